"""Findings of round 4: files of many observations do not meet on the driver."""

from __future__ import annotations

import re

from skyledger.sources.versions import named
from skyledger.sources.warehouse import Warehouse
from skyledger.streaming.landing import ingest_landing

A, B = "US000000001", "US000000002"


def line(station, year, month, element, *values):
    return f"{station}{year}{month:02d}{element}{''.join(f'{v:5d}   ' for v in values)}\n"


def test_cells_of_a_batch_are_not_broadcast(spark, tmp_path, monkeypatch):
    """Packed files are far smaller than their rows, so their size must not choose the join."""
    warehouse, landing, plans = Warehouse(spark, str(tmp_path / "wh"), station_buckets=1), tmp_path / "landing", []
    merge = Warehouse._merge

    def planned(self, before, touched, added, keep):
        if old := named(before.folders, touched):
            plans.append(keep(self.added_rows(old))._jdf.queryExecution().executedPlan().toString())
        merge(self, before, touched, added, keep)

    monkeypatch.setattr(Warehouse, "_merge", planned)
    landing.mkdir()
    files = [
        line(A, 2020, 1, "TMAX", 1, 2) + line(B, 2020, 1, "TMAX", 5),
        line(A, 2020, 1, "TMAX", 8) * 2 + line(A, 2020, 1, "TMIN", 4),
    ]
    for k, text in enumerate(files):
        (landing / f"{k}.dly").write_text(text)
        ingest_landing(warehouse, str(landing), [2020], str(tmp_path / "p"), scope="file").awaitTermination()
    assert len(plans) == 1
    joins = re.findall(r"(\w+Join) (\[station_id#\d+, obs_date#\d+, element#\d+\]), .*LeftAnti", plans[0])
    assert [kind for kind, _ in joins] == ["SortMergeJoin"]
    rows = sorted((r.station_id, str(r.obs_date), r.element, r.data_value) for r in warehouse.daily().collect())
    assert rows == [
        (A, "2020-01-01", "TMAX", 8), (A, "2020-01-01", "TMAX", 8), (A, "2020-01-01", "TMIN", 4),
        (A, "2020-01-02", "TMAX", 2), (B, "2020-01-01", "TMAX", 5),
    ]
