"""The fixed-width scans against a scalar reading of the same lines."""

from __future__ import annotations

import calendar
import datetime
import random

import pytest

from skyledger.schemas import ELEMENTS
from skyledger.sources import (
    malformed_counts,
    parse_daily_lines,
    parse_station_lines,
    read_daily_files,
)

YEARS = (2019, 2020)


def scalar_rows(line: str) -> set[tuple]:
    """One line read cell by cell with plain string slicing."""
    found = set()
    if len(line) < 21 or line[17:21].strip() not in ELEMENTS or int(line[11:15]) not in YEARS:
        return found
    year, month = int(line[11:15]), int(line[15:17])
    cells = [line[21 + 8 * n : 29 + 8 * n] for n in range(31)]
    for day, cell in enumerate(cells, start=1):
        if len(cell) < 5:
            break
        value = cell[:5].strip()
        real_day = 1 <= month <= 12 and day <= calendar.monthrange(year, month)[1]
        if value not in ("", "-9999") and real_day:
            flags = [cell[k : k + 1].strip() or None for k in (5, 6, 7)]
            date = datetime.date(year, month, day)
            found.add((line[:11].strip(), date, line[17:21].strip(), int(value), *flags, None))
    return found


def random_line(rng: random.Random) -> str:
    year, month = rng.choice([2018, 2019, 2020]), rng.choice([1, 2, 2, 4, 12, 13])
    head = f"US{rng.randrange(10**9):09d}{year}{month:02d}{rng.choice([*ELEMENTS, 'WT01'])}"
    cells = []
    for _ in range(31):
        value = rng.choice(["-9999", "     ", f"{rng.randrange(-999, 9999):5d}"])
        cells.append(value + "".join(rng.choice(" GTX7") for _ in range(3)))
    line = head + "".join(cells)
    return line[: rng.choice([len(line)] * 3 + [15, 21, 25, 26, 30, 100, 133])]


def test_random_lines_match_scalar_reading(spark):
    rng = random.Random(7)
    lines = [random_line(rng) for _ in range(1000)]
    got = parse_daily_lines(spark.createDataFrame([(x,) for x in lines], "value string"), YEARS)
    rows = [tuple(r) for r in got.collect()]
    expected = set().union(*map(scalar_rows, lines))
    assert len(rows) == len(set(rows)) > 1000
    assert set(rows) == expected


def test_february_and_cut_line(spark):
    full = "US000000001202002TMAX" + "   10   " * 31
    cut = "US000000001201902TMIN" + "   10   " * 3 + "   1"
    df = spark.createDataFrame([(full,), (cut,)], "value string")
    rows = parse_daily_lines(df, YEARS).collect()
    by_element = {e: sorted(r.obs_date.day for r in rows if r.element == e) for e in ("TMAX", "TMIN")}
    assert by_element["TMAX"] == list(range(1, 30))
    assert by_element["TMIN"] == [1, 2, 3]


def test_bad_numbers_are_skipped_counted_or_fatal(spark):
    lines = [
        ("US000000001202001TMAX   1x   " + "    7   ",),
        ("US000000001abcd01TMAX    1   ",),
        ("US0000000012020xxTMAX    1   ",),
    ]
    df = spark.createDataFrame(lines, "value string")
    assert [r.data_value for r in parse_daily_lines(df, YEARS).collect()] == [7]
    counts = malformed_counts(df, YEARS).first()
    assert (counts.bad_years, counts.bad_months, counts.bad_values) == (1, 1, 1)
    with pytest.raises(Exception, match="not an integer"):
        parse_daily_lines(df, YEARS, on_error="fail").collect()


def test_station_from_file_name(spark, tmp_path):
    (tmp_path / "US000000009.dly").write_text("US000000001202001TMAX    5   \n")
    rows = read_daily_files(spark, str(tmp_path), YEARS, station_from="file").collect()
    assert [(r.station_id, r.data_value) for r in rows] == [("US000000009", 5)]


def test_no_years_is_an_error(spark):
    with pytest.raises(ValueError):
        parse_daily_lines(spark.createDataFrame([("x",)], "value string"), [])


def catalogue_line(lat="  10.5000", lon="  -20.2500", elev=" 100.0", tail="GSN HCN 12345"):
    return f"US000000001 {lat.strip():>8} {lon.strip():>9} {elev:>6} AK {'SOME PLACE':<30} {tail}"


def test_catalogue_fields_and_lengths(spark):
    full = catalogue_line()
    assert len(full) == 85
    short = ["US000000002" + full[11:71], "US000000003" + full[11:72], "US000000004" + full[11:76], "US000000005" + full[11:80]]
    lines = [full, *short]
    rows = {
        r.station_id: r
        for r in parse_station_lines(
            spark.createDataFrame([(x,) for x in lines], "value string")
        ).collect()
    }
    assert sorted(rows) == ["US000000001", "US000000003", "US000000004", "US000000005"]
    first = rows["US000000001"]
    assert (first.latitude, first.longitude, first.elevation) == (10.5, -20.25, 100.0)
    assert (first.state, first.station_name) == ("AK", "SOME PLACE")
    assert (first.gsn_flag, first.hcn_flag, first.wmo_id) == ("GSN", "HCN", "12345")
    assert rows["US000000003"].gsn_flag is None and rows["US000000003"].wmo_id is None
    assert rows["US000000004"].gsn_flag == "GSN" and rows["US000000004"].hcn_flag is None
    assert rows["US000000005"].hcn_flag == "HCN" and rows["US000000005"].wmo_id is None


@pytest.mark.parametrize(
    "lat, elev, kept, elevation",
    [
        ("10.5", "-999.9", True, None),
        ("10.5", "", True, None),
        ("10.5", "1.0d", True, None),
        ("10.5", "nan", True, None),
        ("-999.9", "1.0", False, None),
        ("", "1.0", False, None),
        ("abc", "1.0", False, None),
    ],
)
def test_catalogue_numbers(spark, lat, elev, kept, elevation):
    df = spark.createDataFrame([(catalogue_line(lat=lat, elev=elev),)], "value string")
    rows = parse_station_lines(df).collect()
    assert len(rows) == (1 if kept else 0)
    if kept:
        assert rows[0].elevation is elevation


def test_blank_station_name_stays_empty(spark):
    line = catalogue_line()
    line = line[:41] + " " * 30 + line[71:]
    row = parse_station_lines(spark.createDataFrame([(line,)], "value string")).first()
    assert row.station_name == ""
