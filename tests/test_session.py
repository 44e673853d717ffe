"""Session settings and the shared scratch folder."""

from __future__ import annotations

import types

import pytest

from skyledger import session


class Conf(dict):
    def get(self, key, default=None):
        return super().get(key, default)


class FakeSession(types.SimpleNamespace):
    __hash__ = object.__hash__


def test_named_folder_is_used():
    fake = FakeSession(conf=Conf({"spark.checkpoint.dir": "hdfs://x/shared/", "spark.master": "yarn"}))
    assert session.shared_dir(fake) == "hdfs://x/shared"
    one, two = (session.scratch_path(fake, "a") for _ in range(2))
    assert one != two and one.startswith("hdfs://x/shared/skyledger/a-")


def test_cluster_without_folder_is_refused():
    with pytest.raises(RuntimeError):
        session.shared_dir(FakeSession(conf=Conf({"spark.master": "yarn"})))


def test_local_master_falls_back_once():
    fake = FakeSession(conf=Conf({"spark.master": "local[2]"}))
    assert session.shared_dir(fake) == session.shared_dir(fake)


def test_reducers_keep_their_size_at_every_input_size():
    small, large, huge = (session.sized_for(n * 1024**4) for n in (0, 1, 100))
    key = "spark.sql.shuffle.partitions"
    assert int(small[key]) == 200 < int(large[key])
    assert int(huge[key]) == 100 * int(large[key])
    assert huge["spark.sql.files.maxPartitionBytes"] == large["spark.sql.files.maxPartitionBytes"]
    assert int(session.sized_for(1024**4, reducer_mb=512)[key]) * 2 == int(large[key])
