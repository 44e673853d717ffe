"""Findings of round 3: rows the statistics are read in, texts hashed once, marks of the repeated passages."""

from __future__ import annotations

import random
import re

import numpy as np

from skyledger.llm import decontaminate, quality_qda, substring_dedup
from skyledger.llm.words import ALNUM, word_hashes

READER = "spark.sql.parquet.columnarReaderBatchSize"


def test_statistics_are_read_in_batches_of_bounded_rows(spark, tmp_path, monkeypatch):
    """The reader holds a batch's texts as one array in the executor; the session's setting comes back afterwards."""
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame([(k, f"some words {k}") for k in range(3000)], "doc_id long, text string").write.parquet(path)
    seen, settled, before = [], quality_qda.settle, spark.conf.get(READER)

    def settle(df, label, **options):
        seen.append(int(spark.conf.get(READER)))
        return settled(df, label, **options)

    monkeypatch.setattr(quality_qda, "settle", settle)
    stats = quality_qda.with_statistics(spark.read.parquet(path))
    assert sorted(r.doc_id for r in stats.select("doc_id").collect()) == list(range(3000))
    assert seen and max(seen) <= 1000
    assert spark.conf.get(READER) == before


def test_image_of_passages_by_dense_product():
    """Columns that one, some or nearly all passages hold; more passages than are added at a time."""
    rng = np.random.default_rng(4)
    n, columns = decontaminate._PASSAGES + 300, 900
    rows = [np.unique(np.concatenate([[k % 5], rng.integers(0, columns, rng.integers(0, 31))])) for k in range(n)]
    passage, column = np.repeat(np.arange(n), [r.size for r in rows]), np.concatenate(rows)
    passage = np.where(passage > 7, passage + 1, passage)  # one without a column
    count, idf = rng.integers(1, 4, column.size), rng.random(columns).astype(np.float32) + 0.1
    start = rng.normal(size=(columns, decontaminate.RANK)).astype(np.float32)
    total = np.zeros((columns, decontaminate.RANK), np.float32)
    decontaminate.add_image(total, passage, column, count, idf, start)
    matrix = np.zeros((n + 1, columns))
    matrix[passage, column] = idf[column] * count
    matrix /= np.maximum(np.linalg.norm(matrix, axis=1), 1e-9)[:, None]
    np.testing.assert_allclose(total, matrix.T @ (matrix @ start), rtol=1e-3, atol=1e-3)


def test_running_sums_over_blocks():
    rng = np.random.default_rng(5)
    column = np.arange(1 << decontaminate.BITS) - 30_000  # the lower places have no column
    projection = decontaminate.Projection(np.maximum(column, -1), rng.normal(size=(36_000, 7)).astype(np.float32))
    for n in (0, 1, 15, 16, 17, 1000):
        words = rng.integers(0, 1 << 63, n).astype(np.uint64) << np.uint64(1)
        sums, before = projection.sums(words)
        own = projection.column[(words >> np.uint64(48)).astype(int)]
        assert before[-1] == (own >= 0).sum()
        right = np.concatenate([np.zeros((1, 7)), np.cumsum(projection.table[own[own >= 0]].astype(float), axis=0)])
        np.testing.assert_allclose(sums[: before[-1] + 1], right, atol=1e-3)


def test_a_region_of_one_word_of_the_item_is_left_out_before_the_exact_count():
    """A word that fills a text is one word of the item, however often it stands there."""
    texts = [b"the " * 60, b"the cat sat on a mat in an old red house " + b"the " * 20]
    words, offsets = word_hashes(texts, ALNUM)
    column = np.arange(1 << decontaminate.BITS)
    projection = decontaminate.Projection(column, np.ones((column.size, 3), np.float32))
    items = decontaminate.Items([7], [b"the cat sat on a mat in an old red house"], [b""], projection)
    near = decontaminate.candidates(words, offsets, items, projection, 0.5)
    assert set(near[0].tolist()) == {0, 1}
    assert {r[0] for r in decontaminate.regions(words, offsets, items, near, 0.5)} == {1}


def test_unit_begins_by_splitting_each_text():
    end = re.compile(r"(?<=[.!?])[ \t]+|[\r\n]+")
    rng = random.Random(6)
    odd = " \t\n\r\x0b\x0c\x1c\x85\xa0\u2003\u2028\u3000" + "..!?" + "ab\u00e9\u4e00\U0001f600\ud800\0"
    texts = ["", "\n", ". ", "a", "a.", "a. b", "a.\u00a0 b", "a.\n", "\ta"]
    texts += ["".join(rng.choice(odd) for _ in range(rng.randrange(60))) for _ in range(4000)]
    begins, at = [], 0
    for text in texts:
        for n in filter(None, map(len, map(str.split, end.split(text)))):
            begins.append(at)
            at += n
    assert substring_dedup.unit_begins(texts).tolist() == begins
    assert substring_dedup.unit_begins([]).tolist() == substring_dedup.unit_begins(["", " "]).tolist() == []


def test_held_seeds_reach_the_workers_as_arrays(spark, monkeypatch):
    """Not as a record for each seed; and a passage shared by two texts still goes to the word."""
    rng, columns = random.Random(7), []
    word = lambda: f"w{rng.getrandbits(40):x}"
    passage = [word() for _ in range(40)]
    docs = [(k, " ".join([*(word() for _ in range(30)), *passage, *(word() for _ in range(30))])) for k in range(2)]
    around = substring_dedup._around

    def spy(size):
        run = around(size)

        def checked(frames):
            for frame in frames:
                assert "held" not in frame.columns and all(isinstance(x, np.ndarray) for c in ("first", "at") for x in frame[c])
                yield from run(iter([frame]))

        columns.append(size)
        return checked

    monkeypatch.setattr(substring_dedup, "_around", spy)
    runs = substring_dedup.repeated_runs(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    begin = docs[1][1].index(passage[0])
    assert [(r.doc_id, r.begin, r.stop, r.n_words) for r in runs] == [(1, begin, begin + len(" ".join(passage)), 40)]
    assert columns


def test_frequent_keys_are_joined_without_a_shuffle_and_only_if_there_are_any(spark, tmp_path):
    rows = [(k % 1500 if k < 3000 else -1, k) for k in range(4000)]
    spark.createDataFrame(rows, "first long, at int").write.parquet(str(tmp_path / "rows"))
    spark.createDataFrame([(k, 2) for k in range(1500)] + [(-1, 1000)], "first long, n long").write.parquet(str(tmp_path / "keyed"))
    rows, keyed = (spark.read.parquet(str(tmp_path / name)) for name in ("rows", "keyed"))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "4000")  # above the frequent ones, below the others
    try:
        spread = substring_dedup._spread_join(rows, keyed, ["first"], 4000)
        physical = spread._jdf.queryExecution().executedPlan().toString()
        assert physical.count("BroadcastHashJoin") == 2 and physical.count("SortMergeJoin") == 1
        assert sorted(r.at for r in spread.collect()) == list(range(4000))
        plain = substring_dedup._spread_join(rows, keyed.filter("first >= 0"), ["first"], 4000)
        assert "Union" not in plan(plain) and plan(plain).count("Relation") == 2
        assert sorted(r.at for r in plain.collect()) == list(range(3000))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
