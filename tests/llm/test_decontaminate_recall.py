"""Recall of benchmark items of few words and of paraphrases, against the confirmation rule over every place."""

from __future__ import annotations

import random

import numpy as np
import pytest

from skyledger.llm import decontaminate
from skyledger.llm.words import ALNUM, word_hashes

SYLLABLES = [a + b for a in "bcdfghklmnprstvz" for b in ("a", "e", "i", "o", "u", "ar", "en", "il")]


def vocabulary(rng, n):
    return ["".join(rng.choice(SYLLABLES) for _ in range(rng.choice((2, 3)))) for _ in range(n)]


def altered(rng, item, words, how):
    out = list(item)
    if how == "replaced":
        for k in rng.sample(range(len(out)), len(out) // 5):
            out[k] = rng.choice(words)
    elif how == "deleted":
        out = [w for k, w in enumerate(out) if k % 5 != 2]
    elif how == "inserted":
        for k in sorted(rng.sample(range(len(out)), len(out) // 3), reverse=True):
            out.insert(k, rng.choice(words))
    return out


def confirmable(document, item, share=0.7):
    """Whether some place of the document has a common subsequence of that share of the item, by dynamic programming."""
    n = len(item)
    for low in range(0, max(1, len(document) - n), max(1, n // 3)):
        here = document[max(0, low - n) : low + 2 * n]
        row = [0] * (n + 1)
        for w in here:
            above = row[:]
            for k in range(n):
                row[k + 1] = above[k] + 1 if item[k] == w else max(above[k + 1], row[k])
        if row[n] >= share * n:
            return True
    return False


@pytest.mark.parametrize("length, how", [(4, ""), (5, ""), (6, ""), (8, ""), (10, ""), (15, "replaced"), (30, "replaced"), (30, "deleted"), (30, "inserted")])
def test_planted_items_are_found(spark, length, how):
    rng = random.Random(length)
    words = vocabulary(rng, 4000)
    items = [[rng.choice(words) for _ in range(length)] for _ in range(60)]
    items += [[rng.choice(words) for _ in range(40)] for _ in range(20)]
    rows, planted = [], set()
    for k in range(240):
        text = [rng.choice(words) for _ in range(150)]
        if k < 60:
            at = rng.randrange(len(text))
            text[at:at] = altered(rng, items[k], words, how)
            if confirmable(text, items[k]):
                planted.add((k, k))
        rows.append((k, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    assert len(planted) >= 54
    assert len(planted & got) >= 0.99 * len(planted)
    assert {d for d, _ in got} <= {d for d, _ in planted} or all(confirmable(rows[d][1].split(), items[i], 0.5) for d, i in got)


def test_signature_drops_no_confirmable_region():
    """The bound that leaves regions out, against the longest common subsequence of each."""
    rng = random.Random(2)
    words = vocabulary(rng, 60)
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice((5, 80, 300)))).encode() for _ in range(30)]
    bench = [" ".join(rng.choice(words) for _ in range(rng.choice((3, 12, 20)))).encode() for _ in range(25)]
    found, offsets = word_hashes(texts, ALNUM)
    column = np.arange(1 << decontaminate.BITS)
    table = np.random.default_rng(1).normal(size=(column.size, 8)).astype(np.float32)
    projection = decontaminate.Projection(column, table)
    items = decontaminate.Items(list(range(25)), bench, [b""] * 25, projection)
    near = decontaminate.candidates(found, offsets, items, projection, -2.0)
    every = decontaminate.regions(found, offsets, items, near, -1.0)
    kept = {r[:4] for r in decontaminate.regions(found, offsets, items, near, 0.5)}
    assert len(every) >= 25 * 30
    for text, item, low, high, _ in every:
        share = items.common_subsequence(item, found[low:high]) / items.length[item]
        assert share < 0.5 or (text, item, low, high) in kept


def test_items_are_read_in_blocks_of_bytes(spark):
    bench = spark.createDataFrame([(k, "w" * 100) for k in range(25)], "item_id long, text string").selectExpr("*", "null answer")
    blocks = list(decontaminate._blocks(bench, 1000, 1000))
    assert [len(b[0]) for b in blocks] == [10, 10, 5]
    assert [len(b[0]) for b in decontaminate._blocks(bench, 7)] == [7, 7, 7, 4]
