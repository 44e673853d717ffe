"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document has the set of its hashed words, word pairs and pairs with one word
between them. Training goes over a bounded sample of labelled rows; learning
rates are kept per coordinate and the L1 term leaves few weights, which are
broadcast. Scoring reads whole texts.

Defined cases: null and empty texts have the score of the bias alone; rows
with a null label or null doc_id are not learned from; without labels the
score is 0 for all; an empty table gives an empty result; repeated rows are
scored alike; further input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import held_out, ship, slices
from skyledger.llm.words import ALNUM, mix, word_hashes

BITS = 20
_PAIR, _SKIP = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature places of each text, sorted, and their offsets."""
    words, offsets = word_hashes(texts, ALNUM)
    n, owner = len(texts), np.repeat(np.arange(len(texts), dtype=np.uint64), np.diff(offsets))
    parts = [(owner, words)]
    for gap, factor in ((1, _PAIR), (2, _SKIP)):
        if words.size > gap:
            inside = owner[gap:] == owner[:-gap]
            parts.append((owner[gap:][inside], mix(words[:-gap] * factor + words[gap:])[inside]))
    key = np.concatenate([(o << np.uint64(BITS)) | (h >> np.uint64(64 - BITS)) for o, h in parts])
    key.sort()
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if key.size else key
    ends = np.searchsorted(key, np.arange(n + 1, dtype=np.uint64) << np.uint64(BITS))
    return (key & np.uint64((1 << BITS) - 1)).astype(np.uint32), ends


def train(rows: list[np.ndarray], labels: np.ndarray, alpha=2.0, beta=1.0, l1=5.0, l2=1.0, epochs=8, seed=7) -> dict:
    """FTRL-proximal over the rows' feature sets; returns the non-zero weights and the bias."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bias = bias_n = 0.0
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at = rows[i]
            zi, ni = z[at], n[at]
            w = np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(ni)) / alpha + l2))
            g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - labels[i]
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[at], n[at] = zi + g - sigma * w, ni + g * g
            bias_n += g * g
            bias -= alpha / (beta + np.sqrt(bias_n)) * g
    at = np.flatnonzero(np.abs(z) > l1)
    w = (np.sign(z[at]) * l1 - z[at]) / ((beta + np.sqrt(n[at])) / alpha + l2)
    return {"at": at.astype(np.uint32), "w": w, "bias": bias}


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000) -> dict | None:
    """Weights from at most about ``max_rows`` labelled rows, chosen by a hash of doc_id.

    Features seen in fewer than three sampled rows are left out before training.
    """
    ship(docs.sparkSession)
    known = labels.filter("label IN (0, 1) AND doc_id IS NOT NULL AND NOT (crc32(CAST(doc_id AS STRING)) % 5 = 0)")
    share = min(1.0, max_rows / max(known.count(), 1))
    chosen = known.filter((F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20))) | F.lit(share >= 1))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for rows, texts in slices(frame):
                at, ends = features(texts)
                yield pd.DataFrame({
                    "doc_id": rows["doc_id"], "label": rows["label"],
                    "places": [at[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])],
                })

    sample = (
        docs.select("doc_id", "text").join(chosen, "doc_id")
        .mapInPandas(run, "doc_id long, label int, places binary").toPandas().sort_values(["doc_id"], kind="stable")
    )
    rows = [np.frombuffer(x, np.uint32) for x in sample["places"]]
    if not rows:
        return None
    seen = np.zeros(1 << BITS, np.int32)
    for at in rows:
        seen[at] += 1
    return train([at[seen[at] >= 3] for at in rows], sample["label"].to_numpy().astype(float))


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id and ``score`` of every document."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fitted = shared.value
        dense = np.zeros(1 << BITS)
        if fitted is not None:
            dense[fitted["at"]] = fitted["w"]
        for frame in frames:
            for rows, texts in slices(frame):
                if fitted is None:
                    p = np.zeros(len(texts))
                else:
                    at, ends = features(texts)
                    total = np.concatenate([[0.0], np.cumsum(dense[at])])
                    p = 1 / (1 + np.exp(-np.clip(total[ends[1:]] - total[ends[:-1]] + fitted["bias"], -500, 500)))
                yield pd.DataFrame({"doc_id": rows["doc_id"], "score": p})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score and predicted; learned outside the held-out fifth."""
    return score(docs, fit(docs, labels, max_rows)).select(
        "doc_id",
        held_out("doc_id", 5, 0).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
