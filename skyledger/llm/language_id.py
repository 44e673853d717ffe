"""Language ID: averaged hashed subword embeddings with a linear softmax.

A text is the average of the embeddings of its hashed byte triples and
quadruples (lower case, word breaks included). Embeddings and softmax are
trained together by stochastic gradient descent in numpy over a bounded sample;
a held-back part of it sets the temperature and the rejection threshold.
Embedding and softmax are both linear, so scoring adds up one row of class
weights per subword of the whole text.

Defined cases: a null text or one without a letter is `und` with score 0; with
no labelled rows every text is `und`; a language with one row is learned too;
rows with a null doc_id or null lang are not learned from; an empty table gives
an empty result; further input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import as_bytes, held_out, ship, slices
from skyledger.llm.words import ALNUM

BUCKETS = 1 << 13
WIDTH = 24
_SIZES = ((3, np.uint64(0x9E3779B97F4A7C15)), (4, np.uint64(0xC2B2AE3D27D4EB4F)))


def subwords(text: bytes) -> np.ndarray:
    """Buckets of all subwords of one text, in two runs (triples, quadruples)."""
    norm = ALNUM[np.frombuffer(b" " + text + b" " * 9, np.uint8)]
    eight = np.ndarray((norm.size - 7,), "<u8", buffer=norm.data, strides=(1,))
    out = []
    for size, factor in _SIZES:
        n = max(len(text) + 3 - size, 0)
        gram = eight[:n] & np.uint64((1 << (8 * size)) - 1)
        out.append(((gram * factor) >> np.uint64(51)).astype(np.uint16))
    return np.concatenate(out)


def has_letter(text) -> bool:
    return isinstance(text, str) and any(map(str.isalpha, text))


def train(counts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, epochs=12, rate=0.5, batch=32, seed=5) -> dict:
    """SGD over normalised subword counts; a fifth is held back for calibration."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(counts))
    back, fit = order[: len(order) // 5], order[len(order) // 5 :]
    embed = rng.normal(0, 0.5, (BUCKETS, WIDTH)).astype(np.float32)
    soft = np.zeros((WIDTH, classes), np.float32)

    def dense(rows: np.ndarray) -> np.ndarray:
        x = np.zeros((len(rows), BUCKETS), np.float32)
        for k, i in enumerate(rows):
            at, n = counts[i]
            x[k, at] = n / max(n.sum(), 1)
        return x

    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        fit = rng.permutation(fit)
        for k in range(0, len(fit), batch):
            rows = fit[k : k + batch]
            x = dense(rows)
            hidden = x @ embed
            logits = hidden @ soft
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), labels[rows]] -= 1
            p /= len(rows)
            back_x = p @ soft.T
            soft -= step * 8 * (hidden.T @ p)
            embed -= step * BUCKETS / 16 * (x.T @ back_x)
    weights = embed @ soft
    temperature, reject = 1.0, 0.0
    if len(back):
        logits = np.concatenate([dense(back[k : k + batch]) @ weights for k in range(0, len(back), batch)])
        best = np.inf
        for t in np.geomspace(0.05, 5, 30):
            p = _softmax(logits / t)
            loss = -np.log(p[np.arange(len(back)), labels[back]] + 1e-9).mean()
            if loss < best:
                best, temperature = loss, float(t)
        p = _softmax(logits / temperature)
        right = p.argmax(1) == labels[back]
        reject = float(np.quantile(p.max(1)[right], 0.01)) if right.any() else 0.0
    return {"weights": (weights / temperature).astype(np.float32), "reject": reject}


def _softmax(logits: np.ndarray) -> np.ndarray:
    p = np.exp(logits - logits.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def fit(docs: DataFrame, max_rows: int = 6_000, per_language: int = 800) -> dict:
    """A model from at most about ``max_rows`` rows, ``per_language`` of each language at most.

    Rows are chosen by a hash of doc_id; every language is represented. All
    known languages are counted; ids outside the held-out fifth only.
    """
    ship(docs.sparkSession)
    known = docs.select("doc_id", "text", "lang").filter(
        "lang IS NOT NULL AND doc_id IS NOT NULL AND text IS NOT NULL AND NOT (crc32(CAST(doc_id AS STRING)) % 5 = 0)"
    )
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not sizes:
        return {"languages": [], "weights": np.zeros((BUCKETS, 0), np.float32), "reject": 0.0}
    each = max(2, min(per_language, max_rows // len(sizes)))
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, each / n) * (1 << 20))])
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.greatest(share[F.col("lang")], F.lit(1.0)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for text in as_bytes(frame["text"]):
                at, n = np.unique(subwords(text), return_counts=True)
                out.append((at.tobytes(), n.astype(np.uint32).tobytes()))
            yield pd.DataFrame({
                "doc_id": frame["doc_id"], "lang": frame["lang"],
                "places": [x for x, _ in out], "n": [x for _, x in out],
            })

    rows = chosen.mapInPandas(run, "doc_id long, lang string, places binary, n binary").toPandas()
    rows = rows.sort_values("doc_id", kind="stable")
    languages = sorted(set(rows["lang"]))
    index = {x: i for i, x in enumerate(languages)}
    counts = [(np.frombuffer(a, np.uint16), np.frombuffer(b, np.uint32)) for a, b in zip(rows["places"], rows["n"])]
    model = train(counts, np.array([index[x] for x in rows["lang"]], int), len(languages))
    return {"languages": languages, **model}


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred, score, and whether the score passes the calibrated threshold."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, weights = shared.value["languages"], np.ascontiguousarray(shared.value["weights"].T)
        for frame in frames:
            for rows, texts in slices(frame):
                known, logits = [], np.zeros((len(texts), len(names)))
                for i, (raw, text) in enumerate(zip(rows["text"], texts)):
                    known.append(bool(names) and has_letter(raw))
                    if known[-1]:
                        at = np.bincount(subwords(text), minlength=BUCKETS)
                        logits[i] = weights @ at.astype(np.float32) / max(at.sum(), 1)
                p = _softmax(logits) if names else np.zeros((len(texts), 1))
                best, top = p.argmax(1), np.where(known, p.max(1), 0.0)
                yield pd.DataFrame({
                    "doc_id": rows["doc_id"],
                    "lang_pred": [names[b] if k else "und" for b, k in zip(best, known)],
                    "score": top,
                    "accepted": np.array(known, bool) & (top >= shared.value["reject"]),
                })

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, lang_pred string, score double, accepted boolean")


def identify(docs: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted for every document."""
    return predict(docs, fit(docs, **options)).select(
        "doc_id", held_out("doc_id", 5, 0).alias("held_out"), "lang_pred", "score", "accepted"
    )
