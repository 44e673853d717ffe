"""Quality classifier: regularised quadratic discriminant over document statistics.

Every text becomes a short vector of transformed statistics. Class means and
covariances come from moment sums over all labelled rows, added up by Spark.
Covariances are shrunk towards the pooled one and its diagonal; Cholesky
factors are computed once and scores are differences of Gaussian log densities.

Defined cases: null and empty texts have the statistics of no words and get a
score like any other; rows whose label is null, or whose doc_id is null, are
not learned from; a doc_id labelled twice counts twice; a class without labels
gives the score 0.5 to all; an empty table gives an empty result; further
input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import held_out, reader_rows, settle, ship, slices
from skyledger.llm.words import SPACED, owners, shingle_hashes, word_hashes

FEATURES = (
    "log_words", "log_word_bytes", "upper", "digit", "punctuation", "symbol", "exclamation",
    "distinct_words", "top_word", "repeated_runs", "repeated_lines", "words_per_line", "other_bytes",
)
WIDTH = len(FEATURES)


def _class_table(characters: bytes) -> np.ndarray:
    table = np.zeros(256, np.uint8)
    table[list(characters)] = 1
    return table


_UPPER = _class_table(bytes(range(65, 91)))
_DIGIT = _class_table(b"0123456789")
_PUNCTUATION = _class_table(b".,;:?'\"()-")
_SYMBOL = _class_table(b"#*$%&|<>{}[]\\/=+~^@_`")
_EXCLAMATION = _class_table(b"!")
_HIGH = _class_table(bytes(range(128, 256)))


def _repetition(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text: number of distinct values, and the count of the commonest one."""
    n = offsets.size - 1
    key = (owners(offsets).astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24))
    key.sort()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if key.size else np.zeros(0, np.int64)
    owner = (key[first] >> np.uint64(40)).astype(np.int64)
    run = np.diff(np.append(first, key.size))
    most = np.zeros(n, np.int64)
    np.maximum.at(most, owner, run)
    return np.bincount(owner, minlength=n), most


def statistics(texts: list[bytes]) -> np.ndarray:
    """Transformed statistics, one row for each whole text."""
    words, offsets = word_hashes(texts, SPACED)
    n_words = np.diff(offsets).astype(float)
    size = np.array([len(t) for t in texts], float)
    joined = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])[:-1]
    count = lambda t: np.add.reduceat(t[joined], begins, dtype=np.int64).astype(float)
    distinct, most = _repetition(words, offsets)
    runs, run_offsets = shingle_hashes(words, offsets, 5)
    distinct_runs, _ = _repetition(runs, run_offsets)
    n_runs = np.diff(run_offsets)
    lines = [t.split(b"\n") for t in texts]
    n_lines = np.array([len(x) for x in lines], float)
    n_distinct_lines = np.array([len(set(x)) for x in lines], float)
    part = lambda a, b: a / np.maximum(b, 1.0)
    root = lambda a, b: np.sqrt(part(a, b))
    return np.column_stack([
        np.log1p(n_words),
        np.log1p(part(size, n_words)),
        root(count(_UPPER), size),
        root(count(_DIGIT), size),
        root(count(_PUNCTUATION), size),
        root(count(_SYMBOL), size),
        root(count(_EXCLAMATION), size),
        np.log1p(distinct) / np.maximum(np.log1p(n_words), 1.0),
        root(most, n_words + 20.0),
        root(n_runs - distinct_runs, n_runs),
        root(n_lines - n_distinct_lines, n_lines),
        np.log1p(part(n_words, n_lines)),
        root(count(_HIGH), size),
    ])


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the vector ``stats`` of every document, settled."""
    ship(docs.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for rows, texts in slices(frame, 1 << 20):
                yield pd.DataFrame({"doc_id": rows["doc_id"], "stats": list(statistics(texts).astype(np.float32))})

    out = docs.select("doc_id", "text").mapInPandas(run, "doc_id long, stats array<float>")
    with reader_rows(docs.sparkSession, 1000):
        return settle(out, "quality-statistics", records=1000)


def fit(stats: DataFrame, labels: DataFrame, shrink: float = 0.1, ridge: float = 0.02, exclude=None) -> dict | None:
    """Class means and Cholesky factors from moment sums over all labelled rows.

    ``labels`` has doc_id and ``label`` (0 or 1). ``shrink`` is the weight of the
    pooled covariance, ``ridge`` that of its mean variance on the diagonal.
    Only two rows of moments reach the driver.
    """
    rows = stats if exclude is None else stats.filter(~exclude)
    known = rows.join(labels.filter("label IN (0, 1)"), "doc_id")

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, 1 + WIDTH + WIDTH * WIDTH))
        for frame in frames:
            x = np.stack(frame["stats"].to_list()).astype(float) if len(frame) else np.zeros((0, WIDTH))
            for label in (0, 1):
                own = x[frame["label"].to_numpy() == label]
                total[label] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        yield pd.DataFrame({
            "label": np.repeat([0, 1], total.shape[1]),
            "place": np.tile(np.arange(total.shape[1]), 2),
            "value": total.ravel(),
        })

    moments = (
        known.select("label", "stats")
        .mapInPandas(partial, "label int, place int, value double")
        .groupBy("label", "place")
        .agg(F.sum("value").alias("value"))
        .toPandas()
    )
    total = np.zeros((2, 1 + WIDTH + WIDTH * WIDTH))
    total[moments["label"], moments["place"]] = moments["value"]
    n = total[:, 0]
    if n.min() < 1:
        return None
    means = total[:, 1 : 1 + WIDTH] / n[:, None]
    second = total[:, 1 + WIDTH :].reshape(2, WIDTH, WIDTH)
    covariances = second / n[:, None, None] - means[:, :, None] * means[:, None, :]
    pooled = (covariances * n[:, None, None]).sum(0) / n.sum()
    # Each statistic keeps a variance of its own scale, so a constant one does not dominate.
    floor = np.diag(np.maximum(np.diag(pooled), 1e-4)) + ridge * np.eye(WIDTH) * np.diag(pooled).mean()
    factors, logdets = [], []
    for label in (0, 1):
        weight = max(shrink, WIDTH / (n[label] + WIDTH))
        shrunk = (1 - weight) * covariances[label] + weight * (0.5 * pooled + 0.5 * floor)
        factor = np.linalg.cholesky(shrunk + 1e-6 * np.eye(WIDTH))
        factors.append(np.linalg.inv(factor))
        logdets.append(2 * np.log(np.diag(factor)).sum())
    return {"means": means, "inverse": np.stack(factors), "logdets": np.array(logdets), "prior": np.log(n / n.sum())}


def scores(model: dict | None, x: np.ndarray) -> np.ndarray:
    """Posterior probability of class 1 for each row of statistics."""
    if model is None:
        return np.full(len(x), 0.5)
    logs = []
    for label in (0, 1):
        z = (x - model["means"][label]) @ model["inverse"][label].T
        logs.append(model["prior"][label] - 0.5 * (z * z).sum(1) - 0.5 * model["logdets"][label])
    return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def score(stats: DataFrame, model: dict | None) -> DataFrame:
    """doc_id and ``score`` of every row of statistics."""
    shared = stats.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                x = np.stack(frame["stats"].to_list()).astype(float)
                yield pd.DataFrame({"doc_id": frame["doc_id"], "score": scores(shared.value, x)})

    return stats.mapInPandas(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted for every document.

    Learned from labelled rows outside the held-out fifth (crc32 of doc_id mod 5 is 0).
    """
    stats = with_statistics(docs)
    model = fit(stats, labels, exclude=held_out("doc_id", 5, 0))
    return score(stats, model).select(
        "doc_id",
        held_out("doc_id", 5, 0).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
