"""Packing: concatenate all documents and cut the stream into fixed windows.

The first pass encodes every text once and stores the ids with their place
inside the partition. Token totals per partition, one number each, add up to
the offset of every partition; the second pass cuts each document at multiples
of the window size. Only the last window can be short.

Defined cases: null and empty texts are the end id alone; repeated rows are
packed each; a document longer than a window is cut into several pieces; an
empty table gives an empty result; further input columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import settle, ship, slices
from skyledger.llm.tokens import shared_encoder

PIECE_SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


def encoded(docs: DataFrame, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """One row per document: partition, ids before it there, number of ids, and the ids.

    Ids have two bytes where the vocabulary allows it, else four (``width``).
    """
    spark = docs.sparkSession
    ship(spark)
    definition = spark.sparkContext.broadcast(Path(tokenizer_path).read_text(encoding="utf-8"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = shared_encoder(definition.value, keeps_space=True)
        end = int(end_id).to_bytes(encoder.width, "little")
        part, before = TaskContext.get().partitionId(), 0
        for frame in frames:
            for rows, texts in slices(frame, 2 << 20):
                ids = [x + end for x in encoder.encode(texts)]
                n = np.array([len(x) // encoder.width for x in ids], np.int64)
                place = before + np.cumsum(n) - n
                before += int(n.sum())
                yield pd.DataFrame({
                    "part": part, "before": place, "doc_id": rows["doc_id"].to_numpy(), "n": n,
                    "width": encoder.width, "ids": ids,
                })

    out = docs.select("doc_id", "text").mapInPandas(run, "part int, before long, doc_id long, n long, width int, ids binary")
    return settle(out, "packing-ids")


def partition_offsets(stored: DataFrame) -> dict[int, int]:
    """Ids in all partitions before each one; one number per partition reaches the driver."""
    totals = stored.groupBy("part").agg(F.max(F.col("before") + F.col("n")).alias("n")).toPandas().sort_values("part")
    return dict(zip(totals["part"].tolist(), (totals["n"].cumsum() - totals["n"]).tolist()))


def _as_uint32(ids: bytes, width: int) -> np.ndarray:
    return np.frombuffer(ids, "<u2" if width == 2 else "<u4").astype("<u4")


def pieces(stored: DataFrame, window: int = 1024) -> DataFrame:
    """One row per piece of a document: where it stands, and the crc32 of its ids."""
    base = stored.sparkSession.sparkContext.broadcast(partition_offsets(stored))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for part, before, doc_id, n, width, ids in frame.itertuples(index=False):
                values = _as_uint32(ids, width)
                first = at = base.value[part] + before
                while at < first + n:
                    stop = min(first + n, (at // window + 1) * window)
                    cut = values[at - first : stop - first]
                    out.append((doc_id, at - first, stop - at, zlib.crc32(cut.tobytes()), n, at // window, at % window))
                    at = stop
            yield pd.DataFrame(out, columns=[x.split()[0] for x in PIECE_SCHEMA.split(", ")])

    return stored.select("part", "before", "doc_id", "n", "width", "ids").mapInPandas(run, PIECE_SCHEMA)


def sequences(stored: DataFrame, window: int = 1024) -> DataFrame:
    """The packed windows themselves: sequence_id and its ids (array of int).

    A task emits every window that lies inside its rows whole; what is left at
    its two ends are boundary records, and only those are grouped across tasks.
    """
    base = stored.sparkSession.sparkContext.broadcast(partition_offsets(stored))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, np.zeros(0, np.uint32)
        for frame in frames:
            out = []
            for part, before, width, ids in frame.itertuples(index=False):
                place, values = base.value[part] + before, _as_uint32(ids, width)
                if at is not None and place != at + held.size:  # a new file began: what is held ends here
                    out.append((at // window, at % window, held.tolist()))
                    at = None
                held = values if at is None else np.concatenate([held, values])
                at = place if at is None else at
                while at // window < (at + held.size) // window:
                    n = (at // window + 1) * window - at
                    out.append((at // window, at % window, held[:n].tolist()))
                    at, held = at + n, held[n:]
            yield pd.DataFrame(out, columns=["sequence_id", "offset", "ids"])
        if at is not None and held.size:
            yield pd.DataFrame([(at // window, at % window, held.tolist())], columns=["sequence_id", "offset", "ids"])

    cut = stored.select("part", "before", "width", "ids").mapInPandas(run, "sequence_id long, offset long, ids array<int>")
    whole = cut.filter(F.size("ids") == window).select("sequence_id", "ids")
    parts = cut.filter(F.size("ids") < window).groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return whole.unionByName(parts.select("sequence_id", F.flatten(F.col("p.ids")).alias("ids")))


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 0, window: int = 1024) -> DataFrame:
    """Pieces of all documents in windows of ``window`` ids."""
    return pieces(encoded(docs, tokenizer_path, end_id), window)
