"""Product codes of vectors: codebooks refined in rounds, with norm-of-sum bounds before exact rescans.

Components become whole numbers, so every distance, mean and tie is exact. The
codebooks of all rounds are kept. Beside its code each part of a vector carries,
for every group of entries, a lower bound of the distance to the group's entries
other than its own, and the round the bound was measured in (its stamp). Later
that bound loses only the net displacement of the entries since its stamp, the
norm of the sum of their moves and not the sum of the moves' norms. A group is
compared exactly again only where its bound no longer exceeds the distance to the
part's own entry, which is measured anew in every round.

A round is one pass over the table of the round before. Each task writes its
vectors with their new codes and bounds and adds one row per entry with count and
sums, from which the next codebook follows: 256 entries per part reach the
driver, whatever the input. The table before is emptied after the next is whole,
so two of them exist at a time and lost executors repeat one round at most.

Defined cases: a null vector, or one with a null or non-finite component, is
dropped, as is one with a component of 2**86 or more in size, whose squares no
long could hold; errors over a long's range stop at its end. Vectors of another
length than the commonest (of equally common ones the shorter) are dropped; a
length that the number of parts does not divide is filled up with zeros. Fewer
vectors than entries give as many entries. A null vec_id ranks behind all others;
equal vec_ids rank by their components; repeated rows are coded each; null
labels are one label; an empty table gives an empty result; further columns are
ignored whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyledger.llm.common import ship
from skyledger.session import scratch_path

SCALE = 1024
#: Groups of entries with a bound of their own.
GROUPS = 8
#: Vectors that a task compares at a time.
ROWS = 8192
_LIMIT = float(2**86)
_LONGEST = 2**63 - 1
#: Relative and absolute room for rounding in square roots and stored bounds.
_ROOM, _LEAST = 1e-6, 1e-3


def kept_vectors(embeddings: DataFrame) -> DataFrame:
    """``vec_id``, ``vector`` and ``label`` of the rows that are coded."""
    fine = F.forall("vector", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < _LIMIT / SCALE), F.lit(False)))
    rows = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"), "label")
    return rows.filter(F.col("vector").isNotNull() & (F.size("vector") > 0) & fine)


def _shape(rows: DataFrame) -> tuple[int, int] | None:
    """The commonest length of a vector and the largest component in size, in whole steps."""
    peak = F.array_max(F.transform("vector", lambda x: F.abs(x)))
    found = rows.groupBy(F.size("vector").alias("length")).agg(F.count("*").alias("n"), F.max(peak).alias("peak"))
    best = found.orderBy(F.desc("n"), "length").first()
    return best and (best.length, math.ceil(best.peak * SCALE) + 1)


def _exact_floats(width: int, peak: int) -> bool:
    """Whether squared distances of parts are whole numbers that a double holds exactly."""
    return width * (2 * peak) ** 2 < 1 << 52


class Numbers:
    """Whole components as arrays: doubles where they are exact, Python integers beyond."""

    def __init__(self, length: int, parts: int, peak: int):
        self.parts, self.width = parts, -(-length // parts)
        self.exact = _exact_floats(self.width, peak)
        self.stored = np.dtype("<i2" if peak < 1 << 15 else "<i4" if peak < 1 << 31 else "<i8")

    def whole(self, vectors: list) -> np.ndarray:
        """floor(1024 x) as rows by parts by positions."""
        length = self.parts * self.width
        if self.exact:
            full = np.zeros((len(vectors), length))
            if len(vectors):
                given = np.floor(np.stack(vectors).astype(np.float64) * SCALE)
                full[:, : given.shape[1]] = given
        else:
            full = np.zeros((len(vectors), length), object)
            for row, vector in zip(full, vectors):
                row[: len(vector)] = [math.floor(float(x) * SCALE) for x in vector]
        return full.reshape(len(vectors), self.parts, self.width)

    def pack(self, whole: np.ndarray) -> list[bytes]:
        flat = whole.reshape(len(whole), -1)
        if self.exact:
            data, step = flat.astype(self.stored).tobytes(), flat.shape[1] * self.stored.itemsize
            return [data[i : i + step] for i in range(0, len(data), step)]
        return [",".join(map(str, row)).encode() for row in flat]

    def unpack(self, packed: list[bytes]) -> np.ndarray:
        if self.exact:
            flat = np.frombuffer(b"".join(packed), self.stored).astype(np.float64)
        else:
            flat = np.array([int(x) for row in packed for x in row.decode().split(",")], object)
        return flat.reshape(len(packed), self.parts, self.width)

    def squares(self, points: np.ndarray, entries: np.ndarray) -> np.ndarray:
        """Squared distances, points by entries."""
        if self.exact:
            cross = points @ entries.T
            return (points**2).sum(1)[:, None] + (entries**2).sum(1)[None] - 2 * cross
        return ((points[:, None] - entries[None]) ** 2).sum(2)

    def sums(self, points: np.ndarray, codes: np.ndarray, entries: int) -> np.ndarray:
        if self.exact:
            return np.stack([np.bincount(codes, points[:, j], entries) for j in range(self.width)], axis=1)
        total = np.zeros((entries, self.width), object)
        np.add.at(total, codes, points)
        return total


def _roots(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64))


class Assigner:
    """Nearest entries of one part position in the last of the codebooks so far."""

    def __init__(self, numbers: Numbers, history: list[np.ndarray], groups: int):
        self.numbers, self.now = numbers, len(history) - 1
        self.entries = history[-1] if numbers.exact else history[-1].astype(object)
        size = len(self.entries)
        edges = np.linspace(0, size, min(groups, size) + 1).astype(int)
        self.spans = list(zip(edges[:-1].tolist(), edges[1:].tolist()))
        self.group_of = np.repeat(np.arange(len(self.spans)), np.diff(edges))
        # Net displacement since each round: the largest within a group.
        moved = np.array([_roots(((self.entries - old) ** 2).sum(1)) for old in history])
        self.moved = np.stack([moved[:, a:b].max(1) for a, b in self.spans], axis=1) * (1 + _ROOM)

    def first(self, points: np.ndarray):
        """Bounds that make every group be compared."""
        shape = (len(points), len(self.spans))
        return self.assign(points, None, np.zeros(shape), np.zeros(shape, np.uint8))

    def assign(self, points, codes, bounds, stamps):
        """(codes, squared distances, bounds, stamps, entries compared) of the points."""
        n, every = len(points), np.arange(len(points))
        compared = np.zeros(n, np.int64)
        lower = bounds - self.moved[stamps, np.arange(len(self.spans))]
        if codes is None:
            best, code = np.full(n, np.inf if self.numbers.exact else 2**400, None if self.numbers.exact else object), np.full(n, 256)
            open_ = np.ones(lower.shape, bool)
        else:
            code = codes.astype(np.int64)
            best = ((points - self.entries[code]) ** 2).sum(1)
            compared += 1
            open_ = lower <= (_roots(best) * (1 + _ROOM) + _LEAST)[:, None]
        before, own = code.copy(), best.copy()
        nearest = {}
        for g, (a, b) in enumerate(self.spans):
            rows = np.flatnonzero(open_[:, g])
            if not len(rows):
                continue
            squares = self.numbers.squares(points[rows], self.entries[a:b])
            compared[rows] += b - a
            at = squares.argmin(axis=1)
            least = squares[np.arange(len(rows)), at]
            found = at + a
            better = (least < best[rows]) | ((least == best[rows]) & (found < code[rows]))
            best[rows[better]], code[rows[better]] = least[better], found[better]
            if b - a > 1:
                squares[np.arange(len(rows)), at] = squares.max() + 1
                second = _roots(squares.min(axis=1))
            else:
                second = np.full(len(rows), np.inf)
            nearest[g] = rows, found, _roots(least), second
        bounds, stamps = bounds.copy(), stamps.copy()
        for g, (rows, found, least, second) in nearest.items():
            bounds[rows, g] = np.where(found == code[rows], second, least)
            stamps[rows, g] = self.now
        if codes is not None:
            # The entry left behind is again one of its group's others.
            left = np.flatnonzero(code != before)
            group = self.group_of[before[left]]
            skipped = ~open_[left, group]
            left, group = left[skipped], group[skipped]
            bounds[left, group] = np.minimum(lower[left, group], _roots(own[left]))
            stamps[left, group] = self.now
        # A stored bound is a 32-bit float, rounded down.
        bounds = np.nextafter(np.maximum(bounds, 0).astype(np.float32), np.float32(-1))
        return code.astype(np.uint8), best, bounds, stamps, compared


def _state_schema(label: T.DataType) -> T.StructType:
    schema = T.StructType.fromDDL(
        "vec_id long, vector binary, codes binary, bounds binary, stamps binary, error long, compared long, "
        "part int, entry int, members long, sums array<string>"
    )
    return T.StructType([schema[0], T.StructField("label", label), *schema.fields[1:]])


def _round(rows: DataFrame, numbers: Numbers, history: list[list[np.ndarray]], groups: int, schema: T.StructType, label: str) -> str:
    """Assign every part anew, write the table of this round and return its path."""
    names, first = schema.names, len(history[0]) == 1
    sizes = [len(book[-1]) for book in history]
    ship(rows.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        assigners = [Assigner(numbers, book, groups) for book in history]
        spans = len(assigners[0].spans)
        counts = [np.zeros(size, np.int64) for size in sizes]
        totals = [np.zeros((size, numbers.width), object) for size in sizes]
        for whole_frame in frames:
            for start in range(0, len(whole_frame), ROWS):
                frame = whole_frame.iloc[start : start + ROWS]
                n = len(frame)
                points = numbers.whole(list(frame["vector"])) if first else numbers.unpack(list(frame["vector"]))
                if first:
                    found = [a.first(points[:, p]) for p, a in enumerate(assigners)]
                else:
                    codes = np.frombuffer(b"".join(frame["codes"]), np.uint8).reshape(n, numbers.parts)
                    bounds = np.frombuffer(b"".join(frame["bounds"]), "<f4").reshape(n, numbers.parts, spans)
                    stamps = np.frombuffer(b"".join(frame["stamps"]), np.uint8).reshape(n, numbers.parts, spans)
                    found = [
                        a.assign(points[:, p], codes[:, p], bounds[:, p].astype(np.float64), stamps[:, p])
                        for p, a in enumerate(assigners)
                    ]
                for p, (code, *_) in enumerate(found):
                    counts[p] += np.bincount(code, minlength=sizes[p])
                    totals[p] += numbers.sums(points[:, p], code, sizes[p]).astype(np.int64 if numbers.exact else object)

                def packed(k: int, kind: str, found=found, n=n) -> list[bytes]:
                    data = np.stack([f[k] for f in found], axis=1).astype(kind).tobytes()
                    return [data[i * len(data) // n : (i + 1) * len(data) // n] for i in range(n)]

                error = sum(f[1] for f in found)
                yield pd.DataFrame({
                    "vec_id": frame["vec_id"], "label": frame["label"],
                    "vector": numbers.pack(points) if first else frame["vector"],
                    "codes": packed(0, "u1"), "bounds": packed(2, "<f4"), "stamps": packed(3, "u1"),
                    "error": [min(int(e), _LONGEST) for e in error],
                    "compared": (0 if first else frame["compared"].to_numpy()) + sum(f[4] for f in found),
                    "part": None, "entry": None, "members": None, "sums": None,
                })[names]
        summed = [
            (p, e, int(counts[p][e]), [str(x) for x in totals[p][e]])
            for p, size in enumerate(sizes)
            for e in range(size)
            if counts[p][e]
        ]
        if summed:
            yield pd.DataFrame(summed, columns=["part", "entry", "members", "sums"]).reindex(columns=names)

    path = scratch_path(rows.sparkSession, f"llm-{label}")
    rows.mapInPandas(run, schema).write.option("compression", "zstd").parquet(path)
    return path


def _refined(table: DataFrame, history: list[list[np.ndarray]]) -> None:
    """Append the next codebooks: componentwise floor of the mean; unused entries stay."""
    sums = table.filter("part IS NOT NULL").select("part", "entry", "members", F.posexplode("sums").alias("at", "s"))
    totals = sums.groupBy("part", "entry", "at").agg(
        F.sum("members").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).cast("string").alias("s")
    )
    books = [book[-1].copy() for book in history]
    for row in totals.collect():
        books[row.part][row.entry, row.at] = int(row.s) // row.n
    for book, new in zip(history, books):
        book.append(new)


def _emptied(spark: SparkSession, path: str, schema: T.StructType) -> None:
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def compress(
    embeddings: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, groups: int = GROUPS
) -> tuple[DataFrame, list[np.ndarray]]:
    """(``vec_id, label, codes, error, compared``, final codebooks by part).

    ``codes`` holds a byte per part, ``error`` the squared distance over all
    parts, ``compared`` how many entries were compared exactly in all rounds.
    """
    spark = embeddings.sparkSession
    schema = _state_schema(embeddings.schema["label"].dataType)
    rows = kept_vectors(embeddings)
    shape = _shape(rows)
    if shape is None:
        return spark.createDataFrame([], schema).select("vec_id", "label", "codes", "error", "compared"), []
    length, peak = shape
    numbers = Numbers(length, parts, peak)
    rows = rows.filter(F.size("vector") == length)
    lowest = rows.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(min(entries, 256)).collect()
    start = numbers.whole([np.array(r.vector) for r in lowest])
    history = [[start[:, p]] for p in range(parts)]
    state, previous = rows.withColumn("vec_id", F.col("vec_id").cast("long")), None
    for step in range(rounds + 1):
        path = _round(state, numbers, history, groups, schema, f"codes-{step}")
        if previous:
            _emptied(spark, previous, schema)
        table = spark.read.schema(schema).parquet(path)
        if step < rounds:
            _refined(table, history)
        state, previous = table.filter("part IS NULL"), path
    return state.select("vec_id", "label", "codes", "error", "compared"), [book[-1] for book in history]


def codebook_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components as decimal integers by part, entry and position."""
    numbers = (str(int(x)) for book in books for entry in book for x in entry)
    return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def digests(coded: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """Codes in hex, errors per vector and label, and the digest of the codebooks."""
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_LONGEST).cast("decimal(38,0)")).cast("long")
    per_label = coded.groupBy(F.col("label").alias("of_label")).agg(total.alias("label_error"))
    return coded.join(per_label, F.col("label").eqNullSafe(F.col("of_label"))).select(
        "vec_id",
        F.lower(F.hex("codes")).alias("code"),
        "error",
        "label_error",
        F.lit(codebook_digest(books)).alias("codebooks_sha256"),
        "compared",
    )
