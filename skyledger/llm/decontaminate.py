"""Benchmark decontamination by latent semantic retrieval and sequence checks.

Passages of all documents are TF-IDF vectors over all hashed words. A
randomised SVD finds their leading right singular directions: every partition
adds up A'(A W) for a random W, the sums are added in a tree, and a small SVD
follows. The first direction, which all passages share, is left out and the
others are scaled by their inverse second moments. Windows of every document and
the benchmark items are projected; windows whose cosine with an item reaches
``min_cosine`` are candidates. A candidate is confirmed by the longest common subsequence with the
item, or by a shorter one if the item's answer stands there word for word.

Items are read in blocks of bounded rows and bytes; each block is compared with
all documents. Window lengths follow the lengths of the items, those of few words
included.

Defined cases: null and empty texts or items match nothing; items and documents
that repeat are judged each (one row per pair); an empty table on either side
gives an empty result; ties between places in a document go to the earlier one;
further columns are ignored, but a column ``answer`` of the benchmark is used
as the answer where it is not null (else the item's last five words are).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import semi_join_null_safe, settle, ship, slices
from skyledger.llm.words import ALNUM, word_hashes

#: Words are hashed to 2**BITS places; the places that any passage holds are the columns of the matrix.
BITS = 16
RANK = 48
PASSAGE = 32
#: Bytes of text at a time: in the searches, and in the passes over all passages.
_SLICE, _PASS_SLICE = 1 << 17, 1 << 18
#: Bytes of text that one partial sum of the decomposition stands for at least.
_PART_BYTES = 16 << 20
_SHORTEST, _GROWTH = 12, 1.5
#: Places of an item's signature, in which every word of the item has one, and of a region's.
_SIGNATURE, _REGION_SIGNATURE = 1 << 10, 1 << 12
#: Passages whose images are added at a time; columns that so many of them hold are summed by a matrix product.
_PASSAGES, _COMMON = 1 << 11, 12
#: Words of a block of running sums.
_RUN = 16


def _buckets(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(64 - BITS)).astype(np.int64)


def _entries(words: np.ndarray, offsets: np.ndarray, column: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(passage, column, count) of all distinct pairs, in order of passage, and the number of passages.

    ``column`` maps a place of the hash to its column, below ``top``, or to -1.
    """
    counts = np.diff(offsets)
    per_text = -(-counts // PASSAGE)
    first = np.concatenate([[0], np.cumsum(per_text)])
    inside = np.arange(words.size) - np.repeat(offsets[:-1], counts)
    passage = np.repeat(first[:-1], counts) + inside // PASSAGE
    own = column[_buckets(words)]
    key = (passage * top + own)[own >= 0]
    key.sort()
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if key.size else np.zeros(0, np.int64)
    return key[start] // top, key[start] % top, np.diff(np.append(start, key.size)), int(first[-1])


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int, int]:
    """Passages that hold each bucket, the number of passages, and the bytes of text, over all documents."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, total, size = np.zeros(1 << BITS, np.int64), 0, 0
        places = np.arange(1 << BITS)
        for frame in frames:
            for _, texts in slices(frame, _PASS_SLICE):
                _, bucket, _, n = _entries(*word_hashes(texts, ALNUM), places, 1 << BITS)
                held += np.bincount(bucket, minlength=1 << BITS)
                total += n
                size += sum(map(len, texts))
        yield pd.DataFrame({"bucket": np.append(places, [-1, -2]), "n": np.append(held, [total, size])})

    sums = docs.select("text").mapInPandas(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    found = dict(zip(sums["bucket"].tolist(), sums["n"].tolist()))
    return np.array([found.get(b, 0) for b in range(1 << BITS)]), found.get(-1, 0), found.get(-2, 0)


def add_tree(parts: DataFrame, width: int = 64) -> np.ndarray:
    """Sum of (part, chunk, payload) over all parts: ``width`` payloads meet in a task at a time."""
    top = parts.agg(F.max("part")).first()[0]

    def add(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(x, np.float32) for x in frame["payload"]], axis=0, dtype=np.float64)
        return pd.DataFrame({"part": [key[1]], "chunk": [key[0]], "payload": [total.astype(np.float32).tobytes()]})

    while True:
        parts = parts.withColumn("part", F.floor(F.col("part") / width).cast("int"))
        parts = parts.groupBy("chunk", "part").applyInPandas(add, "part int, chunk int, payload binary")
        top //= width
        if top == 0:
            break
    rows = parts.toPandas().sort_values("chunk")
    return np.concatenate([np.frombuffer(x, np.float32) for x in rows["payload"]])


def add_image(total: np.ndarray, passage: np.ndarray, column: np.ndarray, count: np.ndarray, idf: np.ndarray, start: np.ndarray) -> None:
    """Add A'(A W) to ``total``, for passages of unit length; a bounded number of passages at a time."""
    weight = idf[column] * count.astype(np.float32)
    begin = np.flatnonzero(np.diff(passage, prepend=-1))
    sizes = np.diff(np.append(begin, passage.size))
    weight /= np.repeat(np.sqrt(np.add.reduceat(weight * weight, begin)), sizes)
    for k in range(0, begin.size, _PASSAGES):
        size = sizes[k : k + _PASSAGES]
        part = slice(begin[k], begin[k] + size.sum())
        row = np.repeat(np.arange(size.size), size)
        inside = np.arange(row.size) - np.repeat(np.cumsum(size) - size, size)
        # No passage holds more than PASSAGE columns; places left over have no weight.
        at, own = np.zeros((size.size, PASSAGE), np.int64), np.zeros((size.size, 1, PASSAGE), np.float32)
        at[row, inside], own[row, 0, inside] = column[part], weight[part]
        present, sums = _by_column(row, column[part], weight[part], (own @ start[at])[:, 0])
        total[present] += sums


def _by_column(row: np.ndarray, column: np.ndarray, weight: np.ndarray, projected: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns present and the weighted sums of the projected rows that hold them."""
    order = np.argsort(column.astype(np.uint16), kind="stable")  # below 2**BITS, sorted by radix
    row, column, weight = row[order], column[order], weight[order]
    first = np.flatnonzero(np.diff(column, prepend=-1))
    times = np.diff(np.append(first, column.size))
    sums = projected[row[first]] * weight[first, None]
    some = np.flatnonzero(times < _COMMON)
    for k in range(1, _COMMON - 1):
        some = some[times[some] > k]
        at = first[some] + k
        sums[some] += projected[row[at]] * weight[at, None]
    common = times >= _COMMON
    at = np.repeat(common, times)
    matrix = np.zeros((np.count_nonzero(common), len(projected)), np.float32)
    matrix[np.repeat(np.arange(len(matrix)), times[common]), row[at]] = weight[at]
    sums[common] = matrix @ projected
    return column[first], sums


def basis_of(total: np.ndarray) -> np.ndarray:
    """Directions by falling singular value, without the first, over their singular values."""
    left, size, _ = np.linalg.svd(total.astype(float), full_matrices=False)
    return left[:, 1:] / np.maximum(size[1:], 1e-3 * max(size[0], 1e-9))


def singular_basis(docs: DataFrame, idf: np.ndarray, column: np.ndarray, size: int, seed: int = 11) -> np.ndarray:
    """Scaled basis (columns x RANK - 1) by one randomised pass over all passages.

    Small partitions are joined first, as each task writes a sum of fixed size;
    ``size`` is the bytes of all texts.
    """
    spark = docs.sparkSession
    start = np.random.default_rng(seed).normal(size=(idf.size, RANK)).astype(np.float32)
    shared = spark.sparkContext.broadcast((idf.astype(np.float32), column, start))
    chunks = 8

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        idf, column, start = shared.value
        total, any_rows = np.zeros(start.shape, np.float32), False
        for frame in frames:
            for _, texts in slices(frame, _PASS_SLICE):
                passage, own, count, _ = _entries(*word_hashes(texts, ALNUM), column, idf.size)
                if passage.size:
                    any_rows = True
                    add_image(total, passage, own, count, idf, start)
        if any_rows:
            yield pd.DataFrame({
                "part": TaskContext.get().partitionId(), "chunk": np.arange(chunks),
                "payload": [b.tobytes() for b in np.array_split(total, chunks)],
            })

    tasks = max(spark.sparkContext.defaultParallelism, -(-size // _PART_BYTES))
    parts = settle(docs.select("text").coalesce(tasks).mapInPandas(run, "part int, chunk int, payload binary"), "lsa-partials", records=1000)
    if parts.isEmpty():
        return np.zeros((idf.size, RANK - 1))
    return basis_of(add_tree(parts).reshape(idf.size, RANK))


def held_columns(held: np.ndarray) -> np.ndarray:
    """Column of each hash place that a passage holds, in order of place; others -1."""
    chosen = np.flatnonzero(held)
    column = np.full(held.size, -1, np.int64)
    column[chosen] = np.arange(chosen.size)
    return column


class Projection:
    """Vectors of runs of words: sums over the columns' rows."""

    def __init__(self, column: np.ndarray, table: np.ndarray):
        self.column, self.table = column, table

    def sums(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Running sums over the words that have a column, and how many such words come before each place."""
        own = self.column[_buckets(words)]
        before = np.concatenate([[0], np.cumsum(own >= 0)])
        blocks = before[-1] // _RUN + 1
        rows = np.zeros((blocks * _RUN, self.table.shape[1]), np.float32)
        rows[1 : before[-1] + 1] = self.table[own[own >= 0]]
        # Inside blocks of words first, then over the blocks: whole rows are added, which lie together.
        runs = rows.reshape(blocks, _RUN, -1)
        for k in range(1, _RUN):
            runs[:, k] += runs[:, k - 1]
        runs[1:] += np.cumsum(runs[:-1, -1], axis=0)[:, None]
        return rows, before

    @staticmethod
    def unit(vectors: np.ndarray) -> np.ndarray:
        return vectors / np.maximum(np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None], 1e-12)


def window_sizes(longest: int, shortest: int = _SHORTEST) -> list[int]:
    """Lengths in steps of a half, from the shortest item on where that has under ``_SHORTEST`` words."""
    sizes = [max(1, min(_SHORTEST, shortest))]
    while sizes[-1] * _GROWTH <= longest and sizes[-1] < longest:
        sizes.append(max(sizes[-1] + 1, int(sizes[-1] * _GROWTH)))
    return sizes


def _places(words: np.ndarray, size: int = _SIGNATURE) -> np.ndarray:
    return (words & np.uint64(size - 1)).astype(np.int64)


class Items:
    """A block of benchmark items: words, vectors by window size, and answers."""

    def __init__(self, ids: list, texts: list[bytes], answers: list[bytes], projection: Projection):
        words, offsets = word_hashes(texts, ALNUM)
        self.ids = ids
        self.words = [words[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
        self.lists = [w.tolist() for w in self.words]
        found, at = word_hashes(answers, ALNUM)
        self.answers = [found[a:b] if b > a else w[-5:] for a, b, w in zip(at[:-1], at[1:], self.words)]
        length = np.diff(offsets)
        sizes = np.array(window_sizes(int(length.max(initial=1)), int(length[length > 0].min(initial=_SHORTEST))))
        self.length, self.first, self.places = length, offsets[:-1], _places(words, _REGION_SIGNATURE)
        self.signature = np.zeros((length.size, _SIGNATURE), bool)
        self.signature[np.repeat(np.arange(length.size), length), _places(words)] = True
        nearest = np.maximum(np.searchsorted(sizes, length, side="right") - 1, 0)
        sums, before = projection.sums(words)
        vectors = projection.unit(sums[before[offsets[1:]]] - sums[before[offsets[:-1]]])
        self.groups = [
            (int(s), rows, vectors[rows]) for k, s in enumerate(sizes) if (rows := np.flatnonzero((nearest == k) & (length > 0))).size
        ]

    def common_subsequence(self, item: int, region: np.ndarray) -> int:
        """Length of the longest common subsequence, by bit vectors."""
        own = self.words[item]
        places: dict[int, int] = {}
        for k, w in enumerate(own.tolist()):
            places[w] = places.get(w, 0) | (1 << k)
        full = (1 << own.size) - 1
        row = full
        for w in region.tolist():
            if m := places.get(w):
                u = row & m
                row = ((row + u) | (row - u)) & full
        return own.size - row.bit_count()

    def answered(self, item: int, region: np.ndarray) -> bool:
        answer = self.answers[item]
        if not answer.size or region.size < answer.size:
            return False
        at = np.flatnonzero(region[: region.size - answer.size + 1] == answer[0])
        return any(np.array_equal(region[k : k + answer.size], answer) for k in at)


Windows = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def candidates(words: np.ndarray, offsets: np.ndarray, items: Items, projection: Projection, min_cosine: float) -> Windows:
    """(text, item, begin, end, cosine) of all windows near an item, by text, item and place."""
    sums, before = projection.sums(words)
    counts = np.diff(offsets)
    out: list[list[np.ndarray]] = [[], [], [], [], []]
    for size, rows, vectors in items.groups:
        step = max(1, size // 3)
        n = np.where(counts > size, -(-(counts - size) // step) + 1, np.minimum(counts, 1))
        text = np.repeat(np.arange(counts.size), n)
        inside = np.arange(text.size) - np.repeat(np.cumsum(n) - n, n)
        begin = np.minimum(inside * step, np.maximum(counts[text] - size, 0)) + offsets[text]
        end = np.minimum(begin + size, offsets[text + 1])
        for k in range(0, begin.size, 1 << 11):
            b, e = begin[k : k + (1 << 11)], end[k : k + (1 << 11)]
            window = sums[before[e]] - sums[before[b]]
            norm = np.maximum(np.sqrt(np.einsum("ij,ij->i", window, window)), 1e-12)
            dots = window @ vectors.T
            near = np.flatnonzero(dots >= (min_cosine * norm)[:, None])
            w, i = np.divmod(near, rows.size)
            for column, found in zip(out, (text[k + w], rows[i], b[w], e[w], dots.ravel()[near] / norm[w])):
                column.append(found)
    text, item, begin, end, cosine = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in out)
    order = np.lexsort((begin, item, text))
    return text[order], item[order], begin[order], end[order], cosine[order]


def regions(words: np.ndarray, offsets: np.ndarray, items: Items, near: Windows, least: float) -> list[tuple]:
    """(text, item, low, high, cosine) of joined windows, with an item's length on either side.

    No subsequence is longer than the words there that the item's signature has,
    or than the item's words that the region's has, so a region where these are
    fewer than ``least`` of the item is left out.
    """
    text, item, begin, end, cosine = near
    if not text.size:
        return []
    own = items.length[item]
    new = np.ones(text.size, bool)
    # Windows of an item have one size, so their ends rise with their begins.
    new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (begin[1:] > end[:-1] + own[1:])
    first = np.flatnonzero(new)
    last = np.append(first[1:], text.size) - 1
    text, item, own, top = text[first], item[first], own[first], np.maximum.reduceat(cosine, first)
    low = np.maximum(offsets[text], begin[first] - own)
    high = np.minimum(offsets[text + 1], end[last] + own)
    place = _places(words)
    found = np.zeros(first.size, np.int64)
    for k in range(0, first.size, 1 << 12):  # bounded, as a region may be a whole text
        part = slice(k, k + (1 << 12))
        owner, at, begins = _ranges(low[part], high[part] - low[part])
        found[part] = np.add.reduceat(items.signature[item[part][owner], place[at]], begins, dtype=np.int64)
    keep = np.flatnonzero(found >= least * own - 1e-9)
    text, item, own, low, high, top = (x[keep] for x in (text, item, own, low, high, top))
    place, found = _places(words, _REGION_SIGNATURE), np.zeros(keep.size, np.int64)
    for k in range(0, keep.size, 1 << 8):
        part = slice(k, k + (1 << 8))
        owner, at, _ = _ranges(low[part], high[part] - low[part])
        signature = np.zeros((item[part].size, _REGION_SIGNATURE), bool)
        signature[owner, place[at]] = True
        owner, at, begins = _ranges(items.first[item[part]], own[part])
        found[part] = np.add.reduceat(signature[owner, items.places[at]], begins, dtype=np.int64)
    keep = np.flatnonzero(found >= least * own - 1e-9)
    return list(zip(*(x[keep].tolist() for x in (text, item, low, high, top))))


def _ranges(low: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each place of all ranges the range and the place, and where the ranges begin among them."""
    begins = np.cumsum(size) - size
    owner = np.repeat(np.arange(size.size), size)
    return owner, np.arange(owner.size) + (low - begins)[owner], begins


def confirm(words: np.ndarray, offsets: np.ndarray, items: Items, near: Windows, min_common: float, min_answered: float) -> list[tuple]:
    """(text, item, begin word, end word, cosine, common share, answered) of the best place of each confirmed pair."""
    best: dict[tuple[int, int], tuple] = {}
    for text, item, low, high, cosine in regions(words, offsets, items, near, min(min_common, min_answered)):
        own, here = items.words[item], words[low:high]
        shared = sum(map(set(here.tolist()).__contains__, items.lists[item]))
        if shared < min(min_common, min_answered) * own.size - 1e-9:  # no subsequence can be longer than that
            continue
        common = items.common_subsequence(item, here) / own.size
        answered = common >= min_answered and items.answered(item, here)
        if common >= min_common or answered:
            row = (text, item, low - int(offsets[text]), high - int(offsets[text]), cosine, common, bool(answered))
            if (text, item) not in best or common > best[text, item][5]:
                best[text, item] = row
    return list(best.values())


def contaminated(docs: DataFrame, benchmark: DataFrame, min_cosine: float = 0.62, min_common: float = 0.7, min_answered: float = 0.5, block_items: int = 20_000) -> DataFrame:
    """One row per (document, item) that matches; documents without a match have none."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select("doc_id", "text")
    held, total, size = document_frequencies(docs)
    column = held_columns(held)
    idf = np.log((total + 1) / (held[column >= 0] + 1)) + 0.1
    basis = singular_basis(docs, idf, column, size)
    shared = spark.sparkContext.broadcast(Projection(column, (basis * idf[:, None]).astype(np.float32)))
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    schema = "doc_id long, item_id long, begin_word long, end_word long, cosine double, common_share double, answered boolean"
    results = []
    for block in _blocks(benchmark.select("item_id", "text", answer.alias("answer")), block_items):
        items = spark.sparkContext.broadcast(block)

        def search(frames: Iterator[pd.DataFrame], items=items) -> Iterator[pd.DataFrame]:
            ids, texts, answers = items.value
            known = Items(ids, texts, answers, shared.value)
            for frame in frames:
                out = []
                for rows, texts in slices(frame, _SLICE):
                    words, offsets = word_hashes(texts, ALNUM)
                    near = candidates(words, offsets, known, shared.value, min_cosine)
                    for text, item, *rest in confirm(words, offsets, known, near, min_common, min_answered):
                        doc_id = rows["doc_id"].iloc[text]
                        out.append((None if pd.isna(doc_id) else doc_id, known.ids[item], *rest))
                columns = [x.split()[0] for x in schema.split(", ")]
                yield pd.DataFrame(out, columns=columns).astype({"doc_id": "Int64", "item_id": "Int64"})

        results.append(docs.mapInPandas(search, schema))
    if not results:
        return spark.createDataFrame([], schema)
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out


def _blocks(items: DataFrame, size: int, bytes_: int = 8 << 20) -> Iterator[tuple[list, list[bytes], list[bytes]]]:
    """Items in blocks of at most ``size`` rows and about ``bytes_`` of text; the driver holds one at a time."""
    encode = lambda t: (t or "").encode("utf-8", "replace")
    block: tuple[list, list[bytes], list[bytes]] = ([], [], [])
    held = 0
    for item_id, text, answer in items.toLocalIterator():
        block[0].append(item_id), block[1].append(encode(text)), block[2].append(encode(answer))
        held += len(block[1][-1]) + len(block[2][-1])
        if len(block[0]) == size or held >= bytes_:
            yield block
            block, held = ([], [], []), 0
    if block[0]:
        yield block


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; all columns stay."""
    found = settle(contaminated(docs, benchmark, **options).select("doc_id"), "leaked-ids", records=1000)
    return semi_join_null_safe(docs, found, "doc_id", "left_anti")
