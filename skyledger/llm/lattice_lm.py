"""Language-model score: the likelihood of a text over all its subword segmentations.

The pieces are those of an existing subword vocabulary, plus single bytes so
that every word can be spelled. Their weights start from the vocabulary's own
scores and are re-estimated on the training corpus by expectation-maximisation
over the lattices of its distinct words. A text is a sequence of words and an
end; the probability of a word is the sum over all its segmentations, from a
forward recursion in log space, with the first piece marked as beginning a word.
A word of the training corpus is also an arc of its own, from begin to end of
the word, weighted by its count; the share left to spelled words is the share of
first occurrences (Witten and Bell). Texts in different languages use different
weights, so there is one lattice for each of the commonest languages of the
training rows and one for the rest; the language of a scored text is never
read: its probability is the sum over the lattices.

Work per occurrence is kept out of Python's way: each task turns its documents
into blocks, with a dictionary of the block's distinct words and, per document,
numbers of words and counts. Spark adds up counts per word over all blocks,
the lattice runs once per distinct word, and results go back to the blocks.
A word that is everywhere has one row per block.

Defined cases: null and empty texts are the end alone; rows with a null doc_id
are learned from (their remainder is not the held-out one); repeated rows each
count; words that no training text has get their lattice probability; without
training texts the weights stay those of the vocabulary; an empty table gives
an empty result; further input columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.llm.common import held_out, settle, ship
from skyledger.llm.words import mix

#: Pieces of more bytes are left out of the vocabulary.
_LONGEST = 12
_START = np.uint64(0x7F4A7C159E3779B9)
_STEP = np.uint64(0x5851F42D4C957F2D)


def vocabulary(model_path: str) -> tuple[list[bytes], list[bool], np.ndarray]:
    """Pieces as bytes, whether each begins a word, and first log weights.

    A vocabulary made by merging carries its rank as the score; weights then
    follow the rank as one over it. Lower case only, as texts are lowered.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    best: dict[tuple[bytes, bool], float] = {}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        text = model.id_to_piece(i)
        begins = text.startswith("▁")
        piece = text.removeprefix("▁").encode("utf-8")
        if piece and piece == piece.lower() and len(piece) <= _LONGEST and "▁" not in text[1:]:
            weight = -math.log(10.0 - model.get_score(i))
            best[piece, begins] = max(best.get((piece, begins), -math.inf), weight)
    for byte in range(1, 256):
        for begins in (False, True):
            best.setdefault((bytes([byte]), begins), -math.log(10.0 + model.get_piece_size()))
    keys = sorted(best)
    return [k[0] for k in keys], [k[1] for k in keys], np.array([best[k] for k in keys])


def _spans(block: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(begin, end, hash) of every span of up to _LONGEST bytes, for words of one length (one per row)."""
    n, length = block.shape
    wide = block.astype(np.uint64)
    for begin in range(length):
        h = np.full(n, _START)
        for end in range(begin + 1, min(begin + _LONGEST, length) + 1):
            h = mix(h * _STEP + wide[:, end - 1])
            yield begin, end, h


class Lattice:
    """Piece weights, looked up by the hash of a span; `forward` and expected counts."""

    def __init__(self, pieces: list[bytes], begins: list[bool], log_weights: np.ndarray):
        self.log_weights = log_weights
        hashes = np.empty(len(pieces), np.uint64)
        for length in {len(p) for p in pieces}:
            rows = [i for i, p in enumerate(pieces) if len(p) == length]
            block = np.frombuffer(b"".join(pieces[i] for i in rows), np.uint8).reshape(-1, length)
            hashes[rows] = next(h for b, e, h in _spans(block) if (b, e) == (0, length))
        self.tables = []
        for first in (False, True):
            rows = np.array([i for i, b in enumerate(begins) if b == first])
            bits = 18
            place = (hashes[rows] >> np.uint64(64 - bits)).astype(np.int64)
            order = np.argsort(hashes[rows])
            bound = np.searchsorted(np.sort(place), np.arange((1 << bits) + 1))
            depth = int(np.diff(bound).max())
            self.tables.append((bits, hashes[rows][order], rows[order], bound, depth))

    def find(self, hashes: np.ndarray, first: bool) -> np.ndarray:
        """The piece of each hash, or -1."""
        bits, known, rows, bound, depth = self.tables[first]
        place = (hashes >> np.uint64(64 - bits)).astype(np.int64)
        low, high, out = bound[place], bound[place + 1], np.full(hashes.size, -1, np.int64)
        for k in range(depth):
            at = np.flatnonzero(low + k < high)
            if not at.size:
                break
            hit = at[known[low[at] + k] == hashes[at]]
            out[hit] = rows[low[hit] + k]
        return out

    def forward(self, block: np.ndarray, count: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Log probability of each word (rows of bytes of one length).

        With ``count``, also the expected number of uses of each piece, from
        the backward recursion over the same spans.
        """
        n, length = block.shape
        alpha = np.full((length + 1, n), -np.inf)
        alpha[0] = 0.0
        arcs = []
        with np.errstate(invalid="ignore"):
            for begin, end, h in _spans(block):
                piece = self.find(h, begin == 0)
                has = np.flatnonzero(piece >= 0)
                if has.size:
                    w = self.log_weights[piece[has]]
                    alpha[end, has] = np.logaddexp(alpha[end, has], alpha[begin, has] + w)
                    if count is not None:
                        arcs.append((begin, end, has, piece[has], w))
            if count is None:
                return alpha[length], None
            beta = np.full((length + 1, n), -np.inf)
            beta[length] = 0.0
            uses = np.zeros(self.log_weights.size)
            for begin, end, has, piece, w in reversed(arcs):
                tail = w + beta[end, has]
                expected = np.exp(alpha[begin, has] + tail - alpha[length, has]) * count[has]
                uses += np.bincount(piece, np.nan_to_num(expected), uses.size)
                beta[begin, has] = np.logaddexp(beta[begin, has], tail)
        return alpha[length], uses


    def forward_all(self, block: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Log probability of each word under each row of ``weights``; spans are looked up once."""
        n, length = block.shape
        alpha = np.full((length + 1, n, len(weights)), -np.inf)
        alpha[0] = 0.0
        with np.errstate(invalid="ignore"):
            for begin, end, h in _spans(block):
                piece = self.find(h, begin == 0)
                has = np.flatnonzero(piece >= 0)
                if has.size:
                    alpha[end, has] = np.logaddexp(alpha[end, has], alpha[begin, has] + weights[:, piece[has]].T)
        return alpha[length]


def _by_length(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, bytes as a matrix) of the words of each length, a bounded number at a time."""
    sizes = np.array([len(w) for w in words])
    order = np.argsort(sizes, kind="stable")
    bounds = np.flatnonzero(np.diff(sizes[order])) + 1
    for rows in np.split(order, bounds):
        if rows.size:
            length = int(sizes[rows[0]])
            step = max(1, (1 << 20) // (length + 1) // 8)
            for k in range(0, rows.size, step):
                own = rows[k : k + step]
                yield own, np.frombuffer(b"".join(words[i] for i in own), np.uint8).reshape(-1, length)


def _gathered(frames: Iterator[pd.DataFrame], rows: int = 200_000) -> Iterator[pd.DataFrame]:
    """The frames joined to about ``rows`` rows, so that words of one length fill a matrix."""
    held, size = [], 0
    for frame in frames:
        held.append(frame)
        size += len(frame)
        if size >= rows:
            yield pd.concat(held, ignore_index=True)
            held, size = [], 0
    if size:
        yield pd.concat(held, ignore_index=True)


def _planes(values: np.ndarray) -> bytes:
    """32-bit values as four planes of bytes, which compress well when values are small."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _trained(classes: int) -> list[str]:
    return [f"c{k}" for k in range(classes)]


def blocks(docs: DataFrame, languages: list[str], block_bytes: int = 32 << 20) -> DataFrame:
    """Settled rows of two kinds: documents as word numbers and counts, and block dictionaries.

    A block holds about ``block_bytes`` of text of one task. A dictionary row has
    the word's count in the block's training texts for each class.
    """
    ship(docs.sparkSession)
    classes = len(languages) + 1
    columns = _trained(classes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, number, size = TaskContext.get().partitionId(), 0, 0
        names: dict[bytes, int] = {}
        rows: list[tuple] = []

        def flush() -> pd.DataFrame:
            nonlocal number, size
            block = (part << 32) | number
            words = {"word": list(names), "place": np.arange(len(names))}
            for k, column in enumerate(columns):
                own = [r for r in rows if r[2] == k]
                at = np.concatenate([np.zeros(0, np.uint32), *[r[4] for r in own]])
                n = np.concatenate([np.zeros(0, np.uint32), *[r[5] for r in own]])
                words[column] = np.bincount(at, n, len(names)).astype(np.int64)
            table = pd.DataFrame(
                [(i, h, k, n, _planes(np.diff(a, prepend=np.uint32(0))), _planes(c)) for i, h, k, n, a, c in rows],
                columns=["doc_id", "held_out", "class", "n_words", "places", "counts"],
            )
            out = pd.concat([table, pd.DataFrame(words)])
            out = out.astype({k: "Int64" for k in ("doc_id", "class", "n_words", "place", *columns)})
            number, size = number + 1, 0
            names.clear(), rows.clear()
            return out.assign(block=block)[["block", "doc_id", "held_out", "class", "n_words", "places", "counts", "word", "place", *columns]]

        index = {x: k for k, x in enumerate(languages)}
        for frame in frames:
            for doc_id, text, held, lang in frame.itertuples(index=False):
                found = Counter((text or "").encode("utf-8", "replace").lower().split())
                places = np.fromiter((names.setdefault(w, len(names)) for w in found), np.uint32, len(found))
                counts = np.fromiter(found.values(), np.uint32, len(found))
                order = np.argsort(places)
                own = -1 if held else index.get(lang, classes - 1)
                rows.append((None if pd.isna(doc_id) else doc_id, bool(held), own, int(counts.sum()), places[order], counts[order]))
                size += len(text or "")
                if size >= block_bytes:
                    yield flush()
        if rows:
            yield flush()

    schema = (
        "block long, doc_id long, held_out boolean, class int, n_words long, places binary, counts binary, word binary, place long, "
        + ", ".join(f"{c} long" for c in columns)
    )
    keyed = docs.select("doc_id", "text", held_out("doc_id", 7, 2).alias("held_out"), "lang")
    return settle(keyed.mapInPandas(run, schema), "lm-blocks")


def estimate(counted: DataFrame, pieces, begins, log_weights, n_docs: list[int], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Log weights per class after ``rounds`` of expectation-maximisation, and those of the end.

    ``counted`` has word and its training count per class. Every round adds up
    expected uses over all distinct words; the sums have one row per class and piece.
    """
    spark, classes = counted.sparkSession, len(n_docs)
    ends = np.array(n_docs, float) + 1.0

    def normal(uses: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        total = uses.sum(1) + ends
        return np.log(uses / total[:, None]), np.log(ends / total)

    first = np.exp(log_weights)
    weights, end = normal(np.tile(first / first.sum() * 1e4 + 1e-3, (classes, 1)))
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((pieces, begins, weights))

        def expect(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            pieces, begins, weights = shared.value
            uses = np.zeros((classes, len(pieces)))
            lattice = Lattice(pieces, begins, weights[0])
            for frame in _gathered(frames):
                for k, column in enumerate(_trained(classes)):
                    lattice.log_weights = weights[k]
                    own = frame[frame[column] > 0]
                    words, count = own["word"].tolist(), own[column].to_numpy(float)
                    for rows, block in _by_length(words):
                        uses[k] += lattice.forward(block, count[rows])[1]
            k, at = np.nonzero(uses)
            yield pd.DataFrame({"class": k, "piece": at, "uses": uses[k, at]})

        found = counted.mapInPandas(expect, "class int, piece int, uses double").groupBy("class", "piece").agg(F.sum("uses").alias("uses")).toPandas()
        uses = np.full((classes, len(pieces)), 0.01)
        uses[found["class"].to_numpy(int), found["piece"].to_numpy(int)] += found["uses"].to_numpy(float)
        weights, end = normal(uses)
    return weights, end


def score(docs: DataFrame, model_path: str, rounds: int = 2, max_classes: int = 8) -> DataFrame:
    """n_tokens, n_known, train_tokens, base_score and score of every document."""
    spark: SparkSession = docs.sparkSession
    pieces, begins, first = vocabulary(model_path)
    sizes = docs.filter(~held_out("doc_id", 7, 2) & F.col("lang").isNotNull()).groupBy("lang").count()
    languages = [r["lang"] for r in sizes.orderBy(F.desc("count"), "lang").limit(max_classes - 1).collect()]
    classes = len(languages) + 1
    columns = _trained(classes)
    stored = blocks(docs, languages)
    documents = stored.filter("word IS NULL")
    dictionary = stored.filter("word IS NOT NULL").select("block", "word", "place", *columns)
    counted = settle(dictionary.groupBy("word").agg(*[F.sum(c).alias(c) for c in columns]), "lm-counts")
    per_class = dict(documents.filter("NOT held_out").groupBy("class").count().collect())
    n_docs = [per_class.get(k, 0) for k in range(classes)]
    known = sum(F.col(c) for c in columns) > 0
    sums = counted.agg(
        F.count(F.when(known, 1)).alias("distinct"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns],
        *[F.count(F.when(F.col(c) > 0, 1)).alias(f"t{c}") for c in columns],
    ).first()
    n_class = np.array([sums[c] + n for c, n in zip(columns, n_docs)], float)
    spelled = np.array([sums[f"t{c}"] + 1 for c in columns], float)
    spelled = spelled / (n_class + spelled)
    all_docs = sum(n_docs)
    n_total, distinct = int(n_class.sum()), sums["distinct"] + (all_docs > 0)
    weights, end = estimate(counted, pieces, begins, first, n_docs, rounds)
    end = np.log((1 - spelled) * np.array(n_docs) / np.maximum(n_class, 1) + spelled * np.exp(end))
    prior = np.log((np.array(n_docs) + 0.5) / (all_docs + 0.5 * classes))
    floor = math.log10(n_total + distinct + 1)
    shared = spark.sparkContext.broadcast((pieces, begins, weights))

    def likelihood(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces, begins, weights = shared.value
        lattice = Lattice(pieces, begins, weights[0])
        for frame in _gathered(frames):
            words, logs = frame["word"].tolist(), np.zeros((len(frame), classes))
            for rows, block in _by_length(words):
                logs[rows] = lattice.forward_all(block, weights)
            counts = frame[columns].to_numpy(float)
            whole = np.log(np.maximum((1 - spelled) * counts / np.maximum(n_class, 1), 1e-300))
            logs = np.logaddexp(whole, np.log(spelled) + logs)
            yield pd.DataFrame({"word": frame["word"], "c": counts.sum(1).astype(np.int64), "logs": list(logs.astype(np.float32))})

    judged = counted.mapInPandas(likelihood, "word binary, c long, logs array<float>")
    answered = dictionary.select("block", "word", "place").join(judged, "word").select(F.col("block").alias("home"), "place", "c", "logs")

    def add_up(key: tuple, own: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        c, logs = np.zeros(len(answers)), np.zeros((len(answers), classes))
        if len(answers):
            c[answers["place"]] = answers["c"]
            logs[answers["place"]] = np.stack(answers["logs"].to_list())
        base = np.log10(c + 1) - floor
        out = []
        for doc_id, held, n_words, places, counts in own[["doc_id", "held_out", "n_words", "places", "counts"]].itertuples(index=False):
            at, n = np.cumsum(_from_planes(places)), _from_planes(counts).astype(float)
            by_class = prior + n @ logs[at] + end
            top = by_class.max()
            total = top + math.log(np.exp(by_class - top).sum())
            out.append((
                doc_id, held, int(n_words) + 1, int(n[c[at] > 0].sum()) + (all_docs > 0), n_total,
                float(n @ base[at]) + math.log10(all_docs + 1) - floor, total / math.log(10),
            ))
        frame = pd.DataFrame(out, columns=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
        return frame.astype({"doc_id": "Int64"})

    return (
        documents.select("block", "doc_id", "held_out", "n_words", "places", "counts").groupBy("block")
        .cogroup(answered.groupBy("home"))
        .applyInPandas(
            add_up,
            "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
        )
    )
