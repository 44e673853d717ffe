"""Encoding and decoding with a sentencepiece file of the merge type, by an agenda of adjacent pairs.

A text is normalised as the file says and starts as single characters. Every
adjacent pair whose concatenation is a piece stands in an agenda ordered by the
piece's score, then by position from the left; the first pair is merged, pairs
that it made stale are skipped when they come up, and the pairs with the new
neighbours join the agenda, until it is empty. What is left and is no piece is
spelled in byte pieces, or is the unknown id where the file has no byte pieces.

Where no piece of the file holds a blank mark after another character, no merge
can cross the place before a run of blank marks, nor a line feed that is in no
piece. Such files are encoded run by
run, and a task keeps the ids of the runs that it met lately. New runs of equal
length lie in one array with the agenda of each beside it; every step merges the
first pair of all these agendas. Long runs have a heap each. Each run that the
agenda encodes is checked against the sentencepiece library within its Arrow
batch before its ids are used (``check="runs"``), or every whole text is
(``check="texts"``, about 1.7 times the time); a difference stops the job.

Decoding is the library's ``decode`` over the ids of a whole text.

Defined cases: a null text counts as empty; an empty text has no ids and decodes
to an empty text; rows are independent, so null or repeated doc_ids and repeated
rows are encoded each; texts are never cut; an empty table gives an empty
result; further columns are ignored whatever their names. Files of another type
than merge, or with unused or user-defined pieces, are refused.
"""

from __future__ import annotations

import heapq
import os
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import ship

#: The character that stands for a blank in pieces.
BLANK = "▁"
_RUNS = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
#: The same where a line feed is in no piece, so that no merge crosses it either.
_RUNS_OF_LINES = re.compile(f"{BLANK}*[^{BLANK}\n]+|{BLANK}+|\n+")
#: A task starts a new generation of remembered runs after so many.
GENERATION = 400_000
#: Runs of more characters get a heap of their own; shorter ones of equal length share an array.
LONGEST_IN_ARRAY = 48
_NONE = np.int32(1 << 30)
CHECKS = ("runs", "texts", "none")


class MergeEncoder:
    """The pieces of one file, and ids of texts by merging adjacent symbols in order of score."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.scores: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        byte_ids: dict[int, int] = {}
        for i in range(library.get_piece_size()):
            piece = library.id_to_piece(i)
            if library.is_byte(i):
                byte_ids[int(piece[3:5], 16)] = i
            elif not (library.is_control(i) or library.is_unknown(i)):
                self.scores[piece] = library.get_score(i)
                self.ids[piece] = i
        self.unknown = library.unk_id()
        self.byte_ids = [byte_ids[b] for b in range(256)] if len(byte_ids) == 256 else None
        # Neighbouring unknown symbols share one id, so without byte pieces a run may depend on the next.
        self.by_run = self.byte_ids is not None and not any(BLANK in p.lstrip(BLANK) for p in self.scores)
        self.marks_start = library.normalize("a").startswith(BLANK)
        self.by_line = self.by_run and not any("\n" in p for p in self.scores) and library.normalize("\n").endswith("\n")
        self.lengths = {i: len(p) for p, i in self.ids.items()}
        self._index_pairs(library.get_piece_size())
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _index_pairs(self, size: int) -> None:
        """Numbers for symbols, and the pairs of symbols that are pieces.

        A piece's number is its id. A character that only stands inside pieces
        follows, and any other character is ``self.spare`` plus its code point.
        """
        numbers = dict(self.ids)
        for character in sorted(set("".join(self.ids)) - self.ids.keys()):
            numbers[character] = size + len(numbers) - len(self.ids)
        self.size, self.spare = size, size + len(numbers) - len(self.ids)
        self.of_character = np.arange(0x110000, dtype=np.int64) + self.spare
        for symbol, number in numbers.items():
            if len(symbol) == 1:
                self.of_character[ord(symbol)] = number
        by_score = sorted(self.scores, key=self.scores.__getitem__, reverse=True)
        # Equal scores share a rank, so that the leftmost of them is first.
        distinct = {score: rank for rank, score in enumerate(dict.fromkeys(map(self.scores.__getitem__, by_score)))}
        found = [
            (numbers[p[:k]] << 32 | numbers[p[k:]], distinct[self.scores[p]], own)
            for p, own in self.ids.items()
            for k in range(1, len(p))
            if p[:k] in numbers and p[k:] in numbers
        ]
        found.sort()
        self.pair_keys = np.array([f[0] for f in found], np.int64)
        self.pair_ranks = np.array([f[1] for f in found], np.int32)
        self.pair_ids = np.array([f[2] for f in found], np.int64)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (lower first, _NONE for no piece) and id of each pair of symbols."""
        if not len(self.pair_keys):
            return np.full(left.shape, _NONE), np.zeros(left.shape, np.int64)
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        hit = (self.pair_keys[at] == keys) & (left >= 0) & (right >= 0)
        return np.where(hit, self.pair_ranks[at], _NONE), self.pair_ids[at]

    def _merged_array(self, symbols: np.ndarray) -> np.ndarray:
        """Rows of symbols after all merges; -1 fills a row up from behind."""
        result = np.full(symbols.shape, -1, np.int64)
        ranks, pieces = self._ranks(symbols[:, :-1], symbols[:, 1:])
        rows = np.arange(len(symbols))
        while len(rows):
            first = ranks.argmin(axis=1)
            every = np.arange(len(rows))
            going = ranks[every, first] < _NONE
            result[rows[~going], : symbols.shape[1]] = symbols[~going]
            rows, first, symbols, ranks, pieces = (x[going] for x in (rows, first, symbols, ranks, pieces))
            if not len(rows):
                break
            every = np.arange(len(rows))
            symbols[every, first] = pieces[every, first]
            # The right symbol of the merged pair goes, and with it the pair that began there.
            width = np.arange(symbols.shape[1] - 1)
            symbols = np.take_along_axis(symbols, width + (width > first[:, None]), axis=1)
            if symbols.shape[1] == 1:
                result[rows, :1] = symbols
                break
            # The merged pair's own place is filled anew below, or falls away at the end.
            keep = np.minimum(width[:-1] + (width[:-1] >= first[:, None]), ranks.shape[1] - 1)
            ranks, pieces = np.take_along_axis(ranks, keep, axis=1), np.take_along_axis(pieces, keep, axis=1)
            for place in (first - 1, first):
                some = np.flatnonzero((place >= 0) & (place < ranks.shape[1]))
                at = place[some]
                ranks[some, at], pieces[some, at] = self._ranks(symbols[some, at], symbols[some, at + 1])
        return result

    def _id_bytes(self, runs: list[str]) -> Iterator[tuple[str, bytes]]:
        """(run, little-endian ids) of every run, by arrays of runs of equal length."""
        by_length: dict[int, list[str]] = {}
        for run in runs:
            if len(run) > LONGEST_IN_ARRAY or self.byte_ids is None:
                yield run, array("i", self.run_ids(run)).tobytes()
            else:
                by_length.setdefault(len(run), []).append(run)
        for length, some in by_length.items():
            points = np.frombuffer("".join(some).encode("utf-32-le"), "<u4").reshape(-1, length)
            symbols = self.of_character[points]
            merged = self._merged_array(symbols) if length > 1 else symbols
            spelled = (merged >= self.size).any(axis=1)
            counts = (merged >= 0).sum(axis=1)
            flat = merged[merged >= 0].astype("<i4").tobytes()
            ends = np.cumsum(counts) * 4
            for run, begin, end, odd in zip(some, (ends - counts * 4).tolist(), ends.tolist(), spelled.tolist()):
                yield run, array("i", self._spelled(run, flat[begin:end])).tobytes() if odd else flat[begin:end]

    def _spelled(self, run: str, symbols: bytes) -> Iterator[int]:
        """Ids where characters of the run that are no pieces are spelled in bytes."""
        place = 0
        for symbol in np.frombuffer(symbols, "<i4").tolist():
            if symbol < self.size:
                place += self.lengths[symbol]
                yield symbol
            else:
                yield from (self.byte_ids[b] for b in run[place].encode("utf-8"))
                place += 1

    def merged(self, run: str) -> list[str]:
        """The symbols that are left of ``run`` when no adjacent pair is a piece."""
        symbols = list(run)
        if len(symbols) < 2:
            return symbols
        last = len(symbols) - 1
        before, after = list(range(-1, last)), list(range(1, last + 1)) + [-1]
        scores = self.scores
        # (-score, place of the left symbol, place of the right one, their joint length when they met)
        agenda = [
            (-scores[pair], i, i + 1, 2)
            for i, pair in enumerate(map(str.__add__, run, run[1:]))
            if pair in scores
        ]
        heapq.heapify(agenda)
        while agenda:
            _, left, right, size = heapq.heappop(agenda)
            first, second = symbols[left], symbols[right]
            if not first or not second or len(first) + len(second) != size:
                continue  # one of the two was merged elsewhere in the meantime
            symbols[left], symbols[right] = whole, _ = first + second, ""
            beyond = after[left] = after[right]
            if beyond >= 0:
                before[beyond] = left
                pair = whole + symbols[beyond]
                if pair in scores:
                    heapq.heappush(agenda, (-scores[pair], left, beyond, len(pair)))
            behind = before[left]
            if behind >= 0:
                pair = symbols[behind] + whole
                if pair in scores:
                    heapq.heappush(agenda, (-scores[pair], behind, left, len(pair)))
        return [s for s in symbols if s]

    def run_ids(self, run: str) -> list[int]:
        found: list[int] = []
        previous_unknown = False
        for symbol in self.merged(run):
            own = self.ids.get(symbol)
            if own is not None:
                found.append(own)
            elif self.byte_ids is not None:
                found.extend(self.byte_ids[b] for b in symbol.encode("utf-8"))
            elif not previous_unknown:
                found.append(self.unknown)
            previous_unknown = own is None
        return found

    def runs(self, normalised: str) -> list[str]:
        if not normalised:
            return []
        if not self.by_run:
            return [normalised]
        return (_RUNS_OF_LINES if self.by_line else _RUNS).findall(normalised)

    def _require_equal(self, texts: list[str], found: list[bytes]) -> None:
        theirs = self.library.encode(texts, num_threads=1)
        same = array("i", chain.from_iterable(theirs)).tobytes() == b"".join(found)
        if same and all(4 * len(a) == len(b) for a, b in zip(theirs, found)):
            return
        for text, a, b in zip(texts, theirs, found):
            if array("i", a).tobytes() != b:
                raise ValueError(f"the library encodes {text[:80]!r} otherwise: {a[:20]}")

    def _check_runs(self, found: dict[str, bytes]) -> None:
        """The library puts a blank mark first where the file says so; other runs are shown to it behind a line feed."""
        skip = 1 if self.marks_start else 0
        marked = [r for r in found if (r[0] == BLANK and len(r) > 1) or not skip]
        self._require_equal([r[skip:].replace(BLANK, " ") for r in marked], [found[r] for r in marked])
        if len(marked) < len(found) and self.by_line:
            begun = array("i", self.library.encode("\n")).tobytes()
            if not begun.startswith(found.get(BLANK, b"")):
                raise ValueError("the library encodes a blank otherwise")
            others = [r for r in found if r[0] != BLANK]
            self._require_equal(["\n" + r for r in others], [begun + found[r] for r in others])

    def _learn(self, wanted: set[str], check: str) -> None:
        """Ids of all ``wanted`` runs into the recent generation."""
        if len(self.recent) > GENERATION:
            self.older, self.recent = self.recent, {}
        recent, older = self.recent, self.older
        wanted -= recent.keys()
        for run in wanted & older.keys():
            recent[run] = older[run]
        found = dict(self._id_bytes(list(wanted - older.keys())))
        if check == "runs":
            self._check_runs(found)
        recent.update(found)

    def encode(self, texts: list[str], check: str = "runs") -> list[bytes]:
        """The ids of each whole text as little-endian 32-bit integers."""
        normalise = self.library.normalize
        split = [self.runs(normalise(t)) for t in texts]
        if self.by_run:
            self._learn(set().union(*split), check)
            found = [b"".join(map(self.recent.__getitem__, runs)) for runs in split]
        else:
            found = [array("i", self.run_ids(runs[0]) if runs else []).tobytes() for runs in split]
        if check == "texts" or (check == "runs" and not self.by_run):
            self._require_equal(texts, found)
        return found

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids) if ids else ""


_encoders: dict[int, MergeEncoder] = {}


def shared_encoder(model: bytes) -> MergeEncoder:
    """The worker process's encoder of this file, so that tasks share what it remembers."""
    key = hash(model)
    if key not in _encoders:
        _encoders[key] = MergeEncoder(model)
    return _encoders[key]


def read_model(path: str) -> bytes:
    """The file's bytes (some hundred KB), if its pieces can be merged by score."""
    from sentencepiece import sentencepiece_model_pb2

    with open(path, "rb") as file:
        model = file.read()
    proto = sentencepiece_model_pb2.ModelProto.FromString(model)
    kind = proto.trainer_spec
    if kind.model_type != kind.BPE:
        raise ValueError(f"{os.path.basename(path)} is not of the merge type")
    piece = sentencepiece_model_pb2.ModelProto.SentencePiece
    if any(p.type in (piece.USER_DEFINED, piece.UNUSED) for p in proto.pieces) or kind.treat_whitespace_as_suffix:
        raise ValueError(f"{os.path.basename(path)} has unused or user-defined pieces, or marks blanks behind words")
    return model


#: Code points that an Arrow batch is cut into at most, but for a single text that is longer.
SLICE_CHARACTERS = 2 << 20


def _text_slices(texts: list[str]) -> Iterator[slice]:
    first = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > SLICE_CHARACTERS:
            yield slice(first, i)
            first, size = i, 0
        size += len(text)
    if first < len(texts):
        yield slice(first, len(texts))


def _id_lists(found: list[bytes]) -> pa.Array:
    offsets = np.zeros(len(found) + 1, np.int32)
    np.cumsum([len(x) // 4 for x in found], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), "<i4")))


def _apply(
    rows: DataFrame, schema: str, model: bytes, body: Callable[[MergeEncoder, pa.RecordBatch], Iterable[pa.RecordBatch]]
) -> DataFrame:
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from body(shared_encoder(model), batch)

    return rows.mapInArrow(run, schema)


def _encoded(docs: DataFrame, path: str, check: str, decoded: bool) -> DataFrame:
    if check not in CHECKS:
        raise ValueError(f"check must be one of {CHECKS}, not {check!r}")

    def body(encoder: MergeEncoder, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        for part in _text_slices(texts):
            found = encoder.encode(texts[part], check)
            columns = {"doc_id": batch.column(0)[part.start : part.stop], "ids": _id_lists(found)}
            if decoded:
                columns["decoded"] = pa.array([encoder.decode(np.frombuffer(x, "<i4").tolist()) for x in found], pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, ids array<int>" + (", decoded string" if decoded else "")
    return _apply(docs.select(F.col("doc_id").cast("long"), "text"), schema, read_model(path), body)


def encode(docs: DataFrame, path: str, check: str = "runs") -> DataFrame:
    """``doc_id`` and the ``ids`` of every whole text, without begin and end ids."""
    return _encoded(docs, path, check, decoded=False)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id`` and the ``text`` that its ``ids`` stand for; null ids decode to an empty text."""

    def body(encoder: MergeEncoder, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = pa.array([encoder.decode(ids or []) for ids in batch.column(1).to_pylist()], pa.string())
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "text": texts})

    rows = encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>"))
    return _apply(rows, "doc_id long, text string", read_model(path), body)


def round_trip(docs: DataFrame, path: str, check: str = "runs") -> DataFrame:
    """``doc_id``, ``ids`` and the ``decoded`` text in one pass over the texts."""
    return _encoded(docs, path, check, decoded=True)


def digests(rows: DataFrame) -> DataFrame:
    """Count and digests of ids and decoded texts, as :func:`round_trip` gives them."""
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(listed, 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
