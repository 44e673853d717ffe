"""Substring dedup by hashed units and winnowed word runs: repeated passages go, their earliest place stays.

A text is marked in two ways. It is cut into units at line ends and after
sentence ends; and of all runs of ``(min_words + 1) / 2`` words the one with the
least hash in every window of as many runs is a seed, so any two places that
share ``min_words`` words share a seed, wherever their sentences begin. Words are
normalised (lower case, single spaces). One row per digest has the lowest doc_id
that holds it. A mark is repeated if an earlier document has it, or the same
document further up, where it does not overlap.

A passage ends less than a window outside its outermost seeds. Around those seeds
every document that holds them next to the same word (by a hash of one byte, so a
common line is not listed everywhere) lists its words outwards, packed in one row.
Equal rows fold, prefixes that two folds share are joined, and the longest one that
stands in an earlier place as well is taken, so passages are cut to the word.

The few digests with over a thousandth of all marks are joined apart, where Spark
sees a small table and broadcasts it, and the others by shuffle, so a line that is everywhere stays spread over the tasks.
Marks that touch form a run, and runs of ``min_words`` words or more are removed;
short phrases that happen to be common stay.

Defined cases: null and empty texts have no units; a null doc_id ranks before
all others; rows that share a doc_id rank alike, so neither loses to the other;
ties cannot arise otherwise; an empty table gives an empty result; further
columns pass through `remove` unchanged whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyledger.llm.common import emptied, release, settle, ship, slices
from skyledger.llm.words import SPACED, mix, shingle_hashes, word_hashes

#: Digests with more than one in so many of all units are joined apart from the others.
MOST_FREQUENT = 1000
#: A mark's place has its kind, whether it stands further up, its first word and its words, or those beside a seed.
_MARK_SCHEMA = "doc_id long, version long, first long, second long, place long"
_AROUND_SCHEMA = (
    "doc_id long, version long, first long, side int, at int, prefixes binary, again int"
)
#: Bytes that are kept of the hash of a seed with the words beside it.
_HASH_BYTES = 5
#: Whether a code point, up to the last one that is white space, is white space.
_IS_SPACE = np.array([chr(c).isspace() for c in range(0x3002)])
_SENTENCE_END = np.array([chr(c) in ".!?" for c in range(128)])


def seed_size(min_words: int) -> int:
    """Words of a seed, and seeds of a window: both lie inside any ``min_words`` words."""
    return max(1, min(32, (min_words + 1) // 2))


def winnow(hashes: np.ndarray, offsets: np.ndarray, window: int) -> np.ndarray:
    """Places with the least hash, the last of equal ones, of any window inside a text."""
    if hashes.size < window:
        return np.zeros(0, np.int64)
    least, at, width = hashes, np.arange(hashes.size), 1
    while width < window:
        step = min(width, window - width)
        later = least[step:] <= least[:-step]
        least, at = np.where(later, least[step:], least[:-step]), np.where(later, at[step:], at[:-step])
        width += step
    inside = np.arange(at.size) + window <= np.repeat(offsets[1:], np.diff(offsets))[: at.size]
    at = at[inside]
    return at[np.flatnonzero(np.diff(at, prepend=-1))]  # they ascend


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts with line ends around them, and begin and end of every word there."""
    codes = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), "<u4")
    edge = np.flatnonzero(np.diff(_IS_SPACE[np.minimum(codes, _IS_SPACE.size - 1)].view(np.int8))) + 1
    return codes, edge[0::2], edge[1::2]


def unit_begins(texts: list[str]) -> np.ndarray:
    """The first word of every unit of all texts, whose words are counted through: after line ends, and blanks or tabs after ``.!?``."""
    codes, starts, ends = _joined(texts)
    new = np.zeros(starts.size + 1, bool)
    new[np.searchsorted(starts, np.flatnonzero((codes == 10) | (codes == 13)))] = True
    new[1:] |= _SENTENCE_END[np.minimum(codes[ends - 1], 127)] & ((codes[ends] == 32) | (codes[ends] == 9))
    return np.flatnonzero(new[:-1])


def _word_places(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of every word of all texts, in code points of its text."""
    _, starts, ends = _joined(texts)
    first = np.cumsum([1] + [len(t) + 1 for t in texts])
    base = first[np.searchsorted(first, starts, side="right") - 1]
    return starts - base, ends - base


def _earlier(keys: list, at: np.ndarray, words) -> np.ndarray:
    """Whether the same key stands further up without overlap; the first key is the text."""
    frame = pd.DataFrame(dict(enumerate(keys)))
    return at - pd.Series(at).groupby([frame[c] for c in frame], sort=False).transform("min").to_numpy() >= words


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.filter("text IS NOT NULL").select(
        F.coalesce("doc_id", F.lit(-(2**63))).alias("doc_id"), F.xxhash64("text").alias("version"), "text"
    )


def _words(phrases: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return word_hashes([p.replace("\0", "\1").encode("utf-8", "replace") for p in phrases], SPACED)


def _unit_digests(words: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of every unit: two sums of its words' hashes, each times a random factor of its place in the unit."""
    if not sizes.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = (np.arange(words.size) - np.repeat(begins, sizes)).astype(np.uint64)
    halves = []
    for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        factor = mix((inside + np.uint64(1)) * np.uint64(salt)) | np.uint64(1)
        total = np.add.reduceat(mix(words ^ np.uint64(salt)) * factor, begins)
        halves.append(mix(total ^ mix(sizes.astype(np.uint64) * np.uint64(salt))).view(np.int64))
    return halves[0], halves[1]


def marks(docs: DataFrame, size: int) -> DataFrame:
    """One row per unit and per seed of ``size`` words of every whole text, settled; `_opened` has the columns of a place."""
    ship(docs.sparkSession)

    def rows(part: pd.DataFrame, text: np.ndarray, first: np.ndarray, second: np.ndarray, place: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({
            "doc_id": part["doc_id"].to_numpy()[text], "version": part["version"].to_numpy()[text],
            "first": first, "second": second, "place": place,
        })

    def units(part: pd.DataFrame, lower: list[str], words: np.ndarray, offsets: np.ndarray) -> pd.DataFrame:
        begins = unit_begins(lower)
        sizes = np.diff(np.append(begins, words.size))
        text = np.searchsorted(offsets, begins, side="right") - 1
        first, second = _unit_digests(words, begins, sizes)
        at = begins - offsets[text]
        again, twice = np.zeros(sizes.size, np.int64), np.flatnonzero(pd.Series(first).duplicated(keep=False))
        again[twice] = pd.DataFrame({"t": text[twice], "a": first[twice], "b": second[twice]}).duplicated()
        return rows(part, text, first, second, again << 1 | at << 2 | sizes << 33)

    def seeds(part: pd.DataFrame, words: np.ndarray, offsets: np.ndarray) -> pd.DataFrame:
        grams, first = shingle_hashes(words, offsets, size)
        chosen = winnow(grams, first, size)
        text = np.searchsorted(first, chosen, side="right") - 1
        at = chosen - first[text]
        place = offsets[text] + at
        beside = lambda k, inside: np.where(inside, (words[np.where(inside, k, 0)] >> np.uint64(56)).astype(int) + 1, 0)
        before, after = beside(place - 1, at > 0), beside(place + size, place + size < offsets[text + 1])
        again, twice = np.zeros(chosen.size, np.int64), np.flatnonzero(pd.Series(grams[chosen]).duplicated(keep=False))
        again[twice] = _earlier([text[twice], grams[chosen][twice]], at[twice], size)
        packed = 1 | again << 1 | at << 2 | before << 33 | after << 42
        return rows(part, text, grams[chosen].view(np.int64), np.zeros(chosen.size, np.int64), packed)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part, _ in slices(frame, 1 << 20):
                lower = [t.lower() for t in part["text"]]
                words, offsets = _words([" ".join(t.split()) for t in lower])
                yield units(part, lower, words, offsets)
                if words.size:
                    yield seeds(part, words, offsets)

    return settle(_keyed(docs).mapInPandas(run, _MARK_SCHEMA), "dedup-marks")


def _opened(marked: DataFrame, size: int) -> DataFrame:
    """``marked`` with the columns of its packed places."""
    seed = F.col("place").bitwiseAND(1) == 1
    upper = F.shiftright("place", 33)
    beside = lambda c: F.when(seed, c.bitwiseAND(511).cast("int") - 1).otherwise(-1)
    return marked.select(
        "doc_id", "version", "first", "second", "kept_in", "n", seed.alias("seed"),
        (F.col("place").bitwiseAND(2) != 0).alias("again"),
        F.shiftright("place", 2).bitwiseAND(2**31 - 1).cast("int").alias("at"),
        F.when(seed, size).otherwise(upper.cast("int")).alias("words"),
        beside(upper).alias("before"), beside(F.shiftright("place", 42)).alias("after"),
    )


def _spread_join(rows: DataFrame, keyed: DataFrame, columns: list[str], total: int) -> DataFrame:
    """``rows`` joined with ``keyed``, which has a row and the count ``n`` of each key."""
    frequent = total / MOST_FREQUENT
    # At most MOST_FREQUENT keys can hold so many rows each; stored, their size is known before any row is shuffled for them.
    hot = settle(keyed.filter(F.col("n") > frequent), "dedup-frequent")
    if hot.isEmpty():
        return rows.join(keyed, columns)
    rare = rows.join(hot.select(*columns), columns, "left_anti").join(keyed.filter(F.col("n") <= frequent), columns)
    return rows.join(hot, columns).unionByName(rare)


def _shared(rows: DataFrame, size: int) -> DataFrame:
    """Settled: the marks whose digest stands in two places or more, with the lowest doc_id that has it."""
    columns = ["first", "second"]
    holders = rows.groupBy(*columns).agg(F.min("doc_id").alias("kept_in"), F.count("*").alias("n"))
    holders = settle(holders.filter("n > 1"), "dedup-holders")
    release(rows.sparkSession)
    shared = settle(_opened(_spread_join(rows, holders, columns, rows.count()), size), "dedup-repeated")
    emptied(holders)
    return shared


def _extended(docs: DataFrame, shared: DataFrame, repeated: DataFrame, size: int) -> DataFrame:
    """The outermost repeated seeds (side 0 left, 1 right) with the words outside that are repeated too."""
    order = Window.partitionBy("doc_id", "version").orderBy("at")
    seeds = repeated.filter("seed").select("doc_id", "version", "first", "at", "n", "before", "after").distinct()
    far = lambda gap, word: F.when(F.coalesce(gap > size, F.lit(True)) & (F.col(word) >= 0), F.col(word))
    outer = seeds.select(
        "first", "n",
        far(F.col("at") - F.lag("at").over(order), "before").alias("left"),
        far(F.lead("at").over(order) - F.col("at"), "after").alias("right"),
    )
    outer = outer.filter("left IS NOT NULL OR right IS NOT NULL").groupBy("first")
    outer = settle(outer.agg(F.max("n").alias("n"), F.collect_set("left").alias("lefts"), F.collect_set("right").alias("rights")), "dedup-outer")
    held = _spread_join(shared.filter("seed").select("doc_id", "version", "first", "at", "before", "after"), outer, ["first"], shared.count())
    held = held.withColumn("left", F.array_contains("lefts", F.col("before"))).withColumn("right", F.array_contains("rights", F.col("after")))
    held = held.filter("left OR right").groupBy("doc_id", "version").agg(F.collect_set(F.struct("first", "at", "left", "right")).alias("held"))
    held = settle(held, "dedup-held")
    release(docs.sparkSession)
    columns = [F.col(f"held.{c}").alias(c) for c in ("first", "at", "left", "right")]
    texts = _keyed(docs).join(held, ["doc_id", "version"]).select("doc_id", "version", "text", *columns)
    around = settle(texts.mapInPandas(_around(size), _AROUND_SCHEMA), "dedup-around", records=1000)
    emptied(outer)
    emptied(held)
    release(docs.sparkSession)
    return _reached(around, size)


def _around(size: int):
    """The words outside every held seed in one row: hashes of the seed with 1, 2, ... of them."""
    names = [x.split()[0] for x in _AROUND_SCHEMA.split(", ")]

    def packed(matrix: np.ndarray, counts: np.ndarray, width: int) -> list[bytes]:
        data, step = np.ascontiguousarray(matrix).tobytes(), matrix.shape[1] * width
        return [data[k * step : k * step + n * width] for k, n in enumerate(counts.tolist())]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part, _ in slices(frame, 1 << 20):
                texts = part["text"].tolist()
                words, offsets = _words([" ".join(t.lower().split()) for t in texts])
                held = np.repeat(np.arange(len(part)), part["at"].map(len).to_numpy())
                sides = [np.flatnonzero(np.concatenate(part[c].to_list())) for c in ("left", "right")]
                chosen, side = np.concatenate(sides), np.repeat([0, 1], [len(s) for s in sides])
                if not chosen.size:
                    continue
                text = held[chosen]
                first, at = (np.concatenate(part[c].to_list())[chosen].astype(np.int64) for c in ("first", "at"))
                low, high = offsets[text] + at, offsets[text] + at + size
                chain, counts, again = first.view(np.uint64).copy(), np.zeros(text.size, np.int64), np.zeros(text.size, np.int64)
                hashes = np.zeros((text.size, size - 1), np.uint64)
                # Only a seed that a text holds twice can have its surroundings there again.
                _, kind, times = np.unique(np.stack([text, first, side]), axis=1, return_inverse=True, return_counts=True)
                twice = np.flatnonzero(times[kind.ravel()] > 1)
                for delta in range(1, size):
                    place = np.where(side == 0, low - delta, high + delta - 1)
                    inside = (place >= offsets[text]) & (place < offsets[text + 1])
                    if not inside.any():
                        break
                    place = np.where(inside, place, 0)
                    chain = np.where(inside, mix(mix(chain) ^ words[place]), chain)
                    hashes[:, delta - 1] = chain
                    counts += inside
                    here = twice[inside[twice]]
                    if here.size:
                        begin = np.where(side == 0, at - delta, at)[here]
                        same = _earlier([text[here], first[here], side[here], chain[here]], begin, size + delta)
                        again[here[same]] = delta
                upper = hashes.astype("<u8").view(np.uint8).reshape(text.size, size - 1, 8)[:, :, 8 - _HASH_BYTES :]
                yield pd.DataFrame({
                    "doc_id": part["doc_id"].to_numpy()[text], "version": part["version"].to_numpy()[text], "first": first,
                    "side": side, "at": at, "prefixes": packed(upper, counts, _HASH_BYTES), "again": again,
                })[names]

    return run


def _reached(around: DataFrame, size: int) -> DataFrame:
    """Every seed with the most words beside it that an earlier place has too.

    Equal surroundings fold to one row first. A later document of a fold is
    repeated in full; for its first document the fold's prefixes are compared
    with those of the other folds of the seed, and only prefixes that two folds
    share are joined.
    """
    fold = ["first", "side", "prefixes"]
    folds = around.filter(F.length("prefixes") > 0).groupBy(*fold).agg(F.min("doc_id").alias("least"))
    folds = settle(folds, "dedup-folds")
    release(around.sparkSession)
    step = F.explode(F.sequence(F.lit(1), (F.length("prefixes") / _HASH_BYTES).cast("int")))
    key = ["first", "side", "delta", "hash"]
    prefix = F.expr(f"substring(prefixes, {_HASH_BYTES} * (delta - 1) + 1, {_HASH_BYTES})")
    each = folds.select("*", step.alias("delta")).withColumn("hash", prefix)
    shared = each.groupBy(*key).agg(F.min("least").alias("kept_in"), F.count("*").alias("n")).filter("n > 1")
    shared = settle(shared, "dedup-shared")
    release(around.sparkSession)
    total = folds.agg(F.sum(F.length("prefixes") / _HASH_BYTES)).first()[0] or 0
    near = _spread_join(each, shared, key, total).filter("kept_in < least")
    reach = near.groupBy(*fold).agg(F.max(F.struct("delta", "kept_in")).alias("reach"))
    known = settle(folds.join(reach, fold, "left"), "dedup-reach")
    emptied(folds)
    emptied(shared)
    release(around.sparkSession)
    most = (F.length("prefixes") / _HASH_BYTES).cast("int")
    earlier = F.col("doc_id") > F.col("least")
    delta = F.greatest("again", F.when(earlier, most).otherwise(F.coalesce("reach.delta", F.lit(0))))
    holder = F.when(earlier, F.col("least")).when(F.coalesce("reach.delta", F.lit(0)) >= F.col("again"), F.col("reach.kept_in"))
    rows = around.join(known, fold).select(
        "doc_id", "version", "side", "at", delta.alias("delta"), F.coalesce(holder, F.col("doc_id")).alias("kept_in")
    )
    return rows.filter("delta > 0").select(
        "doc_id", "version",
        F.when(F.col("side") == 0, F.col("at") - F.col("delta")).otherwise(F.col("at")).alias("at"),
        (F.col("delta") + size).alias("words"),
        "kept_in",
    )


def repeated_runs(docs: DataFrame, min_words: int = 25) -> DataFrame:
    """The passages to remove: doc_id, offsets, size, marks inside, and the lowest doc_id that keeps part of them."""
    size = seed_size(min_words)
    rows = marks(docs, size)
    shared = _shared(rows, size)
    emptied(rows)  # later steps read the shared marks only
    release(docs.sparkSession)
    repeated = shared.filter("again OR doc_id > kept_in")
    columns = ["doc_id", "version", "at", "words", "kept_in"]
    spans = repeated.select(*columns, "seed").distinct().withColumn("n", F.lit(1)).drop("seed")
    wider = _extended(docs, shared, repeated, size).select(*columns).withColumn("n", F.lit(0))
    order = Window.partitionBy("doc_id", "version").orderBy("at")
    reached = F.max(F.col("at") + F.col("words")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = (
        spans.unionByName(wider)
        .withColumn("apart", F.coalesce((F.col("at") > reached).cast("int"), F.lit(1)))
        .withColumn("run", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("doc_id", "version", "run")
        .agg(
            F.min("at").alias("at"), (F.max(F.col("at") + F.col("words")) - F.min("at")).cast("long").alias("n_words"),
            F.sum("n").alias("n_units"), F.min("kept_in").alias("kept_in"),
        )
        .filter(F.col("n_words") >= min_words)
    )
    runs = settle(runs.groupBy("doc_id", "version").agg(F.collect_list(F.struct("at", "n_words", "n_units", "kept_in")).alias("runs")), "dedup-passages")
    emptied(shared)
    release(docs.sparkSession)
    return _located(docs, runs).select(_real_id("doc_id"), "version", "begin", "stop", "n_words", "n_units", _real_id("kept_in"))


def _located(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """Runs of words with their offsets in the original text, in code points; rows that repeat count once."""
    schema = "doc_id long, version long, begin int, stop int, n_words long, n_units long, kept_in long"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part, _ in slices(frame, 1 << 20):
                begins, ends = _word_places(part["text"].tolist())
                first, out = 0, []
                # Words are what split() gives, so counting them finds each text's share of the places.
                for doc_id, version, text, own in part[["doc_id", "version", "text", "runs"]].itertuples(index=False):
                    for r in own:
                        low = first + r["at"]
                        out.append((doc_id, version, begins[low], ends[low + r["n_words"] - 1], r["n_words"], r["n_units"], r["kept_in"]))
                    first += len(text.split())
                yield pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")])

    found = _keyed(docs).join(runs, ["doc_id", "version"]).mapInPandas(run, schema)
    return settle(found, "dedup-located", records=1000).distinct()


def _real_id(column: str):
    return F.when(F.col(column) > -(2**63), F.col(column)).alias(column)


def remove(docs: DataFrame, min_words: int = 25) -> DataFrame:
    """``docs`` with the repeated passages cut out of ``text``; n_chars follows where it exists.

    All rows stay, also those whose text becomes empty.
    """
    runs = settle(repeated_runs(docs, min_words), "dedup-runs")
    spans = runs.groupBy(F.col("doc_id").alias("_cut_id"), F.col("version").alias("_cut_version")).agg(
        F.sort_array(F.collect_list(F.struct("begin", "stop"))).alias("_cut_spans")
    )

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, cuts in zip(texts, spans):
            if cuts is not None and text is not None:
                kept, at = [], 0
                for c in cuts:
                    kept.append(text[at : c["begin"]])
                    at = c["stop"]
                text = "".join([*kept, text[at:]])
            out.append(text)
        return pd.Series(out, dtype=object)

    version = F.xxhash64(docs["text"])
    joined = docs.join(spans, docs["doc_id"].eqNullSafe(F.col("_cut_id")) & (version == F.col("_cut_version")), "left")
    changed = joined.withColumn("_cut_text", F.when(F.col("_cut_spans").isNotNull(), cut(docs["text"], F.col("_cut_spans"))))
    new_text = F.coalesce("_cut_text", docs["text"])
    columns = []
    for name, kind in docs.dtypes:
        if name == "text":
            columns.append(new_text.alias(name))
        elif name == "n_chars":
            columns.append(F.when(F.col("_cut_text").isNotNull(), F.length("_cut_text").cast(kind)).otherwise(docs[name]).alias(name))
        else:
            columns.append(docs[name])
    return changed.select(*columns)
