"""Quality rules with thresholds learned from mergeable quantile sketches.

Each text is measured once with built-in functions. The measures of every
(lang, source) go into KLL sketches, which Spark merges from partial
aggregates; fences drawn from their tails replace fixed cutoffs. A fence lies so
far outside the median as an exponential tail would reach for one row in ten
thousand; the tail's scale is read off at the 0.95 quantile, or at 0.99 where
0.95 does not differ from the median. A group's quantiles shrink towards those of
its language, and these towards those of all rows, by the number of rows, so
there is no size at which the rule changes. The fences are joined back to the
rows.

Defined cases: a null text has no words and fails the base rule; null lang or
source form a group of their own; an empty table gives an empty result;
repeated rows are judged each; further input columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import SPACES, plain_words, settle

_BREAK = r"[\x20\x09-\x0D]+"
_A_WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: For each measure the sides that are fenced.
FENCES = {
    "symbol_ratio": "high",
    "mean_word": "both",
    "dup_line_ratio": "high",
    "repeat_ratio": "high",
    "upper_ratio": "high",
}
#: Quantiles that are read from a sketch.
_RANKS = (0.01, 0.05, 0.5, 0.95, 0.99)
#: Room for the rounding of a ratio that equals its fence.
_ROUNDING = 1e-9


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value`` evaluated once, as a lambda variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered(hashes: Column) -> Column:
    """Words inside windows whose hash occurs twice or more; by sorting, so n log n."""

    def by_sorted(s: Column) -> Column:
        same = lambda e, j: F.coalesce(F.get(s, j)["h"] == e["h"], F.lit(False))
        repeated = F.filter(s, lambda e, i: same(e, i - 1) | same(e, i + 1))
        return let(F.sort_array(F.transform(repeated, lambda e: e["p"])), by_position)

    def by_position(p: Column) -> Column:
        step = F.transform(p, lambda x, i: F.coalesce(F.least(F.get(p, i + 1) - x, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(step, F.lit(0).cast("long"), lambda total, x: total + x)

    pairs = F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("p")))
    return let(F.sort_array(pairs), by_sorted)


def _word_part(words: Column) -> Column:
    n = F.size(words)
    starts = F.when(n >= WINDOW, F.sequence(F.lit(0), n - WINDOW))
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))
    repeats = let(
        hashes,
        lambda h: F.when(h.isNull() | (F.size(F.array_distinct(h)) == F.size(h)), F.lit(0).cast("long")).otherwise(_covered(h)),
    )
    return F.struct(n.cast("long").alias("n_words"), repeats.alias("n_repeat_words"))


def _length_without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, "")).cast("long")


def measure(docs: DataFrame) -> DataFrame:
    """One row per document with the counts of the base rule and further measures."""
    text = plain_words(F.col("text"))
    words = F.filter(F.split(text, _BREAK, -1), lambda w: w != "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(_A_WORD))
    rows = docs.select(
        "doc_id",
        "lang",
        "source",
        let(words, _word_part).alias("w"),
        _length_without(text, SPACES).alias("word_chars"),
        (F.length(text) - _length_without(text, SYMBOLS)).cast("long").alias("n_symbols"),
        (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))).cast("long").alias("n_upper"),
        let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d"))).alias("l"),
    )
    return rows.select(
        "doc_id", "lang", "source", "w.n_words", "word_chars", "n_symbols",
        (F.col("l.n") - F.col("l.d")).cast("long").alias("n_dup_lines"),
        "w.n_repeat_words", "n_upper", F.col("l.n").alias("n_lines"),
    )


def with_ratios(rows: DataFrame) -> DataFrame:
    part = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return rows.select(
        "*",
        failed.alias("base_failed"),
        part("n_symbols", "word_chars").alias("symbol_ratio"),
        part("word_chars", "n_words").alias("mean_word"),
        part("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        part("n_repeat_words", "n_words").alias("repeat_ratio"),
        part("n_upper", "word_chars").alias("upper_ratio"),
    )


def _quantiles(sketch: Column, rows: Column) -> Column:
    """The quantiles of a sketch of at least one row, else null."""
    ranks = F.array(*[F.lit(r) for r in _RANKS])
    return F.when(rows > 0, F.call_function("kll_sketch_get_quantile_double", sketch, ranks))


def _shrunk(own: Column, rows: Column, wider: Column, shrink: float) -> Column:
    """Quantiles between those of a group and of the wider group, by the group's rows."""
    weight = rows / (rows + F.lit(float(shrink)))
    mixed = F.transform(wider, lambda w, i: weight * F.get(own, i) + (1 - weight) * w)
    return F.when(own.isNull(), wider).otherwise(mixed)


def _beyond(quantiles: Column, near: int, far: int, tail: float) -> Column:
    """How far a fence lies outside the median on one side."""
    median = F.get(quantiles, 2)
    first, second = F.abs(F.get(quantiles, near) - median), F.abs(F.get(quantiles, far) - median)
    scale = F.when(first > 0, first / math.log(20)).otherwise(second / math.log(100))
    return scale * -math.log(tail) + _ROUNDING


def thresholds(rows: DataFrame, tail: float = 1e-4, shrink: float = 200.0, sketch_k: int = 800) -> DataFrame:
    """Fences per (lang, source) from sketches over rows that pass the base rule.

    ``tail`` is the share of rows beyond a fence if the tail is exponential. A
    group of ``shrink`` rows lies half way between its own quantiles and its
    language's.
    """
    good = F.when(~F.col("base_failed"), F.lit(1))
    per_group = settle(
        rows.groupBy("lang", "source").agg(
            F.count(good).alias("n"),
            *[F.expr(f"kll_sketch_agg_double({m}, {sketch_k}) FILTER (WHERE NOT base_failed)").alias(m) for m in FENCES],
        ),
        "quality-sketches",
    )
    some = per_group.filter("n > 0")
    merged = [F.expr(f"kll_merge_agg_double({m})").alias(m) for m in FENCES]
    per_lang = some.groupBy("lang").agg(F.sum("n").alias("n"), *merged)
    overall = some.agg(F.sum("n").alias("n"), *merged).select(
        F.struct(*[_quantiles(F.col(m), F.col("n")).alias(m) for m in FENCES]).alias("o")
    )
    joined = per_group.alias("g").join(per_lang.alias("l"), F.expr("g.lang <=> l.lang"), "left")
    joined = joined.select(
        F.col("g.lang").alias("t_lang"), F.col("g.source").alias("t_source"), F.col("g.n").alias("rows"),
        F.coalesce("l.n", F.lit(0)).alias("lang_rows"),
        *[_quantiles(F.col(f"g.{m}"), F.col("g.n")).alias(f"g_{m}") for m in FENCES],
        *[_quantiles(F.col(f"l.{m}"), F.col("l.n")).alias(f"l_{m}") for m in FENCES],
        overall.scalar().alias("o"),
    )
    fences = []
    for name, side in FENCES.items():
        of_lang = _shrunk(F.col(f"l_{name}"), F.col("lang_rows"), F.col(f"o.{name}"), shrink)
        found = _shrunk(F.col(f"g_{name}"), F.col("rows"), of_lang, shrink)
        joined = joined.withColumn(f"q_{name}", found)
        quantiles = F.col(f"q_{name}")
        fences.append((F.get(quantiles, 2) + _beyond(quantiles, 3, 4, tail)).alias(f"{name}_max"))
        if side == "both":
            fences.append((F.get(quantiles, 2) - _beyond(quantiles, 1, 0, tail)).alias(f"{name}_min"))
    return joined.select("t_lang", "t_source", *fences)


def apply(docs: DataFrame, **options) -> DataFrame:
    """Counts, base verdict and final verdict of every document."""
    rows = settle(with_ratios(measure(docs)), "quality-measures")
    limits = settle(thresholds(rows, **options), "quality-thresholds")
    judged = rows.join(limits, F.expr("lang <=> t_lang AND source <=> t_source"), "left")
    inside = ~F.col("base_failed")
    for name, side in FENCES.items():
        inside &= F.coalesce(F.col(name) <= F.col(f"{name}_max"), F.lit(True))
        if side == "both":
            inside &= F.coalesce(F.col(name) >= F.col(f"{name}_min"), F.lit(True))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", inside.alias("kept"),
    )
