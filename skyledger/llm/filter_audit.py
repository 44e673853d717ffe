"""Interaction audit of five document filters: every order, every step, by recursive SQL.

Each document is measured once with built-in functions and becomes a mask with a
bit per filter that it fails. Documents fold to cells (part, mask) with their
counts, before anything is enumerated. A recursive common table expression then
extends filter prefixes with the letters they do not have yet, carrying the bits
applied so far; each level emits what its step does to every one of the 32 masks.
The emitted rows are joined with the cells by mask, so the recursion has the same
10,400 rows whatever the documents, and the work that grows is one pass over the
texts and the grouping of their digests.

Filter E asks for a text that a smaller doc_id has anywhere in the table. Texts
are grouped by SHA-256 with their labels and part, so copies fold before they
meet: a digest has at most one row per part and pair of labels in a window.

Defined cases: a null text counts as empty, and all empty texts are identical; a
null lang is the part of the empty string; a null doc_id is smaller than none and
has none smaller, so it neither fails E nor makes others fail, and has no label; rows that share
doc_id and text do not fail E by each other; a doc_id with several labels is good
(toxic) if one of them says so; an empty table gives an empty result; further
columns are ignored whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.llm.common import plain_words, settle
from skyledger.llm.quality_rules import let

LETTERS = "ABCDE"
_BREAK = r"[\x20\x09-\x0D]+"
COUNTS = ("n", "good", "toxic")


def failures(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``part``, digest of the text and mask of the filters A to D that it fails."""
    text = plain_words(F.col("text"))
    words = F.filter(F.split(text, _BREAK, -1), lambda w: w != "")

    def bits(w: Column) -> Column:
        few = F.size(w) < 200
        repetitive = 100 * F.size(F.array_distinct(w)) < 50 * F.size(w)
        return F.when(few, 1).otherwise(0) + F.when(repetitive, 2).otherwise(0)

    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    shouting = 100 * capitals.cast("long") > 3 * F.length(text).cast("long")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("lang", F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        (
            let(words, bits)
            + F.when(shouting, 4).otherwise(0)
            + F.when(text.rlike("[#$%&*|]"), 8).otherwise(0)
        ).alias("mask"),
    )


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows with ``good`` and ``toxic`` as 0 or 1; a document without a label is neither."""
    said = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"),
        F.max((F.col("toxic") == 1).cast("int")).alias("toxic"),
    )
    return rows.join(said, "doc_id", "left").fillna(0, ["good", "toxic"])


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents of each (part, mask): ``n``, and how many are ``good`` and ``toxic``."""
    own = failures(docs).groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    keys = ("digest", "part", "mask", "good", "toxic")
    # Copies of a text fold here; of each fold the smallest doc_id and its rows are kept apart.
    folded = _labelled(own, labels).groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("without_id"),
        F.min("doc_id").alias("least"),
        F.min_by("n", "doc_id").alias("at_least"),
    )
    of_text = Window.partitionBy("digest")
    first = F.when(F.col("least") == F.min("least").over(of_text), F.col("at_least")).otherwise(0)
    original = F.col("without_id") + F.coalesce(first, F.lit(0))
    split = folded.withColumn("original", original).select(
        "part", "good", "toxic",
        F.explode(F.array(
            F.struct(F.col("mask"), F.col("original").alias("n")),
            F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("original")).alias("n")),
        )).alias("c"),
    )
    n = F.col("c.n")
    return split.groupBy("part", F.col("c.mask").alias("mask")).agg(
        F.sum(n).alias("n"), F.sum(n * F.col("good")).alias("good"), F.sum(n * F.col("toxic")).alias("toxic")
    )


#: Level by level: prefixes grow by an unused letter, with what that step does to each mask.
_STEPS = """
WITH RECURSIVE step_of(prefix, step, bit, before, mask) AS (
  SELECT CAST('' AS STRING), 0, 0, 0, CAST(id AS INT) FROM range(32)
  UNION ALL
  SELECT prefix || letter, step + 1, new_bit, before | bit, mask
  FROM (
    SELECT *, explode(map('A', 1, 'B', 2, 'C', 4, 'D', 8, 'E', 16)) AS (letter, new_bit) FROM step_of WHERE step < 5
  )
  WHERE ((before | bit) & new_bit) = 0
)
SELECT prefix, step, mask,
  CAST(mask & (before | bit) = 0 AS INT) AS kept,
  CAST(mask & bit <> 0 AND mask & before = 0 AS INT) AS removed,
  CAST(mask & bit <> 0 AND mask & before <> 0 AS INT) AS redundant,
  CAST(mask = bit AS INT) AS unique_fails
FROM step_of WHERE step > 0
"""


def steps(spark) -> DataFrame:
    """What the last filter of every prefix does to every mask: 325 prefixes times 32 masks."""
    return spark.sql(_STEPS)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the five filters and step in it, zeros included."""
    spark = docs.sparkSession
    counted = settle(cells(docs, labels), "audit-cells")
    level = settle(steps(spark), "audit-steps")
    whole = F.col("step") == len(LETTERS)
    orders = level.filter(whole).select(F.col("prefix").alias("filter_order")).distinct()
    stages = orders.select(
        "filter_order",
        F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))).alias("step"),
    ).withColumn("prefix", F.expr("left(filter_order, step)"))
    # Every part has all 32 masks, so that a part without documents of a mask still gets its rows.
    full = counted.groupBy("part").agg(
        F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*COUNTS)))).alias("of_mask")
    )
    none = F.struct(*[F.lit(0).cast("long").alias(c) for c in COUNTS])
    dense = full.select(
        "part",
        F.explode(F.transform(
            F.sequence(F.lit(0), F.lit(31)),
            lambda m: F.struct(m.alias("mask"), F.coalesce(F.col("of_mask")[m], none).alias("c")),
        )).alias("cell"),
    ).select("part", "cell.mask", "cell.c.*")
    per_prefix = (
        level.join(dense, "mask")
        .groupBy("part", "prefix")
        .agg(
            *[F.sum(F.col(c) * F.col("n")).alias(c) for c in ("kept", "removed", "redundant", "unique_fails")],
            F.sum(F.col("removed") * F.col("good")).alias("good_lost"),
            F.sum(F.col("removed") * F.col("toxic")).alias("toxic_lost"),
        )
    )
    rows = stages.join(per_prefix, "prefix").withColumn("filter", F.expr("substr(filter_order, step, 1)"))
    shapley = rows.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    return rows.join(shapley, ["part", "filter"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails",
        "good_lost", "toxic_lost", "shapley",
    )


#: The audit in another engine's SQL: masks per document, all orders by joins of the letters.
ORACLE_SQL = r"""
WITH m AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), firsts AS (
  SELECT t, min(doc_id) AS least FROM m GROUP BY t
), said AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id
), docs AS (
  SELECT part,
    CASE WHEN len(w) < 200 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN m.doc_id > least THEN 16 ELSE 0 END AS mask,
    coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM m JOIN firsts USING (t) LEFT JOIN said ON m.doc_id = said.doc_id
), cells AS (
  SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM docs GROUP BY part, mask
), letter(l, b) AS (
  VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits
  FROM letter a JOIN letter b ON b.b <> a.b JOIN letter c ON c.b NOT IN (a.b, b.b)
  JOIN letter d ON d.b NOT IN (a.b, b.b, c.b) JOIN letter e ON e.b NOT IN (a.b, b.b, c.b, d.b)
), stages AS (
  SELECT filter_order, CAST(s.step AS INT) AS step, bits[s.step] AS bit,
    CAST(coalesce(list_sum(bits[1:s.step - 1]), 0) AS INT) AS before
  FROM orders, (SELECT unnest(range(1, 6)) AS step) s
), counts AS (
  SELECT part, filter_order, step, bit,
    CAST(sum(CASE WHEN mask & (bit | before) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
    CAST(sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
    CAST(sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
    CAST(sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
    CAST(sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM stages CROSS JOIN cells GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM counts
"""
