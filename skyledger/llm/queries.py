"""The registered queries of the operators; each runs over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.llm import (
    decontaminate, filter_audit, language_id, lattice_lm, merge_pieces, near_dedup, packing, quality_qda, quality_rules,
    substring_dedup, token_store, toxicity, vector_codes,
)
from skyledger.llm.common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _labels(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", F.col(name).alias("label"))


def op1_quality_qda(spark, sf_dir):
    return quality_qda.classify(table(spark, sf_dir, "documents"), _labels(spark, sf_dir, "quality"))


def op2_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op3_toxicity_ftrl(spark, sf_dir):
    return toxicity.classify(table(spark, sf_dir, "documents"), _labels(spark, sf_dir, "toxic"))


def op4_lattice_lm(spark, sf_dir):
    return lattice_lm.score(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op5_language_id(spark, sf_dir):
    return language_id.identify(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_token_store(spark, sf_dir):
    store = token_store.write(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return token_store.read_back(store).drop("occurrence")


def op8_quality_rules(spark, sf_dir):
    return quality_rules.apply(table(spark, sf_dir, "documents"))


def op9_near_dedup(spark, sf_dir):
    return near_dedup.classes(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark, sf_dir):
    return substring_dedup.repeated_runs(table(spark, sf_dir, "documents")).drop("version")


def op11_vector_codes(spark, sf_dir):
    return vector_codes.digests(*vector_codes.compress(table(spark, sf_dir, "embeddings")))


def op12_merge_pieces(spark, sf_dir):
    return merge_pieces.digests(merge_pieces.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model")))


def op13_filter_audit(spark, sf_dir):
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_quality_qda, op2_packing, op3_toxicity_ftrl, op4_lattice_lm, op5_language_id, op6_decontaminate,
        op7_token_store, op8_quality_rules, op9_near_dedup, op10_substring_dedup, op11_vector_codes, op12_merge_pieces,
        op13_filter_audit,
    )
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    """SQL where it can express the operator; the others are tested against brute force."""
    return {"op13_filter_audit": filter_audit.ORACLE_SQL}
