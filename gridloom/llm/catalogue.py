"""The queries of this subpackage, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, decontaminate, exact, jaccard, katz, language, lines, multiindex, packing, pii, simhash, spelling, substring, suffix


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    joined = F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", joined, "contaminated")


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digests(suffix.drop_repeats(table(spark, sf_dir, "documents")))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digests(lines.drop_repeated_runs(table(spark, sf_dir, "documents")))


def op5_every_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digests(lines.drop_repeated_runs(table(spark, sf_dir, "documents"), run=1))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op7_katz_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.language_model_scores(table(spark, sf_dir, "documents"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op8_verified_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(table(spark, sf_dir, "documents")).select("doc_id")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digests(substring.drop_repeats(table(spark, sf_dir, "documents")))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiindex.nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_benchmark_decontamination": op1_benchmark_decontamination,
    "op2_suffix_array_dedup": op2_suffix_array_dedup,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_line_dedup": op5_line_dedup,
    "op5_every_line_dedup": op5_every_line_dedup,
    "op6_pii": op6_pii,
    "op7_katz_language_model": op7_katz_language_model,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op8_verified_near_dedup": op8_verified_near_dedup,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_language_id": op10_language_id,
    "op11_filter_audit": op11_filter_audit,
    "op12_nearest_neighbours": op12_nearest_neighbours,
    "op13_spelling_variants": op13_spelling_variants,
}
ORACLES = {"op1_benchmark_decontamination": decontaminate.ORACLE, "op2_suffix_array_dedup": suffix.ORACLE, "op3_exact_dedup": exact.ORACLE, "op5_line_dedup": lines.ORACLE, "op5_every_line_dedup": lines.EVERY_ORACLE, "op9_substring_dedup": substring.ORACLE, "op11_filter_audit": audit.ORACLE, "op13_spelling_variants": spelling.ORACLE}
