"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import context_tree, decontaminate, language_id, merkle_manifest, partenum, periodic_runs, phrase_automata, pii, poisson_mix, prefix_forest, secret_scan, suffix_dedup, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_ownership": lambda spark, sf_dir: secret_scan.digest(table(spark, sf_dir, "documents")),
        "op2_phrase_automata": lambda spark, sf_dir: phrase_automata.digest(table(spark, sf_dir, "documents")),
        "op3_prefix_forest": lambda spark, sf_dir: prefix_forest.digest(table(spark, sf_dir, "embeddings")),
        "op4_suffix_induction": lambda spark, sf_dir: suffix_dedup.digest(table(spark, sf_dir, "documents")),
        "op5_partenum_join": lambda spark, sf_dir: partenum.digest(table(spark, sf_dir, "documents")),
        "op6_url_trees": lambda spark, sf_dir: url_filter.digest(table(spark, sf_dir, "pages")),
        "op7_benchmark_cgk": lambda spark, sf_dir: decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
        "op8_poisson_mix": lambda spark, sf_dir: poisson_mix.digest(table(spark, sf_dir, "documents")),
        "op9_pii_anchors": lambda spark, sf_dir: pii.digest(table(spark, sf_dir, "documents")),
        "op10_language_pieces": lambda spark, sf_dir: language_id.digest(table(spark, sf_dir, "documents")),
        "op11_recompressed_runs": lambda spark, sf_dir: periodic_runs.digest(table(spark, sf_dir, "documents")),
        "op12_merkle_butterfly": lambda spark, sf_dir: merkle_manifest.digest(table(spark, sf_dir, "documents")),
        "op13_context_tree": lambda spark, sf_dir: context_tree.digest(table(spark, sf_dir, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_secret_ownership": secret_scan.ORACLE_SQL,
        "op2_phrase_automata": phrase_automata.ORACLE_SQL,
        "op4_suffix_induction": suffix_dedup.ORACLE_SQL,
        "op5_partenum_join": partenum.ORACLE_SQL,
        "op8_poisson_mix": poisson_mix.ORACLE_SQL,
        "op11_recompressed_runs": periodic_runs.ORACLE_SQL,
        "op12_merkle_butterfly": merkle_manifest.ORACLE_SQL,
    }
