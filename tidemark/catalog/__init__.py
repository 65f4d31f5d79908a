"""The queries over the given tables that show each operator, and their SQL.

The given tables hold no clinical records. Stand-ins: a user is a subject, ten days of a user are a stay and event
types are channels; or an order is an admission, its lines are stays, events or diagnoses, and a part's brand and type
are a code and its phenotype.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.catalog import exports, learning, plans, relational, series, splits, storage, streams

ENTRIES = relational.ENTRIES | series.ENTRIES | splits.ENTRIES | learning.ENTRIES | storage.ENTRIES | exports.ENTRIES | streams.ENTRIES | plans.ENTRIES


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ENTRIES["w5_daily_grid_previous"][0](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ENTRIES.items() if sql}
