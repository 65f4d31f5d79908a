"""Mixing sources to target weights by Poisson replication.

Every document is repeated a Poisson-distributed number of times, its mean being the target repetition rate of its
source; the count comes from inverting the distribution at a number hashed from the seed and the document, so every
run and every retried task gives the same. The copies are then put in a global pseudo-random order.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import stage

SEED = 17
#: Sources get shares in proportion to their size to this power, unless weights are given: under 1, small ones gain.
SMOOTHING = 0.5


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) hashed from seed and key: 52 bits of an MD5 (four of its hex digits more than a 36-bit id needs)."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), key)), 1, 13), 16, 10).cast("double") / float(2**52)


def rates(docs: DataFrame, source_col: str = "source", weights: Mapping[str, float] | None = None, smoothing: float = SMOOTHING) -> DataFrame:
    """(source, n, rate): rate is what makes the sources' expected shares follow the weights, with as many rows as before in all.

    A null source is a source of its own, named ''. Sources without a weight get none.
    """
    counts = docs.groupBy(F.coalesce(F.col(source_col), F.lit("")).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weighed = counts.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(smoothing)))
    else:
        given = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv)) if weights else None
        weighed = counts.withColumn("w", F.coalesce(F.try_element_at(given, F.col("source")), F.lit(0.0)) if given is not None else F.lit(0.0))
    total = weighed.agg(F.sum("n").alias("all_n"), F.sum("w").alias("all_w"))
    # One row is joined to each source's row.
    return weighed.join(F.broadcast(total)).select("source", "n", F.when(F.col("all_w") > 0, F.col("w") / F.col("all_w") * F.col("all_n") / F.col("n")).otherwise(0.0).alias("rate"))


def thresholds(rate: Column) -> Column:
    """The Poisson distribution function at 0, 1, 2, ... as far as doubles tell it from 1 (about rate + 10 sqrt(rate) + 20 terms).

    A rate of over 500 is split into equal parts of at most 500 by count(), as exp(-rate) would vanish.
    """
    last = F.ceil(rate + 10 * F.sqrt(rate) + 20).cast("int")
    zero = F.exp(-rate)
    step = lambda a, k: F.struct((a["p"] * rate / k).alias("p"), F.concat(a["cdf"], F.array(F.element_at(a["cdf"], -1) + a["p"] * rate / k)).alias("cdf"))
    return F.aggregate(F.sequence(F.lit(1), last), F.struct(zero.alias("p"), F.array(zero).alias("cdf")), step, lambda a: a["cdf"])


#: Rates above this are drawn as a sum of parts: exp(-rate) would vanish, and the sum of Poisson numbers is one.
PART = 500.0
#: Up to so many sources (some 300 bytes each) are sent to every task.
FEW_SOURCES = 20_000


def replicate(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", weights: Mapping[str, float] | None = None, smoothing: float = SMOOTHING, seed: int = SEED) -> DataFrame:
    """docs' columns, copies long, replica long (from 0) and shuffle_key string, each row as often as drawn, in the order of shuffle_key.

    The draw depends on seed and id alone: repeated rows get equal counts, and a null id counts as ''. Rows whose
    source has no weight go. Empty docs give no rows. Columns of docs with the names of the new ones are replaced.
    """
    own = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("key"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"))
    by_source = stage(
        rates(docs, source_col, weights, smoothing)
        .withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART)).cast("int"))
        .select("source", "parts", thresholds(F.col("rate") / F.col("parts")).alias("cdf")),
        "mix-rates",
    )
    # A hot source doesn't meet in one task: the few sources go to the documents, or skewed partitions are split.
    few = F.broadcast(by_source) if by_source.count() <= FEW_SOURCES else by_source
    draw = lambda i: F.size(F.filter("cdf", lambda c: c <= uniform(F.concat_ws("#", "key", i), seed))).cast("long")
    copies = F.aggregate(F.transform(F.sequence(F.lit(1), F.col("parts")), draw), F.lit(0).cast("long"), lambda a, x: a + x)
    drawn = own.join(few, "source").select("row", "key", copies.alias("copies")).where(F.col("copies") > 0)
    out = drawn.withColumn("replica", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    made = {"copies": F.col("copies"), "replica": F.col("replica"), "shuffle_key": F.md5(F.concat_ws("|", F.lit(f"order{seed}"), "key", F.col("replica").cast("string")))}
    kept = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in made]
    return out.select(*kept, *(c.alias(n) for n, c in made.items())).orderBy("shuffle_key", id_col)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, source, copies, replica, shuffle_key for documents, in training order."""
    return replicate(docs.select("doc_id", "source")).select("doc_id", "source", "copies", "replica", "shuffle_key")


_TERMS = math.ceil(50 + 10 * math.sqrt(50) + 20)
#: Inverts by adding up terms as replicate() does; the sources here have rates far below 50, where later terms are 0.
ORACLE_SQL = f"""
WITH RECURSIVE n AS (SELECT coalesce(source, '') AS s, count(*) AS n FROM documents GROUP BY 1),
rate AS (SELECT s, pow(n::DOUBLE, {SMOOTHING}) / sum(pow(n::DOUBLE, {SMOOTHING})) OVER () * sum(n) OVER () / n AS r FROM n),
term AS (
  SELECT s, r, 0 AS k, exp(-r) AS p, exp(-r) AS c FROM rate
  UNION ALL SELECT s, r, k + 1, p * r / (k + 1), c + p * r / (k + 1) FROM term WHERE k < {_TERMS} AND k < ceil(r + 10 * sqrt(r) + 20)),
cdf AS (SELECT s, list(c ORDER BY k) AS cs FROM term GROUP BY s),
drawn AS (
  SELECT doc_id, source, len([1 FOR c IN cs IF c <= ('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, '') || '#1'), 1, 13))::BIGINT::DOUBLE / {float(2**52)}]) AS copies
  FROM documents JOIN cdf ON s = coalesce(source, ''))
SELECT doc_id, source, copies, replica, md5('order{SEED}|' || coalesce(doc_id::VARCHAR, '') || '|' || replica) AS shuffle_key
FROM (SELECT doc_id, source, copies, unnest(range(0, copies)) AS replica FROM drawn)
"""
