"""Tables kept between stages: partitioned Parquet, chosen by subject."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.codes import random_order
from tidemark.functions.permutation import permuted
from tidemark.operators.running import prefix_sums
from tidemark.sources import commits


#: Keys that are sent to every task; more of them are met by a shuffle.
FEW_KEYS = 20_000


def few(keys: DataFrame) -> DataFrame:
    """The keys, to be sent to every task where they are counted to be few: the table that they meet stays where it is."""
    return F.broadcast(keys) if keys.limit(FEW_KEYS + 1).count() <= FEW_KEYS else keys


def common_subjects(tables: Sequence[DataFrame], key: str = "SUBJECT_ID") -> DataFrame:
    """Subjects that every table has."""
    return reduce(lambda a, b: a.join(b, key, "left_semi"), (t.select(key).distinct() for t in tables))


def _holders(spark: SparkSession, folder: str, key: str, kind: str) -> DataFrame:
    """(key, batch, number): which committed batches have a subject; runs that wrote at once may both have it."""
    try:
        rows = spark.read.parquet(f"{folder}/_subjects")
    except AnalysisException:
        return spark.createDataFrame([], f"{key} {kind}, batch string, number long")
    return rows.join(commits.committed(spark, f"{folder}/_commits"), "batch").select(key, "batch", "number")


def done_subjects(spark: SparkSession, folder: str, key: str = "SUBJECT_ID", kind: str = "int") -> DataFrame:
    """(key, batch) of what a stage's folder holds: each subject with the first of the committed batches that have it."""
    return _holders(spark, folder, key, kind).groupBy(key).agg(F.min_by("batch", "number").alias("batch"))


@contextmanager
def measured_broadcasts(spark: SparkSession) -> Iterator[None]:
    """Joins that run inside are broadcast only where a side was measured to be small, after its shuffle.

    Stored tables are columns of few values: files of some MB hold millions of rows, which the planner would broadcast
    by the size of the files.
    """
    threshold, adaptive = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before = {c: spark.conf.get(c, None) for c in (threshold, adaptive)}
    spark.conf.set(adaptive, before[adaptive] or spark.conf.get(threshold))
    spark.conf.set(threshold, "-1")
    try:
        yield
    finally:
        for c, value in before.items():
            if value is None:
                spark.conf.unset(c)
            else:
                spark.conf.set(c, value)


def of_subjects(table: DataFrame, ids: DataFrame, others: DataFrame, key: str = "SUBJECT_ID") -> DataFrame:
    """The rows of the subjects ids, others being all other subjects of the table: where these are few they are sent to the table, which is not shuffled then."""
    if others.count() > FEW_KEYS:
        return table.join(ids, key, "left_semi")
    return table.where(F.col(key).isNotNull()).join(F.broadcast(others.select(key)), key, "left_anti")


def write_by_subject(tables: Mapping[str, DataFrame], folder: str, key: str = "SUBJECT_ID") -> None:
    """The rows of subjects that all tables have and the folder doesn't, as a batch in a folder of each table.

    A batch counts only once it has a number, which it is given last: a run that ends before leaves files that nobody
    reads, and the next one writes these subjects anew. Runs may write at once, without waiting: of the batches that
    have a subject, the one with the least number counts and the others' rows of it are never read, whatever the order
    in which files appear. Rows are clustered by ranges of subjects, so that their number of files follows the data and
    a few subjects are found by the files' least and largest keys. Where a table has few subjects to leave out, these
    are sent to its rows; its rows are shuffled for that only where they are many. Tables are read several times.
    """
    spark = next(iter(tables.values())).sparkSession
    batch = f"b{uuid.uuid4().hex}"  # never read as a number
    kind = next(iter(tables.values())).schema[key].dataType.simpleString()
    with measured_broadcasts(spark), staging(spark, f"{folder}/_staged") as staged:
        keys = staged(reduce(DataFrame.unionAll, (t.where(F.col(key).isNotNull()).select(key, F.lit(i).alias("_table")).distinct() for i, t in enumerate(tables.values()))), "keys")
        done = few(done_subjects(spark, folder, key, kind))
        new = common_subjects([keys.where(F.col("_table") == i) for i in range(len(tables))], key).join(done, key, "left_anti")
        new.write.parquet(f"{folder}/_subjects/batch={batch}")  # once, not with each table
        ids = spark.read.schema(new.schema).parquet(f"{folder}/_subjects/batch={batch}")
        others = staged(keys.join(ids, key, "left_anti"), "others")
        for i, (name, t) in enumerate(tables.items()):
            own = of_subjects(t, ids, others.where(F.col("_table") == i), key)
            own.repartitionByRange(key).sortWithinPartitions(key).write.parquet(f"{folder}/{name}/batch={batch}")
    commits.commit(spark, f"{folder}/_commits", batch)


def sample_subjects(ids: DataFrame, n: int, seed: int = 42, key: str = "SUBJECT_ID", skip: int = 0) -> DataFrame:
    """N subjects in pseudo-random order after skip; the next call's skip goes on where this one ended."""
    return ids.select(key).distinct().orderBy(random_order(F.col(key), seed), key).offset(skip).limit(n)


@contextmanager
def staging(spark: SparkSession, folder: str) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A function that writes a table and reads it again, in a folder of its own that goes in the end: what is read several times is made once."""
    own = f"{folder}/{uuid.uuid4().hex}"

    def staged(table: DataFrame, name: str) -> DataFrame:
        table.write.parquet(f"{own}/{name}")
        return spark.read.schema(table.schema).parquet(f"{own}/{name}")

    try:
        yield staged
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(own)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def numbered_subjects(ids: DataFrame, key: str = "SUBJECT_ID") -> DataFrame:
    """(key, number): the distinct subjects, numbered from 0 in their order, by running counts of ranges."""
    rows = ids.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_one", F.lit(1))
    return prefix_sums(rows, [], key, ["_one"]).select(key, (F.col("cum__one") - 1).cast("long").alias("number"))


def draw_subjects(subjects: DataFrame, total: int, n: int, start: int = 0, seed: int = 42, key: str = "SUBJECT_ID") -> DataFrame:
    """(key, draw), the draws number start to start + n - 1: each epoch of `total` draws has every subject once, in an order of its own.

    subjects are numbered ones. A subject's place in an epoch is computed from its number, so nothing is sorted and a
    call needs to know of the calls before only how many draws they made. Draws of a whole epoch and more are as many
    rows as they are draws.
    """
    if total <= 0 or n <= 0:
        return subjects.select(key, F.lit(0).cast("long").alias("draw")).limit(0)
    epochs = F.sequence(F.lit(start // total).cast("long"), F.lit((start + n - 1) // total).cast("long"))
    each = subjects.withColumn("_epoch", F.explode(epochs))
    placed = each.select(key, (F.col("_epoch") * total + permuted(F.col("number"), total, seed, F.col("_epoch"))).alias("draw"))
    return placed.where((F.col("draw") >= start) & (F.col("draw") < start + n))


def read_subjects(spark: SparkSession, folder: str, kind: str, ids: Sequence[int] | None = None, num_subjects: int | None = None, seed: int = 42, key: str = "SUBJECT_ID") -> DataFrame:
    """A stage's table, of all subjects, given ones, or a seeded sample; ids and a number together are an error."""
    if ids is not None and num_subjects is not None:
        raise ValueError("give subject ids or their number, not both")
    batches = [r["batch"] for r in commits.committed(spark, f"{folder}/_commits").select("batch").collect()]  # one for each run
    table = spark.read.parquet(f"{folder}/{kind}").where(F.col("batch").isin(*batches))
    held = _holders(spark, folder, key, table.schema[key].dataType.simpleString())
    # Only runs at once leave subjects in two batches; without them nothing is joined.
    lost = held.withColumn("first", F.min("number").over(Window.partitionBy(key))).where("number > first").select(key, "batch")
    table = (table if lost.isEmpty() else table.join(lost, [key, "batch"], "left_anti")).drop("batch")
    if ids is not None:
        return table.where(F.col(key).isin(*ids)) if ids else table.limit(0)
    if num_subjects is not None:
        return table.join(sample_subjects(table, num_subjects, seed, key), key, "left_semi")
    return table


def stage_subjects(info: DataFrame, table: DataFrame, key: str = "SUBJECT_ID") -> DataFrame:
    """The demographic table beside a stage's output: its subjects alone."""
    return info.join(table.select(key).distinct(), key, "left_semi")


def split_view(table: DataFrame, assignment: DataFrame, split: str, key: str = "SUBJECT_ID") -> DataFrame:
    """The rows of a split's subjects."""
    return table.join(assignment.where(F.col("split") == split), key, "left_semi")


def split_ratios(assignment: DataFrame) -> DataFrame:
    """(split, n, ratio) by number of subjects."""
    n = assignment.groupBy("split").agg(F.count_distinct("SUBJECT_ID").alias("n"))
    return n.withColumn("ratio", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))


def write_samples(x: DataFrame, y: DataFrame, path: str, keys: Sequence[str] = ("subject", "stay")) -> None:
    """One flat row a sample, features beside labels."""
    x.join(y, list(keys)).write.mode("overwrite").parquet(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Metric rows (run, split, metric, value) as JSON, by run and split."""
    metrics.where(F.col("value").isNotNull()).write.mode("append").partitionBy("run", "split").json(path)
