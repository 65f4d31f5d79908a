"""Numbered commits in a shared folder: of runs that write at once, one gets each number."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Writes text as a file that is there whole or not at all; False where the path was taken.

    The text is written beside it first. On a local file system a hard link puts it in place, elsewhere a rename that
    the file system refuses where the path is taken, as HDFS does in one step.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    fs.mkdirs(target.getParent())
    draft = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if fs.getUri().getScheme() == "file":
            local = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
            jvm.java.nio.file.Files.createLink(local(target), local(draft))
            return True
        return fs.rename(draft, target)
    except Exception as error:  # py4j wraps whatever the file system throws
        if "FileAlreadyExists" in str(error):
            return False
        raise
    finally:
        fs.delete(draft, False)


def commit(spark: SparkSession, folder: str, batch: str) -> int:
    """Gives batch the next free number of the folder's commits, and returns it. Numbers are taken without gaps, so those below one's own are all known."""
    n = max((r["number"] for r in committed(spark, folder).select("number").collect()), default=-1) + 1  # a row a run
    while not put_if_absent(spark, f"{folder}/{n:019d}", batch):
        n += 1
    return n


def committed(spark: SparkSession, folder: str) -> DataFrame:
    """(number, batch) of the folder's commits."""
    try:
        rows = spark.read.option("wholetext", True).text(folder).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("batch"))
    except AnalysisException:
        return spark.createDataFrame([], "number long, batch string")
    return rows.select(F.col("file").cast("long").alias("number"), "batch")
