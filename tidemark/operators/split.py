"""Splits of subjects: by share of the samples, by demographics, and both, to study drift between groups."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.codes import random_order

BOUNDS = ("geq", "greater", "leq", "less")
KEYWORDS = (*BOUNDS, "choice")
#: Orders of the subjects that are tried for the nearest share.
TRIES = 100
Settings = Mapping[str, Mapping[str, object]]


def check_sizes(test: float, val: float) -> None:
    for name, size in (("test", test), ("val", val)):
        if not 0 <= size <= 1:
            raise ValueError(f"invalid {name} size {size}")
    if test + val > 1:
        raise ValueError("test and val together are more than all")


def check_settings(settings: Settings, columns: Sequence[str]) -> None:
    """D9."""
    for attribute, rules in settings.items():
        if attribute not in columns:
            raise ValueError(f"unknown attribute {attribute}")
        if not rules:
            raise ValueError(f"no rule for {attribute}")
        for word, value in rules.items():
            if word not in KEYWORDS:
                raise ValueError(f"unknown rule {word} for {attribute}")
            if value is None or value == [] or value == "":
                raise ValueError(f"empty rule {word} for {attribute}")
        if ("leq" in rules and "less" in rules) or ("geq" in rules and "greater" in rules):
            raise ValueError(f"two bounds on one side of {attribute}")
        if "choice" in rules and len(rules) > 1:
            raise ValueError(f"range and choice for {attribute}")
        low, high = (next((rules[w] for w in words if w in rules), None) for words in (("geq", "greater"), ("leq", "less")))
        if low is not None and high is not None and low > high:
            raise ValueError(f"{attribute}: {low} is above {high}")


def _violations(settings: Settings) -> list[Column]:
    """One column a rule: whether a row violates it. A null never violates a bound, and always a choice."""
    out = []
    for attribute, rules in settings.items():
        c = F.col(attribute)
        for word, value in rules.items():
            if word == "choice":
                values = list(value) if isinstance(value, (list, tuple, set)) else [value]
                out.append(F.coalesce(~c.isin(*values), F.lit(True)))
            else:
                fits = {"geq": c >= value, "greater": c > value, "leq": c <= value, "less": c < value}[word]
                out.append(F.coalesce(~fits, F.lit(False)))
    return out


def demographic_subjects(info: DataFrame, settings: Settings, invert: bool = False, key: str = "SUBJECT_ID") -> DataFrame:
    """D3: subjects of which no row violates a rule. D4, inverted: those without, for some rule, any row that meets it."""
    check_settings(settings, info.columns)
    rules = _violations(settings)
    if not rules:
        return info.select(key).distinct() if not invert else info.select(key).distinct().limit(0)
    if not invert:
        any_ = rules[0]
        for r in rules[1:]:
            any_ = any_ | r
        return info.groupBy(key).agg(F.bool_or(any_).alias("_bad")).where(~F.col("_bad")).select(key)
    met = info.groupBy(key).agg(*(F.bool_or(~r).alias(f"_m{i}") for i, r in enumerate(rules)))
    all_ = F.col("_m0")
    for i in range(1, len(rules)):
        all_ = all_ & F.col(f"_m{i}")
    return met.where(~all_).select(key)


def nearest_share(shares: DataFrame, target: float, tries: int = TRIES, key: str = "SUBJECT_ID", seed: int = 0) -> DataFrame:
    """Subjects whose shares add up as near to target as any prefix of tries pseudo-random orders does.

    shares: (key, ratio), one row a subject. The orders are cut into ranges; totals of the ranges tell where an order
    meets the target, so only the rows of one range of each order are sorted. Of equally near ones the first order, and
    in it the shorter prefix, is taken. One row is collected: the order and its place.
    """
    tried = shares.select(key, "ratio", F.explode(F.sequence(F.lit(seed), F.lit(seed + tries - 1))).alias("try"))
    tried = tried.withColumn("_place", _order(F.col(key), F.col("try"))).withColumn("_range", F.expr(f"_place div {_PLACES // RANGES}"))
    totals = tried.groupBy("try", "_range").agg(F.sum("ratio").alias("_t"))
    upto = F.sum("_t").over(Window.partitionBy("try").orderBy("_range"))
    ends = totals.withColumn("cum", upto).withColumn("_before", F.col("cum") - F.col("_t"))
    met = ends.where((F.col("_before") <= target + 1e-9) & (F.col("cum") >= target - 1e-9)).select("try", "_range", "_before")
    near = tried.join(F.broadcast(met), ["try", "_range"])  # a range or two of each order
    inside = Window.partitionBy("try", "_range").orderBy("_place", key)
    last = ends.select("try", "cum", (F.col("_range") * (_PLACES // RANGES) + (_PLACES // RANGES - 1)).alias("place"), F.lit(None).cast(shares.schema[key].dataType).alias("at"))
    cums = last.unionByName(near.select("try", (F.col("_before") + F.sum("ratio").over(inside)).alias("cum"), F.col("_place").alias("place"), F.col(key).alias("at")))
    cums = cums.select(F.round(F.abs(F.col("cum") - target), 9).alias("miss"), "try", F.round("cum", 9).alias("cum"), "place", "at")
    best = cums.agg(F.min(F.struct("miss", "try", "cum", "place", "at")).alias("b")).first()["b"]  # where the best prefix ends: one row
    if best is None or best["miss"] >= target:
        return shares.select(key).limit(0)
    place = _order(F.col(key), F.lit(best["try"]))
    upto = (place < best["place"]) | ((place == best["place"]) & (F.col(key) <= best["at"] if best["at"] is not None else F.lit(True)))
    return shares.where(upto).select(key)


#: Places of a pseudo-random order, and the ranges into which they are cut.
_PLACES, RANGES = 1 << 28, 64


def _order(key: Column, seed: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws("|", seed.cast("string"), key.cast("string"))), 1, 7), 16, 10).cast("long")


def ratio_split(shares: DataFrame, test: float = 0.0, val: float = 0.0, tries: int = TRIES, key: str = "SUBJECT_ID") -> DataFrame:
    """(key, split): test first, then val, the rest is train; whole subjects, sizes as shares of the samples."""
    check_sizes(test, val)
    left, out = shares, None
    for name, size in (("test", test), ("val", val)):
        if size:
            part = nearest_share(left, size, tries, key).withColumn("split", F.lit(name))
            left = left.join(part, key, "left_anti")
            out = part if out is None else out.unionByName(part)
    rest = left.select(key).withColumn("split", F.lit("train"))
    return rest if out is None else out.unionByName(rest)


def demographic_split(info: DataFrame, settings: Mapping[str, Settings], key: str = "SUBJECT_ID") -> DataFrame:
    """(key, split), each named set by its own rules; train, unless named, is what meets the inverse of all others."""
    parts = {name: demographic_subjects(info, rules, key=key) for name, rules in settings.items()}
    if "train" not in parts:
        train = info.select(key).distinct()
        for name, rules in settings.items():
            train = train.join(demographic_subjects(info, rules, True, key), key, "left_semi")
        parts["train"] = train
    out = None
    for name, part in parts.items():
        named = part.withColumn("split", F.lit(name))
        out = named if out is None else out.unionByName(named)
    return out


def reduce_to_ratio(assignment: DataFrame, shares: DataFrame, test: float, val: float, tries: int = TRIES, key: str = "SUBJECT_ID") -> DataFrame:
    """The split that is smallest against its target stays whole; the others are cut so that the ratios hold. Three numbers are collected."""
    check_sizes(test, val)
    targets = {n: s for n, s in (("train", 1 - test - val), ("val", val), ("test", test)) if s > 0}
    sized = assignment.join(shares, key)
    sums = {r["split"]: float(r["s"]) for r in sized.groupBy("split").agg(F.sum("ratio").alias("s")).collect()}
    scale = min((sums.get(n, 0.0) / s for n, s in targets.items()), default=0.0)
    out = None
    for name, size in targets.items():
        own = sized.where(F.col("split") == name).select(key, "ratio")
        goal = scale * size
        part = own.select(key) if sums.get(name, 0.0) <= goal + 1e-9 else nearest_share(own, goal, tries, key)
        part = part.withColumn("split", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def take_validation(assignment: DataFrame, shares: DataFrame, val: float, key: str = "SUBJECT_ID", tries: int = TRIES) -> DataFrame:
    """Takes the share val, of all samples, out of the train subjects."""
    train = shares.join(assignment.where("split = 'train'"), key, "left_semi")
    part = nearest_share(train, val, tries, key)
    moved = assignment.join(part.withColumn("_v", F.lit(True)), key, "left")
    return moved.select(key, F.when(F.col("_v") & (F.col("split") == "train"), "val").otherwise(F.col("split")).alias("split"))


def fix_train_size(assignment: DataFrame, n: int, seed: int = 42, key: str = "SUBJECT_ID") -> DataFrame:
    """N train subjects in pseudo-random order; the other splits stay."""
    train = assignment.where("split = 'train'").orderBy(random_order(F.col(key), seed), key).limit(n)
    return train.unionByName(assignment.where("split <> 'train'"))


def subjects_for_samples(counts: DataFrame, n: int, tries: int = 20, key: str = "SUBJECT_ID") -> DataFrame:
    """Subjects with about n samples together (count stays instead for deep supervision)."""
    return nearest_share(counts.select(key, F.col("n").cast("double").alias("ratio")), float(n), tries, key)


def train_test_split(info: DataFrame, shares: DataFrame, test: float = 0.0, val: float = 0.0, split: Mapping[str, Settings] | None = None, keep: Settings | None = None, train_size: int | None = None, tries: int = TRIES, key: str = "SUBJECT_ID") -> DataFrame:
    """(key, split). keep filters subjects first; split assigns by demographics, then the sizes, if given, are enforced."""
    subjects = shares.join(demographic_subjects(info, keep, key=key), key, "left_semi") if keep else shares
    if split:
        out = demographic_split(info, split, key).join(subjects.select(key), key, "left_semi")
        if val and "val" not in split:
            out = take_validation(out, subjects, val, key, tries)
        out = reduce_to_ratio(out, subjects, test, val, tries, key) if test or val else out
    else:
        out = ratio_split(subjects, test, val, tries, key)
    return fix_train_size(out, train_size, key=key) if train_size is not None else out


def fingerprint(**settings: object) -> str:
    """Names the settings of a split; it is kept beside the assignment, which is made anew where they differ."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()


def restored(folder: str, make: Callable[[], DataFrame], spark: SparkSession, **settings: object) -> DataFrame:
    """The assignment that was made with the same settings and kept in folder; else make(), which is kept for the next time."""
    path = f"{folder}/{fingerprint(**settings)[:16]}"
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        made = make()
        made.write.mode("overwrite").parquet(path)
        return spark.read.schema(made.schema).parquet(path)


def with_fixed(subjects: DataFrame, test: DataFrame, val: DataFrame, key: str = "SUBJECT_ID") -> DataFrame:
    """Published test and val lists; train is the rest."""
    rest = subjects.select(key).distinct().join(test, key, "left_anti").join(val, key, "left_anti").withColumn("split", F.lit("train"))
    own = lambda part, name: subjects.select(key).distinct().join(part, key, "left_semi").withColumn("split", F.lit(name))
    return rest.unionByName(own(test, "test")).unionByName(own(val, "val"))
