"""URL filters: gradient-boosted trees on lexical features, trained from labelled URLs.

Rules label the URLs they fit, and their verdict stands. URLs without a rule are judged by trees that are trained on
a bounded sample of the labelled ones, from the URL's text alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import stage


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    block: bool

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("com", "/en/", True), Rule("example.com", "/en/7", False), Rule("net", "/de/", False), Rule("example.net", "/de/8", True), Rule("org", "/es/", True))
#: Labelled URLs that the trees are trained on, in expectation; the trees' count and depth.
TRAIN_ROWS, TREES, DEPTH = 4000, 12, 4
#: Fewer labelled URLs than this, or one verdict alone, train no model: URLs without a rule are then allowed.
LEAST_ROWS = 20
#: Up to so many suffixes (some 100 bytes each) are sent to every task.
FEW_SUFFIXES = 20_000


def split_url(url: Column) -> tuple[Column, Column]:
    """host (lower case in A-Z) and path; both empty for null and for what has no '://'."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    ascii_lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(ascii_lower, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits (of equally long ones the first), or nulls. A rule fits its host and all below it."""
    name = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):  # the last that is put around is looked at first
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name = F.when(fits, F.lit(r.name)).otherwise(name)
        verdict = F.when(fits, F.lit("block" if r.block else "allow")).otherwise(verdict)
    return name, verdict


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def with_suffix_statistics(named: DataFrame) -> DataFrame:
    """named (url, host, label) with suffix_rows and suffix_block: how many labelled rows have the suffix (log), and the share of them that is blocked.

    Counted are all labelled rows, in two folds by hash; a labelled row gets the other fold's, so that its own label has
    no part in its features.
    """
    fold = F.pmod(F.xxhash64(F.coalesce("url", F.lit("")), F.lit(7)), F.lit(2))
    keyed = named.withColumns({"_suffix": suffix_of(F.col("host")), "_fold": fold})
    of = lambda i, block: F.count(F.when((F.col("_fold") == i) & ((F.col("label") == "block") if block else F.lit(True)), 1))
    counts = keyed.where(F.col("label").isNotNull()).groupBy("_suffix").agg(*(of(i, b).alias(f"_{'b' if b else 'n'}{i}") for i in (0, 1) for b in (False, True)))
    counts = stage(counts, "url-suffixes")
    few = F.broadcast(counts) if counts.count() <= FEW_SUFFIXES else counts
    told = lambda c: F.coalesce(F.when(F.col("label").isNull(), F.col(f"_{c}0") + F.col(f"_{c}1")).when(F.col("_fold") == 0, F.col(f"_{c}1")).otherwise(F.col(f"_{c}0")), F.lit(0))
    out = keyed.join(few, "_suffix", "left").withColumns({"suffix_rows": F.log1p(told("n")), "suffix_block": (told("b") + 1) / (told("n") + 2)})
    return out.drop("_suffix", "_fold", "_n0", "_b0", "_n1", "_b1")


def _count(text: Column, regex: str) -> Column:
    return F.regexp_count(text, F.lit(regex)).cast("double")


def features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """The lexical features of a URL; none of them holds the host or the path as such."""
    url = F.coalesce(url, F.lit(""))
    length = F.length(url).cast("double")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    letters = F.split(url, "")
    shares = F.transform(F.array_distinct(letters), lambda c: F.size(F.filter(letters, lambda x: x == c)) / F.greatest(length, F.lit(1.0)))
    entropy = F.aggregate(shares, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    last = F.regexp_extract(path, r"([^/]*)/?$", 1)
    return {
        "length": length,
        "host_length": F.length(host).cast("double"),
        "path_length": F.length(path).cast("double"),
        "depth": _count(path, "/[^/]"),
        "labels": _count(host, "[^.]+"),
        "host_hyphens": _count(host, "-"),
        "digit_ratio": _count(url, "[0-9]") / F.greatest(length, F.lit(1.0)),
        "host_digits": _count(host, "[0-9]"),
        "entropy": F.when(length > 0, entropy).otherwise(0.0),
        "parameters": _count(query, "[^&]+"),
        "fragment": F.contains(url, F.lit("#")).cast("double"),
        "secure": url.startswith("https://").cast("double"),
        "suffix_length": F.length(suffix_of(host)).cast("double"),
        "page_digits": _count(last, "[0-9]"),
        "page_dot": F.contains(last, F.lit(".")).cast("double"),
        "page_slash": path.endswith("/").cast("double"),
        "first_segment": F.length(F.regexp_extract(path, r"^/([^/]*)", 1)).cast("double"),
    }


def scored(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[Rule, ...] = RULES, train_rows: int = TRAIN_ROWS, seed: int = 3) -> DataFrame:
    """(id, url, host, path, rule, label, sampled, p): label is the rule's verdict, sampled whether the trees learned from the row, p their probability of block."""
    host, path = split_url(F.col(url_col))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    named = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host.alias("host"), path.alias("path")).withColumns({"rule": rule, "label": verdict})
    named = with_suffix_statistics(named)
    as_vector = F.array(*features(F.col("url"), F.col("host"), F.col("path")).values(), F.col("suffix_rows"), F.col("suffix_block"))
    n = named.where(F.col("label").isNotNull()).count()
    share = min(1.0, train_rows / max(1, n))
    near = F.pmod(F.xxhash64(F.coalesce("url", F.lit("")), "id", F.lit(seed)), F.lit(1 << 40)) < int(share * (1 << 40))
    named = named.withColumn("sampled", F.col("label").isNotNull() & near)
    sample = stage(named.where("sampled").select(as_vector.alias("x"), (F.col("label") == "block").cast("double").alias("y")), "url-sample")
    by_label = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows at most
    kept = ["id", "url", "host", "path", "rule", "label", "sampled", "p"]
    if len(by_label) < 2 or sum(by_label.values()) < LEAST_ROWS:
        return named.withColumn("p", F.lit(0.0)).select(*kept)
    weigh = F.when(F.col("y") == 1, F.lit(1.0 / by_label[1.0])).otherwise(1.0 / by_label[0.0]) * (sum(by_label.values()) / 2)
    model = GBTClassifier(featuresCol="x", labelCol="y", weightCol="w", maxIter=TREES, maxDepth=DEPTH, seed=seed).fit(
        sample.select(array_to_vector("x").alias("x"), "y", weigh.alias("w"))
    )
    return model.transform(named.withColumn("x", array_to_vector(as_vector))).withColumn("p", vector_to_array("probability")[1]).select(*kept)


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[Rule, ...] = RULES, train_rows: int = TRAIN_ROWS, seed: int = 3) -> DataFrame:
    """(id, host, path, rule, verdict, p_block), one row per row of pages.

    p_block is the trees' probability (null where a rule decides). A null URL has empty host and path and is judged by
    the trees as an empty text. The sample for training is the labelled rows whose hash falls below a bound, the same in
    every run; repeated rows are judged alike, and a URL that is repeated often is sampled row by row. Null ids are as
    good as others. No labelled rows: all without a rule are allowed; an empty table gives no rows.
    """
    return scored(pages, id_col, url_col, rules, train_rows, seed).select(
        "id", "host", "path", "rule",
        F.coalesce("label", F.when(F.col("p") > 0.5, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        F.when(F.col("label").isNull(), F.col("p")).alias("p_block"),
    )


def digest(pages: DataFrame) -> DataFrame:
    """op6's columns for pages."""
    return judge(pages).withColumnRenamed("id", "page_id")


#: Host, path and rule alone, which is what SQL can tell; tests compare these columns.
RULES_SQL = f"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, CASE {" ".join(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.name}'" for r in sorted(RULES, key=lambda r: -len(r.name)))} END AS rule FROM h
"""
