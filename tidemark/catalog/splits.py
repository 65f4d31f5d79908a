"""Queries of splits, scalers and imputers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog import proxies as P
from tidemark.operators import scale, split
from tidemark.operators.tasks import sample_shares
from tidemark.sources import stores

KEY = "SUBJECT_ID"


def _shares(spark: SparkSession, d: str) -> DataFrame:
    """A subject is a customer, its samples are its orders."""
    n = P.table(spark, d, "orders").groupBy(F.col("o_custkey").alias(KEY)).agg(F.count(F.lit(1)).alias("n"))
    made = sample_shares(n)
    path = P.folder(spark)  # counted once, and read by each search
    made.write.parquet(path)
    return spark.read.schema(made.schema).parquet(path)


def _info(spark: SparkSession, d: str) -> DataFrame:
    """A row an order: the customer's balance, which every seventh order lacks, segment, and the order's priority."""
    o, c = P.table(spark, d, "orders"), P.table(spark, d, "customer")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_custkey").alias(KEY), F.when(F.col("o_orderkey") % 7 != 0, F.col("c_acctbal")).alias("BALANCE"), F.when(F.col("o_orderkey") % 50 != 0, F.col("c_mktsegment")).alias("SEGMENT"), F.col("o_totalprice").alias("PRICE"),
    )


_I = """i AS (SELECT o_custkey AS SUBJECT_ID, CASE WHEN o_orderkey % 7 <> 0 THEN c_acctbal END AS BALANCE, CASE WHEN o_orderkey % 50 <> 0 THEN c_mktsegment END AS SEGMENT, o_totalprice AS PRICE FROM orders JOIN customer ON o_custkey = c_custkey)"""
_S = "s AS (SELECT o_custkey AS SUBJECT_ID, count(*) / sum(count(*)) OVER () AS ratio FROM orders GROUP BY 1)"
RANGE = {"BALANCE": {"geq": 500, "less": 6000}, "PRICE": {"leq": 480000}}
CHOICE = {"SEGMENT": {"choice": ["BUILDING", "MACHINERY"]}}
TRIES = split.TRIES


def _nearest(rows: str, target: float, name: str, tries: int = TRIES) -> str:
    """CTEs: {name} has the subjects of the nearest prefix."""
    return f"""{name}_c AS (SELECT SUBJECT_ID, t, round(sum(ratio) OVER (PARTITION BY t ORDER BY ('0x' || substr(md5(t::VARCHAR || '|' || SUBJECT_ID::VARCHAR), 1, 7))::BIGINT, SUBJECT_ID), 9) AS cum
  FROM {rows}, (SELECT unnest(range(0, {tries})) AS t)),
{name}_b AS (SELECT t AS bt, cum AS bc FROM {name}_c ORDER BY round(abs(cum - {target}), 9), t, cum LIMIT 1),
{name} AS (SELECT SUBJECT_ID FROM {name}_c, {name}_b WHERE t = bt AND cum <= bc)"""


def ratio_split(spark: SparkSession, d: str) -> DataFrame:
    return split.ratio_split(_shares(spark, d), 0.2, 0.1, TRIES)


RATIO_SQL = f"""WITH {_S}, {_nearest("s", 0.2, "te")}, s2 AS (SELECT * FROM s WHERE SUBJECT_ID NOT IN (SELECT SUBJECT_ID FROM te)), {_nearest("s2", 0.1, "va")}
SELECT SUBJECT_ID, CASE WHEN SUBJECT_ID IN (SELECT SUBJECT_ID FROM te) THEN 'test' WHEN SUBJECT_ID IN (SELECT SUBJECT_ID FROM va) THEN 'val' ELSE 'train' END AS split FROM s"""


def restored(spark: SparkSession, d: str) -> DataFrame:
    """The ratio split, made and kept once and then read, as its settings are the same."""
    folder = P.folder(spark)
    for _ in range(2):
        out = split.restored(folder, lambda: ratio_split(spark, d), spark, test=0.2, val=0.1)
    return out


def kept(settings, invert: bool = False):
    return lambda spark, d: split.demographic_subjects(_info(spark, d), settings, invert)


def demographic_split(spark: SparkSession, d: str) -> DataFrame:
    return split.demographic_split(_info(spark, d), {"test": {"SEGMENT": {"choice": "BUILDING"}}, "val": {"PRICE": {"greater": 450000}}})


def reduced(spark: SparkSession, d: str) -> DataFrame:
    a = P.table(spark, d, "customer").join(_shares(spark, d), F.col("c_custkey") == F.col(KEY), "left_semi")
    named = F.when(F.col("c_mktsegment") == "BUILDING", "test").when(F.col("c_mktsegment") == "MACHINERY", "val").otherwise("train")
    return split.reduce_to_ratio(a.select(F.col("c_custkey").alias(KEY), named.alias("split")), _shares(spark, d), 0.3, 0.1, TRIES)


REDUCED_SQL = f"""WITH {_S}, a AS (SELECT s.*, CASE c_mktsegment WHEN 'BUILDING' THEN 'test' WHEN 'MACHINERY' THEN 'val' ELSE 'train' END AS split FROM s JOIN customer ON c_custkey = SUBJECT_ID),
z AS (SELECT split, sum(ratio) AS total FROM a GROUP BY 1), sc AS (SELECT min(total / CASE split WHEN 'test' THEN 0.3 WHEN 'val' THEN 0.1 ELSE 0.6 END) AS f FROM z),
{", ".join(f'''{n}_r AS (SELECT SUBJECT_ID, ratio FROM a WHERE split = '{n}'), {n}_c AS (SELECT SUBJECT_ID, t, round(sum(ratio) OVER (PARTITION BY t ORDER BY ('0x' || substr(md5(t::VARCHAR || '|' || SUBJECT_ID::VARCHAR), 1, 7))::BIGINT, SUBJECT_ID), 9) AS cum FROM {n}_r, (SELECT unnest(range(0, {TRIES})) AS t)),
{n}_b AS (SELECT t AS bt, cum AS bc FROM {n}_c, sc ORDER BY round(abs(cum - f * {g}), 9), t, cum LIMIT 1), {n}_o AS (SELECT SUBJECT_ID, '{n}' AS split FROM {n}_c, {n}_b WHERE t = bt AND cum <= bc),
{n}_f AS (SELECT SUBJECT_ID, '{n}' AS split FROM {n}_r, sc WHERE (SELECT total FROM z WHERE split = '{n}') <= f * {g} + 1e-9 UNION ALL SELECT * FROM {n}_o WHERE NOT (SELECT total <= f * {g} + 1e-9 FROM z, sc WHERE split = '{n}'))'''
  for n, g in (("train", 0.6), ("val", 0.1), ("test", 0.3)))}
SELECT * FROM train_f UNION ALL SELECT * FROM val_f UNION ALL SELECT * FROM test_f"""


def validation(spark: SparkSession, d: str) -> DataFrame:
    s = _shares(spark, d)
    a = s.select(KEY, F.when(F.col(KEY) % 5 == 0, "test").otherwise("train").alias("split"))
    return split.fix_train_size(split.take_validation(a, s, 0.15, tries=TRIES), 300)


VALIDATION_SQL = f"""WITH {_S}, tr AS (SELECT * FROM s WHERE SUBJECT_ID % 5 <> 0), {_nearest("tr", 0.15, "va")},
o AS (SELECT SUBJECT_ID FROM tr WHERE SUBJECT_ID NOT IN (SELECT SUBJECT_ID FROM va) ORDER BY ('0x' || substr(md5('42|' || SUBJECT_ID::VARCHAR), 1, 7))::BIGINT, SUBJECT_ID LIMIT 300)
SELECT SUBJECT_ID, 'train' AS split FROM o UNION ALL SELECT SUBJECT_ID, 'val' FROM va UNION ALL SELECT SUBJECT_ID, 'test' FROM s WHERE SUBJECT_ID % 5 = 0"""


def by_samples(spark: SparkSession, d: str) -> DataFrame:
    n = P.table(spark, d, "orders").groupBy(F.col("o_custkey").alias(KEY)).agg(F.count(F.lit(1)).alias("n"))
    return split.subjects_for_samples(n, 1000)


def whole_split(spark: SparkSession, d: str) -> DataFrame:
    return split.train_test_split(_info(spark, d), _shares(spark, d), test=0.2, keep=RANGE, tries=TRIES)


def fixed(spark: SparkSession, d: str) -> DataFrame:
    c = P.table(spark, d, "customer").select(F.col("c_custkey").alias(KEY))
    a = split.with_fixed(c, c.where("SUBJECT_ID % 10 = 0"), c.where("SUBJECT_ID % 10 = 1"))
    return stores.split_ratios(a)


def split_view(spark: SparkSession, d: str) -> DataFrame:
    o = P.table(spark, d, "orders").select(F.col("o_custkey").alias(KEY), "o_orderkey")
    a = o.select(KEY, F.when(F.col(KEY) % 3 == 0, "val").otherwise("train").alias("split")).distinct()
    return stores.split_view(o, a, "val")


COLUMNS = ["l_quantity", "l_discount", "l_tax"]


def _holed(spark: SparkSession, d: str) -> DataFrame:
    return P.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *(F.when(F.col("l_orderkey") % (i + 3) != 0, F.col(c)).alias(c) for i, c in enumerate(COLUMNS)))


_H = "h AS (SELECT l_orderkey, l_linenumber, " + ", ".join(f"CASE WHEN l_orderkey % {i + 3} <> 0 THEN {c} END AS {c}" for i, c in enumerate(COLUMNS)) + " FROM lineitem)"
_FILL = {"mean": "avg({c})", "median": "quantile_cont({c}, 0.5)", "most_frequent": "(SELECT {c} FROM h WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)", "constant": "any_value(7.5::DOUBLE)"}
_SCALE = {
    "minmax": ("min({c})", "max({c}) - min({c})"),
    "standard": ("avg({c})", "stddev_pop({c})"),
    "maxabs": ("0.0::DOUBLE", "max(abs({c}))"),
    "robust": ("quantile_cont({c}, 0.5)", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"),
}


def imputed(strategy: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        rows = _holed(spark, d)
        out = scale.impute(rows, scale.fit_imputer(rows, COLUMNS, strategy, 7.5))
        return out.select("l_orderkey", "l_linenumber", *(F.round(c, 6).alias(c) for c in COLUMNS))

    return query


def scaled(kind: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        rows = P.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *COLUMNS)
        out = scale.scaled(rows, scale.fit_scaler(rows, COLUMNS, kind))
        return out.select("l_orderkey", "l_linenumber", *((F.round(c, 6) + 0.0).alias(c) for c in COLUMNS))

    return query


def fit_on_train(spark: SparkSession, d: str) -> DataFrame:
    rows = _holed(spark, d).withColumnRenamed("l_orderkey", KEY)
    a = rows.select(KEY, F.when(F.col(KEY) % 4 == 0, "test").otherwise("train").alias("split")).distinct()
    imputer, scaler = scale.fit_on_train(rows, a, COLUMNS, "minmax")
    out = scale.transform(rows, imputer, scaler, (0.0, 1.0))
    return out.select(KEY, "l_linenumber", *((F.round(c, 6) + 0.0).alias(c) for c in COLUMNS))


TRAIN_SQL = f"""WITH {_H}, t AS (SELECT * FROM h WHERE l_orderkey % 4 <> 0), m AS (SELECT {", ".join(f"avg({c}) AS m_{c}" for c in COLUMNS)} FROM t),
r AS (SELECT {", ".join(f"min(coalesce({c}, m_{c})) AS lo_{c}, max(coalesce({c}, m_{c})) AS hi_{c}" for c in COLUMNS)} FROM t, m)
SELECT l_orderkey AS SUBJECT_ID, l_linenumber, {", ".join(f"round(greatest(0, least(1, (coalesce({c}, m_{c}) - lo_{c}) / (hi_{c} - lo_{c}))), 6) + 0.0::DOUBLE AS {c}" for c in COLUMNS)} FROM h, m, r"""


def pooled_moments(spark: SparkSession, d: str) -> DataFrame:
    rows = P.table(spark, d, "lineitem")
    states = [scale.moments_of(rows.where(F.col("l_linenumber") % 3 == i), COLUMNS) for i in range(3)]
    return scale.from_moments(scale.merged_moments(*states)).select("name", *(F.round(c, 9).alias(c) for c in ("mean", "std", "lo", "hi")))


_BAD = "bool_or(coalesce(BALANCE < 500, false) OR coalesce(BALANCE >= 6000, false) OR coalesce(PRICE > 480000, false))"
ENTRIES = {
    "d1_d2_ratio_split": (ratio_split, RATIO_SQL),
    "d11_restored_split": (restored, RATIO_SQL),
    "d3_range_filter": (kept(RANGE), f"WITH {_I} SELECT SUBJECT_ID FROM i GROUP BY 1 HAVING NOT {_BAD}"),
    "d3_choice_filter": (kept(CHOICE), f"WITH {_I} SELECT SUBJECT_ID FROM i GROUP BY 1 HAVING NOT bool_or(coalesce(SEGMENT NOT IN ('BUILDING', 'MACHINERY'), true))"),
    "d4_inverted_filter": (kept(RANGE, True), f"WITH {_I} SELECT SUBJECT_ID FROM i GROUP BY 1 HAVING NOT (bool_or(NOT coalesce(BALANCE < 500, false)) AND bool_or(NOT coalesce(BALANCE >= 6000, false)) AND bool_or(NOT coalesce(PRICE > 480000, false)))"),
    "d5_demographic_split": (demographic_split, f"""WITH {_I}, g AS (SELECT SUBJECT_ID, bool_or(coalesce(SEGMENT <> 'BUILDING', true)) AS bt, bool_or(coalesce(PRICE <= 450000, false)) AS bv, bool_or(NOT coalesce(SEGMENT <> 'BUILDING', true)) AS mt, bool_or(NOT coalesce(PRICE <= 450000, false)) AS mv FROM i GROUP BY 1)
      SELECT SUBJECT_ID, 'test' AS split FROM g WHERE NOT bt UNION ALL SELECT SUBJECT_ID, 'val' FROM g WHERE NOT bv UNION ALL SELECT SUBJECT_ID, 'train' FROM g WHERE NOT mt AND NOT mv"""),
    "d6_reduced_to_ratio": (reduced, REDUCED_SQL),
    "d7_d8_validation_and_train_size": (validation, VALIDATION_SQL),
    "d10_train_test_split": (whole_split, f"""WITH {_I}, {_S}, k AS (SELECT * FROM s WHERE SUBJECT_ID IN (SELECT SUBJECT_ID FROM i GROUP BY 1 HAVING NOT {_BAD})), {_nearest("k", 0.2, "te")}
      SELECT SUBJECT_ID, CASE WHEN SUBJECT_ID IN (SELECT SUBJECT_ID FROM te) THEN 'test' ELSE 'train' END AS split FROM k"""),
    "d13_subjects_for_samples": (by_samples, f"WITH s AS (SELECT o_custkey AS SUBJECT_ID, count(*)::DOUBLE AS ratio FROM orders GROUP BY 1), {_nearest('s', 1000, 'te')} SELECT SUBJECT_ID FROM te"),
    "d12_a19_s22_fixed_split": (fixed, "SELECT CASE c_custkey % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS split, count(*) AS n, count(*) / sum(count(*)) OVER () AS ratio FROM customer GROUP BY 1"),
    "s15_j17_split_view": (split_view, "SELECT o_custkey AS SUBJECT_ID, o_orderkey FROM orders WHERE o_custkey % 3 = 0"),
    **{f"e1_imputed_{s}": (imputed(s), f"WITH {_H}, f AS (SELECT {', '.join(f'{x.format(c=c)} AS f_{c}' for c in COLUMNS)}{'' if s == 'most_frequent' else ' FROM h'}) SELECT l_orderkey, l_linenumber, {', '.join(f'round(coalesce({c}, f_{c}), 6) AS {c}' for c in COLUMNS)} FROM h, f") for s, x in _FILL.items()},
    **{f"e{i + 2}_{k}_scaled": (scaled(k), f"WITH f AS (SELECT {', '.join(f'{a.format(c=c)} AS a_{c}, {b.format(c=c)} AS b_{c}' for c in COLUMNS)} FROM lineitem) SELECT l_orderkey, l_linenumber, {', '.join(f'round(({c} - a_{c}) / b_{c}, 6) + 0.0::DOUBLE AS {c}' for c in COLUMNS)} FROM lineitem, f") for i, (k, (a, b)) in enumerate(_SCALE.items())},
    "e6_e8_fit_on_train": (fit_on_train, TRAIN_SQL),
    "r5_pooled_moments": (pooled_moments, " UNION ALL ".join(f"SELECT '{c}' AS name, round(avg({c}), 9) AS mean, round(stddev_pop({c}), 9) AS std, min({c}) AS lo, max({c}) AS hi FROM lineitem" for c in COLUMNS)),
}
