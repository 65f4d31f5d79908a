"""Queries of metrics, models, calibration and streams."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog import proxies as P
from tidemark.functions import codes
from tidemark.operators import metrics, models, multilabel
from tidemark.streaming import jobs


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """Labels with a score from the document's length, coarse enough to tie; split by language."""
    j = P.table(spark, d, "labels").join(P.table(spark, d, "documents").select("doc_id", "n_chars", F.col("lang").alias("split")), "doc_id")
    p = F.floor(F.col("n_chars") % 1000 / 10) / 100
    return j.select("doc_id", "split", F.col("quality").alias("y"), p.alias("p"), (p > 0.4).cast("int").alias("told"), F.array("quality", "toxic").alias("ys"), F.array(p, 1 - p).alias("ps"))


_L = "s AS (SELECT doc_id, lang AS split, quality AS y, toxic, (n_chars % 1000 // 10) / 100::DOUBLE AS p, ((n_chars % 1000 // 10) / 100::DOUBLE > 0.4::DOUBLE)::INT AS told FROM labels JOIN documents USING (doc_id))"


def _classes(spark: SparkSession, d: str) -> DataFrame:
    """True and scored class of each vector: the label, and ten of its components."""
    e = P.table(spark, d, "embeddings")
    return e.select("vec_id", F.col("label").alias("y"), F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double")).alias("ps"), (F.col("vec_id") % 4 != 0).alias("known")).withColumn("p", codes.arg_max(F.col("ps")))


_C = "c AS (SELECT *, list_position(ps, list_max(ps)) - 1 AS p FROM (SELECT vec_id, label AS y, embedding[1:10] AS ps, vec_id % 4 <> 0 AS known FROM embeddings))"


def _durations(spark: SparkSession, d: str) -> DataFrame:
    li = P.table(spark, d, "lineitem").join(P.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    h = codes.hours_between(F.col("o_orderdate").cast("timestamp"), F.col("l_shipdate").cast("timestamp"))
    return li.select("l_orderkey", F.col("l_returnflag").alias("split"), h.alias("y"), (F.col("l_quantity") * 24).alias("p")).where("y > 0")


_DU = "u AS (SELECT * FROM (SELECT l_orderkey, l_returnflag AS split, (epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 3.6e9 AS y, l_quantity * 24 AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey) WHERE y > 0)"


def rounded(df: DataFrame, *names: str, n: int = 8) -> DataFrame:
    return df.select(*((F.round(c, n) + 0.0).alias(c) if c in names else F.col(c) for c in df.columns))


def confusion(spark, d):
    return metrics.confusion(_classes(spark, d), "y", "p")


def binary(spark, d):
    return rounded(metrics.binary(_scored(spark, d), "y", "told", ["split"]), "accuracy", "precision", "recall", "f1")


def report(spark, d):
    return rounded(metrics.report(_classes(spark, d), "y", "p"), "precision", "recall", "f1")


def los_report(spark, d):
    u = _durations(spark, d).select("split", codes.custom_bin(F.col("y")).alias("y"), codes.custom_bin(F.col("p")).alias("p"))
    return rounded(metrics.report(u, "y", "p"), "precision", "recall", "f1")


def kappa(spark, d):
    c = _classes(spark, d)
    out = None
    for w in (None, "linear", "quadratic"):
        one = metrics.kappa(c, "y", "p", w, mask="known").withColumn("weights", F.lit(w or "none"))
        out = one if out is None else out.unionByName(one)
    return rounded(out, "kappa")


def los_kappa(spark, d):
    u = _durations(spark, d).select("split", codes.custom_bin(F.col("y")).alias("y"), codes.custom_bin(F.col("p")).alias("p"))
    return rounded(metrics.kappa(u, "y", "p", "linear", ["split"]), "kappa")


def roc_auc(spark, d):
    return rounded(metrics.roc_auc(_scored(spark, d), "y", "p", ["split"]), "roc_auc")


def cut_aucs(spark, d):
    s = _scored(spark, d)
    a, b = metrics.roc_auc_cuts(s, "y", "p", 20, ["split"]), metrics.pr_auc(s, "y", "p", 20, ["split"])
    return rounded(a.join(b, "split"), "roc_auc", "pr_auc")


def average_precision(spark, d):
    return rounded(metrics.average_precision(_scored(spark, d), "y", "p", ["split"]), "average_precision")


def over_labels(spark, d):
    s = _scored(spark, d)
    out = None
    for how in ("micro", "macro"):
        one = metrics.over_labels(metrics.roc_auc, s, "ys", "ps", how, "roc_auc").withColumn("average", F.lit(how))
        out = one if out is None else out.unionByName(one)
    return rounded(out, "roc_auc")


def one_against_all(spark, d):
    return rounded(metrics.over_labels(metrics.roc_auc, _classes(spark, d), "y", "ps", None, "roc_auc"), "roc_auc")


def regression(spark, d):
    return rounded(metrics.regression(_durations(spark, d), "y", "p", ["split"]), "mae", "mse", "rmse", "r2", "mape", "smape", n=5)


def losses(spark, d):
    return rounded(metrics.losses(_scored(spark, d), "y", "p"), "log_loss", "hinge", "squared_hinge", "msle", "huber", "log_cosh", "cosine")


def binned(spark, d):
    return rounded(metrics.binned_mae(_classes(spark, d), "y", "ps", mask="known"), "mae", "mse", n=5)


def top_k(spark, d):
    return rounded(metrics.top_k(_classes(spark, d), "y", "ps", 3), "top_k")


def operating_point(spark, d):
    s = _scored(spark, d)
    return rounded(metrics.at_operating_point(s, "y", "p", 0.5, "sensitivity", 50).crossJoin(F.broadcast(metrics.at_operating_point(s, "y", "p", 0.5, "specificity", 50))), "specificity", "sensitivity")  # one row each


def calibration(spark, d):
    return rounded(metrics.calibration(_scored(spark, d), "y", "p", 10, ["split"]), "confidence", "share")


def calibration_error(spark, d):
    return rounded(metrics.calibration_error(_scored(spark, d), "y", "p", 10, ["split"]), "ece")


def drift(spark, d):
    s = _scored(spark, d).withColumn("split", F.when(F.col("split") == "en", "train").when(F.col("split") == "fr", "val").otherwise("test"))
    return rounded(metrics.drift_report(metrics.roc_auc(s, "y", "p", ["split"]), "roc_auc"), "train", "val", "test", "drift")


def windowed(spark, d):
    e = P.events(spark, d).select(F.col("CHARTTIME"), F.col("VALUE").alias("y"), F.lit(20.0).alias("p"))
    out = jobs.windowed_errors(e, "CHARTTIME", "1 day")
    return rounded(out.select(F.round(codes.hours_between(P.start(), F.col("start")) / 24).cast("long").alias("day"), "n", "mae"), "mae", n=6)


#: The features: all components of the given vectors.
DIMS = 64


def _model_rows(spark: SparkSession, d: str) -> DataFrame:
    e = P.table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("SUBJECT_ID"), (F.col("label") < 4).cast("int").alias("y"), F.transform("embedding", lambda v: v.cast("double")).alias("x"))


_X = [f"x{i}" for i in range(DIMS)]


def _assignment(rows: DataFrame) -> DataFrame:
    return rows.select("SUBJECT_ID", F.when(F.col("SUBJECT_ID") % 5 == 0, "test").when(F.col("SUBJECT_ID") % 5 == 1, "val").otherwise("train").alias("split"))


def pipeline(kind: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        rows = _model_rows(spark, d)
        out = models.fit_and_test(rows, _assignment(rows), "x", kind)
        return rounded(out, "roc_auc") if "roc_auc" in out.columns else out

    return query


def multi_output(spark: SparkSession, d: str) -> DataFrame:
    """Two labels fitted together, the second of which is the sign of a component that is no feature of theirs."""
    rows = _model_rows(spark, d).select(F.slice("x", 2, DIMS - 1).alias("features"), "y", (F.col("x")[0] > 0).cast("int").alias("z")).persist()
    try:
        fitted = multilabel.fit_labels(rows, ["y", "z"])
    finally:
        rows.unpersist()
    told = rows.withColumn("ps", fitted.scores()).withColumn("ys", F.array("y", "z"))
    return rounded(metrics.over_labels(metrics.roc_auc, told, "ys", "ps", None, "roc_auc").select(F.element_at(F.array(*map(F.lit, fitted.labels)), F.col("label") + 1).alias("label"), "roc_auc"), "roc_auc", n=5)


def across_sources(spark: SparkSession, d: str) -> DataFrame:
    """Two sources of vectors, by naive Bayes: fitted on one, judged on its own held-out rows and on the other, and what that costs."""
    rows = _model_rows(spark, d).withColumn("source", F.when(F.col("SUBJECT_ID") % 3 == 0, "a").otherwise("b"))
    told = models.across_sources(rows, "source", "x", "naive_bayes")
    of = lambda s: F.max(F.when(F.col("split") == s, F.col("roc_auc")))
    return rounded(told.groupBy("source").agg(of("train").alias("train"), of("own").alias("own"), of("other").alias("other"), (of("own") - of("other")).alias("delta")), "train", "own", "other", "delta", n=6)


def penalised(spark: SparkSession, d: str) -> DataFrame:
    rows = _model_rows(spark, d).select("y", F.col("y").cast("double").alias("label"), array_to_vector("x").alias("features"))
    return metrics.roc_auc(models.predictions(models.logistic(rows, c=0.1, l1=True), rows), "y", "p")


def nearest(spark: SparkSession, d: str) -> DataFrame:
    """Queries are the rows whose id is divisible by 100, against all rows."""
    rows = _model_rows(spark, d).select("SUBJECT_ID", F.col("y").alias("label"), "x")
    return models.neighbours(rows, rows.where("SUBJECT_ID % 100 = 0"), 5, "SUBJECT_ID").select("SUBJECT_ID", F.round("p", 6).alias("p"))


def line(spark: SparkSession, d: str) -> DataFrame:
    """Hours to delivery by the quantity alone, fitted on train and judged on each split."""
    rows = _durations(spark, d).withColumnRenamed("split", "flag").withColumn("split", F.when(F.col("l_orderkey") % 5 == 0, "test").otherwise("train"))
    folder = P.folder(spark)
    rows.select("split", "y", F.col("p").alias("q")).write.parquet(folder)  # joined once, not in each pass of the fit
    ready = models.assembled(spark.read.parquet(folder), ["q"])
    told = models.predictions(models.linear(ready.where("split = 'train'")), ready)
    return rounded(metrics.regression(told, "label", "p", ["split"]).select("split", "mae", "mse", "r2"), "mae", "mse", "r2", n=4)


def recalibrated(method: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        s = _scored(spark, d)
        return rounded(metrics.calibration_error(models.calibrated(s, s.where("doc_id % 2 = 0"), method), "y", "p"), "ece")

    return query


def _source(spark: SparkSession, d: str, closed: bool = False) -> DataFrame:
    """The events as a stream over copies of the table in several files, in the order of time; with closed, a row of no stay (-1) comes 60 days later, so that the watermark passes all others."""
    folder = P.folder(spark)
    e = P.events(spark, d).select("SUBJECT_ID", "ICUSTAY_ID", "EVENT_ID", "CHARTTIME", "INTIME", "hours", "VARIABLE", "VALUE")
    day = codes.hours_between(P.start(), F.col("CHARTTIME")) / 24
    for first in range(0, 32, 8):  # a stay's rows of a span are in one file, and later spans in later files
        span = e.where((day >= first) & ((day < first + 8) if first < 24 else F.lit(True)))
        span.repartition("ICUSTAY_ID").write.mode("append").parquet(f"{folder}/in")
    if closed:
        later = lambda c: (F.max(c) + F.expr("INTERVAL 60 DAYS")).alias(c)
        last = e.agg(later("CHARTTIME"), later("INTIME")).where("CHARTTIME IS NOT NULL")
        last.select(*(F.col(c) if c in ("CHARTTIME", "INTIME") else F.lit(-1 if c == "ICUSTAY_ID" else None).cast(t).alias(c) for c, t in e.dtypes)).write.mode("append").parquet(f"{folder}/in")
    return jobs.event_stream(spark, f"{folder}/in", e.schema, files=P.files_a_batch(spark, f"{folder}/in", 2))


def ingested(spark: SparkSession, d: str) -> DataFrame:
    """Events that pass stay recovery as a stream; run twice, the second time with nothing new."""
    folder = P.folder(spark)
    stream = _source(spark, d).select("ICUSTAY_ID", F.col("ICUSTAY_ID").alias("HADM_ID"), "EVENT_ID", F.col("VALUE").cast("string").alias("VALUE"))
    stays = P.episodic(spark, d).where("MORTALITY = 1").select(F.col("ICUSTAY_ID").alias("HADM_ID"), "ICUSTAY_ID")
    for _ in range(2):
        jobs.append(jobs.recovered(stream, stays), f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("ICUSTAY_ID", "EVENT_ID", F.col("VALUE").cast("double").alias("VALUE"))


def streamed_bins(spark: SparkSession, d: str) -> DataFrame:
    """Daily bins of the stream, each given out once the watermark has passed it; files hold eight days."""
    folder, source = P.folder(spark), _source(spark, d, closed=True)
    P.episodic(spark, d).select("ICUSTAY_ID", "INTIME").write.parquet(f"{folder}/stays")  # each batch reads them
    stays = spark.read.parquet(f"{folder}/stays")
    none = stays.agg(F.lit(-1).cast("long").alias("ICUSTAY_ID"), (F.max("INTIME") + F.expr("INTERVAL 60 DAYS")).alias("INTIME"))
    binned = jobs.hourly_bins(source.drop("INTIME"), stays.unionByName(none), 24.0, "12 days")
    jobs.append(binned, f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.schema(binned.schema).parquet(f"{folder}/out").where("ICUSTAY_ID >= 0").select("ICUSTAY_ID", "VARIABLE", "bins", "VALUE")


def streamed_scaler(spark: SparkSession, d: str) -> DataFrame:
    folder = P.folder(spark)
    jobs.scaler_states(_source(spark, d), ["VALUE"], f"{folder}/out", f"{folder}/state").awaitTermination()
    return jobs.merged_states(spark, f"{folder}/out").select("name", *(F.round(c, 6).alias(c) for c in ("mean", "std", "lo", "hi")))


def streamed_errors(spark: SparkSession, d: str) -> DataFrame:
    folder = P.folder(spark)
    rows = _source(spark, d).select(F.col("VARIABLE").alias("split"), F.col("VALUE").alias("y"), F.lit(20.0).alias("p"))
    query = jobs.running_errors(rows).writeStream.outputMode("complete").foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/out"))
    query.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("split", "n", F.round("mae", 6).alias("mae"), F.round("mse", 4).alias("mse"))


def streamed_fill(spark: SparkSession, d: str) -> DataFrame:
    folder = P.folder(spark)
    rows = _source(spark, d).select("ICUSTAY_ID", "hours", F.when(F.col("VARIABLE") == "click", F.col("VALUE")).alias("v"))
    query = jobs.forward_filled(rows).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
    query.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


_NEAR = "sum(pos * (cneg - neg / 2)) / (sum(pos) * sum(neg))"


def _auc(rows: str, by: str) -> str:
    part = f"PARTITION BY {by} " if by else ""
    lead = f"{by}, " if by else ""
    return f"SELECT {lead}round({_NEAR}, 8) + 0.0::DOUBLE AS roc_auc FROM (SELECT *, sum(neg) OVER ({part}ORDER BY p) AS cneg FROM (SELECT {lead}p, sum((y = 1)::INT)::DOUBLE AS pos, sum((y <> 1)::INT)::DOUBLE AS neg FROM {rows} GROUP BY ALL)) {f'GROUP BY {by}' if by else ''}"


def _curve(rows: str, n: int, by: str) -> str:
    cuts = ", ".join(f"{c!r}::DOUBLE" for c in metrics.cuts(n))
    return f"SELECT {by}{',' if by else ''} cut, sum((y = 1 AND p > cut)::INT)::DOUBLE AS tp, sum((y <> 1 AND p > cut)::INT)::DOUBLE AS fp, sum((y = 1)::INT)::DOUBLE AS pos, sum((y <> 1)::INT)::DOUBLE AS neg FROM {rows}, (SELECT unnest([{cuts}]) AS cut) GROUP BY ALL"


_REPORT = """n AS (SELECT y, p, count(*)::DOUBLE AS n FROM {src} GROUP BY ALL),
k AS (SELECT class, sum(su) AS support, sum(tl) AS told, sum(tp) AS tp FROM (SELECT y::VARCHAR AS class, n AS su, 0 AS tl, CASE WHEN y = p THEN n ELSE 0 END AS tp FROM n UNION ALL SELECT p::VARCHAR, 0, n, 0 FROM n) GROUP BY 1),
q AS (SELECT class, coalesce(tp / nullif(told, 0), 0) AS pr, coalesce(tp / nullif(support, 0), 0) AS re, coalesce(2 * tp / nullif(told + support, 0), 0) AS f, support::DOUBLE AS support, told, tp FROM k)
SELECT class, round(pr, 8) AS precision, round(re, 8) AS recall, round(f, 8) AS f1, support FROM q
UNION ALL SELECT 'micro', round(sum(tp) / sum(told), 8), round(sum(tp) / sum(support), 8), round(2 * sum(tp) / (sum(told) + sum(support)), 8), sum(support) FROM q
UNION ALL SELECT 'macro', round(avg(pr), 8), round(avg(re), 8), round(avg(f), 8), sum(support) FROM q
UNION ALL SELECT 'weighted', round(sum(pr * support) / sum(support), 8), round(sum(re * support) / sum(support), 8), round(sum(f * support) / sum(support), 8), sum(support) FROM q"""
_BINS = f"len([b FOR b IN {[24 * x for x in codes.LOS_DAYS]} IF b <= {{c}}])"
_BU = f"bu AS (SELECT split, {_BINS.format(c='y')} AS y, {_BINS.format(c='p')} AS p FROM u)"


def _kappa(rows: str, weight: str, by: str = "") -> str:
    lead = f"{by}, " if by else ""
    using = f"USING ({by})" if by else "ON true"
    return f"""SELECT {'o.' + lead if by else ''}round(1 - o.o * o.n / e.e, 8) + 0.0::DOUBLE AS kappa FROM (SELECT {lead}sum({weight})::DOUBLE AS o, count(*)::DOUBLE AS n FROM {rows} GROUP BY ALL) o JOIN
  (SELECT {lead}sum({weight} * r * c)::DOUBLE AS e FROM (SELECT {lead}y, count(*) AS r FROM {rows} GROUP BY ALL) JOIN (SELECT {lead}p, count(*) AS c FROM {rows} GROUP BY ALL) {using} GROUP BY ALL) e {using}"""


_ROWS = "r AS (SELECT vec_id AS SUBJECT_ID, (label < 4)::INT AS y, " + ", ".join(f"embedding[{i + 1}]::DOUBLE AS x{i}" for i in range(DIMS)) + ", CASE vec_id % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS split FROM embeddings)"
#: Gaussian naive Bayes: class 1 against class 0 in log odds, which order as the scores do.
_BAYES = f"""WITH {_ROWS}, t AS (SELECT y AS c, count(*) AS n, {", ".join(f"avg({x}) AS m_{x}, var_pop({x}) AS v_{x}" for x in _X)} FROM r WHERE split = 'train' GROUP BY 1),
b AS (SELECT SUBJECT_ID, split, y, c, ln(n) - 0.5 * ({" + ".join(f"ln(v_{x}) + pow({x} - m_{x}, 2) / v_{x}" for x in _X)}) AS l FROM r, t),
s AS (SELECT split, y, sum(CASE c WHEN 1 THEN l ELSE -l END) AS p FROM b GROUP BY SUBJECT_ID, split, y)"""
#: The same for each of two sources, of which every fifth row is not learned from.
_ACROSS_SQL = f"""WITH {_ROWS}, q AS (SELECT * EXCLUDE (split), CASE WHEN SUBJECT_ID % 3 = 0 THEN 'a' ELSE 'b' END AS source, ('0x' || substr(md5('42|' || SUBJECT_ID), 1, 7))::BIGINT % 5 = 0 AS held FROM r),
g AS (SELECT g.source, q.* EXCLUDE (source, held), CASE WHEN q.source <> g.source THEN 'other' WHEN held THEN 'own' ELSE 'train' END AS split FROM q, (SELECT unnest(['a', 'b']) AS source) g),
t AS (SELECT source, y AS c, count(*) AS n, {", ".join(f"avg({x}) AS m_{x}, var_pop({x}) AS v_{x}" for x in _X)} FROM g WHERE split = 'train' GROUP BY ALL),
b AS (SELECT SUBJECT_ID, g.source, split, y, c, ln(n) - 0.5 * ({" + ".join(f"ln(v_{x}) + pow({x} - m_{x}, 2) / v_{x}" for x in _X)}) AS l FROM g JOIN t USING (source)),
s AS (SELECT source, split, y, sum(CASE c WHEN 1 THEN l ELSE -l END) AS p FROM b GROUP BY SUBJECT_ID, source, split, y),
a AS (SELECT source, split, {_NEAR} AS v FROM (SELECT *, sum(neg) OVER (PARTITION BY source, split ORDER BY p) AS cneg FROM (SELECT source, split, p, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM s GROUP BY ALL)) GROUP BY ALL)
SELECT source, {", ".join(f"round(max(v) FILTER (split = '{n}'), 6) AS {n}" for n in ("train", "own", "other"))}, round(max(v) FILTER (split = 'own') - max(v) FILTER (split = 'other'), 6) + 0.0::DOUBLE AS delta FROM a GROUP BY 1"""
#: Isotonic regression in closed form: at a score, the largest over the starts before it of the least mean over the ends after it; between two scores a line.
_ISOTONIC_SQL = f"""WITH {_L}, g AS (SELECT *, sum(n) OVER w AS cn, sum(v) OVER w AS cv FROM (SELECT p, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS v FROM s WHERE doc_id % 2 = 0 GROUP BY 1) WINDOW w AS (ORDER BY p)),
m AS (SELECT a.p AS a, b.p AS b, (b.cv - a.cv + a.v) / (b.cn - a.cn + a.n) AS mean FROM g a JOIN g b ON a.p <= b.p),
f AS (SELECT p, max(low) AS f FROM (SELECT g.p, m.a, min(m.mean) AS low FROM g JOIN m ON m.a <= g.p AND m.b >= g.p GROUP BY ALL) GROUP BY 1),
q AS (SELECT DISTINCT p AS x FROM s), nb AS (SELECT x, max(p) FILTER (p <= x) AS lo, min(p) FILTER (p >= x) AS hi FROM q, f GROUP BY 1),
t AS (SELECT x, CASE WHEN lo IS NULL THEN h.f WHEN hi IS NULL OR lo = hi THEN l.f ELSE l.f + (h.f - l.f) * (x - lo) / (hi - lo) END AS f FROM nb LEFT JOIN f l ON l.p = lo LEFT JOIN f h ON h.p = hi),
c AS (SELECT y, f AS p FROM s JOIN t ON x = s.p), b AS (SELECT least(9, floor(p * 10)) AS bin, count(*) AS n, avg(p) AS c, avg(y) AS a FROM c GROUP BY 1)
SELECT round(sum(abs(c - a) * n) / sum(n), 8) AS ece FROM b"""
_RATE = "CASE WHEN {b} = 0 THEN CASE WHEN {a} = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ELSE {a} / {b} END"
_M = [f"{m}::DOUBLE" for m in codes.LOS_MEANS]

ENTRIES = {
    "m1_confusion": (confusion, f"WITH {_C} SELECT y, p, count(*)::DOUBLE AS n FROM c GROUP BY ALL"),
    "m2_m17_binary": (binary, f"""WITH {_L} SELECT split, round(avg((y = told)::INT), 8) AS accuracy, round(coalesce(sum((y = 1 AND told = 1)::INT) / nullif(sum(told), 0), 0), 8) AS precision,
      round(coalesce(sum((y = 1 AND told = 1)::INT) / nullif(sum(y), 0), 0), 8) AS recall, round(coalesce(2 * sum((y = 1 AND told = 1)::INT) / nullif(sum(y) + sum(told), 0), 0), 8) AS f1 FROM s GROUP BY 1"""),
    "m3_report": (report, f"WITH {_C}, {_REPORT.format(src='c')}"),
    "m3_los_report": (los_report, f"WITH {_DU}, {_BU}, {_REPORT.format(src='bu')}"),
    "m5_kappa_masked": (kappa, f"WITH {_C}, ck AS (SELECT y, p FROM c WHERE known) " + " UNION ALL ".join(f"SELECT kappa, '{n}' AS weights FROM ({_kappa('ck', w)})" for n, w in (("none", "(y <> p)::INT"), ("linear", "abs(y - p)"), ("quadratic", "(y - p) * (y - p)")))),
    "m4_los_kappa": (los_kappa, f"WITH {_DU}, {_BU} {_kappa('bu', 'abs(y - p)', 'split')}"),
    "m6_m17_roc_auc": (roc_auc, f"WITH {_L} {_auc('s', 'split')}"),
    "m6_m7_auc_by_cuts": (cut_aucs, f"""WITH {_L}, cv AS ({_curve('s', 20, 'split')}), r AS (SELECT split, cut, {_RATE.format(a='fp', b='neg')} AS fpr, {_RATE.format(a='tp', b='pos')} AS tpr, {_RATE.format(a='tp', b='(tp + fp)')} AS pre FROM cv),
      z AS (SELECT *, lag(fpr) OVER w AS f0, lag(tpr) OVER w AS t0, lag(pre) OVER w AS p0 FROM r WINDOW w AS (PARTITION BY split ORDER BY cut))
      SELECT split, round(sum((f0 - fpr) * (t0 + tpr) / 2), 8) AS roc_auc, round(sum((t0 - tpr) * (p0 + pre) / 2), 8) AS pr_auc FROM z WHERE f0 IS NOT NULL GROUP BY 1"""),
    "m8_average_precision": (average_precision, f"""WITH {_L}, g AS (SELECT split, p, sum(y)::DOUBLE AS pos, count(*)::DOUBLE AS n FROM s GROUP BY ALL), w AS (SELECT *, sum(pos) OVER k AS cp, sum(n) OVER k AS cn FROM g WINDOW k AS (PARTITION BY split ORDER BY p DESC))
      SELECT split, round(sum(cp / cn * pos) / sum(pos), 8) AS average_precision FROM w GROUP BY 1"""),
    "m9_m10_m11_auc_over_labels": (over_labels, f"""WITH {_L}, l AS (SELECT 0 AS label, y, p FROM s UNION ALL SELECT 1, toxic, 1 - p FROM s), a AS ({_auc('l', 'label')})
      SELECT round(avg(x.v), 8) AS roc_auc, 'macro' AS average FROM (SELECT {_NEAR} AS v FROM (SELECT *, sum(neg) OVER (PARTITION BY label ORDER BY p) AS cneg FROM (SELECT label, p, sum((y = 1)::INT)::DOUBLE AS pos, sum((y <> 1)::INT)::DOUBLE AS neg FROM l GROUP BY ALL)) GROUP BY label) x
      UNION ALL SELECT *, 'micro' FROM ({_auc('l', '')})"""),
    "m9_auc_one_against_all": (one_against_all, f"WITH {_C}, l AS (SELECT i::INT AS label, (y = i)::INT AS y, ps[i + 1]::DOUBLE AS p FROM c, (SELECT unnest(range(0, 10)) AS i)) {_auc('l', 'label')}"),
    "m12_regression": (regression, f"""WITH {_DU} SELECT split, round(avg(abs(y - p)), 5) AS mae, round(avg(pow(y - p, 2)), 5) AS mse, round(sqrt(avg(pow(y - p, 2))), 5) AS rmse, round(1 - avg(pow(y - p, 2)) / var_pop(y), 5) AS r2,
      round(100 * avg(abs(y - p) / y), 5) AS mape, round(100 * avg(2 * abs(y - p) / (y + p)), 5) AS smape FROM u GROUP BY 1"""),
    "m14_losses": (losses, f"""WITH {_L}, z AS (SELECT *, greatest(1e-15::DOUBLE, least(1 - 1e-15::DOUBLE, p)) AS q, greatest(0, 1 - (2 * y - 1) * p) AS h, abs(y - p) AS d FROM s)
      SELECT round(avg(-(y * ln(q) + (1 - y) * ln(1 - q))), 8) AS log_loss, round(avg(h), 8) AS hinge, round(avg(h * h), 8) AS squared_hinge, round(avg(pow(ln(1 + y) - ln(1 + p), 2)), 8) AS msle, round(avg(d * d / 2), 8) AS huber,
      round(avg(ln(cosh(d))), 8) AS log_cosh, round(sum(y * p) / (sqrt(sum(y * y)) * sqrt(sum(p * p))), 8) AS cosine FROM z"""),
    "m13_m15_binned_mae": (binned, f"WITH {_C}, z AS (SELECT [{', '.join(_M)}][y + 1] - [{', '.join(_M)}][p + 1] AS d FROM c WHERE known) SELECT round(avg(abs(d)), 5) AS mae, round(avg(d * d), 5) AS mse FROM z"),
    "m14_top_k": (top_k, f"WITH {_C} SELECT round(avg((len([x FOR x, i IN ps IF x > ps[y + 1] OR (x = ps[y + 1] AND i < y + 1)]) < 3)::INT), 8) AS top_k FROM c"),
    "m14_operating_point": (operating_point, f"""WITH {_L}, cv AS ({_curve('s', 50, '')}), r AS (SELECT tp / pos AS se, 1 - fp / neg AS sp FROM cv)
      SELECT round(max(sp) FILTER (se >= 0.5), 8) AS specificity, round(max(se) FILTER (sp >= 0.5), 8) AS sensitivity FROM r"""),
    "m18_reliability": (calibration, f"WITH {_L} SELECT split, least(9, floor(p * 10))::INT AS bin, count(*) AS n, round(avg(p), 8) AS confidence, round(avg(y), 8) AS share FROM s GROUP BY ALL"),
    "m18_calibration_error": (calibration_error, f"WITH {_L}, b AS (SELECT split, least(9, floor(p * 10)) AS bin, count(*) AS n, avg(p) AS c, avg(y) AS a FROM s GROUP BY ALL) SELECT split, round(sum(abs(c - a) * n) / sum(n), 8) AS ece FROM b GROUP BY 1"),
    "m19_d14_drift": (drift, f"""WITH {_L}, t AS (SELECT CASE split WHEN 'en' THEN 'train' WHEN 'fr' THEN 'val' ELSE 'test' END AS split, y, p FROM s),
      a AS (SELECT split, {_NEAR} AS v FROM (SELECT *, sum(neg) OVER (PARTITION BY split ORDER BY p) AS cneg FROM (SELECT split, p, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM t GROUP BY ALL)) GROUP BY 1)
      SELECT round(max(v) FILTER (split = 'train'), 8) AS train, round(max(v) FILTER (split = 'val'), 8) AS val, round(max(v) FILTER (split = 'test'), 8) AS test, round(max(v) FILTER (split = 'train') - max(v) FILTER (split = 'test'), 8) + 0.0::DOUBLE AS drift FROM a"""),
    "d14_across_sources": (across_sources, _ACROSS_SQL),
    "m16_windowed_errors": (windowed, f"SELECT (epoch_us(ts) - epoch_us(TIMESTAMP '{P.START}')) // 86400000000 AS day, count(*) AS n, round(avg(abs(value - 20)), 6) AS mae FROM events GROUP BY 1"),
    "g1_g8_logistic_pipeline": (pipeline("logistic"), None),
    "g3_linear_pipeline": (pipeline("linear"), None),
    "g3_line": (line, f"""WITH {_DU}, z AS (SELECT y, p, CASE l_orderkey % 5 WHEN 0 THEN 'test' ELSE 'train' END AS split FROM u), f AS (SELECT regr_slope(y, p) AS a, regr_intercept(y, p) AS b FROM z WHERE split = 'train'),
      t AS (SELECT split, y, a * p + b AS p FROM z, f) SELECT split, round(avg(abs(y - p)), 4) AS mae, round(avg(pow(y - p, 2)), 4) AS mse, round(1 - avg(pow(y - p, 2)) / var_pop(y), 4) + 0.0::DOUBLE AS r2 FROM t GROUP BY 1"""),
    "g4_naive_bayes_pipeline": (pipeline("naive_bayes"), f"{_BAYES} {_auc('s', 'split')}"),
    "g6_tree_pipeline": (pipeline("tree"), None),
    "g6_forest_pipeline": (pipeline("forest"), None),
    "g2_multi_output": (multi_output, None),
    "g5_neighbours": (nearest, f"""WITH {_ROWS}, p AS (SELECT a.SUBJECT_ID, b.y, row_number() OVER (PARTITION BY a.SUBJECT_ID ORDER BY {" + ".join(f"pow(a.{x} - b.{x}, 2)" for x in _X)}, b.SUBJECT_ID) AS i
      FROM r a JOIN r b ON a.SUBJECT_ID <> b.SUBJECT_ID WHERE a.SUBJECT_ID % 100 = 0) SELECT SUBJECT_ID, round(avg(y), 6) AS p FROM p WHERE i <= 5 GROUP BY 1"""),
    "g9_penalised": (penalised, None),
    "g7_calibrated_isotonic": (recalibrated("isotonic"), _ISOTONIC_SQL),
    **{f"g7_calibrated_{m}": (recalibrated(m), None) for m in ("logistic", "temperature", "beta")},
    "g7_calibrated_histogram": (recalibrated("histogram"), f"""WITH {_L}, h AS (SELECT least(9, floor(p * 10)) AS bin, avg(y) AS share FROM s WHERE doc_id % 2 = 0 GROUP BY 1), c AS (SELECT y, coalesce(share, p) AS p FROM s LEFT JOIN h ON bin = least(9, floor(p * 10))),
      b AS (SELECT least(9, floor(p * 10)) AS bin, count(*) AS n, avg(p) AS c, avg(y) AS a FROM c GROUP BY 1) SELECT round(sum(abs(c - a) * n) / sum(n), 8) AS ece FROM b"""),
    "s8_r1_r2_ingested": (ingested, f"WITH {P.E_SQL} SELECT ICUSTAY_ID, EVENT_ID, VALUE FROM e WHERE SUBJECT_ID % 3 = 0"),
    "r3_streamed_bins": (streamed_bins, f"WITH {P.E_SQL} SELECT ICUSTAY_ID, VARIABLE, trunc(hours / 24 - 1e-6::DOUBLE)::INT AS bins, arg_max(VALUE, hours) AS VALUE FROM e GROUP BY ALL"),
    "r5_streamed_scaler": (streamed_scaler, "SELECT 'VALUE' AS name, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS lo, max(value) AS hi FROM events"),
    "r6_streamed_errors": (streamed_errors, "SELECT event_type AS split, count(*) AS n, round(avg(abs(value - 20)), 6) AS mae, round(avg(pow(value - 20, 2)), 4) AS mse FROM events GROUP BY 1"),
    "r7_streamed_fill": (streamed_fill, f"WITH {P.E_SQL} SELECT ICUSTAY_ID, hours, last_value(CASE WHEN VARIABLE = 'click' THEN VALUE END IGNORE NULLS) OVER (PARTITION BY ICUSTAY_ID ORDER BY hours ROWS UNBOUNDED PRECEDING) AS v FROM e"),
}
