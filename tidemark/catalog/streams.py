"""Queries of models, states and metrics that are kept while a stream goes on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog import proxies as P
from tidemark.catalog.learning import _source
from tidemark.catalog.series import NORMAL, STEP, _imputed_sql
from tidemark.operators import scale
from tidemark.streaming import grids, jobs, online
from tidemark.streaming.rolling import rolling_metrics

#: Days of events that come at a time, and what is to be told of an event: whether its value is above this.
SPAN, HIGH = 4, 15.0
RATE, L2 = 0.5, 0.01
#: Event types that are features; the others are told by the intercept.
TYPES = P.CHANNELS[:4]


def learned(spark: SparkSession, d: str) -> DataFrame:
    """Whether an event's value is high, by its type and hour: each span of days is scored, and then learned, by a query of its own that goes on where the last one ended."""
    folder, e = P.folder(spark), P.events(spark, d)
    hour = (F.hour("CHARTTIME") + F.minute("CHARTTIME") / 60) / 24
    day = F.floor((F.unix_micros("CHARTTIME") - F.unix_micros(P.start())) / 86_400_000_000)
    features = F.array(*((F.col("VARIABLE") == c).cast("double") for c in TYPES), hour)
    rows = e.select("EVENT_ID", features.alias("features"), (F.col("VALUE") > HIGH).cast("int").alias("y"), F.floor(day / SPAN).alias("span"))
    rows.write.partitionBy("span").parquet(f"{folder}/rows")
    held = spark.read.parquet(f"{folder}/rows")
    last = held.agg(F.max("span")).first()[0]
    for span in range((last if last is not None else -1) + 1):
        held.where(F.col("span") == span).drop("span").write.mode("append").parquet(f"{folder}/in")
        stream = jobs.event_stream(spark, f"{folder}/in", held.drop("span").schema, files=1_000_000)
        online.learn(stream, f"{folder}/out", f"{folder}/state", rate=RATE, l2=L2).awaitTermination()
    told = online.progress(spark.read.parquet(f"{folder}/out/scored"))
    return told.select(F.col("batch").cast("long").alias("batch"), "n", *(F.round(c, 8).alias(c) for c in ("log_loss", "brier", "accuracy")))


_X = [f"(event_type = '{c}')::INT::DOUBLE" for c in TYPES] + ["(hour(ts) + minute(ts) / 60.0::DOUBLE) / 24.0::DOUBLE"]
_W = [f"w{i}" for i in range(len(_X))]
#: A batch a step: the weights before it score it, and its mean gradient makes the next ones.
LEARNED_SQL = f"""WITH RECURSIVE r AS (SELECT (epoch_us(ts) - epoch_us(TIMESTAMP '{P.START}')) // {SPAN * 86_400_000_000} AS k, (value > {HIGH})::INT AS y, {", ".join(f"{x} AS x{i}" for i, x in enumerate(_X))} FROM events),
m AS (SELECT 0::BIGINT AS k, 0.0::DOUBLE AS b, {", ".join(f"0.0::DOUBLE AS {w}" for w in _W)}
  UNION ALL SELECT k + 1, b - {RATE} * avg(d), {", ".join(f"{w} - {RATE} * (avg(d * x{i}) + {L2} * {w})" for i, w in enumerate(_W))}
  FROM (SELECT m.*, {", ".join(f"x{i}" for i in range(len(_X)))}, 1 / (1 + exp(-(b + {" + ".join(f"x{i} * {w}" for i, w in enumerate(_W))}))) - y AS d FROM m JOIN r USING (k)) GROUP BY k, b, {", ".join(_W)}),
s AS (SELECT k, y, 1 / (1 + exp(-(b + {" + ".join(f"x{i} * {w}" for i, w in enumerate(_W))}))) AS p FROM m JOIN r USING (k))
SELECT k AS batch, count(*) AS n, round(avg(-CASE WHEN y = 1 THEN ln(p) ELSE ln(1 - p) END), 8) AS log_loss, round(avg(pow(p - y, 2)), 8) AS brier, round(avg(((p > 0.5)::INT = y)::INT), 8) AS accuracy FROM s GROUP BY 1"""

def streamed_grid(spark: SparkSession, d: str) -> DataFrame:
    """The daily grid of all channels, filled from the days before, from files with rows up to eight days out of order; the watermark is ten days behind."""
    folder, e = P.folder(spark), P.events(spark, d)
    day = F.floor((F.unix_micros("CHARTTIME") - F.unix_micros(P.start())) / 86_400_000_000)
    ends = F.timestamp_micros(F.unix_micros("INTIME") + P.STAY_DAYS * 86_400_000_000)
    late = F.crc32(F.col("EVENT_ID").cast("string").cast("binary")) % 5  # by up to four days, in files of four days
    rows = e.select("ICUSTAY_ID", "CHARTTIME", "INTIME", ends.alias("OUTTIME"), "VARIABLE", "VALUE", F.floor((day + late) / 4).alias("file"))
    rows.write.partitionBy("file").parquet(f"{folder}/rows")
    held = spark.read.parquet(f"{folder}/rows")
    last = held.agg(F.max("file"), F.max("CHARTTIME")).first()
    for n in range((last[0] if last[0] is not None else -1) + 1):
        held.where(F.col("file") == n).drop("file").write.mode("append").parquet(f"{folder}/in")
    schema = held.drop("file").schema
    # What comes long after: the watermark passes the last stays' ends.
    after = held.limit(1).select(F.lit(-1).cast("long").alias("ICUSTAY_ID"), *((F.lit(last[1]) + F.expr("INTERVAL 60 DAYS")).alias(c) for c in ("CHARTTIME", "INTIME", "OUTTIME")), F.lit(P.CHANNELS[0]).alias("VARIABLE"), F.lit(None).cast("double").alias("VALUE"))
    spark.createDataFrame(after.collect(), schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    with grids.keyed_state(spark):
        made = grids.filled_grid(jobs.event_stream(spark, f"{folder}/in", schema, files=P.files_a_batch(spark, f"{folder}/in", 8)), P.CHANNELS, [NORMAL[c] for c in P.CHANNELS], "10 days", STEP)
        jobs.append(made, f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.schema(made.schema).parquet(f"{folder}/out").where("ICUSTAY_ID >= 0")


#: Rows of a window, and after how many of them it is told.
SIZE, EVERY = 1000, 100


def rolling(spark: SparkSession, d: str) -> DataFrame:
    """AUC and linear kappa of the last 1 000 events of each type: a score and a class that follow the value, but not always."""
    folder, e = P.folder(spark), P.events(spark, d)
    day = F.floor((F.unix_micros("CHARTTIME") - F.unix_micros(P.start())) / 86_400_000_000)
    cents = F.floor((F.col("VALUE") * 3 + F.col("EVENT_ID") % 50) % 100)
    rows = e.select("VARIABLE", "CHARTTIME", "EVENT_ID", (F.col("VALUE") > HIGH).cast("int").alias("y"), (cents / 100).alias("p"), F.least(F.lit(4), F.floor(F.col("VALUE") / 8)).alias("own"), F.floor(cents / 20).alias("told"), F.floor(day / SPAN).alias("span"))
    rows.write.partitionBy("span").parquet(f"{folder}/rows")
    held = spark.read.parquet(f"{folder}/rows")
    last = held.agg(F.max("span")).first()[0]
    for span in range((last if last is not None else -1) + 1):
        held.where(F.col("span") == span).drop("span").write.mode("append").parquet(f"{folder}/in")
        with grids.keyed_state(spark):
            stream = jobs.event_stream(spark, f"{folder}/in", held.drop("span").schema, files=1_000_000)
            made = rolling_metrics(stream, "VARIABLE", "CHARTTIME", "EVENT_ID", "y", "p", F.col("own"), F.col("told"), SIZE, EVERY, 100, 5, "linear")
            jobs.append(made, f"{folder}/out", f"{folder}/state").awaitTermination()
    told = spark.read.parquet(f"{folder}/out")
    return told.select("VARIABLE", "seen", "n", (F.round("roc_auc", 8) + 0.0).alias("roc_auc"), (F.round("kappa", 8) + 0.0).alias("kappa"))


ROLLING_SQL = f"""WITH r AS (SELECT event_type AS VARIABLE, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i, (value > {HIGH})::INT AS y, floor((value * 3 + event_id % 50) % 100)::INT AS c, least(4, floor(value / 8))::INT AS own FROM events),
w AS (SELECT a.VARIABLE, a.i AS seen, b.y, b.c, b.own, b.c // 20 AS told FROM r a JOIN r b ON a.VARIABLE = b.VARIABLE AND b.i BETWEEN a.i - {SIZE - 1} AND a.i WHERE a.i % {EVERY} = 0),
h AS (SELECT *, sum(neg) OVER (PARTITION BY VARIABLE, seen ORDER BY c) AS cneg FROM (SELECT VARIABLE, seen, c, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM w GROUP BY ALL)),
auc AS (SELECT VARIABLE, seen, sum(pos * (cneg - neg / 2)) / nullif(sum(pos) * sum(neg), 0) AS v FROM h GROUP BY ALL),
o AS (SELECT VARIABLE, seen, count(*) AS n, sum(abs(own - told))::DOUBLE AS o FROM w GROUP BY ALL),
e AS (SELECT VARIABLE, seen, sum(abs(own - told) * a.k * b.k)::DOUBLE AS e FROM (SELECT VARIABLE, seen, own, count(*) AS k FROM w GROUP BY ALL) a JOIN (SELECT VARIABLE, seen, told, count(*) AS k FROM w GROUP BY ALL) b USING (VARIABLE, seen) GROUP BY ALL)
SELECT VARIABLE, seen, n, round(v, 8) + 0.0::DOUBLE AS roc_auc, round(CASE WHEN e = 0 THEN 0 ELSE 1 - o * n / e END, 8) + 0.0::DOUBLE AS kappa FROM o JOIN auc USING (VARIABLE, seen) JOIN e USING (VARIABLE, seen)"""

#: Quantiles that the median imputer and the robust scaler are made from.
SHARES = [0.25, 0.5, 0.75]


def streamed_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Whether the quartiles that sketches tell, kept batch by batch, have a rank within the stated error in the whole table."""
    folder, source = P.folder(spark), _source(spark, d)
    columns = ["VALUE", "hours"]
    jobs.sketch_states(source, columns, f"{folder}/out", f"{folder}/state").awaitTermination()
    told = scale.sketched_quantiles(jobs.merged_sketches(spark, f"{folder}/out"), SHARES)
    told = told.select("name", "n", F.posexplode("q").alias("i", "v"))  # three rows a column
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("x")) for c in columns)))
    rows = P.events(spark, d).select(each.alias("s")).select("s.*").join(F.broadcast(told), "name")
    ranks = rows.groupBy("name", "n", "i").agg(F.count_if(F.col("x") < F.col("v")).alias("below"), F.count_if(F.col("x") <= F.col("v")).alias("upto"))
    share, error = F.element_at(F.array(*map(F.lit, SHARES)), F.col("i") + 1), scale.rank_error()
    within = (F.col("below") / F.col("n") <= share + error) & (F.col("upto") / F.col("n") >= share - error)
    return ranks.select("name", share.alias("share"), "n", within.alias("within"))


ENTRIES = {
    "r5_e5_streamed_quantiles": (streamed_quantiles, f"SELECT name, unnest({SHARES})::DOUBLE AS share, n, true AS within FROM (SELECT 'VALUE' AS name, count(value) AS n FROM events UNION ALL SELECT 'hours', count(ts) FROM events)"),
    "m16_rolling_metrics": (rolling, ROLLING_SQL),
    "r7_r3_streamed_grid": (streamed_grid, f"SELECT * EXCLUDE (SUBJECT_ID) FROM ({_imputed_sql('previous')})"),
    "r6_learned_in_stream": (learned, LEARNED_SQL),
}
