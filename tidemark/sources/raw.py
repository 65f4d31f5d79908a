"""Scans of the raw clinical tables, with declared schemas and strict nulls (only the empty field)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns that the engine reads, by table; 'time' columns are parsed leniently or strictly, see read_table.
SCHEMAS: dict[str, dict[str, str]] = {
    "PATIENTS": {"SUBJECT_ID": "int", "GENDER": "string", "DOB": "time", "DOD": "time"},
    "ADMISSIONS": {
        "SUBJECT_ID": "int", "HADM_ID": "int", "ADMITTIME": "time", "DISCHTIME": "time", "DEATHTIME": "time", "ETHNICITY": "string", "DIAGNOSIS": "string",
        "ADMISSION_TYPE": "string", "ADMISSION_LOCATION": "string", "DISCHARGE_LOCATION": "string", "INSURANCE": "string", "LANGUAGE": "string",
    },
    "ICUSTAYS": {
        "SUBJECT_ID": "int", "HADM_ID": "int", "ICUSTAY_ID": "int", "DBSOURCE": "string", "FIRST_CAREUNIT": "string", "LAST_CAREUNIT": "string",
        "FIRST_WARDID": "int", "LAST_WARDID": "int", "INTIME": "time", "OUTTIME": "time", "LOS": "double",
    },
    "D_ICD_DIAGNOSES": {"ICD9_CODE": "string", "SHORT_TITLE": "string", "LONG_TITLE": "string"},
    "D_ITEMS": {"ITEMID": "int", "DBSOURCE": "string"},
    "DIAGNOSES_ICD": {"SUBJECT_ID": "int", "HADM_ID": "int", "SEQ_NUM": "int", "ICD9_CODE": "string"},
    "CHARTEVENTS": {"SUBJECT_ID": "int", "HADM_ID": "int", "ICUSTAY_ID": "int", "CHARTTIME": "time", "ITEMID": "int", "VALUE": "string", "VALUEUOM": "string"},
}
SCHEMAS["OUTPUTEVENTS"] = SCHEMAS["CHARTEVENTS"]
SCHEMAS["LABEVENTS"] = {k: v for k, v in SCHEMAS["CHARTEVENTS"].items() if k != "ICUSTAY_ID"}
EVENT_TABLES = ("CHARTEVENTS", "LABEVENTS", "OUTPUTEVENTS")
EVENT_COLUMNS = list(SCHEMAS["CHARTEVENTS"])


def upper_case(df: DataFrame) -> DataFrame:
    """Upper-case column names."""
    return df.toDF(*(c.upper() for c in df.columns))


def converted(df: DataFrame, kinds: Mapping[str, str], lenient: bool = False) -> DataFrame:
    """The columns of kinds that df has, in that order, cast; bad values are null if lenient, else an error."""

    def cast(name: str, kind: str) -> Column:
        text = F.col(f"`{name}`")
        if kind == "time":
            return F.try_to_timestamp(text.cast("string")) if lenient else F.to_timestamp(text)
        return text.try_cast(kind) if lenient else text.cast(kind)

    return df.select(*(cast(n, k).alias(n) for n, k in kinds.items() if n in df.columns))


def read_table(spark: SparkSession, path: str, kinds: Mapping[str, str], lenient: bool = False) -> DataFrame:
    """A CSV table with a header in either case; no inference: all is read as text and cast as declared."""
    raw = spark.read.option("header", True).option("nullValue", "").option("quote", '"').option("escape", '"').csv(path, inferSchema=False)
    return converted(upper_case(raw), kinds, lenient)


def read_raw(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return read_table(spark, f"{folder}/{table}.csv", SCHEMAS[table])


def read_admissions(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """One scan, two projections: clinical times, and demographics."""
    both = read_raw(spark, folder, "ADMISSIONS")
    clinical = both.select("SUBJECT_ID", "HADM_ID", "ADMITTIME", "DISCHTIME", "DEATHTIME", "ETHNICITY", "DIAGNOSIS")
    info = both.select("SUBJECT_ID", "HADM_ID", "ADMISSION_TYPE", "ADMISSION_LOCATION", "DISCHARGE_LOCATION", "INSURANCE", "LANGUAGE", "ETHNICITY")
    return clinical, info


def union_events(tables: Sequence[DataFrame], columns: Sequence[str] = tuple(EVENT_COLUMNS)) -> DataFrame:
    """Event logs one below the other; a column that one lacks is null there."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out.select(*columns)


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    return union_events([read_raw(spark, folder, t) for t in EVENT_TABLES])


def variable_map(rows: DataFrame) -> DataFrame:
    """(ITEMID, VARIABLE, MIMIC_LABEL) of the entries that are ready, named and used."""
    filled = rows.select(
        F.coalesce(F.col("LEVEL2"), F.lit("")).alias("VARIABLE"), F.col("ITEMID").try_cast("int").alias("ITEMID"),
        F.col("COUNT").try_cast("long").alias("COUNT"), "STATUS", F.col("`MIMIC LABEL`").alias("MIMIC_LABEL"),
    )
    return filled.where("VARIABLE <> '' AND COUNT > 0 AND STATUS = 'ready'").select("ITEMID", "VARIABLE", "MIMIC_LABEL")


def read_variable_map(spark: SparkSession, path: str) -> DataFrame:
    return variable_map(upper_case(spark.read.option("header", True).csv(path)))


def phenotype_rows(definitions: Mapping[str, Mapping]) -> list[tuple[str, str, bool]]:
    last = {str(code): (str(code), name, bool(d["use_in_benchmark"])) for name, d in definitions.items() for code in d["codes"]}
    return sorted(last.values())


def phenotype_codes(spark: SparkSession, definitions: Mapping[str, Mapping]) -> DataFrame:
    """(ICD9_CODE, phenotype, use_in_benchmark) from {phenotype: {use_in_benchmark, codes}}; a code's last definition wins."""
    kinds = T.StructType([T.StructField("ICD9_CODE", T.StringType()), T.StructField("phenotype", T.StringType()), T.StructField("use_in_benchmark", T.BooleanType())])
    return spark.createDataFrame(phenotype_rows(definitions), kinds)


def parse_phenotypes(text: str) -> dict[str, dict]:
    """The definitions from their YAML form (a mapping of blocks with use_in_benchmark and a list of quoted codes)."""
    out: dict[str, dict] = {}
    now = ""
    for line in text.splitlines():
        body = line.split("#")[0].rstrip()
        if body and not body[0].isspace() and body.endswith(":"):
            now = body[:-1].strip("\"'")
            out[now] = {"use_in_benchmark": False, "codes": []}
        elif now and body.strip().startswith("use_in_benchmark:"):
            out[now]["use_in_benchmark"] = body.split(":", 1)[1].strip().lower() == "true"
        elif now and body.strip().startswith(("-", "codes:")):
            listed = body.split(":", 1)[1] if "codes:" in body else body.strip()[1:]
            out[now]["codes"] += [c.strip().strip("[]\"'") for c in listed.split(",") if c.strip().strip("[]\"'")]
    return out


def fixed_split(spark: SparkSession, path: str) -> DataFrame:
    """The subjects of a published list (subject, affiliation; no header) with affiliation 1."""
    return spark.read.schema("SUBJECT_ID int, affiliation int").csv(path).where("affiliation = 1").select("SUBJECT_ID")


def row_count(spark: SparkSession, path: str) -> int:
    """Rows of a file without header."""
    return spark.read.text(path).count()
