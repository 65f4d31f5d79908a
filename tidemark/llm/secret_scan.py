"""Secret scans by corpus-wide ownership frequency; DataFrame expressions only.

Candidate strings are found in every whole text, hashed, and counted over the corpus by distinct repositories and
owners. A value that several owners hold is a widely copied example; one that looks random and stays with few owners
is a live-looking credential.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm._common import few, stage


@dataclass(frozen=True)
class Kind:
    """regex: its group 1, if it has one, else all of it, is the value. least: characters the value has at least. marks: one of them is in the lower case of each match."""

    name: str
    regex: str
    group: int
    least: int
    base: bool
    marks: tuple[str, ...] = ()


KEYWORDS = "(?i:password|passwd|secret|token|api_?key)"
KINDS = (
    Kind("assign", KEYWORDS + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12, True, ("passw", "secret", "token", "key")),
    Kind("access", r"AKIA[A-Z0-9]{14,}", 0, 18, True),
    Kind("hex", r"[0-9a-f]{16,}", 0, 16, True),
    # Added by the method: long opaque strings, kept only where the corpus says that they belong to few owners.
    Kind("opaque", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}", 0, 24, False),
)
#: A value that this many owners hold is a copied example.
COPIED_OWNERS = 3
#: Distinct characters that a live-looking value has at least.
LIVE_DISTINCT = 8


def _hits(text: Column, number: int, kind: Kind) -> Column:
    """struct(kind, gaps, hits): the lengths of the texts between matches; of each match its length, value hash and looks."""
    found, values = F.regexp_extract_all(text, F.lit(kind.regex), F.lit(0)), F.regexp_extract_all(text, F.lit(kind.regex), F.lit(kind.group))

    def told(match: Column, value: Column) -> Column:
        varied = F.size(F.array_distinct(F.split(value, ""))) >= LIVE_DISTINCT
        live = varied & value.rlike("[0-9]") & value.rlike("[A-Za-z]")
        if not kind.base:
            live = live & value.rlike("[A-Z]") & value.rlike("[a-z]")
        return F.struct(
            F.length(match).alias("len"),
            (F.length(value) >= kind.least).alias("fits"),
            live.alias("live"),
            F.sha2(value, 256).alias("hash"),
        )

    hits = F.zip_with(found, values, told)
    gaps = F.transform(F.split(text, kind.regex, -1), lambda x: F.length(x))
    # A text without a mark is not searched.
    marked = reduce(Column.__or__, (F.contains(F.lower(text), F.lit(m)) for m in kind.marks), F.lit(not kind.marks))
    return F.when(marked & (F.size(found) > 0), F.struct(F.lit(number).alias("kind"), gaps.alias("gaps"), hits.alias("hits")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """One row per row of docs, in a staged table: uid, id, spans array<struct(start, kind, end, name, base, live, copied, n_owners, n_repos, hash)>.

    Repositories are told apart by ``repo_cols``, owners by ``owner_col``; a null there is an owner (repository) of its
    own. A null text is empty and has no span. Repeated rows are separate rows with equal spans. Spans of different
    kinds may overlap. ``live``: looks random and fewer than COPIED_OWNERS owners hold the value.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    kinds = F.filter(F.array(*(_hits(text, i, k) for i, k in enumerate(KINDS))), lambda x: x.isNotNull())
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    found = stage(
        docs.select(
            F.monotonically_increasing_id().alias("uid"),
            F.col(id_col).alias("id"),
            part(owner_col).alias("owner"),
            F.concat_ws("/", *map(part, repo_cols)).alias("repo"),
            kinds.alias("kinds"),
        ),
        "secret-hits",
    )
    # A document's matches of a kind, with where they start: running sums within the document alone.
    each = found.select("uid", "owner", "repo", F.explode("kinds").alias("k")).select("uid", "owner", "repo", "k.kind", F.posexplode(F.arrays_zip("k.gaps", "k.hits")).alias("i", "x"))
    before = Window.partitionBy("uid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = (
        each.withColumn("end", F.sum(F.col("x.gaps") + F.coalesce(F.col("x.hits.len"), F.lit(0))).over(before))
        .where(F.col("x.hits.fits"))
        .select("uid", "owner", "repo", "kind", (F.col("end") - F.col("x.hits.len")).alias("start"), "end", F.col("x.hits.live").alias("live"), F.col("x.hits.hash").alias("hash"))
    )
    spread = spans.groupBy("hash").agg(F.count_distinct("owner").alias("n_owners"), F.count_distinct("repo").alias("n_repos"))
    names, base = F.array(*(F.lit(k.name) for k in KINDS)), F.array(*(F.lit(k.base) for k in KINDS))
    copied = F.col("n_owners") >= COPIED_OWNERS
    judged = (
        spans.join(spread, "hash")
        .withColumn("copied", copied)
        .withColumn("live", F.col("live") & ~copied)
        .withColumn("name", F.element_at(names, F.col("kind") + 1))
        .withColumn("base", F.element_at(base, F.col("kind") + 1))
        .where(F.col("base") | F.col("live"))
        .groupBy("uid")
        .agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "name", "base", "live", "copied", "n_owners", "n_repos", "hash"))).alias("spans"))
    )
    none = F.array().cast(judged.schema["spans"].dataType)
    return found.select("uid", "id").join(judged, "uid", "left").withColumn("spans", F.coalesce("spans", none))


def told(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["name"], x["start"], x["end"])), ",")


def _named(name: str) -> Callable[[Column], Column]:
    return lambda x: x["name"] == name


def digest(docs: DataFrame) -> DataFrame:
    """op1's columns for documents, n_added, n_live and n_copied (spans by verdict), most_owners and most_repos (that hold one of the values)."""
    spans = F.col("spans")
    most = lambda c: F.coalesce(F.array_max(F.transform(spans, lambda x: x[c])), F.lit(0)).cast("long")
    count = lambda rule: F.size(F.filter(spans, rule)).cast("long")
    return scan(docs).select(
        F.col("id").alias("doc_id"),
        *(count(_named(k.name)).alias(f"n_{k.name}") for k in KINDS if k.base),
        F.sha2(told(F.filter(spans, lambda x: x["base"])), 256).alias("base_sha256"),
        told(spans).alias("spans"),
        count(lambda x: ~x["base"]).alias("n_added"),
        count(lambda x: x["live"]).alias("n_live"),
        count(lambda x: x["copied"]).alias("n_copied"),
        most("n_owners").alias("most_owners"),
        most("n_repos").alias("most_repos"),
    )


def without_live_secrets(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs without the rows that hold a live-looking credential; widely copied examples stay.

    Rows are told apart by id_col; where an id is repeated, all its rows go together. Rows with a null id stay only if no row with a null id holds one.
    """
    held = few(scan(docs, id_col).where(F.exists("spans", lambda x: x["live"])).select(F.col("id").alias("held_id")).distinct(), "secret-ids")
    return docs.join(held, docs[id_col].eqNullSafe(held["held_id"]), "left_anti")


def _sql_hits(number: int, kind: Kind) -> str:
    regex = kind.regex.replace("(?<![A-Za-z0-9+/_-])", "").replace("'", "''")
    case = " AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]')" if not kind.base else ""
    return f"""
  SELECT doc_id, owner, repo, {number} AS kind, '{kind.name}' AS name, {str(kind.base).lower()} AS base,
         list_sum([length(x) FOR x IN p[1:i]]) + coalesce(list_sum([length(x) FOR x IN h[1:i-1]]), 0) AS s, length(h[i]) AS n, v,
         length(list_distinct(string_split(v, ''))) >= {LIVE_DISTINCT} AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]'){case} AS looks
  FROM (SELECT *, h[i] AS m, vs[i] AS v FROM (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM (
    SELECT doc_id, owner, repo, regexp_extract_all(t, '{regex}', 0) AS h, regexp_extract_all(t, '{regex}', {kind.group}) AS vs, regexp_split_to_array(t, '{regex}') AS p FROM d)))
  WHERE length(v) >= {kind.least}"""


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS owner, coalesce(source, '') || '/' || coalesce(lang, '') AS repo FROM documents),
hit AS ({" UNION ALL ".join(_sql_hits(i, k) for i, k in enumerate(KINDS))}),
spread AS (SELECT v, count(DISTINCT owner) AS n_owners, count(DISTINCT repo) AS n_repos FROM hit GROUP BY v),
judged AS (
  SELECT doc_id, kind, name, base, s, name || ':' || s || ':' || (s + n) AS span, looks AND n_owners < {COPIED_OWNERS} AS live, n_owners >= {COPIED_OWNERS} AS copied, n_owners, n_repos
  FROM hit JOIN spread USING (v) WHERE base OR (looks AND n_owners < {COPIED_OWNERS})),
told AS (
  SELECT doc_id, {", ".join(f"count(*) FILTER (name = '{k.name}') AS n_{k.name}" for k in KINDS if k.base)},
         coalesce(string_agg(span, ',' ORDER BY s, kind) FILTER (base), '') AS base_spans, string_agg(span, ',' ORDER BY s, kind) AS spans,
         count(*) FILTER (NOT base) AS n_added, count(*) FILTER (live) AS n_live, count(*) FILTER (copied) AS n_copied, max(n_owners) AS most_owners, max(n_repos) AS most_repos
  FROM judged GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k.name}, 0) AS n_{k.name}" for k in KINDS if k.base)}, sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(n_added, 0) AS n_added, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied, coalesce(most_owners, 0) AS most_owners, coalesce(most_repos, 0) AS most_repos
FROM d LEFT JOIN told USING (doc_id)
"""
