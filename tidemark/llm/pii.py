"""PII by anchor expansion.

An Aho-Corasick automaton finds the characters and cues that personal data cannot do without (at-signs, plus signs,
digits, schemes, identifier words). At each anchor a deterministic local parser expands to the boundaries of the
candidate and validates it. Texts without an anchor cost one pass of the automaton.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
#: Added by the method: an account number after its cue, and credentials in a URL.
KINDS = (*BASE_KINDS, "account", "login")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ACCOUNT = re.compile(r"(?:[ \t]*(?:no\.?|number|nr\.?|#))?[ \t]*[:=#]?[ \t]*([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?|[0-9](?:[ -]?[0-9]){5,33})(?![A-Za-z0-9])")
_LOGIN = re.compile(r"://([A-Za-z0-9._%+-]+:[^\s/@:]+)@[A-Za-z0-9-]")
#: Identifier cues; the letter before a cue may not be a letter.
CUES = ("account", "acct", "iban", "passport", "ssn", "konto", "compte", "cuenta")


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for c in "0123456789":
        a.add_word(c, "digit")
    a.add_word("@", "at")
    a.add_word("+", "plus")
    a.add_word("://", "scheme")
    for cue in CUES:
        for form in {cue, cue.capitalize(), cue.upper()}:
            a.add_word(form, "cue")
    a.make_automaton()
    return a


_CACHE: list[ahocorasick.Automaton] = []


def automaton() -> ahocorasick.Automaton:
    if not _CACHE:
        _CACHE.append(_automaton())
    return _CACHE[0]


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def spans(text: str | None) -> list[tuple[int, int, int]]:
    """(kind number, start, end) by kind and start; code points, end exclusive. Null and empty texts have none."""
    out: list[tuple[int, int, int]] = []
    if not text:
        return out
    done = [0] * len(KINDS)  # where each kind's last match ended, kept or dropped
    for at, what in automaton().iter(text):
        if what == "digit":
            if at >= done[1]:
                done[1] = _ips(text, at, out)
            if at >= done[2]:
                found = _CARD.match(text, at)
                if found:
                    done[2] = found.end()
                    digits = found[0].replace(" ", "").replace("-", "")
                    if 13 <= len(digits) <= 19 and luhn(digits):
                        out.append((2, at, done[2]))
        elif what == "at":
            found = _DOMAIN.match(text, at)
            if found:
                start = at
                while start > done[0] and text[start - 1] in _LOCAL:
                    start -= 1
                if start < at:
                    done[0] = found.end()
                    out.append((0, start, done[0]))
        elif what == "plus":
            if at >= done[3] and (found := _PHONE.match(text, at)):
                done[3] = found.end()
                if 9 <= sum("0" <= c <= "9" for c in found[0]) <= 15:
                    out.append((3, at, done[3]))
        elif what == "scheme":
            if (found := _LOGIN.match(text, at - 2)) and found.start(1) >= done[5]:
                done[5] = found.end(1)
                out.append((5, found.start(1), done[5]))
        elif found := _ACCOUNT.match(text, at + 1):
            cue = next(c for c in sorted(CUES, key=len, reverse=True) if text[at + 1 - len(c) : at + 1].lower() == c)
            before = text[at - len(cue) : at - len(cue) + 1] if at >= len(cue) else ""
            if not before.isalpha() and found.start(1) >= done[4]:
                done[4] = found.end(1)
                out.append((4, found.start(1), done[4]))
    out.sort()
    return out


def _ips(text: str, at: int, out: list[tuple[int, int, int]]) -> int:
    """Dotted numbers from at on, four by four as long as four follow each other; returns where the run of them ends."""
    run = _NUMBERS.match(text, at)
    end, start = run.end(), at
    while found := _IP.match(text, start, end):
        if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in found[0].split(".")):
            out.append((1, found.start(), found.end()))
        # what follows the match starts with a dot, or is the end of the run
        start = found.end() + 1
    return end


def told(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in found)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, spans array<struct(kind, start, end)> by kind and start, spans_text, base_text; one row per row of docs."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [spans(t) for t in batch.column(1).to_pylist()]
            rows = [[{"kind": KINDS[k], "start": s, "end": e} for k, s, e in f] for f in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(rows, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))),
                    pa.array([told(f) for f in found], pa.string()),
                    pa.array([told([x for x in f if x[0] < len(BASE_KINDS)]) for f in found], pa.string()),
                ],
                ["id", "spans", "spans_text", "base_text"],
            )

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>, spans_text string, base_text string")


def masked(text: str | None, found: list[tuple[int, int, int]]) -> str | None:
    """text with each span, overlapping ones together, put as <KIND>."""
    if not found:
        return text
    out, at = [], 0
    for k, s, e in sorted(found, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"<{KINDS[k].upper()}>"]
        at = max(at, e)
    return "".join(out) + text[at:]


def mask(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with personal data in text_col masked; null texts stay null."""

    @F.pandas_udf("string")
    def put(texts):
        return texts.map(lambda t: masked(t, spans(t)), na_action="ignore")

    return docs.withColumn(text_col, put(F.col(text_col)))


def digest(docs: DataFrame) -> DataFrame:
    """op9's columns for documents, and n_added (spans of the method's own kinds)."""

    def count(name: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == name)).cast("long")

    return find(docs).select(
        F.col("id").alias("doc_id"),
        *(count(k).alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2("base_text", 256).alias("base_sha256"),
        F.col("spans_text").alias("spans"),
        F.size(F.filter("spans", lambda x: x["kind"].isin("account", "login"))).cast("long").alias("n_added"),
    )


def _sql(kind: int, regex: str, fits: str) -> str:
    regex = regex.replace("'", "''")
    return f"""
  SELECT doc_id, {kind} AS kind, '{KINDS[kind]}' AS name, list_sum([length(x) FOR x IN p[1:i]]) + coalesce(list_sum([length(x) FOR x IN h[1:i-1]]), 0) AS s, length(m) AS n
  FROM (SELECT *, h[i] AS m, regexp_replace(h[i], '[^0-9]', '', 'g') AS digits FROM (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM (
    SELECT doc_id, regexp_extract_all(t, '{regex}', 0) AS h, regexp_split_to_array(t, '{regex}') AS p FROM d)))
  WHERE {fits}"""


#: The base spans alone, which is what SQL can tell; tests compare these columns.
BASE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
hit AS ({_sql(0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true")}
UNION ALL {_sql(1, r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "list_max([coalesce(try_cast(x AS HUGEINT), 999) FOR x IN string_split(m, '.')]) <= 255")}
UNION ALL {_sql(2, r"[0-9]([\x20-]?[0-9])+", "length(digits) BETWEEN 13 AND 19 AND list_sum([CASE WHEN (length(digits) - j) % 2 = 0 THEN substr(digits, j, 1)::INT ELSE (2 * substr(digits, j, 1)::INT) % 10 + (2 * substr(digits, j, 1)::INT) // 10 END FOR j IN range(1, length(digits) + 1)]) % 10 = 0")}
UNION ALL {_sql(3, r"\+[0-9][\x20().0-9-]+[0-9]", "length(digits) BETWEEN 9 AND 15")})
SELECT d.doc_id, {", ".join(f"count(*) FILTER (name = '{k}') AS n_{k}" for k in BASE_KINDS)},
       sha256(coalesce(string_agg(name || ':' || s || ':' || (s + n), ',' ORDER BY kind, s) FILTER (kind IS NOT NULL), '')) AS base_sha256
FROM d LEFT JOIN hit USING (doc_id) GROUP BY d.doc_id
"""


def brute(text: str | None) -> str:
    """The base spans as the plain expressions give them, for tests."""
    regexes = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": _CARD.pattern,
        "phone": _PHONE.pattern,
    }
    out = []
    for kind, regex in regexes.items():
        for m in re.finditer(regex, text or ""):
            digits = re.sub(r"[^0-9]", "", m[0])
            fits = {
                "email": True,
                "ip": all(int(x) <= 255 for x in m[0].split(".") if x) if kind == "ip" else True,
                "card": 13 <= len(digits) <= 19 and (not digits or luhn(digits)),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if fits:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
