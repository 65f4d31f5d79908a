"""A Merkle manifest of a dataset by butterfly exchange.

Leaves of a sequence (a language) are put in order and cut into aligned blocks of FANOUT ** LEVELS leaves. A block hashes
its own subtree. Then blocks work in rounds: the FANOUT blocks whose numbers differ in one digit alone swap the roots of
the subtrees they know, and each of them hashes the next ancestor itself. So after its sequence's last round every
block knows the siblings of all its ancestors, and no pass leads down again: a leaf's proof is put together where the
leaf lies. The roots of the sequences are leaves of one more sequence, which goes the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm._common import CRC_SQL, CRC_TABLE, Scratch, stage

FANOUT = 8
#: Levels inside a block, so a block has 512 leaves at most.
LEVELS = 3
BLOCK = FANOUT**LEVELS
#: Up to so many sequences (some 600 bytes each) are sent to every task.
FEW = 10_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def node(parts: Column) -> Column:
    """The digest of an array of digests: of their hex texts, one after the other."""
    return F.sha2(F.array_join(parts, ""), 256)


def leaf(columns: list[Column]) -> Column:
    """The digest of a row: each value as its count of UTF-8 bytes, a colon and itself, or - where it is null."""
    value = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.sha2(F.concat(*map(value, columns)), 256)


def numbered(rows: DataFrame, keys: list[str], order: list[str], scratch: Scratch) -> DataFrame:
    """rows with pos, their number from 0 among those of equal keys in the given order, and n, how many these are.

    Ranges of the whole order are sorted in a task each, and a row's number is its place in the range plus what the
    ranges before hold of its keys. Equal rows are told apart by where they were read.
    """
    placed = rows.withColumn("_read", F.monotonically_increasing_id())
    ranged = placed.repartitionByRange(*keys, *order, "_read").sortWithinPartitions(*keys, *order, "_read")
    kept = scratch.stage(ranged.drop("_read").withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    counts = kept.groupBy(*keys, "_part").agg(F.min("_at").alias("_low"), F.count(F.lit(1)).alias("_n"))
    # A row for each range and sequence in it: their number is that of the tasks and sequences, not of the rows.
    of = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_n").over(of.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = scratch.stage(counts.select(*keys, "_part", "_low", before.alias("_before"), F.sum("_n").over(of).alias("n")))
    offsets = F.broadcast(offsets) if offsets.count() <= FEW else offsets
    same = [kept[k].eqNullSafe(offsets[k]) for k in keys] + [kept["_part"] == offsets["_part"]]
    joined = kept.join(offsets, same)
    return joined.select(*(kept[c] for c in kept.columns if c not in ("_part", "_at")), (F.col("_at") - F.col("_low") + F.col("_before")).alias("pos"), "n")


def _parents(nodes: Column) -> Column:
    """The digests of each FANOUT nodes in a row, the last ones fewer."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FANOUT).cast("int")), lambda i: node(F.slice(nodes, i * FANOUT + 1, F.lit(FANOUT))))


def _siblings(nodes: Column, at: Column) -> Column:
    """(left, right) of node number at (from 0): the digests before and after it in its run of FANOUT, joined."""
    digit = at % FANOUT
    first = at - digit
    return F.struct(F.array_join(F.slice(nodes, first + 1, digit), "").alias("left"), F.array_join(F.slice(nodes, at + 2, FANOUT - 1 - digit), "").alias("right"))


def blocks(leaves: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """(key, block, n, h0 to h{LEVELS - 1}, root, items): a row for each block of BLOCK leaves of (key, pos, n, hash, item).

    h0 are the leaves' digests and hk those of level k; a sequence that ends within a block has no nodes above its root.
    """
    item = F.struct("pos", "hash", "item")
    rows = leaves.groupBy(key, F.floor(F.col("pos") / BLOCK).alias("block"), "n").agg(F.array_sort(F.collect_list(item)).alias("_s"))
    out = rows.select(key, "block", "n", F.transform("_s", lambda s: s["hash"]).alias("h0"), F.transform("_s", lambda s: s["item"]).alias("items"))
    for k in range(LEVELS):
        # In a sequence of several blocks a lone node goes up too; in one of a single block it is the root.
        goes_up = (F.col("n") > BLOCK) | (F.size(f"h{k}") > 1)
        out = out.withColumn(f"h{k + 1}", F.when(goes_up, _parents(F.col(f"h{k}"))).otherwise(F.col(f"h{k}")))
    return scratch.stage(out.withColumn("root", F.element_at(f"h{LEVELS}", 1)).drop(f"h{LEVELS}"))


def butterfly(roots: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """(key, block, root, path) from (key, block, blocks, root): the root of the whole sequence and an array of (left, right).

    In round r, blocks b and b' swap where all digits of their numbers agree but the r-th. The subtree at a sequence's
    end may lack the block that others would swap with; its last block stands in. A round is a group of at most FANOUT
    rows, and one row for each sequence is joined; rounds are the logarithm of the most blocks of a sequence.
    """
    state = roots.withColumn("path", F.array().cast("array<struct<left:string,right:string>>"))
    most = roots.agg(F.max("blocks")).first()[0] or 0
    size = 1
    while size < most:
        state = scratch.stage(state)
        tree, group, lane = (F.floor(F.col("block") / size), F.floor(F.col("block") / (size * FANOUT)), F.col("block") % size)
        met = state.where(F.col("blocks") > size).groupBy(key, group.alias("_group"), lane.alias("_lane"), "blocks")
        met = met.agg(F.array_sort(F.collect_list(F.struct(tree.alias("tree"), "block", "root", "path"))).alias("_met"))
        ends = state.where((F.col("blocks") > size) & (F.col("block") == F.col("blocks") - 1)).select(F.col(key).alias("_key"), F.col("root").alias("_end"))
        ends = F.broadcast(ends) if ends.count() <= FEW else ends
        joined = met.join(ends, met[key].eqNullSafe(ends["_key"]))
        # The group has the sequence's last subtree, but this lane has no block in it.
        last = F.floor((F.col("blocks") - 1) / size)
        lacks = (F.floor(last / FANOUT) == F.col("_group")) & (F.element_at("_met", -1)["tree"] < last)
        known = F.transform("_met", lambda m: m["root"])
        full = joined.withColumn("_known", F.when(lacks, F.concat(known, F.array("_end"))).otherwise(known)).withColumn("_up", node(F.col("_known")))
        swapped = F.transform("_met", lambda m: F.struct(m["block"].alias("block"), F.col("_up").alias("root"), F.concat(m["path"], F.array(_siblings(F.col("_known"), (m["tree"] % FANOUT).cast("int")))).alias("path")))
        went = full.select(key, "blocks", F.inline(swapped))
        state = went.select(key, "block", "blocks", "root", "path").unionByName(state.where(F.col("blocks") <= size))
        size *= FANOUT
    return scratch.stage(state.select(key, "block", "root", "path"))


def _fold(start: Column, path: Column) -> Column:
    return F.aggregate(path, start, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def proven(leaves: DataFrame, key: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The blocks of blocks(), and butterfly()'s (key, block, root, path) for them."""
    own = blocks(leaves, key, scratch)
    count = F.ceil(F.col("n") / BLOCK)
    return own, butterfly(own.select(key, "block", count.alias("blocks"), "root"), key, scratch)


def manifest(docs: DataFrame, columns: list[str] | None = None, by: str = "lang", order: str = "doc_id", item: Column | None = None, other: Column | None = None) -> DataFrame:
    """(item, leaf, subroot, root, proof, folded_root, verified), one row per row of docs.

    A leaf is the digest of the named columns (all by default). Leaves of equal `by` (null is a value of its own) make a
    tree in the order of `order`, nulls first, then of their digests; equal rows are interchangeable leaves. The roots
    of these trees make one tree in the order of `by`, null first and bytewise. proof is an array of (left, right),
    from the leaf up: the digests before and after the node in its run. `item` is a column to carry along (`order` by
    default). Where `other`, a leaf to be checked in place of the own one, isn't null, folded_root starts from it.
    Empty docs give no rows; a single row is its own subroot and root, with an empty proof. The result is staged.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "merkle")
    own = leaf([F.col(f"`{c}`") for c in (columns or docs.columns)])
    extra = F.lit(None).cast("string") if other is None else other
    carried = F.col(order) if item is None else item
    rows = docs.select(F.col(by).cast("string").alias("_by"), F.col(order).alias("_order"), own.alias("hash"), F.struct(carried.alias("item"), extra.alias("other")).alias("item"))
    # Texts are read and hashed once: what is sampled, sorted and dealt out are the digests.
    leaves = numbered(scratch.stage(rows), ["_by"], ["_order", "hash"], scratch)
    own_blocks, paths = proven(leaves.select("_by", "pos", "n", "hash", "item"), "_by", scratch)
    # One row a sequence: its root is a leaf of the tree above.
    roots = paths.where(F.col("block") == 0).select(F.lit(0).alias("_top"), F.col("root").alias("hash"), F.struct(F.col("_by").alias("of")).alias("item"), F.col("_by").alias("_order"))
    above = numbered(roots, ["_top"], ["_order"], scratch)
    top_blocks, top_paths = proven(above.select("_top", "pos", "n", "hash", "item"), "_top", scratch)
    tops = _leaf_rows(top_blocks, top_paths, "_top").select(F.col("item.of").alias("_of"), F.col("hash").alias("subroot"), F.col("root").alias("_root"), F.col("path").alias("_above"))
    tops = scratch.stage(tops)
    tops = F.broadcast(tops) if tops.count() <= FEW else tops
    whole = paths.join(tops, paths["_by"].eqNullSafe(tops["_of"])).select("_by", "block", F.col("_root").alias("root"), "subroot", F.concat("path", "_above").alias("path"))
    told = _leaf_rows(own_blocks, whole, "_by", "subroot")
    folded = _fold(F.coalesce(F.col("item.other"), F.col("hash")), F.col("path"))
    out = told.select(F.col("item.item").alias("item"), F.col("hash").alias("leaf"), "subroot", "root", F.col("path").alias("proof"), folded.alias("folded_root"))
    done = stage(out.withColumn("verified", F.col("folded_root") == F.col("root")), "merkle-manifest")
    scratch.clear()
    return done


def _leaf_rows(own: DataFrame, paths: DataFrame, key: str, *more: str) -> DataFrame:
    """(hash, item, root, path, more): a row for each leaf of the blocks, its path going through the block and then on."""
    p = paths.withColumnRenamed(key, "_key").withColumnRenamed("block", "_block")
    joined = own.drop("root").join(p, own[key].eqNullSafe(p["_key"]) & (own["block"] == p["_block"]))

    def one(h: Column, i: Column) -> Column:
        steps = [F.when((F.col("n") > BLOCK) | (F.size(f"h{k}") > 1), _siblings(F.col(f"h{k}"), F.floor(i / FANOUT**k).cast("int"))) for k in range(LEVELS)]
        inside = F.filter(F.array(*steps), lambda s: s.isNotNull())
        return F.struct(h.alias("hash"), F.element_at("items", i + 1).alias("item"), F.concat(inside, F.col("path")).alias("path"))

    return joined.select("root", *more, F.inline(F.transform("h0", one)))


COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(docs: DataFrame) -> DataFrame:
    """op12's columns for documents. Rows with a null doc_id are not tampered with."""
    changed = [F.translate("text", UPPER, LOWER) if c == "text" else F.col(c) for c in COLUMNS]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, leaf(changed))
    rows = manifest(docs, COLUMNS, other=tampered)
    proof = F.array_join(F.transform("proof", lambda s: F.concat(s["left"], s["right"])), "")
    return rows.select(F.col("item").alias("doc_id"), "leaf", "subroot", "root", F.sha2(proof, 256).alias("proof_sha256"), "folded_root", "verified")


#: Levels that the SQL has below and above the subroots: 8 ** 7 documents of a language and 8 ** 4 languages at most.
_LOW, _HIGH = 7, 4


def _sql_levels(name: str, key: str, first: str, levels: int) -> str:
    """CTEs name0, name1, ...: the nodes of each level, with the digests before and after them in their run."""
    out, source = [], first
    for k in range(levels):
        run = f"(PARTITION BY {key}, pos // {FANOUT} ORDER BY pos ROWS BETWEEN"
        out.append(f"""{name}{k} AS (SELECT {key} AS key, pos, n, h, coalesce(string_agg(h, '') OVER {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(h, '') OVER {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM ({source}))""")
        key = "key"
        source = f"SELECT key, pos // {FANOUT} AS pos, (any_value(n) + {FANOUT - 1}) // {FANOUT} AS n, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h FROM {name}{k} GROUP BY key, pos // {FANOUT}"
    out.append(f"{name}_root AS ({source})")
    return ",\n  ".join(out)


def _sql_leaf(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in [*COLUMNS[:-1], text]) + ")"


def _sql_fold(steps: list[tuple[str, tuple[str, str]]]) -> str:
    """A chain of subqueries that fold x through the steps' siblings."""
    out = "SELECT *, coalesce(t, h) AS x FROM leaf"
    for table, at in steps:
        out = f"SELECT a.* REPLACE (CASE WHEN s.n = 1 THEN x ELSE sha256(s.l || x || s.r) END AS x, proof || s.l || s.r AS proof) FROM ({out}) a JOIN {table} s ON s.key = {at[0]} AND s.pos = {at[1]}"
    return out


ORACLE_SQL = f"""
WITH {CRC_TABLE},
  d AS (SELECT doc_id, CASE WHEN lang IS NULL THEN 'n' ELSE 'v' || lang END AS key, {_sql_leaf("text")} AS h,
    CASE WHEN {CRC_SQL.format(id="doc_id")} % 3 = 0 THEN {_sql_leaf(f"translate(text, '{UPPER}', '{LOWER}')")} END AS t FROM documents, crc_table),
  leaf AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY key) AS n, '' AS proof FROM d),
  {_sql_levels("low", "key", "SELECT key, pos, n, h FROM leaf", _LOW)},
  top AS (SELECT 'all' AS of, key AS lang_key, row_number() OVER (ORDER BY key) - 1 AS pos, count(*) OVER () AS n, h FROM low_root),
  {_sql_levels("high", "of", "SELECT of, pos, n, h FROM top", _HIGH)},
  placed AS (SELECT a.*, top.pos AS above, top.h AS subroot FROM ({_sql_fold([(f"low{k}", ("a.key", f"a.pos // {FANOUT**k}")) for k in range(_LOW)])}) a JOIN top ON top.lang_key = a.key),
  folded AS ({_sql_fold([(f"high{k}", ("'all'", f"a.above // {FANOUT**k}")) for k in range(_HIGH)]).replace("SELECT *, coalesce(t, h) AS x FROM leaf", "SELECT * FROM placed")})
SELECT doc_id, folded.h AS leaf, subroot, high_root.h AS root, sha256(proof) AS proof_sha256, x AS folded_root, x = high_root.h AS verified FROM folded, high_root
"""
