"""N-gram Jaccard join by PartEnum signatures.

A document is the set of its distinct word shingles. Sets are put into bands of sizes; a pair whose Jaccard similarity
reaches the threshold shares a band, and differs in at most k elements there. The domain of shingles is cut by hash into
k + 1 + t parts, so such a pair agrees in at least t + 1 of them. Each set leaves out its t weakest parts (fewest
elements, then hash); the strongest part in which a pair agrees is left out by neither, as t weaker ones would have to
be. Every other part is a signature: sets share one by chance or by a line that many texts have only where a whole part
of several elements is alike.

Sets that share a signature are a bucket; it has a central node as its pivot, with which all others are compared. Of
buckets that are not of one component then, the nodes are told apart by how they differ from their pivot: what two sets
differ from the pivot by differs as the sets do, so a pair that links has many of these differences in common, and one
of the first few of each (elements that the pivot lacks first). Families of copies of one text, which all share their
signatures, so don't meet in pairs. Before sets are fetched, pairs are checked by counts of shingles in hash classes:
the sum of their differences is at most the number of elements in which the sets differ.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import BASE, Scratch, few, mix, pieces, powers, stage, word_hashes, words_of
from tidemark.llm._components import components

#: Link when PERCENT_OF * |A and B| >= PERCENT * |A or B|.
WORDS, PERCENT = 4, 85
#: Each band's largest size is its least size over this.
BAND = 0.75
#: Parts beyond k + 1, as a share of k + 1.
SPARE = 0.2
#: Elements of a set to one hash class of its counts.
TO_CLASS = 4
#: Up to so many rows of two numbers are sent to every task.
FEW_NODES = 500_000
#: Sets that a task remembers having signed, so as to sign copies once.
SIGNED = 2_000_000


class Bands:
    """Sizes to bands; a band's k and spare parts."""

    def __init__(self, percent: int = PERCENT):
        self.percent = percent

    def limits(self, band: int) -> tuple[int, int]:
        """Least and largest size of the smaller set of a pair in this band."""
        low = 1
        for _ in range(band):
            low = self._next(low)
        return low, self._next(low) - 1

    @staticmethod
    def _next(low: int) -> int:
        return max(low + 1, ceil(low / BAND))

    def most(self, size: int) -> int:
        """Size of the largest set that may link with one of ``size``."""
        return size * 100 // self.percent

    def of(self, size: int) -> list[int]:
        """Bands in which a set of this size takes part, as the smaller or as the larger one."""
        out, band, low = [], 0, 1
        while low <= size:
            high = self._next(low) - 1
            if self.most(high) >= size:
                out.append(band)
            band, low = band + 1, high + 1
        return out

    def parts(self, band: int) -> tuple[int, int]:
        """(k, t): the most elements in which a linking pair of this band differs, and the spare parts."""
        high = self.limits(band)[1]
        p, both = self.percent, high + self.most(high)
        k = both * (100 - p) // (100 + p)
        return k, ceil(SPARE * (k + 1))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Shingles in each of a power of two of hash classes: two sets differ in at least as many elements as their counts."""
    bits = max(4, (len(hashes) // TO_CLASS).bit_length() - 1)
    of = (mix(hashes ^ np.uint64(0x8CB92BA72F3D8DD7)) >> np.uint64(64 - bits)).astype(np.int64)
    return np.minimum(np.bincount(of, minlength=1 << bits), 32767).astype(np.int16)


def signatures(hashes: np.ndarray, bands: Bands, cache: dict | None = None) -> np.ndarray:
    """Signatures of a set of distinct 64-bit hashes, at least one shared by every pair that links."""
    out, cache = [], {} if cache is None else cache
    size = len(hashes)
    if size not in cache:
        cache[size] = [(b, *bands.parts(b)) for b in bands.of(size)]
    spread = mix(hashes + np.uint64(0x632BE59BD9B4E019))
    order = np.argsort(spread)  # parts are ranges of this, in every band
    spread, content = spread[order] >> np.uint64(33), mix(hashes ^ np.uint64(0xA0761D6478BD642F))[order]
    for band, k, spare in cache[size]:
        n = k + 1 + spare
        part = (spread * np.uint64(n) >> np.uint64(31)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        sums = np.zeros(n, np.uint64)
        sums[part[first]] = np.add.reduceat(content, first)
        names = mix(sums ^ mix(np.arange(n, dtype=np.uint64) + np.uint64(band * 0x1000003 * BASE & (2**64 - 1))))
        out.append(names[np.lexsort((names, np.bincount(part, minlength=n)))[spare:]])
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def lowered(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def shingles(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row; of fewer words than ``words`` all as one; none without words."""
    data = lowered(data)
    start, end, first = words_of(data, offsets)
    hashes = word_hashes(data, start, end)
    weights = powers(BASE, words)
    grams = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
    for j in range(words):
        grams += mix(hashes[j : j + len(grams)] + np.uint64(j)) * weights[j]
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= words:
            yield np.unique(grams[a : b - words + 1])
        elif b > a:
            yield np.array([np.add.reduce(mix(hashes[a:b] + np.uint64(99)) * powers(BASE, b - a))], np.uint64)
        else:
            yield np.empty(0, np.uint64)


def set_hash(hashes: np.ndarray) -> np.uint64:
    """Names a set; equal sets have equal names, others differ but for one chance in 2**64 a pair."""
    return mix(np.add.reduce(mix(hashes ^ np.uint64(0x2545F4914F6CDD1D)), keepdims=True) + np.uint64(len(hashes)))[0] if len(hashes) else np.uint64(0)


def apart_by(a: str, b: str) -> Column:
    """Sum of the differences of two sketches; the longer one is folded to the other's classes (0 if they are over an octave apart)."""
    half = lambda c: F.transform(F.sequence(F.lit(0), (F.size(c) / 2 - 1).cast("int")), lambda i: F.get(c, 2 * i) + F.get(c, 2 * i + 1))
    one, two = F.col(a).cast("array<int>"), F.col(b).cast("array<int>")
    one, two = F.when(F.size(one) > F.size(two), half(one)).otherwise(one), F.when(F.size(two) > F.size(one), half(two)).otherwise(two)
    return F.when(F.size(one) == F.size(two), F.aggregate(F.zip_with(one, two, lambda x, y: F.abs(x - y)), F.lit(0), lambda s, x: s + x)).otherwise(0)


def _as_long(x) -> pa.Array:
    return pa.array(np.asarray(x, np.uint64).view(np.int64))


def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (sig, node) in order, without repeats, those whose sig several nodes have; holds one batch, whatever the size of a bucket."""
    last = None  # a row that waits for its successor, and whether its predecessor has the same sig
    rows = lambda sig, node: pa.RecordBatch.from_arrays([pa.array(sig), pa.array(node)], ["sig", "node"])
    for batch in batches:
        sig, node = (batch.column(i).to_numpy() for i in (0, 1))
        if not len(sig):
            continue
        if last is not None:
            sig, node = np.r_[last[0], sig], np.r_[last[1], node]
        fresh = np.r_[True, (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])]
        sig, node = sig[fresh], node[fresh]
        like = np.r_[last is not None and last[2], sig[1:] == sig[:-1]]
        keep = like[:-1] | like[1:]
        yield rows(sig[:-1][keep], node[:-1][keep])
        last = sig[-1:], node[-1:], bool(like[-1])
    if last is not None and last[2]:
        yield rows(last[0], last[1])


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """base (id, n, node, classes) and edges (a, b) of nodes.

    node names the document's shingle set (null without shingles). The edges are links between different sets, enough of
    them to hold every linked pair together in one component; equal sets share a node.
    """
    bands = Bands(percent)
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in pieces(batch):
                sets = list(shingles(data, offsets, words))
                nodes = pa.array(np.array([set_hash(s) for s in sets], np.uint64).view(np.int64), mask=np.array([not len(s) for s in sets], bool))
                told = pa.array([sketch(s) for s in sets], pa.list_(pa.int16()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), nodes, told], ["id", "n", "node", "classes"])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, cache = set(), {}
        for batch in batches:
            for _, _, data, offsets in pieces(batch):
                sigs, nodes = [], []
                for s in shingles(data, offsets, words):
                    if len(s) and (node := set_hash(s)) not in seen:
                        if len(seen) >= SIGNED:
                            seen.clear()
                        seen.add(node)
                        sigs.append(signatures(s, bands, cache))
                        nodes.append(np.full(len(sigs[-1]), node))
                if sigs:
                    yield pa.RecordBatch.from_arrays([_as_long(np.concatenate(sigs)), _as_long(np.concatenate(nodes))], ["sig", "node"])

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in pieces(batch):
                sets = list(shingles(data, offsets, words))
                named_ = batch.column(1).slice(a, b - a).to_numpy()
                own = np.array([set_hash(s) for s in sets], np.uint64).view(np.int64) == named_  # rows of other texts may have the id, too
                kept = pa.array([s.view(np.int64) for s, o in zip(sets, own, strict=True) if o], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(named_[own]), kept], ["node", "hashes"])

    base = stage(text.mapInArrow(name, "id long, n long, node long, classes array<short>"), "sets-base")
    scratch = Scratch(docs.sparkSession, "partenum")  # all but base and the links goes at the end
    members = scratch.stage(text.mapInArrow(sign, "sig long, node long").repartition("sig").sortWithinPartitions("sig", "node").mapInArrow(shared, "sig long, node long"))
    named = base.where(F.col("id").isNotNull() & F.col("node").isNotNull())
    looks = named.join(members.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min(F.struct("id", "n", "classes")).alias("f"))
    looks = scratch.stage(looks.select("node", "f.id", "f.n", "f.classes"))

    def sets_of(pairs: DataFrame, *columns: str) -> DataFrame:
        """The sets of the nodes in these columns, each from the document of the least id that has it."""
        nodes = pairs.select(F.explode(F.array(*columns)).alias("node")).distinct()
        some = scratch.stage(looks.join(nodes, "node", "left_semi").select("id", "node"))
        few = F.broadcast(some) if some.count() <= FEW_NODES else some
        return scratch.stage(text.join(few, "id").select("text", "node").mapInArrow(tell, "node long, hashes array<long>").dropDuplicates(["node"]))

    def maybe(pairs: DataFrame) -> DataFrame:
        """Pairs that size and sketches allow to link."""
        for c in "ab":
            pairs = pairs.join(looks.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("classes").alias(f"c{c}")), c)
        sizes = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
        fits = sizes & ((100 + percent) * apart_by("ca", "cb") <= (100 - percent) * (F.col("na") + F.col("nb")))
        return scratch.stage(pairs.where(fits).select("a", "b"))

    def verified(pairs: DataFrame) -> DataFrame:
        sets = sets_of(pairs, "a", "b")
        for c in "ab":
            pairs = pairs.join(sets.select(F.col("node").alias(c), F.col("hashes").alias(f"h{c}")), c)
        both = F.size(F.array_intersect("ha", "hb"))
        return scratch.stage(pairs.where(100 * both >= percent * (F.size("ha") + F.size("hb") - both)).select("a", "b"))

    # A node's hub is the node with which it shares most buckets, of those that are the most central of a bucket; a bucket's pivot is most of its nodes' hub.
    of_sig = members.groupBy("sig").agg(F.count(F.lit(1)).alias("m"))
    central = members.join(of_sig, "sig").groupBy("node").agg(F.sum("m").alias("c"))
    middle = scratch.stage(members.join(central, "node").groupBy("sig").agg(F.max(F.struct("c", "node")).alias("p")).select("sig", F.col("p.node").alias("a")))
    together = members.join(middle, "sig").where("a <> node").groupBy("a", "node").agg(F.count(F.lit(1)).alias("k"))
    hubs = together.groupBy("node").agg(F.max(F.struct("k", "a")).alias("h")).select("node", F.col("h.a").alias("hub"))
    votes = members.join(hubs, "node", "left").groupBy("sig", F.coalesce("hub", "node").alias("hub")).agg(F.count(F.lit(1)).alias("m"))
    pivots = scratch.stage(votes.groupBy("sig").agg(F.max(F.struct("m", "hub")).alias("p")).select("sig", F.col("p.hub").alias("a")))
    starred = scratch.stage(members.join(pivots, "sig").where("a <> node").select("sig", "a", F.col("node").alias("b")))
    edges = verified(maybe(starred.select("a", "b").distinct()))
    # Of buckets that are not of one component, what each node differs in from the pivot.
    label = components(edges).select(F.col("node").alias("b"), F.col("label").alias("lb"))
    known = starred.join(label, "b", "left").withColumn("lb", F.coalesce("lb", "b"))
    mixed = known.groupBy("sig").agg(F.min("lb").alias("lo"), F.max("lb").alias("hi")).where("lo <> hi").select("sig")
    open_ = known.join(mixed, "sig").select("a", "b", "lb").distinct()
    open_ = scratch.stage(open_.join(edges.withColumn("linked", F.lit(True)), ["a", "b"], "left").withColumn("linked", F.coalesce("linked", F.lit(False))))
    sets = sets_of(open_, "a", "b")
    both = open_.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("hb")), "b").join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("ha")), "a")
    both = both.withColumn("differ", F.concat(F.array_except("hb", "ha"), F.array_except("ha", "hb"))).withColumn("d", F.size("differ"))
    both = both.withColumn("na", F.size("ha")).withColumn("nb", F.size("hb"))
    # A partner of a node that is linked with the pivot is not, and so has over (its size + na) * c differences; that of another has d - k at least.
    c = F.lit(100 - percent) / F.lit(100 + percent)
    k = F.floor((F.col("nb") + F.floor(100 * F.col("nb") / percent)) * c + 1e-6)
    length = F.when(F.col("linked"), F.col("d") - F.floor((F.col("d") + (F.col("na") - F.col("nb")) * c) / 2 - 1e-6)).otherwise(k + 1)
    rows = both.select("a", "b", F.col("lb").alias("label"), "linked", "d", F.col("nb").alias("n"), F.posexplode(F.slice("differ", F.lit(1), F.greatest(F.lit(1), F.least(length, F.col("d"))).cast("int"))).alias("i", "e"))
    rows = scratch.stage(rows)
    one = rows.where(~F.col("linked")).select("a", "e", F.col("b").alias("x"), *(F.col(y).alias(f"{y}1") for y in ("label", "d", "n", "i")))
    two = rows.select("a", "e", F.col("b").alias("y"), "linked", *(F.col(y).alias(f"{y}2") for y in ("label", "d", "n", "i")))
    most = F.expr(f"((n1 + n2) * {100 - percent}) div {100 + percent}")  # elements in which a linked pair differs
    common = F.ceil((F.col("d1") + F.col("d2") - most) / 2)  # differences that it has in common; the first of them has so many after it
    fits = (F.col("label1") != F.col("label2")) & (F.col("linked") | (F.col("x") < F.col("y"))) & (100 * F.least("n1", "n2") >= percent * F.greatest("n1", "n2")) & (F.least(F.col("d1") - F.col("i1"), F.col("d2") - F.col("i2")) >= common)
    met = one.join(two, ["a", "e"]).where(fits).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    edges = stage(edges.unionByName(verified(maybe(met))), "set-links")
    scratch.clear()
    return base, edges


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id) per row of docs: component_id is the least id that links reach.

    Null texts and those without words are linked with nothing: their own component. Null ids take part in no
    component: theirs is null. Rows with equal ids are nodes of their own sets.
    """
    base, edges = links(docs, id_col, text_col, words, percent)
    named = base.where(F.col("node").isNotNull() & F.col("id").isNotNull())
    label = components(edges)
    first = named.groupBy("node").agg(F.min("id").alias("least")).join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    of_label = first.groupBy("label").agg(F.min("least").alias("component"))
    of_node = first.select("node", "label").join(of_label, "label").select("node", "component")
    out = base.join(of_node, "node", "left")
    return out.select("id", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))


def digest(docs: DataFrame) -> DataFrame:
    """op5's columns for documents."""
    return linked(docs).withColumnRenamed("id", "doc_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """docs with the document of the least id of each group of near copies; texts without words and null ids all stay."""
    gone = few(linked(docs, id_col, text_col, words, percent).where(F.col("component_id") < F.col("id")).select(F.col("id").alias("gone_id")).distinct(), "copy-ids", FEW_NODES)
    return docs.join(gone, docs[id_col] == gone["gone_id"], "left_anti")

#: The same in SQL: all pairs that share a shingle, so for small tables.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id)
SELECT r.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(c) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY r.doc_id
"""
