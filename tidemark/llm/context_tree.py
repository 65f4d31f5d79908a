"""Scoring texts by context-tree weighting over bytes.

A byte is eight binary decisions, and each decision has a tree of contexts: the none, one, two, ... DEPTH bytes before.
Every node counts how its decision went in the texts that are learned from; Krichevsky and Trofimov's estimate of its
counts is weighed against what its longer contexts make of them, over all depths at once. The weighted probability of a
byte, once learned, depends on the byte and the DEPTH bytes before it alone: its gram.

So texts are cut into blocks, and a block asks for its distinct grams. Grams are counted over the cluster, the trees are
built where all grams of a three-byte context lie together (what lies above is small: two bytes), every distinct gram
is told its probability, and each block gets the answers to what it asked for. Nothing holds a model of the whole
corpus, and no text is looked at but by its own block. Words are asked for in the same way, for the base score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import Scratch, pieces, stage

DEPTH = 4
#: Contexts of so many bytes lie together; the trees' parts above have a row for two bytes and a decision at most.
SPLIT = 3
#: Text of a block, in bytes; one longer document is a block of its own.
BLOCK_BYTES = 32_000_000
#: Text that is packed together, so that nobody unpacks a block at once.
PACK_BYTES = 4_000_000
#: Positions that are looked at at a time.
CHUNK = 1_000_000
#: Grams of whole three-byte contexts that are worked on together.
GROUP = 500_000
#: Grams that are held beside a block's distinct ones before they are merged.
MERGED = 1_000_000
#: A byte that no UTF-8 has: what lies before a text, and its end.
EDGE = 0xFF
SMOOTH = 0.1

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Windows:
    """The grams of some texts: a gram has the byte before as its highest, then the one before that, and so on, and its own byte as its lowest."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, depth: int):
        n, self.depth = len(offsets) - 1, depth
        length = np.diff(offsets)
        self.buffer = np.full(8 + len(data) + n * (depth + 1), EDGE, np.uint8)
        self.first = 8 + offsets[:-1] + np.arange(n) * (depth + 1) + depth
        self.last = self.first + length  # where the end is
        self.own = np.zeros(len(self.buffer), bool)
        self.own[8:] = True
        for k in range(depth):
            self.own[self.first - 1 - k] = False
        at = self.own.copy()
        at[self.last] = False
        self.buffer[at] = _LOWER[data]

    def chunks(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(low, high, grams) for stretches of positions; those of the padding too."""
        before = np.lib.stride_tricks.as_strided(self.buffer[: max(0, len(self.buffer) - 8)].view(np.uint8), (len(self.buffer) - 8, 8), (1, 1))
        for a in range(8, len(self.buffer), CHUNK):
            b = min(len(self.buffer), a + CHUNK)
            # the eight bytes before each position as a little-endian number: the nearest one is its highest
            gram = np.ascontiguousarray(before[a - 8 : b - 8]).view("<u8")[:, 0]
            gram >>= np.uint64(8 * (8 - self.depth))
            gram <<= np.uint64(8)
            gram |= self.buffer[a:b]
            yield a, b, gram.view(np.int64)

    def distinct(self) -> list[tuple[np.ndarray, np.ndarray]]:
        return [np.unique(g[self.own[a:b]], return_counts=True) for a, b, g in self.chunks()]

    def sums(self, grams: pd.Index, values: np.ndarray) -> np.ndarray:
        """For each text, the sum of its grams' values."""
        out = np.zeros(len(self.first))
        for a, b, gram in self.chunks():
            total = np.concatenate([[0.0], np.cumsum(values[grams.get_indexer(gram)] * self.own[a:b])])
            low, high = np.searchsorted(self.last, a), np.searchsorted(self.first, b)
            s, e = np.clip(self.first[low:high], a, b) - a, np.clip(self.last[low:high] + 1, a, b) - a
            out[low:high] += total[e] - total[s]
        return out


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their numbers."""
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    keys, n = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    order = np.argsort(keys, kind="stable")  # the parts are sorted, and merged
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(n[order], first) if len(keys) else n


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """For x > 0, by Stirling's series at x + 8."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def log_estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of Krichevsky and Trofimov's probability of a sequence with so many zeros and ones."""
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1.0) - math.log(math.pi)


class Nodes:
    """The nodes of one depth: key (context << 8 | decision), zeros, ones, log weighted probability, and the weight of the own estimate."""

    def __init__(self, key: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None):
        """below: sum of the children's log weighted probabilities; None at the deepest."""
        self.key, self.zeros, self.ones = key, zeros, ones
        own = log_estimate(zeros, ones)
        if below is None:
            self.log, self.weight = own, np.ones(len(key))
        else:
            self.log = np.logaddexp(own, below) - math.log(2)
            self.weight = np.exp(own - math.log(2) - self.log)

    def parents(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(key, zeros, ones, below) one byte less deep; the byte furthest away is a context's lowest."""
        key, place = np.unique((self.key >> 16) << 8 | (self.key & 0xFF), return_inverse=True)
        return key, *(np.bincount(place, x, len(key)) for x in (self.zeros, self.ones, self.log))

    def mixed(self, key: np.ndarray, bit: np.ndarray, deeper: np.ndarray) -> np.ndarray:
        """The probability of each bit at its node; deeper: what longer contexts say, or nan where none was seen."""
        if not len(self.key):
            return deeper
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        seen = self.key[at] == key
        zeros, ones = self.zeros[at], self.ones[at]
        own = (np.where(bit, ones, zeros) + 0.5) / (zeros + ones + 1)
        w = np.where(np.isnan(deeper), 1.0, self.weight[at])
        return np.where(seen, w * own + (1 - w) * np.nan_to_num(deeper), deeper)


def leaves(gram: np.ndarray, n: np.ndarray, depth: int) -> Nodes:
    """The deepest nodes, of grams that were learned n > 0 times."""
    context, byte = gram >> 8, gram & 0xFF
    keys, zeros, ones = [], [], []
    for k in range(8):
        keys.append(context << 8 | 1 << k | byte >> (8 - k))
        bit = (byte >> (7 - k) & 1).astype(bool)
        zeros.append(np.where(bit, 0, n))
        ones.append(np.where(bit, n, 0))
    key, place = np.unique(np.concatenate(keys), return_inverse=True)
    return Nodes(key, *(np.bincount(place, np.concatenate(x), len(key)) for x in (zeros, ones)), None)


def tree(gram: np.ndarray, n: np.ndarray, depth: int, least: int) -> list[Nodes]:
    """Nodes from the deepest to those of depth least, of grams that hold the whole contexts of that depth."""
    learned = n > 0
    out = [leaves(gram[learned], n[learned], depth)]
    for _ in range(depth - least):
        out.append(Nodes(*out[-1].parents()))
    return out


def log10_of(gram: np.ndarray, levels: list[Nodes], depth: int) -> np.ndarray:
    """log10 of the weighted probability of each gram's byte; levels from the deepest to depth 0.

    A context that was never seen has nothing to say: the mixture is over those that were. Without any, a bit has 1/2.
    """
    context, byte = gram >> 8, gram & 0xFF
    out = np.zeros(len(gram))
    for k in range(8):
        node, bit = 1 << k | byte >> (8 - k), (byte >> (7 - k) & 1).astype(bool)
        p = np.full(len(gram), np.nan)
        for up, level in enumerate(levels):
            p = level.mixed(context >> (8 * up) << 8 | node, bit, p)
        out += np.log10(np.where(np.isnan(p), 0.5, p))
    return out


def _packed(batch: pa.RecordBatch) -> bytes:
    """A batch as compressed bytes: a block's texts are shuffled once, at a quarter of the size that the shuffle's own compression leaves."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(packed: pa.Array | pa.ChunkedArray) -> Iterator[pa.RecordBatch]:
    for one in packed:
        yield from pa.ipc.open_stream(one.as_buffer())


def _in_blocks(docs: DataFrame, id_col: str, text_col: str, learn: Column) -> DataFrame:
    """(block, rows, learned): packed rows (id, text, learn), texts null-free, and how many of them are learned. Blocks are runs of rows as they are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = TaskContext.get().partitionId() << 33, 0
        for batch in batches:
            numbers, packs = [], []
            for n in pa.compute.binary_length(batch.column(1)).to_pylist():
                if held and held + n > BLOCK_BYTES:
                    block, held = block + 1, 0
                held += n + 1
                numbers.append(block)
                packs.append((block, held // PACK_BYTES))
            for a, b in _same(np.array(packs, np.int64).reshape(-1, 2)):
                part = batch.slice(a, b - a)
                learned = pa.compute.sum(part.column(2)).as_py() or 0
                yield pa.RecordBatch.from_arrays([pa.array([numbers[a]], pa.int64()), pa.array([_packed(part)], pa.binary()), pa.array([int(learned)], pa.int64())], ["block", "rows", "learned"])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    return rows.mapInArrow(run, "block long, rows binary, learned long")


def _same(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of equal values, or rows."""
    differ = values[1:] != values[:-1]
    differ = differ.any(1) if values.ndim > 1 else differ
    cuts = [0, *(np.flatnonzero(differ) + 1).tolist(), len(values)] if len(values) else [0]
    yield from zip(cuts, cuts[1:], strict=False)


def _asked(depth: int):
    """From (block, rows) to (block, gram, word, n): what a block asks for, and how often it was learned there; word null for a gram."""

    def put(block: int, grams: list, words: Counter) -> pa.RecordBatch:
        gram, n = _summed(grams)
        word, times = list(words), list(words.values())
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(gram) + len(word), block)), pa.concat_arrays([pa.array(gram), pa.nulls(len(word), pa.int64())]),
                pa.concat_arrays([pa.nulls(len(gram), pa.binary()), pa.array(word, pa.binary())]), pa.concat_arrays([pa.array(n.astype(np.int64)), pa.array(times, pa.int64())]),
            ],
            ["block", "gram", "word", "n"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, grams, words = None, [], Counter()
        for batch in batches:
            for a, b in _same(batch.column(0).to_numpy()):
                if batch.column(0)[a].as_py() != block:
                    if block is not None:
                        yield put(block, grams, words)
                        pa.default_memory_pool().release_unused()
                    block, grams, words = batch.column(0)[a].as_py(), [], Counter()
                for rows in _unpacked(batch.column(1).slice(a, b - a)):
                    for learn in (True, False):
                        part = rows.filter(rows.column(2) if learn else pa.compute.invert(rows.column(2)))
                        for _, _, data, offsets in pieces(part):
                            found = Windows(data, offsets, depth).distinct()
                            grams += found if learn else [(g, np.zeros_like(n)) for g, n in found]
                            if sum(len(g) for g, _ in grams[1:]) > MERGED:
                                grams = [_summed(grams)]
                            raw, ends = _LOWER[data].tobytes(), offsets.tolist()
                            for s, e in zip(ends, ends[1:], strict=False):
                                words.update(raw[s:e].split() if learn else dict.fromkeys(raw[s:e].split(), 0))
        if block is not None:
            yield put(block, grams, words)

    return run


def _groups(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(gram, n) of sorted rows, in parts that hold whole contexts of SPLIT bytes."""
    shift, gram, n = 8 * (depth + 1 - SPLIT), np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        gram, n = (np.concatenate([x, batch.column(i).to_numpy()]) for i, x in enumerate((gram, n)))
        if len(gram) > GROUP:
            cut = int(np.searchsorted(gram, gram[-1] >> shift << shift))
            if cut:
                yield gram[:cut], n[:cut]
                gram, n = gram[cut:], n[cut:]
    if len(gram):
        yield gram, n


def _upper(grams: DataFrame, depth: int) -> list[Nodes]:
    """The nodes of contexts of two bytes, one and none: 65 536 times 255 rows at most, whatever the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for gram, n in _groups(batches, depth):
            key, zeros, ones, below = tree(gram, n, depth, SPLIT)[-1].parents()
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(zeros), pa.array(ones), pa.array(below)], ["key", "zeros", "ones", "below"])

    parts = grams.mapInArrow(run, "key long, zeros double, ones double, below double")
    told = parts.groupBy("key").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("below").alias("below")).toArrow()
    key, zeros, ones, below = (told.column(i).to_numpy() for i in range(4))
    order = np.argsort(key)
    out = [Nodes(key[order], zeros[order], ones[order], below[order])]
    for _ in range(SPLIT - 1):
        out.append(Nodes(*out[-1].parents()))
    return out


def _answers(grams: DataFrame, depth: int) -> DataFrame:
    """(gram, value): log10 of the probability of each gram's byte."""
    together = grams.repartition(F.shiftright("gram", 8 * (depth + 1 - SPLIT))).sortWithinPartitions("gram")
    above = grams.sparkSession.sparkContext.broadcast(_upper(together, depth))  # of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for gram, n in _groups(batches, depth):
            told = log10_of(gram, [*tree(gram, n, depth, SPLIT), *above.value], depth)
            yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(told)], ["gram", "value"])

    return together.mapInArrow(run, "gram long, value double")


def _scorer(depth: int, total: int, kinds: int, ends: int):
    """Scores a block's rows by what it was given: total tokens that were learned, their kinds, and how many of them are ends."""

    def score(rows: pa.Table, given: pa.Table) -> pa.Table:
        is_word = given.column("word").is_valid()
        counts, values = given.select(["word", "n"]).filter(is_word), given.select(["gram", "value"]).filter(pa.compute.invert(is_word))
        times = np.append(counts.column("n").to_numpy(), ends)  # the end's place is -1
        place = dict(zip(counts.column("word").to_pylist(), range(len(times) - 1), strict=True))
        log = np.log10((times + SMOOTH) / (total + SMOOTH * (kinds + 1)))
        gram, first = np.unique(values.column("gram").to_numpy(), return_index=True)
        value, gram = values.column("value").to_numpy()[first].astype(float), pd.Index(gram)
        del counts, values, first, is_word
        out = []
        for batch in _unpacked(rows.column("rows")):
            for a, b, data, offsets in pieces(batch):
                raw, ends_at = _LOWER[data].tobytes(), offsets.tolist()
                met: list[int] = []
                stops = [0]
                for s, e in zip(ends_at, ends_at[1:], strict=False):
                    met += [place[w] for w in raw[s:e].split()]
                    met.append(-1)
                    stops.append(len(met))
                met = np.array(met)
                base, known = (np.add.reduceat(x, stops[:-1]) for x in (log[met], (times[met] > 0).astype(np.int64)))
                own = [batch.column(batch.schema.get_field_index(c)).slice(a, b - a) for c in ("id", "learn")]
                made = [pa.array(np.diff(offsets)), pa.array(np.diff(stops)), pa.array(known), pa.array(base), pa.array(Windows(data, offsets, depth).sums(gram, value))]
                out.append(pa.RecordBatch.from_arrays([*own, *made], ["id", "learn", "n_bytes", "n_tokens", "n_known", "base_score", "score"]))
        pa.default_memory_pool().release_unused()  # what a worker holds on to, others lack
        return pa.Table.from_batches(out)

    return score


def scores(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH) -> DataFrame:
    """(id, learn, n_bytes, n_tokens, n_known, train_tokens, base_score, score), one row per row of docs.

    Rows where `learn` is true are learned from; null is false. Texts are whole, A-Z in lower case; null is empty.
    score is log10 of the weighted probability of the text's UTF-8 bytes and its end, each given the `depth` bytes (3 to
    6) before it; -score * log2(10) / (n_bytes + 1) is the code length of a byte. base_score is that of the words and an
    end, each by its own frequency (0.1 added to each count). Without rows to learn from, every bit has probability
    1/2. Repeated rows are learned as often as they stand and get a score each; null ids stay; empty docs give no rows.
    The result is staged.
    """
    if not SPLIT <= depth <= 6:
        raise ValueError("depth is 3 to 6")
    scratch, kind = Scratch(docs.sparkSession, "context-tree"), docs.schema[id_col].dataType.simpleString()
    texts = scratch.stage(_in_blocks(docs, id_col, text_col, learn))
    asked = scratch.stage(texts.select("block", "rows").mapInArrow(_asked(depth), "block long, gram long, word binary, n long"))
    gram_asked, word_asked = asked.where("word IS NULL").select("block", "gram", "n"), asked.where("word IS NOT NULL").select("block", "word", "n")
    grams = scratch.stage(gram_asked.groupBy("gram").agg(F.sum("n").alias("n")))
    words = scratch.stage(word_asked.groupBy("word").agg(F.sum("n").alias("n")))
    told = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(F.col("n") > 0).alias("v")).first()
    ends = texts.agg(F.coalesce(F.sum("learned"), F.lit(0))).first()[0]
    total, kinds = told["n"] + ends, told["v"] + (ends > 0)
    # A gram's answer goes to its blocks as a float, at half the bytes: it is off by less than a millionth.
    given_grams = gram_asked.select("block", "gram").join(_answers(grams, depth), "gram").select("block", "gram", F.lit(None).cast("binary").alias("word"), F.col("value").cast("float").alias("value"), F.lit(None).cast("long").alias("n"))
    given_words = word_asked.select("block", "word").join(words, "word").select("block", F.lit(None).cast("long").alias("gram"), "word", F.lit(None).cast("float").alias("value"), "n")

    score = _scorer(depth, total, kinds, ends)
    given = given_grams.unionByName(given_words)
    told_rows = texts.select("block", "rows").groupBy("block").cogroup(given.groupBy("block")).applyInArrow(score, f"id {kind}, learn boolean, n_bytes long, n_tokens long, n_known long, base_score double, score double")
    done = stage(told_rows.withColumn("train_tokens", F.lit(total).cast("long")), "context-tree-scores")
    scratch.clear()
    return done


def digest(docs: DataFrame) -> DataFrame:
    """op13's columns for documents, and n_bytes. Rows with a null doc_id are learned from."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False))
    rows = scores(docs, ~held_out)
    return rows.select(F.col("id").alias("doc_id"), (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes")
