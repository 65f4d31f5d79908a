"""Approximate nearest neighbours by a forest of hash prefixes.

The rows are dealt into shards of bounded size by hash. A shard holds, for each tree, the sorted array of its rows'
hash strings (signs of random projections). A query goes down each tree to the longest prefix that it shares with a
row, and then up all trees together, until the ranges under its prefixes hold enough hits; rows that are hit in clearly
more trees than a row is on average are candidates and compared exactly. Every query visits every shard, in blocks, and
the shards' best are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Trees, rows of a shard in expectation, hits asked of all trees together for each row of a shard, and by how many
#: standard deviations a candidate's hits are above the mean. This is for vectors without structure, where neighbours
#: are hardly nearer than others: recall of 0.96 to 0.99 on the given tables, with 8 to 10 % of the rows compared.
TREES, SHARD_ROWS, REACH, ABOVE = 256, 32_768, 8.0, 2.0
SEED = 11
BITS = 32


class Forest:
    """Rows of one length; each has a place of its own, so that rows of equal ids are told apart."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, trees: int = TREES, seed: int = SEED):
        self.order_of = np.argsort(ids, kind="stable")
        self.ids, self.vectors, self.trees = ids[self.order_of], vectors[self.order_of], trees
        self.planes = np.random.default_rng(seed).standard_normal((trees, vectors.shape[1] if vectors.ndim == 2 else 0, BITS))
        self.squares = squares(self.vectors)
        self.unit = self.vectors / np.sqrt(self.squares)[:, None]
        self.keys, self.order = np.empty((trees, len(ids)), np.uint32), np.empty((trees, len(ids)), np.int32)
        for t, keys in enumerate(self.hashes(self.unit)):
            self.order[t] = np.argsort(keys, kind="stable")
            self.keys[t] = keys[self.order[t]]

    def hashes(self, vectors: np.ndarray) -> Iterator[np.ndarray]:
        """Of each tree, the rows' strings."""
        for p in self.planes:
            yield np.packbits(vectors @ p > 0, axis=1).view(">u4").ravel().astype(np.uint32)

    def ranges(self, keys: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """trees x queries: where the rows that share so many first bits with a query begin and end."""
        rest = ((np.uint64(1) << (BITS - bits).astype(np.uint64)) - np.uint64(1)).astype(np.uint32)
        lo, hi = np.empty(keys.shape, np.int64), np.empty(keys.shape, np.int64)
        for t in range(self.trees):
            lo[t] = np.searchsorted(self.keys[t], keys[t] & ~rest, "left")
            hi[t] = np.searchsorted(self.keys[t], keys[t] | rest, "right")
        return lo, hi

    def reached(self, keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ranges of the longest prefixes, as long in every tree, that hold as many rows as asked; found by halving, as they only grow on the way up."""
        low, high = np.zeros(keys.shape[1], np.int64), np.full(keys.shape[1], BITS + 1)  # low is enough, high is not
        while (high - low > 1).any():
            bits = (low + high) // 2
            lo, hi = self.ranges(keys, bits)
            full = ((hi - lo).sum(0) >= asked) & (bits < BITS + 1)
            low, high = np.where(full, bits, low), np.where(full, high, bits)
        return self.ranges(keys, low)

    def candidates(self, vectors: np.ndarray, own: np.ndarray, k: int, reach: float = REACH) -> Iterator[np.ndarray]:
        """For each query the rows to compare; own is its own place, or -1."""
        asked = max(8 * k, int(reach * len(self.ids))) + self.trees * (own >= 0)  # a query's own row is in all its ranges
        lo, hi = self.reached(np.stack(list(self.hashes(vectors))), asked)
        for n in range(len(vectors)):
            hits = np.bincount(np.concatenate([self.order[t, lo[t, n] : hi[t, n]] for t in range(self.trees)]), minlength=len(self.ids))
            if own[n] >= 0:
                hits[own[n]] = -1
            mean = hits.mean()
            some = np.flatnonzero(hits >= mean + ABOVE * np.sqrt(max(mean, 0.0)))
            yield some if len(some) >= 8 * k else np.flatnonzero(hits >= 0)  # few rows, or all alike: no telling them apart

    def search(self, vectors: np.ndarray, own: np.ndarray, k: int, reach: float = REACH) -> Iterator[tuple[int, int, float]]:
        """(query's place among vectors, row id, score) of the k best of each query among the candidates; ties to the smaller id."""
        sq = squares(vectors)
        unit = vectors / np.sqrt(sq)[:, None]
        for n, some in enumerate(self.candidates(unit, own, k, reach)):
            if not len(some):
                continue
            near = self.unit[some] @ unit[n]
            if len(some) > k:  # all that may tie with the k-th, then exactly
                some = some[near >= np.partition(near, len(near) - k)[len(near) - k] - 1e-9]
            exact = cosine(self.vectors[some], self.squares[some], vectors[n], sq[n])
            best = np.lexsort((self.ids[some], -exact))[:k]
            yield from ((n, int(self.ids[some[b]]), float(exact[b])) for b in best)


def _sum(x: np.ndarray) -> np.ndarray:
    """Row sums, term by term from the left, so that equal rows have equal sums everywhere."""
    return np.add.accumulate(x, axis=1)[:, -1] if x.shape[1] else np.zeros(len(x))


def squares(x: np.ndarray) -> np.ndarray:
    return _sum(x * x)


def cosine(x: np.ndarray, xx: np.ndarray, y: np.ndarray, yy: float) -> np.ndarray:
    return np.clip(_sum(x * y) / (np.sqrt(xx) * np.sqrt(yy)), -1.0, 1.0)


def usable(vector: Column) -> Column:
    """Not null, not zero, all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def nearest(rows: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", trees: int = TREES, shard_rows: int = SHARD_ROWS, reach: float = REACH) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row with is_query (on the column id), by cosine in double precision.

    No part take: null ids; vectors null, zero or with a null or non-finite component. Vectors of another length than
    the query's are no candidates. Each row counts: rows that repeat an id, or id and vector, are candidates of their
    own, and each is a query of its own if its id is one. Fewer than k other rows: all of them. Ties go to the smaller id.
    """
    vector = F.col(vector_col).cast("array<double>")
    valid = rows.select(F.col(id_col).cast("long").alias("id"), vector.alias("v")).where(F.col("id").isNotNull() & usable(F.col("v"))).withColumn("dim", F.size("v"))
    # A row's number among those of its id and vector tells it from its repeats.
    valid = valid.withColumn("key", F.xxhash64("id", "v", F.row_number().over(Window.partitionBy("id", "v").orderBy("id"))))
    shards = valid.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("shards"))  # a row for each length
    dealt = valid.join(F.broadcast(shards), "dim")
    index = dealt.select("dim", F.pmod(F.col("key"), F.col("shards")).cast("int").alias("shard"), F.lit(0).alias("part"), "id", "key", "v")
    asked = dealt.where(is_query).select("dim", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), F.lit(1).alias("part"), "id", "key", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, forest = None, [], None
        for batch in batches:
            dim, s, part, ids, keys = (batch.column(i).to_numpy() for i in range(5))
            at = np.flatnonzero(np.r_[True, (np.diff(dim) != 0) | (np.diff(s) != 0) | (np.diff(part) != 0)]) if len(s) else []
            for a, b in zip(at, [*at[1:], len(s)], strict=True):
                if (dim[a], s[a]) != shard:
                    shard, held, forest = (dim[a], s[a]), [], None
                v = np.asarray(batch.column(5).slice(a, b - a).flatten().to_numpy(), np.float64).reshape(-1, dim[a])
                if part[a] == 0:
                    held.append((ids[a:b], keys[a:b], v))
                    continue
                if not held and forest is None:  # no row fell into this shard
                    continue
                if forest is None:
                    rows_, keys_, vectors = (np.concatenate([h[i] for h in held]) for i in range(3))
                    forest, held = Forest(rows_, vectors, trees), []
                    place = {(int(rows_[j]), int(keys_[j])): i for i, j in enumerate(forest.order_of.tolist())}
                own = np.array([place.get(x, -1) for x in zip(ids[a:b].tolist(), keys[a:b].tolist(), strict=True)])
                found = list(forest.search(v, own, k, reach))
                if found:
                    q, r, x = zip(*found, strict=True)
                    q = a + np.array(q)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(keys[q]), pa.array(r, pa.int64()), pa.array(x, pa.float64())], ["query_id", "key", "vec_id", "score"])

    rows_ = index.unionByName(asked).repartition("dim", "shard").sortWithinPartitions("dim", "shard", "part")
    found = rows_.mapInArrow(run, "query_id long, key long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def digest(embeddings: DataFrame) -> DataFrame:
    """op3's columns for embeddings."""
    return nearest(embeddings, F.col("id") % 50 == 0)
