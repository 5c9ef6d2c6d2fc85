"""Approximate nearest neighbours by a hash-prefix forest.

Each tree gives every vector a string of 32 hash bits (signs of random projections) and is the sorted array of them. A
query descends in each tree to its longest-prefix match; from the deepest of these all trees ascend together, a bit at
a time, until the subtrees hold as many entries as `share` of the block's vectors and k for each tree; the vectors met
are ranked by the exact inner product. Vectors of any norm get one more component that evens them out, so that the largest inner
product is the smallest angle.

Equal vectors are one class: only the k + 1 least ids of a class can be among the k nearest of anyone, and equal
queries are searched once. Classes are dealt into blocks of bounded size, each moved once and indexed once; the stated
query set then streams past every block's sorted arrays in batches, so a task holds one block and one batch.

Uniform random vectors, as in the test tables, have no near neighbours to speak of: a recall of 0.9 takes two fifths of
all vectors as candidates. `trees` and `share` are the price; on clustered vectors a small share will do.

Defined cases: vectors null, zero, empty, or holding null or non-finite components take no part, nor do null ids, nor
vectors of another length than most (ties: the longer); of several vectors of one id the least counts; ties of score
go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

BITS = 32


def planes(size: int, trees: int) -> np.ndarray:
    return np.random.default_rng(20240917).standard_normal((size, trees * BITS)).astype(np.float32)


def strings(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Hash strings (row, tree) as 32-bit numbers."""
    bits = (x.astype(np.float32) @ p) > 0
    return np.packbits(bits.reshape(len(x), -1, BITS), axis=2).view(">u4")[:, :, 0].astype(np.uint32)


class Forest:
    """Of each tree a sorted array of strings, and whose they are."""

    def __init__(self, codes: np.ndarray):
        self.order = np.ascontiguousarray(np.argsort(codes, axis=0, kind="stable").astype(np.int32).T)
        self.sorted = np.take_along_axis(np.ascontiguousarray(codes.T), self.order, 1).astype(np.uint64)

    def subtrees(self, codes: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(low, high) of the entries that share `depth` leading bits, by tree and query."""
        cut = (BITS - depth).astype(np.uint64)
        base = (codes >> cut) << cut
        above = base + (np.uint64(1) << cut)
        low = np.stack([np.searchsorted(s, b) for s, b in zip(self.sorted, base)])
        return low, np.stack([np.searchsorted(s, b) for s, b in zip(self.sorted, above)])

    def search(self, codes: np.ndarray, enough: float) -> tuple[np.ndarray, np.ndarray]:
        """Of each query the subtrees where the common ascent stops: the greatest depth at which they hold enough.

        The descent to the longest match of each tree bounds it; as entries only grow on the way up, the level is
        found by halving."""
        codes = np.ascontiguousarray(codes.T).astype(np.uint64)
        rows = self.sorted.shape[1]
        at = np.stack([np.searchsorted(s, c) for s, c in zip(self.sorted, codes)])
        near = np.minimum(*[np.take_along_axis(self.sorted, np.clip(at - d, 0, rows - 1), 1) ^ codes for d in (0, 1)])
        longest = BITS - np.ceil(np.log2(near.astype(np.float64) + 1)).astype(np.int64)
        high = longest.max(0, initial=0)
        low = np.zeros_like(high)
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_] + 1) // 2
            a, b = self.subtrees(codes[:, open_], mid)
            held = (b - a).sum(0) >= enough
            low[open_] = np.where(held, mid, low[open_])
            high[open_] = np.where(held, high[open_], mid - 1)
        return self.subtrees(codes, low)


def vectors_of(embeddings: DataFrame) -> DataFrame:
    """vec_id, v, key of the vectors that take part."""
    e = F.col("embedding").cast("array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("v")).where("vec_id is not null and size(v) > 0")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = rows.where(~F.exists("v", bad)).where(F.exists("v", lambda x: x != 0))
    rows = rows.groupBy("vec_id").agg(F.min("v").alias("v"))
    return rows.withColumn("key", F.sha2(F.col("v").cast("string"), 256))


def nearest(embeddings: DataFrame, k: int = 20, every: int = 20, trees: int = 128, share: float = 0.2, block: int = 16384) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found of every vec_id that `every` divides."""
    rows = vectors_of(embeddings)
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    dims = sizes["n"] if sizes else 1
    rows = stored(rows.where(F.size("v") == dims))
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    longest, n = rows.agg(F.max(norm), F.count("*")).first()
    few = Window.partitionBy("key").orderBy("vec_id")
    ids = rows.withColumn("n", F.row_number().over(few)).where(F.col("n") <= k + 1)
    classes = ids.groupBy("key").agg(F.first("v").alias("v"), F.array_sort(F.collect_list("vec_id")).alias("ids"))  # k + 1 ids at most
    asked = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "key", "v")
    queries = asked.groupBy("key").agg(F.first("v").alias("v"))
    blocks = max(1, -(-int(n or 0) // block))
    deal = F.pmod(F.xxhash64("key", F.lit(blocks)), F.lit(blocks)).cast("int")
    none = F.lit(None).cast("array<long>")
    index = classes.select(deal.alias("block"), F.lit(0).alias("kind"), "key", "v", "ids")
    visits = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), "key", "v", none.alias("ids"))
    # of each block first the classes, then the queries that pass them; more partitions than blocks, so few share one
    dealt = index.unionByName(visits).repartition(4 * blocks, "block").sortWithinPartitions("block", "kind", "key")

    def matrix(column) -> np.ndarray:
        flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
        return flat.to_numpy(zero_copy_only=False).reshape(-1, dims)

    p = planes(dims + 1, trees)
    # the products of two single-precision vectors are off by no more than this, either way
    off = (dims + 2) * 2.0**-23 * float(longest or 0)

    class Block:
        """The classes of a block, indexed."""

        def __init__(self, parts: list[pa.RecordBatch]):
            held = pa.Table.from_batches(parts)
            self.x, self.owners = matrix(held.column("v")), held.column("ids").to_pylist()
            self.x32 = self.x.astype(np.float32)
            spare = np.sqrt(np.maximum((longest or 0) - (self.x * self.x).sum(1), 0))
            self.forest = Forest(strings(np.column_stack([self.x, spare]), p))
            self.least = np.array([o[0] for o in self.owners])

        def nearest(self, batch: pa.RecordBatch) -> pa.RecordBatch:
            out: dict[str, list] = {"key": [], "vec_id": [], "score": []}
            q, keys = matrix(batch.column("v")), batch.column("key").to_pylist()
            low, high = self.forest.search(strings(np.column_stack([q, np.zeros(len(q))]), p), share * len(self.x) + k * trees)
            for i in range(len(q)):
                met = np.zeros(len(self.x), bool)
                met[np.concatenate([o[a:b] for o, a, b in zip(self.forest.order, low[:, i], high[:, i])])] = True
                met = np.flatnonzero(met)
                if len(met) > 4 * (k + 1):  # in single precision, whoever may be among the best
                    rough = np.take(self.x32, met, 0) @ q[i].astype(np.float32)
                    top = np.partition(rough, len(met) - k - 1)[len(met) - k - 1]
                    met = met[rough >= top - off]
                score = np.einsum("ij,j->i", self.x[met], q[i])
                best = np.lexsort((self.least[met], -score))[: k + 1]
                flat = sorted((-score[b], v) for b in best for v in self.owners[met[b]])[: k + 1]
                out["key"] += [keys[i]] * len(flat)
                out["vec_id"] += [v for _, v in flat]
                out["score"] += [-s for s, _ in flat]
            return pa.RecordBatch.from_arrays([pa.array(out["key"], pa.string()), pa.array(out["vec_id"], pa.int64()), pa.array(out["score"], pa.float64())], names=list(out))

    def run(batches):
        now, parts, indexed = None, [], None
        for whole in batches:
            runs = whole.column("block").to_numpy() * 2 + whole.column("kind").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(runs)) + 1).tolist(), whole.num_rows]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                part = whole.slice(a, b - a)
                if (at := int(runs[a]) // 2) != now:
                    now, parts, indexed = at, [], None
                if runs[a] % 2 == 0:
                    parts.append(part)
                elif parts or indexed:  # a block may have no class
                    indexed = indexed or Block(parts)
                    parts = []
                    yield indexed.nearest(part)

    found = dealt.mapInArrow(run, "key string, vec_id long, score double")
    best = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).drop("n")
    own = asked.select("query_id", "key").join(found, "key").where("query_id <> vec_id")
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return own.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def report(embeddings: DataFrame) -> DataFrame:
    """The digest of the contract."""
    return nearest(embeddings)
