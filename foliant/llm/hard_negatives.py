"""Hard negatives by dual-tree search.

Anchors and candidates are hung into one binary tree, whose splits are learned from a bounded sample (`sample`) and into
which every row goes. Each node knows, over all its rows, the greatest distance to its centre and the greatest norm:
for a pair of nodes that gives an interval which holds every inner product between them. Pairs descend together from the
root, three levels at a time, as joins of nodes with their children; a pair whose interval rules it out goes with its
whole group of anchors. Pairs of leaves are scored exactly, first the most promising of each group of anchors, then
those whose interval still reaches what that found.

Positives descend by label (nodes of one label only), negatives through mixed nodes, as far as their interval meets the
band below the group's positives. Rows are cut into blocks of bounded size in the order of (label, leaf, hash), so a
label, a leaf or a group of copies of any size is many blocks; blocks that many anchors visit are dealt to several
tasks. All tables of nodes are joined, none is sent whole; only the splits and centres are (`MOST_BYTES`).

Uniform vectors have loose intervals, so few pairs go there; clustered ones lose most. Results are exact either way.

Defined cases: rows with a null id, label or vector, a null or non-finite component, or a vector of another length than
most (ties: the longer) take no part; of several rows of one id the least (label, vector) counts; scores are 64-bit, and
vectors whose products could be more are an error; an anchor without positives, or a positive without negatives, gives
no rows; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import release, stored

#: Rows of a block of candidates and of anchors, anchor blocks that one task scores against a block, levels a step.
CANDIDATES, ANCHORS, VISITS, STEP = 4096, 256, 64, 3
#: Levels of the tree at most, and bytes of its splits and centres.
DEPTH, MOST_BYTES = 12, 32 << 20


def rows_of(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label, v: the rows that take part, relabelled, their components as whole numbers."""
    e = F.col("embedding").cast("array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), e.alias("e"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = rows.where("vec_id is not null and label is not null and size(e) > 0").where(~F.exists("e", bad))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    v = F.transform("e", lambda x: F.floor(x * scale))
    return rows.select("vec_id", F.struct(label.alias("label"), v.alias("v")).alias("r")).groupBy("vec_id").agg(F.min("r").alias("r")).select("vec_id", "r.label", "r.v")


def parted(x: np.ndarray, centre: np.ndarray, rounds: int = 6) -> tuple[np.ndarray, float]:
    """Direction and threshold between two clusters of x: two far points, drawn to the means of those nearer to each."""
    if not len(x):
        return np.zeros(len(centre)), 0.0
    one = x[np.argmax(((x - centre) ** 2).sum(1))]
    two = x[np.argmax(((x - one) ** 2).sum(1))]
    for _ in range(rounds):
        near = x @ (one - two) > (one @ one - two @ two) / 2
        if near.all() or not near.any():
            break
        one, two = x[near].mean(0), x[~near].mean(0)
    return one - two, float(one @ one - two @ two) / 2


class Tree:
    """Splits of a binary tree (a direction and a threshold for each inner node) and the centres of all nodes, by heap
    order: the children of i are 2i and 2i + 1."""

    def __init__(self, x: np.ndarray, depth: int):
        n = 1 << depth
        self.depth = depth
        self.split, self.at = np.zeros((n, x.shape[1])), np.zeros(n)
        self.centre = np.zeros((2 * n, x.shape[1]))
        members = {1: np.arange(len(x))}
        for i in range(1, 2 * n):
            own = members.pop(i)
            self.centre[i] = x[own].mean(0) if len(own) else self.centre[i // 2]
            if i < n:
                self.split[i], self.at[i] = parted(x[own], self.centre[i])
                along = x[own] @ self.split[i]
                members[2 * i], members[2 * i + 1] = own[along <= self.at[i]], own[along > self.at[i]]

    def leaves(self, x: np.ndarray) -> np.ndarray:
        node = np.ones(len(x), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (np.einsum("ij,ij->i", x, self.split[node]) > self.at[node])
        return node


def steps(depth: int) -> list[int]:
    return [*range(0, depth, STEP), depth]


def grow(rows: DataFrame, n: int, dims: int, sample: int) -> Tree:
    """The tree, from at most `sample` rows of the least hashed ids (as many as fit MOST_BYTES)."""
    most = max(1, min(sample, MOST_BYTES // (8 * dims)))
    table = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).select("v").toArrow()
    x = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.float64)
    fits = max(1, MOST_BYTES // (24 * dims))
    depth = int(np.clip(np.ceil(np.log2(max(1, n / CANDIDATES))), 0, min(DEPTH, np.log2(max(1, len(x) / 8)), np.log2(fits))))
    return Tree(x, depth)


def blocks(rows: DataFrame, tree, size: int, n: int, dims: int, kind: str, by_label: bool) -> DataFrame:
    """block, grp, leaf, n, reach (distance to the centre of each step's node), peak (norm), low and high of the
    anchors' bands, ids, labels, x, and the packed positives: rows of one group and leaf, at most `size` of them."""
    names = rows.columns

    def place(batches):
        for b in batches:
            x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            for at in range(0, len(x), 4096):  # splits of 4,096 rows at a time
                part = b.slice(at, 4096)
                leaf = tree.value.leaves(x[at : at + 4096].astype(np.float64))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(leaf)], names=[*names, "leaf"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    placed = rows.mapInArrow(place, schema + ", leaf long").withColumn("grp", F.col("label") if by_label else F.lit(0).cast("long"))
    key = ["grp", "leaf", F.xxhash64("vec_id")]
    dealt = placed.repartitionByRange(max(1, -(-n // (2 * size))), *key).sortWithinPartitions(*key)
    wide = "positives" in names

    def pack(batches):
        from pyspark import TaskContext

        t, seq = tree.value, TaskContext.get().partitionId() << 24
        held: list[pa.RecordBatch] = []

        def out():
            nonlocal seq, held
            table = pa.Table.from_batches(held).combine_chunks()
            held = []
            x = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            leaf, grp = table.column("leaf")[0].as_py(), table.column("grp")[0].as_py()
            wide_x = x.astype(np.float64)
            reach = [float(np.sqrt(((wide_x - t.centre[leaf >> (t.depth - d)]) ** 2).sum(1).max())) for d in steps(t.depth)]
            peak = float(np.sqrt((wide_x**2).sum(1).max()))
            low = high = None
            pos = b""
            if wide:
                of = table.column("positives").to_pylist()
                flat = np.array([[i, p["vec_id"], p["score"]] for i, row in enumerate(of) for p in row], np.int64).reshape(-1, 3)
                pos, low, high = flat.tobytes(), int(flat[:, 2].min()), int(flat[:, 2].max())
                low = -(-80 * low // 100)
            seq += 1
            cells = [[seq], [grp], [leaf], [len(x)], [reach], [peak], [low], [high], [table.column("vec_id").to_numpy().tobytes()], [table.column("label").to_numpy().tobytes()], [np.ascontiguousarray(x.astype(kind)).tobytes()], [pos]]
            types = [pa.int64()] * 4 + [pa.list_(pa.float64()), pa.float64(), pa.int64(), pa.int64()] + [pa.binary()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, types)], names=["block", "grp", "leaf", "n", "reach", "peak", "low", "high", "ids", "labels", "x", "positives"])

        now, have = None, 0
        for b in batches:
            keys = np.stack([b.column("grp").to_numpy(), b.column("leaf").to_numpy()])
            edges = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(edges, edges[1:]):
                if lo == hi:
                    continue
                if held and now != (keys[0, lo], keys[1, lo]):
                    yield out()
                    have = 0
                now = (keys[0, lo], keys[1, lo])
                while lo < hi:
                    take = min(hi - lo, size - have)
                    held.append(b.slice(lo, take))
                    lo, have = lo + take, have + take
                    if have == size:
                        yield out()
                        have = 0
        if held:
            yield out()
        release()

    packed = "block long, grp long, leaf long, n long, reach array<double>, peak double, low long, high long, ids binary, labels binary, x binary, positives binary"
    return stored(dealt.mapInArrow(pack, packed))


def nodes(b: DataFrame, tree: Tree, step: int, side: str) -> DataFrame:
    """Nodes of a step's level over a table of blocks: all their rows, radius, greatest norm, band."""
    below = tree.depth - steps(tree.depth)[step]
    node = F.shiftright("leaf", below)
    out = b.groupBy("grp", node.alias(f"{side}")).agg(F.sum("n").alias(f"{side}_n"), F.max(F.get("reach", F.lit(step))).alias(f"{side}_r"), F.max("peak").alias(f"{side}_p"), F.min("low").alias(f"{side}_low"), F.max("high").alias(f"{side}_high"))
    up = STEP if step and step < len(steps(tree.depth)) - 1 else tree.depth - steps(tree.depth)[step - 1] if step else 0
    return out.withColumn(f"{side}_up", F.shiftright(side, up))


def intervals(pairs: DataFrame, sent) -> DataFrame:
    """pairs of nodes a and b with least and most: no inner product between their rows is outside."""

    def run(batches):
        for batch in batches:
            c = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in ("a", "b", "a_r", "b_r", "a_p", "b_p")}
            p, q = sent.value.centre[c["a"]], sent.value.centre[c["b"]]
            mid = np.einsum("ij,ij->i", p, q)
            off = np.sqrt((p**2).sum(1)) * c["b_r"] + np.sqrt((q**2).sum(1)) * c["a_r"] + c["a_r"] * c["b_r"]
            norm = c["a_p"] * c["b_p"]
            slack = 1 + 1e-9 * (np.abs(mid) + off + norm)  # rounding of all of this is far below
            most, least = np.minimum(mid + off, norm) + slack, np.maximum(mid - off, -norm) - slack
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least), pa.array(most)], names=[*batch.schema.names, "least", "most"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema)
    return pairs.mapInArrow(run, schema + ", least double, most double")


def descend(a: DataFrame, b: DataFrame, tree: Tree, sent, enough: int | None) -> DataFrame:
    """a, b (blocks), most: pairs of blocks that the descent of both trees leaves. enough: of how many partners the
    greatest are wanted; None: the band of the anchors is."""
    pairs = None
    for step in range(len(steps(tree.depth))):
        left, right = nodes(a, tree, step, "a"), nodes(b, tree, step, "b")
        if pairs is None:
            both = left.join(right, "grp")  # one node a group on each side
        else:
            both = pairs.select("grp", F.col("a").alias("a_up"), F.col("b").alias("b_up")).join(left, ["grp", "a_up"]).join(right, ["grp", "b_up"])
        met = intervals(both.drop("a_up", "b_up"), sent)
        if enough is None:
            pairs = met.where((F.col("most") >= F.col("a_low")) & (F.col("least") <= F.col("a_high")))
        else:  # so many candidates are at least that near to every anchor of the group
            so_far = F.sum("b_n").over(Window.partitionBy("grp", "a").orderBy(F.desc("least"), "b").rowsBetween(Window.unboundedPreceding, 0))
            met = met.withColumn("_bar", F.when(so_far > enough, F.col("least")))
            pairs = met.withColumn("_bar", F.max("_bar").over(Window.partitionBy("grp", "a"))).where("_bar is null or most >= _bar").drop("_bar")
        pairs = stored(pairs)
    own = lambda t, side: t.select("grp", F.col("leaf").alias(side), F.col("block").alias(f"{side}_block"))
    out = pairs.select("grp", "a", "b", "most").join(own(a, "a"), ["grp", "a"]).join(own(b, "b"), ["grp", "b"])
    return out.select(F.col("a_block").alias("a"), F.col("b_block").alias("b"), "most")


def array(cell, kind: str) -> np.ndarray:
    return np.frombuffer(cell.as_py(), kind)


def best_positives(anchors: dict, held: dict, scores: np.ndarray, k: int) -> list[tuple]:
    out = []
    for i, own in enumerate(anchors["ids"]):
        other = np.flatnonzero((held["labels"] == anchors["labels"][i]) & (held["ids"] != own))
        top = other[np.lexsort((held["ids"][other], -scores[i, other]))[:k]]
        out += [(int(own), None, None, int(held["ids"][j]), int(scores[i, j])) for j in top]
    return out


def best_negatives(anchors: dict, held: dict, scores: np.ndarray, k: int) -> list[tuple]:
    out = []
    of = anchors["positives"]
    begins = np.searchsorted(of[:, 0], np.arange(len(anchors["ids"]) + 1))
    for i, own in enumerate(anchors["ids"]):
        mine = of[begins[i] : begins[i + 1]]
        if not len(mine):
            continue
        low, high = -(-80 * int(mine[:, 2].min()) // 100), int(mine[:, 2].max())
        near = np.flatnonzero((held["labels"] != anchors["labels"][i]) & (scores[i] >= low) & (scores[i] <= high))
        near = near[np.lexsort((held["ids"][near], -scores[i, near]))]
        falling = -scores[i, near]
        for _, other, score in mine.tolist():
            first, last = np.searchsorted(falling, -score), np.searchsorted(falling, -(-(-80 * score // 100)), "right")
            out += [(int(own), other, score, int(held["ids"][j]), int(scores[i, j])) for j in near[first : min(first + k, max(first, last))]]
    return out


FOUND = "a long, anchor_id long, positive_id long, positive_score long, vec_id long, score long"


def scored(pairs: DataFrame, a: DataFrame, b: DataFrame, dims: int, kind: str, exact: str, k: int, best) -> DataFrame:
    """Of every pair of blocks the k best of each anchor (and positive). A block of candidates is read once in a task,
    then the blocks of anchors that visit it pass by."""
    visits = pairs.groupBy("b").agg(F.count("*").alias("_n"))
    deals = F.ceil(F.col("_n") / VISITS).cast("int")
    cargo = ["n", "ids", "labels", "x", "positives"]
    left = pairs.join(visits, "b").withColumn("deal", F.pmod(F.xxhash64("a"), deals).cast("int"))
    left = left.join(a.select(F.col("block").alias("a"), *cargo), "a").select("b", "deal", F.col("a").alias("visit"), *cargo)
    right = b.select(F.col("block").alias("b"), *cargo).join(visits.withColumn("deal", F.explode(F.sequence(F.lit(0), deals - 1))), "b").select("b", "deal", F.lit(None).cast("long").alias("visit"), *cargo)
    both = left.unionByName(right)
    tasks = max(int(both.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-b.count() // 4))
    both = both.repartition(tasks, "b", "deal").sortWithinPartitions("b", "deal", F.col("visit").asc_nulls_first())

    def run(batches):
        held = None
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r] for c in ("visit", *cargo)}
                block = {"ids": array(row["ids"], "i8"), "labels": array(row["labels"], "i8"), "x": array(row["x"], kind).reshape(-1, dims).astype(exact)}
                if row["visit"].as_py() is None:
                    held = block
                    continue
                block["positives"] = array(row["positives"], "i8").reshape(-1, 3)
                rows = best(block, held, (block["x"] @ held["x"].T).astype(np.int64), k)
                columns = list(zip(*[(row["visit"].as_py(), *x) for x in rows])) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "anchor_id", "positive_id", "positive_score", "vec_id", "score"])
        release()

    return both.mapInArrow(run, FOUND)


def search(a: DataFrame, b: DataFrame, tree: Tree, sent, dims: int, kind: str, exact: str, k: int, best, enough: int | None) -> DataFrame:
    """The k best of every anchor (and positive), with their rank."""
    pairs = stored(descend(a, b, tree, sent, enough))
    per = ["anchor_id", "positive_id"]
    first = Window.partitionBy("a").orderBy(F.desc("most"), "b")
    ordered = pairs.withColumn("_n", F.row_number().over(first))
    seeds = stored(scored(ordered.where("_n = 1").select("a", "b"), a, b, dims, kind, exact, k, best))
    # what a group of anchors has for certain: the least of their k-th best, once each of them has k
    wanted = a.select(F.col("block").alias("a"), (F.octet_length("positives") / 24 if enough is None else F.col("n")).cast("long").alias("_of"))
    full = seeds.groupBy("a", *per).agg(F.count("*").alias("_n"), F.min("score").alias("_bar")).where(F.col("_n") >= k).groupBy("a").agg(F.count("*").alias("_full"), F.min("_bar").alias("_bar"))
    bars = full.join(wanted, "a").where("_full = _of").select("a", "_bar")
    rest = ordered.where("_n > 1").join(bars, "a", "left").where("_bar is null or most >= _bar").select("a", "b")
    found = seeds.unionByName(scored(rest, a, b, dims, kind, exact, k, best))
    rank = F.row_number().over(Window.partitionBy(*per).orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).drop("a")


def mine(embeddings: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, sample: int = 16384) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark: SparkSession = embeddings.sparkSession
    rows = stored(rows_of(embeddings))
    sizes = rows.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("v", lambda x: F.greatest(x, -x)))).alias("most")).orderBy(F.desc("n"), F.desc("dims")).first()
    if sizes is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    dims, n, most = sizes["dims"], sizes["n"], sizes["most"]
    if most >= 1 << 53 or dims * most * most >= 1 << 56:
        raise ValueError("inner products of these vectors need more than 64 bits")
    rows = rows.where(F.size("v") == dims)
    kind = "i2" if most < 1 << 15 else "i4" if most < 1 << 31 else "i8"
    product = dims * most * most  # products of whole numbers are exact in floats up to their mantissa
    exact = "f4" if product < 1 << 24 else "f8" if product < 1 << 53 else "i8"
    tree = grow(rows, n, dims, sample)
    sent = spark.sparkContext.broadcast(tree)
    anchors = rows.where(F.col("vec_id") % every == 0)
    count = max(1, n // every)
    how = (tree, sent, dims, kind, exact)
    near = search(blocks(anchors, sent, ANCHORS, count, dims, kind, True), blocks(rows, sent, CANDIDATES, n, dims, kind, True), *how, positives, best_positives, positives)
    of = near.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "score"))).alias("positives"))  # `positives` at most
    asked = stored(anchors.join(of, "vec_id"))
    far = search(blocks(asked, sent, ANCHORS, count, dims, kind, False), blocks(rows, sent, CANDIDATES, n, dims, kind, False), *how, negatives, best_negatives, None)
    return far.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def report(embeddings: DataFrame) -> DataFrame:
    """The digest of the contract."""
    return mine(embeddings)


ORACLE = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)::INTEGER AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score QUALIFY rank <= 5
"""
