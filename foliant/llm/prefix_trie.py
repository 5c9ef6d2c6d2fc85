"""Conversation prefix trie by distributed MSD radix partitioning.

Turns are sorted by conversation over ranges of equal size and numbered there (a conversation may span ranges), and each
distinct (role, text) gets a number from a dictionary; only numbers travel from then on. A bucket holds the
conversations that share a prefix, known by the least of them. A round takes every bucket down to where its
conversations first differ (whole chains at once, so copies of long conversations take one round) and deals them by the
next turn. Buckets of one conversation are chains as they are; buckets of at most `LOCAL` turns are finished together,
many in a task, by multikey quicksort; the others go round again. Partitioning and sorting both give, of every turn of
every conversation, the node it stands for.

Nodes are then aggregates over turns: members are counted, a turn whose conversation is not the least of its node is
saved, and counts for all nodes above it in its own conversation.

Hot keys: a turn that more than a thousandth of all rows share is joined by broadcast (fewer than a thousand are),
counts are added up before they move, and the ids that end in one node are joined as strings of 4,096 ids at most, which
one pass hashes in order.

Defined cases: a null conv_id takes no part; null role and text are empty; a null turn comes first, equal turns in the
order of role and text, repeated rows each count; conversations that the rebuilding leaves without turns end in the
root; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import release, stored
from .language_id import CRC

#: Turns of a bucket that a task sorts, turns a task holds together, share of all rows that makes a key hot.
LOCAL, HELD, HOT = 1 << 16, 1 << 18, 1000
#: Width of the ranges of ids that are joined before they are hashed.
IDS = 4096
ROWS = "conv_id long, depth int, size int, node long, parent long"


# --------------------------------------------------------------------------- sequences
def numbered(turns: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), size (code points), key (digest of role and text) of every turn, numbered in the order of
    conversation, turn, role and text. Ranges number their own turns; where a conversation goes on from the range
    before, what that held is added."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    key = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    rows = rows.withColumns({"key": key, "size": F.length("text")})
    place = ["conv_id", F.col("turn").asc_nulls_first()]
    # ranges go by the beginnings of long texts, which stand in the order of the whole ones and are what is sampled
    ranges = [*place, F.left("role", F.lit(64)), F.left("text", F.lit(64))]
    sorted_ = rows.repartitionByRange(*ranges).sortWithinPartitions(*place, "role", "text").select("conv_id", "size", "key")

    def number(batches):
        part, conv, n = TaskContext.get().partitionId(), None, 0
        for b in batches:
            ids = b.column("conv_id").to_numpy()
            if not len(ids):
                continue
            edges = np.concatenate([[0], np.flatnonzero(ids[1:] != ids[:-1]) + 1])
            pos = np.arange(len(ids)) - np.repeat(edges, np.diff(np.append(edges, len(ids))))
            if ids[0] == conv:
                pos[: edges[1] if len(edges) > 1 else len(ids)] += n
            conv, n = ids[-1], int(pos[-1]) + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * len(ids), pa.int32()), pa.array(pos, pa.int64())], names=["conv_id", "size", "key", "part", "pos"])

    local = stored(sorted_.mapInArrow(number, "conv_id long, size int, key binary, part int, pos long"))
    # only the last conversation of a range can go on in the next
    ends = local.groupBy("part").agg(F.max("conv_id").alias("conv_id"), F.min("conv_id").alias("least"), F.max_by("pos", F.struct("conv_id", "pos")).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # a row a range: a conversation meets its earlier ranges and, at most, the one that it ends in
    more = ends.select("conv_id", "part", (F.col("n") + 1).alias("n")).unionByName(ends.where("least < conv_id").select(F.col("least").alias("conv_id"), "part", F.lit(0).cast("long").alias("n")))
    more = more.withColumn("n", F.sum("n").over(before)).where("n > 0")
    return local.join(F.broadcast(more), ["conv_id", "part"], "left").select("conv_id", (F.col("pos") + F.coalesce("n", F.lit(0))).cast("int").alias("pos"), "size", "key")  # two rows a range at most are sent


def keyed(rows: DataFrame, table: DataFrame, on: list[str], count: str, total: int) -> DataFrame:
    """rows joined with a table of one row a key, whose rows count says how many of the rows have it: keys of more than
    a thousandth of all rows, fewer than a thousand of them, go to the rows, the rest meet by key."""
    if total < 2 * HOT * HOT:
        return rows.join(table.drop(count), on)  # what a thousandth is, a task takes anyway; AQE splits the rest
    hot = F.broadcast(table.where(F.col(count) * HOT > total).drop(count))
    cold = rows.join(hot, on, "left_anti").join(table.where(F.col(count) * HOT <= total).drop(count), on)
    return rows.join(hot, on).unionByName(cold)


def encoded(turns: DataFrame) -> DataFrame:
    """conv_id, pos, size, id: turns by their number in a dictionary of all distinct turns."""
    rows = stored(numbered(turns))
    words = stored(rows.groupBy("key").agg(F.count("*").alias("n")).withColumn("id", F.monotonically_increasing_id()))
    return keyed(rows, words, ["key"], "n", rows.count()).select("conv_id", "pos", "size", "id")


def crc(conv: Column) -> Column:
    return F.crc32(conv.cast("string").cast("binary"))


def rebuilt(rows: DataFrame, every: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, depth from 1, size, id, turns of the conversation) and conversations (conv_id, turns): the first
    h turns are those of the conversation that opens its hundred."""
    heads = rows.where((F.col("conv_id") % every == 0) & (F.col("pos") < most - 1))
    counts = rows.groupBy("conv_id").agg(F.count("*").cast("int").alias("own"))
    head_of = (F.col("conv_id") - F.col("conv_id") % every).alias("head")
    convs = counts.select("conv_id", "own", head_of, (crc(F.col("conv_id")) % most).cast("int").alias("h"))
    given = heads.groupBy(F.col("conv_id").alias("head")).agg(F.count("*").cast("int").alias("given"))
    convs = convs.join(given, "head", "left").withColumn("given", F.least("h", F.coalesce("given", F.lit(0))))
    convs = stored(convs.select("conv_id", "head", "h", "given", (F.col("given") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("turns")))
    ours = rows.join(convs, "conv_id").where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("given") + 1).alias("depth"), "size", "id", "turns")
    theirs = convs.where("given > 0").join(heads.select(F.col("conv_id").alias("head"), "pos", "size", "id"), "head").where("pos < given")
    return ours.unionByName(theirs.select("conv_id", (F.col("pos") + 1).alias("depth"), "size", "id", "turns")), convs.select("conv_id", "turns")


# --------------------------------------------------------------------------- partitioning
def quicksort(conv: np.ndarray, at: np.ndarray, to: np.ndarray, ids: np.ndarray, node: np.ndarray, parent: np.ndarray, bucket: int) -> None:
    """Multikey quicksort of the sequences ids[at[i]:to[i]] of the conversations conv, all of one bucket: three-way
    partition by the turn at hand, the equal part goes on with the next. An equal part is a node: node and parent of its
    members' turns are written down."""
    todo = [(np.arange(len(conv)), 0, bucket)]
    while todo:
        own, d, above = todo.pop()
        own = own[at[own] + d < to[own]]  # the others end above
        if len(own) == 1:
            i = own[0]
            node[at[i] + d : to[i]] = conv[i]
            parent[at[i] + d] = above
            parent[at[i] + d + 1 : to[i]] = conv[i]
            continue
        if not len(own):
            continue
        now = ids[at[own] + d]
        pivot = np.partition(now[:: max(1, len(now) // 9)], min(len(now), 9) // 2)[min(len(now), 9) // 2] if len(now) > 2 else now[0]
        same = own[now == pivot]
        name = conv[same].min()
        node[at[same] + d], parent[at[same] + d] = name, above
        todo.append((same, d + 1, name))
        for side in (own[now < pivot], own[now > pivot]):
            if len(side):
                todo.append((side, d, above))


def finish(batches):
    """Rows (bucket, conv_id, depth, size, id), sorted, to rows with node and parent; whole buckets, several at once."""
    held: list[pa.RecordBatch] = []

    def out(table: pa.Table):
        c = {n: table.column(n).to_numpy() for n in ("bucket", "conv_id", "depth", "size", "id")}
        node, parent = np.zeros(len(c["id"]), np.int64), np.zeros(len(c["id"]), np.int64)
        new = (c["conv_id"][1:] != c["conv_id"][:-1]) | (c["bucket"][1:] != c["bucket"][:-1])
        at = np.concatenate([[0], np.flatnonzero(new) + 1])
        to = np.append(at[1:], len(node))
        edge = np.concatenate([[0], np.flatnonzero(c["bucket"][at][1:] != c["bucket"][at][:-1]) + 1, [len(at)]])
        for lo, hi in zip(edge, edge[1:]):
            quicksort(c["conv_id"][at[lo:hi]], at[lo:hi], to[lo:hi], c["id"], node, parent, int(c["bucket"][at[lo]]))
        for lo in range(0, len(node), 1 << 16):
            part = slice(lo, lo + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(x[part]) for x in (c["conv_id"], c["depth"], c["size"], node, parent)], names=["conv_id", "depth", "size", "node", "parent"])

    def tables():
        nonlocal held
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            if sum(x.num_rows for x in held) >= HELD:
                whole = pa.Table.from_batches(held)
                last = whole.column("bucket").to_numpy()
                cut = int(np.searchsorted(last, last[-1]))
                if cut:  # the last bucket may go on
                    yield whole.slice(0, cut)
                    held = whole.slice(cut).to_batches()
        if held:
            yield pa.Table.from_batches(held)

    for table in tables():
        yield from out(table)
    release()


def places(turns: DataFrame, root: int, convs: int, local: int = LOCAL) -> DataFrame:
    """conv_id, depth, size, node, parent of every turn: the least conversations of its prefix and of the one before."""
    act = turns.withColumns({"bucket": F.lit(root), "n": F.lit(convs).cast("long"), "d": F.lit(0)})
    act = stored(act)
    done: list[DataFrame] = []
    to_sort: list[DataFrame] = []
    shown = lambda df, node, parent: df.select("conv_id", F.col("depth").cast("int"), "size", node.alias("node"), parent.alias("parent"))
    rows = act.count()
    if rows <= local:
        to_sort.append(act)
        rows = 0
    while rows:
        # how far the conversations of a bucket go together
        level = act.groupBy("bucket", "n", "depth").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("have"))
        fork = level.where("have < n or lo <> hi").groupBy("bucket").agg(F.min("depth").alias("fork"))
        act = stored(act.join(fork, "bucket", "left"))
        done.append(shown(act.where("fork is null or depth < fork"), F.col("bucket"), F.col("bucket")))
        split = act.where("depth = fork")
        left = F.col("turns") - F.col("depth")
        children = stored(split.groupBy("bucket", "id").agg(F.min("conv_id").alias("child"), F.count("*").alias("m"), F.sum(left).alias("left"), F.count("*").alias("_count")))
        dealt = stored(keyed(split, children, ["bucket", "id"], "_count", rows).select("conv_id", "depth", "size", "bucket", "child", "m", "left"))
        done.append(shown(dealt, F.col("child"), F.col("bucket")))
        deeper = act.where("depth > fork").drop("bucket", "n", "d", "fork").join(dealt.select("conv_id", F.col("child").alias("bucket"), F.col("m").alias("n"), F.col("depth").alias("d"), "left"), "conv_id")
        deeper = stored(deeper)
        done.append(shown(deeper.where("n = 1"), F.col("bucket"), F.col("bucket")))
        to_sort.append(deeper.where((F.col("n") > 1) & (F.col("left") <= local)).drop("left"))
        act = stored(deeper.where((F.col("n") > 1) & (F.col("left") > local)).drop("left"))
        rows = act.count()
    for some in to_sort:
        key = ["bucket", "conv_id", "depth"]
        dealt = some.select("bucket", "conv_id", F.col("depth").cast("int").alias("depth"), "size", "id").repartition("bucket").sortWithinPartitions(*key)
        done.append(dealt.mapInArrow(finish, ROWS))
    out = done[0]
    for df in done[1:]:
        out = out.unionByName(df)
    return out


# --------------------------------------------------------------------------- nodes
def digests(ends: DataFrame) -> DataFrame:
    """node, depth, ends_sha256 of the ids that end there, ascending: ids are joined by ranges, then hashed in order."""
    part = F.floor(F.col("conv_id") / IDS)
    pieces = ends.groupBy("node", "depth", part.alias("part")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))
    nodes = pieces.groupBy("node", "depth").agg(F.count("*").alias("parts"))
    pieces = pieces.join(nodes, ["node", "depth"])

    def run(batches):
        now, state = None, None
        for b in batches:
            for node, depth, ids in zip(*(b.column(c).to_pylist() for c in ("node", "depth", "ids"))):
                if (node, depth) != now:
                    if now:
                        yield pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]], pa.int32()), pa.array([state.hexdigest()])], names=["node", "depth", "ends_sha256"])
                    now, state = (node, depth), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]], pa.int32()), pa.array([state.hexdigest()])], names=["node", "depth", "ends_sha256"])

    long = pieces.where("parts > 1").repartition("node", "depth").sortWithinPartitions("node", "depth", "part").select("node", "depth", "ids")
    return pieces.where("parts = 1").select("node", "depth", F.sha2("ids", 256).alias("ends_sha256")).unionByName(long.mapInArrow(run, "node long, depth int, ends_sha256 string"))


def trie(turns: DataFrame, local: int = LOCAL) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
    sequences, convs = rebuilt(encoded(turns))
    root, n = convs.agg(F.min("conv_id"), F.count("*")).first()
    if root is None:
        root, n = 0, 0
    rows = places(sequences, root, n, local)
    top = convs.select("conv_id", F.lit(0).alias("depth"), F.lit(0).alias("size"), F.lit(root).cast("long").alias("node"), F.lit(None).cast("long").alias("parent"))
    rows = stored(rows.unionByName(top).join(convs, "conv_id"))
    nodes = stored(rows.groupBy("node", "depth").agg(F.count("*").alias("n_convs"), F.min("parent").alias("parent"), F.max("turns").alias("deepest")))
    tips = nodes.where("deepest = depth").select(F.col("node").alias("conv_id"), F.lit(1).alias("tip"))  # a leaf ends its least member
    below = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    saved = F.sum(F.when(F.col("node") != F.col("conv_id"), F.col("size")).otherwise(0).cast("long")).over(below)
    sums = rows.withColumn("saved", saved).join(tips, "conv_id", "left").groupBy("node", "depth").agg(F.sum("saved").alias("saved_tokens"), F.count("tip").alias("n_leaves"))
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("node"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    ends = digests(rows.where("depth = turns").select("node", "depth", "conv_id"))
    key = ["node", "depth"]
    out = nodes.join(sums, key).join(children, key, "left").join(ends, key, "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select(F.col("node").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def report(conversations: DataFrame) -> DataFrame:
    """The digest of the contract."""
    return trie(conversations)


ORACLE = rf"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS n FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS head, {CRC.format("conv_id")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
b AS (SELECT c.conv_id, 0 AS own, n, role, text FROM c JOIN t ON t.conv_id = c.head AND n <= h UNION ALL SELECT c.conv_id, 1, n, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND n > h),
s AS (SELECT conv_id, row_number() OVER w AS depth, length(text) AS size, list({{'role': role, 'text': text}}) OVER w AS path FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY own, n ROWS UNBOUNDED PRECEDING)
      UNION ALL SELECT conv_id, 0, 0, []::STRUCT(role VARCHAR, text VARCHAR)[] FROM c),
e AS (SELECT conv_id, max(depth) AS turns FROM s GROUP BY conv_id),
r AS (SELECT s.*, min(conv_id) OVER (PARTITION BY path) AS node, turns FROM s JOIN e USING (conv_id)),
n AS (SELECT node, depth, count(*) AS n_convs, any_value(size) AS size, string_agg(CASE WHEN turns = depth THEN conv_id::VARCHAR END, ',' ORDER BY conv_id) AS ends, max(turns) = depth AS leaf FROM r GROUP BY node, depth),
u AS (SELECT a.node, a.depth, sum((n.n_convs - 1) * n.size)::BIGINT AS saved_tokens, count_if(n.leaf)::BIGINT AS n_leaves, count_if(n.depth = a.depth + 1)::BIGINT AS n_children FROM n JOIN r a ON a.conv_id = n.node AND a.depth <= n.depth GROUP BY a.node, a.depth)
SELECT n.node AS conv_id, n.depth, p.node AS parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256 FROM n JOIN u USING (node, depth) LEFT JOIN r p ON p.conv_id = n.node AND p.depth = n.depth - 1
"""
