"""N-gram Jaccard join by PartEnum signatures, exact, and the components of its links.

A document's feature set is its distinct word shingles (64-bit hashes). Sizes fall into bands such that similar sets
lie in one band or in neighbours. For a pair of bands the similarity bounds the Hamming distance by k, so the hash
domain is cut into n1 parts of n2 sub-parts; in one part at least the sets differ in k2 sub-parts at most, hence they
agree on some n2 - k2 sub-parts: every such subset gives a signature, and similar sets share one. What unlike sets
often share is emptiness, so a subset without features gives none where it can't be the only one that agrees (`parts_of`).

Equal sets are one class, found by their 128-bit digest and known by its first row (its node), so copies take no part
beyond their first. Signatures are range-partitioned with their owners, so that a signature that many share spreads
over tasks; each task streams its sorted rows, links owners to the first of their signature and numbers them by blocks
of bounded size, and the ends of tasks are linked where a signature goes on. A candidate is counted exactly. Where
owners of a signature are still in different components, the owners of a block are compared with those of every block
(a sketch that bounds the distance is part of the join, so only candidates leave it), with a few owners first and more blocks a turn until each
was one; so no link between different texts is lost, and no link inside a component is looked for. Components
are found once; further links join those they touch.

Defined cases: null or wordless text has an empty set, is linked with nothing and is its own component; fewer words
than `words` give one shingle, the whole sequence; rows of one doc_id are rows for
themselves, linked by their own texts; rows of null doc_id are linked by nothing; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations
from math import comb, exp, sqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, WHITE, ascii_lower, distinct_per_row, gram_hashes, mix, release, segment_sums, slices, span_hashes, stored, text_bytes, word_bounds
from .components import components

#: Sub-parts of a part, and how many of them may differ.
SCHEME = (2, 1)
#: 64-bit words of the parity sketch.
SKETCH = 16
#: Cells of the hash domain whose counts are compared before whole sets.
CELLS = 1024
#: Owners of a signature that are compared with each other in one group.
BLOCK = 512
#: And how many of them are so first.
FEW = 8


def bands(num: int, den: int, most: int) -> list[int]:
    """Least size of each band: sets with similarity >= num/den lie in one band or in neighbours."""
    out = [1]
    while out[-1] <= most:
        out.append(out[-1] * den // num + 1)
    return out


def distance(largest: int, num: int, den: int) -> int:
    """Hamming distance that similar sets of at most that size can have."""
    return (den - num) * 2 * largest // (den + num)


def parts_of(k: int, least: int, scheme: tuple[int, int]) -> tuple[int, int]:
    """(parts, good): into how many parts the hash domain is cut, and in how many of them sets at distance k share a
    signature at least. A few more parts than needed are cut where that makes good exceed the parts that are empty in a
    set of `least` features: then none need be found by emptiness, which unlike sets share too."""
    n2, k2 = scheme
    fewest = -(-(k + 1) // (k2 + 1))
    for n1 in range(fewest, fewest + fewest // 4 + 1):
        q = exp(-least / (n1 * n2))
        empty = n1 * sum(comb(n2, i) * q**i * (1 - q) ** (n2 - i) for i in range(n2 - k2, n2 + 1))
        if n1 - k // (k2 + 1) > empty + 4 * sqrt(empty):
            return n1, n1 - k // (k2 + 1)
    return fewest, fewest - k // (k2 + 1)


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    raw, off = text_bytes(texts)
    low = ascii_lower(raw)
    starts, ends, before = word_bounds(low, off, WHITE)
    return distinct_per_row(*gram_hashes(span_hashes(low, starts, ends), before, words), len(off) - 1)


def signatures(h: np.ndarray, begins: np.ndarray, rows: np.ndarray, num: int, den: int, scheme: tuple[int, int] = SCHEME) -> tuple[np.ndarray, np.ndarray]:
    """(signature, row) of the sets of these rows."""
    sizes = np.diff(begins)
    levels = bands(num, den, int(sizes.max(initial=0)))
    band = np.searchsorted(levels, sizes, "right") - 1
    sigs, owners = [], []
    value = mix(h ^ U64(0xA5A5A5A5A5A5A5A5))
    for up in (0, 1):
        for b in np.unique(band[rows]):
            own = rows[band[rows] == b]
            instance = int(b) + up
            k = distance(levels[instance + 1] - 1 if instance + 1 < len(levels) else levels[instance] * den // num, num, den)
            n2, k2 = scheme if k else (1, 0)
            n1, good = parts_of(k, levels[max(instance - 1, 0)], (n2, k2))
            parts = n1 * n2
            for at in range(0, len(own), max(1, (1 << 22) // max(parts, int(levels[b])))):
                some = own[at : at + max(1, (1 << 22) // max(parts, int(levels[b])))]
                count = sizes[some]
                heads = np.concatenate([[0], np.cumsum(count)])
                member = np.arange(heads[-1]) + np.repeat(begins[some] - heads[:-1], count)
                cell = np.repeat(np.arange(len(some)) * parts, count) + ((h[member] >> U64(32)) * U64(parts) >> U64(32)).astype(np.int64)
                edge = np.searchsorted(cell, np.arange(len(some) * parts + 1))
                sums = segment_sums(value[member], edge).reshape(len(some), n1, n2)
                empty = np.diff(edge).reshape(len(some), n1, n2) == 0
                # fewer parts are empty than agree with any similar set: one that agrees is not
                spare = (empty.sum(2) >= n2 - k2).sum(1) < good
                place = mix(np.arange(n1, dtype=np.uint64) + U64(instance << 32))[None, :]
                for c, chosen in enumerate(combinations(range(n2), n2 - k2)):
                    with np.errstate(over="ignore"):
                        sig = place + U64(c + 1)
                        for i in chosen:
                            sig = mix(sig * U64(0x9FB21C651E98DF25) + sums[:, :, i])
                    told = ~(empty[:, :, chosen].all(2) & spare[:, None])
                    sigs.append(np.broadcast_to(sig, (len(some), n1))[told] >> U64(16))  # 48 bits; a clash is one candidate more
                    owners.append(np.repeat(some, n1).reshape(-1, n1)[told])
    if not sigs:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(sigs), np.concatenate(owners)


def set_table(docs: DataFrame, words: int, num: int, den: int, scheme: tuple[int, int] = SCHEME) -> DataFrame:
    """Of each row: row (its number), doc_id, t (a hash of the text), n_shingles, h1, h2 (digest of the set) and, if it is the first of its
    digest in its slice, its signatures and its sketch: of each of 64 * SKETCH cells of the hash domain, whether it
    holds an odd number."""

    def run(batches):
        number = TaskContext.get().partitionId() << 33
        for whole in batches:
            for batch in slices(whole, "text"):
                h, begins = shingle_sets(batch.column("text"), words)
                n = np.diff(begins)
                h1, h2 = segment_sums(mix(h), begins), segment_sums(mix(mix(h) ^ U64(0x5851F42D4C957F2D)), begins)
                ids = batch.column("doc_id")
                order = np.lexsort((h2, h1))  # stable: of equal digests, the first row comes first
                order = order[(ids.is_valid().to_numpy(zero_copy_only=False) & (n > 0))[order]]
                first = np.ones(len(order), bool)
                first[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
                sig, owner = signatures(h, begins, np.sort(order[first]), num, den, scheme)
                by = np.argsort(owner, kind="stable")
                off = np.searchsorted(owner[by], np.arange(batch.num_rows + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(off), pa.array(sig[by].view(np.int64)))
                cells = 64 * SKETCH
                at = np.repeat(np.arange(batch.num_rows), n) * cells + (h & U64(cells - 1)).astype(np.int64)
                odd = np.packbits((np.bincount(at, minlength=batch.num_rows * cells) & 1).astype(bool)).view(np.int64)
                one = np.zeros(batch.num_rows, bool)
                one[order[first]] = True
                ends = np.concatenate([[0], np.cumsum(one * SKETCH)]).astype(np.int32)
                sketch = pa.ListArray.from_arrays(pa.array(ends), pa.array(odd.reshape(-1, SKETCH)[one].ravel()))
                numbers = pa.array(number + np.arange(batch.num_rows))
                number += batch.num_rows
                yield pa.RecordBatch.from_arrays([numbers, ids, batch.column("t"), pa.array(n), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), lists, sketch], names=["row", "doc_id", "t", "n_shingles", "h1", "h2", "sigs", "sketch"])
        release()

    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64(F.col("text").cast("string")).alias("t"))
    return narrow.mapInArrow(run, "row long, doc_id long, t long, n_shingles long, h1 long, h2 long, sigs array<long>, sketch array<long>")


def shared(rows: DataFrame, parts: int) -> DataFrame:
    """rows: (sig, node). (sig, node, pivot, block, place) of the rows whose signature has another owner in its range, and of
    the first and last signature of each range, where owners of the next range may be. pivot: the first owner of the
    range; block: a number that at most BLOCK owners of one signature share; place: which of these an owner is."""
    dealt = rows.repartitionByRange(parts, "sig", "node").sortWithinPartitions("sig", "node")

    def run(batches):
        held = None  # the last run: signature, pivot, owners so far, whether its pivot was given out
        first_sig = None
        base = TaskContext.get().partitionId() << 32

        def out(sig, node, pivot, at):
            return pa.RecordBatch.from_arrays([pa.array(sig, pa.int64()), pa.array(node, pa.int64()), pa.array(pivot, pa.int64()), pa.array(base + np.asarray(at) // BLOCK, pa.int64()), pa.array(np.asarray(at) % BLOCK, pa.int32())], names=["sig", "node", "pivot", "block", "place"])

        for b in batches:
            sig, node = b.column(0).to_numpy(), b.column(1).to_numpy()
            if not len(sig):
                continue
            if first_sig is None:
                first_sig = sig[0]
            new = np.ones(len(sig), bool)
            new[1:] = sig[1:] != sig[:-1]
            start = np.flatnonzero(new)
            run_of = np.cumsum(new) - 1
            size = np.diff(np.append(start, len(sig)))
            pivot, at = node[start], np.arange(len(sig)) - start[run_of]
            keep = (size > 1)[run_of] | (sig == first_sig)
            before = 0
            if held is not None and held[0] == sig[0]:
                pivot[0], before = held[1], held[2]
                at[run_of == 0] += before
                keep |= run_of == 0
                if not held[3]:
                    yield out([held[0]], [held[1]], [held[1]], [0])
            yield out(sig[keep], node[keep], pivot[run_of[keep]], at[keep])
            held = (sig[-1], pivot[-1], int(size[-1]) + (before if len(start) == 1 else 0), bool(keep[-1]))
        if held is not None and not held[3]:
            yield out([held[0]], [held[1]], [held[1]], [0])

    return dealt.mapInArrow(run, "sig long, node long, pivot long, block long, place int")


def tested(pairs: DataFrame, sets: DataFrame, column: str, test) -> DataFrame:
    """The pairs (x, y) for which test holds of the arrays in a column of both: test(of x, of y, n of x, n of y)."""
    left = sets.select(F.col("node").alias("x"), F.col("n").alias("nx"), F.col(column).alias("sx"))
    right = sets.select(F.col("node").alias("y"), F.col("n").alias("ny"), F.col(column).alias("sy"))

    def run(batches):
        for b in batches:
            keep = [test(p.as_buffer(), q.as_buffer(), n, m) for p, q, n, m in zip(b.column("sx"), b.column("sy"), b.column("nx").to_pylist(), b.column("ny").to_pylist())]
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("x").filter(mask), b.column("y").filter(mask)], names=["x", "y"])

    return pairs.join(left, "x").join(right, "y").select("x", "y", "nx", "ny", "sx", "sy").mapInArrow(run, "x long, y long")


def verified(pairs: DataFrame, info: DataFrame, docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """The pairs (x, y) of nodes whose sets are similar: exact counts of common shingles. Whole sets are made and sent
    only for pairs that the counts by cell of the hash domain, whose distance is no greater, leave."""

    def near(p, q, n, m):
        differ = np.abs(np.frombuffer(p, np.uint8).astype(np.int64) - np.frombuffer(q, np.uint8)).sum()
        return bool(differ * (den + num) <= (n + m) * (den - num))

    def similar(p, q, n, m):
        both = np.concatenate([np.frombuffer(p, np.int64), np.frombuffer(q, np.int64)])
        both.sort(kind="stable")
        common = int((both[1:] == both[:-1]).sum())
        return den * common >= num * (n + m - common)

    for column, test in (("cells", near), ("set", similar)):
        if pairs.isEmpty():
            return pairs
        ends = pairs.select(F.col("x").alias("node")).unionByName(pairs.select(F.col("y").alias("node"))).distinct()
        sets = stored(sets_of(docs, stored(info.select("node", "doc_id", "h1", "h2").join(ends, "node")), words, column))
        pairs = stored(tested(pairs, sets, column, test))
    return pairs


def sets_of(docs: DataFrame, wanted: DataFrame, words: int, column: str, broadcast_rows: int = 1 << 19) -> DataFrame:
    """(node, n, column) of the wanted nodes (node, doc_id, h1, h2), column being set, or cells (shingles in each cell,
    255 at most). Their ids go to all tasks only up to broadcast_rows (8 bytes each); the digest tells which of the rows
    of an id is meant."""
    ids = wanted.select("doc_id").distinct()
    few = wanted.count() <= broadcast_rows
    picked = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    picked = picked.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi").select("text")

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                h, begins = shingle_sets(batch.column("text"), words)
                h1, h2 = segment_sums(mix(h), begins), segment_sums(mix(mix(h) ^ U64(0x5851F42D4C957F2D)), begins)
                if column == "set":
                    blobs = [h[begins[i] : begins[i + 1]].tobytes() for i in range(batch.num_rows)]
                else:
                    at = np.repeat(np.arange(batch.num_rows), np.diff(begins)) * CELLS + (h & U64(CELLS - 1)).astype(np.int64)
                    counts = np.minimum(np.bincount(at, minlength=batch.num_rows * CELLS), 255).astype(np.uint8)
                    blobs = [c.tobytes() for c in counts.reshape(-1, CELLS)]
                yield pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(np.diff(begins)), pa.array(blobs, pa.binary())], names=["h1", "h2", "n", column])

    made = picked.mapInArrow(run, f"h1 long, h2 long, n long, {column} binary").dropDuplicates(["h1", "h2"])
    return made.join(wanted, ["h1", "h2"]).select("node", "n", column)


def apart(p: str, q: str, num: int, den: int):
    """Not more than an exact lower bound of the Hamming distance allows: parities that differ, and sizes."""
    differ = F.lit(0)
    for i in range(SKETCH):
        differ = differ + F.bit_count(F.col(f"{p}.s{i}").bitwiseXOR(F.col(f"{q}.s{i}")))
    n, m = F.col(f"{p}.n"), F.col(f"{q}.n")
    return (differ * (den + num) <= (n + m) * (den - num)) & (F.least(n, m) * den >= F.greatest(n, m) * num)


def range_parts(table: DataFrame, each: int = 8_000_000) -> int:
    """Ranges of about that many signatures at most, and as many as the session has shuffle partitions at least."""
    total = table.agg(F.sum(F.greatest(F.size("sigs"), F.lit(0)))).first()[0] or 0
    return max(1, int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // each))


def jaccard_join(docs: DataFrame, words: int = 5, num: int = 8, den: int = 10, scheme: tuple[int, int] = SCHEME) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(table, classes, links, components): set_table of each row; node (its first row) and least doc_id of each digest;
    links between nodes that connect all that is connected by similarity >= num/den; component of each linked node."""
    table = stored(set_table(docs, words, num, den, scheme))
    classes = stored(table.where("n_shingles > 0 and doc_id is not null").groupBy("h1", "h2").agg(F.min("row").alias("node"), F.min(F.struct("doc_id", "row")).alias("least")))
    nodes = table.where("size(sigs) > 0").withColumnRenamed("row", "node")
    rows = nodes.select("node", "sigs").join(classes.select("node"), "node", "left_semi").select(F.explode("sigs").alias("sig"), "node")
    owners = stored(shared(rows, range_parts(table)))
    # ranges that one signature spans meet in its least pivot; a signature at an end may have one owner only
    tops = owners.select("sig", "pivot").distinct()
    tops = tops.join(tops.groupBy("sig").agg(F.min("pivot").alias("top"), F.max("pivot").alias("last")).where("top < last"), "sig")
    pairs = owners.select(F.col("node").alias("x"), F.col("pivot").alias("y")).unionByName(tops.select(F.col("pivot").alias("x"), F.col("top").alias("y")))
    pairs = pairs.where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    known = owners.select("node").distinct()
    info = nodes.select("node", "doc_id", "h1", "h2", F.col("n_shingles").alias("n"), *(F.col("sketch")[i].alias(f"s{i}") for i in range(SKETCH)))
    info = stored(info.join(known, "node", "left_semi"))
    near = pairs.join(info.alias("p"), F.col("x") == F.col("p.node")).join(info.alias("q"), (F.col("y") == F.col("q.node")) & apart("p", "q", num, den))
    links = verified(stored(near.select("x", "y")), info, docs, words, num, den)
    of = components(links, "x", "y")
    turn = 0
    while True:
        # signatures whose owners are in several components still: the owners whose turn it is are compared with all others
        placed = owners.select("sig", "block", "place", "node").join(of, "node", "left").withColumn("component", F.coalesce("component", "node"))
        per = Window.partitionBy("sig")
        blocks = placed.groupBy("sig", "block").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.max("place").alias("most"))
        blocks = blocks.withColumns({"k": F.row_number().over(per.orderBy("block")) - 1, "a": F.min("a").over(per), "b": F.max("b").over(per)})
        blocks = blocks.withColumn("last", F.max(turn_of("k", "most")).over(per)).where((F.col("a") < F.col("b")) & (F.col("last") >= turn))
        blocks = stored(blocks.select("sig", "block", "k"))
        if blocks.isEmpty():
            return table, classes, links, of
        own = placed.join(blocks, ["sig", "block"]).withColumn("turn", turn_of("k", "place")).where(f"turn >= {turn}")
        own = stored(own.drop("k", "place").join(info.drop("doc_id", "h1", "h2"), "node"))
        p = own.alias("p")
        q = own.where(f"turn = {turn}").drop("block").join(blocks.select("sig", "block"), "sig").alias("q")
        met = (F.col("p.sig") == F.col("q.sig")) & (F.col("p.block") == F.col("q.block")) & (F.col("p.component") != F.col("q.component"))
        more = p.join(q, met & ((F.col("p.turn") > turn) | (F.col("p.node") < F.col("q.node"))) & apart("p", "q", num, den))
        more = more.select(F.least("p.node", "q.node").alias("x"), F.greatest("p.node", "q.node").alias("y")).distinct()
        found = verified(stored(more), info, docs, words, num, den)
        if not found.isEmpty():
            links = links.unionByName(found)
            of = stored(grown(of, found))
        turn += 1


def turn_of(k: str, place: str):
    """When an owner is compared with all others of its signature: a few first, as most groups are one component then,
    then the rest of the first block, then three blocks, twelve, and so on."""
    later = 2 + F.floor(F.log2(F.greatest(F.col(k), F.lit(1))) / 2)
    return F.when(F.col(k) > 0, later).otherwise((F.col(place) >= FEW).cast("int")).cast("int")


def grown(of: DataFrame, links: DataFrame) -> DataFrame:
    """The components (node, component) with further links (x, y): only components that these touch are joined anew."""
    edges = links
    for end in ("x", "y"):
        edges = edges.join(of.withColumnsRenamed({"node": end, "component": "c"}), end, "left").withColumn(end, F.coalesce("c", end)).drop("c")
    new = stored(components(edges, "x", "y")).withColumnsRenamed({"node": "old", "component": "new"})
    moved = of.join(new, of["component"] == new["old"], "left").select("node", F.coalesce("new", "component").alias("component"))
    return moved.unionByName(new.join(of, new["old"] == of["node"], "left_anti").select(F.col("old").alias("node"), F.col("new").alias("component")))


def near_duplicates(docs: DataFrame, words: int = 5, num: int = 8, den: int = 10, scheme: tuple[int, int] = SCHEME) -> DataFrame:
    """doc_id, n_shingles, component_id of each row; t (xxhash64 of its text); keeper: whether it is the one row of its
    component that stays, the first of the least doc_id."""
    table, classes, _, of = jaccard_join(docs, words, num, den, scheme=scheme)
    linked = classes.select("node", "least").join(of, "node")
    linked = linked.select("node", "component").join(linked.groupBy("component").agg(F.min("least").alias("first")), "component").drop("component")
    placed = classes.join(linked, "node", "left").select("h1", "h2", F.coalesce("first", "least").alias("first"))
    joined = table.select("row", "doc_id", "t", "n_shingles", "h1", "h2").join(placed, ["h1", "h2"], "left")
    alone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    return joined.select("doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"), "t", (alone | (F.col("row") == F.col("first.row"))).alias("keeper"))


def report(docs: DataFrame) -> DataFrame:
    """The digest of the contract: three words, similarity 0.9."""
    return near_duplicates(docs, 3, 90, 100).select("doc_id", "n_shingles", "component_id")


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[i:i + 2], ' ') FOR i IN range(1, len(w) - 1)]) END AS s FROM w),
c AS (SELECT s, min(doc_id) AS rep FROM (SELECT doc_id, list_sort(s) AS s FROM s) GROUP BY s),
e AS (SELECT rep, len(s) AS n, unnest(s) AS g FROM c WHERE len(s) > 0),
j AS (SELECT a.rep AS x, b.rep AS y FROM e a JOIN e b ON a.g = b.g AND a.rep < b.rep AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 90 GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
b AS (SELECT x, y FROM j UNION ALL SELECT y, x FROM j),
r(x, y) AS (SELECT rep, rep FROM c WHERE len(s) > 0 UNION SELECT r.x, b.y FROM r JOIN b ON r.y = b.x),
m AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
SELECT d.doc_id, len(d.s)::BIGINT AS n_shingles, CASE WHEN len(d.s) = 0 THEN d.doc_id ELSE m.component_id END AS component_id
FROM (SELECT doc_id, list_sort(s) AS s FROM s) d LEFT JOIN c ON c.s = d.s LEFT JOIN m ON m.x = c.rep
"""
