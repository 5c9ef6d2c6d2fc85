"""Sharding by histogram sort: near equal bytes a shard, found by counting below probes, then one exchange.

The sort key of a document is (xxhash64 of its text, doc_id), so equal texts lie side by side. A narrow table of key and
size is written once; each round counts, in every partition, the exact bytes and rows below a few hundred candidate
keys inside the brackets that are still too wide, and only those counts reach the driver: their number depends on the
shards and probes, not on the rows. A hot text is no hot key, as its copies differ in doc_id and splitters may fall
between them. When all splitters meet the tolerance the rows are exchanged once, by sub-ranges of a shard, which a
task sorts and numbers alone: the histogram has already said how many rows lie before each sub-range.

Defined cases: null text has size 1 (its bytes, none, plus 1); a null doc_id sorts first; rows equal in text and doc_id
have one key and stay together; an empty table gives no rows; columns named like the results are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

LOW = -(1 << 63)
HIGH, LO = "_key_high", "_key_low"


def below(high: np.ndarray, low: np.ndarray, at_high: np.ndarray, at_low: np.ndarray) -> np.ndarray:
    """How many of the sorted probes (at_high, at_low) are <= each key: all keys halve their bracket together."""
    first, last = np.zeros(len(high), np.int64), np.full(len(high), len(at_high), np.int64)
    for _ in range(len(at_high).bit_length()):
        mid = (first + last) // 2
        probe = np.minimum(mid, len(at_high) - 1)
        reached = (mid < last) & ((at_high[probe] < high) | (at_high[probe] == high) & (at_low[probe] <= low))
        first, last = np.where(reached, mid + 1, first), np.where(reached, last, mid)
    return first


def arrays(probes: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([p[0] for p in probes], np.int64), np.array([p[1] for p in probes], np.int64)


def number(key: tuple[int, int]) -> int:
    return ((key[0] - LOW) << 64) | (key[1] - LOW)


def pair(value: int) -> tuple[int, int]:
    return (value >> 64) + LOW, (value & ((1 << 64) - 1)) + LOW


def histogram(keys: DataFrame, probes: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Exact (bytes, rows) below each probe."""
    at_high, at_low = arrays(probes)

    def count(batches):
        total = np.zeros((2, len(probes) + 1), np.int64)
        for b in batches:
            at = below(b.column(0).to_numpy(), b.column(1).to_numpy(), at_high, at_low)
            total[0] += np.bincount(at, b.column(2).to_numpy(), len(probes) + 1).astype(np.int64)
            total[1] += np.bincount(at, minlength=len(probes) + 1)
        filled = np.flatnonzero(total[1])
        yield pa.RecordBatch.from_arrays([pa.array(filled), pa.array(total[0][filled]), pa.array(total[1][filled])], names=["at", "bytes", "n"])

    rows = keys.mapInArrow(count, "at long, bytes long, n long").groupBy("at").agg(F.sum("bytes"), F.sum("n")).collect()
    found = np.zeros((2, len(probes) + 1), np.int64)
    for at, size, n in rows:
        found[:, at] = size, n
    return list(zip(*np.cumsum(found, axis=1)[:, :-1].tolist()))


def splitters(keys: DataFrame, total: int, parts: int, wide: dict[int, int], probes: int = 1024, rounds: int = 200) -> list[tuple[tuple[int, int], int, int]]:
    """Of each inner boundary of `parts` equal parts: key, bytes and rows below it. wide: the tolerance of each."""
    goal = {j: total * j // parts for j in range(1, parts)}
    bracket = {j: ((0, 0, 0), (1 << 128, total, -1)) for j in goal}  # (key, bytes below, rows below)
    done: dict[int, tuple] = {}
    for _ in range(rounds):
        open_ = [j for j in goal if j not in done]
        if not open_:
            break
        spans = sorted({(bracket[j][0], bracket[j][1]) for j in open_})
        each = max(1, probes // len(spans))
        tries = sorted({x for lo, hi in spans for i in range(1, each + 1) if lo[0] < (x := lo[0] + (hi[0] - lo[0]) * i // (each + 1)) < hi[0]})
        counted = [(x, *c) for x, c in zip(tries, histogram(keys, [pair(x) for x in tries]))] if tries else []
        at = np.array([c[1] for c in counted])
        for j in open_:
            lo, hi = bracket[j]
            i = int(np.searchsorted(at, goal[j], "right"))
            if i and counted[i - 1][0] > lo[0]:
                lo = counted[i - 1]
            if i < len(counted) and counted[i][0] < hi[0]:
                hi = counted[i]
            bracket[j] = (lo, hi)
            best = min((lo, hi), key=lambda x: (abs(x[1] - goal[j]), x[0]))
            if abs(best[1] - goal[j]) <= wide[j] and best[2] >= 0 and best[0] or hi[0] - lo[0] <= 1:
                done[j] = best if best[2] >= 0 else lo
    if len(done) < len(goal):
        raise RuntimeError(f"{len(goal) - len(done)} of {len(goal)} splitters are not found after {rounds} rounds")
    return [(pair(done[j][0]), done[j][1], done[j][2]) for j in sorted(done)]


def shard(docs: DataFrame, shards: int = 8, tolerance: float = 0.001, part_bytes: int = 64 << 20) -> DataFrame:
    """docs with size, text_crc32, shard and slot: shard sizes differ from the mean by `tolerance` of it, or by what
    one key holds; slots count from 0 in the order of the key. Splitters that cannot be found are an error."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.drop("size", "text_crc32", "shard", "slot", HIGH, LO)
    base = base.withColumns({"size": F.octet_length(text).cast("long") + 1, "text_crc32": F.crc32(text.cast("binary")), HIGH: F.xxhash64(text), LO: F.coalesce(F.col("doc_id").cast("long"), F.lit(LOW))})
    keys = stored(base.select(HIGH, LO, "size"))
    total = int(keys.agg(F.sum("size")).first()[0] or 0)
    spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    subs = max(-(-total // (shards * part_bytes)), -(-spread // shards), 1)
    cuts = splitters(keys, total, shards * subs, {j: int((tolerance if j % subs == 0 else 0.25 / subs) * total / shards) for j in range(1, shards * subs)}) if total else []
    cuts = [((LOW, LOW), 0, 0), *cuts]
    # three numbers a sub-range, so 36 bytes for each `part_bytes` of input: a table of their own, not literals of the plan
    heads = [cuts[i - i % subs][2] for i in range(len(cuts))]
    sent = docs.sparkSession.sparkContext.broadcast((*arrays([c[0] for c in cuts[1:]]), np.array([c[2] - h for c, h in zip(cuts, heads)], np.int64)))

    @F.pandas_udf("part int, base long")
    def place(high: pd.Series, low: pd.Series) -> pd.DataFrame:
        at_high, at_low, base = sent.value
        part = below(high.to_numpy(), low.to_numpy(), at_high, at_low)
        return pd.DataFrame({"part": part.astype(np.int32), "base": base[part]})

    order = Window.partitionBy("_part").orderBy(HIGH, LO)
    out = base.withColumn("_place", place(HIGH, LO)).withColumn("_part", F.col("_place.part")).withColumn("_row", F.row_number().over(order))
    return out.withColumns({"shard": (F.col("_part") / subs).cast("int"), "slot": (F.col("_place.base") + F.col("_row") - 1).cast("long")}).drop("_place", "_part", "_row", HIGH, LO)


def report(docs: DataFrame) -> DataFrame:
    """The digest of the contract, by the law of equal bytes."""
    return shard(docs.select("doc_id", "text")).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
