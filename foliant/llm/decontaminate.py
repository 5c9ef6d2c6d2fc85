"""Benchmark decontamination: suffix arrays over shards of the training text, searched by every test suffix.

Each shard (a slice of a partition) numbers its words by the benchmark's vocabulary; a word outside it ends a
suffix, as no test suffix goes on there. The shard's suffixes are sorted by prefix doubling, every test suffix is
binary-searched for its longest verbatim match and place, and every test window for the range of its occurrences.
Documents don't move, whatever their number: the pass has no shuffle. The benchmark is the only thing sent to
executors; beyond `block_bytes` it goes in blocks, one after the other, the hits so far kept in a work table.

Defined cases: null or wordless text has 0 words and no hit; null or wordless items give no window; an item of fewer
than `window` words is one window; equal items all count, equal ids once; items of null id hit words but are not
listed; rows with equal doc_id are judged each for itself; an empty benchmark or table gives no hits or no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NOT_ALNUM, ascii_lower, release, slices, span_hashes, stored, text_bytes, word_bounds


def suffix_array(t: np.ndarray, depth: int) -> np.ndarray:
    """Start positions of t's suffixes, sorted; a suffix begins at a positive number and ends before the first 0."""
    pad = np.zeros(len(t) + 3, np.int64)
    pad[: len(t)] = t
    a, b, c = pad[:-2], pad[1:-1], pad[2:]
    b = np.where(a > 0, b, 0)
    c = np.where(b > 0, c[: len(b)], 0)
    wide = int(t.max(initial=0)).bit_length() + 1
    held = 3 if wide * 3 < 63 else 1
    key = (a << (2 * wide)) | (b << wide) | c if held == 3 else a
    sa = np.flatnonzero(t > 0)
    sa = sa[np.argsort(key[sa], kind="stable")]
    rank = np.zeros(len(t) + 2, np.int64)
    slots, k = np.arange(len(sa)), held

    def number(part: np.ndarray, keys: np.ndarray, at: np.ndarray) -> np.ndarray:
        new = np.ones(len(part), bool)
        new[1:] = keys[1:] != keys[:-1]
        rank[part] = np.maximum.accumulate(np.where(new, at, 0)) + 1
        again = ~new
        again[:-1] |= ~new[1:]
        return again

    open_ = number(sa, key[sa], slots)
    while k < depth and open_.any():
        at = slots[open_]
        part = sa[at]
        keys = (rank[part] << 32) | rank[np.minimum(part + k, len(t))]
        order = np.argsort(keys, kind="stable")
        part, keys = part[order], keys[order]
        sa[at] = part
        slots, open_, k = at, number(part, keys, at), 2 * k
    return sa


def common_prefix(t: np.ndarray, at: np.ndarray, q: np.ndarray, qat: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Words that t from at and q from qat share, up to most; t and q end with zeros."""
    out = np.zeros(len(at), np.int64)
    live = np.arange(len(at))
    while len(live):
        x = np.minimum(at[live] + out[live], len(t) - 1)
        y = np.minimum(qat[live] + out[live], len(q) - 1)
        live = live[(t[x] == q[y]) & (t[x] > 0) & (out[live] < most[live])]
        out[live] += 1
    return out


def bound(t: np.ndarray, sa: np.ndarray, q: np.ndarray, qat: np.ndarray, most: np.ndarray, after: bool) -> np.ndarray:
    """Where each test prefix of `most` words would go among the sorted suffixes: before or after equal ones."""
    low, high = np.zeros(len(qat), np.int64), np.full(len(qat), len(sa), np.int64)
    while (open_ := np.flatnonzero(low < high)).size:
        mid = (low[open_] + high[open_]) // 2
        n = common_prefix(t, sa[mid], q, qat[open_], most[open_])
        whole = n >= most[open_]
        x = t[np.minimum(sa[mid] + n, len(t) - 1)]
        y = q[np.minimum(qat[open_] + n, len(q) - 1)]
        right = np.where(whole, after, x < y)
        low[open_] = np.where(right, mid + 1, low[open_])
        high[open_] = np.where(right, high[open_], mid)
    return low


class Benchmark:
    """The test items of one block as numbers: vocabulary, suffixes, distinct windows and the items of each."""

    def __init__(self, items: list[tuple], window: int):
        texts = pa.array([x[1] for x in items], pa.string())
        raw, off = text_bytes(texts)
        low = ascii_lower(raw)
        starts, ends, before = word_bounds(low, off, NOT_ALNUM)
        words = span_hashes(low, starts, ends)
        self.vocab, numbers = np.unique(words, return_inverse=True)
        count = np.diff(before)
        self.q = np.zeros(len(words) + len(items) + 1, np.int64)
        shift = np.repeat(np.arange(len(items)), count)
        place = np.arange(len(words)) + shift
        self.q[place] = numbers + 1
        left = np.repeat(before[1:], count) - np.arange(len(words))
        self.suffix_at, self.suffix_len, self.suffix_item = place, left, shift
        size = np.minimum(count, window)[shift]
        whole = np.flatnonzero(left >= size)
        self.least = int(size.min(initial=window)) if len(size) else window
        self.depth = int(count.max(initial=1))
        seen: dict[bytes, int] = {}
        self.win_at, self.win_len, self.win_items = [], [], []
        for w in whole:
            key = self.q[place[w] : place[w] + size[w]].tobytes()
            if key not in seen:
                seen[key] = len(seen)
                self.win_at.append(place[w])
                self.win_len.append(size[w])
                self.win_items.append(set())
            self.win_items[seen[key]].add(int(shift[w]))
        self.win_at, self.win_len = np.array(self.win_at, np.int64), np.array(self.win_len, np.int64)
        self.win_items = [sorted(x) for x in self.win_items]
        self.ids = [x[0] for x in items]
        self.sorted = suffix_array(self.q, self.depth)
        item_at = np.zeros(len(self.q), np.int64)
        item_at[place] = shift
        self.sorted_item = item_at[self.sorted]
        length_at = np.zeros(len(self.q), np.int64)
        length_at[place] = left
        self.sorted_len = length_at[self.sorted]


def search(shard: pa.Array, bench: Benchmark):
    """Of each text: words, hit flags of its words, item numbers found, and the longest match (words, item, place)."""
    raw, off = text_bytes(shard)
    low = ascii_lower(raw)
    starts, ends, before = word_bounds(low, off, NOT_ALNUM)
    rows, counts = len(off) - 1, np.diff(before)
    hits = np.zeros(len(starts) + 1, np.int64)
    found: list[set[int]] = [set() for _ in range(rows)]
    longest = [(0, None, None)] * rows
    if len(starts) and len(bench.vocab):
        words = span_hashes(low, starts, ends)
        at = np.minimum(np.searchsorted(bench.vocab, words), len(bench.vocab) - 1)
        number = np.where(bench.vocab[at] == words, at + 1, 0)
        t = np.zeros(len(words) + rows + 1, np.int64)
        row_of = np.repeat(np.arange(rows), counts)
        t[np.arange(len(words)) + row_of] = number
        stops = np.flatnonzero(t == 0)  # runs too short for any window hold no suffix that counts
        run = np.diff(np.concatenate([[-1], stops])) - 1
        t[np.flatnonzero(t > 0)[np.repeat(run, run) < bench.least]] = 0
        sa = suffix_array(t, bench.depth)
        if len(sa):
            row_at = np.zeros(len(t), np.int64)
            row_at[np.arange(len(words)) + row_of] = row_of
            lo = bound(t, sa, bench.q, bench.win_at, bench.win_len, False)
            hi = bound(t, sa, bench.q, bench.win_at, bench.win_len, True)
            for w in np.flatnonzero(hi > lo):
                places = sa[lo[w] : hi[w]]
                own = row_at[places]
                np.add.at(hits, places - own, 1)
                np.add.at(hits, places - own + bench.win_len[w], -1)
                for r in np.unique(own):
                    found[r].update(bench.win_items[w])
            # every suffix of the shard, not only those next to a test suffix, against its two neighbours among these
            here = bound(t, sa, bench.q, bench.sorted, bench.sorted_len, False)
            after = np.searchsorted(here, np.arange(len(sa)), "right")
            n = np.zeros(len(sa), np.int64)
            for near in (np.maximum(after - 1, 0), np.minimum(after, len(here) - 1)):
                n = np.maximum(n, common_prefix(t, sa, bench.q, bench.sorted[near], bench.sorted_len[near]))
            long = np.flatnonzero(n >= bench.least)
            places, n = sa[long], n[long]
            own = row_at[places]
            order = np.lexsort((places, -n, own))
            rows_hit, first = np.unique(own[order], return_index=True)
            top = order[first]  # of each row the longest, and the first of these
            low_at = bound(bench.q, bench.sorted, t, places[top], n[top], False)
            high_at = bound(bench.q, bench.sorted, t, places[top], n[top], True)
            for r, k, i, j in zip(rows_hit, top, low_at, high_at):
                longest[r] = (int(n[k]), int(bench.sorted_item[i:j].min()), int(places[k] - r - before[r]))
    return counts, np.cumsum(hits[:-1]) > 0, before, found, longest


def rank(match: tuple) -> tuple:
    """Order of matches (words, item, place): the longest, then the first in the text, then the least item, null first."""
    return -match[0], match[2], match[1] is not None, match[1] or 0


#: Bytes of text in a shard: small, as a task keeps its arrays beside the workers of other stages.
SHARD = 2 << 20

FOUND = "n_words long, n_hit long, hit_words binary, items array<long>, match_words long, match_item long, match_at long"


def match_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text", block_bytes: int = 16 << 20) -> DataFrame:
    """docs and, of each: n_words, hit_words (a bit for each word), items found, and its longest verbatim match
    with a test suffix (words, item, word it begins at; ties: the first place, then the least item)."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length("text") + 32)).first()[0] or 0
    blocks = -(-int(total) // block_bytes) or 1
    old = [c for c in docs.columns if c in {x.split()[0] for x in FOUND.split(", ")}]
    docs = docs.drop(*old)
    names = docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", " + FOUND
    for b in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        own = [tuple(r) for r in part.collect()]  # at most about block_bytes, whatever the benchmark's size
        own.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
        sent = docs.sparkSession.sparkContext.broadcast(own)

        def run(batches, sent=sent, first=b == 0):
            bench = Benchmark(sent.value, window)
            for whole in batches:
                for batch in slices(whole, text, SHARD):
                    counts, hit, before, found, longest = search(batch.column(text), bench)
                    was = None if first else {c: batch.column(c).to_pylist() for c in ("hit_words", "items", "match_words", "match_item", "match_at")}
                    bits, ids, best, n_hit = [], [], [], []
                    for r in range(batch.num_rows):
                        flags = hit[before[r] : before[r + 1]]
                        own_ids = {bench.ids[i] for i in found[r]} - {None}
                        top = longest[r]
                        if top[1] is not None:
                            top = (top[0], bench.ids[top[1]], top[2])
                        if was:
                            flags = flags | np.unpackbits(np.frombuffer(was["hit_words"][r], np.uint8), count=len(flags)).astype(bool)
                            own_ids |= set(was["items"][r])
                            old = tuple(was[c][r] for c in ("match_words", "match_item", "match_at"))
                            if old[0] and (not top[0] or rank(old) < rank(top)):
                                top = old
                        n_hit.append(int(flags.sum()))
                        bits.append(np.packbits(flags).tobytes())
                        ids.append(sorted(own_ids))
                        best.append(top)
                    kept = [batch.column(c) for c in names]
                    yield pa.RecordBatch.from_arrays(
                        [*kept, pa.array(counts, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(bits, pa.binary()), pa.array(ids, pa.list_(pa.int64())), *(pa.array([x[i] for x in best], pa.int64()) for i in range(3))],
                        names=[*names, "n_words", "n_hit", "hit_words", "items", "match_words", "match_item", "match_at"],
                    )
                    del counts, hit, before, found, longest
                release()

        frame = docs if b == 0 else frame  # noqa: F821
        frame = frame.mapInArrow(run, schema)
        if b < blocks - 1:
            frame = stored(frame)
    return frame


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """docs without the rows that hold a window of the benchmark."""
    return match_benchmark(docs, benchmark, window).where("n_hit = 0").select(*docs.columns)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest of the contract."""
    found = match_benchmark(docs.select("doc_id", "text"), benchmark)
    listed = F.concat_ws(",", F.array_sort(F.transform("items", lambda x: x.cast("string"))))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE = r"""
WITH dw AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
dg AS (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)),
hit AS (SELECT DISTINCT rid, n, i FROM dg SEMI JOIN win USING (n, g)),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hit) GROUP BY rid),
it AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT dg.rid, win.item_id FROM dg JOIN win USING (n, g)) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (rid) LEFT JOIN it USING (rid)
"""
