"""Suffix-array dedup: every byte that a 100-byte string covers which also starts earlier, found exactly.

A sparse suffix array over the whole corpus. Of the 100-byte windows of a text each chooses its least-hashed gram;
equal windows choose equal ones at equal places, so suffixes need sorting only where they begin with a chosen gram
(an anchor; about one byte in 39). Anchors whose gram no other place has are dropped first (their hashes are
exchanged, each once a chunk), with every window that chose one. The suffixes left carry the bytes of their windows;
sampled splitters range-partition them by leading tokens (8 bytes each), and each bucket sorts its own by multikey
quicksort, a token at a time among those still tied, onwards from the anchor and then backwards from it. The common
prefixes of neighbours in both orders tell exactly which windows are equal: those whose suffixes are alike for all
bytes after the anchor and all before it. Of equal windows, all but the first are covered. A gram at the end of
a bucket may go on in the next (and one that very many share is worked off in pieces), so the first window of each kind
there is compared across boundaries, by its bytes. A piece keeps these claims packed and exchanges their hashes; only
windows whose hash another piece has too leave it as rows.

Defined cases: null text has no bytes; texts under `length` bytes lose nothing; of equal doc_ids, rows come in the
order of their slice; a null doc_id comes first; an empty table gives no rows.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import buckets, chunk_table, packed_batch, split, unpack
from .common import _BASE, _BYTE, U64, mix, release, stored, text_bytes

LENGTH, GRAM = 100, 24
BLOCK = 1 << 20
NONE = U64(2**64 - 1)
LOWEST = -(1 << 63)


def sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best of x[i:i+width], for every i with that many."""
    have = 1
    while have * 2 <= width:
        x = best(x[:-have], x[have:]) if len(x) > have else x[:0]
        have *= 2
    more = width - have
    return best(x[:-more], x[more:]) if more and len(x) > more else x if not more else x[:0]


def gram_values(raw: np.ndarray, gram: int) -> np.ndarray:
    """A hash of raw[i:i+gram], for every i with that many; never 0 or NONE."""
    with np.errstate(over="ignore"):
        part, have, out, done = _BYTE[raw], 1, None, 0
        left = gram
        while left:
            if left & 1:
                out = part if out is None else out[: len(out) - have] * U64(pow(_BASE, have, 2**64)) + part[done:]
                done += have
            left >>= 1
            if left:
                part = part[:-have] * U64(pow(_BASE, have, 2**64)) + part[have:] if len(part) > have else part[:0]
                have *= 2
            if len(part) == 0 and left:
                return np.zeros(0, np.uint64)
    return np.clip(mix(out), U64(1), NONE - U64(1))


def anchors(raw: np.ndarray, begins: np.ndarray, length: int, gram: int):
    """(window's least hash or 0, by start; anchor positions; their hashes) of texts on end, begins with the end."""
    n = len(raw)
    if n < length:
        return np.zeros(n, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    width = length - gram + 1
    value = np.full(n + width, NONE, np.uint64)
    value[: n - gram + 1] = gram_values(raw, gram)
    least = sliding(value, width, np.minimum)[:n]
    ends = np.repeat(begins[1:], np.diff(begins))
    least[np.arange(n) + length > ends] = 0
    padded = np.zeros(n + width - 1, np.uint64)
    padded[width - 1 :] = least
    at = np.flatnonzero((sliding(padded, width, np.maximum) == value[:n]) & (value[:n] != NONE))
    return least, at, value[at]


def blocks_of(off: np.ndarray, most: int = BLOCK):
    """Rows from-to of about that many bytes; a longer row is alone."""
    at, rows = 0, len(off) - 1
    while at < rows:
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield at, min(to, rows)
        at = to


def grams_of(batch: pa.RecordBatch, length: int, gram: int):
    """Sorted distinct anchor hashes of a chunk, and whether each occurs there more than once."""
    raw, off = text_bytes(batch.column("text"))
    found = [anchors(raw[off[a] : off[b]], off[a : b + 1] - off[a], length, gram)[2] for a, b in blocks_of(off)]
    keys, count = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
    return keys, count > 1


SENT = "chunk long, bucket long, n long, keys binary"


def message(chunk: int, keys: np.ndarray, n: int) -> pa.RecordBatch:
    """Sorted distinct keys of a chunk, a row for each bucket that has some."""
    parts = split(keys, n)
    return pa.RecordBatch.from_arrays(
        [pa.array([chunk] * len(parts), pa.int64()), pa.array([p[0] for p in parts], pa.int64()), pa.array([p[1].stop - p[1].start for p in parts], pa.int64()), pa.array([keys[p[1]].tobytes() for p in parts], pa.binary())],
        names=["chunk", "bucket", "n", "keys"],
    )


def masks_of(sent: DataFrame) -> DataFrame:
    """(chunk, bucket, n, mask) of messages: which of a chunk's keys in a bucket other chunks have sent too."""

    def meet(table: pa.Table) -> pa.Table:
        arrays = [np.frombuffer(k.as_buffer(), np.uint64) for k in table.column("keys")]
        keys = np.concatenate(arrays)
        order = np.argsort(keys, kind="stable")
        s = keys[order]
        twice = np.zeros(len(s), bool)
        twice[1:] = s[1:] == s[:-1]
        twice[:-1] |= s[1:] == s[:-1]
        flags = np.empty(len(s), bool)
        flags[order] = twice
        cuts = np.cumsum([len(a) for a in arrays])[:-1]
        masks = [np.packbits(f).tobytes() for f in np.split(flags, cuts)]
        del keys, order, s, twice, flags
        release()
        return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "n": table.column("n"), "mask": pa.array(masks, pa.binary())})

    return sent.groupBy("bucket").applyInArrow(meet, "chunk long, bucket long, n long, mask binary")


def flags_of(masks) -> np.ndarray:
    """The flags of a chunk's sorted keys, from its (bucket, n, mask)."""
    return np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=n).astype(bool) for _, n, m in sorted(masks)])


def shared_grams(chunks: DataFrame, n: int, length: int, gram: int) -> DataFrame:
    """(chunk, bucket, n, mask): of the sorted distinct anchor hashes of a chunk in a bucket, which other chunks have."""

    def send(batches):
        for b in batches:
            for chunk, body in zip(b.column("chunk").to_pylist(), b.column("body")):
                yield message(chunk, grams_of(unpack(body.as_buffer()), length, gram)[0], n)
        release()

    return masks_of(chunks.select("chunk", "body").mapInArrow(send, SENT))


def suffixes(batch: pa.RecordBatch, chunk: int, shared: np.ndarray, keys: np.ndarray, length: int, gram: int):
    """Of a chunk: (anchor suffixes with the bytes of their windows), and spans covered by what the chunk has earlier.

    shared: which of the sorted distinct hashes `keys` occur more than once in the corpus."""
    raw, off = text_bytes(batch.column("text"))
    ids = batch.column("doc_id").cast(pa.int64()).fill_null(LOWEST).to_numpy()
    rows, places, firsts, lasts = [], [], [], []
    for a, b in blocks_of(off):
        part, begins = raw[off[a] : off[b]], off[a : b + 1] - off[a]
        least, at, value = anchors(part, begins, length, gram)
        if not len(at):
            continue
        known = shared[np.searchsorted(keys, value)]
        start = np.flatnonzero(least > 0)
        j = np.searchsorted(at, start)
        todo = np.flatnonzero(value[j] != least[start])
        while len(todo):
            j[todo] += 1
            todo = todo[value[j[todo]] != least[start[todo]]]
        start, j = start[known[j]], j[known[j]]
        if not len(start):
            continue
        new = np.ones(len(start), bool)
        new[1:] = (j[1:] != j[:-1]) | (start[1:] != start[:-1] + 1)
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(start)) - 1
        row = np.searchsorted(begins, start[head], "right") - 1
        rows.append(row + a)
        places.append(at[j[head]] + off[a])
        firsts.append(start[head] + off[a])
        lasts.append(start[tail] + off[a])
    if not rows or not sum(map(len, rows)):
        return None
    row, place, s1, s2 = (np.concatenate(x).astype(np.int64) for x in (rows, places, firsts, lasts))
    order = np.lexsort((s1, row, ids[row]))
    row, place, s1, s2 = row[order], place[order], s1[order], s2[order]
    # equal bytes, equally cut, have an earlier equal: only the first goes on
    size = s2 - s1 + length
    at = np.concatenate([[0], np.cumsum(size)])
    data = raw[np.arange(at[-1]) + np.repeat(s1 - at[:-1], size)]
    seen: set[bytes] = set()
    again = np.zeros(len(size), bool)
    for i in range(len(size)):
        d = data[at[i] : at[i + 1]].tobytes() + int(place[i] - s1[i]).to_bytes(2, "little")
        again[i] = d in seen
        seen.add(d)
    return row, place, s1, s2, size, at, data, again, ids, off


SUFFIX = "t0 long, t1 long, doc_id long, chunk long, row int, at long, skip int, windows int, bytes binary"
SPAN = "chunk long, row int, start long, stop long"


def token(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 8 bytes at each place as a number that sorts as they do."""
    out = np.zeros(len(at), np.uint64)
    for i in range(8):
        out = (out << U64(8)) | data[at + i].astype(np.uint64)
    return (out ^ U64(1 << 63)).view(np.int64)


def spill_suffixes(chunks: DataFrame, masks: DataFrame, length: int, gram: int) -> DataFrame:
    """kind 0: suffixes; kind 1: spans that a chunk has found covered by itself."""

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({f.split()[0]: pa.array([], {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[f.split()[1]]) for f in (SUFFIX + ", stop long").split(", ")})
        if not left.num_rows:
            return empty
        chunk = left.column("chunk")[0].as_py()
        batch = unpack(left.column("body")[0].as_buffer())
        keys, twice = grams_of(batch, length, gram)
        if not right.num_rows:
            return empty
        shared = flags_of(zip(right.column("bucket").to_pylist(), right.column("n").to_pylist(), right.column("mask").to_pylist())) | twice
        got = suffixes(batch, chunk, shared, keys, length, gram)
        if got is None:
            return empty
        row, place, s1, s2, size, at, data, again, ids, off = got
        own = np.flatnonzero(~again)
        skip = place - s1
        base = off[row]
        bytes_ = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
        spans = np.flatnonzero(again)
        both = np.concatenate([own, spans])
        mine = pa.array(np.arange(len(both)) >= len(own))
        where = at[:-1] + skip
        release()
        return pa.table({
            "t0": pa.array(token(data, where)[both]),
            "t1": pa.array(token(data, where + 8)[both]),
            "doc_id": pa.array(ids[row][both]),
            "chunk": pa.array(np.full(len(both), chunk)),
            "row": pa.array(row[both].astype(np.int32)),
            "at": pa.array((s1 - base)[both]),
            "skip": pa.array(skip[both].astype(np.int32)),
            "windows": pa.array((s2 - s1 + 1)[both].astype(np.int32)),
            "bytes": pa.compute.if_else(mine, pa.scalar(None, pa.binary()), bytes_.take(pa.array(both))),
            "stop": pa.compute.if_else(mine, pa.array((s2 - base + length)[both]), pa.scalar(None, pa.int64())),
        })

    return chunks.select("chunk", "body").groupBy("chunk").cogroup(masks.groupBy("chunk")).applyInArrow(join, SUFFIX + ", stop long")


def words_of(data: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The 8 bytes at each place as a number that sorts as they do; bytes beyond the `left` ones count as 0. data goes on
    for 8 bytes after its last place."""
    word = data[at[:, None] + np.arange(8)].view(">u8").ravel().astype(np.uint64)
    over = np.clip(8 - left, 0, 8).astype(np.uint64)
    return np.where(over == 8, U64(0), word >> (over % U64(8) * U64(8)) << (over % U64(8) * U64(8)))


def multikey_quicksort(data: np.ndarray, at: np.ndarray, size: np.ndarray, group: np.ndarray, depth: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings data[at : at + size] within groups (numbers that ascend; strings of a group agree in their
    first `depth` bytes), and of each place in that order the bytes that its string has in common with the one before,
    `most` at most; 0 at the head of a group. Each round splits all that are still tied by their next 8 bytes."""
    n = len(at)
    order, common, places = np.arange(n), np.zeros(n, np.int64), np.arange(n)
    data = np.concatenate([data, np.zeros(most + 8, np.uint8)])
    while len(places):
        word = words_of(data, at[order[places]] + depth, size[order[places]] - depth)
        by = np.lexsort((word, group))
        order[places], word = order[places][by], word[by]
        same = group[1:] == group[:-1]
        equal = same & (word[1:] == word[:-1])
        apart = np.flatnonzero(same & ~equal)
        differ = word[apart + 1] ^ word[apart]
        common[places[apart + 1]] = depth + sum((differ >> U64(64 - 8 * k) == 0).astype(np.int64) for k in range(1, 8))
        depth += 8
        if depth >= most:
            common[places[np.flatnonzero(equal) + 1]] = most
            break
        new = np.ones(len(places), bool)
        new[1:] = ~equal
        run = np.cumsum(new) - 1
        tied = np.bincount(run)[run] > 1
        places, group = places[tied], run[tied]
    return order, common


def equal_from(order: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
    """A number of each string that those have which agree in their first `depth` bytes."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(common < depth)
    return out


def compare(b: dict, length: int, gram: int, edge: np.ndarray):
    """Windows of suffixes, in the order of place: covered spans, and claims (first windows of edge suffixes): owner and
    how many bytes after the suffix's first the window begins, in the order of owners."""
    data, begin = b["data"], b["off"][:-1]
    skip, count = b["skip"].astype(np.int64), b["windows"].astype(np.int64)
    heads = np.concatenate([[0], np.cumsum(count)])
    tokens = np.lexsort((b["t1"], b["t0"]))
    new = np.ones(len(tokens), bool)
    new[1:] = (b["t0"][tokens][1:] != b["t0"][tokens][:-1]) | (b["t1"][tokens][1:] != b["t1"][tokens][:-1])
    order, common = multikey_quicksort(data, (begin + skip)[tokens], (b["off"][1:] - begin - skip)[tokens], np.cumsum(new), 16, length)
    order = tokens[order]
    # only suffixes that share their gram go on
    alike = equal_from(order, common, gram)
    live = np.flatnonzero(np.bincount(alike)[alike] > 1)
    covered = np.zeros(heads[-1], bool)
    if len(live):
        onward = np.flatnonzero(np.isin(order, live))
        place = np.empty(len(begin), np.int64)
        place[live] = np.arange(len(live))
        # between two live neighbours, what others stand between them have in common is no more than their own
        least = np.minimum.reduceat(common, np.append(0, onward[:-1] + 1)) if len(onward) else common[:0]
        order = place[order[onward]]
        grams = equal_from(order, least, gram)
        by = np.argsort(grams, kind="stable")
        back = data[::-1]
        order2, common2 = multikey_quicksort(back, (len(data) - begin - skip)[live][by], skip[live][by], grams[by], 0, length - gram)
        order2 = by[order2]
        own_skip, own_count, own_heads = skip[live], count[live], heads[live]
        for r in range(length - gram + 1):
            have = np.flatnonzero((own_skip >= r) & (own_skip - own_count < r))
            if len(have) < 2:
                continue
            key = equal_from(order, least, length - r)[have] * (len(live) + 1) + equal_from(order2, common2, r)[have]
            later = np.ones(len(have), bool)
            later[np.unique(key, return_index=True)[1]] = False
            covered[own_heads[have[later]] + own_skip[have[later]] - r] = True
    owner = np.repeat(np.arange(len(begin)), count)
    shift = np.arange(heads[-1]) - heads[owner]
    new = covered.copy()
    new[1:] &= ~(covered[:-1] & (owner[1:] == owner[:-1]))
    last = covered.copy()
    last[:-1] &= ~(covered[1:] & (owner[1:] == owner[:-1]))
    f, l = np.flatnonzero(new), np.flatnonzero(last)
    spans = (owner[f], b["at"][owner[f]] + shift[f], b["at"][owner[l]] + shift[l] + length)
    c = np.flatnonzero(~covered & edge[owner])
    return spans, (owner[c], shift[c])


FOUND = SPAN + ", piece long, claims long, body binary"
#: Suffixes that a bucket sorts at a time, and those of one beginning, beyond which they are sorted in pieces.
HELD, PIECE = 50_000, 200_000


def covered_spans(suffix: DataFrame, length: int, gram: int, held_most: int = HELD, piece: int = PIECE) -> DataFrame:
    """Spans (body null), and of each piece of a range, packed, its claims: first windows that other ranges or pieces may
    have earlier."""
    windows = suffix.agg(F.sum("windows")).first()[0] or 0
    parts = max(int(suffix.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-windows // 4_000_000))
    dealt = suffix.drop("stop").repartitionByRange(parts, "t0", "t1", "doc_id", "chunk", "row", "at").sortWithinPartitions("t0", "t1")
    names = ["t0", "t1", "doc_id", "chunk", "row", "at", "skip", "windows"]
    found = [f.split()[0] for f in FOUND.split(", ")]

    def span_rows(b, owner, start, stop):
        none = [pa.nulls(len(owner), t) for t in (pa.int64(), pa.int64(), pa.binary())]
        return pa.RecordBatch.from_arrays([pa.array(b["chunk"][owner]), pa.array(b["row"][owner].astype(np.int32)), pa.array(start), pa.array(stop), *none], names=found)

    def claim_row(b, owner, shift, piece: int):
        own, first = np.unique(owner, return_index=True)
        shifts = pa.ListArray.from_arrays(pa.array(np.append(first, len(owner)).astype(np.int32)), pa.array(shift.astype(np.int32)))
        columns = {c: pa.array(b[c][own]) for c in ("doc_id", "chunk", "row", "at", "skip")}
        body = packed_batch(pa.RecordBatch.from_arrays([*columns.values(), b["bytes"].take(pa.array(own)), shifts], names=[*columns, "bytes", "shifts"]))
        none = [pa.nulls(1, t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int64())]
        return pa.RecordBatch.from_arrays([*none, pa.array([piece]), pa.array([len(owner)]), pa.array([body], pa.binary())], names=found)

    def run(batches):
        held: list[pa.RecordBatch] = []
        held_rows = 0
        open_: list[tuple] = []  # beginnings that other ranges or pieces may have too
        numbers = itertools.count(TaskContext.get().partitionId() << 24)

        def work(table: pa.Table, goes_on: bool):
            b = {c: table.column(c).to_numpy() for c in names}
            if not open_:
                open_.append((b["t0"][0], b["t1"][0]))
            if goes_on:
                open_[1:] = [(b["t0"][-1], b["t1"][-1])]
            order = np.lexsort((b["at"], b["row"], b["chunk"], b["doc_id"]))
            b = {c: v[order] for c, v in b.items()}
            b["bytes"] = table.column("bytes").combine_chunks().take(pa.array(order))
            b["data"], b["off"] = text_bytes(b["bytes"])
            edge = np.zeros(len(order), bool)
            for t0, t1 in open_:
                edge |= (b["t0"] == t0) & (b["t1"] == t1)
            spans, (owner, shift) = compare(b, length, gram, edge)
            yield span_rows(b, *spans)
            if len(owner):
                yield claim_row(b, owner, shift, next(numbers))

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            held_rows += batch.num_rows
            if held_rows < held_most:
                continue
            ends = [(x.column("t0")[k].as_py(), x.column("t1")[k].as_py()) for x, k in ((held[0], 0), (batch, batch.num_rows - 1))]
            if ends[0] == ends[1]:
                if held_rows >= piece:
                    yield from work(pa.Table.from_batches(held), True)
                    held, held_rows = [], 0
                continue
            table = pa.Table.from_batches(held)
            t0, t1 = table.column("t0").to_numpy(), table.column("t1").to_numpy()
            whole = int(np.flatnonzero((t0 != t0[-1]) | (t1 != t1[-1]))[-1]) + 1
            yield from work(table.slice(0, whole), False)
            held, held_rows = table.slice(whole).to_batches(), table.num_rows - whole
        if held:
            yield from work(pa.Table.from_batches(held), True)
        held = []
        release()

    return dealt.mapInArrow(run, FOUND)


def claim_keys(batch: pa.RecordBatch, length: int):
    """Of packed claims: a hash of each one's bytes and its gram's place in them, its suffix, where it begins in that,
    and the bytes of the suffixes on end with their beginnings."""
    shift = batch.column("shifts").flatten().to_numpy()
    owner = np.repeat(np.arange(batch.num_rows), batch.column("shifts").value_lengths().to_numpy())
    raw, off = text_bytes(batch.column("bytes"))
    value = np.empty(len(owner), np.uint64)
    for a, b in blocks_of(off):
        here = slice(*np.searchsorted(owner, [a, b]))
        value[here] = gram_values(raw[off[a] : off[b]], length)[off[owner[here]] - off[a] + shift[here]]
    before = batch.column("skip").to_numpy()[owner] - shift
    return mix(value ^ mix(before.astype(np.uint64))), owner, shift, raw, off


CLAIM = SPAN + ", doc_id long, before int, window binary"


def claims_met(pieces: DataFrame, length: int, block: int = 1 << 17) -> DataFrame:
    """Claims whose hash another claim has: a claim that is alone has no equal in another piece."""
    total = pieces.agg(F.sum("claims")).first()[0] or 0
    n = max(1, -(-total // (4 << 20)))

    def send(batches):
        for b in batches:
            for piece, body in zip(b.column("piece").to_pylist(), b.column("body")):
                yield message(piece, np.unique(claim_keys(unpack(body.as_buffer()), length)[0]), n)
        release()

    def rows(batches):
        for b in batches:
            for body, masks in zip(b.column("body"), b.column("masks").to_pylist()):
                batch = unpack(body.as_buffer())
                key, owner, shift, raw, off = claim_keys(batch, length)
                keys, back, count = np.unique(key, return_inverse=True, return_counts=True)
                met = np.flatnonzero((flags_of((m["bucket"], m["n"], m["mask"]) for m in masks) | (count > 1))[back])
                del key, keys, back, count
                for at in range(0, len(met), block):
                    some = met[at : at + block]
                    own, start = owner[some], batch.column("at").to_numpy()[owner[some]] + shift[some]
                    window = raw[(off[own] + shift[some])[:, None] + np.arange(length)]
                    ends = pa.py_buffer((np.arange(len(some) + 1, dtype=np.int32) * length).tobytes())
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("chunk").take(pa.array(own)), batch.column("row").take(pa.array(own)), pa.array(start), pa.array(start + length), batch.column("doc_id").take(pa.array(own)), pa.array((batch.column("skip").to_numpy()[own] - shift[some]).astype(np.int32)), pa.Array.from_buffers(pa.binary(), len(some), [None, ends, pa.py_buffer(window.tobytes())])],
                        names=[f.split()[0] for f in CLAIM.split(", ")],
                    )
        release()

    masks = masks_of(pieces.select("piece", "body").mapInArrow(send, SENT)).groupBy(F.col("chunk").alias("piece")).agg(F.collect_list(F.struct("bucket", "n", "mask")).alias("masks"))
    return pieces.select("piece", "body").join(masks, "piece").select("body", "masks").mapInArrow(rows, CLAIM)


def spans_of(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """(chunks, spans): the documents by the chunk, and what is covered in them (spans may overlap)."""
    chunks = chunk_table(docs)
    masks = shared_grams(chunks, buckets(chunks), length, gram)
    split_ = stored(spill_suffixes(chunks, masks, length, gram))
    found = stored(covered_spans(split_.where("stop is null"), length, gram))
    first = Window.partitionBy("before", "window").orderBy("doc_id", "chunk", "row", "start")
    late = claims_met(found.where("body is not null"), length).withColumn("n", F.row_number().over(first)).where("n > 1")
    spans = found.where("body is null").select("chunk", "row", "start", "stop").unionByName(late.select("chunk", "row", "start", "stop"))
    own = split_.where("stop is not null").select("chunk", "row", F.col("at").alias("start"), "stop")
    return chunks, spans.unionByName(own)


def cut(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """docs and, of each: n_bytes, n_removed, spans (maximal covered runs of bytes), kept (the other bytes)
    and kept_text (these without what is left of a character that was cut)."""
    docs = docs.drop("n_bytes", "n_removed", "spans", "kept", "kept_text")
    chunks, spans = spans_of(docs, length, gram)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", n_bytes long, n_removed long, spans array<struct<start:long,stop:long>>, kept binary, kept_text string"
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        batch = unpack(left.column("body")[0].as_buffer())
        raw, off = text_bytes(batch.column("text"))
        row = right.column("row").to_numpy()
        mark = np.zeros(len(raw) + 1, np.int64)
        np.add.at(mark, off[row] + right.column("start").to_numpy(), 1)
        np.add.at(mark, off[row] + right.column("stop").to_numpy(), -1)
        gone = np.cumsum(mark[:-1]) > 0
        sizes, removed, lists, kept = [], [], [], []
        for i in range(batch.num_rows):
            g = gone[off[i] : off[i + 1]]
            edge = np.flatnonzero(np.diff(np.concatenate([[0], g.view(np.int8), [0]])))
            sizes.append(len(g))
            removed.append(int(g.sum()))
            lists.append([{"start": int(x), "stop": int(y)} for x, y in zip(edge[::2], edge[1::2])])
            kept.append(raw[off[i] : off[i + 1]][~g].tobytes())
        out = pa.Table.from_batches([batch])
        for name, values, t in (("n_bytes", sizes, pa.int64()), ("n_removed", removed, pa.int64()), ("spans", lists, kind), ("kept", kept, pa.binary()), ("kept_text", [k.decode(errors="ignore") for k in kept], pa.string())):
            out = out.append_column(name, pa.array(values, t))
        del batch, raw, mark, gone
        release()
        return out

    return chunks.select("chunk", "body").groupBy("chunk").cogroup(spans.groupBy("chunk")).applyInArrow(join, schema)


def report(docs: DataFrame) -> DataFrame:
    """The digest of the contract."""
    out = cut(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
