"""LM scoring by deleted interpolation: bigram and unigram maximum-likelihood estimates and the uniform one, mixed by
weights that depend on how often the context was seen, learned by expectation-maximisation on held-out counts.

Every chunk sends each of its distinct unigrams and bigrams once, with its counts in the training texts and in their
deleted part (a tenth of the training texts, by id); what all chunks have comes back in the same order. Weights are
learned where the counts without the deleted part meet the events of that part: all its tokens count, gathered by
the exact counts that their estimates are made of. That table stays in Spark: a round of expectation-maximisation is
one aggregate over it, of which a row a level comes to the driver. Scores use all training counts.

Defined cases: null and empty texts are one token, the end; a null doc_id counts as the empty text in the split; rows
of one doc_id are each scored and each learned from; without training texts the estimates are uniform; an empty table
gives no rows.
"""

from __future__ import annotations

import warnings
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import buckets, chunk_table, pack, split, unpack, unpack_array
from .common import U64, WHITE, ascii_lower, mix, release, span_hashes, stored, text_bytes, word_bounds

END, BEGIN = U64(0x3C6EF372FE94F82B), U64(0x510E527FADE682D1)
LEVELS = 64
FEWEST = 1e-6  # of any weight


def residue(doc_id) -> int:
    return zlib.crc32(str("" if doc_id is None else doc_id).encode())


def held_out(crc: np.ndarray) -> np.ndarray:
    return crc % 7 == 2


def deleted(crc: np.ndarray) -> np.ndarray:
    return crc // 7 % 10 == 0


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, byte by byte."""
    steps = np.diff(keys, prepend=U64(0))
    return pack(steps.view(np.uint8).reshape(-1, 8).T.copy())


def unpacked_keys(blob, n: int) -> np.ndarray:
    return np.cumsum(unpack_array(blob, np.uint8, 8 * n).reshape(8, n).T.copy().view(np.uint64).ravel())


class Grams:
    """A chunk's texts as n-grams: `keys` sorted and distinct (odd: unigrams), and of each token its row, the place of
    its unigram, its context's unigram and its bigram among the keys."""

    def __init__(self, batch: pa.RecordBatch):
        raw, off = text_bytes(batch.column("text"))
        low = ascii_lower(raw)
        starts, ends, before = word_bounds(low, off, WHITE)
        words = span_hashes(low, starts, ends)
        del raw, low, starts, ends
        rows, counts = batch.num_rows, np.diff(before)
        self.ids = batch.column("doc_id").to_pylist()
        self.crc = np.array([residue(i) for i in self.ids], np.int64)
        self.row = np.repeat(np.arange(rows, dtype=np.int32), counts + 1)
        tokens = np.full(len(words) + rows, END, np.uint64)
        tokens[np.arange(len(words)) + np.repeat(np.arange(rows), counts)] = words
        context = np.empty_like(tokens)
        context[1:] = tokens[:-1]
        self.begins = before + np.arange(rows + 1)
        context[self.begins[:-1]] = BEGIN
        one = U64(1)
        with np.errstate(over="ignore"):
            pairs = mix(context * U64(0x9FB21C651E98DF25) + tokens) & ~one
        del words, context
        # unigrams and bigrams by themselves: sorting them together takes twice the memory
        tokens |= one
        single, token = np.unique(tokens, return_inverse=True)
        token = token.astype(np.int32)
        del tokens
        double, pair = np.unique(pairs, return_inverse=True)
        pair = pair.astype(np.int32)
        del pairs
        begin = np.full(min(rows, 1), BEGIN | one, np.uint64)
        self.keys = np.sort(np.concatenate([np.union1d(single, begin), double]))
        place = lambda keys: np.searchsorted(self.keys, keys).astype(np.int32)
        self.token, self.pair, self.start = place(single)[token], place(double)[pair], np.repeat(place(begin), rows)
        self.context = np.empty_like(self.token)
        self.context[1:] = self.token[:-1]
        self.context[self.begins[:-1]] = self.start

    def counts(self, rows: np.ndarray) -> np.ndarray:
        """Occurrences of each key in the rows that are True; BEGIN is counted once a row."""
        n = len(self.keys)
        own = rows[self.row]
        return np.bincount(self.token[own], minlength=n) + np.bincount(self.pair[own], minlength=n) + np.bincount(self.start[rows], minlength=n)

    def blocks(self, most: int = 1 << 18):
        """(first row, row after the last) of about that many tokens, of a row at least."""
        a = 0
        while a < len(self.ids):
            b = max(a + 1, int(np.searchsorted(self.begins, self.begins[a] + most, "right")) - 1)
            yield a, b
            a = b


def met(table: pa.Table, most: int = 1 << 19) -> pa.Table:
    """A bucket's messages answered: of every key sent, in the order sent, the sums over all chunks; and a row of chunk -1
    (see count_exchange). The bucket's range is taken by parts of about `most` keys, whose sums are all that is held of
    them besides the messages and the answers."""
    sizes = table.column("n").to_pylist()
    keys = [unpacked_keys(k.as_buffer(), n) for k, n in zip(table.column("keys"), sizes)]
    sent = {name: [unpack_array(c.as_buffer(), np.uint32, n) for c, n in zip(table.column(name), sizes)] for name in ("all", "cut")}
    back = {name: [np.empty(n, np.int64) for n in sizes] for name in sent}
    low, high = int(min(k[0] for k in keys)), int(max(k[-1] for k in keys)) + 1
    parts = -(-sum(sizes) // most)
    bounds = np.array([low + (high - low) * i // parts for i in range(1, parts)], np.uint64)
    edges = [np.concatenate([[0], np.searchsorted(k, bounds), [len(k)]]) for k in keys]
    types, sums = 0, dict.fromkeys(sent, 0)
    for i in range(parts):
        where = [slice(e[i], e[i + 1]) for e in edges]
        distinct, at = np.unique(np.concatenate([k[w] for k, w in zip(keys, where)]), return_inverse=True)
        cuts = np.cumsum([w.stop - w.start for w in where])[:-1]
        single = (distinct & U64(1)).astype(bool) & (distinct != BEGIN | U64(1))
        for name in sent:
            total = np.bincount(at, np.concatenate([x[w] for x, w in zip(sent[name], where)]), len(distinct)).astype(np.int64)
            for out, w, x in zip(back[name], where, np.split(total[at], cuts)):
                out[w] = x
            sums[name] += int(total[single].sum())
            types += int((single & (total > 0)).sum()) if name == "all" else 0
    bucket = table.column("bucket")[0].as_py()
    return pa.table({
        "chunk": pa.array([*table.column("chunk").to_pylist(), -1], pa.int64()),
        "bucket": pa.array([bucket] * (len(sizes) + 1), pa.int64()),
        "n": pa.array([*sizes, types], pa.int64()),
        **{name: pa.array([*map(pack, back[name]), sums[name].to_bytes(8, "little")], pa.binary()) for name in sent},
    })


def count_exchange(chunks: DataFrame, n: int) -> DataFrame:
    """(chunk, bucket, n, all, cut): of a chunk's keys in a bucket, the counts in all training texts and in the
    deleted part; a row of chunk -1 for each bucket: n distinct training unigrams, all and cut their tokens."""

    def send(batches):
        for b in batches:
            for chunk, body in zip(b.column("chunk").to_pylist(), b.column("body")):
                g = Grams(unpack(body.as_buffer()))
                train = ~held_out(g.crc)
                whole, part = g.counts(train).astype(np.uint32), g.counts(train & deleted(g.crc)).astype(np.uint32)
                parts = split(g.keys, n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk] * len(parts), pa.int64()), pa.array([p[0] for p in parts], pa.int64()), pa.array([p[1].stop - p[1].start for p in parts], pa.int64()), *(pa.array([f(x[p[1]]) for p in parts], pa.binary()) for x, f in ((g.keys, packed_keys), (whole, pack), (part, pack)))],
                    names=["chunk", "bucket", "n", "keys", "all", "cut"],
                )
                del g, whole, part, parts
                release()

    def meet(table: pa.Table) -> pa.Table:
        out = met(table)
        release()
        return out

    sent = chunks.select("chunk", "body").mapInArrow(send, "chunk long, bucket long, n long, keys binary, all binary, cut binary")
    return sent.groupBy("bucket").applyInArrow(meet, "chunk long, bucket long, n long, all binary, cut binary")


def aligned(right: pa.Table, name: str) -> np.ndarray:
    rows = sorted(zip(right.column("bucket").to_pylist(), right.column("n").to_pylist(), right.column(name).to_pylist()))
    return np.concatenate([unpack_array(b, np.int64, n) for _, n, b in rows]) if rows else np.zeros(0, np.int64)


def level(context: np.ndarray) -> np.ndarray:
    """Bucket of a context's count: 0 for none, then by the power of two."""
    return np.where(context > 0, np.floor(np.log2(np.maximum(context, 1))).astype(np.int64) + 1, 0)


def estimates(g: Grams, count: np.ndarray, tokens: int, own: np.ndarray | slice = slice(None)):
    c = count[g.context[own]]
    return level(c), count[g.pair[own]] / np.maximum(c, 1), count[g.token[own]] / max(tokens, 1)


def held_out_events(chunks: DataFrame, back: DataFrame) -> DataFrame:
    """l, context, pair, own, n of the deleted part: how many of its tokens have these counts (context, bigram, token) in
    the other training texts, and the level of the context; written once, as every round reads it."""

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({c: pa.array([], pa.int64()) for c in ("l", "context", "pair", "own", "n")})
        if not left.num_rows or not right.num_rows:
            return empty
        release()
        g = Grams(unpack(left.column("body")[0].as_buffer()))
        own = (~held_out(g.crc) & deleted(g.crc))[g.row]
        if not own.any():
            return empty
        count = aligned(right, "all") - aligned(right, "cut")
        found = np.stack([count[g.context[own]], count[g.pair[own]], count[g.token[own]]])
        found = found[:, np.lexsort(found)]
        first = np.flatnonzero(np.append(True, (np.diff(found) != 0).any(0)))
        c, pair, token = found[:, first]
        return pa.table({"l": level(c), "context": c, "pair": pair, "own": token, "n": np.diff(np.append(first, found.shape[1]))})

    rows = chunks.select("chunk", "body").groupBy("chunk").cogroup(back.where("chunk >= 0").groupBy("chunk")).applyInArrow(join, "l long, context long, pair long, own long, n long")
    return stored(rows.groupBy("l", "context", "pair", "own").agg(F.sum("n").alias("n")))


def learn(events: DataFrame, tokens: int, uniform: float, rounds: int = 60, settled: float = 1e-4) -> np.ndarray:
    """Weights (level x bigram, unigram, uniform) by expectation-maximisation: one set for all events, and by level one
    that leans on it with eight events. Rounds end when none moves a weight by more than `settled`; a warning says so
    if that takes more than `rounds`.

    Two rounds give the course of each set of weights, along which it then leaps (squared extrapolation); a round from
    there counts if it moves the set less than the round before did. The fixed point is that of the plain rounds."""
    p = [F.col("pair") / F.greatest("context", F.lit(1)), F.col("own") / F.lit(max(tokens, 1)), F.lit(uniform)]
    share = lambda x, i: F.sum(F.col("n") * x[i] / (x[0] + x[1] + x[2]))

    def after(now: np.ndarray) -> np.ndarray:
        """now: weights by level, the common ones last; after one round over all events."""
        own = [F.get(F.lit(now[:-1, i].tolist()), F.col("l").cast("int")) * p[i] for i in range(3)]
        all_ = [F.lit(float(now[-1, i])) * p[i] for i in range(3)]
        sums = events.groupBy("l").agg(*[share(x, i).alias(f"{name}{i}") for name, x in (("o", own), ("a", all_)) for i in range(3)]).collect()  # a row a level
        if not sums:
            return now
        got = np.zeros((LEVELS + 1, 3))
        for r in sorted(sums):
            got[r["l"]] = [r["o0"], r["o1"], r["o2"]]
            got[-1] += [r["a0"], r["a1"], r["a2"]]
        got[-1] = inside(got[-1:] / got[-1].sum())
        got[:-1] += 8 * got[-1]
        return inside(got / got.sum(1, keepdims=True))

    now, move, spent = np.tile([0.4, 0.5, 0.1], (LEVELS + 1, 1)), np.inf, 0
    while spent < rounds:
        one = after(now)
        two = after(one)
        spent += 3
        if (move := np.abs(two - one).max()) <= settled:
            return two[:-1]
        course, bend = one - now, two - 2 * one + now
        length = lambda x: np.sqrt((x * x).sum(1, keepdims=True))
        far = np.maximum(length(course) / np.maximum(length(bend), 1e-12), 1)
        while (out := (now + 2 * far * course + far * far * bend).min(1, keepdims=True) < FEWEST).any() and (far[out] > 1.01).any():
            far = np.where(out, (1 + far) / 2, far)
        leap = inside(now + 2 * far * course + far * far * bend)
        then = after(leap)
        now = np.where(length(then - leap) <= length(two - one), then, two)
    warnings.warn(f"after {spent} rounds of expectation-maximisation weights still move by {move:.2g}", stacklevel=2)
    return now[:-1]


def inside(weights: np.ndarray) -> np.ndarray:
    """Rows of weights, none below the least, that add up to one."""
    weights = np.maximum(weights, FEWEST)
    return weights / weights.sum(1, keepdims=True)


def lm_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each text."""
    chunks = chunk_table(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    back = stored(count_exchange(chunks, buckets(chunks)), packed=True)
    types = tokens = cut = 0
    for n, a, c in back.where("chunk = -1").select("n", "all", "cut").toLocalIterator():  # a row a bucket
        types, tokens, cut = types + n, tokens + int.from_bytes(a, "little"), cut + int.from_bytes(c, "little")
    uniform = 1 / (types + 1)
    weights = learn(held_out_events(chunks, back), tokens - cut, uniform)

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        release()
        g = Grams(unpack(left.column("body")[0].as_buffer()))
        count = aligned(right, "all")
        known, base, score = np.zeros(len(g.ids), np.int64), np.zeros(len(g.ids)), np.zeros(len(g.ids))
        for a, b in g.blocks():
            some = slice(g.begins[a], g.begins[b])
            total = lambda x: np.add.reduceat(x, g.begins[a:b] - g.begins[a])  # noqa: B023, E731
            l, p2, p1 = estimates(g, count, tokens, some)
            w, own = weights[l], count[g.token[some]]
            known[a:b] = total((own > 0).astype(np.int64))
            base[a:b] = total(np.log10((own + 1) / (tokens + types + 1)))
            score[a:b] = total(np.log10(w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] * uniform))
        return pa.table({
            "doc_id": pa.array(g.ids, pa.int64()),
            "held_out": pa.array(held_out(g.crc)),
            "n_tokens": pa.array(np.diff(g.begins)),
            "n_known": pa.array(known),
            "train_tokens": pa.array(np.full(len(g.ids), tokens)),
            "base_score": pa.array(base),
            "score": pa.array(score),
        })

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return chunks.select("chunk", "body").groupBy("chunk").cogroup(back.where("chunk >= 0").groupBy("chunk")).applyInArrow(join, schema)
