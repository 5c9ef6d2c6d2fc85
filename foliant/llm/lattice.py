"""SentencePiece encoding and decoding on a relational lattice.

Texts fall apart where no piece of the model goes on (a space before a word, most punctuation), so only distinct
segments need a lattice. Their substrings up to the longest piece are exploded, equi-joined to the piece table (its
size is fixed by the model, so it is broadcast), grouped by segment again, and folded by higher-order functions. The
fold depends on the kind of model: for a unigram model it is Viterbi, the path of the greatest sum of scores; a BPE
model's scores are only the order of its merges, and no sum of them gives its encoding, so there the fold merges the
best edge between neighbours until none is left. Either way the result is what the library gives for that model.

Segments longer than `folded` characters without a cut, where folds grow with the square, are encoded by the same rules
with a heap, where their chunk is. The documents stay in bucketed chunks: only distinct segments move to the
lattice, and their ids back to the chunks that have them.

Defined cases: null and empty texts have no pieces; characters no piece has are spelt in bytes (or the unknown piece,
if the model has none); U+2581 in a text counts as the space it stands for, so it decodes to a space, as in the
library; an empty table gives no rows; columns named like the results are replaced.
"""

from __future__ import annotations

import functools
import heapq
import struct
import uuid
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import chunk_rows, unpack
from .common import release, span_hashes, text_bytes, workspace

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
MARK, STOP = "\x01", "\x02"
#: A chunk's number and a place in it share a long; a segment's cuts fit in another.
PLACE_BITS, FOLDED = 24, 64
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, USER, BYTE = 1, 2, 4, 6


def fields(data: bytes):
    """(number, value) of a protocol buffer message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(key & 7)
            n = varint() if n is None else n
            yield key >> 3, data[at : at + n]
            at += n


class Model:
    """Pieces, scores and kind of a SentencePiece file."""

    def __init__(self, data: bytes):
        self.pieces, self.scores, self.types, self.kind, self.prefix = [], [], [], UNIGRAM, True
        for number, value in fields(data):
            if number == 1:
                piece = dict(fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.types.append(piece.get(3, NORMAL))
            elif number == 2:
                self.kind = dict(fields(value)).get(3, UNIGRAM)
            elif number == 3:
                self.prefix = bool(dict(fields(value)).get(3, 1))
        self.unknown = self.types.index(UNKNOWN) if UNKNOWN in self.types else 0
        self.bytes = [-1] * 256
        for i, (piece, kind) in enumerate(zip(self.pieces, self.types)):
            if kind == BYTE:
                self.bytes[int(piece[3:-1], 16)] = i
        self.table = {p: (i, s) for i, (p, s, t) in enumerate(zip(self.pieces, self.scores, self.types)) if t in (NORMAL, USER)}
        self.longest = max(map(len, self.table), default=1)
        self.unknown_score = min((s for _, s in self.table.values()), default=0.0) - 10.0
        joints = {(ord(a), ord(b)) for p in self.table for a, b in zip(p, p[1:])}
        chars = sorted({c for j in joints for c in j})
        self.chars = np.array(chars, np.uint32)
        place = {c: i + 1 for i, c in enumerate(chars)}
        self.joined = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        for a, b in joints:
            self.joined[place[a], place[b]] = True

    def rows(self) -> list[tuple]:
        return [(p, i, float(s)) for p, (i, s) in self.table.items()]

    def spelt(self, char: str) -> list[int]:
        out = [self.bytes[b] for b in char.encode()]
        return out if -1 not in out else [self.unknown]

    @functools.cached_property
    def output(self) -> tuple[np.ndarray, np.ndarray]:
        """Bytes that each id decodes to, on end, and where each begins."""
        parts = []
        for p, t in zip(self.pieces, self.types):
            parts.append(bytes([int(p[3:-1], 16)]) if t == BYTE else p.replace(SPACE, " ").encode() if t in (NORMAL, USER) else " ⁇ ".encode() if t == UNKNOWN else b"")
        return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def cut(self, text: str, cuts: int) -> list[int]:
        """Ids of the pieces of text that begin at the bits of cuts."""
        out, begin, bits, table = [], 0, f"{cuts:b}1", self.table
        while begin < len(text):
            end = bits.index("1", begin + 1)
            piece = text[begin:end]
            if piece in table:
                out.append(table[piece][0])
            else:
                out += self.spelt(piece)
            begin = end
        return out

    def merged(self, text: str) -> list[int]:
        """Pieces of one segment by merges, best first, leftmost of equals."""
        n = len(text)
        after, before, stop = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple] = []

        def offer(a: int):
            b = after[a]
            if b < n and (hit := self.table.get(text[a : stop[b]])):
                heapq.heappush(heap, (-hit[1], a, stop[b]))

        for i in range(n - 1):
            offer(i)
        live = [True] * n
        while heap:
            _, a, end = heapq.heappop(heap)
            b = after[a] if live[a] else n
            if b >= n or not live[a] or stop[b] != end:
                continue
            live[b] = False
            stop[a], after[a] = end, after[b]
            if after[a] < n:
                before[after[a]] = a
            offer(a)
            if before[a] >= 0:
                offer(before[a])
        out: list[int] = []
        a = 0
        while a < n:
            part = text[a : stop[a]]
            out += [self.table[part][0]] if part in self.table else self.spelt(part)
            a = after[a]
        return out

    def viterbi(self, text: str) -> list[int]:
        n = len(text)
        best: list[tuple] = [(0.0, 0, [])] + [None] * n
        for e in range(1, n + 1):
            for b in range(max(0, e - self.longest), e):
                if hit := self.table.get(text[b:e]):
                    step = (best[b][0] + hit[1], b, [hit[0]])
                elif e == b + 1:
                    step = (best[b][0] + self.unknown_score, b, self.spelt(text[b]))
                else:
                    continue
                if best[e] is None or step[0] > best[e][0]:
                    best[e] = step
        out, e = [], n
        while e:
            out[:0] = best[e][2]
            e = best[e][1]
        return out

    def encode(self, text: str) -> list[int]:
        return self.merged(text) if self.kind == BPE else self.viterbi(text)


def read_model(path: str = MODEL) -> Model:
    with open(path, "rb") as f:
        return Model(f.read())


class Segments:
    """Where a chunk's texts fall apart: code points, starts and ends of segments, segments before each row; and the
    distinct ones (sorted hashes), with the place of every segment among them."""

    def __init__(self, batch: pa.RecordBatch, model: Model, kind: int = 0):
        column, rows = batch.column("text"), batch.num_rows
        size = np.zeros(rows, np.int64)
        self.codes = np.empty(column.nbytes + 2 * rows, np.uint32)
        n, at = 0, 0
        while at < rows:  # a few hundred texts at a time are Python strings
            texts = [t.replace(" ", SPACE) if t else "" for t in column.slice(at, 256).to_pylist()]
            texts = [SPACE + t if t and model.prefix else t for t in texts]
            size[at : at + len(texts)] = [len(t) for t in texts]
            part = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
            self.codes[n : n + len(part)] = part
            n, at = n + len(part), at + len(texts)
        self.codes = self.codes[:n]
        off = np.concatenate([[0], np.cumsum(size)])
        table, block = place_table(model), 1 << 20
        cut = np.ones(n, bool)
        for i in range(0, n, block):
            place = table[self.codes[max(i - 1, 0) : i + block]]
            cut[max(i, 1) : i + block] = ~model.joined[place[:-1], place[1:]]
        cut[off[:-1][off[:-1] < n]] = True
        self.starts = np.flatnonzero(cut)
        self.ends = np.append(self.starts[1:], n)
        self.before = np.searchsorted(self.starts, off)
        hashes = span_hashes(self.codes, self.starts, self.ends, kind=kind)
        self.keys, self.first, self.at = np.unique(hashes, return_index=True, return_inverse=True)
        self.at = self.at.astype(np.int32)
        self.kind = kind

    def clash(self, block: int = 1 << 18) -> bool:
        """Whether different segments share a hash: every segment is compared with the first one of its hash."""
        home = self.starts[self.first]
        if not np.array_equal((self.ends[self.first] - home)[self.at], self.ends - self.starts):
            return True
        i = 0
        while i < len(self.starts):
            j = max(i + 1, int(np.searchsorted(self.ends, self.starts[i] + block, "right")))
            a, b = int(self.starts[i]), int(self.ends[j - 1])
            there = np.arange(a, b) + np.repeat(home[self.at[i:j]] - self.starts[i:j], self.ends[i:j] - self.starts[i:j])
            if not np.array_equal(self.codes[a:b], self.codes[there]):
                return True
            i = j
        return False

    def seconds(self) -> np.ndarray:
        """Another hash of each distinct segment."""
        out, order = np.empty(len(self.first), np.uint64), np.argsort(self.first)
        out[order] = span_hashes(self.codes, self.starts[self.first[order]], self.ends[self.first[order]], kind=self.kind + 1)
        return out

    def strings(self, which: np.ndarray) -> pa.StringArray:
        first = self.first[which]
        size = self.ends[first] - self.starts[first]
        codes = gather(self.codes, self.starts[first], size)
        places = np.concatenate([[0], np.cumsum((codes >= 0x80).view(np.int8) + (codes >= 0x800) + (codes >= 0x10000) + 1)])
        data = codes.tobytes().decode("utf-32-le").encode()
        offsets = places[np.concatenate([[0], np.cumsum(size)])].astype(np.int32)
        return pa.StringArray.from_buffers(len(which), pa.py_buffer(offsets), pa.py_buffer(data))

    def folded(self, most: int) -> np.ndarray:
        """Which distinct segments go to the lattice: neither long nor holding the mark of the fold."""
        a, b = self.starts[self.first], self.ends[self.first]
        marks = np.flatnonzero((self.codes == ord(MARK)) | (self.codes == ord(STOP)))
        return (b - a <= most) & (np.searchsorted(marks, a) == np.searchsorted(marks, b))


_PLACES: dict[int, np.ndarray] = {}


class Group:
    """The chunks of a group, one after the other: the distinct segments of all that go to the lattice (sorted hashes
    and strings), and of each chunk what its ids need; the bulky arrays of a chunk are gone before the next."""

    def __init__(self, bodies, model: Model, folded: int, encode: bool):
        self.chunks, texts = [], []
        self.keys, second, place = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for body in bodies:
            batch = unpack(body.as_buffer())
            for kind in range(0, 1000, 2):  # other hashes, should two different segments share one
                s = Segments(batch, model, kind)
                more = s.seconds()
                at = np.minimum(np.searchsorted(self.keys, s.keys), max(len(self.keys) - 1, 0))
                known = self.keys[at] == s.keys if len(self.keys) else np.zeros(len(s.keys), bool)
                if not s.clash() and np.array_equal(second[at[known]], more[known]):
                    break
            own = s.folded(folded)
            fresh = np.flatnonzero(own & ~known)
            texts.append(s.strings(fresh))
            place = np.concatenate([place, np.arange(len(place), len(place) + len(fresh))])
            self.keys, second = np.concatenate([self.keys, s.keys[fresh]]), np.concatenate([second, more[fresh]])
            order = np.argsort(self.keys, kind="stable")
            self.keys, second, place = self.keys[order], second[order], place[order]
            if encode:
                rest = np.flatnonzero(~own)
                self.chunks.append((batch, s.keys, own, s.at, s.before, {int(r): model.encode(t) for r, t in zip(rest, s.strings(rest).to_pylist())}))
        self.texts = pa.chunked_array(texts, pa.string()).combine_chunks().take(pa.array(place))


def place_table(model: Model) -> np.ndarray:
    """Of every code point, its place among the model's characters (0: none)."""
    key = len(model.chars)
    if key not in _PLACES:
        table = np.zeros(0x110000, np.int16 if key < 30000 else np.int32)
        table[model.chars] = np.arange(1, key + 1)
        _PLACES.clear()
        _PLACES[key] = table
    return _PLACES[key]


def bucketed(df: DataFrame) -> DataFrame:
    """A table in the shared folder, bucketed by group, so that joins by group don't move it."""
    spark = df.sparkSession
    name = f"chunks_{uuid.uuid4().hex}"
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    df.write.bucketBy(parts, "group").option("path", workspace(spark)).option("compression", "none").format("parquet").saveAsTable(name)
    return spark.table(name)


def pair_of(left: str, right: str) -> str:
    return f"{MARK}{left}{STOP}{MARK}{right}{STOP}"


def merge_pairs(model: Model) -> pa.Table:
    """piece and every way to merge it from two neighbours: score, pair, and when its turn is: the rank of the piece,
    or of the part that comes later than the piece itself (late)."""
    rank = {p: -s for p, (_, s) in model.table.items()}
    pieces, ways = [], []
    for piece, (_, score) in model.table.items():
        own = []
        for k in range(1, len(piece)):
            left, right = piece[:k], piece[k:]
            if (k == 1 or left in rank) and (k == len(piece) - 1 or right in rank):
                last = max([rank[x] for x in (left, right) if len(x) > 1], default=-1.0)
                own.append({"turn": max(last, -score), "late": int(last >= -score), "pair": pair_of(left, right), "score": score})
        if own:
            pieces.append(piece)
            ways.append(own)
    kind = pa.list_(pa.struct([("turn", pa.float64()), ("late", pa.int32()), ("pair", pa.string()), ("score", pa.float64())]))
    return pa.table({"piece": pa.array(pieces), "ways": pa.array(ways, kind)})


def merge_fold(edges, text):
    """The pieces of text, each between MARK and STOP: the best edge between two neighbours is merged, the leftmost of
    equals, until there is none. An edge is (turn, late, pair, score).

    One pass over the edges by turn does that, unless an edge whose part comes later than its piece is met, or one
    turn merges twice and what a merge makes possible could come between; only such texts search for the best edge again
    and again."""
    begin = F.concat(F.lit(MARK), F.array_join(F.split(text, ""), STOP + MARK), F.lit(STOP))

    def whole(pair):
        return F.replace(pair, F.lit(STOP + MARK), F.lit(""))

    def turn(a, x):
        merged = F.replace(a["text"], x["pair"], whole(x["pair"]))
        twice = F.length(a["text"]) - F.length(merged) > 2
        odd = (x["late"] == 1) | (a["last"] == x["turn"]) | (twice & F.exists(edges, lambda y: (y["late"] == 1) & (y["turn"] == x["turn"])))
        done = F.struct(merged.alias("text"), x["turn"].alias("last"), odd.alias("odd"))
        return F.when(a["odd"] | ~F.contains(a["text"], x["pair"]), a).otherwise(done)

    once = F.aggregate(F.sort_array(edges), F.struct(begin.alias("text"), F.lit(-1.0).alias("last"), F.lit(False).alias("odd")), turn)

    def step(state, _):
        found = F.filter(edges, lambda x: F.contains(state, x["pair"]))
        best = F.array_max(F.transform(found, lambda x: F.struct(x["score"].alias("score"), (-F.instr(state, x["pair"])).alias("at"), x["pair"].alias("pair"))))
        return F.when(best.isNull(), state).otherwise(F.overlay(state, whole(best["pair"]), -best["at"], F.length(best["pair"])))

    search = F.aggregate(F.sequence(F.lit(2), F.greatest(F.length(text), F.lit(2))), begin, step)
    return once, lambda got: F.when(got["odd"], search).otherwise(got["text"])


def viterbi_fold(edges, text, unknown: float):
    """The pieces of the best path over text, each between MARK and STOP; of equals the one whose last piece begins first
    wins. An edge is (b, e, score)."""
    n = F.length(text)
    start = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("back"), F.lit("").alias("path")))

    def step(paths, e):
        ends = F.filter(edges, lambda x: x["e"] == e + 1)
        to = lambda b, score: F.struct((F.get(paths, b - 1)["score"] + score).alias("score"), (-b).alias("back"), F.concat(F.get(paths, b - 1)["path"], F.lit(MARK), F.substring(text, b, e + 1 - b), F.lit(STOP)).alias("path"))
        known = F.transform(ends, lambda x: to(x["b"], x["score"]))
        alone = F.exists(ends, lambda x: x["b"] == e)
        return F.concat(paths, F.array(F.array_max(F.when(alone, known).otherwise(F.concat(known, F.array(to(e, F.lit(unknown))))))))

    return F.element_at(F.aggregate(F.sequence(F.lit(1), n), start, step), -1)["path"]


def cut_bits(pieces):
    """A bit for each character, the first one highest: whether a piece begins there."""
    heads = F.regexp_replace(pieces, f"{MARK}[^{STOP}]{STOP}?", "\x03")
    bits = F.translate(F.regexp_replace(heads, f"[^\x03{STOP}]", "0"), f"\x03{STOP}", "1")
    return F.conv(bits, 2, -10).cast("long")


def segment_cuts(segments: DataFrame, model: Model) -> DataFrame:
    """segments (seg, owners) to owners and cuts: where pieces begin."""
    spark = segments.sparkSession
    if model.kind == BPE:
        table = merge_pairs(model)
    else:
        table = pa.table({"piece": list(model.table), "score": pa.array([v[1] for v in model.table.values()], pa.float64())})
    pieces = F.broadcast(spark.createDataFrame(table))
    least = 2 if model.kind == BPE else 1
    n = F.length("seg")
    # b = 0 is a row for the owners alone, so that they go through the explosion once
    starts = segments.select("seg", "owners", F.explode(F.sequence(F.lit(0), F.greatest(n + 1 - least, F.lit(0)))).alias("b"))
    ends = starts.select("seg", F.when(F.col("b") == 0, F.col("owners")).alias("owners"), "b", F.explode(F.when(F.col("b") == 0, F.array(F.lit(0))).otherwise(F.sequence(F.col("b") + least, F.least(F.col("b") + model.longest, n + 1)))).alias("e"))
    subs = ends.withColumn("piece", F.when(F.col("b") > 0, F.expr("substring(seg, b, e - b)")))
    edges = subs.join(pieces, "piece", "left").where(F.col("b").eqNullSafe(0) | F.col("ways" if model.kind == BPE else "score").isNotNull())
    edge = F.col("ways") if model.kind == BPE else F.struct("b", "e", "score")
    words = edges.groupBy("seg").agg(F.first("owners", ignorenulls=True).alias("owners"), F.collect_list(F.when(F.col("b") > 0, edge)).alias("edges"))
    if model.kind == UNIGRAM:
        return words.select("owners", cut_bits(viterbi_fold(F.col("edges"), F.col("seg"), model.unknown_score)).alias("cuts"))
    once, rest = merge_fold(F.col("edges"), F.col("seg"))
    return words.withColumn("edges", F.flatten("edges")).withColumn("once", once).select("owners", cut_bits(rest(F.col("once"))).alias("cuts"))


def gather(values: np.ndarray, begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """values[begins[i]:begins[i]+counts[i]], on end."""
    ends = np.cumsum(counts)
    return values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins - ends + counts, counts)]


def decode_flat(ids: np.ndarray, begins: np.ndarray, model_output, prefix: bool) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of rows of ids, and where each begins; the space put before a text is taken off."""
    data, at = model_output
    size = np.diff(at)[ids]
    out = gather(data, at[:-1][ids], size)
    ends = np.concatenate([[0], np.cumsum(size)])[begins - begins[0]]
    if prefix:
        first = ends[:-1][(ends[1:] > ends[:-1])]
        first = first[out[first] == 32]
        keep = np.ones(len(out), bool)
        keep[first] = False
        moved = np.concatenate([[0], np.cumsum(~keep)])
        out, ends = out[keep], ends - moved[ends]
    return out, ends


def same_text(ids: np.ndarray, begins: np.ndarray, batch: pa.RecordBatch, model: Model, block: int = 1 << 18) -> list[bool]:
    """Of each row, whether its ids decode to its text."""
    raw, off = text_bytes(batch.column("text"))
    output, same, a = model.output, [], 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(begins, begins[a] + block, "right")) - 1)
        out, to = decode_flat(ids[begins[a] : begins[b]], begins[a : b + 1], output, model.prefix)
        same += [np.array_equal(out[to[i - a] : to[i - a + 1]], raw[off[i] : off[i + 1]]) for i in range(a, b)]
        a = b
    return same


def encode(docs: DataFrame, path: str = MODEL, folded: int = FOLDED, most: int = 2 << 20, together: int = 16, drop: tuple[str, ...] = ()) -> DataFrame:
    """docs without the columns to drop and, of each: ids, n_pieces, and whether the ids decode to the text again (round_trip)."""
    docs = docs.drop("ids", "n_pieces", "round_trip")
    model, folded = read_model(path), min(folded, FOLDED)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def grouped(batches):
        """Chunks in groups of neighbours: `together` of them, fewer where single texts are large."""
        group, n, held = (TaskContext.get().partitionId() << 16) - 1, together, 0
        for b in chunk_rows(most, 5)(batches):
            if n == together or held >= together * most:
                group, n, held = group + 1, 0, 0
            n, held = n + 1, held + b.column("size")[0].as_py()
            yield pa.RecordBatch.from_arrays([pa.array([group], pa.int64()), b.column("body")], names=["group", "body"])

    chunks = bucketed(docs.mapInArrow(grouped, "group long, body binary"))

    def words(table: pa.Table) -> pa.Table:
        g = Group(table.column("body"), sent.value, folded, False)
        order = pa.compute.array_sort_indices(g.texts)  # neighbours share beginnings, which packs well
        out = pa.table({"seg": g.texts.take(order), "owner": pa.array((table.column("group")[0].as_py() << PLACE_BITS) + order.to_numpy().astype(np.int64))})
        del g
        release()
        return out

    # a group's segments make some 200 MB of edges at most, and a task holds a sixth of that
    groups = chunks.select("group").distinct().count()
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 6 * groups)
    sent_words = chunks.groupBy("group").applyInArrow(words, "seg string, owner long").repartition(parts, "seg")
    segments = sent_words.groupBy("seg").agg(F.collect_list("owner").alias("owners"))
    back = segment_cuts(segments, model).select(F.explode("owners").alias("owner"), "cuts")
    back = back.select(F.shiftright("owner", PLACE_BITS).alias("group"), F.col("owner").bitwiseAND((1 << PLACE_BITS) - 1).cast("int").alias("at"), "cuts")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name not in drop) + ", ids array<int>, n_pieces int, round_trip boolean"

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        m = sent.value
        g = Group(left.column("body"), m, folded, True)
        cuts = np.zeros(len(g.keys), np.int64)
        cuts[right.column("at").to_numpy()] = right.column("cuts").to_numpy()
        flat, sizes = array("i"), np.zeros(len(g.keys), np.int64)
        for a in range(0, len(cuts), 1 << 14):
            for i, (text, c) in enumerate(zip(g.texts.slice(a, 1 << 14).to_pylist(), cuts[a : a + (1 << 14)].view(np.uint64).tolist()), a):
                ids = m.cut(text, c)
                flat.extend(ids)
                sizes[i] = len(ids)
        pool = np.frombuffer(flat, np.int32) if len(flat) else np.zeros(0, np.int32)
        place = np.cumsum(sizes) - sizes
        out = []
        while g.chunks:
            out.append(chunk_ids(m, *g.chunks.pop(0), g.keys, pool, place, sizes).drop_columns(list(drop)))
        del g, pool, flat
        release()
        return pa.concat_tables(out)

    return chunks.groupBy("group").cogroup(back.groupBy("group")).applyInArrow(join, schema)


def chunk_ids(m: Model, batch, keys, own, at, before, rest: dict, known, pool, place, sizes) -> pa.Table:
    """A chunk's rows with their ids: segments of the group by their place in pool, others by themselves."""
    more = [rest[i] for i in sorted(rest)]
    flat = np.concatenate([pool, np.array([i for p in more for i in p], np.int32)])
    begins, counts = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
    where = np.searchsorted(known, keys[own])
    begins[own], counts[own] = place[where], sizes[where]
    counts[~own] = [len(p) for p in more]
    begins[~own] = len(pool) + np.cumsum(counts[~own]) - counts[~own]
    ends = np.zeros(len(at) + 1, np.int64)
    if len(at):
        np.cumsum(counts[at], out=ends[1:])
    ids = np.empty(ends[-1], np.int32)
    for i in range(0, len(at), 1 << 18):
        some = at[i : i + (1 << 18)]
        ids[ends[i] : ends[min(i + (1 << 18), len(at))]] = gather(flat, begins[some], counts[some])
    ends = ends[before]
    lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
    table = pa.Table.from_batches([batch]).append_column("ids", lists).append_column("n_pieces", pa.array(np.diff(ends).astype(np.int32)))
    return table.append_column("round_trip", pa.array(same_text(ids, ends, batch, m), pa.bool_()))


def decode(encoded: DataFrame, path: str = MODEL, ids: str = "ids") -> DataFrame:
    """encoded and, of each row, decoded: the text that its ids stand for (bytes that are no UTF-8 are replaced)."""
    sent = encoded.sparkSession.sparkContext.broadcast(read_model(path))
    encoded = encoded.drop("decoded")
    names = encoded.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema) + ", decoded string"

    def run(batches):
        output, prefix = sent.value.output, sent.value.prefix
        for b in batches:
            lists = b.column(ids).to_pylist()
            flat = np.array([i for x in lists for i in x or ()], np.int64)
            begins = np.concatenate([[0], np.cumsum([len(x or ()) for x in lists])]).astype(np.int64)
            out, to = decode_flat(flat, begins, output, prefix)
            texts = [None if x is None else out[to[i] : to[i + 1]].tobytes().decode(errors="replace") for i, x in enumerate(lists)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*names, "decoded"])

    return encoded.mapInArrow(run, schema)


def report(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """Every whole text: its ids and the round trip."""
    return encode(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), path, drop=("text",)).select("doc_id", "n_pieces", "ids", "round_trip")
