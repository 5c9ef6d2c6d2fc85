"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of about 400 bytes. A passage is encoded (hashed byte pairs, byte classes, repetition;
then a learned hidden layer), a gated attention learned from the documents' labels weighs the passages, and the
weighted representation is scored. Only the text goes in. The model is trained on the driver from a bounded sample of
labelled documents (`sample` and `sample_bytes`, those of the least hashed ids), whole texts each; it is then a few tens of kilobytes,
sent to all tasks, and every document is scored where it is read: no shuffle.

Defined cases: null and empty texts are one passage without content; several labels of an id count as their mean
(0.5 and more is 1), null labels and ids don't count; without two classes among the labels every score is the share of
label 1 (0.5 without any); an empty table gives no rows; columns named like the results are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, WHITE, release, slices, span_hashes, stored, text_bytes, word_bounds

PASSAGE, PAIRS, HIDDEN, GATE = 400, 320, 24, 12
#: Bytes of text that are encoded at a time, some 60 of memory each; a longer text is one piece.
SLICE = 1 << 20
#: upper case, lower case, digits, white space, line ends, other ASCII, bytes beyond ASCII
CLASSES = 7
_CLASS = np.full(256, 6, np.int64)
_CLASS[:128] = 5
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58] = 0, 1, 2
_CLASS[9:14] = _CLASS[32] = 3
_CLASS[10] = 4
_PAIR = (np.arange(65536, dtype=np.uint64) * U64(0x9E3779B97F4A7C15) >> U64(40)).astype(np.int64) % PAIRS
FEATURES = PAIRS + CLASSES + 4


def passages(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(features of each passage, where each text's passages begin); a text has one passage at least."""
    raw, off = text_bytes(texts)
    size = np.diff(off)
    parts = np.maximum(1, np.rint(size / PASSAGE).astype(np.int64))
    begins = np.concatenate([[0], np.cumsum(parts)])
    n = int(begins[-1])
    row = np.repeat(np.arange(len(size)), size)
    place = begins[row] + (np.arange(len(raw)) - off[row]) * parts[row] // np.maximum(size[row], 1)
    out = np.zeros((n, FEATURES), np.float32)
    if len(raw):
        total = np.maximum(np.bincount(place, minlength=n), 1).astype(np.float32)
        inner = np.flatnonzero(place[1:] == place[:-1])
        pair = _PAIR[(raw[inner].astype(np.int64) << 8) | raw[inner + 1]]
        out[:, :PAIRS] = np.sqrt(np.bincount(place[inner] * PAIRS + pair, minlength=n * PAIRS).reshape(n, PAIRS) / total[:, None])
        out[:, PAIRS : PAIRS + CLASSES] = np.bincount(place * CLASSES + _CLASS[raw], minlength=n * CLASSES).reshape(n, CLASSES) / total[:, None]
        starts, ends, _ = word_bounds(raw, off, WHITE)
        if len(starts):
            words = span_hashes(raw, starts, ends)
            at = place[starts]
            count = np.bincount(at, minlength=n)
            same = np.zeros(len(words), bool)
            same[1:] = (words[1:] == words[:-1]) & (at[1:] == at[:-1])
            distinct = np.unique(np.stack([at.astype(np.uint64), words]), axis=1)[0].astype(np.int64) if len(words) < 2 else at[np.lexsort((words, at))][first_of(at, words)]
            floor = np.maximum(count, 1)
            out[:, -4] = np.bincount(at, same, n) / floor
            out[:, -3] = np.bincount(distinct, minlength=n) / floor
            out[:, -2] = np.bincount(at, ends - starts, n) / floor / 10
        out[:, -1] = np.log1p(np.bincount(place, minlength=n)) / 6
    return out, begins


def first_of(at: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Which are the first of their kind, in the order of (at, words)."""
    order = np.lexsort((words, at))
    a, w = at[order], words[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (w[1:] != w[:-1])
    return new


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Model:
    """tanh layer, gated attention over a bag, logistic score of the weighted sum."""

    def __init__(self, mean, scale, share):
        rng = np.random.default_rng(7)
        self.mean, self.scale, self.share = mean, scale, share
        shapes = {"W": (FEATURES, HIDDEN), "b": (HIDDEN,), "V": (HIDDEN, GATE), "U": (HIDDEN, GATE), "w": (GATE,), "c": (HIDDEN,), "d": (1,)}
        self.p = {k: (rng.standard_normal(s) / np.sqrt(s[0]) if k not in "bd" else np.zeros(s)).astype(np.float32) for k, s in shapes.items()}

    def forward(self, x, begins):
        p = self.p
        h = np.tanh(((x - self.mean) / self.scale) @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
        e = (t * s) @ p["w"]
        seg = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
        a = np.exp(e - np.maximum.reduceat(e, begins[:-1])[seg])
        a /= np.add.reduceat(a, begins[:-1])[seg]
        z = np.add.reduceat(a[:, None] * h, begins[:-1])
        return h, t, s, a, seg, z, sigmoid(z @ p["c"] + p["d"])

    def step(self, x, begins, y, weight):
        p = self.p
        h, t, s, a, seg, z, score = self.forward(x, begins)
        ds = ((score - y) * weight / len(y)).astype(np.float32)
        dz = ds[:, None] * p["c"]
        da = (dz[seg] * h).sum(1)
        de = a * (da - np.add.reduceat(a * da, begins[:-1])[seg])
        dts = de[:, None] * p["w"]
        dt, dg = dts * s * (1 - t * t), dts * t * s * (1 - s)
        dh = (a[:, None] * dz[seg] + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
        g = {"c": z.T @ ds, "d": ds.sum(keepdims=True), "w": (t * s).T @ de, "V": h.T @ dt, "U": h.T @ dg, "b": dh.sum(0), "W": ((x - self.mean) / self.scale).T @ dh}
        return {k: v + 1e-4 * p[k] * (k == "W") for k, v in g.items()}

    def scores(self, x, begins):
        if self.share is not None:
            return np.full(len(begins) - 1, self.share), np.zeros(len(x), np.float32)
        out = self.forward(x, begins)
        return out[6].astype(np.float64), out[3]


def fit(bags: list[np.ndarray], y: np.ndarray, epochs: int = 25, batch: int = 128) -> Model:
    if len(set(y)) < 2:
        return Model(0, 1, float(np.mean(y)) if len(y) else 0.5)
    flat = np.concatenate(bags)
    model = Model(flat.mean(0), flat.std(0) + 1e-3, None)
    rng = np.random.default_rng(11)
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    v = {k: np.zeros_like(x) for k, x in model.p.items()}
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())) ** 0.5
    t = 0
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            x = np.concatenate([bags[i] for i in own])
            begins = np.concatenate([[0], np.cumsum([len(bags[i]) for i in own])])
            t += 1
            rate = 3e-3 * (1 - 0.9 * epoch / epochs)
            for k, g in model.step(x, begins, y[own], weight[own]).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                model.p[k] = (model.p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return model


def held_out(doc_id):
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def train(docs: DataFrame, labels: DataFrame, sample: int = 4000, sample_bytes: int = 64 << 20) -> Model:
    """The model from at most `sample` labelled documents whose ids are not held out, and from as many of them, in the
    order of a hash, as have passages of `sample_bytes` together (2 * FEATURES bytes each); whole documents only."""
    known = labels.where("doc_id is not null and quality is not null").where(~held_out("doc_id"))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    picked = texts.join(F.broadcast(known), "doc_id").select("doc_id", "text", "y")  # at most `sample` rows are sent

    def encode(batches):
        for whole in batches:
            for b in slices(whole, "text", SLICE):
                x, begins = passages(b.column("text"))
                blobs = [x[begins[i] : begins[i + 1]].astype(np.float16).tobytes() for i in range(b.num_rows)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(blobs, pa.binary())], names=["doc_id", "y", "bag"])

    rows = stored(picked.mapInArrow(encode, "doc_id long, y int, bag binary"))
    # `sample` numbers in one task at most
    so_far = F.sum(F.octet_length("bag")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
    within = rows.select("doc_id", so_far.alias("so_far")).where(F.col("so_far") <= sample_bytes).select("doc_id").distinct()
    rows = rows.join(F.broadcast(within), "doc_id", "left_semi").toArrow().sort_by("doc_id")
    bags = [np.frombuffer(b.as_buffer(), np.float16).reshape(-1, FEATURES).astype(np.float32) for b in rows.column("bag")]
    return fit(bags, rows.column("y").to_numpy().astype(np.float32))


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = 4000) -> DataFrame:
    """docs and, of each: score, n_passages, and the passage of most weight (top_passage, from 0)."""
    docs = docs.drop("score", "n_passages", "top_passage")
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))
    names = docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", score double, n_passages int, top_passage int"

    def run(batches):
        model = sent.value
        for whole in batches:
            for b in slices(whole, "text", SLICE):
                x, begins = passages(b.column("text"))
                score, weight = model.scores(x, begins)
                top = [int(np.argmax(weight[begins[i] : begins[i + 1]])) for i in range(b.num_rows)]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(score), pa.array(np.diff(begins).astype(np.int32)), pa.array(top, pa.int32())], names=[*names, "score", "n_passages", "top_passage"])
        release()

    return docs.mapInArrow(run, schema)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The digest of the contract."""
    out = quality_scores(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), labels)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
