"""Language identification by rank-order profiles.

A profile is the `PROFILE` most frequent n-grams (one to three letters; the space that ends a word counts as one) of a
text or of a language, in the order of their frequency. A document goes to the language whose profile has the least
out-of-place distance: summed over the document's n-grams, how far each stands from its place in the language's profile,
or `PROFILE` if it is not there. score is 1 - distance / (the distance of a document that shares nothing).

Counts of languages cover all texts to learn from: each task adds up what it reads, Spark sums and ranks. Only the
profiles go to all tasks: `PROFILE` rows a language, and more than `LANGUAGES` languages are an error. Every document is
then read once more and judged where it lies.

Defined cases: a null text or one without a letter is `und`, score 0, and so is every text where nothing was learned;
n-grams of equal frequency stand in the order of length, then of code points; of languages at equal distance the first
by name; a null lang teaches nothing; a null doc_id is the empty text to the fold; repeated rows each count; texts of
any length are counted in blocks, whole; columns named like the results are replaced; an empty table gives no rows.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import release

PROFILE, LANGUAGES = 400, 10_000
#: Characters of a text that are counted at a time, and n-grams that a task gathers before it passes them on.
BLOCK, GATHER = 1 << 20, 1 << 20
SPACE = 32


@cache
def letter() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their counts."""
    if len(keys) == 1:
        return keys[0], counts[0]
    flat, where = np.unique(np.concatenate(keys), return_inverse=True)
    return flat, np.bincount(where, np.concatenate(counts), len(flat)).astype(np.int64)


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """n-grams of a text (21 bits a character, the first highest), sorted, and how often each occurs."""
    keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    before = np.array([SPACE], np.int64)
    for at in range(0, len(text or "") + 1, BLOCK):
        points = np.frombuffer(text[at : at + BLOCK].lower().encode("utf-32-le"), np.uint32) if text else np.zeros(0, np.uint32)
        own = np.where(letter()[points], points, SPACE).astype(np.int64)
        if at + BLOCK > len(text or ""):
            own = np.append(own, SPACE)  # the last word ends
        row = np.concatenate([before, own])
        row = row[np.concatenate([[True], (row[1:] != SPACE) | (row[:-1] != SPACE)])]
        new = len(before)
        one, two = row[new:], row[new - 1 : -1] << 21 | row[new:]
        first = max(new, 2)
        three = row[first - 2 : -2] << 42 | row[first - 1 : -1] << 21 | row[first:]
        found = np.concatenate([one[one != SPACE], two, three[row[first - 1 : -1] != SPACE]])
        k, n = np.unique(found, return_counts=True)
        keys.append(k)
        counts.append(n)
        before = row[-2:]
    return merged(keys[1:], counts[1:])


def ranked(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The profile: keys by falling count, then as they are."""
    return keys[np.lexsort((keys, -counts))[:PROFILE]]


def counted(batches):
    """lang, gram, n: what a task's texts hold, added up before it goes on."""
    held: dict[str, list] = {}
    size = 0

    def out():
        for lang, parts in held.items():
            keys, counts = merged([k for k, _ in parts], [n for _, n in parts])
            for at in range(0, len(keys), 1 << 16):
                part = slice(at, at + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys[part]), pa.string()), pa.array(keys[part]), pa.array(counts[part])], names=["lang", "gram", "n"])

    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text")):
            parts = held.setdefault(lang, [])
            parts.append(grams(text.as_py()))
            size += len(parts[-1][0])
            if size > GATHER:
                for name, some in held.items():
                    held[name] = [merged([k for k, _ in some], [n for _, n in some])]
                size = sum(len(some[0][0]) for some in held.values())
                if size > GATHER // 2:
                    yield from out()
                    held, size = {}, 0
    yield from out()
    release()


def profiles(docs: DataFrame) -> DataFrame:
    """lang, gram, place (from 0): the profiles of the languages of docs (text, lang), over all of them."""
    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang is not null and text is not null")
    total = rows.mapInArrow(counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return total.withColumn("place", place - 1).where(F.col("place") < PROFILE).select("lang", "gram", "place")


class Profiles:
    """Profiles of all languages: of each n-gram, in which languages it stands, and where."""

    def __init__(self, rows: pa.Table):
        self.names = sorted(set(rows.column("lang").to_pylist()))
        if len(self.names) > LANGUAGES:
            raise ValueError(f"more than {LANGUAGES} languages")
        at = {n: i for i, n in enumerate(self.names)}
        gram = rows.column("gram").to_numpy()
        order = np.argsort(gram, kind="stable")
        self.keys, self.begins = np.unique(gram[order], return_index=True)
        self.begins = np.append(self.begins, len(gram))
        self.lang = np.array([at[x] for x in rows.column("lang").to_pylist()], np.int64)[order]
        self.place = rows.column("place").to_numpy().astype(np.int64)[order]

    def judge(self, text: str | None) -> tuple[str, float, str | None]:
        """Language, score, and the runner-up."""
        own = ranked(*grams(text))
        if not len(own) or not self.names:
            return "und", 0.0, None
        at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[at] == own)
        begin, n = self.begins[at[hit]], self.begins[at[hit] + 1] - self.begins[at[hit]]
        entry = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())
        gain = PROFILE - np.abs(np.repeat(hit, n) - self.place[entry])
        near = np.bincount(self.lang[entry], gain, len(self.names)).astype(np.int64)
        best = np.lexsort((np.arange(len(near)), -near))
        distance = len(own) * PROFILE - int(near[best[0]])
        return self.names[best[0]], 1 - distance / (len(own) * PROFILE), self.names[best[1]] if len(near) > 1 else None


def learn(docs: DataFrame) -> Profiles:
    return Profiles(profiles(docs).limit(PROFILE * LANGUAGES + 1).toArrow())


def identify(docs: DataFrame, known: DataFrame) -> DataFrame:
    """docs and, of each: lang_pred, score and the second nearest language (runner_up), by the profiles of known."""
    docs = docs.drop("lang_pred", "score", "runner_up")
    sent = docs.sparkSession.sparkContext.broadcast(learn(known))
    names = docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", lang_pred string, score double, runner_up string"

    def run(batches):
        for b in batches:
            judged = [sent.value.judge(t.as_py()) for t in b.column("text")]
            more = [pa.array([x[i] for x in judged], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *more], names=[*names, "lang_pred", "score", "runner_up"])
        release()

    return docs.mapInArrow(run, schema)


def held_out() -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def report(docs: DataFrame) -> DataFrame:
    """The digest of the contract."""
    out = identify(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), docs.where(~held_out()))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda s, z: CASE WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END)), 4294967295)"

ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, ' ' || trim(regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}]+', ' ', 'g')) || ' ' AS s, {CRC.format("doc_id")} % 4 = 2 AS held_out FROM documents),
l AS (SELECT r, string_split(s, '') AS l FROM d WHERE length(s) > 2),
u AS (SELECT r, unnest(list_concat(l, list_transform(range(1, len(l)), lambda i: l[i] || l[i + 1]), list_transform(range(1, len(l) - 1), lambda i: CASE WHEN l[i + 1] <> ' ' THEN l[i] || l[i + 1] || l[i + 2] ELSE ' ' END))) AS gram FROM l),
g AS (SELECT r, gram, count(*) AS c FROM u WHERE gram <> ' ' GROUP BY ALL),
own AS (SELECT r, gram, row_number() OVER (PARTITION BY r ORDER BY c DESC, length(gram), gram) - 1 AS place FROM g QUALIFY place < {PROFILE}),
total AS (SELECT lang, gram, sum(c) AS c FROM g JOIN d USING (r) WHERE NOT held_out AND lang IS NOT NULL GROUP BY ALL),
known AS (SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY c DESC, length(gram), gram) - 1 AS place FROM total QUALIFY place < {PROFILE}),
dist AS (SELECT r, l.lang, sum(CASE WHEN known.place IS NULL THEN {PROFILE} ELSE abs(own.place - known.place) END)::BIGINT AS apart, count(*) AS m
         FROM own CROSS JOIN (SELECT DISTINCT lang FROM known) l LEFT JOIN known ON known.lang = l.lang AND known.gram = own.gram GROUP BY ALL),
best AS (SELECT * FROM dist QUALIFY row_number() OVER (PARTITION BY r ORDER BY apart, lang) = 1)
SELECT doc_id, held_out, coalesce(best.lang, 'und') AS lang_pred, coalesce(1 - apart::DOUBLE / (m * {PROFILE})::DOUBLE, 0.0) AS score FROM d LEFT JOIN best USING (r)
"""
