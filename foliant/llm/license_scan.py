"""License scans: sparse TF-IDF cosine of header lines and licence files to templates, then inheritance by directory.

Every line of every whole text is a candidate header; a licence file is also compared as a whole. Vectors run over
lower-case words; weights are tf * (ln((1 + templates) / (1 + templates with the word)) + 1), so words that no
template has count in the length. A candidate must hold one of the template's heaviest words, chosen such that
without any of them the cosine cannot reach the threshold: the filter loses nothing, and only its lines are exploded.

A file without a header of its own takes the licence of the nearest directory above it (or its own directory) that
holds a licence file: its ancestor paths are exploded and equi-joined to the licensed directories. All of it is
DataFrame code; the template weights are the only thing broadcast, and their size is fixed by the templates.

One-line notices (TEMPLATES) are weighed and compared as the SQL does. SPDX forms, licence bodies and long headers
(license_texts) have weights of their own and are compared with every block of neighbouring lines, so a wrapped header
or a paragraph of a licence file is found whatever surrounds it. The better of both counts.

Defined cases: null and empty texts have no header; a null path has no directory and inherits nothing; among equal
scores the first licence by name wins, among licence files of one directory the better, then the first licence by
name; repeated rows are each judged; an empty table gives no rows; columns named like the results are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, stored
from .license_texts import TEXTS

# Licence identifiers and the wording of their customary notices.
TEMPLATES = [
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0-only"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work. CC0 1.0 Universal."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0-only"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
#: Words too common to look for, if others will do.
COMMON = {"a", "and", "by", "into", "is", "mit", "of", "the", "this", "to", "work"}
WORD = r"[a-z0-9][a-z0-9.]*[a-z0-9]|[a-z0-9]"
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|unlicense)[^/]*$"


class Weights:
    """Template vectors, inverse frequencies, and the words one of which a match must hold."""

    def __init__(self, templates, threshold: float):
        texts = [Counter(re.findall(WORD, text.lower())) for _, text in templates]
        df = Counter(w for t in texts for w in t)
        self.idf = {w: math.log((1 + len(texts)) / (1 + n)) + 1 for w, n in df.items()}
        self.unknown = math.log(1 + len(texts)) + 1
        self.rows, triggers = [], set()
        for at, ((name, _), t) in enumerate(zip(templates, texts)):
            vector = {w: n * self.idf[w] for w, n in t.items()}
            norm = math.sqrt(sum(v * v for v in vector.values()))
            self.rows += [(at, name, w, v / norm) for w, v in vector.items()]
            held = 0.0
            for w, v in sorted(vector.items(), key=lambda x: (x[0] in COMMON, x[0].isalpha() and len(x[0]) < 5, -x[1], x[0])):
                triggers.add(w)
                held += v * v / norm / norm
                if 1 - held < threshold * threshold:  # the rest alone stays below the threshold
                    break
        self.triggers = sorted(triggers)


class Blocks:
    """Templates compared with blocks of neighbouring lines."""

    def __init__(self, templates, threshold: float):
        w = Weights(templates, threshold)
        self.idf, self.unknown, self.threshold = w.idf, w.unknown, threshold
        self.names, self.word = [n for n, _ in templates], re.compile(WORD)
        self.triggers = frozenset(w.triggers)
        self.vectors = {word: np.zeros(len(templates)) for word in w.idf}
        for at, _, word, v in w.rows:
            self.vectors[word][at] = v
        # beyond twice the longest template a block holds more of other things, or a template twice
        self.most = 2 * max(len(re.findall(WORD, t.lower())) for _, t in templates)

    def best(self, low: str) -> tuple[str, float] | None:
        """The best (license, score) at the threshold or above of any block of lines."""
        # no cosine exceeds the length of the part of a template whose words are there at all
        mass = sum((self.vectors[w] ** 2 for w in self.vectors.keys() & set(self.word.findall(low))), np.zeros(len(self.names)))
        if mass.max(initial=0) < (self.threshold - 1e-6) ** 2:
            return None
        lines = [self.word.findall(x) for x in low.split("\n")]
        lines = [x for x in lines if x]
        counts = [Counter(x) for x in lines]
        held = [any(w in self.idf for w in c) for c in counts]
        strong = [not self.triggers.isdisjoint(c) for c in counts]
        dots = [sum((n * self.idf[w] * self.vectors[w] for w, n in c.items() if w in self.idf), np.zeros(len(self.names))) if h else None for c, h in zip(counts, held)]
        top: tuple[float, str] | None = None
        until = [len(lines)] * (len(lines) + 1)  # the next line with a trigger
        for i in range(len(lines) - 1, -1, -1):
            until[i] = i if strong[i] else until[i + 1]
        for i in range(len(lines)):
            if not held[i] or until[i] == len(lines):  # a block that starts with a foreign line is better without it
                continue
            seen: Counter = Counter()
            square, n, dot = 0.0, 0, np.zeros(len(self.names))
            for j in range(i, len(lines)):
                n += len(lines[j])
                if j > i and n > self.most:
                    break
                for w, c in counts[j].items():
                    square += ((seen[w] + c) ** 2 - seen[w] ** 2) * self.idf.get(w, self.unknown) ** 2
                    seen[w] += c
                if not held[j]:
                    continue
                dot = dot + dots[j]
                if until[i] > j:
                    if n + len(lines[until[i]]) > self.most and until[i] > i + self.most:
                        break
                    continue
                score = round(float(dot.max()) / math.sqrt(square), 9)
                if score >= self.threshold and (top is None or score >= top[0]):
                    for at in np.flatnonzero(np.round(dot / math.sqrt(square), 9) == score):
                        if top is None or (-score, self.names[at]) < (-top[0], top[1]):
                            top = (score, self.names[at])
        return (top[1], top[0]) if top else None


def block_matches(files: DataFrame, threshold: float, templates=TEXTS) -> DataFrame:
    """files: _row, _low. _row, license, score of the best template of each row with any at the threshold or above."""

    def run(batches):
        blocks = Blocks(templates, threshold)
        for whole in batches:
            for batch in slices(whole, "_low"):
                found = [(r, *b) for r, x in zip(batch.column("_row").to_pylist(), batch.column("_low").to_pylist()) if (b := blocks.best(x))]
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.string()), pa.array([f[2] for f in found], pa.float64())], names=["_row", "license", "score"])

    return files.select("_row", "_low").mapInArrow(run, "_row string, license string, score double")


def words_of(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit(f"({WORD})"), F.lit(1))


def header_matches(docs: DataFrame, weights: Weights, threshold: float) -> DataFrame:
    """_row, license, score of the best template of each row with any at the threshold or above."""
    units = docs.select("_row", F.explode("_lines").alias("line"))
    units = units.select("_row", F.xxhash64("line").alias("unit"), F.explode(words_of(F.col("line"))).alias("word"))
    tf = units.groupBy("_row", "unit", "word").agg(F.count("*").alias("tf"))
    spark = docs.sparkSession
    idf = F.broadcast(spark.createDataFrame(sorted(weights.idf.items()), "word string, idf double"))
    terms = F.broadcast(spark.createDataFrame(weights.rows, "template int, license string, word string, weight double"))
    tf = tf.join(idf, "word", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(weights.unknown)))
    norm = tf.groupBy("_row", "unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = tf.join(terms, "word").groupBy("_row", "unit", "template", "license").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    scored = dots.join(norm, ["_row", "unit"]).withColumn("score", F.round(F.col("dot") / F.col("norm"), 9)).where(F.col("score") >= threshold)
    best = scored.groupBy("_row").agg(F.max("score").alias("score"))
    return scored.join(best, ["_row", "score"]).groupBy("_row", "score").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, path: str = "path", threshold: float = 0.75, templates=TEMPLATES) -> DataFrame:
    """docs and, of each: license (null: none), how (header, inherited or none), score, and licensed_by, the directory
    that an inherited licence comes from."""
    docs = docs.drop("license", "how", "score", "licensed_by", "_row")
    weights = Weights(templates, threshold)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    at = F.coalesce(F.col(path).cast("string"), F.lit(""))
    # 128 bits: by one hash of 64, two of ten billion files would share a licence
    row = F.concat(F.hex(F.xxhash64(at, text)), F.lit("-"), F.hex(F.xxhash64(F.lit(1), text, at)))
    keyed = docs.withColumns({"_row": row, "_path": F.col(path).cast("string")})
    is_file = F.coalesce(F.col("_path").rlike(LICENCE_FILE), F.lit(False))
    heads = "".join(sorted({re.escape(w[0]) for w in weights.triggers}))
    trigger = rf"(?=[{heads}])(?<![a-z0-9.])(?:" + "|".join(map(re.escape, weights.triggers)) + r")(?![a-z0-9])"
    keyed_low = keyed.withColumn("_low", F.lower(text))
    lines = F.filter(F.split("_low", "\n"), lambda x: x.rlike(trigger))
    lines = F.array_distinct(F.when(is_file, F.concat(lines, F.array("_low"))).otherwise(lines))
    # what later steps need of the texts is a few lines of a few of them
    files = stored(keyed_low.select("_row", F.col("_path").alias("path"), is_file.alias("_file"), lines.alias("_lines")))
    own = stored(header_matches(files.where("size(_lines) > 0").dropDuplicates(["_row", "path"]), weights, threshold).unionByName(block_matches(keyed_low, threshold)))
    best = own.groupBy("_row").agg(F.max("score").alias("score"))
    own = stored(own.join(best, ["_row", "score"]).groupBy("_row", "score").agg(F.min("license").alias("license")))
    # rows equal in path and text are equal in all that follows
    licensed = files.where("_file").select("_row", "path").join(own, "_row").select(F.regexp_replace("path", "/?[^/]*$", "").alias("dir"), "license", "score")
    top = licensed.groupBy("dir").agg(F.max(F.struct("score", F.lit(0))).alias("top")).select("dir", F.col("top.score").alias("score"))
    licensed = licensed.join(top, ["dir", "score"]).groupBy("dir", "score").agg(F.min("license").alias("license"))
    bare = files.join(own, "_row", "left_anti").where("path is not null").select("_row", "path").distinct()
    # directories look for theirs, not files: what meets at the root is every directory once
    bare = bare.withColumn("dir", F.regexp_replace("path", "/?[^/]*$", ""))
    home = bare.select(F.col("dir").alias("home")).distinct()
    steps = F.split("home", "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, 1, i), "/"))
    above = home.select("home", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), ups))).alias("dir"))
    nearest = F.max_by(F.struct(F.col("dir").alias("licensed_by"), "license", "score"), F.length("dir"))
    inherited = bare.join(above.join(licensed, "dir").groupBy(F.col("home").alias("dir")).agg(nearest.alias("i")), "dir").select("_row", "i.licensed_by", "i.license", "i.score")
    found = own.select("_row", F.lit(None).cast("string").alias("licensed_by"), "license", "score", F.lit("header").alias("how"))
    found = found.unionByName(inherited.withColumn("how", F.lit("inherited")))
    out = keyed.join(found, "_row", "left")
    return out.drop("_path").select(*docs.columns, "license", F.coalesce("how", F.lit("none")).alias("how"), "score", "licensed_by")


PATH = "concat(coalesce(source, 'unknown'), '/', coalesce(lang, 'und'), '/', cast(floor(doc_id / 256) as {big}), '/', case when doc_id % 64 = 0 then 'LICENSE' else concat(cast(doc_id as {text}), '.txt') end)"


def report(docs: DataFrame) -> DataFrame:
    """All documents, as files of a tree: source/language/block of 256 ids; ids that 64 divides are named LICENSE."""
    files = docs.select("doc_id", "text", F.expr(PATH.format(big="bigint", text="string")).alias("path"))
    return scan(files).select("doc_id", "path", "license", "how", "score", "licensed_by")


def oracle(threshold: float = 0.75) -> str:
    w = Weights(TEMPLATES, threshold)
    idf = ", ".join(f"('{k}', {v!r}::DOUBLE)" for k, v in sorted(w.idf.items()))
    terms = ", ".join(f"({t}, '{n}', '{k}', {v!r}::DOUBLE)" for t, n, k, v in w.rows)
    return rf"""
WITH idf(word, idf) AS (VALUES {idf}), terms(template, license, word, weight) AS (VALUES {terms}),
f AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {PATH.format(big='BIGINT', text='VARCHAR')} AS path FROM documents),
u AS (SELECT r, unnest(list_distinct(list_concat(string_split(text, chr(10)), CASE WHEN regexp_matches(path, '(?i)(^|/)(licen[cs]e|copying|unlicense)[^/]*$') THEN [text] ELSE [] END))) AS line FROM f),
w AS (SELECT r, line, unnest(regexp_extract_all(lower(line), '{WORD}')) AS word FROM u),
tf AS (SELECT r, line, word, count(*) AS tf FROM w GROUP BY ALL),
tw AS (SELECT r, line, word, tf * coalesce(idf, {w.unknown!r}::DOUBLE) AS w FROM tf LEFT JOIN idf USING (word)),
norm AS (SELECT r, line, sqrt(sum(w * w)) AS norm FROM tw GROUP BY ALL),
dots AS (SELECT r, line, template, license, sum(w * weight) AS dot FROM tw JOIN terms USING (word) GROUP BY ALL),
scored AS (SELECT r, license, round(dot / norm, 9) AS score FROM dots JOIN norm USING (r, line) WHERE round(dot / norm, 9) >= {threshold}),
own AS (SELECT r, first(license ORDER BY score DESC, license) AS license, max(score) AS score FROM scored GROUP BY r),
dirs AS (SELECT regexp_replace(path, '/?[^/]*$', '') AS dir, first(license ORDER BY score DESC, license) AS license, max(score) AS score FROM f JOIN own USING (r) WHERE regexp_matches(path, '(?i)(^|/)(licen[cs]e|copying|unlicense)[^/]*$') GROUP BY 1),
up AS (SELECT r, array_to_string(p[1:i], '/') AS dir FROM (SELECT r, string_split(path, '/') AS p, unnest(range(0, len(string_split(path, '/')))) AS i FROM f ANTI JOIN own USING (r))),
inh AS (SELECT r, first(dir ORDER BY length(dir) DESC) AS licensed_by, first(license ORDER BY length(dir) DESC) AS license, first(score ORDER BY length(dir) DESC) AS score FROM up JOIN dirs USING (dir) GROUP BY r)
SELECT doc_id, path, coalesce(own.license, inh.license) AS license, CASE WHEN own.r IS NOT NULL THEN 'header' WHEN inh.r IS NOT NULL THEN 'inherited' ELSE 'none' END AS how, coalesce(own.score, inh.score) AS score, licensed_by
FROM f LEFT JOIN own USING (r) LEFT JOIN inh USING (r)
"""
