"""Each operator against brute force on small tables: nulls, empty and long texts, ties, repeated rows, empty tables,
columns of clashing names."""

import hashlib
import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliant.llm import chat, decontaminate, forest, jaccard, language_model, lattice, license_scan, quality, sharding, suffix_dedup
from foliant.llm import queries as Q

DOCS = "doc_id long, text string"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(t))


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(3)
    vocab = [f"w{i}" for i in range(60)] + ["été", "naïve", "日本", "A", "The"]
    text = lambda n: " ".join(rng.choice(vocab, n))
    base, passage = text(120), text(40)
    rows = [(i, text(int(rng.integers(1, 80)))) for i in range(30)]
    rows += [(100 + i, base) for i in range(8)]  # copies
    for i in range(12):  # near copies
        w = base.split()
        for at in rng.integers(0, 120, int(rng.integers(1, 4))):
            w[at] = f"x{i}{at}"
        rows.append((120 + i, " ".join(w)))
    rows += [(150 + i, f"{text(20)} {passage} {text(15)}") for i in range(6)]
    rows += [(200, None), (201, ""), (202, "   \n "), (203, "one"), (204, "one"), (205, "a" * 3000), (206, text(6000)), (207, "\U0001f600 ▁ \x01 mark\x02"), (208, " lead"), (209, "aaaa aaaa bcbcbc ththth"), (30, text(10)), (30, "again"), (None, "no id at all here"), (None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def empty(spark, schema=DOCS):
    return spark.createDataFrame([], schema)


def test_license_scan(spark):
    files = [("a/b/LICENSE", "Released under the MIT License."), ("a/b/c/x.txt", "nothing here"), ("a/y.txt", "nothing"), ("a/b/z.py", "# SPDX-License-Identifier: Apache-2.0\ncode"), (None, "Licensed under CC BY-NC 4.0."), ("LICENSE", None), ("q.txt", None), ("q.txt", ""), ("a/b/c/x.txt", "nothing here")]
    df = spark.createDataFrame([(p, t, "old") for p, t in files], "path string, text string, license string")
    got = {(r["path"], r["text"]): (r["license"], r["how"], r["licensed_by"]) for r in license_scan.scan(df).collect()}
    assert license_scan.scan(df).count() == len(files)
    assert got["a/b/c/x.txt", "nothing here"] == ("MIT", "inherited", "a/b")
    assert got["a/y.txt", "nothing"] == (None, "none", None) and got["a/b/z.py", files[3][1]][0] == "Apache-2.0"
    assert got[None, files[4][1]] == ("CC-BY-NC-4.0", "header", None) and got["q.txt", None][1] == "none"
    assert license_scan.scan(empty(spark, "path string, text string")).count() == 0


def test_license_files_and_wrapped_headers(spark):
    import textwrap

    from foliant.llm import license_texts as T

    body = "MIT License\n\nCopyright (c) 2024 Jane Doe\n\n" + "\n\n".join(textwrap.fill(x, 78) for x in (T.MIT, T.MIT_NOTICE, T.AS_IS.upper()))
    gpl = next(t for n, t in T.BODIES if n == "GPL-3.0" and "either version" in t)
    wrapped = "/*\n * tool.c: a tool\n *\n" + "\n".join(f" * {x}" for x in textwrap.wrap(gpl, 60)) + "\n */\nint main() { return 0; }"
    title = "                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n\n" + "the rest of the text\n" * 50
    files = [("m/LICENSE", body, "MIT"), ("m/x.txt", "nothing", "MIT"), ("g/tool.c", wrapped, "GPL-3.0"), ("h/COPYING", title, "GPL-2.0"), ("z/z.py", "# SPDX-License-Identifier: Zlib", None)]
    files += [(f"s/{x}.py", f"# SPDX-License-Identifier: {x}\ncode", y) for x, y in (("GPL-3.0-or-later", "GPL-3.0"), ("GPL-2.0-or-later", "GPL-2.0"), ("MPL-2.0", "MPL-2.0"), ("ISC", "ISC"), ("LGPL-2.1-only", "LGPL-2.1"))]
    got = {r["path"]: r["license"] for r in license_scan.scan(spark.createDataFrame([f[:2] for f in files], "path string, text string")).collect()}
    assert got == {p: x for p, _, x in files}


def test_chat(spark):
    turns = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "b<o>b", None), (1, 3, "ann", "é"), (1, 3, "ann", "é"), (1, None, None, "first"), (None, 1, "ann", "lost"), (2, 1, "system", "alone"), (3, 100, "x", "far"), (3, 1, "x", "near")]
    out = chat.rotate(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    got = {(r["conv_id"], r["perspective"], r["block"]): r for r in out.collect()}
    assert set(got) == {(1, "ann", 0), (1, "b<o>b", 0), (3, "x", 0), (3, "x", 1)}
    one = got[1, "ann", 0]
    assert one["text"].startswith("<|im_start|>user name=unknown\nfirst<|im_end|>\n<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi <im_end><|im_end|>\n<|im_start|>user name=b_o_b\n<|im_end|>\n")
    spans = [one["text"][int(a) : int(b)] for a, b in (x.split(":") for x in one["mask"].split(","))]
    assert spans == ["hi <im_end><|im_end|>", "é<|im_end|>", "é<|im_end|>"] and one["n_turns"] == 6
    assert not re.search("Python|Pandas|InArrow|ArrowEval", out._jdf.queryExecution().toString())
    assert chat.rotate(empty(spark, "conv_id long, turn long, role string, text string")).count() == 0


def test_chat_hot_blocks(spark):
    """A conversation without turn numbers comes in parts, whose concatenation is the rendering."""
    turns = [(i, None, ("ann", "bob")[n % 2], f"{n:03d}") for i in (1, 2) for n in range(250)] + [(1, 70, "ann", "last")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("old"))
    whole = {(r["conv_id"], r["perspective"], r["block"]): r for r in chat.rotate(df).collect()}
    split: dict = {}
    for r in sorted(chat.rotate(df, most=40).collect(), key=lambda r: (r["block"], r["part"])):
        split.setdefault((r["conv_id"], r["perspective"], r["block"]), []).append(r)
    assert set(split) == set(whole) and all(r["part"] == 0 for r in whole.values())
    for at, parts in split.items():
        assert "".join(r["text"] for r in parts) == whole[at]["text"]
        assert [r["part"] for r in parts] == list(range(len(parts))) and len(parts) == (7 if at[2] == 0 else 1)
        said = lambda r: [r["text"][int(a) : int(b)] for a, b in (x.split(":") for x in r["mask"].split(",") if x)]
        assert [x for r in parts for x in said(r)] == said(whole[at])


def test_chat_query_whole_blocks(spark, tmp_path):
    """A block of any number of turns is one row of the query, with the mask's places in all of it, as in its SQL."""
    duckdb = pytest.importorskip("duckdb")
    turns = [(1, None, ("ann", "bob", "system")[n % 3], f"{n:05d} é") for n in range(9000)] + [(1, 70, "ann", "last"), (2, 5, "ann", "x")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    out = Q.queries()["op2_chat_rotation"](spark, str(tmp_path))
    got = {(r["conv_id"], r["perspective"], r["block"]): r for r in out.collect()}
    assert out.count() == len(got) == 5 and got[1, "ann", 0]["n_turns"] == 9000
    hot = got[1, "ann", 0]
    assert [hot["text"][int(a) : int(b)] for a, b in (x.split(":") for x in hot["mask"].split(","))] == [f"{n:05d} é<|im_end|>" for n in range(0, 9000, 3)]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    result = con.execute(Q.oracle_sql()["op2_chat_rotation"])
    names = [x[0] for x in result.description]
    assert sorted(names) == sorted(out.columns)
    assert sorted(result.fetchall()) == sorted(tuple(r[c] for c in names) for r in got.values())


def test_license_of_nearest_directory(spark):
    """Inheritance against a walk up the path: roots, leading slashes, ties, repeated rows, a very long text."""
    rng = np.random.default_rng(12)
    names = ["a", "b", "c"]
    files = {("LICENSE" if i % 9 == 0 else f"f{i}", tuple(rng.choice(names, int(rng.integers(0, 5))))) for i in range(300)}
    notice = {0: ("MIT", "Released under the MIT License."), 1: ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"), 2: (None, "no words of that kind " * 20000)}
    rows = [("/".join((*d, n)), notice[zlib.crc32("/".join(d).encode()) % 3 if n == "LICENSE" else 2]) for n, d in sorted(files)]
    rows += [("/etc/x", notice[2]), ("/LICENSE", notice[0]), ("c/b/LICENSE", notice[1]), ("c/b/COPYING", notice[0])]
    rows += rows[:20]
    licensed: dict = {}
    for p, (name, _) in rows:
        if name and re.search("LICENSE|COPYING", p):
            licensed.setdefault(p.rpartition("/")[0], set()).add(name)
    got = Counter((r["path"], r["licensed_by"], r["how"]) for r in license_scan.scan(spark.createDataFrame([(p, t[1][:400] if i % 50 else t[1]) for i, (p, t) in enumerate(rows)], "path string, text string")).collect())
    expected: Counter = Counter()
    for p, (name, _) in rows:
        d = p.rpartition("/")[0]
        while name is None and d and d not in licensed:
            d = d.rpartition("/")[0]
        near = None if name or d not in licensed else d
        expected[p, near, "header" if name else "none" if near is None else "inherited"] += 1
    assert got == expected
    assert sum(n for (_, d, _), n in got.items() if d) > 50


def test_forest(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 16)).astype(np.float32)
    x[50:150] = x[0]  # a large class of equal vectors
    data = [(i, [float(v) for v in x[i]]) for i in range(400)] + [(400, None), (401, [0.0] * 16), (402, [float("nan")] + [1.0] * 15), (403, [1.0, None] + [1.0] * 14), (404, [1.0]), (None, [1.0] * 16), (20, [float(v) for v in x[20]])]
    got = {}
    for r in forest.nearest(spark.createDataFrame(data, "vec_id long, embedding array<float>"), k=20).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 400, 20))
    hits = 0
    y = x.astype(np.float64)
    for q, found in got.items():
        score = y @ y[q]
        best = sorted((-score[i], i) for i in range(400) if i != q)[:20]
        assert [f[0] for f in sorted(found)] == list(range(1, 21))
        assert all(abs(s - score[v]) < 1e-9 for _, v, s in found)
        hits += len({v for _, v in best} & {v for _, v, _ in found})
    assert hits >= 0.95 * 20 * len(got)
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in forest.nearest(few).collect()] == [(0, 1, 1, 2.0)]
    assert forest.nearest(empty(spark, "vec_id long, embedding array<float>")).count() == 0


def test_forest_meets_a_part(spark):
    """A full block with the parameters of the query: most of the nearest are found among under half of all vectors."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((16384, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    data = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.ListArray.from_arrays(np.arange(0, x.size + 1, 64, dtype=np.int32), x.ravel())}))
    got = forest.nearest(data, every=64).toPandas().groupby("query_id").vec_id.apply(set)
    asked = np.arange(0, len(x), 64)
    score = x[asked].astype(np.float64) @ x.T.astype(np.float64)
    score[np.arange(len(asked)), asked] = -9
    best = np.argsort(-score, axis=1)[:, :20]
    assert sorted(got.index) == list(asked)
    assert sum(len(got[q] & set(b)) for q, b in zip(asked.tolist(), best.tolist())) >= 0.9 * 20 * len(asked)
    codes = forest.strings(np.column_stack([x, np.zeros(len(x))]), forest.planes(65, 128))
    index = forest.Forest(codes)
    low, high = index.search(codes[asked], 0.2 * len(x) + 20 * 128)
    met = [len(np.unique(np.concatenate([o[a:b] for o, a, b in zip(index.order, low[:, i], high[:, i])]))) for i in range(len(asked))]
    assert np.mean(met) < 0.5 * len(x)


def test_forest_blocks(spark):
    """Several blocks, extra columns: the same scores as by brute force where all is met."""
    rng = np.random.default_rng(9)
    x = rng.standard_normal((300, 8))
    data = spark.createDataFrame([(i, [float(v) for v in x[i]], "a", 1) for i in range(300)], "vec_id long, embedding array<double>, key string, score int")
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in forest.nearest(data, k=5, block=40).collect()}
    score = x @ x.T
    assert got == {(q, n + 1): v for q in range(0, 300, 20) for n, v in enumerate(sorted(set(range(300)) - {q}, key=lambda v: (-score[q, v], v))[:5])}


def brute_windows(text, items):
    tokens = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    w, hit, ids = tokens(text), set(), set()
    for i, t in items:
        v = tokens(t)
        n = min(10, len(v))
        for s in range(len(v) - n + 1) if n else ():
            for p in range(len(w) - n + 1):
                if w[p : p + n] == v[s : s + n]:
                    hit |= set(range(p, p + n))
                    ids |= {i} - {None}
    listed = ",".join(sorted(map(str, ids)))
    return len(w), len(hit), len(ids), hashlib.sha256(listed.encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block", [16 << 20, 200])
def test_decontaminate(spark, docs, rows, block):
    passage = next(t for i, t in rows if i == 150).split()[18:45]
    items = [(1, " ".join(passage)), (22, "Again!"), (3, None), (4, ""), (1, " ".join(passage[5:20])), (None, "no id at all"), (5, " ".join(["zz"] * 30)), (6, rows[5][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.match_benchmark(docs, bench, block_bytes=block)
    expected = []
    for i, t in rows:
        n, h, _, sha, _ = brute_windows(t, items)
        expected.append((i, t, n, h, sha))
    report = Counter((r["doc_id"], r["n_words"], r["n_hit"], r["items_sha256"]) for r in decontaminate.report(docs, bench).collect())
    assert report == Counter((i, n, h, s) for i, _, n, h, s in expected)
    assert Counter(r["n_hit"] for r in found.collect()) == Counter(h for _, _, _, h, _ in expected)
    kept = decontaminate.decontaminate(docs, bench).count()
    assert kept == sum(h == 0 for _, _, _, h, _ in expected)
    assert decontaminate.report(docs, empty(spark, "item_id long, text string")).where("contaminated").count() == 0
    assert decontaminate.report(empty(spark), bench).count() == 0


def test_language_model(spark, docs, rows):
    out = language_model.lm_scores(docs).collect()
    assert len(out) == len(rows)
    tokens = [(i, [*words(t), None]) for i, t in rows]
    crc = lambda i: zlib.crc32(str("" if i is None else i).encode())
    c = Counter(w for i, ws in tokens if crc(i) % 7 != 2 for w in ws)
    n, v = sum(c.values()), len(c)
    expected = Counter((i, crc(i) % 7 == 2, len(ws), sum(w in c for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, ws in tokens)
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out) == expected
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in out)
    assert language_model.lm_scores(empty(spark)).count() == 0


def test_language_model_memory():
    """A chunk of 2 MB in short words as n-grams, and the answers to its keys, in a bounded multiple of its bytes; parts of
    a bucket answer as the whole does."""
    rng = np.random.default_rng(8)
    text = " ".join(map(str, rng.integers(0, 50000, 350_000).tolist()))
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(100)), "text": [text[i : i + len(text) // 100] for i in range(0, len(text) - 99, len(text) // 100)][:100]})

    def peak(f):
        tracemalloc.start()
        out = f()
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return out, most

    language_model.Grams(batch.slice(0, 1))
    g, most = peak(lambda: language_model.Grams(batch))
    assert most < 16 * len(text)
    ones = [(zlib.crc32(str(i).encode()) % 7 != 2) for i in range(100)]
    count = g.counts(np.array(ones)).astype(np.uint32)
    halves = [g.keys[::2], g.keys[1::3], g.keys]
    sent = [[language_model.packed_keys(k) for k in halves], [language_model.pack(c) for c in (count[::2], count[1::3], count)]]
    table = pa.table({"chunk": [0, 1, 2], "bucket": [5] * 3, "n": [len(k) for k in halves], "keys": sent[0], "all": sent[1], "cut": sent[1]})
    out, most = peak(lambda: language_model.met(table, 1 << 15))
    assert most < 50 * sum(len(k) for k in halves)
    total = count.astype(np.int64)
    total[::2] += count[::2]
    total[1::3] += count[1::3]
    for name in ("all", "cut"):
        for got, expected in zip(out.column(name), (total[::2], total[1::3], total)):
            assert np.array_equal(language_model.unpack_array(got.as_buffer(), np.int64, len(expected)), expected)
    single = ((g.keys & np.uint64(1)) > 0) & (g.keys != language_model.BEGIN | np.uint64(1))
    assert out.column("n").to_pylist()[-1] == (single & (total > 0)).sum() and int.from_bytes(out.column("all")[3].as_py(), "little") == total[single].sum()
    assert out.equals(language_model.met(table))


def test_language_model_by_hand(spark):
    """With its learned weights, every score is the mixture of plain counts."""
    data = spark.createDataFrame([(i, f"a b c{i % 3} a b") for i in range(60)], DOCS)
    out = {r["doc_id"]: r["score"] for r in language_model.lm_scores(data).collect()}
    tokens = {i: ["B", *f"a b c{i % 3} a b".split(), None] for i in range(60)}
    crc = {i: zlib.crc32(str(i).encode()) for i in tokens}
    train = [t for i, t in tokens.items() if crc[i] % 7 != 2]
    part = [t for i, t in tokens.items() if crc[i] % 7 != 2 and crc[i] // 7 % 10 != 0]
    cut = [t for i, t in tokens.items() if crc[i] % 7 != 2 and crc[i] // 7 % 10 == 0]
    count = lambda ts: (Counter(w for t in ts for w in t), Counter(p for t in ts for p in zip(t, t[1:])))
    one, two = count(part)
    n = sum(v for w, v in one.items() if w != "B")
    types = len({w for t in train for w in t} - {"B"})
    events = [(int(language_model.level(np.array([one[a]]))[0]), one[a], two[a, b], one[b]) for t in cut for a, b in zip(t, t[1:])]
    table = [(*k, v) for k, v in Counter(events).items()]
    uniform = 1 / (types + 1)
    weights = language_model.learn(spark.createDataFrame(table, "l long, context long, pair long, own long, n long"), n, uniform)
    # token by token, to the end
    common = np.array([0.4, 0.5, 0.1])
    slow = np.tile(common, (language_model.LEVELS, 1))
    p = np.array([[pair / max(c, 1), own / n, uniform] for _, c, pair, own in events])
    for _ in range(3000):
        share = p * common
        common = np.maximum((share / share.sum(1, keepdims=True)).mean(0), language_model.FEWEST)
        common /= common.sum()
        for l in range(language_model.LEVELS):
            share = p[[e[0] == l for e in events]] * slow[l]
            got = (share / share.sum(1, keepdims=True)).sum(0) + 8 * common
            slow[l] = np.maximum(got / got.sum(), language_model.FEWEST)
            slow[l] /= slow[l].sum()
    assert np.abs(weights - slow).max() < 0.02
    assert np.allclose(weights.sum(1), 1)
    one, two = count(train)
    n = sum(v for w, v in one.items() if w != "B")
    for i, t in tokens.items():
        total = 0
        for a, b in zip(t, t[1:]):
            w = weights[int(language_model.level(np.array([one[a]]))[0])]
            total += math.log10(w[0] * two[a, b] / max(one[a], 1) + w[1] * one[b] / n + w[2] / (types + 1))
        assert abs(total - out[i]) < 1e-9


def test_quality(spark):
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for i in range(300):
        good = i % 3 > 0
        w = [rng.choice(["river", "stone", "walks", "morning", "quiet"]) for _ in range(60)]
        rows.append((i, " ".join(w) if good else "!! ".join(x.upper() for x in w)))
        labels.append((i, int(good)))
    rows += [(900, None), (901, ""), (None, "x"), (5, rows[5][1]), (902, "word " * 20000)]
    docs = spark.createDataFrame([(*r, "old") for r in rows], "doc_id long, text string, score string")
    labels += [(7, None), (None, 1)]
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    out = quality.report(docs, lab).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    held = [r for r in out if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 300]
    assert np.mean([r["predicted"] == int(r["doc_id"] % 3 > 0) for r in held]) > 0.95
    assert quality.quality_scores(docs, empty(spark, "doc_id long, quality int")).where("score = 0.5").count() == len(rows)
    assert quality.report(empty(spark), lab).count() == 0


def test_sharding(spark, docs, rows):
    more = docs.unionByName(spark.createDataFrame([(1000 + i, "hot text") for i in range(400)], DOCS))
    out = sharding.report(more).collect()
    assert len(out) == len(rows) + 400
    by = {}
    for r in out:
        by.setdefault(r["shard"], []).append(r)
    assert all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in by.values())
    text = {i: t for i, t in rows if i is not None and i != 30} | {1000 + i: "hot text" for i in range(400)}
    assert all(r["size"] == len((text[r["doc_id"]] or "").encode()) + 1 and r["text_crc32"] == zlib.crc32((text[r["doc_id"]] or "").encode()) for r in out if r["doc_id"] in text)
    even = sharding.report(spark.createDataFrame([(i, "t" * (i % 50)) for i in range(4000)], DOCS)).groupBy("shard").agg(F.sum("size").alias("s")).collect()
    sizes = [r["s"] for r in even]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 0.004 * np.mean(sizes) + 100
    assert sharding.report(empty(spark)).count() == 0


def test_shards_by_hand(spark, docs, rows):
    """The order of the key, the shards' edges and the slots, against a plain sort; columns of clashing names."""
    import xxhash

    more = docs.unionByName(spark.createDataFrame([(1000 + i, "hot text") for i in range(400)], DOCS))
    frame = more.select("*", *[F.lit("old").alias(c) for c in ("size", "shard", "slot", "text_crc32")])
    tolerance = 0.001
    got = sorted((r["shard"], r["slot"], r["doc_id"], r["text"], r["size"]) for r in sharding.shard(frame, 8, tolerance).fillna({"text": "", "doc_id": sharding.LOW}).collect())
    whole = [(sharding.LOW if i is None else i, t or "") for i, t in [*rows, *((1000 + i, "hot text") for i in range(400))]]
    key = lambda d: ((h := xxhash.xxh64_intdigest(d[1].encode(), 42)) - (h >> 63 << 64), d[0])
    plain = sorted(whole, key=key)
    assert [g[2:4] for g in got] == plain  # shards follow each other in the order of the key
    assert all(g[4] == len(g[3].encode()) + 1 for g in got)
    assert [g[1] for g in got] == [n for s in range(8) for n in range(sum(g[0] == s for g in got))]
    edges = {0: 0}  # bytes below each place where the key changes
    for n, a in enumerate(plain[:-1], 1):
        edges[n] = edges[n - 1] + len(a[1].encode()) + 1
    edges = {n: b for n, b in edges.items() if not n or key(plain[n - 1]) != key(plain[n])}
    total = sum(g[4] for g in got)
    at = 0
    for s in range(7):
        at += sum(g[0] == s for g in got)
        below = sum(g[4] for g in got[:at])
        nearest = min(abs(b - total * (s + 1) // 8) for b in [*edges.values(), total])
        assert abs(below - total * (s + 1) // 8) <= max(tolerance * total / 8, nearest)


def test_probes_below():
    rng = np.random.default_rng(2)
    high, low = rng.integers(-3, 3, 500), rng.integers(-3, 3, 500)
    for n in (0, 1, 2, 5, 8, 30):
        probes = sorted({(int(a), int(b)) for a, b in rng.integers(-3, 3, (n, 2))})
        got = sharding.below(high, low, *sharding.arrays(probes)) if probes else np.zeros(500)
        assert got.tolist() == [sum(p <= k for p in probes) for k in zip(high.tolist(), low.tolist())]


def test_splitters_raise(spark):
    keys = spark.range(1000).select(F.col("id").alias("high"), F.col("id").alias("low"), F.lit(1).cast("long").alias("size"))
    with pytest.raises(RuntimeError):
        sharding.splitters(keys, 1000, 4, {j: 0 for j in (1, 2, 3)}, probes=3, rounds=2)


def test_every_copy_has_its_longest_match():
    import pyarrow as pa

    rng = np.random.default_rng(5)
    text = lambda n: list(rng.choice([f"w{i}" for i in range(25)], n))
    passages = [text(30), text(18), text(12)]
    items = [(i, " ".join(p)) for i, p in enumerate(passages)] + [(7, " ".join(passages[0][4:25]))]
    texts = [" ".join(text(6) + p[int(rng.integers(0, 5)) :] + text(4)) for p in passages for _ in range(9)] + ["", " ".join(text(40))]
    bench = decontaminate.Benchmark(items, 10)
    _, hit, before, _, longest = decontaminate.search(pa.array(texts), bench)
    tests = [(i, t.split()[s:]) for i, (_, t) in enumerate(items) for s in range(len(t.split()))]
    for r, w in enumerate(map(str.split, texts)):
        best = (0, None, None)
        for at in range(len(w)):
            for i, q in tests:
                n = next((k for k, (a, b) in enumerate(zip(w[at:], q)) if a != b), min(len(w) - at, len(q)))
                if n >= bench.least and (best[1] is None or (-n, at, i) < (-best[0], best[2], best[1])):
                    best = (n, i, at)
        assert longest[r] == best and (best[0] > 0 or not hit[before[r] : before[r + 1]].any())
    assert sum(x[0] > 0 for x in longest) > 20


def cut_by_hand(rows):
    """The digest of each (doc_id, text), which are in order."""
    seen, out = set(), {}
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(b[p : p + 100])
        kept = bytes(x for x, y in zip(b, gone) if not y)
        out[i] = (len(b), sum(gone), sum(1 for j in range(len(b)) if gone[j] and (not j or not gone[j - 1])), hashlib.sha256(kept).hexdigest())
    return out


def digests(df):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()}


def test_suffix_dedup(spark, docs, rows):
    order = sorted(((i, t) for i, t in rows if i is not None and i != 30), key=lambda r: r[0])
    plain = docs.where("doc_id is not null and doc_id <> 30").repartition(3)
    assert digests(suffix_dedup.report(plain)) == cut_by_hand(order)
    assert suffix_dedup.cut(docs.withColumn("kept", F.lit(1))).count() == len(rows)
    assert suffix_dedup.report(empty(spark)).count() == 0
    # a null doc_id comes first, rows of one doc_id lose all but one of their copies
    text = rows[30][1]
    again = suffix_dedup.report(spark.createDataFrame([(5, text), (None, text), (7, text), (7, text)], DOCS)).collect()
    assert Counter((r["doc_id"], r["n_removed"] == r["n_bytes"]) for r in again) == Counter([(None, False), (5, True), (7, True), (7, True)])


def test_suffix_dedup_over_pieces(spark):
    """A beginning that many documents share lies in many ranges: windows that differ stay in their pieces, equal ones
    meet again. Each passage stands between texts of a document's own."""
    rng = np.random.default_rng(11)
    text = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 5000, n))
    passages = [text(45), text(30)]
    rows = [(i, f"{text(15)} {passages[i % 7 == 0]} {text(12)}") for i in range(150)]
    df = spark.createDataFrame(rows, DOCS).repartition(4)
    chunks = suffix_dedup.chunk_table(df, 4000)
    split = suffix_dedup.stored(suffix_dedup.spill_suffixes(chunks, suffix_dedup.shared_grams(chunks, 2, 100, 24), 100, 24).where("stop is null"))
    found = suffix_dedup.stored(suffix_dedup.covered_spans(split, 100, 24, 40, 60))
    pieces = found.where("body is not null")
    claims = pieces.agg(F.sum("claims")).first()[0]
    met = suffix_dedup.claims_met(pieces, 100, 50)
    assert pieces.count() > 4 and 0 < met.count() < claims / 2  # more pieces than ranges
    assert met.groupBy("before", "window").count().where("count < 2").isEmpty()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        assert digests(suffix_dedup.report(df)) == cut_by_hand(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("n,num,den,scheme", [(3, 90, 100, (2, 1)), (5, 8, 10, (1, 0)), (5, 8, 10, (3, 1))])
def test_jaccard(spark, docs, rows, n, num, den, scheme):
    def shingles(t):
        w = words(t)
        return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])

    own = [(i, t) for i, t in rows if i is not None and i != 30]
    sets = {i: shingles(t) for i, t in own}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(docs.where("doc_id is not null and doc_id <> 30").repartition(3), n, num, den, scheme).collect()}
    assert got == {i: (len(s), root(i)) for i, s in sets.items()}
    assert jaccard.near_duplicates(docs).count() == len(rows)
    # rows of one doc_id go by their own texts, rows of none are alone
    odd = spark.createDataFrame([(1, "a b c d e f g"), (1, "t u v w x y z"), (2, "t u v w x y z"), (3, "a b c d e f g"), (None, "a b c d e f g"), (4, None), (4, None)], DOCS)
    found = jaccard.near_duplicates(odd.withColumn("row", F.lit("old")), n, num, den, scheme).collect()
    assert Counter((r["doc_id"], r["component_id"], r["keeper"]) for r in found) == Counter([(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (None, None, True), (4, 4, True), (4, 4, True)])
    assert jaccard.report(empty(spark)).count() == 0


def test_components_settle_or_raise(spark):
    from foliant.llm.components import components

    path = spark.createDataFrame([(i, i + 1) for i in range(40)], "x long, y long")
    assert {r["component"] for r in components(path, "x", "y").collect()} == {0}
    with pytest.raises(RuntimeError):
        components(path, "x", "y", rounds=2)


def test_signatures_are_shared():
    """Every pair at the threshold shares a signature, whatever its sizes."""
    rng = np.random.default_rng(9)
    for num, den, scheme in ((90, 100, (3, 1)), (90, 100, (2, 1)), (8, 10, (1, 0)), (8, 10, (4, 2))):
        for size in [1, 2, 9, 10, 11, 18, 19, 20, 57, 199, 500]:
            for _ in range(20):
                a = rng.integers(0, 2**63, size, dtype=np.uint64)
                drop = int(rng.integers(0, size * (den - num) // den + 1))
                b = a[drop:].copy()
                extra = (den * len(b) - num * size) // num
                b = np.concatenate([b, rng.integers(0, 2**63, int(rng.integers(0, extra + 1)), dtype=np.uint64)])
                x, y = np.unique(a), np.unique(b)
                common = len(np.intersect1d(x, y))
                if not len(y) or den * common < num * (len(x) + len(y) - common):
                    continue
                h, begins = np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)])
                sig, owner = jaccard.signatures(h, begins, np.array([0, 1]), num, den, scheme)
                assert set(sig[owner == 0]) & set(sig[owner == 1])


def thue_morse(n):
    """A word and its complement, which powers of one odd base modulo 2**64 don't tell apart."""
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_words_are_told_apart(spark):
    from foliant.llm.common import span_hashes

    for n in (512, 1024, 4096):
        a, b = thue_morse(n)
        one, two = span_hashes(np.frombuffer((a + b).encode(), np.uint8), np.array([0, n]), np.array([n, 2 * n]))
        assert one != two
    a, b = thue_morse(1024)
    data = spark.createDataFrame([(7, a), (8, b), (9, f"{a} {b}")], DOCS)
    bench = spark.createDataFrame([(1, a)], "item_id long, text string")
    assert {r["doc_id"]: r["n_hit"] for r in decontaminate.report(data, bench).collect()} == {7: 1, 8: 0, 9: 1}
    assert {r["component_id"] for r in jaccard.report(data).collect()} == {7, 8, 9}
    assert all(r["round_trip"] for r in lattice.encode(data).collect())
    assert lattice.encode(data).select("ids").distinct().count() == 3




def test_lattice_groups(spark):
    """A group is sixteen chunks, whose segments are sent once, or fewer of large texts; segments as strings, in characters
    of any width."""
    rows = [(i, f"word{i % 7} été 日本 𝄞 " * 40) for i in range(48)] + [(100 + i, "long " * 8000) for i in range(5)]
    data = spark.createDataFrame(rows, DOCS).coalesce(1)
    before = {t.name for t in spark.catalog.listTables()}
    out = lattice.encode(data, most=1 << 12)
    (name,) = {t.name for t in spark.catalog.listTables()} - before
    assert sorted(r["count"] for r in spark.table(name).groupBy("group").count().collect()) == [2, 2, 13]
    assert out.columns == ["doc_id", "text", "ids", "n_pieces", "round_trip"]
    got = {r["doc_id"]: r for r in out.collect()}
    assert {k: r["text"] for k, r in got.items()} == dict(rows) and all(r["round_trip"] for r in got.values())
    short = lattice.encode(data, most=1 << 12, together=1, drop=("text",))
    assert short.columns == ["doc_id", "ids", "n_pieces", "round_trip"]
    assert {r["doc_id"]: r["ids"] for r in short.collect()} == {k: r["ids"] for k, r in got.items()}
    model = lattice.read_model()
    s = lattice.Segments(pa.RecordBatch.from_pydict({"text": [t for _, t in rows[:9]]}), model)
    at = np.argsort(s.keys)[::-1]
    assert s.strings(at).to_pylist() == [s.codes[s.starts[i] : s.ends[i]].tobytes().decode("utf-32-le") for i in s.first[at]]
    assert s.strings(at[:0]).to_pylist() == [] and model.output is model.output


@pytest.mark.parametrize("kind", [lattice.BPE, lattice.UNIGRAM])
def test_lattice(spark, docs, rows, tmp_path, kind):
    tokenizer = pytest.importorskip("sentencepiece")
    data = open(lattice.MODEL, "rb").read()
    model = lattice.Model(data)
    path = lattice.MODEL
    if kind == lattice.UNIGRAM:  # the same pieces and scores, read as a unigram model
        at = data.index(b"\x18\x02", data.rindex("梦".encode()))
        data = data[: at + 1] + b"\x01" + data[at + 2 :]
        path = str(tmp_path / "unigram.model")
        open(path, "wb").write(data)
    assert lattice.read_model(path).kind == kind and len(model.pieces) == 32000
    library = tokenizer.SentencePieceProcessor(model_file=path)
    out = lattice.encode(docs.withColumn("ids", F.lit("old")), path)
    got = Counter((r["doc_id"], r["text"], tuple(r["ids"])) for r in out.collect())
    assert got == Counter((i, t, tuple(library.encode(t or ""))) for i, t in rows)
    assert all(r["round_trip"] == ("▁" not in (r["text"] or "")) for r in out.collect())
    assert all(r["decoded"] == (r["text"] or "").replace("▁", " ") for r in lattice.decode(out, path).collect())
    assert lattice.encode(empty(spark), path).count() == 0


@pytest.mark.parametrize("name", list(Q.oracle_sql()))
def test_against_sql(spark, sf, against_sql, name):
    against_sql(Q.queries()[name](spark, sf), Q.oracle_sql()[name])


def test_pipeline(spark, sf):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = docs
    for at, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, seen, sf)
        assert at == len(P.STAGES) - 1 or out.columns == docs.columns
        seen = P.stored(out)
    assert 0 < seen.count() < docs.count() and seen.where("not round_trip").count() == 0
    assert P.run(spark, sf).count() == seen.count()


def test_pipeline_leaves_columns_alone(spark, sf):
    """Columns named like those of the operators keep their values in every filtering stage."""
    import corpus_pipeline as P

    names = ["score", "n_words", "contaminated", "n_bytes", "kept", "keeper", "component_id", "_id", "_t"]
    docs = P.stored(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "n_chars", *[F.concat(F.lit(c), F.col("doc_id")).alias(c) for c in names]))
    for _, stage in P.STAGES[:-1]:
        out = P.stored(stage(spark, docs, sf))
        assert out.columns == docs.columns and 0 < out.count() < docs.count()
        assert out.where(" or ".join(f"not (`{c}` <=> concat('{c}', doc_id))" for c in names)).isEmpty()
        assert out.where("n_chars <> length(text)").isEmpty()


def test_pipeline_of_nothing(spark, sf):
    """Null and empty texts pass or go alike, an empty table stays empty."""
    import corpus_pipeline as P

    for docs in (empty(spark), spark.createDataFrame([(1, None), (2, ""), (3, None), (None, None)], DOCS)):
        for _, stage in P.STAGES[1:-1]:
            out = P.stored(stage(spark, docs, sf))
            assert out.count() == docs.count()
        kept = P.stored(P.keep_quality(spark, docs, sf)).count()
        assert kept in (0, docs.count())


def test_attention_by_hand():
    """Forward pass and gradients of the attention model against plain sums and differences."""
    rng = np.random.default_rng(2)
    model = quality.Model(np.float32(0.1), np.float32(1.5), None)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x, begins, y = rng.standard_normal((7, quality.FEATURES)), np.array([0, 3, 4, 7]), np.array([1.0, 0.0, 1.0])
    p, scores = model.p, []
    for a, b in zip(begins, begins[1:]):
        h = [np.tanh((v - model.mean) / model.scale @ p["W"] + p["b"]) for v in x[a:b]]
        e = [float(np.exp((np.tanh(v @ p["V"]) / (1 + np.exp(-(v @ p["U"])))) @ p["w"])) for v in h]
        z = sum(w * v for w, v in zip(e, h)) / sum(e)
        scores.append(1 / (1 + np.exp(-(z @ p["c"] + p["d"][0]))))
    assert np.allclose(model.forward(x, begins)[6], scores)
    loss = lambda: -np.mean(np.where(y > 0, np.log(s := model.forward(x, begins)[6]), np.log(1 - s)))
    found = model.step(x, begins, y, np.ones(3))
    for k in p:
        at = tuple(rng.integers(0, n) for n in p[k].shape)
        kept, d = p[k][at], 1e-6
        p[k][at] = kept + d
        up = loss()
        p[k][at] = kept - d
        down = loss()
        p[k][at] = kept
        assert abs((up - down) / (2 * d) + 1e-4 * kept * (k == "W") - found[k][at]) < 1e-5, k
