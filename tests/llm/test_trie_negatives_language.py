"""Operators 11 to 13 against SQL and brute force: nulls, empty and long texts, ties, repeated rows, empty tables,
columns of clashing names, groups of copies."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import hard_negatives, language_id, prefix_trie
from foliant.llm import queries as Q

TURNS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_hard_negatives", "op13_language_id"])
def test_against_sql(spark, sf, against_sql, name):
    against_sql(Q.queries()[name](spark, sf), Q.oracle_sql()[name])


# --------------------------------------------------------------------------- 11
def brute_trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [x[2:] for x in sorted(t)] for c, t in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        head = c - int(math.fmod(c, 100))
        built[c] = tuple(convs.get(head, [])[:h] + own[h:])
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[built[c][:d]].append(c)
    out = []
    for path, own in members.items():
        below = [p for p in members if p[: len(path)] == path]
        ends = ",".join(str(c) for c in own if built[c] == path)
        saved = sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p)
        kids = sum(len(p) == len(path) + 1 for p in below)
        leaves = sum(not any(q[:-1] == p for q in below if q) for p in below)
        parent = members[path[:-1]][0] if path else None
        out.append((own[0], len(path), parent, len(own), kids, leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations():
    rng = np.random.default_rng(5)
    rows = []
    for c in [*range(0, 25), *range(95, 130), 205, -3, -100, -150, 10**12]:
        for turn in range(int(rng.integers(0, 7)) + 1):
            rows.append((c, turn, str(rng.choice(["user", "assistant"])), str(rng.choice(["a", "bb", "é", "", "\U0001f600\U0001f600"]))))
    for c in range(300, 320):  # a group of copies
        rows += [(c, t, "user", f"same {t}") for t in range(9)]
    rows += [(330, t, "user", f"long {t % 3}") for t in range(400)] + [(331, t, "user", f"long {t % 3}") for t in range(400)]
    rows += [(340, None, None, None), (340, None, "user", "z"), (340, 1, None, "x"), (340, 1, "user", None), (340, 1, "user", None), (341, 0, "ab", "c"), (342, 0, "a", "bc"), (None, 0, "user", "nobody"), (350, 0, "user", "x" * 5000)]
    return rows


def test_trie(spark, local=20):
    rows = conversations()
    df = spark.createDataFrame(rows, TURNS).withColumns({"depth": F.lit(9), "id": F.lit("x"), "key": F.lit(1)}).repartition(5)
    out = prefix_trie.trie(df, local)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute_trie(rows)


def test_trie_of_nothing(spark):
    assert prefix_trie.report(spark.createDataFrame([], TURNS)).count() == 0
    assert prefix_trie.report(spark.createDataFrame([(None, 0, "user", "x")], TURNS)).count() == 0


def test_trie_hashes_ids_over_several_ranges(spark):
    rows = [(c, 0, "user", "same") for c in range(1, 20_000, 2)]
    got = prefix_trie.report(spark.createDataFrame(rows, TURNS)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_trie_of_one_turn(rows)


def brute_trie_of_one_turn(rows):
    """All say the same, and no conversation opens a hundred: those that lose their turn end in the root."""
    kept = [c for c, *_ in rows if zlib.crc32(str(c).encode()) % 6 == 0]
    lost = [c for c, *_ in rows if zlib.crc32(str(c).encode()) % 6]
    sha = lambda x: hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()
    saved = 4 * (len(kept) - 1)
    return sorted([(rows[0][0], 0, None, len(rows), 1, 1, saved, sha(lost)), (kept[0], 1, rows[0][0], len(kept), 0, 1, saved, sha(kept))], key=str)


def test_numbers_of_a_conversation_over_several_ranges(spark):
    rows = [(1, t, "user", str(t)) for t in range(3000)] + [(c, 0, "user", "x") for c in range(2, 50)]
    got = prefix_trie.numbered(spark.createDataFrame(rows, TURNS).repartition(7)).where("conv_id = 1").orderBy("pos").collect()
    assert [r["pos"] for r in got] == list(range(3000)) and got[2999]["size"] == 4
    assert bytes(got[17]["key"]) == hashlib.sha256(b"4:user17").digest()


# --------------------------------------------------------------------------- 12
def brute_negatives(rows, dims):
    kept = {}
    for i, e, label in rows:
        if i is None or e is None or label is None or len(e) != dims or any(x is None or not math.isfinite(x) for x in e):
            continue
        r = ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in e])
        kept[i] = min(kept.get(i, r), r)
    out = []
    for a, (la, va) in kept.items():
        if a % 100:
            continue
        score = {i: sum(x * y for x, y in zip(va, v)) for i, (_, v) in kept.items() if i != a}
        near = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in near if kept[i][0] == la][:5]:
            band = [i for i in near if kept[i][0] != la and 80 * score[p] <= 100 * score[i] <= 100 * score[p]][:5]
            out += [(a, p, k + 1, i, score[p], score[i]) for k, i in enumerate(band)]
    return sorted(out)


def vectors(rng, n, dims=8, groups=6, spread=0.05):
    centre = rng.standard_normal((groups, dims))
    centre /= np.linalg.norm(centre, axis=1)[:, None]
    x = centre[rng.integers(0, groups, n)] + spread * rng.standard_normal((n, dims))
    return [(int(i), [float(np.float32(c)) for c in v], int(rng.integers(0, 10))) for i, v in enumerate(x)]


@pytest.mark.parametrize("small", [False, True])
def test_negatives(spark, monkeypatch, small):
    rows = vectors(np.random.default_rng(2), 1500)
    rows += [(2000 + i, rows[200][1], 3) for i in range(60)]  # copies: ties go to smaller ids
    rows += [(3000, None, 1), (3100, [1.0] * 8, None), (3200, [math.nan] + [0.0] * 7, 2), (3300, [None] + [1.0] * 7, 2), (3400, [1.0] * 5, 2), (3500, [], 2), (None, [1.0] * 8, 2), (3600, [math.inf] + [0.0] * 7, 2), (3700, [0.0] * 8, 2), (100, rows[100][1], rows[100][2]), (-100, rows[7][1], 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"leaf": F.lit("x"), "score": F.lit(1)}).repartition(3)
    if small:  # a deeper tree, several blocks a leaf, blocks dealt to several tasks
        for name, value in (("CANDIDATES", 64), ("ANCHORS", 4), ("VISITS", 2)):
            monkeypatch.setattr(hard_negatives, name, value)
    got = sorted(tuple(r) for r in hard_negatives.mine(df).collect())
    assert got == brute_negatives(rows, 8) and len(got) > 100


def test_negatives_prune_groups(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "CANDIDATES", 64)
    rows = hard_negatives.stored(hard_negatives.rows_of(spark.createDataFrame(vectors(np.random.default_rng(4), 4000, groups=40, spread=0.01), "vec_id long, embedding array<float>, label int")))
    tree = hard_negatives.grow(rows, 4000, 8, 4096)
    sent = spark.sparkContext.broadcast(tree)
    b = hard_negatives.blocks(rows, sent, 64, 4000, 8, "i2", False)
    a = hard_negatives.blocks(rows.where("vec_id % 10 = 0"), sent, 16, 400, 8, "i2", False)
    pairs = hard_negatives.descend(a, b, tree, sent, 5)
    assert tree.depth >= 5 and pairs.count() < 0.3 * a.count() * b.count()


def test_negatives_of_nothing_and_of_large_numbers(spark):
    schema = "vec_id long, embedding array<double>, label int"
    assert hard_negatives.report(spark.createDataFrame([], schema)).count() == 0
    with pytest.raises(ValueError):
        hard_negatives.report(spark.createDataFrame([(0, [1e300], 1)], schema))
    rows = [(i * 50, [float(2**19 + i), -float(i)], i % 3) for i in range(1, 30)]
    got = sorted(tuple(r) for r in hard_negatives.report(spark.createDataFrame(rows, schema)).collect())
    assert got and got[0][4] > 2**53


# --------------------------------------------------------------------------- 13
def brute_profile(text):
    s = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    s = " " + " ".join(s.split()) + " "
    if not s.strip():
        return Counter()
    g = [s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1)]
    return Counter(x for x in g if x != " " and not (len(x) == 3 and x[1] == " "))


def top(counts):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], len(x[0]), [ord(c) for c in x[0]]))[: language_id.PROFILE]]


def brute_language(rows):
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 4 == 2
    total = defaultdict(Counter)
    for i, text, lang in rows:
        if not held(i) and lang is not None and text is not None:
            total[lang] += brute_profile(text)
    known = {k: {g: r for r, g in enumerate(top(c))} for k, c in total.items() if c}
    out = []
    for i, text, _ in rows:
        own = top(brute_profile(text))
        if not own or not known:
            out.append((i, held(i), "und", 0.0))
            continue
        far = {k: sum(abs(r - p[g]) if g in p else language_id.PROFILE for r, g in enumerate(own)) for k, p in known.items()}
        best = min(far, key=lambda k: (far[k], k))
        out.append((i, held(i), best, 1 - far[best] / (len(own) * language_id.PROFILE)))
    return sorted(out, key=str)


def test_language(spark):
    rng = np.random.default_rng(8)
    say = lambda w, n: " ".join(rng.choice(w.split(), n))
    words = {"xx": "der die das und über Straße", "yy": "the of and thing a", "zz": "и не дом что лес", "ww": "猫 犬 が は 日本"}
    rows = [(i, say(words[k], int(rng.integers(1, 60))), k) for i, k in enumerate(list(words) * 12)]
    rows += [(200, None, "xx"), (201, "", "xx"), (202, "12 !? 3", "yy"), (203, "the of", None), (None, "das und", "xx"), (None, None, None), (204, say(words["yy"], 30_000), "yy"), (205, "the", "xx"), (205, "the", "xx"), (206, "q", "tie"), (207, "1", "none")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"score": F.lit(1), "gram": F.lit("x"), "n": F.lit(2)})
    got = sorted((tuple(r) for r in language_id.report(df).collect()), key=str)
    assert got == brute_language(rows)
    more = language_id.identify(df, df)
    assert more.columns == ["doc_id", "text", "lang", "gram", "n", "lang_pred", "score", "runner_up"] and more.count() == len(rows)
    assert language_id.report(df.limit(0)).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(df, df.limit(0)).collect()} == {"und"}


def test_language_in_blocks(monkeypatch):
    text = "Über  die...Straße 12 und das, ALLES! " * 40 + "ende"
    whole = language_id.grams(text)
    for size in (1, 2, 7, 64):
        monkeypatch.setattr(language_id, "BLOCK", size)
        assert all((a == b).all() for a, b in zip(language_id.grams(text), whole))
    assert Counter(dict(zip(whole[0].tolist(), whole[1].tolist()))).total() == sum(brute_profile(text).values())


def test_language_of_held_out_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = language_id.report(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    right, n = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 20 and right > 0.97
