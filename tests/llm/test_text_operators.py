"""The text operators against brute-force versions, on small tables with nulls, ties, repeats and very long texts."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larkspur.llm import bpe, chat, components, decontaminate, hmm, linedup, mincut, ngramjoin, quality, substring, textvec, topk

RNG = random.Random(5)
VOCABULARY = ["".join(RNG.choice("abcdé") for _ in range(RNG.randint(1, 4))) for _ in range(60)]


def sentence(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def corpus():
    rng = random.Random(11)
    base = [sentence(rng, rng.randint(5, 120)) for _ in range(40)]
    docs = []
    for i in range(120):
        kind = rng.random()
        t = rng.choice(base)
        if kind < 0.3:
            w = t.split()
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = "new" + str(rng.randrange(1000))
            t = " ".join(w)
        elif kind < 0.5:
            t = sentence(rng, 20) + "\n" + t + "\n" + rng.choice(base)
        elif kind < 0.6:
            t = t.upper()
        elif kind < 0.8:
            t = sentence(rng, rng.randint(0, 60))
        docs.append((i, t))
    docs += [(200, None), (201, ""), (202, " \t\n "), (203, "one"), (204, "one"), (205, " ".join(VOCABULARY * 300)), (206, " ".join(VOCABULARY * 300) + " x")]
    return docs


DOCS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in DOCS], "doc_id long, text string, n_words string, rep int").repartition(5).cache()


def lower(b):
    return bytes(x + 32 if 65 <= x <= 90 else x for x in b)


def words(t):
    return re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())


def test_pieces_are_those_of_a_regex():
    texts = [t for _, t in DOCS] + ["\x0b a\x00b \x1c", "x"]
    data, at = textvec.buffers(pa.array(texts, pa.string()))
    p = textvec.pieces(data, at, fold=True)
    got = [[bytes(data[a:b]) for a, b in zip(p.start[x:y], p.stop[x:y])] for x, y in zip(p.lo, p.hi)]
    assert got == [words(t) for t in texts]
    by = defaultdict(set)
    for a, b, h in zip(p.start, p.stop, p.hash):
        by[lower(bytes(data[a:b]))].add(int(h))
    assert all(len(v) == 1 for v in by.values()) and len({next(iter(v)) for v in by.values()}) == len(by)


def clusters():
    """Copies of a few texts with edits near the threshold, which share passages too."""
    rng = random.Random(17)
    passage = sentence(rng, 14)
    out = []
    for b in range(8):
        base = sentence(rng, rng.randint(16, 60)).split()
        for _ in range(25):
            w = list(base)
            for _ in range(rng.randint(0, 1 + len(w) // 18)):
                w[rng.randrange(len(w))] = rng.choice(VOCABULARY + ["own" + str(rng.randrange(99))])
            out.append((len(out), " ".join(w) + (" " + passage) * rng.randint(0, 1)))
    return out


@pytest.mark.parametrize("kind", ["mixed", "clusters"])
def test_near_duplicates(spark, docs, kind):
    rows = DOCS if kind == "mixed" else clusters()
    docs = docs if kind == "mixed" else spark.createDataFrame(rows, "doc_id long, text string")
    sets = {}
    for i, t in rows:
        w = words(lower((t or "").encode()).decode())
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                lo, hi = sorted((root(a), root(b)))
                parent[hi] = lo
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngramjoin.near_duplicates(docs).collect()}
    assert got == {i: (len(s), root(i)) for i, s in sets.items()}
    assert len(set(c for _, c in got.values())) < len(got)


def test_near_duplicates_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ngramjoin.near_duplicates(empty).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (4, "a b c d e F")], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in ngramjoin.near_duplicates(odd).collect()) == [(-1, 2, None), (3, 2, 3), (3, 2, 3), (4, 2, 3)]


def test_near_duplicates_of_rows_that_repeat_an_id(spark):
    a, b, c = ("one two three four five six seven eight nine ten", "k l m n o p q r s t u", "lone row of other words entirely here")
    rows = [(3, a), (3, b), (4, a + " x"), (5, b + " y"), (6, c), (3, c + " z"), (3, None), (None, a), (7, "")]
    want = [(None, 6, None), (3, 0, 3), (3, 4, 3), (3, 6, 3), (3, 7, 3), (4, 7, 3), (5, 8, 3), (6, 3, 6), (7, 0, 7)]
    plain = lambda df: sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=lambda r: (r[0] is not None, *r))
    assert plain(ngramjoin.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == want
    strings = spark.createDataFrame([(None if i is None else f"d{i}", t) for i, t in rows], "doc_id string, text string")
    assert plain(ngramjoin.near_duplicates(strings)) == [(None if i is None else f"d{i}", n, None if c is None else f"d{c}") for i, n, c in want]


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (3, 30), (30, 31), (31, 32), (7, 7)], "a long, b long")
    want = {1: 1, 2: 1, 3: 1, 30: 1, 31: 1, 32: 1, 7: 7, 8: 8, 9: 8}
    assert {r.node: r.label for r in components.components(links).collect()} == want
    hub = spark.range(1, 400).selectExpr("1000 as a", "1000 + id as b").union(spark.range(1, 400).selectExpr("5000 + id as a", "5001 + id as b"))
    assert {r.node: r.label for r in components.components(links.union(hub)).collect()} == {**want, **{1000 + k: 1000 for k in range(400)}, **{5000 + k: 5001 for k in range(1, 401)}}


def plain_substrings(rows):
    first = {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        w = words(t)
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    out = {}
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())
    return out


def test_substrings(docs):
    done = substring.dedup_substrings(docs)
    removed = F.aggregate("repeats", F.lit(0).cast("long"), lambda s, r: s + r.stop - r.start)
    got = {r.doc_id: (r.n_words, r.n, r.h) for r in done.select("doc_id", "n_words", removed.alias("n"), F.sha2(F.col("kept").cast("binary"), 256).alias("h")).collect()}
    assert got == plain_substrings(DOCS)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_substrings_of_rows_that_repeat_an_id(spark, kind):
    p = sentence(random.Random(1), 20)
    own = lambda c, n: " ".join(f"{c}{k}" for k in range(n))
    rows = [(1, f"a b {p}"), (5, f"{own('w', 80)} {p}"), (5, own("v", 8)), (6, own("u", 50)), (6, f"x {p} z"), (6, f"x {p} z"), (None, p), (7, None)]
    typed = [(i if i is None or kind == "long" else f"k{i}", t) for i, t in rows]
    done = substring.dedup_substrings(spark.createDataFrame(typed, f"doc_id {kind}, text string").repartition(3))
    got = sorted((str(r.doc_id).lstrip("k"), r.n_words, sum(x.stop - x.start for x in r.repeats)) for r in done.collect())
    assert got == [("1", 22, 0), ("5", 8, 0), ("5", 100, 20), ("6", 22, 20), ("6", 22, 20), ("6", 50, 0), ("7", 0, 0), ("None", 20, 0)]


def test_decontamination(spark, docs):
    rng = random.Random(3)
    items = [(k, rng.choice(DOCS[:100])[1]) for k in range(6)] + [(90, "One"), (91, ""), (92, None), (None, "a b"), (5, "zz zz")]
    table = spark.createDataFrame(items, "item_id long, text string")

    def norm(t):
        return re.findall(rb"[0-9a-z\x80-\xff]+", lower((t or "").encode()))

    windows = defaultdict(set)
    for k, t in items:
        w = norm(t)
        if k is not None and w:
            for x in range(max(1, len(w) - 9)):
                windows[tuple(w[x : x + 10])].add(str(k))
    want = {}
    for i, t in DOCS:
        w = norm(t)
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for x in range(len(w) - n + 1):
                if tuple(w[x : x + n]) in windows:
                    found |= windows[tuple(w[x : x + n])]
                    hit |= set(range(x, x + n))
        want[i] = (len(w), len(hit), sorted(found))
    for most in (decontaminate.MAX_PATTERN_CHARS, 500):  # one automaton, and several
        rows = decontaminate.decontaminate(docs, table, most=most).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in rows} == want
        texts = dict(DOCS)
        for r in rows:
            assert sum(len(norm(texts[r.doc_id][s.start : s.stop])) for s in r.spans) == r.n_hit
    assert any(h for _, h, _ in want.values())
    assert decontaminate.decontaminate(docs, table.limit(0)).agg(F.sum("n_hit")).first()[0] == 0


def test_decontamination_of_repeated_and_null_ids_and_clashing_names(spark):
    item, other = (" ".join(f"{c}{k}" for k in range(15)) for c in "uv")
    table = spark.createDataFrame([(1, item), (2, other), (2, other + " w")], "item_id long, text string")
    rows = [(None, f"a {item} b"), (7, f"{item} {other}"), (7, "nothing in here"), (7, None), ("x", other)]
    for kind in ("long", "string"):
        typed = [(i if i is None else str(i) if kind == "string" else 9 if i == "x" else i, t, 5, 6, 7, 8) for i, t in rows]
        docs = spark.createDataFrame(typed, f"doc_id {kind}, text string, n_words int, _id int, _items int, spans int")
        got = [decontaminate.decontaminate(docs, table, most=most, carry=tuple(docs.columns)) for most in (4_000_000, 100)]
        assert got[0].columns == got[1].columns == ["doc_id", "text", "_id", "_items", "n_words", "n_hit", "items", "spans"]
        one, several = (sorted(df.select("doc_id", "_items", "n_words", "n_hit", "items", "spans").collect(), key=str) for df in got)
        assert one == several
        assert sorted((r.n_words, r.n_hit, r["items"]) for r in one) == [(0, 0, []), (3, 0, []), (15, 15, ["2"]), (17, 15, ["1"]), (30, 30, ["1", "2"])]


def test_line_dedup(spark):
    long = "x" * 50
    rows = [(1, f"{long}1\n{long}2\nshort\n{long}3"), (2, f"own line\n{long}1\n{long}2\nshort\nmore of its own"), (3, f"{long}1\n{long}2\nshort\n{long}3"), (4, "short"), (5, "a\nshort"), (6, None), (7, ""), (8, f"{long}3\n{long}1"), (8, f"{long}3\n{long}1")]
    got = defaultdict(list)
    for r in linedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r.doc_id].append((r.text, r.n_lines, r.n_removed))
    assert got[1] == [(rows[0][1], 4, 0)] and got[2] == [("own line\nmore of its own", 5, 3)] and got[3] == [("", 4, 4)]
    assert got[4] == [("short", 1, 0)] and got[5] == [("a\nshort", 2, 0)] and got[6] == [(None, 0, 0)] and got[7] == [("", 0, 0)]
    assert len(got[8]) == 2 and got[8][0][2] == 1
    assert linedup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_line_dedup_is_that_of_all_pairs(spark):
    rows = [(1, "Share this article"), (2, "Leave a comment"), (3, "Posted by admin")]
    rows += [(k, f"own {k}\nShare this article\nLeave a comment\nPosted by admin\nend {k}") for k in (10, 11)]
    got = {r.doc_id: r.text for r in linedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {**dict(rows), 11: "own 11\nend 11"}

    rng = random.Random(23)
    pool = ["x" * rng.choice([3, 15, 25, 50]) + str(k) for k in range(14)]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.8 else f"own {i} {k}" for k in range(rng.randint(1, 9)))) for i in range(160)]
    lines = {i: t.split("\n") for i, t in rows}
    want = {}
    for j, b in lines.items():
        gone = {x for i, a in lines.items() if i < j for x in linedup.aligned_lines(b, a, [len(x) for x in b])}
        want[j] = (len(gone), "\n".join(x for k, x in enumerate(b) if k not in gone))
    got = {r.doc_id: (r.n_removed, r.text) for r in linedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_line_dedup_of_repeated_ids_and_clashing_names(spark):
    x, y, z = ("x" * 45, "y" * 45, "z" * 45)
    rows = [(1, x), (3, f"{x}\n{y}"), (3, "own\nlines"), (3, f"{y}\n{z}"), (5, f"a\n{y}"), (5, f"a\n\n{y}"), (None, f"{x}\n{y}"), (7, None)]
    for kind in ("long", "string"):
        df = spark.createDataFrame([(i if i is None or kind == "long" else str(i), t, 1, 2, 3, 4) for i, t in rows], f"doc_id {kind}, text string, _gone int, gone int, i int, n_removed int")
        out = linedup.dedup_lines(df, carry=tuple(df.columns))
        assert out.columns == ["doc_id", "text", "_gone", "gone", "i", "n_lines", "n_removed"]
        got = sorted((str(r.doc_id), str(r.text), r.n_removed, r.gone) for r in out.collect())
        assert got == sorted([("1", x, 0, 2), ("3", y, 1, 2), ("3", "own\nlines", 0, 2), ("3", f"{y}\n{z}", 0, 2), ("5", "a", 1, 2), ("5", "a\n", 1, 2), ("None", f"{x}\n{y}", 0, 2), ("7", "None", 0, 2)])


def test_patience_aligns_like_a_subsequence():
    rng = random.Random(2)
    for _ in range(200):
        a, b = [rng.randint(0, 12) for _ in range(rng.randint(0, 15))], [rng.randint(0, 12) for _ in range(rng.randint(0, 15))]
        pairs = linedup.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    assert linedup.patience([1, 2, 3], [1, 2, 3]) == [(0, 0), (1, 1), (2, 2)]


def test_bpe_round_trip_and_reference(docs):
    tiktoken = pytest.importorskip("tiktoken")
    tokenizers = pytest.importorskip("public_tokenizers")
    path = tokenizers.path("byte_bpe_multi_50k.tiktoken")
    v = bpe.vocabulary(open(path, "rb").read(), tokenizers.PATTERN)
    plain = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=v.rank, special_tokens={})
    rng = random.Random(9)
    alphabet = ["a", "b", " ", "  ", "\n", "é", "\x1c", "\x85", "\xa0", "1", "!", "'s", "😀", "日本", "the", "tion", "\x00", "<|endoftext|>"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(300)] + ["a" * 3000, "", "é" * 700, "the" * 500]
    for text, ids in zip(texts, v.encode(texts)):
        assert ids.tolist() == plain.encode_ordinary(text)
        assert v.decode(ids.astype(int)) == text.encode()
    for r in bpe.encode(docs, path, tokenizers.PATTERN).collect():
        text = dict(DOCS)[r.doc_id] or ""
        assert r.ids == plain.encode_ordinary(text) and bytes(r.decoded) == text.encode()


def test_top_k(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(300, 12)).astype(np.float32)
    v[50:90] = v[7]
    rows = [(i, [float(x) for x in e]) for i, e in enumerate(v)] + [(1000, None), (1001, [float("nan")] * 12), (1002, [1.0, None] * 6), (1050, [1.0, 2.0]), (1051, [3.0, 1.0]), (1100, [1.0] * 5), (None, [1.0] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = set()
    q = {i: [int(np.floor(256 * np.float64(np.float32(x)))) for x in e] for i, e in rows if i is not None and e and all(x is not None and np.isfinite(x) for x in e)}
    for i, a in q.items():
        if i % 50 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), j) for j, b in q.items() if j != i and len(b) == len(a))[:5]
            want |= {(i, k + 1, j, -s) for k, (s, j) in enumerate(scored)}
    got = {tuple(r) for r in topk.search(df, F.col("id") % 50 == 0).collect()}
    assert got == want


def test_top_k_of_vectors_of_any_size(spark):
    rng = np.random.default_rng(9)
    scale = [1, 1, 2.0**12, 2.0**20, 2.0**30, 2.0**60]
    rows = [(i, [float(x) for x in (rng.normal(size=3) * scale[i % 6]).astype(np.float32)]) for i in range(120)] + [(200, [1.0, 2.0]), (201, [2.0**20, 1.0]), (250, [0.0, 0.0])]
    q = {i: [int(np.floor(256 * np.float64(x))) for x in e] for i, e in rows}
    want = set()
    for i, a in q.items():
        if i % 50 == 0:
            scored = sorted((-min(max(sum(x * y for x, y in zip(a, b)), -(2**63)), 2**63 - 1), j) for j, b in q.items() if j != i and len(b) == len(a))[:5]
            want |= {(i, k + 1, j, -s) for k, (s, j) in enumerate(scored)}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert {tuple(r) for r in topk.search(df, F.col("id") % 50 == 0).collect()} == want
    assert {r.score for r in topk.search(df, F.col("id") == 200).collect()} == {256 * 256 * (2**20 + 2), 0}
    with pytest.raises(ValueError):
        topk.search(df.select(F.col("vec_id").cast("string").alias("vec_id"), "embedding"), F.lit(True))


def test_queries_below_the_cutoff_are_not_multiplied():
    rng = np.random.default_rng(3)
    q, c = (np.floor(rng.normal(size=(n, 8)) * 50) for n in (40, 300))
    full = (q @ c.T).astype(np.int64)
    cut = np.sort(full, axis=1)[:, -5].astype(float)
    cut[::2] = full.max(axis=1)[::2] + 1  # which no row reaches
    rows, lists = topk.lists_that_reach(q, c, cut, 4)
    assert (sum(lists) == full[rows]).all() and set(range(1, 40, 2)) <= set(rows.tolist())
    assert topk.lists_that_reach(q, c, np.full(40, np.linalg.norm(q, axis=1).max() * np.linalg.norm(c, axis=1).max() * 8), 4)[0].size == 0


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 1, "assistant", "yes"), (3, 2, "user", " more "), (4, 0, "user", "hi"), (4, 1, "assistant", "no"), (5, 0, None, None), (None, 0, "user", "hi"), (6, None, "user", "x"), (7, 0, "user", "hi"), (7, 1, "assistant", "no")]
    rows += [(8, t, "user", f"t{t}") for t in range(700)] + [(9, t, "user", f"t{t}") for t in range(600)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    assert {(r.conv_id, r.n_turns) for r in chat.maximal(df).collect()} == {(3, 3), (4, 2), (5, 1), (8, 700)}
    out = {(r.conv_id, r.turn): r.rendered for r in chat.format_chats(df).collect()}
    assert out[3, 2] == "<|user|>\nmore\n<|end|>\n" and len(out) == 706
    assert chat.format_chats(df.limit(0)).count() == 0


def test_quality_learns_and_scores_all(spark, docs):
    rng = random.Random(8)
    rows = [(i, sentence(rng, 60).capitalize() + "." if i % 2 else "###".join(sentence(rng, 60).split())) for i in range(400)] + [(900, None), (901, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(None, 1), (5, None), (99999, 0)], "doc_id long, quality int")
    forest = quality.learn(df, labels, lambda i: quality.third(i) != 1)
    scored = {r.doc_id: r.score for r in quality.score(df, forest).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(scored[i] >= 0.5) == (i % 2 == 1) for i in held]) > 0.97
    assert len(scored) == 402 and all(0 <= s <= 1 for s in scored.values())
    assert quality.score(docs, quality.learn(df, labels.limit(0))).agg(F.count("score")).first()[0] == len(DOCS)


def test_quality_of_rows_that_repeat_an_id(spark):
    rows = [(1, "A good text of some words, which ends well."), (1, "### ### ###")] * 40 + [(2, "# # #"), (None, "x"), (3, None)]
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0)], "doc_id long, quality int")
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    one, two = (quality.learn(df, labels, most=50) for _ in range(2))
    assert one.start == two.start and (one.leaf == two.leaf).all() and (one.threshold == two.threshold).all()
    assert quality.score(df, one).count() == len(rows)


def test_trees_are_walked_and_grown_as_plain_ones():
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(300, 3)), 1)
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] > 0.5)).astype(float)
    forest = quality.fit(x, y)

    def walk(row):
        total = forest.start
        for feature, threshold, leaf in zip(forest.feature, forest.threshold, forest.leaf):
            at = 0
            while at < len(feature):
                at = 2 * at + (2 if row[feature[at]] > threshold[at] else 1)
            total += leaf[at - len(feature)]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(forest.score(x), [walk(r) for r in x]) and np.mean((forest.score(x) >= 0.5) == y) > 0.97
    # the first split of the first tree is the best of all by gain
    p = y.mean()
    g, h = p - y, np.full(len(y), p * (1 - p))

    def gain(j, t):
        left = x[:, j] <= t
        if h[left].sum() < quality.LEAST_WEIGHT or h[~left].sum() < quality.LEAST_WEIGHT:
            return -1
        part = lambda s: g[s].sum() ** 2 / (h[s].sum() + quality.RIDGE)
        return part(left) + part(~left) - part(np.ones(len(y), bool))

    best = max(gain(j, t) for j in range(3) for t in np.unique(x[:, j])[:-1])
    assert gain(forest.feature[0, 0], forest.threshold[0, 0]) == pytest.approx(best)


def test_hmm_scores_are_those_of_plain_recursion(spark, docs):
    source = docs.select(F.col("doc_id").alias("i"), F.col("text").alias("t"))
    lexicon = hmm.learn_lexicon(source)
    model, _ = hmm.train(source, lexicon, 2)
    got = {r.doc_id: r.score for r in hmm.score(source, lexicon, model).collect()}
    tokens = {i: [lower(w) for w in words(t)] for i, t in DOCS}
    count = Counter(w for i, ws in tokens.items() if not hmm.held_out(i) for w in ws)
    ends = sum(not hmm.held_out(i) for i in tokens)
    top = set(sorted(count, key=lambda w: -count[w])[: hmm.TOP])  # all of them: the corpus has fewer kinds
    assert len(top) == len(count) == len(lexicon.count)
    want = {}
    for i, t in DOCS:
        data, at = textvec.buffers(pa.array([t], pa.string()))
        p = textvec.pieces(data, at, fold=True)
        symbols = [*lexicon.symbol(p).tolist(), lexicon.symbols - 1]
        a, log = None, 0.0
        for s in symbols:
            a = [(model.start[k] if a is None else sum(a[j] * model.move[j, k] for j in range(hmm.STATES))) * model.emit[s, k] for k in range(hmm.STATES)]
            c = sum(a)
            log += np.log10(c)
            a = [v / c for v in a]
        for w, s in zip(tokens[i], symbols):
            if w not in top:  # a word of a class: its share of the class, of which training saw none
                log += np.log10(hmm.ADD) - lexicon.rest_total[s - len(lexicon.count)]
        want[i] = log
    assert got == pytest.approx(want, rel=1e-9) and ends + sum(count.values()) == lexicon.tokens


def test_hmm_counts_base_and_likelihood(spark, docs):
    got = {r.doc_id: r for r in hmm.language_model_scores(docs).collect()}
    tokens = {i: [lower(w) for w in words(t)] + [None] for i, t in DOCS}
    count = Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 10 for w in ws)
    n, v = sum(count.values()), len(count)
    for i, ws in tokens.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ws), sum(count[w] > 0 for w in ws), n, zlib.crc32(str(i).encode()) % 10 == 0)
        assert r.base_score == pytest.approx(sum(np.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws))
        assert r.score < 0
    assert hmm.language_model_scores(docs.limit(0)).count() == 0


def test_hmm_scores_each_row_by_its_own_text(spark):
    rows = [(1, "a b c"), (1, "a b c d"), (None, "a b"), (2, None), (3, "a b c"), (4, "zz"), (4, "zz")] * 3
    got = [hmm.language_model_scores(spark.createDataFrame([(i if i is None or kind == "long" else str(i), t) for i, t in rows], f"doc_id {kind}, text string").repartition(2), passes=2).collect() for kind in ("long", "string")]
    plain = lambda rs: sorted((str(r.doc_id), r.n_tokens, r.held_out, round(r.base_score, 6), round(r.score, 6)) for r in rs)
    assert plain(got[0]) == plain(got[1]) and sorted(r.n_tokens for r in got[0]) == sorted([4, 5, 3, 1, 4, 2, 2] * 3)
    assert len({(r.n_tokens, r.score) for r in got[0]}) == 5 and got[1][0].__getattr__("train_tokens") > 0


def test_forward_recursion_is_the_sum_over_paths():
    rng = np.random.default_rng(6)
    k, s = hmm.STATES, 5
    unit = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    m = hmm.Model(unit(rng.random(k), 0), unit(rng.random((k, k)), 1), unit(rng.random((s, k)), 0))
    symbols, bounds = rng.integers(0, s, 9), np.array([0, 3, 3 + 1, 9])

    def total(seq):
        a = m.start * m.emit[seq[0]]
        for x in seq[1:]:
            a = (a[:, None] * m.move).sum(axis=0) * m.emit[x]
        return np.log10(a.sum())

    want = [total(symbols[a:b]) for a, b in zip(bounds, bounds[1:])]
    for most in (1, 2, 5, 100):  # tokens at once: blocks of long texts change nothing
        assert np.allclose(hmm.log_likelihood(symbols, bounds, m, most), want)


def test_expected_counts_are_those_of_all_paths():
    import itertools

    rng = np.random.default_rng(16)
    k, s, states = 5, 4, hmm.STATES
    unit = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    m = hmm.Model(unit(rng.random(states), 0), unit(rng.random((states, states)), 1), unit(rng.random((s, states)), 0))
    symbols, bounds = rng.integers(0, s, 9), np.array([0, 4, 5, 5 + k - 1])
    symbols = symbols[: bounds[-1]]
    start, move, emit, log = np.zeros(states), np.zeros((states, states)), np.zeros((s, states)), 0.0
    for a, b in zip(bounds, bounds[1:]):
        seq = symbols[a:b]
        paths = list(itertools.product(range(states), repeat=len(seq)))
        chance = np.array([m.start[p[0]] * m.emit[seq[0], p[0]] * np.prod([m.move[x, y] * m.emit[o, y] for x, y, o in zip(p, p[1:], seq[1:])]) for p in paths])
        log += np.log10(chance.sum())
        for p, w in zip(paths, chance / chance.sum()):
            start[p[0]] += w
            for x, y in zip(p, p[1:]):
                move[x, y] += w
            for o, x in zip(seq, p):
                emit[o, x] += w
    for most in (1, 3, 100):
        (got_start, got_move, got_emit), got_log = hmm.expected(symbols, bounds, m, most)
        assert np.allclose(got_start, start) and np.allclose(got_move, move) and np.allclose(got_emit, emit) and got_log == pytest.approx(log)


def test_symbols_without_training_mass_have_a_likelihood():
    tokens = 1e13
    share = np.array([tokens, 0.1, 0.1]) / (tokens + 0.2)
    counts = (np.ones(hmm.STATES), np.ones((hmm.STATES, hmm.STATES)), np.outer([tokens / hmm.STATES, 0, 0], np.ones(hmm.STATES)))
    got = hmm.log_likelihood(np.full(5000, 1), np.array([0, 5000]), hmm.Model.of(counts, share))
    assert np.isfinite(got).all() and -30 * 5000 < got[0] < -10 * 5000


def test_passes_raise_the_likelihood():
    rng = np.random.default_rng(7)
    symbols = np.concatenate([rng.integers(0, 10, 400) if k % 2 else rng.integers(10, 20, 400) for k in range(10)]).astype(np.int32)
    bounds = np.arange(0, 4001, 400)
    share = np.bincount(symbols, minlength=20) / len(symbols)
    model = hmm.Model.first(share)
    last = -np.inf
    for _ in range(8):
        counts, before = hmm.expected(symbols, bounds, model)
        model = hmm.Model.of(counts, share)
        now = hmm.log_likelihood(symbols, bounds, model).sum()
        assert now > max(last, before) - 0.01  # smoothing may cost a little
        last = now
    assert last > len(symbols) * np.log10(1 / 20) * 0.9


def test_training_converges_over_all_texts(spark):
    rng = random.Random(31)
    rows = [(i, sentence(rng, 12)) for i in range(500)]
    rare = [" ".join(f"{'pqrs'[k // 5 % 4]}{rng.randrange(40)}" for k in range(9000)) for _ in range(6)]  # kinds of words in turn, in long texts only
    docs = spark.createDataFrame(rows + [(1000 + i, t) for i, t in enumerate(rare)], "doc_id long, text string").repartition(3).cache()
    a_token = lambda **k: hmm.language_model_scores(docs, **k).where("not held_out").agg(F.sum("score") / F.sum("n_tokens")).first()[0]
    assert a_token() == pytest.approx(a_token(passes=40), abs=0.03)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>"</script></head><body class="has-sidebar"><header><h1>My Site</h1><a href=/>Home</a></header><nav><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></nav>
<div id="cookie-notice"><p>We use cookies to make this site better for you and for all of your friends.</p></div>
<article><h1>The title &amp; more</h1><p>A first  paragraph\nwith <b>bold</b>er words and &eacute;t&#233;, which is long enough to be taken for content.<p>Second one<br>broken.<div class="ad">Buy this now, it is really cheap and good for you, as all of our customers say.</div><p>A last paragraph of the article that ends here.</article>
<div class="comments"><p>I think this is a great article, thank you so much for writing all of it down for us.</p></div><aside><p>Other stories that you may like to read today.</p></aside><form><label>Mail</label><input></form><footer>&copy; me</footer></body></html>"""


def test_main_text():
    want = "The title & more A first paragraph with bolder words and été, which is long enough to be taken for content. Second one broken. A last paragraph of the article that ends here."
    assert mincut.main_text(PAGE) == want
    assert mincut.main_text(PAGE[: PAGE.index("</article>")]) == want
    assert mincut.main_text(None) == mincut.main_text("") == mincut.main_text("<script>x") == ""


def test_dropped_elements_end_where_they_should():
    texts = lambda html: [b.text for b in mincut.blocks(html)[0]]
    for odd in ('<svg class="i"/>', "<svg/>", "<math />", "<svg-icon></svg-icon>", "<svg-icon a=b></svg-icon>", "<object-view>x</object-view>", "<select-menu></select-menu>", "<script-x></script-x>", "<select><!-- -->", "<svg>", "<object data=a>", "<canvas>", "<math>", "</svg>", "<SVG CLASS='a/b' />"):
        assert texts(f"<p>one</p>{odd}<p>two</p>") == (["one", "x", "two"] if ">x<" in odd else ["one", "two"]), odd
    for odd in ("<svg><title>t</title><path d='/'/></svg>", "<select><option>a<option>b</select >", "<object>o</object>", "<canvas>c</canvas>", "<math><mi>x</mi></math>", "<script>s</script>", "<style/>p</style>", "<svg a='/'>z</svg>"):
        assert texts(f"<p>one</p>{odd}<p>two</p>") == ["one", "two"], odd
    assert texts("<p>one</p><script>two") == ["one"]
    assert texts("<select>" * 20000 + "<p>one</p>") == ["one"]


def test_pages(spark):
    df = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (2, None, None), (3, "v", "<p>" * 5000)], "page_id long, url string, html string")
    got = sorted((r.page_id, r.n_chars, len(r.text)) for r in mincut.extract(df).collect())
    assert [g[0] for g in got] == [1, 2, 2, 3] and all(a == b for _, a, b in got) and got[1][1] == 0


def test_tags_end_where_a_quote_is_open():
    texts = lambda html: [b.text for b in mincut.blocks(html)[0]]
    assert texts('<p>one <a href="x>two</a> three</p><p class="q">four</p>') == ["one two three", "four"]
    assert texts("<p>it's <b class='>y</b> z</p><p>w") == ["it's y z", "w"]
    assert texts('<p>a <a title="b > c">d</a></p>') == ["a d"] and texts('<div data-h="<b>q</b>">e</div>') == ["e"] and texts('<p>1 < 2 and <p x="') == ["1 < 2 and"]


def test_compounds_say_what_their_last_word_is():
    long = "A long paragraph of words which is surely the content of this page, as it goes on."
    assert mincut.main_text(f'<div class="share-price-story"><p>{long}</div>') == long
    assert mincut.main_text(f'<div class="article-comments"><p>{long}</div>') == ""


def minimal(excess, edges):
    """The least cost of a cut, by trying all."""
    import itertools

    cost = lambda s: sum(-min(x, 0) if k else max(x, 0) for x, k in zip(excess, s)) + sum(w for i, j, w in edges if s[i] != s[j])
    best = min(map(cost, itertools.product([0, 1], repeat=len(excess))))
    return best, cost


def test_cut_is_minimal():
    rng = random.Random(3)
    for _ in range(150):
        n = rng.randint(1, 9)
        excess = [rng.randint(-9, 9) for _ in range(n)]
        edges = [(rng.randrange(n), rng.randrange(n), rng.randint(0, 4)) for _ in range(2 * n)]
        edges = [(i, j, w) for i, j, w in edges if i != j]
        best, cost = minimal(excess, edges)
        assert cost(mincut.cut(excess, edges)) == best


def small_page(rng):
    region = ["<article>{}</article>", "<div>{}</div>", "<nav>{}</nav>", '<div class="comments">{}</div>', '<p class="byline">{}', "<section>{}</section>"]
    block = lambda: rng.choice(["<p>{}</p>", "<li>{}</li>", "<h2>{}</h2>", "<p><a>{}</a></p>"]).format(sentence(rng, rng.choice([1, 3, 8, 30])) + rng.choice(["", "."]))
    return "".join(rng.choice(region).format("".join(block() for _ in range(rng.randint(1, 3)))) for _ in range(rng.randint(1, 3)))


def test_pages_are_cut_at_least_cost():
    rng = random.Random(41)
    flipped = 0
    for _ in range(120):
        page, regions = mincut.blocks(small_page(rng))
        excess, edges = mincut.graph(page, regions)
        if len(excess) > 13:
            continue
        best, cost = minimal(excess, edges)
        side = mincut.cut(excess, edges)
        assert cost(side) == best
        flipped += sum((x > 0) != k for x, k in zip(excess, side[: len(page)]))
    assert flipped > 10  # the edges decide


def test_classifier_is_fitted_on_pages(spark):
    rng = random.Random(4)
    pages = [(i, f"<nav><ul><li>{sentence(rng, 1)}<li>{sentence(rng, 2)}</ul></nav><article><h1>{sentence(rng, 4)}</h1><p>{sentence(rng, 30)}.</p><p>{sentence(rng, 2)}</p></article><footer>{sentence(rng, 3)}</footer>") for i in range(60)] + [(None, None), (70, "")]
    df = spark.createDataFrame(pages, "page_id long, html string")
    w = dict(zip(mincut.FEATURES, mincut.learn(df)))
    assert w["words_25"] > mincut.WEIGHTS["words_25"] and w["item"] < mincut.WEIGHTS["item"] and w["words_10"] + w["words_25"] + w[""] > 1
    assert (mincut.learn(df.limit(0)) == mincut.PRIOR).all() and (mincut.fit(np.empty((0, len(mincut.PRIOR))), np.empty(0), np.empty(0)) == mincut.PRIOR).all()
    for r in mincut.extract(df, carry=()).collect():
        want = "" if not dict(pages)[r.page_id] else " ".join(re.sub("<[^>]*>", " ", re.search("<article>(.*)</article>", dict(pages)[r.page_id])[1]).split())
        assert r.text == want
