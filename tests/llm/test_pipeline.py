"""The pipeline's stages on a small corpus: what each drops and keeps, with odd rows and clashing columns."""

import random

import pytest

import corpus_pipeline
from larkspur.llm.shared import keep

RNG = random.Random(21)
VOCABULARY = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(2, 7))) for _ in range(400)]


def text(n, sep=" "):
    return sep.join(RNG.choice(VOCABULARY) for _ in range(n))


ITEM = text(30)
BASE = text(80)
BLOCK = text(12)
ROWS = [(i, text(70)) for i in range(120)] + [(i, text(70, "### ")) for i in range(200, 320)]
ROWS += [(500, BASE), (501, BASE.replace(BASE.split()[40], "zz", 1)), (502, f"{text(40)}\n{BLOCK}"), (503, f"{text(40)}\n{BLOCK}"), (504, f"{text(30)} {ITEM} {text(30)}"), (505, BLOCK), (600, None), (601, ""), (None, text(50)), (602, text(20_000))]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.25, "x", 7) for i, t in ROWS], "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, n_lines int")
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i < 200), 0) for i, _ in ROWS if i is not None and i < 320], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = keep(stage(spark, docs, corpus), name)
        seen[name] = {r.doc_id: r for r in docs.collect()}
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
            assert all((r.score, r.spans, r.n_lines) == (0.25, "x", 7) for r in seen[name].values())
    quality, lines, near, clean, ids = (seen[n] for n, _ in corpus_pipeline.STAGES)
    assert not any(i is not None and 200 <= i < 320 for i in quality) and set(range(120)) <= set(quality) and {None, 602} <= set(quality)
    assert lines[502].text.endswith(BLOCK) and not lines[503].text.endswith(BLOCK) and lines[503].n_chars == len(lines[503].text)
    assert 505 not in lines and 500 in near and 501 not in near
    assert 504 in near and 504 not in clean and set(range(120)) <= set(clean) and None in clean
    assert set(ids) == set(clean) and ids[500].n_tokens == len(ids[500].ids) > 0
    assert corpus_pipeline.run(spark, corpus).count() == len(ids)


def test_stages_of_empty_tables(spark, corpus, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{corpus}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_is_the_plain_one(spark, corpus):
    """Each stage by a plain version of its operator, one after the other."""
    import base64
    import hashlib
    import re

    import public_tokenizers
    import pyarrow as pa
    import tiktoken
    from pyspark.sql import functions as F

    from larkspur.llm import linedup, quality, textvec

    docs, labels = (spark.read.parquet(f"{corpus}/{t}.parquet") for t in ("documents", "labels"))
    forest = quality.learn(docs.select("doc_id", "text"), labels)
    good = forest.score(quality.statistics(*textvec.buffers(pa.array([t for _, t in ROWS], pa.string())))) >= 0.5
    rows = [r for r, k in zip(ROWS, good) if k]

    lines, left = {i: (t or "").split("\n") for i, t in rows if i is not None}, []
    for i, t in rows:
        gone = set()
        if i is not None and t:
            b = [x for x in lines[i] if x]
            for j, other in lines.items():
                if j < i:
                    gone |= set(linedup.aligned_lines([hash(x) for x in b], [hash(x) for x in other if x], [len(x.encode()) for x in b]))
            t = "\n".join(x for k, x in enumerate(b) if k not in gone) if gone else t
        if not gone or t.strip():
            left.append((i, t))

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets, parent = {i: shingles(t) for i, t in left if i is not None}, {}
    root = lambda i: i if parent.get(i, i) == i else root(parent[i])
    for i in sorted(sets):
        for j in sorted(sets):
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    left = [(i, t) for i, t in left if i is None or root(i) == i]

    norm = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    item = norm(ITEM)
    windows = {tuple(item[k : k + 10]) for k in range(len(item) - 9)}
    left = [(i, t) for i, t in left if not any(tuple(w[k : k + 10]) in windows for w in [norm(t)] for k in range(len(w) - 9))]

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((str(i), len(ids), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in left for ids in [plain.encode_ordinary(t or "")])
    got = corpus_pipeline.run(spark, corpus).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("None")).alias("i"), "n_tokens", "decoded_sha256").collect()
    assert sorted(map(tuple, got)) == want


def test_texts_that_lose_no_line_go_past_the_shuffle(spark):
    from pyspark.sql import functions as F

    from larkspur.llm import bloom, linedup

    shared = "a line that is long enough to be deleted from the later one"
    rows = [(i, f"text number {i} has one line of its own that nobody shares") for i in range(50)] + [(50, shared), (51, f"{shared}\nmore")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    gone = linedup.removed_lines(df)
    loses = linedup._let_through(df, bloom.of_ids(gone, "x"), F.xxhash64("text"))
    assert [r.doc_id for r in df.where(loses).collect()] == [51]
    got = {r.doc_id: (r.text, r.n_removed) for r in linedup.dedup_lines(df).collect()}
    assert got == {**{i: (t, 0) for i, t in rows[:51]}, 51: ("more", 1)}


@pytest.mark.parametrize("full", [False, True])
def test_near_dedup_shuffles_no_text(spark, corpus, monkeypatch, full):
    import numpy as np

    from larkspur.llm import bloom

    rows = [(None, BASE), *((f"d{i}", text(60)) for i in range(40)), *((f"d{i}", BASE) for i in (50, 51, 52)), ("d3", "a row more"), ("d51", text(60))]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    groups = keep(corpus_pipeline.ngramjoin.near_duplicates(docs), "groups")
    goes = {r.doc_id for r in groups.where("component_id <> doc_id").collect()}
    if full:  # a filter that lets all through, and more than may be sent
        monkeypatch.setattr(bloom, "of_ids", lambda *a: np.full(16, -1, np.int64).view(np.uint64))
        monkeypatch.setattr(bloom, "MOST_SENT", 3)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = bloom.without(docs, "doc_id", groups, groups.component_id != groups.doc_id) if full else corpus_pipeline.near_dedup(spark, docs, corpus)
        assert full or "Exchange hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(str, out.collect())) == sorted(str(r) for r in docs.collect() if r.doc_id not in goes) and goes
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
