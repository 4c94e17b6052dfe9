"""Dealing to buckets, Bloom filters and vectorised n-grams."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from larkspur.llm import bloom, exchange, substring, textvec


def test_every_bucket_is_a_partition_of_its_own(spark):
    for n in (1, 7, 51):
        keys = exchange.keys(n).tolist()
        df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "bucket int, i int")
        got = {r.i: r.p for r in exchange.to_buckets(df, n).select("i", F.spark_partition_id().alias("p")).collect()}
        assert got == {i: i for i in range(n)}


def test_deal_keeps_the_order_within_buckets():
    v = textvec.mix(np.arange(1000, dtype=np.uint64))
    order, cut = exchange.deal(v, 9)
    assert sorted(order.tolist()) == list(range(1000)) and cut[-1] == 1000
    for k in range(9):
        part = order[cut[k] : cut[k + 1]]
        assert (np.diff(part) > 0).all() and ((v[part] >> np.uint64(32)) % np.uint64(9) == k).all()


def test_bloom_has_no_false_negatives(spark):
    df = spark.createDataFrame([(i * 7919,) for i in range(500)] + [(None,)], "id long")
    words = bloom.of_ids(df, "id", 1 << 14)
    assert bloom.has(words, np.arange(500) * 7919).all()
    assert bloom.has(words, np.arange(1, 5000) * 7919 + 1).mean() < 0.05
    assert bloom.only(spark.range(0, 500 * 7919, 7919), words, "id").count() == 500


def test_grams_stay_within_a_text():
    data, at = textvec.buffers(pa.array(["a b c d", "", "b c", "x"]))
    p = textvec.pieces(data, at)
    g, first = textvec.grams_within(p, 2)
    assert first.tolist() == [0, 1, 2, 4] and g[1] == g[3] and len(set(g.tolist())) == 3


def test_every_window_has_an_anchor_of_its_content():
    rng = np.random.default_rng(2)
    words = [" ".join(rng.choice(list("abcdef"), 40)) for _ in range(20)]
    data, at = textvec.buffers(pa.array(words))
    p = textvec.pieces(data, at)
    w, start, anchor = substring.anchored(p, 13, 7)
    assert len(w) == 20 * 28
    by = {}
    for h, a in zip(w.tolist(), anchor.tolist()):
        assert by.setdefault(h, a) == a


def test_maximal_repeats():
    assert substring.maximal_repeats(np.array([3, 4, 5, 30, 17]), 13) == [(3, 43)]
    assert substring.maximal_repeats(np.array([3, 40]), 13) == [(3, 16), (40, 53)]
    assert substring.maximal_repeats(np.array([], int), 13) == []


def test_statistics_of_long_and_odd_texts():
    from larkspur.llm import quality

    texts = [None, "", " ", "x" * 3_000_000, "a b a b", "#"]
    x = quality.statistics(*textvec.buffers(pa.array(texts, pa.string())))
    assert x.shape[0] == 6 and np.isfinite(x).all() and (x[0] == x[1]).all()


def test_a_worker_forgets_what_other_operators_remembered():
    from larkspur.llm import textvec
    from larkspur.llm.arrowmap import _remembered, remembered, tidied

    def task(operator):
        def run(batches):
            for b in batches:
                textvec.powers(3, b)
                if operator:
                    remembered(operator)[b] = b
                yield b

        return list(tidied(run, operator)(iter([1, 2])))

    assert task("bpe") == [1, 2] and _remembered == {"bpe": {1: 1, 2: 2}}
    assert task("bpe") == [1, 2] and set(_remembered) == {"bpe"}
    assert task("") == [1, 2] and _remembered == {}
    assert textvec.powers(3, 4).tolist() == [1, 3, 9, 27]
