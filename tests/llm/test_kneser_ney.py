import collections
import math
import os
import zlib

import numpy as np
import pytest

from souq.llm import kneser_ney as K

from . import brute


def model(texts):
    """The same model from plain counts."""
    uni, bi = collections.Counter(), collections.Counter()
    for t in texts:
        w = [*brute.SPACED.findall(brute.lower(t)), "</s>"]
        uni.update(w)
        bi.update(zip(["<s>", *w[:-1]], w))
    cont, total, follow = collections.Counter(w for _, w in bi), collections.Counter(), collections.defaultdict(lambda: [0, 0, 0])
    for (v, _), c in bi.items():
        total[v] += c
        follow[v][min(c, 3) - 1] += 1

    def disc(values):
        n = collections.Counter(values)
        return K.discounts(n[1], n[2], n[3], n[4])
    d2, d1 = disc(bi.values()), disc(cont.values())
    low = sum(d1[min(c, 3) - 1] for c in cont.values()) / len(bi) / (len(uni) + 1)

    def p(v, w):
        c = cont[w]
        one = (c - d1[min(c, 3) - 1] if c else 0) / len(bi) + low
        if not total[v]:
            return one
        c = bi[v, w]
        return ((c - d2[min(c, 3) - 1] if c else 0) + sum(a * b for a, b in zip(d2, follow[v])) * one) / total[v]
    return uni, p


@pytest.mark.parametrize("shards", [1, 8])
def test_scores_match_plain_counts(spark, docs, pdocs, shards):
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in pdocs.doc_id}
    uni, p = model([t for i, t in zip(pdocs.doc_id, pdocs.text) if not held[i]])
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", shards)
        got = {r.doc_id: r for r in K.lm_scores(docs).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    n, v = sum(uni.values()), len(uni)
    for i, t in zip(pdocs.doc_id, pdocs.text):
        w = [*brute.SPACED.findall(brute.lower(t)), "</s>"]
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(w), sum(x in uni for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((uni[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), rel_tol=1e-9)
        assert math.isclose(r.score, sum(math.log10(p(a, b)) for a, b in zip(["<s>", *w[:-1]], w)), rel_tol=1e-9)
    assert sum(r.score for r in got.values() if r.held_out) > sum(r.base_score for r in got.values() if r.held_out)
    assert abs(sum(p("the", x) for x in [*uni, "<unknown>"]) - 1) < 1e-9


def test_odd_rows(spark, odd):
    got = sorted((r.doc_id or -1, r.n_tokens, r.n_known) for r in K.lm_scores(odd).collect())
    assert len(got) == odd.count() and (3, 1, 1) in got and (4, 1, 1) in got
    assert K.lm_scores(odd.limit(0)).count() == 0
    one = spark.createDataFrame([(2, "only held out")], "doc_id long, text string")
    assert zlib.crc32(b"2") % 5 != 1 or K.lm_scores(one).first().n_known == 0


def test_nothing_to_train_on_is_uniform(spark):
    i = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    r = K.lm_scores(spark.createDataFrame([(i, "a b")], "doc_id long, text string")).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.score) == (3, 0, 0, 0.0)


def test_packing_round_trips():
    g = np.random.default_rng(0)
    k = np.unique(g.integers(0, 2 ** 64, 1000, dtype=np.uint64))
    assert (K.unpack(K.pack(k), np.uint64) == k).all()
    c = g.integers(0, 2 ** 32, 1000).astype(np.uint32)
    assert (K.unplanes(K.planes(c)) == c).all()
    assert len(K.unpack(b"", np.uint64)) == 0


def test_counts_beyond_a_byte(spark):
    docs = spark.createDataFrame([(i, "yes yes yes no") for i in range(400)], "doc_id long, text string")
    m = K.train(docs, 3)
    yes, no = (int(m.number(K.word_hashes(s, *K.word_bounds(s)[:2]))[0])
               for t in ("yes", "no") for s in K.slices(K.pa.array([t])))
    assert m.pair_counts(np.array([yes, yes, no]), np.array([yes, no, no])).tolist() == [800, 400, 0]
    assert os.path.isdir(m.path)
