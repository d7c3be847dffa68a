import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from souq.llm import quality as Q
from souq.llm import toxicity as X
from souq.llm.labelled import collect_features

CHECK = "/root/testdata/sf0.1"


def auc(y, s):
    r = pd.Series(s).rank().to_numpy()
    n = (y == 1).sum()
    return (r[y == 1].sum() - n * (n + 1) / 2) / (n * (y == 0).sum())


@pytest.mark.parametrize("query, label, limit, least", [(Q.op6_quality_vote, "quality", 0.7, 0.97), (X.op10_subword_toxicity, "toxic", 0.3, 0.96)])
def test_held_out_accuracy(spark, query, label, limit, least):
    got = query(spark, CHECK).toPandas()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= limit)).all()
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    m = got.merge(pd.read_parquet(f"{CHECK}/labels.parquet"), on="doc_id")
    m = m[m.held_out]
    assert (m.predicted == m[label]).mean() >= least and auc(m[label].to_numpy(), m.score.to_numpy()) >= 0.97


@pytest.mark.parametrize("score, label", [(Q.score_quality, "quality"), (X.score_toxicity, "toxic")])
def test_odd_rows_and_labels(spark, odd, score, label):
    rows = [(1, 1), (1, 0), (6, 0), (None, 1), (9, None), (8, 1), (777, 1), (3, 1), (4, 0), (9, 5)]
    labels = spark.createDataFrame([(*r, "x") for r in rows], f"doc_id long, {label} int, text string")
    got = score(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 2}) == 1
    assert score(odd.limit(0), labels).count() == 0
    assert {r.score for r in score(odd, labels.limit(0)).collect()} == {0.5}


def test_the_sample_is_sent_without_its_zeros(spark, monkeypatch):
    """The driver gets far fewer bytes than the features take, and the same features."""
    rows = [(i, i % 2, f"Some plain words of text {i}, " * (1 + i % 3) if i else "") for i in range(200)]
    sample = spark.createDataFrame(rows, "doc_id long, y int, text string")
    sent, arrow = [], type(sample).toArrow
    monkeypatch.setattr(type(sample), "toArrow", lambda self: sent.append(arrow(self)) or sent[-1])
    x, y = collect_features(sample, Q.features)
    assert (x == Q.features(pa.array([r[2] for r in rows]))).all() and x.dtype == np.float32 and y.tolist() == [r[1] for r in rows]
    assert sent[0].nbytes < x.nbytes / 4


def test_misspelt_words_share_vectors(spark):
    g = np.random.default_rng(2)
    letters = list("abcdefghij")
    words = ["".join(g.choice(letters, 5)) for _ in range(300)]
    rows, labels = [], []
    for i in range(600):
        w = list(g.choice(words, 30))
        if i % 5 == 0:
            w[7] = ["horridness", "horridly", "horrids"][i % 3]
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 5 == 0)))
    probe = [(10_000, " ".join([*g.choice(words, 30), "hhorridest"])), (10_001, " ".join(g.choice(words, 30)))]
    docs = spark.createDataFrame(rows + probe, "doc_id long, text string")
    got = {r.doc_id: r.score for r in X.score_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert got[10_000] > 0.3 > got[10_001]


def test_sample_has_one_row_for_each_id(spark):
    from souq.llm.labelled import labelled_sample
    ids = list(range(1, 41))
    docs = spark.createDataFrame([(i, f"text {i}") for i in ids] + [(i, f"other {j}") for i in ids[:8] for j in range(50)]
                                 + [(i, None) for i in ids], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int")
    sample, counts = labelled_sample(docs, labels, "quality", 1000)
    rows = sample.collect()
    assert len(rows) == len({r.doc_id for r in rows}) == sum(counts.values())
    assert all(r.text and r.y == r.doc_id % 2 for r in rows)
    assert sorted(rows) == sorted(labelled_sample(docs.repartition(3), labels, "quality", 1000)[0].collect())
