import random

from pyspark.sql import functions as F

import corpus_pipeline as C
from souq.llm.common import numbered_texts
from souq.llm.decontaminate import contaminated, scan
from souq.llm.mixing import word_count
from souq.llm.paragraph_dedup import remove_passages, repeated_passages

from . import brute

SMOKE = "/root/testdata/sf0.01"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet")
    seen = [docs]
    for i, (_, stage) in enumerate(C.STAGES):
        out = stage(spark, seen[-1], SMOKE).cache()
        if i < len(C.STAGES) - 1:
            assert out.columns == docs.columns
        seen.append(out)
    raw, good, near, cut, clean, mixed = seen
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in seen]
    assert ids[1] < ids[0] and ids[2] < ids[1] and ids[3] <= ids[2] and ids[4] <= ids[3] and ids[5] <= ids[4]
    assert len(ids[1]) > 0.75 * len(ids[0])
    # one of each group of the stage's own input stays
    rows = [(r.doc_id, r.text) for r in good.collect()]
    want = {i for i, (_, c) in brute.near_duplicates(rows, 5, 80).items() if i == c}
    assert ids[2] == want
    assert repeated_passages(cut).where("not kept").count() <= 0.02 * repeated_passages(near).where("not kept").count() + 2
    bench = spark.read.parquet(f"{SMOKE}/benchmark.parquet")
    assert scan(clean, bench).where(contaminated()).count() == 0
    assert scan(cut, bench).where(contaminated()).count() == len(ids[3]) - len(ids[4])
    total = clean.select(F.sum(word_count(F.col("text")))).first()[0]
    taken = mixed.select("source", "taken", "target").collect()
    assert all(r.taken > 0 for r in taken) and abs(total - sum(r.taken for r in taken)) <= 40
    for source, target in {r.source: r.target for r in taken}.items():
        assert abs(target - sum(r.taken for r in taken if r.source == source)) <= 1


def test_odd_rows_pass_through(spark, odd):
    for name, stage in C.STAGES:
        out = stage(spark, odd, SMOKE)
        assert out.count() <= odd.count(), name
        if name != "mixing":
            assert out.columns == odd.columns
        else:
            assert set(out.columns) == set(odd.columns) | set(C.ADDED)
    once = C.near_dedup(spark, odd, SMOKE)
    assert sorted(r.doc_id or -1 for r in once.collect()) == [-1, -1, 1, 3, 4, 5, 6, 8, 9]
    assert 0 < C.mixing(spark, odd, SMOKE).count() <= 8  # of the rows with words
    for name, stage in C.STAGES:
        assert stage(spark, odd.limit(0), SMOKE).count() == 0, name


def sentences(seed, n):
    g = random.Random(seed)
    return " ".join("".join(g.choice("abcdefghij") for _ in range(6)) for _ in range(n))


def test_different_texts_of_one_id_are_different_documents(spark):
    a, b, c = sentences(1, 80), sentences(2, 80), sentences(3, 80)
    rows = [(1, a), (5, a), (5, b), (5, None), (7, c), (7, c), (None, a), (None, a)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.text) for r in C.near_dedup(spark, docs, SMOKE).collect()), key=repr)
    assert got == sorted([(1, a), (5, b), (5, None), (7, c), (None, a)], key=repr)
    # an id whose texts lead two groups: each group keeps one
    rows = [(3, a + " more"), (5, a), (5, b), (8, b + " less"), (9, c)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], docs.schema)
    got = {(r.doc_id, r.text) for r in C.near_dedup(spark, docs, SMOKE).collect()}
    assert len(got) == 3 and (3, a + " more") in got and (9, c) in got and len(got & {(5, b), (8, b + " less")}) == 1


def test_passages_are_cut_from_the_text_they_are_in(spark):
    shared, own, other, third = sentences(4, 120), sentences(5, 200), sentences(6, 300), sentences(7, 100)
    rows = [(1, third + " " + shared), (5, own + " " + shared), (5, other), (6, "x")]
    docs = spark.createDataFrame([(i, t, 1, 2.0, "a", "b") for i, t in rows],
                                 "doc_id long, text string, __doc int, __cuts double, __left string, __number string")
    got = {(r.doc_id, r.text.strip()) for r in remove_passages(docs).collect()}
    assert remove_passages(docs).columns == docs.columns
    assert got == {(1, third + " " + shared), (5, own), (5, other), (6, "x")}


def test_numbers_of_texts(spark):
    rows = [(1, "a"), (1, "a"), (2, "b"), (2, "c"), (2, None), (None, "d"), (None, "e"), (3, None)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, __text string")
    out = [(r.doc_id, r.text, r.n) for r in numbered_texts(docs, "n").collect()]
    assert sorted((i, t) for i, t, _ in out if i is not None and t) == sorted((i, t) for i, t in rows if i is not None and t)
    assert all(n == i for i, _, n in out if i != 2) and len({n for i, _, n in out if i == 2}) == 3
    assert all(n > 1 << 61 for i, _, n in out if i == 2)
    assert numbered_texts(docs.limit(0), "n").count() == 0
