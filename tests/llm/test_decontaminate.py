from souq.llm import decontaminate as D

BENCH = [(1, "The CAT sat on the mat and then it ran off to sea"), (2, "alpha BETA"), (3, None), (4, ""), (None, "two"),
         (6, "solo"), (10, "cat sat on the mat and then it ran off to sea again"), (11, "one two three")]
DOCS = [(1, "the cat sat on the mat and then it ran off to sea again and home"), (2, None), (3, ""), (None, "Alpha beta"),
        (5, "x ALPHA, beta! y"), (5, "x ALPHA, beta! y"), (7, "one two three one two three"), (8, "zz " * 50 + "solo end")]


def frames(spark):
    return (spark.createDataFrame([(*r, 1, "w") for r in DOCS], "doc_id long, text string, length int, items string"),
            spark.createDataFrame([(*r, 2) for r in BENCH], "item_id long, text string, doc_id int"))


def test_hits_by_hand(spark):
    d, b = frames(spark)
    got = sorted((r.doc_id or -1, r.n_words, r.n_hit, r["items"], [tuple(s) for s in r.spans]) for r in D.scan(d, b).collect())
    assert got == [
        (-1, 2, 2, ["2"], [(0, 2)]), (1, 16, 14, ["1", "10"], [(0, 14)]), (2, 0, 0, [], []), (3, 0, 0, [], []),
        (5, 4, 2, ["2"], [(1, 3)]), (5, 4, 2, ["2"], [(1, 3)]), (7, 6, 6, ["11"], [(0, 6)]), (8, 52, 1, ["6"], [(50, 51)])]


def test_removal_of_documents_and_spans(spark):
    d, b = frames(spark)
    kept = D.remove_documents(d, b)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 8]
    cut = {r.doc_id: r.text for r in D.remove_spans(d, b).collect()}
    assert cut[1] == "and home" and cut[5] == "x y" and cut[2] is None and cut[8] == "zz " * 50 + "end"


def test_shuffled_join_gives_the_same(spark, monkeypatch):
    d, b = frames(spark)
    want = sorted(map(str, D.scan(d, b).collect()))
    monkeypatch.setattr(D, "BROADCAST_WINDOWS", 0)
    assert sorted(map(str, D.scan(d, b).collect())) == want


def test_empty_tables(spark, odd):
    d, b = frames(spark)
    assert D.scan(d.limit(0), b).count() == 0
    none = D.scan(odd, b.limit(0)).collect()
    assert len(none) == odd.count() and all(r.n_hit == 0 for r in none)


def test_no_python_in_the_plan(spark):
    plan = D.op1_decontaminate(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastHashJoin" in plan
