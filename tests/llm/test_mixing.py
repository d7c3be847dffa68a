from collections import defaultdict

from souq.llm import mixing as M


def by_source(rows):
    out = defaultdict(list)
    for r in rows:
        out[r.source].append(r)
    return out


def test_targets_are_met_and_bounded(spark, docs):
    for buckets in (20_000, 3):
        rows = M.mix(docs, bucket_rows=buckets).collect()
        total = sum(r.size for r in rows)
        groups = by_source(rows)
        assert abs(sum(g[0].target for g in groups.values()) - total) < 1e-6 * total
        for g in groups.values():
            assert sum(r.taken for r in g) == int(g[0].target)
            assert all(0 <= r.taken <= 3 * r.size for r in g)
            e = g[0].epochs
            assert all(e * r.size <= r.taken <= (e + 1) * r.size for r in g)
    again = {r.doc_id: r.taken for r in M.mix(docs.repartition(7)).collect()}
    assert again == {r.doc_id: r.taken for r in M.mix(docs).collect()}


def test_caps_reshare_the_excess(spark):
    # weights 1, 2, 3 and null last with weight 1: b and c are too small for their shares
    rows = [(i, "a", "w " * 100) for i in range(10)] + [(20, "b", "w " * 10), (21, "c", "w " * 10), (22, None, "w " * 180)]
    got = by_source(M.mix(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect())
    t = {s: g[0].target for s, g in got.items()}
    assert t["b"] == 30 and t["c"] == 30 and abs(t["a"] + t[None] - 1140) < 1e-6
    assert abs(t[None] - 540) < 1e-6  # its own cap, 3 * 180
    assert {r.source: r.epochs for g in got.values() for r in g}["b"] == 3


def test_quality_weight_orders_the_selection(spark):
    rows = [(i, "a", "good words here " * 5) for i in range(300)] + [(1000 + i, "a", "$$ %% && ## @@ !! " * 3) for i in range(300)] \
        + [(5000, "b", "x " * 90_000)]
    got = M.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"),
                weight=spark.createDataFrame([("a", 1.0), ("b", 20.0)], "source string, weight double")).where("source = 'a'").collect()
    share = {k: sum(r.taken for r in got if (r.doc_id >= 1000) == k) / sum(r.size for r in got if (r.doc_id >= 1000) == k)
             for k in (False, True)}
    assert share[False] > 1.5 * share[True]


def test_odd_rows_and_empty(spark, odd):
    rows = M.mix(odd).collect()
    assert len(rows) == odd.count()
    for g in by_source(rows).values():
        assert sum(r.taken for r in g) == int(g[0].target + 1e-9)
    assert M.mix(odd.limit(0)).count() == 0
    none = spark.createDataFrame([(1, "a", None), (2, None, "")], "doc_id long, source string, text string")
    assert sorted((r.size, r.taken, r.target) for r in M.mix(none).collect()) == [(0, 0, 0.0)] * 2
