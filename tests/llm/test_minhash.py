import numpy as np
import pytest

from souq.llm import components, lsh
from souq.llm import minhash_dedup as M

from . import brute


def test_smoke_table_matches_brute_force(spark, pdocs):
    want = brute.near_duplicates(list(zip(pdocs.doc_id, pdocs.text)), 3, 85)
    got = M.op8_minhash_dedup(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == len(pdocs)


@pytest.mark.parametrize("limits", [{}, {"group_rows": 2, "chunk_shingles": 150}])
def test_a_star_of_near_copies_is_linked_exactly(spark, limits):
    """Copies of one text with more or fewer edits: many pairs lie on either side of the threshold."""
    g = np.random.default_rng(3)
    base = [f"w{i}" for i in range(80)]
    docs = []
    for i in range(60):
        w = list(base)
        for p in g.choice(80, int(g.integers(0, 7)), replace=False):
            w[p] = f"x{i}y{p}"
        docs.append((i, " ".join(w)))
    want = brute.near_duplicates(docs, 3, 85)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in M.near_duplicates(df, 3, 85, **limits).collect()}
    assert got == want


def test_odd_rows(odd):
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1, r.kept) for r in M.near_duplicates(odd, 3, 85).collect())
    want = [(-1, 0, -1, True), (-1, 3, -1, True), (1, 17, 1, True), (2, 17, 1, False), (2, 17, 1, False), (3, 0, 3, True),
            (4, 0, 4, True), (5, 0, 5, True), (6, 1, 6, True), (7, 1, 6, False), (8, 1, 8, True), (9, 4, 9, True)]
    assert got == want


def test_empty_table(odd):
    assert M.near_duplicates(odd.limit(0)).count() == 0


def test_banding_keeps_its_promise():
    for s in (0.8, 0.85, 0.95):
        b, r = lsh.tune(s)
        assert (1 - s ** r) ** b <= 1e-6 and b * r <= 160


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(40)]
    star = [(100, 200 + i) for i in range(50)]
    e = spark.createDataFrame(path + star + [(7, 7), (3, 2), (None, 5)], "a long, b long")
    got = {r.node: r.root for r in components.connected_components(e).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100} | {200 + i: 100 for i in range(50)}
    assert components.connected_components(e.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_components_match_a_union(spark, seed):
    """Sparse random edges (long paths, hubs, cycles), with repeats, loops, both directions and null ends."""
    g = np.random.default_rng(seed)
    pairs = [tuple(map(int, p)) for p in g.integers(0, 60, (45, 2))] + [(100, 100 + i) for i in range(1, 9)]
    pairs += [(b, a) for a, b in pairs[:10]] + pairs[:5] + [(7, 7)]
    label = {n: n for p in pairs for n in p}
    for a, b in pairs * len(pairs):
        label[a] = label[b] = min(label[a], label[b])
    linked = {n for a, b in pairs if a != b for n in (a, b)}
    e = spark.createDataFrame([*pairs, (None, 3), (4, None)], "a long, b long")
    got = [tuple(r) for r in components.connected_components(e).collect()]
    assert sorted(got) == sorted((n, label[n]) for n in linked)


def test_edges_that_are_stars_take_no_round(spark, monkeypatch):
    """Each round deals the edges out five times; one more round to see that nothing changes is not needed."""
    kept = []
    persist = components.persist_shared
    monkeypatch.setattr(components, "persist_shared", lambda df: kept.append(1) or persist(df))
    e = spark.createDataFrame([(1, 2), (3, 1), (1, 4), (8, 9)], "a long, b long")
    got = {r.node: r.root for r in components.connected_components(e).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8} and len(kept) == 1
