import numpy as np
import pyarrow as pa

from souq.llm import paragraph_dedup as P
from souq.llm import textops as T

G = np.random.default_rng(11)


def text(n):
    return [f"w{x}" for x in G.integers(0, 5000, n)]


def corpus():
    passage, edited = text(60), text(70)
    near = list(edited)
    near[33] = "other"
    rows = [(i, " ".join(text(int(G.integers(10, 300))))) for i in range(100, 140)]
    for i, p in ((5, passage), (9, passage), (7, passage), (20, edited), (21, near)):
        a, b = text(37), text(int(G.integers(5, 90)))
        gap = "\n" if i >= 20 else " "
        rows.append((i, gap.join([" ".join(a), " ".join(p), " ".join(b)])))
    return rows, passage, edited


def test_embedded_passages_are_found_to_the_word(spark):
    rows, passage, _ = corpus()
    got = P.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    spans = {(r.doc_id, r.first_word, r.n_words, r.component_id, r.kept) for r in got}
    for i in (7, 9):
        assert (i, 37, 60, 5, False) in spans
    assert (5, 37, 60, 5, True) in spans
    assert {r.doc_id for r in got} == {5, 7, 9, 20, 21}
    assert (21, 37, 70, 20, False) in spans


def test_removal_keeps_the_rest(spark):
    rows, passage, _ = corpus()
    df = spark.createDataFrame([(i, t, "en", len(t), None) for i, t in rows],
                               "doc_id long, text string, lang string, n_chars long, _x string")
    left = {r.doc_id: r for r in P.remove_passages(df).collect()}
    before = dict(rows)
    assert set(left) == set(before)
    for i, t in before.items():
        if i in (7, 9):
            w = t.split(" ")
            assert left[i].text == " ".join(w[:37] + w[97:]) and left[i].n_chars == len(left[i].text)
        elif i != 21:
            assert left[i].text == t


def test_exact_copies_go_whole_and_nulls_stay(spark, odd):
    t = " ".join(text(80))
    df = spark.createDataFrame([(1, t), (2, t), (3, t), (3, t), (None, t), (4, None), (5, ""), (6, "short one")],
                               "doc_id long, text string")
    left = P.remove_passages(df).collect()
    assert sorted((r.doc_id or -1, r.text) for r in left if r.text) == [(-1, t), (1, t), (6, "short one")]
    assert len(left) == 5
    assert P.remove_passages(odd).count() == odd.count()
    assert P.repeated_passages(df.limit(0)).count() == 0


def stretch_ids(t):
    out = set()
    for s in T.slices(pa.array([t])):
        w = P._Words(s)
        text_, pos = w.stretches()
        out |= set(P._ids(w, text_, pos, np.full(len(pos), P.SIZE)).tolist())
    return out


def test_every_shared_run_holds_a_stretch():
    for _ in range(30):
        run = text(P.SIZE + P.GAP - 1)
        ids = [stretch_ids(" ".join([*text(a), *run, *text(b)])) for a, b in ((3, 50), (120, 0), (41, 7))]
        assert ids[0] & ids[1] & ids[2]


def test_constant_text_counts_once(spark):
    df = spark.createDataFrame([(1, "a " * 1000)], "doc_id long, text string")
    assert df.mapInArrow(P._places, "doc_id long, pos int, n int, id long, bands array<long>").count() == 2  # a stretch, a line


def test_agreement_crosses_small_edits():
    a = np.arange(30)
    b = np.concatenate([a[:10], [99], a[11:18], a[19:30], [7, 7, 7]])
    assert P.agreement(a, b) == (30, 29)
    assert P.agreement(a, np.arange(100, 130)) == (0, 0) and P.agreement(a[:0], b) == (0, 0)


def test_every_place_of_a_shared_passage_is_found(spark):
    p, a, b, c, d = text(60), text(30), text(100), text(400), text(20)
    line = text(50)
    rows = [(1, " ".join([*a, *p, *d])), (2, " ".join([*b, *p, *c, *p, *d[::-1]])), (3, " ".join([*p, *a[::-1], *p])),
            (4, "\n".join(" ".join(x) for x in (line, text(40), line, line))), (5, "\n".join(" ".join(x) for x in (text(30), line, text(30), line))),
            (6, " ".join(p)), (6, " ".join(p))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.first_word, r.n_words, r.kept) for r in P.repeated_passages(df).collect()}
    assert got == {(1, 30, 60, True), (2, 100, 60, False), (2, 560, 60, False), (3, 0, 60, False), (3, 90, 60, False), (6, 0, 60, False),
                   (4, 0, 50, True), (4, 90, 100, True), (5, 30, 50, False), (5, 110, 50, False)}
    left = {r.doc_id: r.text.split() for r in P.remove_passages(df).collect()}
    assert left[2] == [*b, *c, *d[::-1]] and left[3] == a[::-1]


def test_similar_passages_inside_lines_are_found(spark):
    rows, want = [], set()
    for i in range(0, 80, 2):
        p, before, after = text(60), text(int(G.integers(5, 60))), text(30)
        other = [*p[:30], "edit", *p[30 + i // 2 % 2:]]  # a word more, or another word
        rows += [(i, " ".join([*text(25), *p, *text(40)])), (i + 1, " ".join([*before, *other, *after]))]
        want.add((i + 1, len(before), len(other), i))
    got = P.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).where("not kept").collect()
    assert {(r.doc_id, r.first_word, r.n_words, r.component_id) for r in got} == want


def test_different_words_between_shared_ones_stay(spark):
    short, long = (text(20), text(20)), (text(50), text(60))
    mine, other = (text(20), text(30)), (text(20), text(30))

    def lines(a, m, b):
        return "\n".join(" ".join(x) for x in (a, m, b))
    rows = [(1, lines(short[0], mine[0], short[1])), (2, lines(short[0], other[0], short[1])),
            (3, lines(long[0], mine[1], long[1])), (4, lines(long[0], other[1], long[1]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.first_word, r.n_words, r.component_id, r.kept) for r in P.repeated_passages(df).collect()}
    assert got == {(3, 0, 50, 3, True), (3, 80, 60, 3, True), (4, 0, 50, 3, False), (4, 80, 60, 3, False)}
    left = {r.doc_id: r.text.split() for r in P.remove_passages(df).collect()}
    assert left[2] == [*short[0], *other[0], *short[1]] and left[4] == other[1]


def test_places_and_contexts_are_shuffled_once(spark, monkeypatch):
    """Which places repeat is found where the places meet, and both joins of the contexts read one shuffle."""
    kept, persist = [], P.persist_shared
    monkeypatch.setattr(P, "persist_shared", lambda df: (kept.append(df), persist(df))[1])
    passage = " ".join(f"shared{i}" for i in range(70))
    rows = [(d, f"own{d} text{d} " + passage + f" tail{d}") for d in range(6)] + [(9, " ".join(f"other{i}" for i in range(90)))]
    got = P.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).where("not kept").collect()
    assert sorted((r.doc_id, r.first_word, r.n_words, r.component_id) for r in got) == [(d, 0, 73, 0) for d in range(1, 6)]
    scans = [df for df in kept if "id" in df.columns or "root" in df.columns]
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in scans]
    places = [p for p in plans if "pos:int" in p]  # reads whole places
    assert len(places) == 1 and "Window" in places[0]
    # no other step groups all places by id
    assert not [df for df in kept if df.columns == ["id", "root"]]
    assert not [df for df in kept if "before" in df.columns]
    spans = next(df for df in kept if df.columns == P.WIDE.names)
    spans.collect()
    final = spans._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]
    assert final.count("MapInArrow _contexts") == 1 and "ReusedExchange" in final
