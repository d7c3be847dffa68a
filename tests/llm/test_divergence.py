"""Operator 11 against a plain Python version in whole numbers."""

import collections
import random
import re

import pytest

from souq.llm import divergence as D

from .brute import lower

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UNIT = 10 ** 9


def brute(rows, min_docs=10, top=10):
    docs = [(lang or "", source or "", TERM.findall(lower(text))) for lang, source, text in rows]
    df = collections.Counter((lang, w) for lang, _, ws in docs for w in set(ws))
    kept = collections.defaultdict(list)
    for (lang, w), n in df.items():
        if n >= min_docs:
            kept[lang].append(w)
    count, whole = collections.Counter(), collections.Counter()
    for lang, source, ws in docs:
        for w in ws:
            count[lang, source, w] += 1
            whole[lang, w] += 1
    groups = collections.defaultdict(set)
    for lang, source, _ in docs:
        groups[lang].add(source)
    out = []

    def ranked(lang, source, part, items, most=None):
        items.sort(key=lambda x: (-x[1], x[0].encode()))
        out.extend((lang, source, part, item, value, r + 1) for r, (item, value) in enumerate(items[:most]))
    for lang, sources in groups.items():
        v, ws = len(kept[lang]), kept[lang]

        def dist(get):
            n = sum(get(w) for w in ws)
            return {w: 1 + UNIT * (get(w) + 2) // (n + 2 * v) for w in ws}
        p = {s: dist(lambda w, s=s: count[lang, s, w]) for s in sources}
        q = dist(lambda w: whole[lang, w])

        def f(x, y):
            return (x - y) ** 2 // (x + y)
        for s in sources:
            ranked(lang, s, "pair", [(o, sum(f(p[s][w], p[o][w]) for w in ws)) for o in sources if o != s])
            ranked(lang, s, "term", [(w, f(p[s][w], q[w])) for w in ws if count[lang, s, w] and p[s][w] > q[w]], top)
    return sorted(out)


def made(seed, n, langs, sources, words):
    g = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in "aZéñß" for b in "bcdeF東"][:words]
    rows = []
    for _ in range(n):
        source = f"s{g.randrange(sources)}" if g.random() > 0.33 else "s0"  # a hot source
        text = " ".join(g.choice(vocabulary) + g.choice(["", ",", "-x", "1"]) for _ in range(g.randrange(40)))
        rows.append((g.choice(langs), source, text))
    return rows


ODD = [(None, None, None), (None, "a", "x y z"), ("", "b", "x"), ("en", None, "word " * 30_000), ("en", "only", ""), ("de", "alone", " 12 \n "),
       ("fr", "p", "un deux"), ("fr", "q", None), ("fr", "q", None)]


@pytest.mark.parametrize("group_block, term_block", [(32, 4096), (2, 3), (1, 1)])
def test_every_cut_of_the_cube_gives_the_same_audit(spark, group_block, term_block):
    rows = made(3, 300, ["en", "de"], 7, 30) + ODD
    df = spark.createDataFrame([(*r, 5, 1, "k", 2) for r in rows],
                               "lang string, source string, text string, n long, rank int, part string, value int").repartition(4)
    got = sorted(map(tuple, D.audit(df, group_block=group_block, term_block=term_block).collect()))
    assert got == brute(rows)
    assert any(r[2] == "term" for r in got) and ("fr", "p", "pair", "q", 0, 1) in got


def test_all_terms_kept_and_empty_table(spark):
    rows = [(lang, s, t) for lang, s, t in made(9, 60, ["x"], 3, 12)] + ODD
    schema = "lang string, source string, text string"
    got = D.audit(spark.createDataFrame(rows, schema), min_docs=1, top=2, term_block=5).collect()
    assert sorted(map(tuple, got)) == brute(rows, 1, 2)
    assert D.audit(spark.createDataFrame([], schema)).count() == 0
