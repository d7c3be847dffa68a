import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from souq.llm import textops as T

from . import brute


def words_of(texts):
    out = []
    for s in T.slices(pa.array(texts, pa.string())):
        starts, ends, first = T.word_bounds(s)
        h = T.word_hashes(s, starts, ends)
        for i in range(s.n):
            a, b = first[i], first[i + 1]
            out.append(([bytes(T.LOWER[s.data[x:y]]).decode() for x, y in zip(starts[a:b], ends[a:b])], h[a:b].tolist()))
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbB \n\té東|", max_size=30)), max_size=8))
def test_words_match_the_regex(texts):
    seen = {}
    for t, (words, hashes) in zip(texts, words_of(texts)):
        assert words == brute.SPACED.findall(brute.lower(t))
        for w, h in zip(words, hashes):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_slices_cut_between_texts(monkeypatch):
    monkeypatch.setattr(T, "SLICE_BYTES", 10)
    texts = ["abc def ghi jkl mno", "", None, "x y", "z"]
    assert [w for w, _ in words_of(texts)] == [brute.SPACED.findall(t or "") for t in texts]


def test_shingles_tell_order_and_length_apart():
    texts = ["a b c d", "b a c d", "a b", "b a", "a", "a a", "", "a b c"]
    got = []
    for s in T.slices(pa.array(texts)):
        h, at = T.shingle_hashes(T.word_hashes(s, *T.word_bounds(s)[:2]), T.word_bounds(s)[2], 3)
        got += [tuple(h[at[i]:at[i + 1]].tolist()) for i in range(s.n)]
    assert [len(g) for g in got] == [2, 2, 1, 1, 1, 1, 0, 1]
    assert len({x for g in got for x in g}) == 8 and got[0][0] == got[7][0]
