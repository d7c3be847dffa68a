"""Substring dedup by paragraph MinHash banding (operator 9).

Two kinds of paragraphs are taken from a text.  Its lines: they are banded by
MinHash over five-word shingles, colliding ones are joined and verified by
exact Jaccard similarity.  And, since a repeated passage may stand in the
middle of a line, stretches of ``SIZE`` words that begin where the content
says so (the smallest shingle hash of every ``GAP`` positions): two texts that
share ``SIZE + GAP - 1`` = 22 words in a row share such a stretch.  That covers
the passages that are similar but not equal: a place where two passages differ
takes at least 9 of their five-word shingles together, so at similarity 0.8
their common runs hold at least 36 shingles for every such place, and the
longest run has 18 shingles, which are 22 words.

Equal or similar paragraphs form components.  In every component the
occurrence in the smallest document stays.  Consecutive paragraphs that repeat
the same document at the same distance are one chain.  The words between its
paragraphs and on either side of it are compared word by word, across small
edits, with the one that stays: a chain is widened as far as they agree, and
split where they do not.
The resulting spans are the removals.

Scale: the texts are read once for the paragraphs, which are written as narrow
rows (document, place, id, bands); only documents with repetitions are read
again.  Buckets are reduced to a minimum and maximum map-side, so a passage on
a third of all documents costs one row per task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import (checked_broadcast, fresh_names, numbered_texts, persist_shared, small_batches, table,
                     write_shared)
from .components import connected_components
from .lsh import band_hashes, exact_links, hash_family
from .textops import Slice, fmix, shingle_hashes, slices, to_batch, word_bounds, word_hashes

U = np.uint64
WORDS = 5          # words of a shingle
LINE = 16          # words of the shortest line taken
SIZE = 10          # words of a stretch
GAP = 13           # positions of which one begins a stretch
REACH = 34         # words between two paragraphs of one chain, at most
BANDS, ROWS = 6, 3  # finds 98 % of lines at similarity 0.8 and more above; a line's neighbours widen into it
LEAST = 40         # words of a repeated passage that is reported
AROUND = 64        # words on either side of a chain of paragraphs that are compared with the one that stays


def _anchors(hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Positions (in the concatenation) of the smallest hash of every GAP positions of a text, or
    of all its positions if it has fewer; the first of equal ones.  ``n``: positions per text."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    low = U((1 << max(24, len(hashes).bit_length())) - 1)
    packed = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    first = np.cumsum(n) - n
    few = (n > 0) & (n < GAP)
    out = [np.minimum.reduceat(packed, first[n > 0])[few[n > 0]]]
    if len(packed) >= GAP:
        m, width = packed, 1
        while width * 2 <= GAP:
            m = np.minimum(m[:-width], m[width:])
            width *= 2
        m = np.minimum(m[:len(packed) - GAP + 1], m[GAP - width:])
        text = np.repeat(np.arange(len(n)), n)
        out.append(m[text[:len(m)] == text[GAP - 1:]])
    return np.unique((np.concatenate(out) & low).astype(np.int64))


class _Words:
    """The words of a slice of texts, its shingles, and its paragraphs by place."""

    def __init__(self, s: Slice):
        self.first_text, self.n = s.first, s.n
        starts, ends, self.first = word_bounds(s)
        self.words = word_hashes(s, starts, ends)
        self.shingles, self.at = shingle_hashes(self.words, self.first, WORDS)
        self.newlines = np.cumsum(s.data == 0x0A)[starts] if len(starts) else np.zeros(0, np.int64)
        # a word's text and place, and the shingle that begins with it
        self.text = np.repeat(np.arange(s.n), np.diff(self.first))
        self.pos = np.arange(len(self.words)) - self.first[self.text]

    def stretches(self) -> tuple[np.ndarray, np.ndarray]:
        """Text and first word of the stretches placed by content."""
        n = np.maximum(np.diff(self.first) - SIZE + 1, 0)
        text = np.repeat(np.arange(self.n), n)
        pos = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
        a = _anchors(self.shingles[self.at[text] + pos], n)
        return text[a], pos[a]

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, first word and number of words of the lines of at least LINE words."""
        if not len(self.words):
            return (np.zeros(0, np.int64),) * 3
        new = np.ones(len(self.words), bool)
        new[1:] = (self.newlines[1:] != self.newlines[:-1]) | (self.text[1:] != self.text[:-1])
        begin = np.flatnonzero(new)
        n = np.diff(np.append(begin, len(self.words)))
        begin, n = begin[n >= LINE], n[n >= LINE]
        return self.text[begin], self.pos[begin], n

    def runs(self, text: np.ndarray, pos: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the shingles of each paragraph, one after the other, and where each begins."""
        count = n - WORDS + 1
        begin = np.cumsum(count) - count
        return np.repeat(self.at[text] + pos - begin, count) + np.arange(int(count.sum())), begin


def _ids(w: _Words, text: np.ndarray, pos: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Hash of the words of each paragraph in their order."""
    if not len(text):
        return np.zeros(0, np.int64)
    index, begin = w.runs(text, pos, n)
    order = np.arange(len(index)) - np.repeat(begin, n - WORDS + 1)
    h = fmix(w.shingles[index] + order.astype(np.uint64) * U(0x9E3779B97F4A7C15))
    return fmix(np.add.reduceat(h, begin) + n.astype(np.uint64)).view(np.int64)


def _runs_of_equal(w: _Words, text: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word, number of words and id of the stretches; equal ones that overlap, as in
    constant text, are one that covers them all."""
    ids = _ids(w, text, pos, np.full(len(text), SIZE))
    order = np.lexsort((pos, ids, text))
    text, pos, ids = text[order], pos[order], ids[order]
    new = np.ones(len(ids), bool)
    new[1:] = (text[1:] != text[:-1]) | (ids[1:] != ids[:-1]) | (pos[1:] >= pos[:-1] + SIZE)
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(ids))[:len(begin)] - 1
    return text[begin], pos[begin], pos[last] + SIZE - pos[begin], ids[begin]


def _banded(w: _Words, text: np.ndarray, pos: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The buckets of each paragraph, a row each."""
    if not len(text):
        return np.zeros((0, BANDS), np.int64)
    a, b = hash_family(BANDS * ROWS)
    index, begin = w.runs(text, pos, n)
    h = w.shingles[index]
    sig = np.empty((len(text), len(a)), np.uint32)
    for k in range(len(a)):
        sig[:, k] = (np.minimum.reduceat(h * a[k] + b[k], begin) >> U(32)).astype(np.uint32)
    return band_hashes(sig, BANDS, ROWS)


PLACES = pa.schema([("doc_id", pa.int64()), ("pos", pa.int32()), ("n", pa.int32()), ("id", pa.int64()), ("bands", pa.list_(pa.int64()))])


def _places(batches):
    for b in batches:
        doc = b.column("doc_id").to_numpy()
        for s in slices(b.column("text")):
            w = _Words(s)
            text, pos, n = w.lines()
            ids = _ids(w, text, pos, n)
            # the bands of a line that a text repeats stand at its first place
            _, once = np.unique(np.stack([text, ids]), axis=1, return_index=True)
            once = np.sort(once)
            bands = _banded(w, text[once], pos[once], n[once])
            count = np.zeros(len(ids), np.int64)
            count[once] = BANDS
            other, at, size, other_ids = _runs_of_equal(w, *w.stretches())
            ends = np.concatenate(([0], np.cumsum(np.concatenate([count, np.zeros(len(other), np.int64)]))))
            lists = pa.ListArray.from_arrays(ends.astype(np.int32), bands.ravel())
            text, pos, n = np.concatenate([text, other]), np.concatenate([pos, at]), np.concatenate([n, size])
            yield to_batch(PLACES, [doc[w.first_text + text], pos.astype(np.int32), n.astype(np.int32), np.concatenate([ids, other_ids]), lists])


def _line_sets(batches):
    for b in batches:
        for s in slices(b.column("text")):
            w = _Words(s)
            text, pos, n = w.lines()
            index, begin = w.runs(text, pos, n)
            sets = [np.unique(x).tobytes() for x in np.split(w.shingles[index], begin[1:])] if len(text) else []
            yield pa.RecordBatch.from_arrays([pa.array(_ids(w, text, pos, n), pa.int64()), pa.array(sets, pa.binary())], ["id", "set"])


CONTEXT = pa.schema([("doc_id", pa.int64()), ("first", pa.int32()), ("end", pa.int32()), ("key", pa.int64()),
                     ("before", pa.binary()), ("after", pa.binary()), ("inside", pa.binary())])
CONTEXT_DDL = "doc_id long, first int, end int, key long, before binary, after binary, inside binary"


def _contexts(batches):
    """The hashes of the words before (nearest first), after, and in the gaps of each wanted chain."""
    for b in batches:
        doc, wanted = b.column("doc_id").to_numpy(), b.column("at").to_pylist()
        rows: list[list] = [[] for _ in CONTEXT]
        for s in slices(b.column("text")):
            starts, ends, first = word_bounds(s)
            w = word_hashes(s, starts, ends)
            for i in range(s.n):
                mine = w[first[i]:first[i + 1]]
                for x in wanted[s.first + i]:
                    if x["end"] <= len(mine):  # else another text of the same id has it
                        before = mine[max(0, x["first"] - AROUND):x["first"]][::-1]
                        inside = b"".join(mine[g["first"]:g["end"]].tobytes() for g in x["gaps"])
                        for c, v in zip(rows, (doc[s.first + i], x["first"], x["end"], x["key"], before.tobytes(),
                                               mine[x["end"]:x["end"] + AROUND].tobytes(), inside)):
                            c.append(v)
        yield to_batch(CONTEXT, rows)


#: edits that an agreement may cross (words passed on either side), if then five words agree
_EDITS = ((1, 1), (1, 0), (0, 1), (2, 2), (2, 1), (1, 2), (2, 0), (0, 2), (3, 3))


def agreement(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """How many words of a and of b agree from their beginnings, across small edits."""
    i = j = 0
    while True:
        n = min(len(a) - i, len(b) - j)
        same = a[i:i + n] == b[j:j + n]
        run = n if same.all() else int(same.argmin())
        i, j = i + run, j + run
        for x, y in _EDITS:
            u, v = a[i + x:i + x + 5], b[j + y:j + y + 5]
            if len(u) == 5 and len(v) == 5 and (u == v).all():
                i, j = i + x, j + y
                break
        else:
            return i, j


WIDE = pa.schema([("doc_id", pa.int64()), ("first", pa.int32()), ("end", pa.int32()),
                  ("keeper", pa.int64()), ("k_first", pa.int32()), ("k_end", pa.int32())])
WIDE_DDL = "doc_id long, first int, end int, keeper long, k_first int, k_end int"


def _agreeing(r: dict):
    """The parts of a chain that agree with the one that stays: first word and end of each in both."""
    words = {c: np.frombuffer(r[c], np.uint64) for c in ("before", "k_before", "after", "k_after", "inside", "k_inside")}
    x, kx = agreement(words["before"], words["k_before"])
    first, k_first, i, j = r["first"] - x, r["k_first"] - kx, 0, 0
    for g, k in zip(r["gaps"], r["k_gaps"]):
        n, kn = g["end"] - g["first"], k["end"] - k["first"]
        a, b = words["inside"][i:i + n], words["k_inside"][j:j + kn]
        i, j = i + n, j + kn
        x, kx = agreement(a, b)
        if x < n:
            y, ky = agreement(a[x:][::-1], b[kx:][::-1])
            yield first, g["first"] + x, k_first, k["first"] + kx
            first, k_first = g["end"] - y, k["end"] - ky
    x, kx = agreement(words["after"], words["k_after"])
    yield first, r["end"] + x, k_first, r["k_end"] + kx


def _widened(batches):
    for b in batches:
        out: list[list] = [[] for _ in WIDE]
        for r in b.to_pylist():
            for first, end, k_first, k_end in _agreeing(r):
                for c, v in zip(out, (r["doc_id"], first, end, r["keeper"], k_first, k_end)):
                    c.append(v)
        yield to_batch(WIDE, out)


def _similar(docs: DataFrame, units: DataFrame, percent: int, chunk_shingles: int) -> DataFrame:
    """(id, root) of lines that are similar, but not equal, to another: banding, then exact Jaccard."""
    band = units.where(F.size("bands") > 0).select(F.explode("bands").alias("bucket"), "id", "doc_id", "n")
    # buckets with different lines of different documents
    near = persist_shared(band.groupBy("bucket").agg(F.min("id").alias("leader"), F.max("id").alias("hi"),
                                                     F.min("doc_id").alias("d"), F.max("doc_id").alias("e"))
                          .where("leader <> hi and d <> e").select("bucket", "leader"))
    members = persist_shared(band.select("bucket", "id", "n").join(checked_broadcast(near), "bucket")
                             .select("leader", "id", "n").distinct())

    def fetch(ids: DataFrame) -> DataFrame:
        ids = persist_shared(ids)
        few = checked_broadcast(ids)
        source = persist_shared(units.select("id", "doc_id").join(few, "id").groupBy("id").agg(F.min("doc_id").alias("doc_id"))
                                .select("doc_id").distinct())
        return docs.join(checked_broadcast(source), "doc_id", "left_semi").mapInArrow(_line_sets, "id long, set binary") \
            .join(few, "id", "left_semi").groupBy("id").agg(F.any_value("set").alias("set"))

    return connected_components(exact_links(members, fetch, percent, chunk_shingles)).select(F.col("node").alias("id"), "root")


def repeated_passages(docs: DataFrame, percent: int = 80, least: int = LEAST, bridge: int = 5,
                      chunk_shingles: int = 200_000) -> DataFrame:
    """Passages of at least ``least`` words that repeat across documents.

    ``docs`` has doc_id and text; other columns are ignored.  Returns one row
    per place of a passage: doc_id, first_word (from 0), n_words,
    component_id (the smallest document that shares the passage), kept (this is
    the occurrence that stays).  Passages of a document that are at most
    ``bridge`` words apart are one; the rows with kept = false are the
    removals.

    Defined cases: null and empty texts and texts of fewer than SIZE words
    have no passages; rows without doc_id take no part; a repeated row is the
    same document and no repetition across documents; with different texts
    under one id, places in either are found; ties of equal paragraphs stay in
    the smallest document, at its first place; an empty table gives an empty
    result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    units = write_shared(docs.mapInArrow(_places, "doc_id long, pos int, n int, id long, bands array<long>"), "paragraphs")
    similar = _similar(docs, units, percent, chunk_shingles)
    # paragraphs of several documents are found where their places meet, so every place is sent once
    same = Window.partitionBy("id")
    where = persist_shared(units.select("doc_id", "pos", "n", "id")
                           .withColumn("d", F.min("doc_id").over(same)).withColumn("e", F.max("doc_id").over(same))
                           .join(similar, "id", "left").where("d <> e or root is not null")
                           .select("doc_id", "pos", "n", F.coalesce("root", "id").alias("root")).distinct())
    keeper = where.groupBy("root").agg(F.min(F.struct("doc_id", "pos", "n")).alias("k"), F.max("doc_id").alias("hi")) \
        .where("k.doc_id <> hi").select("root", F.col("k.doc_id").alias("keeper"), F.col("k.pos").alias("k_pos"), F.col("k.n").alias("k_n"))
    # chains: paragraphs of a document, in order, that repeat the same one at the same distance
    near = Window.partitionBy("doc_id", "keeper", "shift").orderBy("pos", "n")
    before = near.rowsBetween(Window.unboundedPreceding, -1)
    # words of a chain between its paragraphs, here and in the one that stays
    gap = F.struct(F.col("reach").alias("first"), F.col("pos").alias("end"),
                   F.least("k_reach", "k_pos").alias("k_first"), F.col("k_pos").alias("k_end"))
    chains = where.join(keeper, "root").where("doc_id <> keeper or pos <> k_pos").withColumn("shift", F.col("k_pos") - F.col("pos")) \
        .withColumn("reach", F.max(F.col("pos") + F.col("n")).over(before)) \
        .withColumn("k_reach", F.max(F.col("k_pos") + F.col("k_n")).over(before)) \
        .withColumn("new", F.coalesce(F.col("pos") > F.col("reach") + REACH, F.lit(True)).cast("int")) \
        .withColumn("chain", F.sum("new").over(near)).groupBy("doc_id", "keeper", "shift", "chain") \
        .agg(F.min("pos").alias("first"), F.max(F.col("pos") + F.col("n")).alias("end"),
             F.min("k_pos").alias("k_first"), F.max(F.col("k_pos") + F.col("k_n")).alias("k_end"),
             F.sort_array(F.collect_list(F.when((F.col("new") == 0) & (F.col("pos") > F.col("reach")), gap))).alias("between")) \
        .withColumn("gaps", F.transform("between", lambda g: F.struct(g["first"].alias("first"), g["end"].alias("end")))) \
        .withColumn("k_gaps", F.transform("between", lambda g: F.struct(g["k_first"].alias("first"), g["k_end"].alias("end")))) \
        .select("doc_id", "first", "end", "gaps", F.xxhash64("gaps").alias("key"),
                "keeper", "k_first", "k_end", "k_gaps", F.xxhash64("k_gaps").alias("k_key"))
    chains = persist_shared(chains)
    # the words around both ends and in the gaps, once for each different chain, from the documents that have any
    asked = chains.select("doc_id", "first", "end", "key", "gaps").union(chains.select("keeper", "k_first", "k_end", "k_key", "k_gaps")) \
        .groupBy("doc_id").agg(F.collect_set(F.struct("first", "end", "key", "gaps")).alias("at"))
    asked = persist_shared(asked)
    some = docs.join(checked_broadcast(asked.select("doc_id")), "doc_id", "left_semi")
    # not kept: both joins read the one shuffle that drops the repeated rows
    context = some.join(asked, "doc_id").select("doc_id", "text", "at").mapInArrow(_contexts, CONTEXT_DDL) \
        .dropDuplicates(["doc_id", "first", "end", "key"])
    kept = context.select(F.col("doc_id").alias("keeper"), F.col("first").alias("k_first"), F.col("end").alias("k_end"),
                          F.col("key").alias("k_key"), F.col("before").alias("k_before"), F.col("after").alias("k_after"),
                          F.col("inside").alias("k_inside"))
    spans = persist_shared(chains.join(context, ["doc_id", "first", "end", "key"]).join(kept, ["keeper", "k_first", "k_end", "k_key"])
                           .select("doc_id", "first", "end", "gaps", "keeper", "k_first", "k_end", "k_gaps",
                                   "before", "after", "inside", "k_before", "k_after", "k_inside")
                           .mapInArrow(_widened, WIDE_DDL))
    places = spans.select("doc_id", "first", "end", F.col("keeper").alias("component_id"))
    gone = _merged(places.where("doc_id <> component_id"), bridge, least)
    stay = _merged(spans.select(F.col("keeper").alias("doc_id"), F.col("k_first").alias("first"), F.col("k_end").alias("end"),
                                F.col("keeper").alias("component_id")).union(places.where("doc_id = component_id")).distinct(), bridge, least)
    return gone.withColumn("kept", F.lit(False)).union(stay.withColumn("kept", F.lit(True)))


def _merged(spans: DataFrame, bridge: int, least: int) -> DataFrame:
    """Spans of a document that overlap or nearly touch, as one; short ones go."""
    order = Window.partitionBy("doc_id").orderBy("first", "end", "component_id")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    run = F.sum(F.when(F.col("first") <= F.col("reach") + bridge, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return spans.withColumn("reach", reach).withColumn("run", run).groupBy("doc_id", "run") \
        .agg(F.min("first").alias("first_word"), F.max("end").alias("end"), F.min("component_id").alias("component_id")) \
        .select("doc_id", F.col("first_word").cast("long").alias("first_word"),
                (F.col("end") - F.col("first_word")).cast("long").alias("n_words"), "component_id") \
        .where(F.col("n_words") >= least)


def _cut(text_at: int, cuts_at: int, left: str):
    """Texts without the words of their spans, as a last column."""
    def run(batches):
        for b in batches:
            cuts, out = b.column(cuts_at).to_pylist(), []
            for s in slices(b.column(text_at)):
                starts, ends, first = word_bounds(s)
                raw = s.data.tobytes()
                for i in range(s.n):
                    at, end = int(s.offsets[i]), int(s.offsets[i + 1])
                    n = int(first[i + 1] - first[i])
                    parts = []
                    for x in sorted(cuts[s.first + i] or [], key=lambda c: c["first_word"]):
                        if x["first_word"] >= n:
                            continue
                        parts.append(raw[at:int(starts[first[i] + x["first_word"]])])
                        after = x["first_word"] + x["n_words"]
                        at = int(starts[first[i] + after]) if after < n else end
                    out.append(b"".join([*parts, raw[at:end]]).decode("utf-8"))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], [*b.schema.names, left])
    return run


def remove_passages(docs: DataFrame, least: int = LEAST, **params) -> DataFrame:
    """``docs`` without the repeated passages: the same columns, the text cut, n_chars following it.

    Different texts under one id are different documents here: each is cut at
    its own passages only.  Documents of which nothing but separators is left
    go; all others stay, empty and null texts as they were.
    """
    columns = docs.columns
    number, doc, cuts, left = fresh_names(columns, "__number", "__doc", "__cuts", "__left")
    texts = numbered_texts(docs, number)
    found = repeated_passages(texts.select(F.col(number).alias("doc_id"), "text"), least=least, **params)
    removals = persist_shared(found.where("not kept").groupBy(F.col("doc_id").alias(doc))
                              .agg(F.collect_list(F.struct("first_word", "n_words")).alias(cuts)))
    joined = texts.join(checked_broadcast(removals), F.col(number) == F.col(doc), "left").drop(number)
    touched = joined.where(F.col(doc).isNotNull()).drop(doc)
    schema = T.StructType([*touched.schema.fields, T.StructField(left, T.StringType())])
    cut = touched.mapInArrow(_cut(columns.index("text"), len(columns), left), schema) \
        .where(F.trim(F.regexp_replace(left, r"[\x09-\x0D]", " ")) != "")
    new = {"text": F.col(left), "n_chars": F.length(left).cast("long")}
    cut = cut.select(*[new[c].alias(c) if c in new else F.col(c) for c in columns])
    return joined.where(F.col(doc).isNull()).select(*columns).union(cut)


def op9_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 9 over all documents."""
    return repeated_passages(table(spark, sf_dir, "documents", "doc_id", "text"))
