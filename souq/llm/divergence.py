"""Source divergence audit by three-dimensional cube partitioning (operator 11).

Every (lang, source) group has a smoothed term distribution over the terms its
lang keeps.  The divergence of two groups is a sum over terms, so the work is
a cube: group x group x term.  A task owns one cell (group block, group block,
term block): it receives the two slices of counts that meet there, adds up
the partial divergences of all its pairs, and the partial sums are reduced
along the term axis.

Scale: text is read once and counted per batch, so what is shuffled is one row
for each group, term and batch, combined map-side.  A slice is replicated to
the cells of its row and column of the cube (once for each group block); a
cell holds about 2 * ``group_block`` * ``term_block`` counts, whatever the
number of groups, terms or words.  Terms that neither slice of a cell has are
not listed there: each adds the same amount to a pair, so they are counted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_batches, table, write_shared
from .textops import LOWER, slices, to_batch, word_bounds

# bytes that end a term: ASCII other than letters
BREAK = np.ones(256, bool)
BREAK[0x41:0x5B] = BREAK[0x61:0x7B] = False
BREAK[0x80:] = False

UNIT = 1_000_000_000  # what the probabilities of a distribution add up to
COUNTS = "lang string, source string, term string, n long, docs long"
_ARROW = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _words(s) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased terms of a slice in order, and the slice's text that each is from."""
    starts, ends, first = word_bounds(s, BREAK)
    offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)
    letters = np.ascontiguousarray(LOWER[s.data[~BREAK[s.data]]])
    terms = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(letters))
    return terms, np.repeat(np.arange(s.n), np.diff(first))


def _count(batches):
    """Occurrences and documents of each (lang, source, term) of a batch; a row with an empty
    term names each group."""
    for b in batches:
        if not b.num_rows:
            continue
        names = pa.StructArray.from_arrays([b.column(0), b.column(1)], ["lang", "source"])
        keys = pa.array([f"{len(x)}:{x}{y}" for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]).dictionary_encode()
        group = keys.indices.to_numpy()
        groups = names.take(pa.array(np.unique(group, return_index=True)[1]))
        n = len(groups)
        yield to_batch(_ARROW, [groups.field(0), groups.field(1), pa.array([""] * n), np.zeros(n, np.int64), np.zeros(n, np.int64)])
        for s in slices(b.column(2)):
            terms, text = _words(s)
            if not len(terms):
                continue
            coded = terms.dictionary_encode()
            m = len(coded.dictionary)
            each, times = np.unique(text * m + coded.indices.to_numpy(), return_counts=True)
            found, at = np.unique(group[s.first + each // m] * np.int64(m) + each % m, return_inverse=True)
            of = groups.take(pa.array(found // m))
            yield to_batch(_ARROW, [of.field(0), of.field(1), coded.dictionary.take(pa.array(found % m)),
                                    np.bincount(at, times).astype(np.int64), np.bincount(at)])


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents); null columns read as ''.
    The empty term names every group."""
    small_batches(docs.sparkSession)
    text = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return text.mapInArrow(_count, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _whole_ratio(a: Column, b: Column) -> Column:
    """floor(a / b) of non-negative whole numbers, exact (the product in ``a`` may exceed a long)."""
    return F.call_function("div", a, b)


def smoothed(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(UNIT * (n + 2) / (total + 2 * kept))."""
    wide = F.lit(UNIT).cast("decimal(10,0)") * (n + 2).cast("decimal(20,0)")
    return (_whole_ratio(wide, F.greatest(total + 2 * kept, F.lit(1)).cast("decimal(20,0)")) + 1).cast("long")


def divergence(p: Column, q: Column) -> Column:
    return _whole_ratio((p - q) * (p - q), p + q)


PARTIAL = "lang string, a string, b string, part long, terms long, rest long, kept long"


def _cell(t: pa.Table) -> pa.Table:
    """Partial divergences of all pairs of one cell of the cube.

    Rows with an empty term are the cell's groups, with the probability of a term they lack.
    """
    schema = pa.schema([("lang", pa.string()), ("a", pa.string()), ("b", pa.string()), ("part", pa.int64()),
                        ("terms", pa.int64()), ("rest", pa.int64()), ("kept", pa.int64())])
    source, term = (t.column(c).combine_chunks().dictionary_encode() for c in ("source", "term"))
    row, column = source.indices.to_numpy(), term.indices.to_numpy()
    p, block = t.column("p").to_numpy(), t.column("g").to_numpy()
    empty = term.dictionary.index(pa.scalar("")).as_py()
    head = column == empty
    base, side = np.zeros(len(source.dictionary), np.int64), np.zeros(len(source.dictionary), np.int64)
    base[row[head]], side[row[head]] = p[head], block[head]
    # a column for each occurring term; the empty one stays equal on both sides and adds nothing
    m = len(term.dictionary)
    dense = np.repeat(base[:, None], m, axis=1)
    dense[row[~head], column[~head]] = p[~head]
    dense[:, empty] = 1
    names = source.dictionary.to_pylist()
    i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
    if i == j:
        order = sorted(range(len(names)), key=lambda x: names[x].encode())
        pairs = [(a, order[k + 1:]) for k, a in enumerate(order[:-1])]
    else:
        across = np.flatnonzero(side == j).tolist()
        pairs = [(a, across) for a in np.flatnonzero(side == i).tolist() if across]
    out: list[list] = [[], [], [], []]
    for a, bs in pairs:
        d, s = dense[bs] - dense[a], dense[bs] + dense[a]
        part = (d * d // s).sum(axis=1)
        rest = (base[bs] - base[a]) ** 2 // (base[bs] + base[a])
        out[0] += [names[a]] * len(bs)
        out[1] += [names[x] for x in bs]
        out[2] += part.tolist()
        out[3] += rest.tolist()
    n = len(out[0])
    return pa.Table.from_batches([to_batch(schema, [[t.column("lang")[0].as_py()] * n, out[0], out[1], out[2], [m - 1] * n, out[3],
                                                   [t.column("kept")[0].as_py()] * n])])


def audit(docs: DataFrame, min_docs: int = 10, top: int = 10, group_block: int = 32, term_block: int = 4096) -> DataFrame:
    """Divergence of every two sources of a lang (part ``pair``), and the ``top`` terms that set a
    source apart from its lang (part ``term``).

    ``docs`` has lang, source, text (other columns are ignored).  Returns
    lang, source, part, item, value, rank.

    Defined cases: null lang, source or text read as ''; every row is a
    document, repeated rows too; texts without terms still make their group
    known; a lang without kept terms gives its pairs the value 0; a lang of
    one source has no pairs; ties go to the item that is smaller in UTF-8; an
    empty table gives an empty result.  The size of Arrow batches set here
    stays set for the session.
    """
    counts = write_shared(term_counts(docs), "term-counts")
    terms = counts.where("term <> ''")
    kept = write_shared(terms.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
                        .where(F.col("docs") >= min_docs).select("lang", "term", "lang_n"), "kept-terms")
    found = write_shared(terms.select("lang", "source", "term", "n").join(kept, ["lang", "term"])
                         .select("lang", "source", "term", "n", "lang_n"), "kept-counts")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("lang_n").alias("lang_total"))
    totals = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    named = counts.where("term = ''").select("lang", "source")
    size = named.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / group_block).alias("blocks"))
    groups = write_shared(
        named.join(totals, ["lang", "source"], "left").join(size, "lang").join(langs, "lang", "left")
        .select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("kept", F.lit(0)).alias("kept"),
                F.coalesce("lang_total", F.lit(0)).alias("lang_total"), "blocks",
                F.greatest(F.lit(1), F.ceil(F.coalesce("kept", F.lit(0)) / term_block)).alias("slabs"),
                F.pmod(F.xxhash64("source"), "blocks").alias("g")), "groups")
    entries = found.join(groups, ["lang", "source"]).withColumn("p", smoothed(F.col("n"), F.col("total"), F.col("kept")))

    # the cube: a slice goes to the cells of its row and its column
    part = ["lang", "source", "g", "blocks", "kept", "term", "p", "k"]
    heads = groups.withColumn("term", F.lit("")).withColumn("p", smoothed(F.lit(0), F.col("total"), F.col("kept"))) \
        .withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slabs") - 1))).select(part)
    slabs = entries.withColumn("k", F.pmod(F.xxhash64("term"), "slabs")).select(part).union(heads) \
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))) \
        .select("lang", "source", "g", "kept", "term", "p", "k", F.least("g", "other").alias("i"), F.greatest("g", "other").alias("j"))
    partial = slabs.groupBy("lang", "i", "j", "k").applyInArrow(_cell, PARTIAL)
    # along the term axis
    summed = partial.groupBy("lang", "a", "b").agg(
        (F.sum("part") + (F.any_value("kept") - F.sum("terms")) * F.any_value("rest")).alias("value"))
    pairs = summed.select("lang", "value", F.explode(F.array(
        F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
        F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x")) \
        .select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")

    q = smoothed(F.col("lang_n"), F.col("lang_total"), F.col("kept"))
    apart = entries.withColumn("q", q).where("n > 0 and p > q") \
        .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    columns = ["lang", "source", "part", "item", F.col("value").cast("long").alias("value"), "rank"]
    return pairs.withColumn("rank", F.row_number().over(order)).select(columns) \
        .union(apart.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select(columns))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 11 over all documents."""
    return audit(table(spark, sf_dir, "documents", "lang", "source", "text"))


OP11_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text
  FROM documents),
w AS MATERIALIZED (
  SELECT r, lang, source, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM d),
kept AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
lt AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
gt AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
f AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         (1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (coalesce(gt.total, 0)::HUGEINT + 2 * lt.v))::HUGEINT AS p,
         (1 + 1000000000::HUGEINT * (k.n + 2) // (lt.total::HUGEINT + 2 * lt.v))::HUGEINT AS q
  FROM g JOIN kept k USING (lang) JOIN lt USING (lang)
  LEFT JOIN gt ON gt.lang = g.lang AND gt.source = g.source
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::BIGINT AS value
  FROM f a JOIN f b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
apart AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value
  FROM f WHERE n > 0 AND p > q)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM apart)
QUALIFY part = 'pair' OR rank <= 10
"""
