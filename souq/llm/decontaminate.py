"""Benchmark decontamination (operator 1), DataFrame functions only.

The benchmark's normalised word windows form a hash set that is broadcast
(after its size is checked).  Training texts are scanned once: the hash of the
words at every position probes the set inside the scan's stage, hits are
verified word by word in the join condition, and only verified hits (and one
row per document) leave the stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import persist_shared, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
ANCHOR = 4
# largest benchmark, in windows of at most 13 words, that is broadcast
BROADCAST_WINDOWS = 500_000


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; null has none."""
    return F.coalesce(F.array_remove(F.split(F.translate(text, UPPER, LOWER), BETWEEN_WORDS), ""),
                      F.array().cast("array<string>"))


def _anchor(at: Column, i: Column, size: int) -> Column:
    return F.xxhash64(F.lit(size), *[F.get(at, i + j) for j in range(size)])


def _anchors(column: str, size: int) -> Column:
    return F.transform(column, lambda _, i: _anchor(F.col(column), i, size))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows with the items they come from: w, length, anchor, anchor_size, items.

    An item of fewer than ``window`` words, but not none, is one window.
    """
    item = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    return item.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, window))).alias("w")) \
        .groupBy("w").agg(F.collect_set("item_id").alias("items")) \
        .select("w", F.size("w").alias("length"), F.least(F.size("w"), F.lit(ANCHOR)).alias("anchor_size"), "items")


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Hits of benchmark windows in every document.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text; other columns
    are ignored.  Returns one row per input row: doc_id, n_words, n_hit (words
    inside any occurrence of a window), items (sorted strings of the items
    with occurring windows), spans (the hit ranges of word positions, disjoint
    and in order), text_hash.

    Defined cases: null and empty texts, of documents or items, have no words
    and no hits; a null doc_id is a document like any other; an item without
    item_id marks words but is not named; repeated rows give a row each; empty
    tables give no rows, or no hits.
    """
    win = persist_shared(benchmark_windows(benchmark, window))
    sizes = {r.anchor_size: r.n for r in win.groupBy("anchor_size").agg(F.count(F.lit(1)).alias("n")).collect()}
    anchored = win.limit(0).withColumn("anchor", F.lit(0).cast("long"))
    for s in sorted(sizes):
        anchored = anchored.union(win.where(F.col("anchor_size") == s)
                                  .withColumn("anchor", _anchor(F.col("w"), F.lit(0), s)))
    # one more row that every document meets once, so documents without hits stay
    always = win.sparkSession.range(1).select(
        F.array().cast("array<string>").alias("w"), F.lit(0).alias("length"),
        F.array().cast(win.schema["items"].dataType).alias("items"), F.lit(0).cast("long").alias("anchor"))
    hashes = anchored.select("w", "length", "items", "anchor").union(always)
    if sum(sizes.values()) <= BROADCAST_WINDOWS:
        hashes = F.broadcast(hashes)

    doc = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("words")) \
        .withColumn("n_words", F.size("words"))
    anchors = F.concat(F.array(F.lit(0).cast("long")),
                       *[_anchors("words", s) for s in sorted(sizes)])
    # position 0 is the row for all; then the words' positions, once for each anchor size
    probes = doc.select("doc_id", "text_hash", "n_words", "words", F.posexplode(anchors).alias("p", "anchor")) \
        .withColumn("pos", F.pmod(F.col("p") - 1, F.greatest("n_words", F.lit(1))))
    verified = F.when(F.col("h.length") == 0, F.col("d.p") == 0).otherwise(
        (F.col("d.p") > 0) & (F.slice("d.words", F.col("d.pos") + 1, F.col("h.length")) == F.col("h.w")))
    hits = probes.alias("d").join(hashes.alias("h"), (F.col("d.anchor") == F.col("h.anchor")) & verified) \
        .select("doc_id", "text_hash", "n_words", "items",
                F.when(F.col("length") > 0, F.struct("pos", (F.col("pos") + F.col("length")).alias("end"))).alias("span"))
    by_doc = hits.groupBy("doc_id", "text_hash", "n_words").agg(
        F.array_sort(F.collect_set("span")).alias("found"), F.collect_set("items").alias("items"),
        F.count(F.when(F.col("span").isNull(), 1)).alias("copies"))
    empty = F.array().cast("array<struct<pos:int,end:int>>")

    def widen(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        grown = F.concat(F.slice(done, 1, F.size(done) - 1),
                         F.array(F.struct(last["pos"].alias("pos"), F.greatest(last["end"], x["end"]).alias("end"))))
        return F.when((F.size(done) > 0) & (x["pos"] <= F.get(done, F.size(done) - 1)["end"]), grown) \
            .otherwise(F.concat(done, F.array(F.struct(x["pos"].alias("pos"), x["end"].alias("end")))))

    spans = F.when(F.size("found") == 0, empty).otherwise(F.aggregate("found", empty, widen))
    names = F.array_sort(F.array_distinct(F.transform(F.flatten("items"), lambda x: x.cast("string"))))
    return by_doc.withColumn("spans", spans).select(
        "doc_id", "text_hash", F.col("n_words").cast("long").alias("n_words"),
        F.aggregate("spans", F.lit(0), lambda n, x: n + x["end"] - x["pos"]).cast("long").alias("n_hit"),
        names.alias("items"), "spans", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")).drop("_copy")


def contaminated(percent_words: int = 20) -> Column:
    """The contamination rule: at least one word in ``percent_words`` is hit."""
    return (F.col("n_hit") > 0) & (percent_words * F.col("n_hit") >= F.col("n_words"))


def remove_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any other columns) that are not contaminated."""
    bad = scan(docs, benchmark).where(contaminated()).select(
        F.col("doc_id").alias("__bad_id"), F.col("text_hash").alias("__bad_hash")).distinct()
    # the same id and text is the same document; the rest stays, whatever its columns
    return docs.join(bad, docs["doc_id"].eqNullSafe(F.col("__bad_id")) & (F.xxhash64(docs["text"]) == F.col("__bad_hash")),
                     "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id and text without the hit words (each goes with the separators that follow it)."""
    hit = scan(docs, benchmark).where("n_hit > 0").select(
        F.col("doc_id").alias("_hit_id"), "text_hash", "spans").distinct()
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
    gap = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
    pieces = F.regexp_extract_all("text", F.lit(f"{word}+{gap}"), F.lit(0))
    left = F.filter(pieces, lambda _, i: ~F.exists("spans", lambda s: (i >= s["pos"]) & (i < s["end"])))
    return docs.join(hit, docs["doc_id"].eqNullSafe(F.col("_hit_id")) & (F.xxhash64(docs["text"]) == F.col("text_hash")), "left") \
        .select("doc_id", F.when(F.col("spans").isNull(), F.col("text")).otherwise(
            F.concat(F.regexp_extract("text", f"^{gap}", 0), F.array_join(left, ""))).alias("text"))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 1 over all documents and the whole benchmark."""
    found = scan(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"))


OP1_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, array_to_string(w[i + 1 : i + 13], ' ') AS key, least(len(w), 13) AS n
  FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 13, 0) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
spot AS (SELECT rid, w, unnest(range(0, len(w))) AS p FROM d WHERE len(w) > 0),
hit AS (
  SELECT a.rid, a.p, l.n, win.item_id
  FROM spot a JOIN lens l ON a.p + l.n <= len(a.w)
  JOIN win ON win.n = l.n AND win.key = array_to_string(a.w[a.p + 1 : a.p + l.n], ' ')),
words_hit AS (
  SELECT rid, count(*) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(p, p + n)) AS q FROM hit) GROUP BY rid),
items_hit AS (
  SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT rid, item_id::VARCHAR AS id FROM hit) GROUP BY rid)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN words_hit USING (rid) LEFT JOIN items_hit USING (rid)
"""
