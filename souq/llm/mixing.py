"""Mixing sources to target weights (weighted sampling to token budgets).

Method: Efraimidis-Spirakis keys ``-ln(u) / weight`` order the documents of a
source; documents are taken in that order until the source's token budget is
full.  A budget above the source's size first takes complete epochs (every
document once per epoch) and selects by key only in the last, partial one.

Scale: the text is read once; what follows works on narrow rows
(id, source, size, key).  A source is never ordered in one task: its keys are
cut into buckets of about ``bucket_rows`` rows, bucket totals give the
running offsets, and the order inside a bucket is a window on
(source, bucket).  The number of buckets follows the measured row count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import persist_shared, table

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of whitespace-separated words (space, tab, LF, VT, FF, CR); null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """Weight in [0.1, 1]: the share of the text's characters that are ASCII letters, spaces
    or beyond ASCII.  Symbols, digits and table bars lower it; empty and null texts get 0.1."""
    kept = F.length(F.regexp_replace(text, r"[\x21-\x40\x5B-\x60\x7B-\x7E]+", ""))
    return F.coalesce(F.lit(0.1) + 0.9 * kept / F.greatest(F.length(text), F.lit(1)), F.lit(0.1))


def targets(sizes: DataFrame, weight: DataFrame | None = None, cap: int = 3) -> DataFrame:
    """Token budget per source: weight shares of the total, capped, excess reshared.

    ``sizes`` has (source, source_size), one row per source, null allowed.
    Sources in code point order, null last, weigh 1, 2, 3, 1, 2, 3, ...; or
    ``weight`` gives (source, weight).  A source's target is
    ``min(cap * size, level * weight)`` where one level makes the targets sum
    to the total.  The level is found directly: sorted by ``cap * size /
    weight`` the capped sources come first, so it is the first position where
    sharing what the earlier ones leave stays under the next cap.  One row
    per source goes through the ordering.
    """
    if weight is None:
        order = Window.orderBy(F.col("source").asc_nulls_last())
        w = sizes.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("double"))
    else:
        w = sizes.alias("s").join(weight.alias("w"), F.col("s.source").eqNullSafe(F.col("w.source"))) \
            .select("s.source", "source_size", F.col("weight").cast("double").alias("weight"))
    by_cap = Window.orderBy(F.col("cap_level"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy()
    r = (w.withColumn("cap_level", cap * F.col("source_size") / F.col("weight"))
          .withColumn("left", F.sum("source_size").over(all_rows)
                      - F.coalesce(F.sum(cap * F.col("source_size")).over(before), F.lit(0)))
          .withColumn("w_left", F.sum("weight").over(all_rows)
                      - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
          .withColumn("share", F.col("left") / F.col("w_left"))
          # the first source whose own cap lies above the share fixes the level
          .withColumn("at", F.row_number().over(by_cap))
          .withColumn("level", F.min(F.when(F.col("share") <= F.col("cap_level"), F.struct("at", "share"))).over(all_rows)["share"]))
    return r.select("source", "source_size",
                    F.least(F.col("cap_level"), F.coalesce("level", "cap_level")).alias("_l"), "weight") \
            .select("source", "source_size", (F.col("_l") * F.col("weight")).alias("target"))


def mix(docs: DataFrame, weight: DataFrame | None = None, cap: int = 3, seed: int = 17,
        bucket_rows: int = 2_000) -> DataFrame:
    """Choose how many words of each document the mix takes.

    ``docs`` has doc_id, source, text and possibly more columns (ignored).
    Returns one row per input row: doc_id, source, size, source_size, target,
    taken, epochs, tie (xxhash64 of the
    text).

    Defined cases: null text has size 0 and takes 0; null source is a source
    of its own, last in order; null doc_id takes part like any id; repeated
    rows are separate rows with the same key, ordered among themselves by size
    and text hash, so the multiset of results is fixed; an empty table gives
    an empty result; a total of 0 words gives targets of 0.  The document at
    the edge of the budget contributes only the words still missing, so a
    source's taken words equal its target rounded down.
    """
    # 52 bits of a digest of the id, a uniform number in (0, 1)
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    narrow = persist_shared(docs.select(
        "doc_id", "source", word_count(F.col("text")).alias("size"),
        (-F.log(u) / quality_weight(F.col("text"))).alias("key"), F.xxhash64("text").alias("tie")))
    # map-side combined: one row per source and task is shuffled
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    goal = targets(sizes.select("source", "source_size"), weight, cap)
    plan = (goal.alias("g").join(sizes.alias("s"), F.col("g.source").eqNullSafe(F.col("s.source")))
            .select("g.source", "g.source_size", "target", "n")
            .withColumn("budget", F.floor("target").cast("long"))
            .withColumn("epochs", F.when(F.col("source_size") > 0,
                                         F.floor(F.col("budget") / F.greatest("source_size", F.lit(1)))).otherwise(0)
                        .cast("long"))
            .withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
            .withColumn("buckets", F.ceil(F.col("n") / bucket_rows).cast("long")))
    rows = narrow.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source"))) \
        .select("doc_id", F.col("d.source").alias("source"), "size", "key", "tie", "source_size", "target",
                "epochs", "rest",
                # u^(1/weight) falls as the key grows: buckets are ranges of the key
                F.floor((1 - F.exp(-F.col("key"))) * F.col("buckets")).cast("long").alias("bucket"))
    totals = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    start = totals.select("source", "bucket", (
        F.sum("bucket_size").over(Window.partitionBy("source").orderBy("bucket")) - F.col("bucket_size")).alias("start"))
    within = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size", "tie") \
        .rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    out = placed.alias("r").join(
        start.alias("b"), F.col("r.source").eqNullSafe(F.col("b.source")) & (F.col("r.bucket") == F.col("b.bucket"))) \
        .select("doc_id", F.col("r.source").alias("source"), "size", "tie", "source_size", "target", "epochs", "rest",
                (F.col("start") + F.col("inside")).alias("before"))
    part = F.least(F.col("size"), F.greatest(F.lit(0), F.col("rest") - F.col("before")))
    return out.select("doc_id", "source", "size", "source_size", "target",
                      (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"), "epochs", "tie")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 3 over all documents."""
    return mix(table(spark, sf_dir, "documents", "doc_id", "source", "text")) \
        .select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(text) AS tie,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         coalesce(0.1 + 0.9 * length(regexp_replace(text, '[\x21-\x40\x5B-\x60\x7B-\x7E]+', '', 'g'))
                  / greatest(length(text), 1), 0.1)::DOUBLE AS quality,
         (('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5)
           / 4503599627370496.0 AS u
  FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS total FROM d GROUP BY source),
w AS (SELECT source, total, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM s),
c AS (SELECT a.source, a.total, a.weight, 3 * a.total / a.weight AS lvl,
             ((SELECT sum(total) FROM w) - coalesce((SELECT sum(3 * b.total) FROM w b
                WHERE 3 * b.total / b.weight < 3 * a.total / a.weight), 0))
             / (SELECT sum(b.weight) FROM w b WHERE 3 * b.total / b.weight >= 3 * a.total / a.weight) AS share
      FROM w a),
level AS (SELECT min_by(share, lvl) AS l FROM c WHERE share <= lvl),
t AS (SELECT source, total, least(lvl, coalesce((SELECT l FROM level), lvl)) * weight AS target FROM c),
r AS (SELECT d.doc_id, d.size, t.total, t.target,
             CASE WHEN t.total > 0 THEN floor(floor(t.target) / greatest(t.total, 1)) ELSE 0 END AS epochs,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY -ln(d.u) / d.quality, d.doc_id, d.size, d.tie
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, total::BIGINT AS source_size, target,
       (epochs * size + least(size, greatest(0, floor(target) - epochs * total - before_)))::BIGINT AS taken
FROM r
"""
