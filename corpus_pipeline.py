"""Corpus pipeline: from raw documents to a training mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
what a stage returns as Parquet in the shared folder and gives it to the next.
All stages but the last return the columns of documents, whatever more than
doc_id, text, lang, source and n_chars they are; the last adds size,
source_size, target, taken and epochs (and drops columns that had these names).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from souq.llm.common import checked_broadcast, fresh_names, numbered_texts, persist_shared, table, write_shared
from souq.llm.decontaminate import remove_documents
from souq.llm.labelled import with_score
from souq.llm.minhash_dedup import near_duplicates
from souq.llm.mixing import mix
from souq.llm.paragraph_dedup import remove_passages
from souq.llm.quality import fit_quality

ADDED = ("size", "source_size", "target", "taken", "epochs")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject (score >= 0.7)."""
    model = fit_quality(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    return with_score(docs, model, "__quality").where("__quality >= 0.7").drop("__quality")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8.

    Different texts under one id are different documents: each goes or stays
    by its own text.  Rows that repeat an id with the same text, or a text
    without id, are one document.
    """
    columns = docs.columns
    number, tie = fresh_names(columns, "__number", "__tie")
    texts = numbered_texts(docs, number)
    found = near_duplicates(texts.select(F.col(number).alias("doc_id"), "text"), words=5, percent=80)
    gone = persist_shared(found.where("not kept").select(F.col("doc_id").alias(number)).distinct())
    left = texts.join(checked_broadcast(gone), number, "left_anti")
    hashed = left.withColumn(tie, F.xxhash64("text"))
    repeated = persist_shared(hashed.groupBy(F.col(number).alias("id"), F.col(tie).alias("h")).agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    n = repeated.count()
    if not n:
        return left.select(*columns)
    same = F.col(number).eqNullSafe(F.col("r.id")) & (F.col(tie) == F.col("r.h"))
    twice = checked_broadcast(repeated, n).alias("r")
    once = hashed.join(twice, same, "left_semi").dropDuplicates([number, tie, "text"])
    return hashed.join(twice, same, "left_anti").union(once).select(*columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that repeat across them."""
    return remove_passages(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark does not contaminate."""
    return remove_documents(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, each with the number of its words taken (repeats counted).

    Rows that repeat an id and text share what the mix takes of them.
    """
    taken = mix(docs).groupBy("doc_id", "tie").agg(
        *[F.any_value(c).alias(c) for c in ("size", "source_size", "target", "epochs")],
        F.floor(F.sum("taken") / F.count(F.lit(1))).cast("long").alias("taken")) \
        .select(F.col("doc_id").alias("__id"), F.col("tie").alias("__tie"), *ADDED)
    same = docs["doc_id"].eqNullSafe(taken["__id"]) & (F.xxhash64(docs["text"]) == taken["__tie"])
    return docs.drop(*ADDED).join(taken.where("taken > 0"), same).drop("__id", "__tie")


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: the stages train a model and iterate over a graph, which SQL cannot express
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = write_shared(docs, name)
    return docs
