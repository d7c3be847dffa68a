"""Quality classifier by nearest-neighbour voting (operator 6).

Texts become vectors of hashed trigrams of character classes plus a few
counts of repetition, weighted by inverse document frequency and projected on
the leading latent-semantic directions of a bounded labelled sample.  The
sample's vectors are broadcast; every document takes exact blocked cosine
products with all of them, and its nearest labels vote, weighted by
similarity.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .labelled import collect_features, held_out, labelled_sample, with_score
from .textops import slices, word_bounds, word_hashes

BITS = 10
BUCKETS = 1 << BITS
EXTRA = 3
REPETITION = 3      # how much more a count of repetition weighs than one trigram
WIDTH = BUCKETS + EXTRA

# character classes: letters of either case, digits and bytes beyond ASCII each count as one
_CLASS = np.arange(256, dtype=np.uint32)
_CLASS[ord("a"):ord("z") + 1] = ord("a")
_CLASS[ord("A"):ord("Z") + 1] = ord("A")
_CLASS[ord("0"):ord("9") + 1] = ord("0")
_CLASS[128:] = 128


def features(column: pa.Array) -> np.ndarray:
    """Counts per text: hashed class trigrams; words equal to the word before; words seen before
    in the text; words.  Whole texts are read; empty and null texts have all zeros."""
    out = []
    for s in slices(column):
        c = _CLASS[s.data]
        doc = np.repeat(np.arange(s.n), np.diff(s.offsets))
        x = np.zeros((s.n, WIDTH), np.float32)
        if len(c) > 2:
            h = c[:-2] * np.uint32(2654435761) + c[1:-1] * np.uint32(2246822519) + c[2:] * np.uint32(3266489917)
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            h >>= np.uint32(32 - BITS)
            ok = doc[:-2] == doc[2:]
            x[:, :BUCKETS] = np.bincount(doc[:-2][ok] * BUCKETS + h[ok], minlength=s.n * BUCKETS).reshape(s.n, BUCKETS)
        starts, ends, first = word_bounds(s)
        w = word_hashes(s, starts, ends, lower=False)
        of = np.repeat(np.arange(s.n), np.diff(first))
        if len(w):
            again = (w[1:] == w[:-1]) & (of[1:] == of[:-1])
            x[:, BUCKETS] = np.bincount(of[1:][again], minlength=s.n)
            order = np.lexsort((w, of))
            seen = (w[order][1:] == w[order][:-1]) & (of[order][1:] == of[order][:-1])
            x[:, BUCKETS + 1] = np.bincount(of[order][1:][seen], minlength=s.n)
            x[:, BUCKETS + 2] = np.diff(first)
        out.append(x)
    return np.concatenate(out) if out else np.zeros((0, WIDTH), np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


class NeighbourVote:
    """Fitted on a bounded labelled sample: term weights, latent directions, sample vectors, votes."""

    def __init__(self, x: np.ndarray, y: np.ndarray, counts: dict[int, int], rank: int = 32, neighbours: int = 15,
                 power: float = 8.0):
        self.neighbours, self.power = neighbours, power
        self.idf = (np.log((len(x) + 1) / (np.count_nonzero(x, axis=0) + 1)) + 1).astype(np.float32)
        self.idf[BUCKETS:BUCKETS + 2] *= REPETITION
        # in place: the sample is the largest thing the driver holds
        t = np.log1p(x, out=x)
        t *= self.idf
        for i in range(0, len(t), 256):  # the norm copies what it is given
            t[i:i + 256] = _unit(t[i:i + 256])
        # right singular vectors of the sample, from its bounded Gram matrix
        self.directions = np.linalg.eigh(t.T @ t)[1][:, -rank:].astype(np.float32)
        self.vectors = _unit(t @ self.directions).astype(np.float32)
        # a class that the sample holds less often than the labels do counts more
        n = {c: max(1, int((y == c).sum())) for c in (0, 1)}
        self.y = y.astype(np.float32)
        self.vote = np.where(y == 1, counts.get(1, 0) / n[1], counts.get(0, 0) / n[0]).astype(np.float32)

    def __call__(self, column: pa.Array) -> np.ndarray:
        """Weighted share of label 1 among the nearest labelled vectors, for each text."""
        if not len(self.y):
            return np.full(len(column), 0.5)
        v = _unit(_unit(np.log1p(features(column)) * self.idf) @ self.directions)
        k = min(self.neighbours, len(self.y))
        out = np.empty(len(v))
        for i in range(0, len(v), 256):
            s = v[i:i + 256] @ self.vectors.T
            top = np.argpartition(-s, k - 1, axis=1)[:, :k]
            w = (np.maximum(np.take_along_axis(s, top, 1), 0).astype(np.float64) ** self.power + 1e-9) * self.vote[top]
            out[i:i + 256] = (w * self.y[top]).sum(axis=1) / w.sum(axis=1)
        return np.clip(out, 0, 1)


def fit_quality(docs: DataFrame, labels: DataFrame, per_class: int = 2000) -> NeighbourVote:
    """Fit on at most ``per_class`` labelled documents of each class, outside the held-out fold."""
    sample, counts = labelled_sample(docs, labels, "quality", per_class)
    x, y = collect_features(sample, features)
    return NeighbourVote(x, y, counts)


def score_quality(docs: DataFrame, labels: DataFrame, per_class: int = 2000) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= 0.7) of every row of ``docs``.

    Only the text enters the score.  Defined cases: null text counts as empty
    and, like empty text, is voted on by its nearest vectors; a null doc_id is
    never held out; repeated rows get equal scores; labels that are null,
    repeated or without a document are handled as in ``labelled_sample``;
    without any label every score is 0.5; an empty table gives an empty result.
    """
    model = fit_quality(docs, labels, per_class)
    return with_score(docs.select("doc_id", "text"), model) \
        .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_quality_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 6 over all documents."""
    return score_quality(table(spark, sf_dir, "documents", "doc_id", "text"),
                         table(spark, sf_dir, "labels", "doc_id", "quality"))
