"""Toxicity by averaged subword embeddings and a linear softmax (operator 10).

A text is the bag of its words' character n-grams (with word-edge marks) and
whole words, hashed into buckets.  The embeddings of the bag are averaged and
fed to a linear softmax; embeddings and softmax are trained jointly in numpy
on a bounded labelled sample.  A misspelt word the model never saw shares most
n-gram vectors with the word it stands for.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import persist_shared, small_batches, table
from .labelled import held_out, labelled_sample, with_score
from .textops import LOWER, SPACE, Slice, fmix, slices, word_bounds, word_hashes

U = np.uint64
BITS = 17
BUCKETS = 1 << BITS
SHORTEST, LONGEST = 3, 5
_LETTER = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64)


def subwords(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Text number and bucket of every subword of a slice: byte n-grams inside words, lower-cased,
    aware of word edges, and the words themselves."""
    starts, ends, first = word_bounds(s)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = len(s.data)
    text = np.repeat(np.arange(s.n), np.diff(s.offsets))
    begins, finishes = np.zeros(size, bool), np.zeros(size, bool)
    begins[starts], finishes[ends - 1] = True, True
    # bytes left to the end of the word a byte belongs to; none outside words
    left = ends[np.maximum(np.cumsum(begins) - 1, 0)] - np.arange(size)
    left[SPACE[s.data]] = 0
    value = _LETTER[LOWER[s.data]]
    h = np.zeros(size, np.uint64)
    texts, buckets = [], []
    for k in range(LONGEST):
        if k >= size:
            break
        h[:size - k] = h[:size - k] * U(0x9E3779B97F4A7C15) + value[k:]
        if k + 1 >= SHORTEST:
            at = np.flatnonzero(left > k)
            g = h[at] + begins[at] * U(0x632BE59BD9B4E019) + finishes[at + k] * U(0x85157AF5CB6B3D21) + U(k)
            texts.append(text[at])
            buckets.append(fmix(g) >> U(64 - BITS))
    texts.append(text[starts])
    buckets.append(fmix(word_hashes(s, starts, ends) ^ U(99)) >> U(64 - BITS))
    return np.concatenate(texts), np.concatenate(buckets).astype(np.int64)


class SubwordSoftmax:
    """Weight of each subword bucket in the softmax's log-odds, and the bias."""

    def __init__(self, weight: np.ndarray, bias: float):
        self.weight, self.bias = weight.astype(np.float32), float(bias)

    def __call__(self, column: pa.Array) -> np.ndarray:
        """Probability of label 1 of each text; texts without words get that of the bias alone."""
        out = []
        for s in slices(column):
            text, bucket = subwords(s)
            n = np.bincount(text, minlength=s.n)
            # each subword with a weight counts once per text, however often it is repeated
            has = self.weight[bucket] != 0
            pair = np.unique(text[has] * BUCKETS + bucket[has])
            z = np.bincount(pair // BUCKETS, self.weight[pair % BUCKETS], s.n) / np.sqrt(np.maximum(n, 1)) + self.bias
            out.append(1 / (1 + np.exp(-np.clip(z, -50, 50))))
        return np.concatenate(out) if out else np.zeros(0)


def _document_counts(batches):
    """Per task, in how many texts of either class each bucket occurs."""
    df, n = np.zeros((2, BUCKETS), np.int32), np.zeros(2, np.int64)
    for b in batches:
        y = b.column("y").to_numpy()
        for s in slices(b.column("text")):
            text, bucket = subwords(s)
            pair = np.unique(text * BUCKETS + bucket)
            label = y[s.first:s.first + s.n]
            for c in (0, 1):
                df[c] += np.bincount(pair[label[pair // BUCKETS] == c] % BUCKETS, minlength=BUCKETS).astype(np.int32)
            n += np.bincount(label, minlength=2)
    if n.sum():
        yield pa.RecordBatch.from_arrays([pa.array([df.tobytes()]), pa.array([n.tobytes()])], ["df", "n"])


def _bags(kept: np.ndarray):
    place = np.full(BUCKETS, -1, np.int64)
    place[kept] = np.arange(len(kept))

    def run(batches):
        for b in batches:
            bags, total = [], []
            for s in slices(b.column("text")):
                text, bucket = subwords(s)
                total += np.bincount(text, minlength=s.n).tolist()
                p = place[bucket]
                pair = np.unique(text[p >= 0] * BUCKETS + p[p >= 0])
                cut = np.searchsorted(pair // BUCKETS, np.arange(s.n + 1))
                p = (pair % BUCKETS).astype(np.uint32)
                bags += [p[cut[i]:cut[i + 1]].tobytes() for i in range(s.n)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(total, pa.int64()),
                                              pa.array(bags, pa.binary())], ["doc_id", "y", "n", "bag"])
    return run


def _train(bags: list[np.ndarray], n: np.ndarray, y: np.ndarray, weight: np.ndarray, width: int, dim: int, steps: int,
           batch: int, rate: float, decay: float, dropout: float, seed: int) -> tuple[np.ndarray, float]:
    """Embeddings and softmax trained jointly by Adam; returns each subword's weight in the log-odds, and the bias.

    A text's vector is the mean of its subword vectors, each different one
    counted once, times the square root of the text's number of subwords, so
    long texts keep the evidence of a few words.  A share of each bag is left
    out at every step, so that no word rests on all of its subwords: those that
    a misspelling keeps have to be enough.
    """
    g = np.random.default_rng(seed)
    par = [g.normal(0, 0.1, (width, dim)), g.normal(0, 0.1, (dim, 2)), np.zeros(2)]
    m, v = [np.zeros_like(p) for p in par], [np.zeros_like(p) for p in par]
    scale = 1 / np.sqrt(np.maximum(n, 1))
    order = np.zeros(0, np.int64)
    for t in range(1, steps + 1):
        if len(order) < min(batch, len(y)):
            order = g.permutation(len(y))
        take, order = order[:batch], order[batch:]
        x = np.stack([np.bincount(bags[i][g.random(len(bags[i])) >= dropout], minlength=width) * scale[i] for i in take])
        hidden = x @ par[0]
        z = hidden @ par[1] + par[2]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(take)), y[take]] -= 1
        p *= (weight[take] / len(take))[:, None]
        grads = [x.T @ (p @ par[1].T) + decay * par[0], hidden.T @ p + decay * par[1], p.sum(axis=0)]
        for i, d in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * d
            v[i] = 0.999 * v[i] + 0.001 * d * d
            par[i] -= rate * (m[i] / (1 - 0.9 ** t)) / (np.sqrt(v[i] / (1 - 0.999 ** t)) + 1e-8)
    # a whole bag is scored between the share seen in training, which keeps the
    # probabilities of known words, and its full weight, which favours misspelt ones
    return (1 - 0.75 * dropout) * (par[0] @ (par[1][:, 1] - par[1][:, 0])), par[2][1] - par[2][0]


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = 4000, dim: int = 8,
                 epochs: int = 4, least_steps: int = 240, batch: int = 256, rate: float = 0.05, decay: float = 1e-5, dropout: float = 0.5,
                 least_chi: float = 10.0, seed: int = 0) -> SubwordSoftmax:
    """Fit on at most ``per_class`` labelled documents of each class, outside the held-out fold.

    Every bucket that tells the classes apart beyond chance (chi-square of the
    sample's document counts, ``least_chi`` at least) has an embedding; others
    count in the mean as zero vectors: with few labels, embeddings of buckets
    that only chance sets apart drown the others.  The sample's classes are
    weighted back to their shares among all labels.  Everything on the driver
    is bounded by the parameters and the number of buckets.
    """
    small_batches(docs.sparkSession)
    sample, counts = labelled_sample(docs, labels, "toxic", per_class)
    sample = persist_shared(sample.select(F.col("doc_id").cast("long"), F.col("y").cast("int"), "text").repartition(16, "doc_id"))
    df, n = np.zeros((2, BUCKETS)), np.zeros(2)
    for r in sample.mapInArrow(_document_counts, "df binary, n binary").collect():
        df += np.frombuffer(r.df, np.int32).reshape(2, -1)
        n += np.frombuffer(r.n, np.int64)
    if not n.all():
        # one class or none: its share is all there is to say
        return SubwordSoftmax(np.zeros(BUCKETS), 0.0 if not n.any() else (50.0 if n[1] else -50.0))
    # classes weigh as among all labels, also in the choice of buckets
    share = np.array([counts.get(c, 0) for c in (0, 1)], float)
    seen = df * (share / n)[:, None]
    both, p = seen.sum(axis=0), share[1] / share.sum()
    chi = (seen[1] - both * p) ** 2 / np.maximum(both * p * (1 - p), 1e-9)
    order = np.argsort(-chi, kind="stable")
    best = order[:max(1, int((chi * df.sum(axis=0) / np.maximum(both, 1e-9) >= least_chi).sum()))]
    t = sample.mapInArrow(_bags(best), "doc_id long, y int, n long, bag binary").toArrow() \
        .sort_by([("doc_id", "ascending"), ("bag", "ascending")])
    y = t.column("y").to_numpy().astype(np.int64)
    weight = (share / n)[y]
    steps = max(least_steps, epochs * math.ceil(len(y) / batch))
    w, bias = _train([np.frombuffer(x, np.uint32) for x in t.column("bag").to_pylist()], t.column("n").to_numpy(), y,
                     weight / weight.mean(), len(best), dim, steps, batch, rate, decay, dropout, seed)
    full = np.zeros(BUCKETS)
    full[best] = w
    return SubwordSoftmax(full, bias)


def score_toxicity(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= 0.3) of every row of ``docs``.

    Only the text enters the score.  Defined cases: null text counts as empty;
    texts without words get the model's bias; a null doc_id is never held out;
    repeated rows get equal scores; labels that are null, repeated or without
    a document are handled as in ``labelled_sample``; labels of one class only
    give its extreme score, none at all 0.5; an empty table gives an empty result.
    """
    model = fit_toxicity(docs, labels, **params)
    return with_score(docs.select("doc_id", "text"), model) \
        .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 10 over all documents."""
    return score_toxicity(table(spark, sf_dir, "documents", "doc_id", "text"),
                          table(spark, sf_dir, "labels", "doc_id", "toxic"))
