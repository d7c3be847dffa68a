"""Interpolated modified Kneser-Ney language model (operator 7).

A bigram model with three discounts per level over a continuation unigram
level over the uniform distribution.  Counted in Spark; stored as sorted
arrays in files of the shared folder; workers map the files into memory and
look words and word pairs up by binary search.

Training passes:

1. Vocabulary.  Every task turns its texts into distinct word hashes with
   counts and sends them, sorted and packed, to hash ranges; each range is
   merged and written.  A word's number is its place in the sorted hashes.
2. Pairs.  With the vocabulary mapped, tasks count distinct pairs
   ``first * size + second`` and send them to shards by their first word.  A
   first word that holds more than a small share of all tokens is spread over
   all shards by its second words, so no shard grows with one word.
3. Per-word statistics (how many different words follow once, twice, more
   often, and how many precede) are summed by vocabulary range.

The driver sees one row of totals per shard.  Nothing is pruned or capped;
every count and file grows with the corpus.
"""

from __future__ import annotations

import atexit
import os
import shutil
import uuid
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .common import small_batches, table
from .labelled import held_out
from .textops import fmix, slices, to_batch, word_bounds, word_hashes

U = np.uint64
END, BEGIN = U(0x0E4D0E4D0E4D0E4D), U(0xBE61BE61BE61BE61)   # the end token, and what stands before the first word
FLUSH = 4_000_000                                            # tokens a task gathers before it sends


# -- packing of sorted whole numbers: differences by byte planes, so that the shuffle's compression removes the zero planes

def pack(x: np.ndarray) -> bytes:
    d = np.diff(x, prepend=x.dtype.type(0))
    return d.view(np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes()


def unpack(b: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.cumsum(np.frombuffer(b, np.uint8).reshape(size, -1).T.copy().view(dtype).ravel(), dtype=dtype)


def planes(x: np.ndarray) -> bytes:
    return x.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()


def unplanes(b: bytes) -> np.ndarray:
    return np.frombuffer(b, np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel()


def merge(keys: np.ndarray, *counts: np.ndarray) -> list[np.ndarray]:
    """Distinct sorted keys and the sums of their counts."""
    if not len(keys):
        return [keys, *[c.astype(np.int64) for c in counts]]
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return [keys[first], *[np.add.reduceat(c[order].astype(np.int64), first) for c in counts]]


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the shared checkpoint folder, as a path that every worker can map."""
    at = urlparse(checkpoint_dir(spark))
    if at.scheme not in ("", "file"):
        raise ValueError(f"the language model maps its files into memory: spark.checkpoint.dir must be mounted, not {at.scheme}")
    path = os.path.join(at.path, f"kneser-ney-{uuid.uuid4().hex}")
    os.makedirs(path)
    return path


def save(path: str, array: np.ndarray) -> None:
    """Write raw values under a temporary name first, so a repeated task leaves a whole file."""
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        f.write(np.ascontiguousarray(array).data)
    os.replace(part, path)


def load(path: str, dtype) -> np.ndarray:
    return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)


class Model:
    """Where the files are, the totals, and lookups for workers."""

    def __init__(self, path: str, shards: int):
        self.path, self.shards = path, shards
        self.offsets = np.zeros(shards + 1, np.int64)   # number of the first word of each vocabulary range
        self.tokens = self.words = self.documents = self.pair_types = 0
        self.hot = np.zeros(0, np.int64)                # first words spread over all shards
        self.pair_discounts = self.word_discounts = (0.0, 0.0, 0.0)
        self.uniform_weight = 1.0

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def _file(self, name: str, dtype) -> np.ndarray:
        cache = self.__dict__.setdefault("_open", {})
        if name not in cache:
            cache[name] = load(f"{self.path}/{name}", dtype)
        return cache[name]

    @property
    def size(self) -> int:
        return int(self.offsets[-1])

    def range_of(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes >> U(32)) * U(self.shards) >> U(32)).astype(np.int64)

    def _each_range(self, which: np.ndarray):
        order = np.argsort(which, kind="stable")
        cut = np.searchsorted(which[order], np.arange(self.shards + 1))
        for s in np.unique(which).tolist():
            yield s, order[cut[s]:cut[s + 1]]

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word, -1 if training did not have it."""
        distinct, back = np.unique(hashes, return_inverse=True)
        out = np.full(len(distinct), -1, np.int64)
        for s, at in self._each_range(self.range_of(distinct)):
            known = self._file(f"word-{s}.hash", np.uint64)
            if len(known):
                place = np.minimum(np.searchsorted(known, distinct[at]), len(known) - 1)
                out[at] = np.where(known[place] == distinct[at], self.offsets[s] + place, -1)
        return out[back]

    def word_values(self, numbers: np.ndarray, name: str, dtype) -> np.ndarray:
        """A per-word value of known words, 0 for number -1."""
        distinct, back = np.unique(numbers, return_inverse=True)
        out = np.zeros(len(distinct), np.int64)
        known = distinct >= 0
        which = np.searchsorted(self.offsets, distinct[known], "right") - 1
        place = np.flatnonzero(known)
        for s, at in self._each_range(which):
            out[place[at]] = self._file(f"word-{s}.{name}", dtype)[distinct[place[at]] - self.offsets[s]]
        return out[back]

    def shard_of(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        x = first.astype(np.uint64)
        x = np.where(np.isin(first, self.hot), fmix(x) + second.astype(np.uint64), x)
        return ((fmix(x) >> U(32)) * U(self.shards) >> U(32)).astype(np.int64)

    def pair_counts(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """How often training has each pair of numbered words (0 if either is unknown)."""
        out = np.zeros(len(first), np.int64)
        known = np.flatnonzero((first >= 0) & (second >= 0))
        keys = first[known].astype(np.uint64) * U(self.size) + second[known].astype(np.uint64)
        distinct, back = np.unique(keys, return_inverse=True)
        n = np.zeros(len(distinct), np.int64)
        which = self.shard_of((distinct // U(self.size)).astype(np.int64), (distinct % U(self.size)).astype(np.int64))
        for s, at in self._each_range(which):
            have = self._file(f"pair-{s}.key", np.uint64)
            if len(have):
                place = np.minimum(np.searchsorted(have, distinct[at]), len(have) - 1)
                c = self._file(f"pair-{s}.count", np.uint8)[place].astype(np.int64)
                large = np.flatnonzero(c == 255)
                if len(large):
                    c[large] = self._file(f"pair-{s}.large", np.int64)[
                        np.searchsorted(self._file(f"pair-{s}.place", np.int64), place[large])]
                n[at] = np.where(have[place] == distinct[at], c, 0)
        out[known] = n[back]
        return out


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """The three discounts from the numbers of types seen once to four times, each within its count."""
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.0
    d = [i - (i + 1) * y * b / a if a else i * 0.5 for i, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1)]
    return tuple(min(max(x, 0.0), float(i)) for i, x in enumerate(d, 1))


def _discounted(count: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return count - np.array([0.0, *d])[np.minimum(count, 3)]


def _sequences(column: pa.Array):
    """Per slice: hashes of all words and an end per text, the number of tokens of each text."""
    for s in slices(column):
        starts, ends, first = word_bounds(s)
        w = word_hashes(s, starts, ends)
        n = np.diff(first) + 1
        at = np.cumsum(n) - 1                       # places of the ends
        out = np.empty(int(n.sum()), np.uint64)
        out[at] = END
        out[np.setdiff1d(np.arange(len(out)), at, assume_unique=True)] = w
        yield out, n


def _before(numbers: np.ndarray, n: np.ndarray, begin: int) -> np.ndarray:
    """The word before each token; the first of a text follows the beginning."""
    out = np.empty_like(numbers)
    out[1:] = numbers[:-1]
    out[np.cumsum(n) - n] = begin
    return out


VOCAB = pa.schema([("shard", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])


def _send(m: Model, keys: np.ndarray, counts: np.ndarray, which: np.ndarray):
    rows = [(s, pack(keys[at]), planes(counts[at])) for s, at in m._each_range(which)]
    return to_batch(VOCAB, [list(x) for x in zip(*rows)] if rows else [[], [], []])


def _gather(batches, tokens_of, finish):
    """Run ``finish`` over about FLUSH tokens at a time."""
    held, size = [], 0
    for b in batches:
        for x in tokens_of(b.column("text")):
            held.append(x)
            size += len(x[0])
            if size >= FLUSH:
                yield finish(held)
                held, size = [], 0
    if held:
        yield finish(held)


def _count_words(m: Model):
    def finish(held):
        k, c = np.unique(np.concatenate([w for w, _ in held]), return_counts=True)
        return _send(m, k, c, m.range_of(k))

    def run(batches):
        yield from _gather(batches, _sequences, finish)
    return run


def _merge_words(m: Model):
    def run(key, t):
        s = key[0].as_py()
        keys = [unpack(b, np.uint64) for b in t.column("keys").to_pylist()]
        counts = [unplanes(b) for b in t.column("counts").to_pylist()]
        for special in (BEGIN,) if m.range_of(np.array([BEGIN]))[0] == s else ():
            keys.append(np.array([special]))
            counts.append(np.zeros(1, np.uint32))
        k, c = merge(np.concatenate(keys), np.concatenate(counts))
        save(f"{m.path}/word-{s}.hash", k)
        save(f"{m.path}/word-{s}.count", c)
        return pa.table({"shard": pa.array([s], pa.int32()), "words": [len(k)], "tokens": [int(c.sum())]})
    return run


def _count_pairs(m: Model):
    begin = int(m.number(np.array([BEGIN]))[0])

    def finish(held):
        w = m.number(np.concatenate([x for x, _ in held]))
        v = _before(w, np.concatenate([n for _, n in held]), begin)
        k, c = np.unique(v.astype(np.uint64) * U(m.size) + w.astype(np.uint64), return_counts=True)
        return _send(m, k, c, m.shard_of((k // U(m.size)).astype(np.int64), (k % U(m.size)).astype(np.int64)))

    def run(batches):
        yield from _gather(batches, _sequences, finish)
    return run


STATS = pa.schema([("range", pa.int32()), ("numbers", pa.binary()), ("once", pa.binary()), ("twice", pa.binary()),
                   ("more", pa.binary()), ("before", pa.binary()), ("counts", pa.list_(pa.int64()))])
STATS_DDL = "range int, numbers binary, once binary, twice binary, more binary, before binary, counts array<long>"


def _merge_pairs(m: Model):
    def run(key, t):
        s = key[0].as_py()
        k, c = merge(np.concatenate([unpack(b, np.uint64) for b in t.column("keys").to_pylist()]),
                     np.concatenate([unplanes(b) for b in t.column("counts").to_pylist()]))
        large = np.flatnonzero(c >= 255)
        save(f"{m.path}/pair-{s}.key", k)
        save(f"{m.path}/pair-{s}.count", np.minimum(c, 255).astype(np.uint8))
        save(f"{m.path}/pair-{s}.place", large)
        save(f"{m.path}/pair-{s}.large", c[large])
        first, second = (k // U(m.size)).astype(np.int64), (k % U(m.size)).astype(np.int64)
        word, once, twice, more, before = merge(
            np.concatenate([first, second]), *[np.concatenate([x, np.zeros(len(k), np.int64)]) for x in (c == 1, c == 2, c > 2)],
            np.concatenate([np.zeros(len(k), np.int64), np.ones(len(k), np.int64)]))
        rows = [(r, pack(word[at]), *[planes(x[at]) for x in (once, twice, more, before)], None)
                for r, at in m._each_range(np.searchsorted(m.offsets, word, "right") - 1)]
        rows.append((-1, *[None] * 5, [len(k), *[int((c == i).sum()) for i in (1, 2, 3, 4)]]))
        return pa.Table.from_batches([to_batch(STATS, [list(x) for x in zip(*rows)])])
    return run


def _merge_stats(m: Model):
    def run(key, t):
        r = key[0].as_py()
        total = np.zeros(5, np.int64)
        if r < 0:
            total = np.array(t.column("counts").to_pylist()).sum(axis=0)
        else:
            size = int(m.offsets[r + 1] - m.offsets[r])
            at = np.concatenate([unpack(b, np.int64) for b in t.column("numbers").to_pylist()]) - m.offsets[r]
            for name in ("once", "twice", "more", "before"):
                v = np.bincount(at, np.concatenate([unplanes(b) for b in t.column(name).to_pylist()]), size).astype(np.int64)
                save(f"{m.path}/word-{r}.{name}", v)
            total[1:] = [int((v == i).sum()) for i in (1, 2, 3, 4)]
            total[0] = int((v >= 3).sum())
        return pa.table({"range": pa.array([r], pa.int32()), "counts": pa.array([total.tolist()], pa.list_(pa.int64()))})
    return run


def _hot_words(m: Model, share: float):
    """Numbers of the words with more than ``share`` of all tokens, found where the counts are."""
    limit = share * max(m.tokens, 1)

    def run(batches):
        for b in batches:
            for s in b.column("shard").to_pylist():
                at = np.flatnonzero(load(f"{m.path}/word-{s}.count", np.int64) > limit) + m.offsets[s]
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64())], ["number"])
    return run


def train(docs: DataFrame, shards: int | None = None, path: str | None = None) -> Model:
    """Count the texts of ``docs`` (column ``text``) and write the model's files.

    ``shards`` defaults to the session's shuffle partitions.  Without ``path``
    the files go to a new folder under the shared checkpoint folder that is
    removed when the driver ends.
    """
    spark = docs.sparkSession
    small_batches(spark)
    if path is None:
        path = shared_folder(spark)
        atexit.register(shutil.rmtree, path, ignore_errors=True)
    m = Model(path, shards or int(spark.conf.get("spark.sql.shuffle.partitions")))
    text = docs.select("text")
    # every range has a row, so that empty ranges are written too
    every = spark.range(m.shards).select(F.col("id").cast("int").alias("shard"), F.lit(b"").alias("keys"), F.lit(b"").alias("counts"))
    done = text.mapInArrow(_count_words(m), "shard int, keys binary, counts binary").union(every) \
        .groupBy("shard").applyInArrow(_merge_words(m), "shard int, words long, tokens long").collect()
    sizes = np.zeros(m.shards, np.int64)
    for r in done:
        sizes[r.shard] = r.words
    m.offsets = np.concatenate(([0], np.cumsum(sizes)))
    m.words, m.tokens = m.size - 1, sum(r.tokens for r in done)
    m.hot = np.sort(np.array([r.number for r in every.select("shard").mapInArrow(
        _hot_words(m, 1 / (4 * m.shards)), "number long").collect()], np.int64))
    stats = text.mapInArrow(_count_pairs(m), "shard int, keys binary, counts binary").union(every) \
        .groupBy("shard").applyInArrow(_merge_pairs(m), STATS_DDL)
    blank = F.lit(b"")
    stats = stats.union(every.select("shard", *[blank] * 5, F.lit(None).cast("array<long>")))
    totals = stats.groupBy("range").applyInArrow(_merge_stats(m), "range int, counts array<long>").collect()
    n = np.zeros(5, np.int64)
    for r in totals:
        if r.range < 0:
            m.pair_types, m.pair_discounts = r.counts[0], discounts(*r.counts[1:])
        else:
            n += np.array(r.counts)
    m.word_discounts = discounts(*n[1:].tolist())
    d = m.word_discounts
    if m.pair_types:
        m.uniform_weight = (d[0] * n[1] + d[1] * n[2] + d[2] * n[0]) / m.pair_types
    end = m.number(np.array([END]))
    m.documents = int(m.word_values(end, "count", np.int64)[0])
    return m


class Scorer:
    """Log10 probabilities of texts, looked up in the mapped files."""

    def __init__(self, m: Model):
        self.m = m

    def _tokens(self, w: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count of each token and its log10 probability after the word before it."""
        m = self.m
        begin = int(m.number(np.array([BEGIN]))[0])
        number = m.number(w)
        count = m.word_values(number, "count", np.int64)
        low = self.m.uniform_weight / (m.words + 1)
        if not m.pair_types:
            return count, np.full(len(w), np.log10(low))
        # level 1: how many different words stand before the word
        p = np.maximum(_discounted(m.word_values(number, "before", np.int64), m.word_discounts), 0) / m.pair_types + low
        # level 2, where the word before is known
        v = _before(number, n, begin)
        total = np.where(v == begin, m.documents, m.word_values(v, "count", np.int64))
        follow = sum(d * m.word_values(v, name, np.int64) for d, name in zip(m.pair_discounts, ("once", "twice", "more")))
        own = np.maximum(_discounted(m.pair_counts(v, number), m.pair_discounts), 0)
        seen = total > 0
        p[seen] = (own[seen] + follow[seen] * p[seen]) / total[seen]
        return count, np.log10(p)

    def rows(self, column: pa.Array):
        """n_tokens, n_known, base score and score of each text."""
        m = self.m
        out = [[], [], [], []]
        floor = m.tokens + 0.5 * (m.words + 1)
        for w, n in _sequences(column):
            count, logp = self._tokens(w, n)
            of = np.repeat(np.arange(len(n)), n)
            base = np.log10((count + 0.5) / floor)
            for c, x in zip(out, (n, np.bincount(of, count > 0, len(n)), np.bincount(of, base, len(n)), np.bincount(of, logp, len(n)))):
                c.append(x)
        return [np.concatenate(c) if c else np.zeros(0) for c in out]


SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                    ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def score(docs: DataFrame, m: Model) -> DataFrame:
    """Rows of ``docs`` (doc_id, held_out, text) with the model's log10 probability of the text.

    Perplexity is ``10 ** (-score / n_tokens)``.
    """
    small_batches(docs.sparkSession)
    scorer = Scorer(m)

    def run(batches):
        for b in batches:
            n, known, base, s = scorer.rows(b.column("text"))
            yield to_batch(SCORES, [b.column("doc_id"), b.column("held_out"), n.astype(np.int64), known.astype(np.int64),
                                    np.full(len(n), m.tokens, np.int64), base, s])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "text").mapInArrow(
        run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def lm_scores(docs: DataFrame) -> DataFrame:
    """Train on the documents outside the held-out fold (crc32 of the id mod 5 is 1) and score all.

    Defined cases: null text counts as empty and has one token, its end; a
    null doc_id trains and is not held out; repeated rows train each time and
    get equal scores; words that training lacks share the unknown word's
    probability; with nothing to train on every token has the uniform
    probability; an empty table gives an empty result.
    """
    docs = docs.select("doc_id", "text").withColumn("held_out", held_out(F.col("doc_id"), 5, 1))
    return score(docs, train(docs.where(~F.col("held_out"))))


def op7_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 7 over all documents."""
    return lm_scores(table(spark, sf_dir, "documents", "doc_id", "text"))
