"""MinHash banding and exact linking of the sets that collide.

Shared by document and paragraph near-duplicates.  Sets are numpy arrays of
distinct 64-bit shingle hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, persist_shared
from .components import connected_components
from .textops import fmix

U = np.uint64


def tune(similarity: float, miss: float = 1e-6, max_hashes: int = 160) -> tuple[int, int]:
    """Bands and rows per band: the most selective banding (most rows) whose chance to miss
    a pair of exactly the wanted similarity is at most ``miss`` within ``max_hashes`` minima."""
    best = (max(1, math.ceil(math.log(miss) / math.log(1 - similarity))), 1)
    for r in range(2, 9):
        b = math.ceil(math.log(miss) / math.log(1 - similarity ** r))
        if b * r <= max_hashes:
            best = (b, r)
    return best


def hash_family(k: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and offsets of ``k`` multiply-shift hash functions."""
    g = np.random.default_rng(seed)
    return (g.integers(0, 1 << 63, k, dtype=np.uint64) * U(2) + U(1), g.integers(0, 1 << 63, k, dtype=np.uint64))


def minima(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The upper 32 bits of each hash function's minimum over the (non-empty) set."""
    low = np.full(len(a), ~U(0))
    for i in range(0, len(values), 1024):
        np.minimum(low, (a[:, None] * values[None, i:i + 1024] + b[:, None]).min(axis=1), out=low)
    return (low >> U(32)).astype(np.uint32)


def band_hashes(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit bucket per band; the band's number is part of it.  Works on one or many signatures."""
    m = sig.reshape(-1, bands, rows).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), m.shape[:2]).copy()
    for j in range(rows):
        h = fmix(h * U(0x9E3779B97F4A7C15) + m[:, :, j])
    return h.reshape(*sig.shape[:-1], bands).view(np.int64)


def similar(inter: np.ndarray, n_a, n_b, percent: int) -> np.ndarray:
    """Whether 100 * |intersection| >= percent * |union|, in whole numbers."""
    return 100 * inter >= percent * (n_a + n_b - inter)


class _Union:
    """Components over 0..n-1 as an array of labels (small groups inside a task)."""

    def __init__(self, labels: np.ndarray):
        self.label = np.unique(labels, return_inverse=True)[1]

    def join(self, i: int, js: np.ndarray) -> list[int]:
        """Join i with js; returns the js that brought in a new component."""
        new = []
        for j in js.tolist():
            if self.label[i] != self.label[j]:
                new.append(j)
                self.label[self.label == self.label[j]] = self.label[i]
        return new


def link_sets(ids: np.ndarray, sets: list[np.ndarray], percent: int,
              labels: np.ndarray | None = None, only: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Exact links inside a group: every pair of different components is compared on full sets.

    Returns links that span the components of the group's similarity graph.
    ``labels`` are components already known; ``only`` marks members of which
    each pair to be compared has at least one.  A member is compared with all
    others at once through a table of the group's shingles; members that are
    already connected to all that is left are not compared again.
    """
    if len(ids) == 2 and labels is None:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return [(int(ids[0]), int(ids[1]))] if ids[0] != ids[1] and similar(both, len(sets[0]), len(sets[1]), percent) else []
    n = np.array([len(s) for s in sets], np.int64)
    first = np.concatenate(([0], np.cumsum(n)[:-1]))
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
    mark = np.zeros(int(flat.max()) + 1, np.uint8)
    comp = _Union(ids if labels is None else labels)
    todo = np.ones(len(ids), bool) if only is None else only.copy()
    out = []
    while todo.any():
        left = np.flatnonzero(todo)
        if only is None:
            # stop when all members not yet compared are in one component
            names, sizes = np.unique(comp.label[left], return_counts=True)
            if len(names) == 1 and len(left) < len(ids):
                break
            out_of = left[comp.label[left] != names[sizes.argmax()]]
            i = int(out_of[0]) if len(out_of) else int(left[0])
        else:
            i = int(left[0])
        todo[i] = False
        if len(np.unique(comp.label)) == 1:
            break
        mine = flat[first[i]:first[i] + n[i]]
        mark[mine] = 1
        inter = np.add.reduceat(mark[flat], first, dtype=np.int64)
        mark[mine] = 0
        hit = np.flatnonzero(similar(inter, n[i], n, percent) & (comp.label != comp.label[i]))
        out += [(int(ids[i]), int(ids[j])) for j in comp.join(i, hit)]
    return out


def _signature_filter(percent: int, hashes: int, slack: float = 4.5):
    """Members of a group whose signature agrees well enough with another member's."""
    p = percent / 100
    need = p - slack * math.sqrt(p * (1 - p) / hashes)

    def run(t):
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(t.num_rows, hashes)
        ok = np.zeros(t.num_rows, bool)
        for i in range(t.num_rows - 1):
            hit = (sig[i + 1:] == sig[i]).mean(axis=1) >= need
            ok[i] |= hit.any()
            ok[i + 1:] |= hit
        return t.select(["leader", "id", "n"]).filter(pa.array(ok))
    return run


LINK_SCHEMA = "a long, b long"


def _links_batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"])


def _link_runs(percent: int, key: tuple[str, ...]):
    """Link the groups of equal key in sorted rows.  A group that a batch boundary cuts is carried
    over; groups are bounded by the chunking before."""
    def links_of(t: pa.Table) -> list[tuple[int, int]]:
        named = "root" in t.column_names
        return link_sets(t.column("id").to_numpy(), [np.frombuffer(x, np.uint64) for x in t.column("set").to_pylist()], percent,
                         t.column("root").to_numpy() if named else None,
                         t.column("loose").to_numpy(zero_copy_only=False) if named else None)

    def run(batches):
        carried = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if carried is None else pa.concat_tables([carried, t]).combine_chunks()
            if not t.num_rows:
                continue
            k = np.stack([t.column(c).to_numpy() for c in key])
            cut = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1).tolist()]
            out = []
            for i, j in zip(cut[:-1], cut[1:]):
                if j - i > 1:
                    out += links_of(t.slice(i, j - i))
            carried = t.slice(cut[-1])
            yield _links_batch(out)
        if carried is not None and carried.num_rows > 1:
            yield _links_batch(links_of(carried))
    return run


def _linked(rows: DataFrame, percent: int, *key: str) -> DataFrame:
    return rows.repartition(*key).sortWithinPartitions(*key, "id").mapInArrow(_link_runs(percent, key), LINK_SCHEMA)


def verified_members(reps: DataFrame, percent: int, hashes: int, group_rows: int = 4096) -> DataFrame:
    """(leader, id, n): which sets to compare with which, after banding and signatures.

    ``reps`` has id long, n int (set size), bands array<long>, sig binary (one
    byte of each minimum), one row per different set; it should be
    materialised.

    Every bucket names the member with the smallest hash as its leader (a
    map-side combined minimum).  Members that share a bucket share its leader,
    so comparing within the leaders' groups covers every pair that collides in
    any band.  Signature verification then drops members that agree with
    nobody in the group (groups of up to ``group_rows``; a larger group goes
    on whole).
    """
    band = reps.select("id", F.explode("bands").alias("bucket"))
    lead = band.groupBy("bucket").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct(F.xxhash64("id").alias("h"), "id")).alias("l")) \
        .where("c > 1").select("bucket", F.col("l.id").alias("leader"))
    members = persist_shared(band.join(lead, "bucket").select("leader", "id").distinct())
    size = members.groupBy("leader").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    full = members.join(size, "leader").join(reps.select("id", "n", "sig"), "id")
    return persist_shared(
        full.where(F.col("c") <= group_rows).groupBy("leader")
        .applyInArrow(_signature_filter(percent, hashes), "leader long, id long, n int")
        .union(full.where(F.col("c") > group_rows).select("leader", "id", "n")))


def exact_links(members: DataFrame, fetch_sets, percent: int, chunk_shingles: int = 1_000_000) -> DataFrame:
    """Links (a, b) that span the similarity graph within the groups of ``members`` (leader, id, n).

    ``fetch_sets(ids)`` returns (id, set binary) for the ids in a frame.

    1. Exact comparison on full sets, by group.  A group of more than
       ``chunk_shingles`` shingles is cut into chunks, each with the leader.
    2. Only for cut groups: members outside the group's largest component so
       far are compared with every chunk, block by block.

    No step emits pairs other than the spanning links.
    """
    # an id with two different texts has two sets; both are compared
    chunks = members.groupBy("leader").agg(F.ceil(F.sum("n") / chunk_shingles).cast("int").alias("chunks"))
    sets = fetch_sets(members.select("id").distinct())
    cut = members.select("leader", "id").distinct().join(chunks, "leader")
    part = F.pmod(F.xxhash64("id", F.lit(3)), F.col("chunks")).cast("int")
    rows = cut.join(sets, "id").withColumn("chunk", F.explode(
        F.when(F.col("id") == F.col("leader"), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array(part))))
    links = persist_shared(_linked(rows.select("leader", "chunk", "id", "set"), percent, "leader", "chunk"))
    large = persist_shared(cut.where("chunks > 1"))
    if large.isEmpty():
        return links
    comp = connected_components(links)
    named = persist_shared(large.join(comp.withColumnRenamed("node", "id"), "id", "left")
                           .withColumn("root", F.coalesce("root", "id")))
    main = named.groupBy("leader", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("leader") \
        .agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.sum("c").alias("members"), F.max("c").alias("most"))
    open_ = named.join(main.where("members > most"), "leader")
    loose = open_.where("root <> main").withColumn("k", part)
    # blocks: chunk j of all members against chunk k of the loose ones
    blocks = loose.select("leader", "k").distinct()
    every = open_.withColumn("j", part).join(blocks, "leader").select("leader", "j", "k", "id", "root", F.lit(False).alias("loose"))
    some = loose.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))) \
        .select("leader", "j", "k", "id", "root", F.lit(True).alias("loose"))
    more = _linked(every.union(some).join(sets, "id"), percent, "leader", "j", "k")
    return persist_shared(links.union(more))


def rows_with_ids(rows: DataFrame, ids: DataFrame, column: str = "id") -> DataFrame:
    """Rows whose id is in ``ids``: a broadcast semi-join up to the size bound, else a shuffled one."""
    n = ids.count()
    return rows.join(F.broadcast(ids) if n <= BROADCAST_ROWS else ids, column, "left_semi")
