"""Near-duplicate groups by SuperMinHash signatures, banding, verification on full sets and union-find.

Signatures.  Every n-gram of a set draws one pseudo-random permutation of the
slots; in round j it offers to its j-th slot a value between j and j + 1, and a
slot keeps the least value offered.  As the ranks of one n-gram are a
permutation, a set's slots are filled evenly, which lowers the variance against
independent hashes.  A set stops early: when every slot holds a value of the
rounds done, later rounds cannot change it; a long text needs one round.  All
n-grams of a batch of texts draw together, a round being a few numpy steps.

Banding.  The signature is cut into bands; sets that agree in a whole band
meet in its bucket.  Rows per band follow the threshold: a pair at the
threshold that agrees in no band has a chance below MISS.  In a bucket two sets
are joined if their sizes allow a link and their sketches (two bits a slot)
agree in so many slots that a pair at the threshold has a chance below MISS to
agree in fewer; only a spanning forest of these pairs leaves the bucket, and in
a bucket of more than BUCKET_MOST sets all are joined with the first.

Verification.  The connected groups are families.  A family is cut by set size
into blocks, and full sets are compared, exactly.  First every block meets
itself and the block next to it.  Where a family of several blocks is not yet
one group, only the sets outside its largest group go on to the other blocks:
what is in one group already needs no more comparison, so a large group of near
copies costs no square.  Links that hold are joined by union-find rounds.

Defined results: a null or wordless text has an empty set and links with
nothing; a text shorter than n words is one n-gram; equal sets are one class,
represented by its smallest document; rows of one doc_id are one document,
linked by any of its texts, and each row is returned; rows without doc_id link
with nothing, have no component and are kept; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, join_spread, mix64
from .graph import components
from .jaccard import BROADCAST_IDS, LINKS, WHOLE, _blocks, _full, near_blocks, shingles, with_blocks

#: Slots of a signature; the chance with which a step may miss a pair at the threshold.
SLOTS, MISS = 128, 1e-9
#: A bucket of more sets is joined through its first one.
BUCKET_MOST = 512
#: N-grams drawn together.
TOGETHER = 1 << 16


def band_rows(percent: int) -> int:
    """The most rows a band may have."""
    t = percent / 100
    return max([1, *(r for r in range(1, 9) if (1 - t**r) ** (SLOTS // r) <= MISS)])


def least_agreement(percent: int) -> int:
    """The fewest slots in which two-bit sketches of a pair at the threshold agree, but for a chance below MISS (a Chernoff bound)."""
    p = 0.25 + 0.75 * percent / 100
    for c in range(int(SLOTS * p), 0, -1):
        q = c / SLOTS
        if q < p and SLOTS * (q * log(q / p) + (1 - q) * log((1 - q) / (1 - p))) >= -log(MISS):
            return c
    return 0


def signatures(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """The SuperMinHash signature of each set of distinct hashes, a row each; the round is in the highest byte of a value."""
    sizes = np.array([len(s) for s in sets], np.int64)
    out = np.full((len(sets), slots), np.uint64(0xFFFFFFFFFFFFFFFF))
    flat, own = np.concatenate([np.zeros(0, np.uint64), *sets]), np.repeat(np.arange(len(sets)), sizes)
    docs, places = np.flatnonzero(sizes), None
    for j in range(slots):
        if not len(flat):
            break
        draw = mix64(flat + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        k = j + (mix64(draw ^ np.uint64(0xD6E8FEB86659FD93)) % np.uint64(slots - j)).astype(np.int64)
        at = np.arange(len(flat))
        slot = k if places is None else places[at, k].astype(np.int64)
        np.minimum.at(out.ravel(), own * slots + slot, (np.uint64(j) << np.uint64(56)) | (draw >> np.uint64(8)))
        open_ = (out[docs].max(axis=1) >> np.uint64(56)) > np.uint64(j)
        alive = np.zeros(len(sets), bool)
        docs = docs[open_]
        alive[docs] = True
        stay = alive[own]
        if places is None:
            places = np.tile(np.arange(slots, dtype=np.uint8), (int(stay.sum()), 1))
        else:
            places = places[stay]
        flat, own, k = flat[stay], own[stay], k[stay]
        at = np.arange(len(flat))
        places[at, k] = places[at, j]  # a step of a Fisher-Yates shuffle; place j is done with
    return out


def bands_of(signature: np.ndarray, rows: int) -> np.ndarray:
    """The keys of the bands of each signature."""
    n = signature.shape[1] // rows
    key = np.broadcast_to(mix64(np.arange(1, n + 1, dtype=np.uint64)), (len(signature), n))
    for r in range(rows):
        key = mix64(key * np.uint64(0x9FB21C651E98DF25) + signature[:, r : n * rows : rows])
    return key


def sketch_of(signature: np.ndarray) -> np.ndarray:
    """Two bits of each slot, packed into 64-bit words."""
    bits = np.stack([(signature >> np.uint64(1)) & np.uint64(1), signature & np.uint64(1)], axis=2).astype(np.uint8)
    return np.packbits(bits.reshape(len(signature), -1), axis=1).view(np.uint64)


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many slots sketches (last axis) agree."""
    x = a ^ b
    return 32 * x.shape[-1] - np.bitwise_count((x | x >> np.uint64(1)) & np.uint64(0x5555555555555555)).sum(axis=-1, dtype=np.int64)


WORDS = SLOTS // 32
SETS = "doc_id long, n_shingles long, set_key binary, code array<long>"


def _sets(k: int, rows: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size, key and code (sketch, then bands) of each text's set."""

    def coded(ids: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch:
        sig = signatures(sets)
        code = np.concatenate([sketch_of(sig), bands_of(sig, rows)], axis=1).view(np.int64)
        keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * code.shape[1], pa.int32()), pa.array(code.ravel()))
        return pa.RecordBatch.from_arrays([ids, pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), lists], ["doc_id", "n_shingles", "set_key", "code"])

    for batch in batches:
        ids, held, n, a = batch.column("doc_id"), [], 0, 0
        for h in shingles(batch.column("text"), k):
            held.append(np.unique(h))
            n += len(held[-1])
            if n > TOGETHER or len(held) == 1024:
                yield coded(ids.slice(a, len(held)), held)
                a, held, n = a + len(held), [], 0
        if held:
            yield coded(ids.slice(a, len(held)), held)


MET = "u long, v long"


def forest(near: np.ndarray) -> np.ndarray:
    """For each node of a symmetric adjacency matrix, the first node of its group."""
    first = np.full(len(near), -1)
    for i in range(len(near)):
        if first[i] < 0:
            group = edge = near[i] | (np.arange(len(near)) == i)
            while edge.any():
                edge = near[edge].any(axis=0) & ~group
                group = group | edge
            first[group] = i
    return first


def _buckets(percent: int, most: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, n, rep, sketch words) come sorted by key and n; out come pairs that join what may link."""
    least = least_agreement(percent)

    def pairs(u, v):
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    def met(key, n, rep, sketch):
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        size = np.diff(edge)
        two = edge[:-1][size == 2]
        two = two[(100 * n[two] >= percent * n[two + 1]) & (agreement(sketch[two], sketch[two + 1]) >= least)]
        us, vs = [rep[two]], [rep[two + 1]]
        for a, m in zip(edge[:-1][size > 2].tolist(), size[size > 2].tolist(), strict=True):
            own = rep[a : a + m]
            if m > most:
                us.append(np.repeat(own[:1], m - 1))
                vs.append(own[1:])
                continue
            s, w = n[a : a + m], sketch[a : a + m]
            fit = 100 * np.minimum(s[:, None], s) >= percent * np.maximum(s[:, None], s)
            first = forest(fit & (agreement(w[:, None], w[None]) >= least))
            other = np.flatnonzero(first != np.arange(m))
            us.append(own[first[other]])
            vs.append(own[other])
        u, v = np.concatenate(us), np.concatenate(vs)
        return pairs(u[u != v], v[u != v])

    held, hub = None, None  # the last list, which may go on; key and first set of a list that is too long
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [np.asarray(batch.column(x)) for x in ("key", "n", "rep")] + [np.stack([np.asarray(batch.column(f"w{i}")) for i in range(WORDS)], axis=1).view(np.uint64)]
        if hub is not None:
            own = int((now[0] == hub[0]).sum())
            yield pairs(np.full(own, hub[1]), now[2][:own])
            if own == len(now[0]):
                continue
            now, hub = [x[own:] for x in now], None
        if held is not None:
            now = [np.concatenate(x) for x in zip(held, now, strict=True)]
        cut = int(np.argmax(now[0] == now[0][-1]))
        if cut:
            yield met(*(x[:cut] for x in now))
        held = [x[cut:] for x in now]
        if len(held[0]) > most:
            hub = (held[0][0], held[2][0])
            yield pairs(np.full(len(held[0]) - 1, hub[1]), held[2][1:])
            held = None
    if held is not None:
        yield met(*held)


def meet(whole: DataFrame, held: DataFrame, passing: DataFrame, percent: int) -> DataFrame:
    """Links between the blocks held (family, block, i, j) and the sets that pass them (family, rep, i, j)."""
    one = whole.join(held, ["family", "block"]).select("family", "i", "j", F.lit(0).alias("side"), "lead", "rep", "tokens")
    two = whole.join(passing, ["family", "rep"]).select("family", "i", "j", F.lit(1).alias("side"), "lead", "rep", "tokens")
    rows = one.unionByName(two).repartition("family", "i", "j").sortWithinPartitions("family", "i", "j", "side", "lead", "rep").drop("lead")
    return rows.mapInArrow(lambda it: _blocks(percent, it), LINKS).where("v is not null").select("u", "v")


def confirmed(rows: DataFrame, families: DataFrame, k: int, percent: int, scratch: Scratch) -> DataFrame:
    """rep and label of the classes (families: rep, n, family) that link with another, compared on full sets."""
    placed = scratch.keep(with_blocks(families), "placed")
    near = scratch.keep(near_blocks(placed, percent), "near")
    small = placed.count() <= BROADCAST_IDS
    texts = rows.join(F.broadcast(placed) if small else placed, rows["doc_id"] == placed["rep"]).select("rep", "family", "block", "n", "text")
    whole = scratch.keep(texts.mapInArrow(lambda it: _full(k, it), WHOLE), "whole")

    beside = near.where("i < j").groupBy("family", "i").agg(F.min("j").alias("j"))
    own = near.where("i = j").select("family", F.col("j").alias("block"), "i", "j")
    held = own.unionByName(beside.select("family", F.col("j").alias("block"), "i", "j"))
    passing = placed.join(beside.withColumnRenamed("i", "block"), ["family", "block"]).select("family", "rep", F.col("block").alias("i"), "j")
    links = scratch.keep(meet(whole, held, passing, percent), "links")
    labels = components(links, scratch, "first").withColumnRenamed("node", "rep")
    rest = near.where("i < j").join(beside, ["family", "i", "j"], "left_anti")
    if rest.isEmpty():
        return labels
    # families of many blocks: what is outside the largest group passes the blocks it has not met
    several = placed.join(rest.select("family").distinct(), "family").join(labels, "rep", "left").select("family", "block", "rep", F.coalesce("label", "rep").alias("label"))
    largest = several.groupBy("family", "label").agg(F.count("*").alias("c")).groupBy("family").agg(F.max_by("label", F.struct("c", -F.col("label"))).alias("largest"))
    outside = scratch.keep(several.join(largest, "family").where("label <> largest").select("family", "block", "rep"), "outside")
    both = rest.select("family", F.col("i").alias("block"), F.col("j").alias("other")).unionByName(rest.select("family", F.col("j").alias("block"), F.col("i").alias("other")))
    passing = outside.join(both, ["family", "block"]).select("family", "rep", F.col("other").alias("i"), F.lit(-1).cast("long").alias("j"))
    held = passing.select("family", F.col("i").alias("block"), "i", "j").distinct()
    more = scratch.keep(meet(whole, held, passing, percent), "more")
    return components(links.unionByName(more), scratch, "second").withColumnRenamed("node", "rep")


def near_copies(docs: DataFrame, k: int = 5, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs (doc_id, text).

    Documents whose sets of k-word n-grams have a Jaccard similarity of at
    least percent / 100 link; component_id is the smallest doc_id reachable,
    and that document is kept.
    """
    scratch, per_band, most = Scratch(docs.sparkSession, "minhash"), band_rows(percent), BUCKET_MOST
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = scratch.keep(rows.mapInArrow(lambda it: _sets(k, per_band, it), SETS), "sets")
    full = sets.where("n_shingles > 0 and doc_id is not null")
    reps = scratch.keep(full.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("code").alias("code")), "reps")
    sketch = [F.element_at("code", i + 1).alias(f"w{i}") for i in range(WORDS)]
    banded = reps.select(F.explode(F.slice("code", WORDS + 1, SLOTS // per_band)).alias("key"), "n", "rep", *sketch)
    banded = banded.repartition("key").sortWithinPartitions("key", "n", "rep")
    met = banded.mapInArrow(lambda it: _buckets(percent, most, it), MET)
    family = components(met, scratch, "families")
    families = family.join(reps.select("rep", "n"), F.col("node") == F.col("rep")).select("rep", "n", F.col("label").alias("family")).distinct()
    labels = confirmed(rows, scratch.keep(families, "of"), k, percent, scratch)
    scratch.drop("whole")
    classes = reps.select("set_key", "rep").join(labels, "rep", "left").select("set_key", F.coalesce("label", "rep").alias("component"))
    found = join_spread(sets.select("doc_id", "n_shingles", "set_key"), classes, ["set_key"], "doc_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
