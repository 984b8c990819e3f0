"""Exact Jaccard join of word n-gram sets, and the groups its links form.

Equal sets are one class, represented by its smallest document; all else works
on classes, so copies are never paired.

Order.  The n-grams are counted in buckets, over all documents.  N-grams of
crowded buckets are common, all others rare.  Every set is ordered rare first, then by how common,
then by hash.  Two sets that link share an n-gram among the first
|s| - ceil(t |s|) + 1 of both (the prefix).

Rare lists.  If the first shared n-gram is rare, the pair meets in that
n-gram's list.  Lists are sorted by set size and position.  For each entry the
blocks of sizes that cannot link are skipped, and a pair opens only at a list
where its positions leave room for the overlap it needs.  All lists count: of
the set whose prefix ends first in the order, every n-gram up to there that the
other has as well was met, so the number of meetings and the rest of that set
bound the overlap; a pair goes on only if they reach what it needs.

Common part.  If the first shared n-gram is common, both sets consist of common
n-grams but for a share of 1 - t: near copies of one text.  Such sets meet
through one class that has the n-gram in its prefix, and so do the sets of a
rare list of more than LIST_MOST entries: pairs never follow a list's square.

Families.  The connected groups of what has met are families; a link never
leaves one.  A family is cut by set size into blocks of bounded weight, and the
whole sets of every two blocks that sizes allow to link are brought together
once: one block is held as lists of n-grams, the other streams past.  The
overlaps of a set with the whole block are derived from those of the highly
similar set before it, by the lists of the n-grams in which the two differ.
Counts of links, and only those links that join two groups, leave the blocks.

Keys that may be hot (a class of copies, the centre of a star, a set size) are
spread over slices wherever rows meet them.

Defined results: a null or wordless text has an empty set and links with
nothing; a shorter text than n words is one n-gram; rows of one doc_id are one
document, linked by any of its texts, and each row is returned; rows without
doc_id link with nothing and have no component; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import RangeHash, Scratch, join_spread, joined, mix64, sieved, small_batches, text_slices, tidy, word_bounds
from .graph import components

#: Buckets of the n-gram counts as a power of two.  A task gives a row a bucket at most, so their number must not follow the input.
BITS = 18
#: Bytes hashed at once.
SLICE = 1 << 18
#: Weight of a block: n-grams of its sets, a set counting as BLOCK / BLOCK_SETS at least.
BLOCK, BLOCK_SETS = 1 << 20, 8192
#: A longer list meets through one of its classes; pairs made at once.
LIST_MOST, PAIRS_HELD = 512, 1 << 16
#: An n-gram is common if its bucket holds so many more than the mean, beside six deviations.
COMMON = 64
#: Rows of a few numbers up to this many are broadcast (some 16 MB); with more, texts go through a sieve and few are shuffled.
BROADCAST_IDS = 200_000

#: Lists and blocks are worked off in slices, so that no step shuffles much at once: entries of the lists in a slice, n-grams
#: of the blocks in a slice, and the most slices that the whole of the entries, or of the sets, is divided into.
SLICE_ENTRIES, SLICE_GRAMS, SLICES = 1 << 23, 1 << 25, 8

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shingles(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The n-gram hashes of each text, with repeats."""
    for a, b, docs in text_slices(column, SLICE):
        buf, begin, _ = joined(docs)
        start, end = word_bounds(LOWER[buf])
        word = RangeHash(LOWER[buf])(start, end)
        cut = np.searchsorted(start, np.append(begin, len(buf)))
        window = word
        for j in range(1, k):
            window = window[: len(word) - j] * np.uint64(0xA24BAED4963EE407) + word[j:] if len(word) > j else word[:0]
        window = mix64(window)
        for i in range(b - a):
            n = cut[i + 1] - cut[i]
            if n >= k:
                yield window[cut[i] : cut[i + 1] - k + 1]
            elif n:
                whole = np.array([n], np.uint64)
                for j in range(cut[i], cut[i + 1]):
                    whole = mix64(whole ^ word[j : j + 1]) * np.uint64(0x9FB21C651E98DF25)
                yield whole
            else:
                yield word[:0]


def _count(k: int, bits: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << bits, np.int32)
    held, n = [], 0

    def add():
        nonlocal counts
        found, times = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]) >> np.uint64(64 - bits), return_counts=True)
        counts[found.astype(np.int64)] += times.astype(np.int32)
        held.clear()

    for batch in batches:
        for h in shingles(batch.column("text"), k):
            held.append(h)
            n += len(h)
            if n > 1 << 19:
                add()
                n = 0
    add()
    found = np.flatnonzero(counts)
    for a in range(0, len(found), 1 << 16):
        part = found[a : a + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(counts[part].astype(np.int64))], ["bucket", "n"])


def common_levels(docs: DataFrame, k: int, scratch: Scratch) -> np.ndarray:
    """Per bucket: 0 if its n-grams are rare, else the order of its count."""
    bits = BITS
    counts = docs.select("text").mapInArrow(lambda it: _count(k, bits, it), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = scratch.keep(counts, "counts")
    mean = (counts.agg(F.sum("n")).first()[0] or 0) / (1 << bits)
    levels = np.zeros(1 << bits, np.uint8)
    # far fewer than the buckets: each is above the mean by so much
    for r in counts.where(F.col("n") > mean + 6 * mean**0.5 + COMMON).collect():
        levels[r.bucket] = int(np.log2(max(r.n, 1))) + 1
    scratch.drop("counts")
    return levels


def ordered(h: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, int]:
    """A set in the common order, and how many of it are rare."""
    u = np.unique(h)
    level = levels[(u >> np.uint64(65 - len(levels).bit_length())).astype(np.int64)]
    rare = int((level == 0).sum())
    return (u if rare == len(u) else u[np.lexsort((u, level))]), rare


SETS = "doc_id long, n_shingles long, set_key binary, n_rare long, prefix array<long>"


def _sets(k: int, percent: int, levels: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, keys, rares, prefixes = [], [], [], []
        for h in shingles(batch.column("text"), k):
            s, rare = ordered(h, levels)
            size = len(s)
            prefix = s[: size - (percent * size + 99) // 100 + 1] if size else s
            n.append(size)
            keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if size else None)
            rares.append(min(rare, len(prefix)))
            prefixes.append(prefix.view(np.int64))
        offsets = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])])
        flat = np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)
        arrays = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(rares, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_shingles", "set_key", "n_rare", "prefix"])


def needed(na, nb, percent: int):
    """The least overlap with which sets of these sizes link."""
    return -(-percent * (na + nb) // (100 + percent))


def prefix_length(n, percent: int):
    return n + (-percent * n) // 100 + 1


def list_pairs(n: np.ndarray, pos: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index pairs of one list, sorted by (n, pos), whose sizes can link; and which of them open there."""
    own = np.arange(len(n))
    count = np.searchsorted(n, 100 * n // percent, "right") - own - 1  # larger sizes are skipped
    i = np.repeat(own, count)
    j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
    return i, j, np.minimum(n[i] - pos[i], n[j] - pos[j]) >= needed(n[i], n[j], percent)


PAIRS = "a long, b long, lack long, opens int"
#: The end of a prefix that holds all rare n-grams of its set.
NO_END = np.iinfo(np.int64).max


def _lists(percent: int, most: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (token, rep, place, ends) come sorted by token and place; place holds size and position."""
    none = np.zeros(0, np.int64)

    def met(low, high, lack, opens):
        return pa.RecordBatch.from_arrays([pa.array(low), pa.array(high), pa.array(lack, pa.int64()), pa.array(opens.astype(np.int32))], ["a", "b", "lack", "opens"])

    def star(hub, reps):
        """Entries of a long list with its first one."""
        reps = reps[reps != hub]
        return met(np.minimum(reps, hub), np.maximum(reps, hub), np.zeros(len(reps), np.int64), np.ones(len(reps), bool))

    def judged(found, rep, n, ends):
        left, right, opens = (np.concatenate(x) for x in zip(*found, strict=True))
        keep = rep[left] != rep[right]
        left, right, opens = left[keep], right[keep], opens[keep]
        # how many meetings the overlap needs beside the rest of the set whose prefix ends first
        rest = lambda x: n[x] - prefix_length(n[x], percent)
        a, b = ends[left], ends[right]
        room = np.where(a < b, rest(left), np.where(b < a, rest(right), np.where(a == NO_END, NO_END, np.maximum(rest(left), rest(right)))))
        lack = np.where(room == NO_END, 0, needed(n[left], n[right], percent) - room)
        return met(np.minimum(rep[left], rep[right]), np.maximum(rep[left], rep[right]), lack, opens)

    def pairs(t, rep, place, ends):
        n, pos = place >> 31, place & ((1 << 31) - 1)
        edge = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1], [True]]))
        size = np.diff(edge)
        two = edge[:-1][size == 2]
        two = two[100 * n[two] >= percent * n[two + 1]]
        opens = np.minimum(n[two] - pos[two], n[two + 1] - pos[two + 1]) >= needed(n[two], n[two + 1], percent)
        found, held = [(two, two + 1, opens)], len(two)
        for a, m in zip(edge[:-1][size > 2], size[size > 2], strict=True):
            if m > most:
                yield star(rep[a], rep[a + 1 : a + m])
                continue
            i, j, o = list_pairs(n[a : a + m], pos[a : a + m], percent)
            found.append((i + a, j + a, o))
            held += len(i)
            if held > PAIRS_HELD:
                yield judged(found, rep, n, ends)
                found, held = [], 0
        if found:
            yield judged(found, rep, n, ends)

    held: list[np.ndarray] = []
    hub: tuple[int, int] | None = None  # token and first entry of a long list that goes on
    for batch in batches:
        now = [np.asarray(batch.column(x)) for x in ("token", "rep", "place", "ends")]
        if not len(now[0]):
            continue
        if held:
            now = [np.concatenate(x) for x in zip(held, now, strict=True)]
        if hub is not None:
            own = int(np.searchsorted(now[0] != hub[0], True))
            yield star(hub[1], now[1][:own])
            now = [x[own:] for x in now]
            if not len(now[0]):
                held = []
                continue
            hub = None
        cut = int(np.argmax(now[0] == now[0][-1]))  # the last list may go on in the next batch
        if cut:
            yield from pairs(*(x[:cut] for x in now))
        held = [x[cut:] for x in now]
        if len(held[0]) > most:
            hub = (int(held[0][0]), int(held[1][0]))
            yield star(hub[1], held[1][1:])
            held = []
    if held:
        yield from pairs(*held)
    else:
        yield star(0, none)


WHOLE = "rep long, family long, block long, lead binary, tokens binary"
SIDES = "rep long, family long, tasks array<struct<i: long, j: long, side: int>>, lead binary, tokens binary"


def _full(k: int, batches: Iterator[pa.RecordBatch], last: str = "block") -> Iterator[pa.RecordBatch]:
    """The whole sets of the classes that are wanted; of several texts of one document, those of the wanted size."""
    for batch in batches:
        sets = [np.unique(h) for h in shingles(batch.column("text"), k)]
        kept = np.flatnonzero(np.array([len(s) == n for s, n in zip(sets, batch.column("n").to_pylist(), strict=True)], bool))
        given = [batch.column(x).take(pa.array(kept)) for x in ("rep", "family", last)]
        lead, tokens = ([x.tobytes() for x in found] for found in ([sets[i][:4] for i in kept], [sets[i] for i in kept]))
        yield pa.RecordBatch.from_arrays([*given, pa.array(lead, pa.binary()), pa.array(tokens, pa.binary())], ["rep", "family", last, "lead", "tokens"])


class Block:
    """Sets as lists by n-gram, and the overlaps of a passing set with all of them."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        self.tokens, self.owner = flat[order], np.repeat(np.arange(len(sets), dtype=np.int32), self.sizes)[order]
        self.before, self.overlap = np.zeros(0, np.uint64), np.zeros(len(sets), np.int64)

    def tally(self, tokens: np.ndarray) -> np.ndarray:
        """How many of the tokens each of the sets has."""
        a, b = np.searchsorted(self.tokens, tokens), np.searchsorted(self.tokens, tokens, "right")
        n = b - a
        at = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return np.bincount(self.owner[at], minlength=len(self.sizes))

    def linked(self, s: np.ndarray, percent: int) -> np.ndarray:
        """Which of the sets link with s; derived from what the set before had."""
        gone, new = np.setdiff1d(self.before, s, True), np.setdiff1d(s, self.before, True)
        self.overlap = self.overlap - self.tally(gone) + self.tally(new) if len(gone) + len(new) < len(s) else self.tally(s)
        self.before = s
        return 100 * self.overlap >= percent * (len(s) + self.sizes - self.overlap)


class Links:
    """A spanning forest of links and the number of links of each class."""

    def __init__(self):
        self.up: dict[int, int] = {}
        self.pairs: list[tuple[int, int]] = []
        self.count: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(y, y)
        return x

    def add(self, name: int, others: np.ndarray) -> None:
        """Links between one class and others, other than itself."""
        if len(others):
            self.count[name] = self.count.get(name, 0) + len(others)
        for other in others.tolist():
            x, y = self.root(name), self.root(other)
            if x != y:
                self.up[y] = x
                self.pairs.append((name, other))


LINKS = "u long, v long, n long"


def _blocks(percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (family, i, j, side, lead, rep, tokens) come sorted: the block that is held (side 0), then the
    sets that pass it, similar ones together; a block meets itself without a second side.  Out come links
    (u, v) and, without v, counts of links (u, n)."""
    task, block, sets, links, seen = None, None, {}, Links(), set()
    names = degree = np.zeros(0, np.int64)

    def load():
        nonlocal block, names, degree
        names, degree = np.array([rep for rep, _ in sets], np.int64), np.zeros(len(sets), np.int64)
        block = Block([np.frombuffer(t, np.uint64) for _, t in sets]) if sets else None

    def close():
        if task is not None:
            if task[1] == task[2]:
                load()
                for at, (rep, t) in enumerate(sets):
                    hit = block.linked(np.frombuffer(t, np.uint64), percent)
                    hit[at] = False
                    links.add(rep, names[hit])
            for rep, n in zip(names.tolist(), degree.tolist(), strict=True):
                if n:
                    links.count[rep] = links.count.get(rep, 0) + n
            if links.count:
                us, ns = zip(*links.count.items(), strict=True)
                m = len(links.pairs)
                u = pa.array([p[0] for p in links.pairs] + list(us), pa.int64())
                v = pa.array([p[1] for p in links.pairs] + [None] * len(us), pa.int64())
                yield pa.RecordBatch.from_arrays([u, v, pa.array([0] * m + list(ns), pa.int64())], ["u", "v", "n"])

    for batch in batches:
        keys = zip(*(batch.column(x).to_pylist() for x in ("family", "i", "j", "side", "rep")), strict=True)
        tokens = batch.column("tokens")
        for at, (family, i, j, side, rep) in enumerate(keys):
            if (family, i, j) != task:
                yield from close()
                task, block, sets, links, seen = (family, i, j), None, {}, Links(), set()
                names = degree = np.zeros(0, np.int64)
            row = tokens[at].as_py()
            if side == 0:
                sets[rep, row] = None
                continue
            if block is None:
                load()
                sets = {}
            key = (rep, hashlib.blake2b(row, digest_size=16).digest())
            if block is None or key in seen:
                continue
            seen.add(key)
            hit = block.linked(np.frombuffer(row, np.uint64), percent)
            degree += hit
            links.add(rep, names[hit])
    yield from close()


def with_blocks(classes: DataFrame) -> DataFrame:
    """classes (rep, n, family) with block: sets of one family and near sizes, of bounded weight together.

    Sizes are laid end to end, smallest first, by their weights; a size too
    heavy for one block is dealt over several by hash.  Only sizes are put in
    order, not classes.
    """
    least = -(-BLOCK // BLOCK_SETS)
    sizes = classes.groupBy("family", "n").agg((F.count("*") * F.greatest(F.col("n"), F.lit(least))).alias("weight"))
    before = F.sum("weight").over(Window.partitionBy("family").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("weight")
    sizes = sizes.select("family", "n", F.floor(before / F.lit(BLOCK)).alias("base"), F.ceil(F.col("weight") / F.lit(BLOCK)).alias("parts"))
    dealt = join_spread(classes, sizes, ["family", "n"], "rep")
    return dealt.select("rep", "n", "family", (F.shiftleft(F.col("base"), 24) + F.pmod(F.xxhash64("rep"), F.col("parts"))).alias("block"))


def near_blocks(placed: DataFrame, percent: int) -> DataFrame:
    """family, i, j: the pairs of blocks whose set sizes allow a link; numbers only."""
    bounds = placed.groupBy("family", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    x, y = bounds.alias("x"), bounds.alias("y")
    near = x.join(y, (F.col("x.family") == F.col("y.family")) & (F.col("x.block") <= F.col("y.block")) & (F.col("x.high") * 100 >= F.col("y.low") * percent))
    return near.select(F.col("x.family").alias("family"), F.col("x.block").alias("i"), F.col("y.block").alias("j"))


def similar_groups(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links of every row of docs (doc_id, text).

    Documents whose sets of k-word n-grams have a Jaccard similarity of at
    least percent / 100 link; component_id is the smallest doc_id reachable.
    n_links counts the other classes that its class links with.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    levels = common_levels(rows, k, scratch)
    whole = scratch.keep(rows.mapInArrow(lambda it: _sets(k, percent, levels, it), SETS), "sets")
    sets = scratch.keep(whole.drop("n_rare", "prefix"), "members")
    full = F.expr("n_shingles > 0 and doc_id is not null")
    held = sets.where(full).groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.count("*").alias("m"))
    classes = scratch.keep(held, "classes")
    # a set that occurs once stays where it lies; the prefixes of others are shuffled
    split = sieved(whole.where(full), F.col("set_key"), classes.where("m > 1"), "set_key")
    several = split.where("_maybe").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("n_rare").alias("n_rare"), F.first("prefix").alias("prefix"))
    reps = split.where("not _maybe").select("set_key", F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), "n_rare", "prefix").unionByName(several)
    reps = scratch.keep(reps.drop("set_key"), "reps")
    scratch.drop("sets")
    del whole, split, several
    tidy(docs.sparkSession)

    # rare lists
    spilled = F.col("n_rare") < F.size("prefix")
    ends = F.when(spilled, F.lit(int(NO_END))).otherwise(F.shiftrightunsigned(F.element_at("prefix", -1), 1))
    most, met = LIST_MOST, None
    entries = reps.agg(F.sum("n_rare")).first()[0] or 0
    parts = min(SLICES, -(-entries // SLICE_ENTRIES)) or 1
    for part in range(parts):
        rare = F.posexplode(F.slice("prefix", F.lit(1), F.col("n_rare").cast("int"))).alias("pos", "token")
        listed = reps.select("rep", "n", ends.alias("ends"), rare).where(F.pmod(F.xxhash64("token"), F.lit(parts)) == part)
        listed = listed.select("token", "rep", (F.shiftleft("n", 31) + F.col("pos")).alias("place"), "ends").repartition("token").sortWithinPartitions("token", "place", "rep")
        met = listed.mapInArrow(lambda it: _lists(percent, most, it), PAIRS).groupBy("a", "b").agg(F.count("*").alias("c"), F.min("lack").alias("lack"), F.max("opens").alias("opens"))
        scratch.keep(met, f"met/{part}")
        del listed
        tidy(docs.sparkSession)
    met = docs.sparkSession.read.schema(met.schema).parquet(*(scratch.path(f"met/{part}") for part in range(parts)))
    met = met.groupBy("a", "b").agg(F.sum("c").alias("c"), F.min("lack").alias("lack"), F.max("opens").alias("opens"))
    pairs = met.where("opens = 1 and c >= lack").select("a", "b")

    # common part: the classes that have a common n-gram in their prefix meet the smallest of their slice, and those the smallest of all
    crowd = reps.where("n_rare < size(prefix)").select("rep", F.explode(F.expr("slice(prefix, cast(n_rare as int) + 1, size(prefix))")).alias("token"))
    crowd = crowd.withColumn("slice", F.pmod(F.xxhash64("rep"), F.lit(64)))
    least = crowd.groupBy("token", "slice").agg(F.min("rep").alias("b"))
    heads = least.join(least.groupBy("token").agg(F.min("b").alias("a")), "token").select("a", "b")
    met = pairs.unionByName(crowd.join(least, ["token", "slice"]).select(F.col("rep").alias("a"), "b")).unionByName(heads)
    met = scratch.keep(met.select(F.col("a").alias("u"), F.col("b").alias("v")), "edges")
    scratch.drop("reps")
    scratch.drop("met")

    family = components(met, scratch, "families")
    of = family.join(classes.select("rep", "n"), F.col("node") == F.col("rep")).select("rep", "n", F.col("label").alias("family")).distinct()
    placed = scratch.keep(with_blocks(scratch.keep(of, "of")), "placed")
    near = near_blocks(placed, percent)
    held = near.select("family", F.col("j").alias("block"), F.struct("i", "j", F.lit(0).alias("side")).alias("task"))
    passing = near.where("i < j").select("family", F.col("i").alias("block"), F.struct("i", "j", F.lit(1).alias("side")).alias("task"))
    near = scratch.keep(held.unionByName(passing), "near")
    # every meeting of two blocks is one slice's; each slice sees the texts that it needs, and shuffles their sets once
    weight = placed.groupBy("family", "block").agg(F.sum("n").alias("w"))
    once, all_ = weight.agg(F.sum("w")).first()[0] or 0, near.join(weight, ["family", "block"]).agg(F.sum("w")).first()[0] or 0
    parts = -(-all_ // max(SLICE_GRAMS, -(-once // SLICES))) or 1
    for part in range(parts):
        own = near.where(F.pmod(F.xxhash64("family", "task.i", "task.j"), F.lit(parts)) == part).groupBy("family", "block").agg(F.collect_list("task").alias("tasks"))
        wanted = scratch.keep(join_spread(placed, own, ["family", "block"], "rep").select("rep", "n", "family", "tasks"), f"wanted/{part}")
        if wanted.count() <= BROADCAST_IDS:
            texts = rows.join(F.broadcast(wanted), F.col("doc_id") == F.col("rep"))
        else:
            texts = sieved(rows, F.col("doc_id"), wanted, "rep").where("_maybe").join(wanted, F.col("doc_id") == F.col("rep"))
        whole = texts.select("rep", "family", "n", "tasks", "text").mapInArrow(lambda it: _full(k, it, "tasks"), SIDES)
        sides = whole.select("rep", "family", F.explode("tasks").alias("task"), "lead", "tokens").select("family", "task.*", "lead", "rep", "tokens")
        sides = sides.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j", "side", "lead", "rep").drop("lead")
        scratch.keep(sides.mapInArrow(lambda it: _blocks(percent, it), LINKS), f"links/{part}")
        scratch.drop(f"wanted/{part}")
        del own, wanted, texts, whole, sides
        tidy(docs.sparkSession)
    links = docs.sparkSession.read.schema(LINKS).parquet(*(scratch.path(f"links/{part}") for part in range(parts)))

    degree = links.where("v is null").groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("n_links"))
    labels = components(links.where("v is not null").select("u", "v"), scratch, "labels").withColumnRenamed("node", "rep")
    classes = classes.select("set_key", "rep").join(labels, "rep", "left").join(degree, "rep", "left")
    classes = classes.select("set_key", F.coalesce("label", "rep").alias("component"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    found = join_spread(sets.select("doc_id", "n_shingles", "set_key"), classes, ["set_key"], "doc_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.when(F.col("doc_id").isNotNull(), F.coalesce("n_links", F.lit(0))).alias("n_links"))


def keep_one_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that are the smallest doc_id of their group; equal rows of one
    document are one; rows without doc_id or words stay."""
    scratch = Scratch(docs.sparkSession, "one-each")
    groups = similar_groups(docs.select("doc_id", "text"), k, percent).where("doc_id is not null")
    marks = groups.groupBy(F.col("doc_id").alias("_id")).agg(F.max((F.col("component_id") < F.col("doc_id")).cast("int")).alias("_gone"), F.count("*").alias("_rows"))
    marks = scratch.keep(marks.where("_gone = 1 or _rows > 1"), "marks")
    several = marks.where("_gone = 0")
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col("doc_id").alias("_doc"))  # names of other columns cannot clash
    same = F.col("_doc") == F.col("_id")
    if marks.count() <= BROADCAST_IDS:
        once = whole.join(F.broadcast(marks), same, "left_anti")
        again = whole.join(F.broadcast(several), same, "left_semi")
    else:  # what no sieve marks stays where it lies
        split = sieved(whole, F.col("_doc").cast("long"), marks, "_id")
        once = split.where("not _maybe").unionByName(split.where("_maybe").join(marks, same, "left_anti"))
        again = sieved(whole, F.col("_doc").cast("long"), several, "_id").where("_maybe").join(several, same, "left_semi")
    once = once.select("_row.*")
    return once if several.isEmpty() else once.unionByName(again.select("_row.*").dropDuplicates())
