"""Content hashes, leak-safe splits, overlaps, shared cells, clusters and components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut
from .spatial import cell


def duplicates(df: DataFrame, key: str, content: Column) -> DataFrame:
    """key, canonical (smallest key with equal content), size of every row whose content occurs more than once.

    The groups are summed before they meet the rows again, so a large group is
    one row of the small side of a join that adaptive execution can split.
    """
    d = df.select(key, F.sha2(content, 256).alias("_h"))
    groups = d.groupBy("_h").agg(F.min(key).alias("canonical"), F.count("*").alias("size")).where("size > 1")
    return d.join(groups, "_h").select(key, "canonical", "size")


def leak_safe_split(df: DataFrame, key: str, content: Column, every: int = 5, at: int = 2) -> DataFrame:
    """key, part: train, holdout, leaked (a holdout row whose content is in train) or repeated (in the holdout already)."""
    d = df.select(key, F.sha2(F.coalesce(content, F.lit("")), 256).alias("_h"), (F.pmod(F.col(key), F.lit(every)) == at).alias("_held"))
    g = d.groupBy("_h").agg(F.bool_or(~F.col("_held")).alias("_train"), F.min(F.when(F.col("_held"), F.col(key))).alias("_first"))
    part = F.when(~F.col("_held"), "train").when(F.col("_train"), "leaked").when(F.col(key) > F.col("_first"), "repeated").otherwise("holdout")
    return d.join(g, "_h").select(key, part.alias("part"))


def folds(df: DataFrame, key: str, k: int) -> DataFrame:
    """df with fold: a hash of the key, so a fold needs no order over all rows."""
    return df.withColumn("fold", F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long") % k)


def overlaps(df: DataFrame, by: str, key: str, start: str, end: str, width: int) -> DataFrame:
    """by, a, b, overlap of all pairs of intervals of one key that overlap, a before b.

    An interval is listed in every bucket of that width that it touches; a pair
    counts in the bucket where its overlap begins, so only neighbours in time meet.
    """
    last = F.greatest(F.floor((F.col(end) - 1) / width), F.floor(F.col(start) / width))
    listed = df.select(by, F.struct(key, start, end).alias("x"), F.explode(F.sequence(F.floor(F.col(start) / width), last)).alias("_bucket"))
    x, y = listed, listed.withColumnRenamed("x", "y")
    begins = F.floor(F.greatest(F.col("x")[start], F.col("y")[start]) / width) == F.col("_bucket")
    pairs = x.join(y, [by, "_bucket"]).where(begins & (F.col("x")[key] < F.col("y")[key]) & (F.col("x")[start] < F.col("y")[end]) & (F.col("y")[start] < F.col("x")[end]))
    shared = F.least(F.col("x")[end], F.col("y")[end]) - F.greatest(F.col("x")[start], F.col("y")[start])
    return pairs.select(by, F.col("x")[key].alias("a"), F.col("y")[key].alias("b"), shared.alias("overlap"))


#: Sets that are compared at once, cells of the sets of a block, and the least number of blocks if there are more sets than SIDE.
SIDE, BLOCK_CELLS, BLOCKS = 2048, 1 << 21, 8
#: A meeting in lists costs as much as so many comparisons within blocks; keys up to this many are broadcast.
MEETING, BROADCAST_KEYS = 50, 200_000


class Part:
    """Some sets as entries (row, cell), by cell."""

    def __init__(self, names: pa.Array, n: np.ndarray, ids: list[np.ndarray]):
        self.names, self.n = names, n
        cells = np.concatenate(ids)
        order = np.argsort(cells, kind="stable")
        self.rows = np.repeat(np.arange(len(ids)), [len(x) for x in ids])[order]
        self.cells, self.begin, self.often = np.unique(cells[order], return_index=True, return_counts=True)

    def shared(self, other: Part) -> np.ndarray:
        """How many cells each two sets share: common cells by a product of matrices, rare ones one by one."""
        out = np.zeros((len(self.n), len(other.n)), np.float32)
        _, a, b = np.intersect1d(self.cells, other.cells, True, True)
        dense = self.often[a] * other.often[b] * 8 > out.size * 0.07 - 8000
        wide = []
        for part, at in ((self, a[dense]), (other, b[dense])):
            many = part.often[at]
            x = np.zeros((len(part.n), len(at)), np.float32)
            entries = np.repeat(part.begin[at] - np.cumsum(many) + many, many) + np.arange(many.sum())
            x[part.rows[entries], np.repeat(np.arange(len(at)), many)] = 1
            wide.append(x)
        out += wide[0] @ wide[1].T
        for i, j in zip(a[~dense].tolist(), b[~dense].tolist(), strict=True):
            out[self.rows[self.begin[i] : self.begin[i] + self.often[i], None], other.rows[other.begin[j] : other.begin[j] + other.often[j]]] += 1
        return out


def _compared(least: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (i, j, side, c, n, ids) come sorted: a block (side 0), then the sets that pass it; a block without passing sets meets itself."""
    task, held = None, []

    def parts(batch):
        for a in range(0, batch.num_rows, SIDE):
            own = batch.slice(a, SIDE)
            yield Part(own.column("c"), np.asarray(own.column("n")), [np.asarray(x.values) for x in own.column("ids")])

    def links(x, y):
        shared = x.shared(y)
        n = np.minimum(x.n[:, None], y.n)
        holds = (shared >= n * least) & (shared > 0)
        i, j = np.nonzero(np.triu(holds, 1) if x is y else holds)
        return pa.RecordBatch.from_arrays([x.names.take(pa.array(i)), y.names.take(pa.array(j)), pa.array(shared[i, j].astype(np.int64)), pa.array(n[i, j])], ["c", "d", "shared", "n"])

    def close():
        if task is not None and task[0] == task[1]:
            for k, x in enumerate(held):
                for y in held[k:]:
                    yield links(x, y)

    for batch in batches:
        place = np.stack([np.asarray(batch.column(x)) for x in ("i", "j", "side")], axis=1)
        cuts = np.flatnonzero((place[1:] != place[:-1]).any(1)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(place)], strict=True):
            if a == b:
                continue
            now, own = tuple(place[a, :2].tolist()), batch.slice(a, b - a)
            if now != task:
                yield from close()
                task, held = now, []
            if place[a, 2] == 0:
                held.extend(parts(own))
            else:
                for y in parts(own):
                    for x in held:
                        yield links(x, y)
    yield from close()


def compared(classes: DataFrame, least: float, cells: int, count: int) -> DataFrame:
    """c, d, shared, n of the classes (c, n, ids) that share at least `least` of the smaller: every two blocks meet in one task,
    that holds one of them; no pair is written that fails.  cells: of all sets together; count: of classes."""
    blocks = max(-(-cells // BLOCK_CELLS), BLOCKS if count > SIDE else 1)
    at = classes.select("c", "n", "ids", F.pmod(F.xxhash64("c"), F.lit(blocks)).alias("k"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("o"))
    at = at.select(F.least("k", "o").alias("i"), F.greatest("k", "o").alias("j"), (F.col("k") > F.col("o")).cast("int").alias("side"), "c", "n", "ids")
    # one partition a meeting, as each is long
    rows = at.repartition(blocks * (blocks + 1) // 2, "i", "j").sortWithinPartitions("i", "j", "side")
    kind = dict(classes.dtypes)["c"]
    return rows.mapInArrow(lambda it: _compared(least, it), f"c {kind}, d {kind}, shared long, n long")


def shared_cells(df: DataFrame, key: str, cells: list[str], least: float) -> DataFrame:
    """a, b, shared, ratio: common cells of two keys over the smaller set, for keys whose ratio is at least `least`.

    Keys of equal sets are one class, and only classes are compared.  The smaller set of such a pair has one of the common
    cells among its rarest n - ceil(least n) + 1, so only those are looked up in the other sets.  A set travels with its
    cells, as sorted numbers, so that a pair is judged where it meets and counts at its first common cell; pairs that fail
    are written nowhere.  Where sets have so much in common that the lists would meet more than all pairs do, blocks of sets are
    compared instead.  A cell with a null is one of its set, but common to none.
    """
    sets = df.where(F.col(key).isNotNull()).select(key, *cells).distinct()
    often = sets.dropna(subset=cells).groupBy(*cells).agg(F.count("*").alias("_often"))
    # the rarer, the smaller; the numbers are read from the checkpoint, so they stay
    ids = cut(often.orderBy("_often", *cells).select(*cells, F.monotonically_increasing_id().alias("_id")))
    coded = sets.join(ids, cells, "left").groupBy(key).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("_id")).alias("ids"))
    coded = cut(coded)
    classes = cut(coded.groupBy("n", "ids").agg(F.min(key).alias("c"), F.count("*").alias("m")))
    first = F.greatest(F.size("ids") - F.ceil(F.col("n") * least) + 1, F.lit(0)).cast("int")
    a = classes.select("c", "n", "ids", F.posexplode(F.slice("ids", F.lit(1), first)).alias("_at", "_id"))
    b = classes.select(F.col("c").alias("d"), F.col("n").alias("nd"), F.col("ids").alias("others"), F.explode("ids").alias("_id"))
    often = a.groupBy("_id").agg(F.count("*").alias("_a")).join(b.groupBy("_id").agg(F.count("*").alias("_b")), "_id")
    cost = often.agg(F.sum(F.col("_a").cast("double") * F.col("_b")).alias("meetings"), F.sum("_b").alias("cells")).first()
    count = classes.count()
    if (cost.meetings or 0) * MEETING > count * count / 2:
        links = compared(classes.where("size(ids) > 0"), least, cost.cells, count)
    else:
        smaller = (F.col("n") < F.col("nd")) | ((F.col("n") == F.col("nd")) & (F.col("c") < F.col("d")))
        met = a.join(b, "_id").where(smaller & ~F.arrays_overlap(F.slice("ids", F.lit(1), F.col("_at")), "others"))
        links = met.select("c", "d", F.size(F.array_intersect("ids", "others")).cast("long").alias("shared"), "n")
    several = classes.where("m > 1")
    if not several.isEmpty():
        links = links.unionByName(several.where("size(ids) > 0").select("c", F.col("c").alias("d"), F.size("ids").cast("long").alias("shared"), "n"))
    links = links.where(F.col("shared") >= F.col("n") * least).withColumnsRenamed({"c": "a", "d": "b"})
    if not several.isEmpty():
        of = coded.join(classes.select("n", "ids", "c"), ["n", "ids"]).select(F.col(key).alias("_key"), F.col("c").alias("_c"))
        of = F.broadcast(of) if coded.count() <= BROADCAST_KEYS else of
        one = links.join(of, F.col("a") == F.col("_c")).select(F.col("a").alias("_a"), F.col("_key").alias("a"), "b", "shared", "n")
        links = one.join(of, F.col("b") == F.col("_c")).where("_a <> b or a < _key").select("a", F.col("_key").alias("b"), "shared", "n")
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "shared", (F.col("shared") / F.col("n")).alias("ratio"))


#: Slices over which the edges of one node are spread.
SLICES = 64


def to_least(edges: DataFrame, least: Column, which: Column) -> tuple[DataFrame, DataFrame]:
    """Edges (v, least of u) for the edges (u, v) of a kind, and (u, least) per node u.  The edges of one node are spread over
    slices where its least meets them, so that the centre of a star is not one task."""
    own = edges.withColumn("_s", F.pmod(F.xxhash64("v"), F.lit(SLICES)).cast("int"))
    found = own.groupBy("u").agg(least.alias("m"), F.bit_or(F.expr("shiftleft(1L, _s)")).alias("_has"))
    dealt = found.select("u", "m", F.explode(F.filter(F.sequence(F.lit(0), F.lit(SLICES - 1)), lambda i: F.getbit("_has", i) == 1)).alias("_s"))
    return own.where(which).join(dealt, ["u", "_s"]).select(F.col("v").alias("u"), F.col("m").alias("v")), found.select("u", F.col("m").alias("v"))


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node reachable by edges (a, b).

    Alternates large-star and small-star steps until the edges no longer change,
    which a chain of n nodes does in about log n rounds; a loop (a, a) makes a
    node of its own.  Lineage is cut each round by a checkpoint.
    """
    up = lambda d: d.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    given = edges.where("a is not null and b is not null").select(F.col("a").alias("u"), F.col("b").alias("v"))
    nodes = cut(given.select(F.col("u").alias("node")).union(given.select("v")).distinct())
    e, seen = cut(up(given)), None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = up(to_least(both, F.least(F.min("v"), F.first("u")), F.col("v") > F.col("u"))[0])
        moved, least = to_least(large, F.min("v"), F.lit(True))
        e = cut(up(moved.unionByName(least)))
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return nodes.join(stars, "node", "left").select("node", F.coalesce("label", "node").alias("label"))


def linked_in_line(df: DataFrame, by: str, x: str, gap: float, tie: str) -> DataFrame:
    """df with cluster: single-link clusters on a line, a new one where the next value is more than gap away."""
    w = Window.partitionBy(by).orderBy(x, tie)
    far = F.coalesce(F.col(x) - F.lag(x).over(w) > gap, F.lit(False)).cast("int")
    return df.withColumn("_far", far).withColumn("cluster", F.sum("_far").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_far")


def first_fit(df: DataFrame, by: str, key: str, x: str, y: str, radius: float) -> DataFrame:
    """by, key, cluster: in key order, an unused point opens a cluster and absorbs all unused within radius.

    In rounds over cells of the radius: the smallest undecided key of a cell opens if those of the eight cells around are
    larger; then all undecided points within radius of what has opened are decided.  A point belongs to the smallest opener
    within radius.  Points meet openers only, which are more than the radius apart, so a cell sees a fixed number of them
    however many points it holds.  Keys are unique within a group; rows with a null group, key or place have no cluster and
    no row.
    """
    at = df.select(by, F.col(key).cast("long").alias("_k"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).where(f"`{by}` is not null and _k is not null and _x is not null and _y is not null")
    whole = cut(at.withColumns({"_cx": cell(F.col("_x"), radius), "_cy": cell(F.col("_y"), radius)}))
    place = [by, "_cx", "_cy"]
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    around = lambda d: d.withColumn("_d", F.explode(steps)).withColumns({"_cx": F.col("_cx") + F.col("_d.i"), "_cy": F.col("_cy") + F.col("_d.j")}).drop("_d")
    seen = lambda d: around(d).groupBy(*place).agg(F.collect_list(F.struct("_k", "_x", "_y")).alias("_near"))
    holds = lambda o: (F.sqrt((F.col("_x") - o["_x"]) ** 2 + (F.col("_y") - o["_y"]) ** 2) <= radius) | (F.col("_k") == o["_k"])
    left, openers = whole, None
    while not left.isEmpty():
        least = cut(left.groupBy(*place).agg(F.min_by(F.struct("_k", "_x", "_y"), "_k").alias("_o")).select(*place, "_o.*"))
        opens = cut(least.join(around(least).groupBy(*place).agg(F.min("_k").alias("_k")), [*place, "_k"], "left_semi"))
        openers = opens if openers is None else openers.unionByName(opens)
        left = cut(left.join(seen(opens), place, "left").where(~F.coalesce(F.exists("_near", holds), F.lit(False))).drop("_near"))
    own = F.col("_k").cast(dict(df.dtypes)[key]).alias(key)
    if openers is None:
        return whole.select(by, own, F.col("_k").alias("cluster"))
    return whole.join(seen(openers), place).select(by, own, F.array_min(F.transform(F.filter("_near", holds), lambda o: o["_k"])).alias("cluster"))
