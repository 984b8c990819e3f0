"""Approximate nearest neighbours: NN-descent builds the graph, greedy search answers.

Equal vectors are one node, so a large group of copies is one place of the
graph; a node keeps its `keep` smallest ids, which is all that an answer of
that length can show.  The graph starts from neighbours inside small chunks
around pivots, which come in two levels: a bounded number of pivots that every
task knows, and below each as many again as its cell needs, which are dealt to
the cell's rows by a shuffle.  In each round of descent every node gathers its
neighbours and those it is a neighbour of, and introduces them to each other: a
join of edges with vectors, a shuffle to the meeting node, and a top-k per
node.  A centre invites at most MEET guests a round, new ones first; an edge
stays new at either end until it was invited there, so the bound only puts off.
Rounds end when few edges are new.

A search keeps the best `beam` nodes of every query and expands the nearest
ones that are not expanded yet, by joins with edges and vectors, until none is
left; a node once measured for a query is not measured again.  It starts from
the pivots of both levels, and from the query's own node if it has one.

Inside the descent vectors are 32-bit numbers less a common centre, and each
group's distances are taken from its own mean, so that a shift of all vectors
costs no digits; what a search returns is measured on the original ones.

Defined results: vectors that are null, zero, of another length than most, or
hold a null or non-finite component take no part; rows without vec_id take no
part; rows of one vec_id with equal vectors are one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

DEGREE, MEET, CHUNK = 24, 48, 512
#: Pivots of the first level: one for so many nodes, up to a bound in number and bytes; each node joins the chunks of NEAR of them.
PIVOT_SHARE, PIVOTS, NEAR = 40, 1024, 8
#: Members of a cell that one task compares with the cell's pivots of the second level, in chunks.
CELL_SLICE = 64
BEAM, EXPAND = 384, 48
#: Vectors of queries or pivots up to so many bytes go to every task; more queries are joined by a shuffle.
BROADCAST_BYTES = 16 << 20
#: Descent ends when fewer edges than this share are new.
SETTLED = 0.02


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, keys, vecs, dims = [], [], [], []
        for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist(), strict=True):
            if i is None or not v or None in v:
                continue
            x = np.array(v, np.float64) + 0.0  # -0.0 becomes 0.0
            if np.isfinite(x).all() and x.any():
                raw = x.tobytes()
                ids.append(i)
                keys.append(hashlib.blake2b(raw, digest_size=16).digest())
                vecs.append(raw)
                dims.append(len(x))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array(vecs, pa.binary()), pa.array(dims, pa.int32())], ["vec_id", "key", "vec", "dim"])


def vectors(column, kind=np.float64) -> np.ndarray:
    """Rows of a binary column of vectors of one length."""
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1) if raw else np.zeros((0, 0))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of a to all of b, taken from the mean of b."""
    mean = b.mean(0, dtype=np.float64)
    a, b = a - mean, b - mean
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(d, 0))


def top(df: DataFrame, by: str, order: list, k: int) -> DataFrame:
    """The first k rows of each group; pre-selected before the shuffle."""
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


class Index:
    """nodes (node, vec), members (node, vec_id), edges (node, nbr), pivots, and cells: the pivots
    of the second level (pivot, slice, node, short) or None."""

    def __init__(self, nodes: DataFrame, members: DataFrame, edges: DataFrame, pivots: list, cells: DataFrame | None = None, slices: dict[int, int] | None = None):
        self.nodes, self.members, self.edges, self.pivots, self.cells, self.slices = nodes, members, edges, pivots, cells, slices or {}

    def centre(self) -> np.ndarray:
        return np.frombuffer(b"".join(p[1] for p in self.pivots), np.float64).reshape(len(self.pivots), -1).mean(0)


NEAREST = "id long, short binary, pivot int"


def _to_pivots(spots: np.ndarray, centre: np.ndarray, near: int, name: str, vec: str):
    """The nearest pivots of each vector, and the vector in short."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = vectors(batch.column(vec))
            if len(x):
                best = np.argsort(distances(x, spots), 1)[:, :near]
                short = pa.array([r.tobytes() for r in (x - centre).astype(np.float32)], pa.binary())
                for j in range(best.shape[1]):
                    yield pa.RecordBatch.from_arrays([batch.column(name), short, pa.array(best[:, j].astype(np.int32))], ["id", "short", "pivot"])

    return run


def _to_cells(take: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (pivot, slice, member, id, short) come sorted: the pivots of the second level, then members.
    Out come the members (id, short, pivot, sub, spot) with the place and node of their nearest `take` such pivots."""
    cell, ids, spots = None, [], []
    schema = ["id", "short", "pivot", "sub", "spot"]
    for batch in batches:
        keys = list(zip(*(batch.column(x).to_pylist() for x in ("pivot", "slice", "member")), strict=True))
        own, short = batch.column("id").to_pylist(), batch.column("short").to_pylist()
        at = 0
        while at < len(keys):
            end = at
            while end < len(keys) and keys[end] == keys[at]:
                end += 1
            if keys[at][:2] != cell:
                cell, ids, spots = keys[at][:2], [], []
            if not keys[at][2]:
                ids += own[at:end]
                spots += short[at:end]
            else:
                x = np.frombuffer(b"".join(short[at:end]), np.float32).reshape(end - at, -1)
                y = np.frombuffer(b"".join(spots), np.float32).reshape(len(ids), -1) if ids else x[:1]
                near = np.argsort(distances(x, y), 1)[:, :take]
                names = pa.array(ids or [None], pa.int64())
                for j in range(near.shape[1]):
                    n = end - at
                    yield pa.RecordBatch.from_arrays([pa.array(own[at:end], pa.int64()), pa.array(short[at:end], pa.binary()), pa.array([cell[0]] * n, pa.int32()), pa.array(near[:, j].astype(np.int32)), names.take(pa.array(near[:, j]))], schema)
            at = end


def with_cells(members: DataFrame, cells: DataFrame, slices: dict[int, int], take: int) -> DataFrame:
    """id, short, pivot, sub, spot of members (id, short, pivot): a cell's members are dealt over its slices, each with all its pivots."""
    several = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in slices.items() for x in pair)), F.col("pivot")), F.lit(1))
    dealt = members.select("pivot", F.pmod(F.xxhash64("id"), several).cast("int").alias("slice"), F.lit(True).alias("member"), "id", "short")
    rows = dealt.unionByName(cells.select("pivot", "slice", F.lit(False).alias("member"), F.col("node").alias("id"), "short"))
    rows = rows.repartition("pivot", "slice").sortWithinPartitions("pivot", "slice", "member", "id")
    return rows.mapInArrow(lambda it: _to_cells(take, it), "id long, short binary, pivot int, sub int, spot long")


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Groups of rows that come sorted by keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*held, batch])
        code = np.zeros(table.num_rows - 1, bool)
        for k in keys:
            col = table.column(k).to_numpy()
            code |= col[1:] != col[:-1]
        cuts = [0, *(np.flatnonzero(code) + 1)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield table.slice(a, b - a)
        held = table.slice(cuts[-1]).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


EDGES = "node long, nbr long, d double"


def _as_edges(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    parts = [np.concatenate(x) for x in zip(*rows, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in parts], ["node", "nbr", "d"])


def _chunk_edges(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in _grouped(batches, ["pivot", "sub"]):
        ids, x = t.column("id").to_numpy(), vectors(t.column("short"), np.float32)
        for a in range(0, len(ids), 4 * CHUNK):  # the size of a chunk is a matter of chance
            own, y = ids[a : a + 4 * CHUNK], x[a : a + 4 * CHUNK]
            if len(own) > 1:
                d = distances(y, y)
                np.fill_diagonal(d, np.inf)
                near = np.argsort(d, 1)[:, : min(k, len(own) - 1)]
                yield _as_edges([(np.repeat(own, near.shape[1]), own[near.ravel()], np.take_along_axis(d, near, 1).ravel())])


def _introduce(most: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """At each centre: pairs of its guests, one of them new, that are nearer than their worst neighbours."""
    out, held = [], 0
    for t in _grouped(batches, ["centre"]):
        ids, x = t.column("guest").to_numpy(), vectors(t.column("short"), np.float32)
        new, worst = t.column("fresh").to_numpy(), t.column("worst").to_numpy()
        d = distances(x, x)
        d[~(new[:, None] | new[None, :])] = np.inf
        np.fill_diagonal(d, np.inf)
        d[d >= worst[:, None]] = np.inf
        near = np.argsort(d, 1)[:, :most]
        far = np.take_along_axis(d, near, 1)
        i, j = np.nonzero(np.isfinite(far))
        if len(i):
            out.append((ids[i], ids[near[i, j]], far[i, j]))
            held += len(i)
        if held > 50_000:
            yield _as_edges(out)
            out, held = [], 0
    if out:
        yield _as_edges(out)


def build_index(vectors_: DataFrame, scratch: Scratch, degree: int = DEGREE, keep: int = 11, pivots: int = PIVOTS, chunk: int = CHUNK) -> Index:
    """The neighbour graph of every row of vectors_ (vec_id, embedding)."""
    rows = vectors_.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    clean = scratch.keep(rows.mapInArrow(_clean, "vec_id long, key binary, vec binary, dim int"), "clean")
    dims = clean.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(1).collect()
    dim = dims[0]["dim"] if dims else 0
    clean = clean.where(F.col("dim") == dim)
    kept = top(clean.select("key", "vec_id", "vec").distinct(), "key", ["vec_id"], keep)
    first = kept.groupBy("key").agg(F.min("vec_id").alias("node"))
    kept = scratch.keep(kept.join(first, "key").select("node", "vec_id", "vec"), "kept")
    members, nodes = kept.select("node", "vec_id"), scratch.keep(kept.where("node = vec_id").select("node", "vec"), "nodes")
    if nodes.isEmpty():
        return Index(nodes, members, clean.sparkSession.createDataFrame([], "node long, nbr long"), [])

    # pivots: those with the smallest hashes, a sample of bounded size, and below each as many again as its cell has chunks
    pivots = max(1, min(pivots, nodes.count() // PIVOT_SHARE, BROADCAST_BYTES // (8 * dim)))
    found = [(r.node, bytes(r.vec)) for r in nodes.orderBy(F.xxhash64("node"), "node").limit(pivots).collect()]
    spots = np.frombuffer(b"".join(v for _, v in found), np.float64).reshape(len(found), -1)
    near = scratch.keep(nodes.mapInArrow(_to_pivots(spots, spots.mean(0), NEAR, "node", "vec"), NEAREST), "near")
    shorts = scratch.keep(near.groupBy("id").agg(F.first("short").alias("short")).withColumnRenamed("id", "node"), "shorts")
    sizes = {r["pivot"]: r["count"] for r in near.groupBy("pivot").count().collect()}  # one row a pivot
    parts = {p: -(-n // chunk) for p, n in sizes.items()}
    slices = {p: -(-n // CELL_SLICE) for p, n in parts.items()}
    cells = None
    if max(parts.values()) > 1:
        share = F.element_at(F.create_map(*(F.lit(x) for p in sizes for x in (p, parts[p] / sizes[p] if parts[p] > 1 else 0.0))), F.col("pivot"))
        chosen = near.where(F.pmod(F.xxhash64("id", "pivot"), F.lit(1 << 30)) < share * (1 << 30))
        several = F.element_at(F.create_map(*(F.lit(x) for pair in slices.items() for x in pair)), F.col("pivot"))
        cells = scratch.keep(chosen.select("pivot", F.explode(F.sequence(F.lit(0), several - 1)).alias("slice"), F.col("id").alias("node"), "short"), "cells")
        chunks = with_cells(near, cells, slices, 1).select("id", "short", "pivot", "sub")
    else:
        chunks = near.withColumn("sub", F.lit(0))
    start = chunks.repartition("pivot", "sub").sortWithinPartitions("pivot", "sub").mapInArrow(lambda it: _chunk_edges(degree, it), EDGES)
    order = [F.col("d"), F.col("nbr")]
    # new to its own node (ahead) and to the neighbour (back) until invited there
    edges = top(start.dropDuplicates(["node", "nbr"]), "node", order, degree).withColumns({"ahead": F.lit(True), "back": F.lit(True)})
    edges = scratch.keep(edges, "edges-0")
    scratch.drop("near")

    n_edges, i = edges.count(), 0
    while True:
        i += 1
        both = edges.select(F.col("node").alias("centre"), F.col("nbr").alias("guest"), "d", F.col("ahead").alias("fresh")).unionByName(edges.select(F.col("nbr").alias("centre"), F.col("node").alias("guest"), "d", F.col("back").alias("fresh")))
        guests = both.groupBy("centre", "guest").agg(F.min("d").alias("d"), F.max("fresh").alias("fresh"))
        guests = scratch.keep(top(guests, "centre", [F.desc("fresh"), F.col("d"), F.col("guest")], MEET).drop("d"), f"guests-{i}")
        worst = edges.groupBy("node").agg(F.when(F.count("*") >= degree, F.max("d")).otherwise(F.lit(float("inf"))).alias("worst"))
        known = shorts.join(worst, "node", "left").select(F.col("node").alias("guest"), "short", F.coalesce("worst", F.lit(float("inf"))).alias("worst"))
        meet = guests.join(known, "guest").select("centre", "guest", "short", "worst", "fresh").repartition("centre").sortWithinPartitions("centre")
        # of what one centre proposes to a guest, only its nearest `degree` can be among the guest's neighbours
        met = meet.mapInArrow(lambda it: _introduce(degree, it), EDGES).groupBy("node", "nbr").agg(F.min("d").alias("d"))
        asked = guests.where("fresh")
        known_edges = edges.join(asked.select(F.col("centre").alias("node"), F.col("guest").alias("nbr"), F.lit(True).alias("a")), ["node", "nbr"], "left")
        known_edges = known_edges.join(asked.select(F.col("guest").alias("node"), F.col("centre").alias("nbr"), F.lit(True).alias("b")), ["node", "nbr"], "left")
        old = known_edges.select("node", "nbr", "d", (F.col("ahead") & F.col("a").isNull()).alias("ahead"), (F.col("back") & F.col("b").isNull()).alias("back"), F.lit(False).alias("new"))
        pool = old.unionByName(met.withColumns({"ahead": F.lit(True), "back": F.lit(True), "new": F.lit(True)}))
        pool = pool.groupBy("node", "nbr").agg(F.min("d").alias("d"), F.min("ahead").alias("ahead"), F.min("back").alias("back"), F.min("new").alias("new"))
        edges = scratch.keep(top(pool, "node", order, degree), f"edges-{i}")
        scratch.drop(f"edges-{i - 1}")
        scratch.drop(f"guests-{i}")
        if edges.where("new").count() <= SETTLED * n_edges:
            break
    # searched both ways: a node's own neighbours, and the nearest of those that have it as one
    back = edges.select(F.col("nbr").alias("node"), F.col("node").alias("nbr"), "d")
    graph = top(edges.select("node", "nbr", "d").unionByName(back).distinct(), "node", order, 2 * degree)
    return Index(nodes, members, scratch.keep(graph.select("node", "nbr"), "graph"), found, cells, slices)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        q, x = vectors(batch.column("qvec")), vectors(batch.column("vec"))
        d = np.sqrt(((q - x) ** 2).sum(1)) if len(q) else np.zeros(0)
        yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("node"), pa.array(d)], ["query_id", "node", "d"])


def starts_of(index: Index, queries: DataFrame) -> DataFrame:
    """query_id, node: where the search of each query begins."""
    own = queries.where("own is not null").select("query_id", F.col("own").alias("node"))
    if not index.pivots:
        return own
    ids, centre = [n for n, _ in index.pivots], index.centre()
    spots = np.frombuffer(b"".join(v for _, v in index.pivots), np.float64).reshape(len(ids), -1)
    near = queries.mapInArrow(_to_pivots(spots, centre, NEAR, "query_id", "qvec"), NEAREST)
    named = near.select(F.col("id").alias("query_id"), F.get(F.array(*map(F.lit, ids)), F.col("pivot")).alias("node"))
    if index.cells is not None:
        below = with_cells(near, index.cells, index.slices, 4).select(F.col("id").alias("query_id"), F.col("spot").alias("node"))
        named = named.unionByName(below.where("node is not null"))
    return named.unionByName(own).distinct()


def search(index: Index, queries: DataFrame, scratch: Scratch, k: int = 10, beam: int = BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row of queries (query_id, qvec, own).

    own is the node of the query's own row, or null; its vec_id is no answer to itself.
    """
    queries = scratch.keep(queries.select("query_id", "qvec", "own"), "queries")
    asked = queries.select("query_id", "qvec")
    size = queries.agg(F.sum(F.length("qvec") + 8)).first()[0] or 0
    asked = F.broadcast(asked) if size <= BROADCAST_BYTES else asked

    def measured(pairs: DataFrame) -> DataFrame:
        rows = pairs.join(index.nodes, "node").join(asked, "query_id")
        return rows.select("query_id", "node", "qvec", "vec").mapInArrow(_measure, "query_id long, node long, d double")

    order = [F.col("d"), F.col("node")]
    seen = [scratch.keep(measured(starts_of(index, queries)), "seen-0")]
    best, i = scratch.keep(top(seen[0], "query_id", order, beam).withColumn("open", F.lit(True)), "beam-0"), 0
    while True:
        turn = scratch.keep(top(best.where("open"), "query_id", order, EXPAND).select("query_id", "node"), f"turn-{i}")
        if turn.isEmpty():
            break
        i += 1
        ahead = turn.join(index.edges, "node").select("query_id", F.col("nbr").alias("node")).distinct()
        known = reduce(DataFrame.unionByName, (x.select("query_id", "node") for x in seen))
        fresh = scratch.keep(measured(ahead.join(known, ["query_id", "node"], "left_anti")), f"seen-{i}")
        seen.append(fresh)
        done = best.join(turn.withColumn("now", F.lit(True)), ["query_id", "node"], "left").select("query_id", "node", "d", (F.col("open") & F.col("now").isNull()).alias("open"))
        best = scratch.keep(top(done.unionByName(fresh.withColumn("open", F.lit(True))), "query_id", order, beam), f"beam-{i}")
        scratch.drop(f"beam-{i - 1}")
        scratch.drop(f"turn-{i - 1}")
    near = top(best, "query_id", order, k + 1)
    found = near.join(index.members, "node").where("vec_id <> query_id").select("query_id", "vec_id", F.col("d").alias("score"))
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_to_every(vectors_: DataFrame, every: int = 100, k: int = 10, **options) -> DataFrame:
    """The k nearest of every row whose vec_id is divisible by `every`, among all rows but itself."""
    scratch = Scratch(vectors_.sparkSession, "ann")
    index = build_index(vectors_, scratch, keep=k + 1, **options)
    asked = vectors_.where(F.col("vec_id") % every == 0).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    clean = asked.mapInArrow(_clean, "vec_id long, key binary, vec binary, dim int")
    own = index.nodes.select(F.col("node").alias("own"), F.col("vec").alias("qvec"))
    # the query's node: the one with an equal vector
    queries = clean.select(F.col("vec_id").alias("query_id"), F.col("vec").alias("qvec")).distinct().join(own, "qvec")
    return search(index, queries, scratch, k)
