"""Removal of passages that a document with a smaller id has as well.

Every byte covered by a string of `LENGTH` bytes that also starts in a document
with a smaller doc_id is removed.  Matches are judged on the input.

Pieces.  Each window of LENGTH bytes is anchored at its minimiser, the k-gram
in it with the smallest hash; consecutive windows with one anchor are a piece.
Equal windows have equal anchors, so only pieces of one anchor can share any.
Anchors go to partitions as hashes; equal pieces become one, in each task
before the shuffle and again behind it: all but those of the smallest document
are covered as a whole.

Suffix order.  Where an anchor has several different pieces, their texts are
brought together, sent to where the anchor stands in its smallest document, so
that neighbouring anchors meet and overlapping pieces become one stretch of
text.  The suffixes of these stretches are sorted by linear grouping (see
suffixes.py).  Suffixes with LENGTH equal bytes stand side by side; the
smallest document of such a run covers the others.  An anchor with more than
CROWDED different pieces (a common phrase) has its windows compared by 128-bit
hashes in a plain aggregate instead, which needs no group in one task.

Defined results: a null text is empty; rows without doc_id are left whole and
cover nothing; equal strings in one document, or in rows of one doc_id, cover
nothing; each row is returned; other columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RangeHash, Scratch, joined, mix64, slices, texts_as_bytes
from .suffixes import suffix_order

LENGTH, ANCHOR = 50, 24
CROWDED = 16_384
#: Bytes hashed at once; bytes of text of which suffixes are sorted together (lists that fit a core's cache).
SLICE, SORTED = 1 << 20, 24 << 10
#: Entries that a task holds before it deals them out.
HELD = 600_000

ENTRY = np.dtype([("anchor", "<u8"), ("piece", "<u8"), ("doc", "<i8"), ("tag", "<u4"), ("start", "<i4"), ("size", "u1"), ("at", "u1")])


def tag_of(text: bytes, tagged: bool) -> int:
    """Tells rows of one doc_id with different texts apart; 0 where no doc_id repeats."""
    return int.from_bytes(hashlib.blake2b(text, digest_size=4).digest(), "little") if tagged else 0


def pieces_of(docs: list[bytes]) -> tuple[np.ndarray, ...]:
    """doc index, start, end, anchor hash, piece hash and anchor's offset of the pieces of some texts of at most 2**24 bytes together."""
    buf, begin, end = joined(docs)
    span = LENGTH - ANCHOR + 1
    n = len(buf) - ANCHOR + 1
    none = np.zeros(0, np.int64)
    if n < span:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64), none
    hashed = RangeHash(buf)
    gram = hashed.rolling(ANCHOR)
    low = np.uint64((1 << 24) - 1)
    least = (gram & ~low) | np.arange(n, dtype=np.uint64)  # the leftmost of equal hashes is the least
    step = 1
    while 2 * step <= span:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if rest := span - step:
        least = np.minimum(least[:-rest], least[rest:])
    sizes = end - begin + 1
    room = np.repeat(end, sizes)[: len(least)]
    start = np.flatnonzero(room - np.arange(len(least)) >= LENGTH)
    doc, anchor = np.repeat(np.arange(len(docs)), sizes)[start], (least[start] & low).astype(np.int64)
    if not len(start):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64), none
    first = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)])
    a, b = start[first], start[np.append(np.flatnonzero(first)[1:], len(start)) - 1] + LENGTH
    return doc[first], a - begin[doc[first]], b - begin[doc[first]], gram[anchor[first]], hashed(a, b), anchor[first] - a


def _segments(ids: list, texts: list[bytes], tagged: bool) -> Iterator[tuple[list, list[bytes], list[int], list[int]]]:
    """Slices of texts; a very long text comes in segments that overlap by a window less one byte."""
    for a, b in slices([len(t) for t in texts], SLICE):
        if b - a == 1 and len(texts[a]) > 2 * SLICE:
            for s in range(0, len(texts[a]), SLICE):
                yield [ids[a]], [texts[a][s : s + SLICE + LENGTH - 1]], [tag_of(texts[a], tagged)], [s]
        else:
            yield ids[a:b], texts[a:b], [tag_of(t, tagged) for t in texts[a:b]], [0] * (b - a)


def _entries(batch: pa.RecordBatch, tagged: bool) -> Iterator[np.ndarray]:
    ids, texts = batch.column("doc_id").to_pylist(), texts_as_bytes(batch.column("text"))
    known = [i for i, x in enumerate(ids) if x is not None and len(texts[i]) >= LENGTH]
    for own, docs, tags, shift in _segments([ids[i] for i in known], [texts[i] for i in known], tagged):
        doc, start, end, anchor, piece, at = pieces_of(docs)
        out = np.empty(len(doc), ENTRY)
        out["anchor"], out["piece"], out["at"] = anchor, piece, at
        out["doc"], out["tag"] = np.array(own, np.int64)[doc], np.array(tags, np.uint32)[doc]
        out["start"], out["size"] = start + np.array(shift, np.int64)[doc], end - start
        yield out


def pack(e: np.ndarray) -> bytes:
    """Entries byte plane by byte plane, which lets the shuffle press the empty ones;
    documents as differences; 40 bits of the anchor and 48 of the piece."""
    planes = lambda x, n: x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].T.tobytes()
    step = np.diff(e["doc"], prepend=np.zeros(1, np.int64))
    return b"".join([len(e).to_bytes(4, "little"), planes(e["anchor"] >> np.uint64(24), 5), planes(e["piece"], 6), planes(step, 8), planes(e["tag"], 4), planes(e["start"], 4), planes(e["size"], 1), planes(e["at"], 1)])


def unpack(blob: bytes) -> np.ndarray:
    n, at = int.from_bytes(blob[:4], "little"), 4
    out = np.empty(n, ENTRY)

    def take(width):
        nonlocal at
        part = blob[at : at + width * n]
        at += width * n
        return part

    for name, width in (("anchor", 5), ("piece", 6), ("doc", 8), ("tag", 4), ("start", 4), ("size", 1), ("at", 1)):
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = np.frombuffer(take(width), np.uint8).reshape(width, n).T
        x = wide.view("<u8")[:, 0]
        out[name] = np.cumsum(x.view(np.int64)) if name == "doc" else x
    return out


def alike(e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Entries by anchor, piece, document; where anchors and pieces begin; and whether an entry's piece is in a smaller document."""
    e = e[np.lexsort((e["start"], e["doc"], e["piece"], e["anchor"]))]
    anchor = np.concatenate([[True], e["anchor"][1:] != e["anchor"][:-1]])
    piece = anchor | np.concatenate([[True], e["piece"][1:] != e["piece"][:-1]])
    least = e["doc"][np.flatnonzero(piece)][np.cumsum(piece) - 1]
    return e, anchor, piece, e["doc"] > least


PARTS = "part int, kind int, data binary"
SPAN = np.dtype([("doc", "<i8"), ("tag", "<u4"), ("start", "<i4"), ("size", "u1")])
REQUEST = np.dtype([("doc", "<i8"), ("tag", "<u4"), ("start", "<i4"), ("size", "u1"), ("at", "u1"), ("home", "<i8"), ("spot", "<i4")])
#: Documents whose ids differ in the last so many bits share the rows of a list.
NEAR_BITS = 6
#: Bytes of a document whose anchors are compared in one place.
HOME = 1 << 14
LISTS = "near long, kind int, data binary"


def _deal(parts: int, tagged: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind 0: entries packed for a part; kind 1: pieces that this task has found in a smaller document."""

    def flush(held, number):
        e = np.concatenate(held)
        order = np.lexsort((e["doc"], e["piece"]))
        piece = e["piece"][order]
        first = np.concatenate([[True], piece[1:] != piece[:-1]])
        covered = np.zeros(len(e), bool)
        covered[order] = e["doc"][order] > e["doc"][order][first][np.cumsum(first) - 1]
        gone, e = e[covered], e[~covered]
        part = (e["anchor"] >> np.uint64(24)) % np.uint64(parts)
        order = np.argsort(part, kind="stable")
        e, part = e[order], part[order].astype(np.int32)
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1), len(e)] if len(e) else [0]
        rows = [(int(part[a]), 0, pack(e[a:b])) for a, b in zip(cuts, cuts[1:], strict=False)]
        if len(gone):
            rows.append((number % parts, 1, pack(gone[np.lexsort((gone["start"], gone["doc"]))])))
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], ["part", "kind", "data"])

    held, n, number = [], 0, 0
    for batch in batches:
        for e in _entries(batch, tagged):
            if len(e):
                held.append(e)
                n += len(e)
                if n > HELD:
                    number += int(e["doc"][0])
                    yield flush(held, number)
                    held, n = [], 0
    if n:
        yield flush(held, number + int(held[0]["doc"][0]))


def as_lists(e: np.ndarray, kind: int, form: np.dtype, **more: np.ndarray) -> pa.RecordBatch:
    """One row per group of near documents: its entries in that form, end to end."""
    order = np.lexsort((e["start"], e["tag"], e["doc"]))
    e = e[order]
    near = e["doc"] >> NEAR_BITS
    first = np.flatnonzero(np.concatenate([[True], near[1:] != near[:-1]])) if len(e) else np.zeros(0, np.int64)
    data = np.empty(len(e), form)
    for name in form.names:
        data[name] = more[name][order] if name in more else e[name]
    offsets = np.append(first, len(e)).astype(np.int32) * form.itemsize
    lists = pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(near[first]), pa.array(np.full(len(first), kind, np.int32)), lists], ["near", "kind", "data"])


def _meet(crowded: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by part.  kind 0: covered pieces; 1: pieces to compare by suffixes; 2: by windows."""

    spans, asked = [], {1: [], 2: []}

    def out(most):
        """What is held, as lists, once it is more than most."""
        if sum(map(len, spans)) > most:
            yield as_lists(np.concatenate(spans), 0, SPAN)
            spans.clear()
        for kind, held in asked.items():
            if sum(len(x[0]) for x in held) > most:
                e, home, spot = (np.concatenate(x) for x in zip(*held, strict=True))
                yield as_lists(e, kind, REQUEST, home=home, spot=spot)
                held.clear()

    def of(blobs):
        e, anchor, piece, covered = alike(np.concatenate([unpack(b) for b in blobs]))
        spans.append(e[covered])
        which = np.cumsum(anchor) - 1
        head = np.flatnonzero(anchor)
        several = np.minimum.reduceat(e["doc"], head) < np.maximum.reduceat(e["doc"], head)
        different = np.bincount(which[piece], minlength=len(head))
        ask = ((different > 1) & several)[which] & ~covered
        least = np.minimum.reduceat(e["doc"], head)
        spot = np.minimum.reduceat(np.where(e["doc"] == least[which], e["start"], np.iinfo(np.int32).max), head)
        home = mix64(least.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (spot // HOME).astype(np.uint64)).astype(np.int64)
        for kind, rows in ((1, ask & (different <= crowded)[which]), (2, ask & (different > crowded)[which])):
            asked[kind].append((e[rows], home[which[rows]], spot[which[rows]]))

    part, blobs = None, []
    for batch in batches:
        for p, kind, data in zip(*(batch.column(x).to_pylist() for x in ("part", "kind", "data")), strict=True):
            if kind:
                spans.append(unpack(data))
                continue
            if p != part and blobs:
                of(blobs)
                yield from out(HELD)
                blobs = []
            part = p
            blobs.append(data)
    if blobs:
        of(blobs)
    yield from out(0)


def _listed(form: np.dtype, tagged: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """doc_id, text and own entries, in lots, from rows sorted by near and side: lists (side 0), then documents."""
    near, lists, parts = None, [], {}
    for batch in batches:
        rows = []
        for here, side, doc, text, data in zip(*(batch.column(x).to_pylist() for x in ("near", "side", "doc_id")), texts_as_bytes(batch.column("text")), batch.column("data").to_pylist(), strict=True):
            if here != near:
                near, lists, parts = here, [], {}
            if not side:
                lists.append(data)
                continue
            if lists:
                e = np.frombuffer(b"".join(lists), form)
                e = e[np.lexsort((e["start"], e["tag"], e["doc"]))]
                cuts = np.flatnonzero(np.concatenate([[True], (e["doc"][1:] != e["doc"][:-1]) | (e["tag"][1:] != e["tag"][:-1]), [True]]))
                parts = {(int(e["doc"][a]), int(e["tag"][a])): e[a:b] for a, b in zip(cuts, cuts[1:], strict=False)}
                lists = []
            rows.append((doc, text, parts.get((doc, tag_of(text, tagged))) if parts else None))
        yield rows


def _texts(tagged: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of the pieces that a document is asked for."""
    names = ["home", "spot", "doc", "tag", "start", "text", "at"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32()]
    for lot in _listed(REQUEST, tagged, batches):
        rows = [(home, spot, doc, tag, start, text[start : start + size], at) for _, text, own in lot if own is not None for doc, tag, start, size, at, home, spot in own.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, types, strict=True)], names)


def shared_windows(docs: list[int], texts: list[bytes]) -> list[np.ndarray]:
    """Per text: the starts of its windows that a text of a smaller document has as well."""
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes + 1) - 1
    begin = ends - sizes
    symbols = np.frombuffer(b"\0".join([*texts, b""]), np.uint8).astype(np.int16) + 1
    symbols[ends] = 0
    collects = gc.isenabled()
    gc.disable()  # a million small lists and no cycles
    try:
        order = np.array(suffix_order(symbols.tolist()))
    finally:
        if collects:
            gc.enable()
    owner = np.searchsorted(begin, order, "right") - 1
    full = order - begin[owner] + LENGTH <= sizes[owner]
    order, owner = order[full], owner[full]
    hashed = RangeHash((symbols & 255).astype(np.uint8))(order, order + LENGTH)
    same = np.zeros(len(order), bool)
    same[1:] = hashed[1:] == hashed[:-1]
    rows = np.lib.stride_tricks.sliding_window_view(symbols, LENGTH) if len(order) else None
    at = np.flatnonzero(same)
    for a in range(0, len(at), 20_000):  # equal hashes are compared by bytes
        k = at[a : a + 20_000]
        same[k] = (rows[order[k]] == rows[order[k - 1]]).all(1)
    run = np.cumsum(~same) - 1
    doc = np.array(docs, np.int64)[owner]
    least = np.minimum.reduceat(doc, np.flatnonzero(~same)) if len(doc) else doc
    hit = doc > least[run] if len(doc) else np.zeros(0, bool)
    starts, owners = (order - begin[owner])[hit], owner[hit]
    by = np.argsort(owners, kind="stable")
    cuts = np.searchsorted(owners[by], np.arange(len(texts) + 1))
    return [starts[by[cuts[i] : cuts[i + 1]]] for i in range(len(texts))]


def with_company(group: list[list]) -> list[list]:
    """The pieces of one anchor that can share a window with a piece of another document: a
    window holds the anchor and at least half of its other bytes before or behind it."""
    half = (LENGTH - ANCHOR) // 2
    seen: dict[tuple, int | None] = {}
    sides = []
    for doc, _, _, t, at in group:
        own = [(0, t[at - half : at + ANCHOR])] if at >= half else []
        if at + ANCHOR + half <= len(t):
            own.append((1, t[at : at + ANCHOR + half]))
        sides.append(own)
        for k in own:
            if seen.setdefault(k, doc) != doc:
                seen[k] = None  # of several documents
    return [r for r, own in zip(group, sides, strict=True) if any(seen[k] is None for k in own)]


def _sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (home, spot, doc, tag, start, text, at) come sorted by home and spot.  Anchors are sorted together up to SORTED bytes."""
    anchor, group, rows, held = None, [], [], 0
    for batch in batches:
        for home, spot, *row in zip(*(batch.column(x).to_pylist() for x in ("home", "spot", "doc", "tag", "start", "text", "at")), strict=True):
            if (home, spot) != anchor:
                if group:
                    rows += (more := with_company(group))
                    held += sum(len(r[3]) for r in more)
                    group = []
                if held > SORTED:
                    yield _spans(rows)
                    rows, held = [], 0
                anchor = (home, spot)
            group.append(row)
    if group:
        rows += with_company(group)
    if rows:
        yield _spans(rows)


def stretches(rows: list[list]) -> list[list]:
    """Overlapping pieces (doc, tag, start, text) of one text become one."""
    out: list[list] = []
    for doc, tag, start, text, _ in sorted(rows, key=lambda r: r[:3]):
        if out and out[-1][:2] == [doc, tag] and start <= (end := out[-1][2] + sum(map(len, out[-1][3]))):
            out[-1][3].append(text[end - start :])
        else:
            out.append([doc, tag, start, [text]])
    return [[*r[:3], b"".join(r[3])] for r in out]


def _spans(rows: list[list]) -> pa.RecordBatch:
    rows = stretches(rows)
    found = shared_windows([r[0] for r in rows], [r[3] for r in rows])
    e = np.empty(sum(map(len, found)), ENTRY)
    count = [len(f) for f in found]
    for k, name in enumerate(("doc", "tag", "start")):
        e[name] = np.repeat(np.array([r[k] for r in rows]), count)
    e["start"] += np.concatenate([*found, np.zeros(0, np.int64)]).astype(np.int32)
    e["size"] = LENGTH
    return as_lists(e, 0, SPAN)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(h[:16], r["doc"], r["tag"], r["start"] + i) for r in batch.to_pylist() for i in range(len(r["text"]) - LENGTH + 1) for h in [hashlib.blake2b(r["text"][i : i + LENGTH], digest_size=16).digest()]]
        cols = zip(*rows, strict=True) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.binary(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["window", "doc", "tag", "start"])


RESULT = "doc_id long, n_bytes long, removed array<struct<start:long,end:long>>, kept binary"


def runs_of(spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the maximal runs that the spans cover."""
    spans = spans[np.argsort(spans["start"], kind="stable")]
    reach = np.maximum.accumulate(spans["start"].astype(np.int64) + spans["size"])
    first = np.concatenate([[True], spans["start"][1:] > reach[:-1]])
    return spans["start"][first].astype(np.int64), reach[np.append(np.flatnonzero(first)[1:], len(spans)) - 1]


def _cut(tagged: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    none = np.zeros(0, np.int64)
    for lot in _listed(SPAN, tagged, batches):
        runs = [runs_of(own) if own is not None else (none, none) for *_, own in lot]
        kept = [b"".join(text[a:b] for a, b in zip([0, *end], [*begin, len(text)], strict=True)) if len(begin) else text for (_, text, _), (begin, end) in zip(lot, runs, strict=True)]
        flat = pa.StructArray.from_arrays([pa.array(np.concatenate([none, *(r[k] for r in runs)])) for k in (0, 1)], ["start", "end"])
        removed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(r[0]) for r in runs])]), pa.int32()), flat)
        doc, size = pa.array([x[0] for x in lot], pa.int64()), pa.array([len(x[1]) for x in lot], pa.int64())
        yield pa.RecordBatch.from_arrays([doc, size, removed, pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "removed", "kept"])


def with_lists(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """docs behind the lists of their group of near documents: one shuffle, sorted, nothing gathered in the JVM."""
    near = F.coalesce(F.shiftright("doc_id", NEAR_BITS), F.xxhash64("text"))
    none = lambda t: F.lit(None).cast(t)
    a = lists.select("near", F.lit(0).alias("side"), none("long").alias("doc_id"), none("string").alias("text"), "data")
    b = docs.select(near.alias("near"), F.lit(1).alias("side"), "doc_id", "text", none("binary").alias("data"))
    return a.unionByName(b).repartition("near").sortWithinPartitions("near", "side")


def covered_spans(docs: DataFrame, scratch: Scratch, crowded: int = CROWDED, tagged: bool = True) -> DataFrame:
    """near, data: spans to remove, as lists of entries; a group of near documents may have several."""
    parts = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.mapInArrow(lambda it: _deal(parts, tagged, it), PARTS).repartition("part").sortWithinPartitions("part")
    met = scratch.keep(dealt.mapInArrow(lambda it: _meet(crowded, it), LISTS), "met")
    spans = met.where("kind = 0").select("near", "data")
    texts = "home long, spot int, doc long, tag long, start int, text binary, at int"
    asked = with_lists(docs, met.where("kind = 1")).mapInArrow(lambda it: _texts(tagged, it), texts)
    ordered = asked.repartition("home").sortWithinPartitions("home", "spot")
    spans = spans.unionByName(ordered.mapInArrow(_sort, LISTS).select("near", "data"))
    if not (many := met.where("kind = 2")).isEmpty():
        windows = scratch.keep(with_lists(docs, many).mapInArrow(lambda it: _texts(tagged, it), texts).mapInArrow(_windows, "window binary, doc long, tag long, start long"), "windows")
        least = windows.groupBy("window").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most")
        hit = windows.join(least, "window").where("doc > least")
        spans = spans.unionByName(hit.select("doc", "tag", "start").mapInArrow(_as_list, LISTS).select("near", "data"))
    return scratch.keep(spans, "spans")


def _as_list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        e = np.empty(batch.num_rows, ENTRY)
        for name in ("doc", "tag", "start"):
            e[name] = np.asarray(batch.column(name))
        e["size"] = LENGTH
        yield as_lists(e, 0, SPAN)


def cut_repeats(docs: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """doc_id, n_bytes, removed (maximal runs of bytes: start, end) and kept (the remaining bytes) of every row of docs (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tagged = not rows.groupBy("doc_id").count().where("count > 1").isEmpty()
    spans = covered_spans(rows, Scratch(docs.sparkSession, "repeats"), crowded, tagged)
    return with_lists(rows, spans).mapInArrow(lambda it: _cut(tagged, it), RESULT)
