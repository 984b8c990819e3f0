"""Byte-level BPE encoding and decoding by overlapping chunks.

A text longer than `chunk` characters is cut into chunks that overlap the next
one by `overlap` characters.  Every chunk is pre-tokenised on its own, in
parallel.  Two neighbours are stitched at the first pre-token boundary that
both of them have inside the overlap: the pattern never looks behind, so from a
common boundary on both go the same way.  Each chunk then encodes its own
pieces, and the ids are put in order again.  Decoding concatenates the raw
bytes of the ids.  A shorter text is one chunk and never leaves its partition.

Should two neighbours share no boundary in the overlap (one pre-token of
hundreds of characters lies across it), the text is encoded as one chunk.

Defined results: a null text is empty (no ids); repeated rows give repeated
rows; a null doc_id stays null; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

CHUNK, OVERLAP = 32768, 1024
#: A boundary this close to a chunk's end may move once more text is seen.
MARGIN = 4

#: ids are little-endian unsigned 32-bit integers, end to end.
ENCODED = "doc_id long, ids binary"


class Codec:
    """Ranks and pattern of one vocabulary; pieces are encoded separately."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.raw = {i: b for b, i in ranks.items()}

    def encode(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text)

    def bounds(self, text: str, begin: int = 0) -> list[int]:
        """Ends of the pre-tokens of text from begin on."""
        return [m.end() for m in self.pattern.finditer(text, begin)]

    def encode_span(self, text: str, begin: int, end: int) -> list[int]:
        """Ids of the pre-tokens between two boundaries; text goes on behind end."""
        ids: list[int] = []
        known: dict[str, list[int]] = {}
        for m in self.pattern.finditer(text, begin):
            if m.start() >= end:
                break
            piece = m.group()
            if (got := known.get(piece)) is None:
                got = known[piece] = self.encode(piece)
            ids += got
        return ids

    def decode(self, ids) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids))


@lru_cache(4)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def stitch(tail: list[int], head: list[int], low: int, high: int) -> int:
    """The first boundary of both lists within (low, high], or -1."""
    both = set(tail).intersection(head)
    return min((p for p in both if low < p <= high), default=-1)


def _encoded(c: Codec, docs: pa.Array, ids: list[bytes], back: bool) -> pa.RecordBatch:
    """Encoded texts, and what their ids decode to if that is asked for."""
    raw = [pa.array([c.decode(np.frombuffer(x, "<u4").tolist()) for x in ids], pa.binary())] if back else []
    return pa.RecordBatch.from_arrays([docs, pa.array(ids, pa.binary()), *raw], ["doc_id", "ids", *["decoded"] * back])


def _short(path: str, pattern: str, back: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    c = codec(path, pattern)
    for batch in batches:
        for a in range(0, batch.num_rows, 1000):
            part = batch.slice(a, 1000)
            ids = [np.array(c.encode(text or ""), "<u4").tobytes() for text in part.column("text").to_pylist()]
            yield _encoded(c, part.column("doc_id"), ids, back)


def _decode(path: str, pattern: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    c = codec(path, pattern)
    for batch in batches:
        yield _encoded(c, batch.column("doc_id"), batch.column("ids").to_pylist(), True)


CHUNKS = "text_key binary, doc_id long, chunk_no int, start long, n_chars long, text string"


def _cut(chunk: int, overlap: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["text_key", "doc_id", "chunk_no", "start", "n_chars", "text"]
    types = [pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            key = hashlib.sha256(f"{doc_id}:{text}".encode()).digest()[:16]
            for first in range(0, len(text), 64 * chunk):  # a very long text leaves in several batches
                rows = [(key, doc_id, s // chunk, s, len(text), text[s : s + chunk + overlap]) for s in range(first, min(len(text), first + 64 * chunk), chunk)]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def _edges(path: str, pattern: str, chunk: int, overlap: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    c = codec(path, pattern)
    for batch in batches:
        head, tail = [], []
        for s, text in zip(batch.column("start").to_pylist(), batch.column("text").to_pylist(), strict=True):
            ends = c.bounds(text)
            head.append([s + p for p in ends if p <= overlap])
            tail.append([s + p for p in ends if chunk <= p <= len(text) - MARGIN])
        keep = [batch.column(x) for x in ("text_key", "chunk_no", "start", "n_chars", "copies")]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(head, pa.list_(pa.int64())), pa.array(tail, pa.list_(pa.int64()))], ["text_key", "chunk_no", "start", "n_chars", "copies", "head", "tail"])


def _encode(path: str, pattern: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by text and chunk.  Chunks of one text without a common boundary are one group."""
    c = codec(path, pattern)
    names = ["text_key", "doc_id", "chunk_no", "copies", "ids"]
    types = [pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]

    def put(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def of(group):
        first, last = group[0], group[-1]
        text = "".join([g["text"][: g["next_start"] - g["start"]] for g in group[:-1]] + [last["text"]])
        ids = c.encode_span(text, first["span_from"] - first["start"], last["span_to"] - first["start"])
        return first["text_key"], first["doc_id"], first["chunk_no"], first["copies"], np.array(ids, "<u4").tobytes()

    group, out = [], []
    for batch in batches:
        for row in batch.to_pylist():
            if group and (group[0]["text_key"], group[0]["part"]) != (row["text_key"], row["part"]):
                out.append(of(group))
                group = []
            group.append(row)
            if len(out) >= 64:
                yield put(out)
                out = []
    if group:
        out.append(of(group))
    if out:
        yield put(out)


def _join(path: str, pattern: str, back: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by text and chunk; the ids of a text are put end to end."""
    c = codec(path, pattern)
    now, parts = None, []

    def put():
        doc_id, copies = now[1:]
        return _encoded(c, pa.array([doc_id] * copies, pa.int64()), [b"".join(parts)] * copies, back)

    for batch in batches:
        for key, doc_id, copies, ids in zip(*(batch.column(x).to_pylist() for x in ("text_key", "doc_id", "copies", "ids")), strict=True):
            if now is None or now[0] != key:
                if now is not None:
                    yield put()
                now, parts = (key, doc_id, copies), []
            parts.append(ids)
    if now is not None:
        yield put()


def encode_chunks(long_docs: DataFrame, path: str, pattern: str, scratch: Scratch, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """text_key, doc_id, chunk_no, copies, ids (little-endian unsigned 32 bits) of every stitched chunk."""
    cut = long_docs.select("doc_id", "text").mapInArrow(lambda it: _cut(chunk, overlap, it), CHUNKS)
    by = ["text_key", "chunk_no"]
    rows = [F.first(x).alias(x) for x in ("doc_id", "start", "n_chars", "text")]
    chunks = scratch.keep(cut.groupBy(*by).agg(*rows, F.count("*").alias("copies")), "chunks")

    w = Window.partitionBy("text_key").orderBy("chunk_no")
    edges = chunks.mapInArrow(lambda it: _edges(path, pattern, chunk, overlap, it), "text_key binary, chunk_no int, start long, n_chars long, copies long, head array<long>, tail array<long>")
    joints = edges.withColumns({"next_start": F.lead("start").over(w), "next_head": F.lead("head").over(w)}).withColumn(
        "joint", F.when(F.col("next_start").isNull(), F.col("n_chars")).otherwise(F.array_min(F.array_intersect("tail", "next_head")))
    )
    whole = Window.partitionBy("text_key")
    broken = F.max(F.col("joint").isNull().cast("int")).over(whole) == 1  # one chunk for all of it
    spans = (
        joints.withColumn("broken", broken)
        .withColumn("span_from", F.when(F.col("broken"), F.lit(0)).otherwise(F.coalesce(F.lag("joint").over(w), F.lit(0))))
        .withColumn("span_to", F.when(F.col("broken"), F.col("n_chars")).otherwise(F.col("joint")))
        .withColumn("part", F.when(F.col("broken"), F.lit(-1)).otherwise(F.col("chunk_no")))
        .select(*by, "span_from", "span_to", "part", "next_start")
    )
    ready = chunks.join(spans, by).select(*by, "doc_id", "copies", "start", "next_start", "text", "span_from", "span_to", "part")
    ready = ready.repartition("text_key", "part").sortWithinPartitions("text_key", "part", "chunk_no")
    return ready.mapInArrow(lambda it: _encode(path, pattern, it), "text_key binary, doc_id long, chunk_no int, copies long, ids binary")


def encode_documents(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP, back: bool = False) -> DataFrame:
    """doc_id, ids of every row of docs (doc_id, text); with back also decoded, made from the ids by the same worker."""
    scratch = Scratch(docs.sparkSession, "bpe")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    is_long = F.coalesce(F.length("text"), F.lit(0)) > chunk
    schema = ENCODED + ", decoded binary" * back
    short = rows.where(~is_long).mapInArrow(lambda it: _short(path, pattern, back, it), schema)
    parts = encode_chunks(rows.where(is_long), path, pattern, scratch, chunk, overlap)
    ordered = parts.repartition("text_key").sortWithinPartitions("text_key", "chunk_no")
    return short.unionByName(ordered.mapInArrow(lambda it: _join(path, pattern, back, it), schema))


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids, decoded (raw bytes) of every row of encoded (doc_id, ids)."""
    return encoded.select("doc_id", "ids").mapInArrow(lambda it: _decode(path, pattern, it), f"{ENCODED}, decoded binary")


def digests(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    n = (F.length("ids") / 4).cast("long")
    return decoded.select("doc_id", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
