"""Collocations from vertical positional inverted lists.

Lists.  Texts are cut into chunks of bounded size, at the ends of pieces, and
each chunk is written as inverted lists: for every word the rising positions at
which it occurs.  Words of a piece have adjacent positions, the ends of pieces
leave gaps, so neighbours are words whose positions differ by one.

Levels.  The lists of phrases of k words come from those of k - 1: the
positions behind a phrase's occurrences are merged with the postings of the
words, and a phrase and the word found there make a longer phrase with a list
of its own.  The length of a list is the phrase's exact frequency in the
chunk; sums over chunks are exact frequencies.  Only frequent phrases are
extended, and only if what follows their first word is frequent too: a pass for
each level counts hashes, in blocks by their first bits, and leaves a bitmap of
those that are frequent.  The bitmap grows with their
number up to a bound; a hash that meets another costs work, never a phrase, as
the last pass counts by the words themselves.

Scores.  Frequencies of the parts of a phrase come by joins (a word that
begins a large share of the phrases is spread over slices); scores are whole
numbers of 38 digits, so a phrase may occur 10**15 times.

Defined results: a null or wordless text adds nothing, a null language is
`und`; every row counts, also with a repeated or no doc_id; other columns are
ignored; a language without a frequent phrase has no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import RangeHash, Scratch, bounded_batches, join_spread, joined, mix64, slices, text_slices

#: Bytes of text in a chunk, but for a longer piece.
CHUNK = 2 << 20
#: Bounds of a bitmap's size, as powers of two (32 MB at most), and bits for each frequent phrase as a power of two.
LEAST_BITS, MOST_BITS, SPARE_BITS = 16, 28, 4
#: Occurrences of words for each block of phrases that are counted together, and hashes of a block after which equal ones are summed.
BLOCK, TOGETHER = 1 << 20, 1 << 20
#: Slices over which the phrases of one language are ranked first.
RANKED = 64

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that end a piece, and those that are no part of a word.
BREAKS = b".,;:!?\n\x0b\x0c\r"
ENDS_PIECE = np.zeros(256, bool)
ENDS_PIECE[list(BREAKS)] = True
IN_WORD = ~ENDS_PIECE
IN_WORD[[0x20, 0x09]] = False

LISTS = "lang string, words array<string>, hashes array<long>, sizes array<int>, positions binary"


def cut_text(text: bytes, most: int) -> Iterator[bytes]:
    """A text in parts of at most `most` bytes that end where pieces end; a longer piece stays whole."""
    a = 0
    while len(text) - a > most:
        b = max(text.rfind(c, a, a + most) for c in (BREAKS[i : i + 1] for i in range(len(BREAKS)))) + 1
        if b <= a:
            b = min((at for c in BREAKS if (at := text.find(c, a + most)) >= 0), default=len(text)) + 1
        yield text[a:b]
        a = b
    if a < len(text):
        yield text[a:]


def inverted(docs: list[bytes], salt: np.uint64) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray] | None:
    """The words of some texts, their hashes, how long their lists are, and the lists, one behind the other."""
    buf = LOWER[joined(docs)[0]]
    step = np.diff(np.concatenate([[False], IN_WORD[buf], [False]]).astype(np.int8))
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if not len(start):
        return None
    position = np.arange(len(start)) + np.searchsorted(np.flatnonzero(ENDS_PIECE[buf]), start)
    hashes, first, word, sizes = np.unique(mix64(RangeHash(buf)(start, end) ^ salt), return_index=True, return_inverse=True, return_counts=True)
    length = (end - start)[first]
    offset = np.concatenate([[0], np.cumsum(length)])
    at = np.repeat(start[first] - offset[:-1], length) + np.arange(offset[-1])
    words = pa.Array.from_buffers(pa.string(), len(first), [None, pa.py_buffer(offset.astype(np.int32)), pa.py_buffer(buf[at])])
    return words, hashes, sizes, position[np.argsort(word, kind="stable")].astype(np.int32)


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = batch.column("lang").dictionary_encode()
        for i, lang in enumerate(langs.dictionary.to_pylist()):
            texts = batch.column("text").filter(pc.equal(langs.indices, i))
            salt = RangeHash(np.frombuffer(lang.encode(), np.uint8))(np.array([0]), np.array([len(lang.encode())]))[0]
            for _, _, docs in text_slices(texts, CHUNK):
                parts = [p for d in docs for p in cut_text(d, CHUNK)]
                for a, b in slices([len(p) for p in parts], CHUNK):
                    found = inverted(parts[a:b], salt)
                    if found is not None:
                        words, hashes, sizes, positions = found
                        row = [[lang], [words], [pa.array(hashes.view(np.int64))], [pa.array(sizes.astype(np.int32))], [positions.tobytes()]]
                        types = [pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
                        arrays = [pa.ListArray.from_arrays(pa.array([0, len(x[0])], pa.int32()), x[0]) if pa.types.is_list(t) else pa.array(x, t) for x, t in zip(row, types, strict=True)]
                        yield pa.RecordBatch.from_arrays(arrays, ["lang", "words", "hashes", "sizes", "positions"])


class Bitmap:
    """Which hashes may be those of frequent phrases."""

    def __init__(self, bits: int, packed: np.ndarray):
        self.bits, self.packed = bits, packed

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        return (self.packed[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def bitmap(frequent: DataFrame) -> Bitmap:
    """The bitmap of column h; Spark builds it in parts of 4 KB."""
    count = frequent.count()
    bits = min(MOST_BITS, max(LEAST_BITS, count.bit_length() + SPARE_BITS))
    at = F.shiftrightunsigned("h", 64 - bits) + 1
    parts = frequent.groupBy(F.bitmap_bucket_number(at).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    packed = np.zeros(1 << (bits - 3), np.uint8)
    for r in parts.toLocalIterator():
        own = np.frombuffer(r.bits, np.uint8)
        packed[(r.part - 1) * len(own) : r.part * len(own)] = own
    return Bitmap(bits, packed)


class Chunk:
    """The inverted lists of one chunk, and those of longer phrases."""

    def __init__(self, hashes: np.ndarray, sizes: np.ndarray, positions: np.ndarray):
        self.hashes, self.sizes, self.positions = hashes, sizes, positions
        self.words = np.arange(len(sizes), dtype=np.int32)[:, None]  # of each phrase
        self.posting = np.full(int(positions.max()) + 2, -1, np.int32)  # which word's list holds a position
        self.posting[positions] = np.repeat(self.words[:, 0], sizes)
        self.one = hashes

    def hash_of(self, words: np.ndarray) -> np.ndarray:
        out = self.one[words[:, 0]]
        for k in range(1, words.shape[1]):
            out = mix64(out * np.uint64(0xA24BAED4963EE407) + self.one[words[:, k]])
        return out

    def keep(self, these: np.ndarray) -> None:
        """Only these phrases go on."""
        self.positions = self.positions[np.repeat(these, self.sizes)]
        self.words, self.sizes, self.hashes = self.words[these], self.sizes[these], self.hashes[these]

    def extend(self, below: Bitmap) -> None:
        """From the lists of some phrases to those of one word more, whose last words may be frequent (below)."""
        k = self.words.shape[1]
        phrase = np.repeat(np.arange(len(self.sizes)), self.sizes)
        behind = self.positions + k
        follower = self.posting[np.minimum(behind, len(self.posting) - 1)]
        follower[behind >= len(self.posting)] = -1
        met = follower >= 0
        code = phrase[met] * len(self.one) + follower[met]
        order = np.argsort(code, kind="stable")
        code, positions = code[order], self.positions[met][order]
        edge = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1], [True]])) if len(code) else np.zeros(1, np.int64)
        code = code[edge[:-1]]
        self.words = np.concatenate([self.words[code // len(self.one)], (code % len(self.one)).astype(np.int32)[:, None]], axis=1)
        self.sizes, self.positions = np.diff(edge), positions
        self.hashes = self.hash_of(self.words)
        self.keep(below.has(self.hash_of(self.words[:, 1:])))


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, Chunk]]:
    for batch in batches:
        for i in range(batch.num_rows):
            array = lambda x: np.asarray(batch.column(x)[i].values)  # noqa: B023, E731
            yield batch, i, Chunk(array("hashes").view(np.uint64), array("sizes").astype(np.int64), np.frombuffer(batch.column("positions")[i].as_py(), np.int32))


def _hashed(k: int, maps: list[Bitmap], bits: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The phrases of k words of each chunk whose parts may be frequent, as blocks of hashes and frequencies by the first bits of the hash."""
    for _, _, c in chunks(batches):
        for below in maps[: k - 1]:
            c.keep(below.has(c.hashes))
            c.extend(below)
        order = np.argsort(c.hashes)
        h, f = c.hashes[order], c.sizes[order].astype(np.int32)
        block = (h >> np.uint64(64 - bits)).astype(np.int64)
        edge = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]])) if len(h) else np.zeros(1, np.int64)
        cut = [pa.array([x[i:j].tobytes() for i, j in zip(edge[:-1], edge[1:], strict=True)], pa.binary()) for x in (h, f)]
        yield pa.RecordBatch.from_arrays([pa.array(block[edge[:-1]]), *cut], ["block", "h", "f"])


def summed(hashes: list[np.ndarray], sizes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Each hash once, with the sum of its frequencies."""
    h, f = np.concatenate(hashes), np.concatenate(sizes).astype(np.int64)
    order = np.argsort(h)
    h, f = h[order], f[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return h[first], np.add.reduceat(f, first)


def _frequent(least: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hashes that are frequent; rows come sorted by block, and one block is held, its hashes once each."""
    now, hs, fs, held = None, [], [], 0

    def close() -> pa.RecordBatch:
        h, f = summed(hs, fs) if hs else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        return pa.RecordBatch.from_arrays([pa.array(h[f >= least].view(np.int64))], ["h"])

    for batch in batches:
        for block, h, f in zip(*(batch.column(x).to_pylist() for x in ("block", "h", "f")), strict=True):
            if block != now:
                yield close()
                now, hs, fs, held = block, [], [], 0
            hs.append(np.frombuffer(h, np.uint64))
            fs.append(np.frombuffer(f, np.int32))
            held += len(hs[-1])
            if held > TOGETHER:
                h, f = summed(hs, fs)
                hs, fs, held = [h], [f], -len(h)
    yield close()


def _spelled(longest: int, maps: list[Bitmap], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The phrases of 2 to `longest` words that may be frequent, in words, with their frequency in each chunk."""
    for batch, i, c in chunks(batches):
        words = batch.column("words")[i].values
        for below in maps[: longest - 1]:
            c.keep(below.has(c.hashes))
            c.extend(below)
            k = c.words.shape[1]
            these = maps[k - 1].has(c.hashes)
            text = pc.binary_join_element_wise(*(words.take(pa.array(w)) for w in c.words[these].T), " ")
            m = len(text)
            yield pa.RecordBatch.from_arrays([pa.repeat(batch.column("lang")[i], m), text, pa.repeat(pa.scalar(k, pa.int32()), m), pa.array(c.sizes[these], pa.int64())], ["lang", "phrase", "k", "f"])


def part(first: Column, length: Column) -> Column:
    """Words of the phrase, from a place on."""
    return F.array_join(F.slice(F.split("phrase", " "), first, length), " ")


def score_of(a: str, left: str, right: str) -> Column:
    """floor(1000000 a a / (l r)) of three columns up to 10**15, exactly."""
    wide = lambda c: F.col(c).cast("decimal(16,0)")
    return F.call_function("div", (wide(a) * wide(a) * F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(38,0)"), (wide(left) * wide(right)).cast("decimal(38,0)"))


def top_phrases(docs: DataFrame, longest: int = 3, least: int = 10, covered_percent: int = 50, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the best phrases of each language in docs (text, lang).

    Phrases have 2 to `longest` words and occur a >= least times; of their cuts
    in two parts that occur l and r times the lowest score
    floor(1000000 a a / (l r)) counts.  A phrase inside a longer one that is at
    least covered_percent as frequent is dropped.  n counts the language's words.
    """
    scratch = Scratch(docs.sparkSession, "phrases")
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    with bounded_batches(docs.sparkSession):
        lists = scratch.keep(texts.mapInArrow(_lists, LISTS), "lists")
        words = lists.select("lang", F.explode(F.arrays_zip("words", "hashes", "sizes")).alias("w"))
        words = words.groupBy("lang", F.col("w.words").alias("phrase")).agg(F.sum("w.sizes").alias("f"), F.first("w.hashes").alias("h")).where(F.col("f") >= least)
        words = scratch.keep(words, "words")
        maps, columns = [bitmap(words.select("h"))], lists.select("hashes", "sizes", "positions")
        occurrences = lists.agg(F.sum(F.octet_length("positions") / 4)).first()[0] or 0
        bits = min(22, max(8, int(occurrences / BLOCK).bit_length()))
        for k in range(2, longest + 1):
            blocks = columns.mapInArrow(lambda it, k=k, m=list(maps): _hashed(k, m, bits, it), "block long, h binary, f binary").repartition("block").sortWithinPartitions("block")
            maps.append(bitmap(scratch.keep(blocks.mapInArrow(lambda it: _frequent(least, it), "h long"), f"level-{k}")))
        spelled = lists.select("lang", "words", "hashes", "sizes", "positions").mapInArrow(lambda it: _spelled(longest, maps, it), "lang string, phrase string, k int, f long")
        phrases = scratch.keep(spelled.groupBy("lang", "phrase", "k").agg(F.sum("f").alias("f")).where(F.col("f") >= least), "phrases")

    known = words.select("lang", "phrase", "f").unionByName(phrases.select("lang", "phrase", "f"))
    cuts = phrases.select("lang", "phrase", F.col("f").alias("a"), "k", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.withColumns({"left": part(F.lit(1), F.col("cut")), "right": part(F.col("cut") + 1, F.col("k") - F.col("cut"))})
    for side, f in (("left", "l"), ("right", "r")):
        cuts = join_spread(cuts, known.select("lang", F.col("phrase").alias(side), F.col("f").alias(f)), ["lang", side], "phrase")
    scored = cuts.withColumn("score", score_of("a", "l", "r")).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))

    inside = phrases.where("k > 2").select("lang", "f", "k", "phrase", F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("m"))
    inside = inside.select("lang", "f", "m", "phrase", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("m") + 1)).alias("at"))
    inside = inside.groupBy("lang", part(F.col("at"), F.col("m")).alias("phrase")).agg(F.max("f").alias("longer"))
    left = scored.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < covered_percent * F.col("a")))

    order = [F.desc("best.score"), F.desc("a"), F.asc("phrase")]
    slice_ = F.pmod(F.xxhash64("phrase"), F.lit(RANKED))
    few = left.withColumn("slice", slice_).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "slice").orderBy(*order))).where(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    total = lists.groupBy("lang").agg(F.sum(F.octet_length("positions") / 4).cast("long").alias("n"))
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "best.l", "best.r", "n", "best.score")
