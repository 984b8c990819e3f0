"""Small helpers shared by the operators: tables, scratch files, batches."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Scratch folders that this process has made.
ROOTS: list[str] = []


@lru_cache(1)
def local_base() -> str:
    """A temporary folder for sessions without a shared one; it goes when the process ends."""
    path = tempfile.mkdtemp(prefix="seriesloom-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return f"file://{path}"


class Scratch:
    """Intermediate Parquet tables in the folder that all executors share.

    The folder is the session's spark.checkpoint.dir.  Where that is unset, a
    local session (as in tests) uses a temporary folder and any other raises an
    error, as its executors would not share one.  Writing a table and reading
    it back cuts lineage: a lost executor costs no earlier stage.
    """

    def __init__(self, spark: SparkSession, label: str):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = local_base()
        self.spark, self.root = spark, f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
        ROOTS.append(self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write df under name and return a DataFrame that reads it."""
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        remove(self.spark, self.path(name))


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def clear(spark: SparkSession) -> None:
    """Remove all scratch folders of this process, once no result that reads them is needed."""
    while ROOTS:
        remove(spark, ROOTS.pop())


#: Slices over which the rows of one key are spread.
SPREAD = 64


def spread_key(by: str) -> Column:
    """The slice of a row, by a column that tells the rows of one key apart."""
    return F.pmod(F.xxhash64(by), F.lit(SPREAD)).cast("int")


def slice_mask(of: str) -> Column:
    """An aggregate: which slices occur, as bits."""
    return F.expr(f"bit_or(shiftleft(1L, {of}))")


def each_slice(mask: str) -> Column:
    """A row for each slice of a mask."""
    return F.explode(F.expr(f"filter(sequence(0, {SPREAD - 1}), s -> (shiftrightunsigned({mask}, s) & 1) = 1)"))


def join_spread(big: DataFrame, small: DataFrame, keys: list[str], by: str, how: str = "inner") -> DataFrame:
    """big joined with small (one row a key) on keys, of which a few may hold most rows of big.

    The rows of a key are spread over slices by the column `by`, and the row of
    small goes to those slices of its key that occur.
    """
    big = big.withColumn("_slice", spread_key(by))
    masks = big.groupBy(*keys).agg(slice_mask("_slice").alias("_mask"))
    dealt = small.join(masks, keys).withColumn("_slice", each_slice("_mask")).drop("_mask")
    return big.join(dealt, [*keys, "_slice"], how).drop("_slice")


#: Marks of a sieve as a power of two; 64 of them are a row, so a sieve is 2**18 rows at most, however many ids made it.
SIEVE_BITS = 24


def sieved(big: DataFrame, by: Column, ids: DataFrame, of: str) -> DataFrame:
    """big with _maybe: true wherever `by` is among the ids (column `of`, of the same type), and by chance for a few other rows.

    Long rows are so told apart where they lie, and only those that are wanted, and few others, are shuffled by an exact
    join after it.  The ids are marks of a fixed number, and those are broadcast.
    """
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << SIEVE_BITS))
    marks = ids.select(at(F.col(of)).alias("_at")).groupBy(F.shiftright("_at", 6).alias("_word")).agg(F.expr("bit_or(shiftleft(1L, cast(_at & 63 as int)))").alias("_marks"))
    found = big.withColumn("_at", at(by)).withColumn("_word", F.shiftright("_at", 6)).join(F.broadcast(marks), "_word", "left")
    return found.withColumn("_maybe", F.coalesce(F.expr("getbit(_marks, cast(_at & 63 as int)) = 1"), F.lit(False))).drop("_word", "_at", "_marks")


def tidy(spark: SparkSession) -> None:
    """Shuffle files stay until the driver collects its garbage, which it may not do for long; between steps that each shuffle much, it is asked to."""
    gc.collect()
    spark._jvm.System.gc()


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, unless the session has set that itself: rows hold whole texts."""
    if spark.conf.get(BATCH_BYTES, None) is None and spark.conf.isModifiable(BATCH_BYTES):
        spark.conf.set(BATCH_BYTES, str(4 << 20))


@contextmanager
def bounded_batches(spark: SparkSession, most: int = 4 << 20) -> Iterator[None]:
    """Arrow batches of at most `most` bytes for the jobs that are run within; the session's own setting comes back."""
    before = spark.conf.get(BATCH_BYTES, None)
    spark.conf.set(BATCH_BYTES, str(most))
    try:
        yield
    finally:
        spark.conf.unset(BATCH_BYTES) if before is None else spark.conf.set(BATCH_BYTES, before)


def texts_as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def text_slices(column: pa.Array, most: int) -> Iterator[tuple[int, int, list[bytes]]]:
    """Ranges of rows of at most `most` bytes together, or of one row, and their texts; only one range is held."""
    sizes = pc.binary_length(column).fill_null(0).to_pylist()
    for a, b in slices(sizes, most):
        yield a, b, texts_as_bytes(column.slice(a, b - a))


def slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items of at most `most` bytes together, or of one item."""
    begin, held = 0, 0
    for i, n in enumerate(sizes):
        if i > begin and held + n > most:
            yield begin, i
            begin, held = i, 0
        held += n
    if begin < len(sizes):
        yield begin, len(sizes)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers (splitmix finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    np.multiply.accumulate(np.concatenate([out[:1], np.full(n - 1, base, np.uint64)]), out=out)
    return out


class RangeHash:
    """Hashes of any byte ranges of one buffer, by prefix sums modulo 2**64.

    Powers come from two short tables, of the low and the high part of the
    exponent, so that a long buffer leaves nothing behind.
    """

    BASE, LOW = 0x9E3779B97F4A7C15, 1 << 16
    _table = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    _pow, _inv = _powers(BASE, LOW), _powers(pow(BASE, -1, 1 << 64), LOW)

    def __init__(self, buf: np.ndarray):
        n, step = len(buf), self.LOW
        self.high = _powers(pow(self.BASE, -step, 1 << 64), n // step + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        scale = 1
        for a in range(0, n, step):
            part = self._table[buf[a : a + step]]
            part *= self._pow[: len(part)]
            part *= np.uint64(scale)
            self.sums[a + 1 : a + 1 + len(part)] = part
            scale = scale * pow(self.BASE, step, 1 << 64) & (1 << 64) - 1
        np.cumsum(self.sums, out=self.sums)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        part = self.sums[end] - self.sums[start]
        part *= self._inv[start & (self.LOW - 1)]
        if len(self.high) > 1:
            part *= self.high[start >> 16]
        return mix64(part + (end - start).astype(np.uint64))

    def rolling(self, k: int) -> np.ndarray:
        """Hashes of all ranges of k bytes; the same as of the ranges one by one."""
        part = self.sums[k:] - self.sums[:-k]
        for i, a in enumerate(range(0, len(part), self.LOW)):
            own = part[a : a + self.LOW]
            own *= self._inv[: len(own)]
            own *= self.high[i]
        part += np.uint64(k)
        return mix64(part)


#: White space of the word rule [^\x20\x09-\x0D]+
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_bounds(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a buffer."""
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = ~SPACE[buf]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def joined(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One buffer of all texts with a line feed after each, and where each text begins and ends."""
    sizes = np.array([len(d) for d in docs], np.int64)
    ends = np.cumsum(sizes + 1) - 1
    return np.frombuffer(b"\n".join([*docs, b""]), np.uint8), ends - sizes, ends


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per key: does it occur more than once, and has it occurred earlier."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    later = np.zeros(len(keys), bool)
    later[order[1:]] = same
    any_ = later.copy()
    any_[order[:-1]] |= same
    return any_, later
