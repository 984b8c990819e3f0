"""Token counts as rollups that are maintained by deltas.

A ledger folder holds one folder per committed batch.  A batch brings inserts,
deletes and revised counts of documents; it is stored as signed rows per
document (a revision is the old count with sign -1 and the new one with +1) and
as their sums by source, language and tokenizer version.  Totals add the sums
of all committed batches and never touch documents.  A batch counts from the
moment its marker exists; committing it again changes nothing, and a batch that
broke off is written anew.

The rows lie in buckets by document, and a commit reads only the buckets that
its changes fall into.  After FOLD batches they are folded into a snapshot, so
neither totals nor commits scan an ever longer history.  One writer at a time:
a lock file keeps a second one out; `unlock` frees it after a writer has died.

Defined results: a null text has no tokens; of several changes to one document
and tokenizer in a batch the last (greatest seq) holds; an insert of a document
that is there revises it; a delete or revision of one that is not there is
nothing and an insert; rows without doc_id are documents of their own that are
only ever added, one for each insert or revision; other null keys are values of
their own; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import codec
from .common import join_spread, small_batches, text_slices

CHANGE = "doc_id long, source string, lang string, tokenizer string, op string, seq long, n_tokens long"
ROWS = "doc_id long, source string, lang string, tokenizer string, docs long, tokens long, bucket int"
TOTALS = "source string, lang string, tokenizer string, docs long, tokens long"
KEYS = ["source", "lang", "tokenizer"]
#: Buckets of documents, batches after which they are folded, and rows of a bucket that one task writes.
BUCKETS, FOLD, TASK_ROWS = 64, 16, 1 << 20
#: Bytes of text that are decoded at once.
SLICE = 1 << 18


def bucket(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(BUCKETS)).cast("int")


class TokenLedger:
    def __init__(self, spark: SparkSession, root: str, fold: int = FOLD):
        self.spark, self.root, self.fold_after = spark, root.rstrip("/"), fold
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        where = self._path(f"{self.root}/{folder}")
        return sorted(x.getPath().getName() for x in self._fs.listStatus(where)) if self._fs.exists(where) else []

    def _mark(self, file: str) -> None:
        where = self._path(f"{self.root}/{file}")
        self._fs.mkdirs(where.getParent())
        self._fs.create(where, False).close()

    def batches(self) -> list[str]:
        """Names of the committed batches."""
        return self._names("commits")

    def _sources(self) -> list[str]:
        """The folders that together hold all committed rows: the last snapshot and the batches behind it."""
        done = self._names("folded")
        if not done:
            return [f"batches/{b}" for b in self.batches()]
        held = set(self._names(f"snapshots/{done[-1]}/covers"))
        return [f"snapshots/{done[-1]}", *(f"batches/{b}" for b in self.batches() if b not in held)]

    def _read(self, what: str, schema: str) -> DataFrame:
        paths = [f"{self.root}/{x}/{what}" for x in self._sources()]
        parts = [self.spark.read.schema(schema).parquet(p) for p in paths]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], schema)

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens over all committed batches."""
        rows = self._read("totals", TOTALS)
        return rows.groupBy(*KEYS).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens")).where("n_docs <> 0 or n_tokens <> 0")

    def current(self, buckets: list[int] | None = None) -> DataFrame:
        """The documents that are there, with their present counts; those of some buckets, or all."""
        rows = self._read("rows", ROWS)
        rows = rows if buckets is None else rows.where(F.col("bucket").isin(buckets))
        return rows.groupBy("bucket", "doc_id", *KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs > 0")

    def unlock(self) -> None:
        self._fs.delete(self._path(f"{self.root}/writer"), False)

    def _write(self, folder: str, signed: DataFrame, n: int) -> None:
        # a bucket is a folder, which a reader can skip; as many tasks write it as its share of some n rows asks for, and
        # rows without id, all of one bucket, are spread as if there were as many of them
        few = F.pmod(F.xxhash64("doc_id"), F.lit(1 + n // (BUCKETS * TASK_ROWS)))
        part = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64(*KEYS, "tokens"), F.lit(16 + n // TASK_ROWS))).otherwise(few)
        signed.repartition(F.col("bucket"), part).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/{folder}/rows")
        rows = self.spark.read.schema(ROWS).parquet(f"{self.root}/{folder}/rows")
        rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).write.mode("overwrite").parquet(f"{self.root}/{folder}/totals")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply changes (CHANGE) as the batch of that name; False if it was committed before."""
        if self._fs.exists(self._path(f"{self.root}/commits/{batch}")):
            return False
        self._mark("writer")  # fails if there is one
        try:
            if self._fs.exists(self._path(f"{self.root}/commits/{batch}")):  # by a writer that held the lock until now
                return False
            who = ["doc_id", "tokenizer"]
            changes = changes.select(*who, "op", "source", "lang", "seq", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("tokens"))
            changes.write.mode("overwrite").parquet(f"{self.root}/batches/{batch}/changes")
            changes = self.spark.read.schema(changes.schema).parquet(f"{self.root}/batches/{batch}/changes")
            last = changes.where("doc_id is not null").groupBy(*who).agg(F.max(F.struct("seq", "op", "source", "lang", "tokens")).alias("c")).select(*who, "c.*")
            put = last.unionByName(changes.where("doc_id is null")).where("op <> 'delete'")
            signed = put.select("doc_id", *KEYS, F.lit(1).cast("long").alias("docs"), "tokens", bucket(F.col("doc_id")).alias("bucket"))
            if self.batches():
                touched = [r[0] for r in changes.where("doc_id is not null").select(bucket(F.col("doc_id"))).distinct().collect()]  # BUCKETS at most
                a, b = last.alias("a"), self.current(touched).alias("b")
                same = (F.col("a.doc_id") == F.col("b.doc_id")) & F.col("a.tokenizer").eqNullSafe(F.col("b.tokenizer"))
                signed = signed.unionByName(b.join(a, same, "left_semi").select("doc_id", *KEYS, (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens"), "bucket"))
            self._write(f"batches/{batch}", signed, changes.count())
            self._mark(f"commits/{batch}")
            self._fs.delete(self._path(f"{self.root}/batches/{batch}/changes"), True)
            if len(self._sources()) > self.fold_after:
                self._fold()
        finally:
            self.unlock()
        return True

    def _fold(self) -> None:
        """A snapshot of all committed batches; it counts from the moment its marker exists."""
        name, held = f"{len(self._names('folded')):08d}", self.batches()
        self._fs.delete(self._path(f"{self.root}/snapshots/{name}"), True)
        rows = self.current()
        self._write(f"snapshots/{name}", rows, rows.count())
        for b in held:
            self._mark(f"snapshots/{name}/covers/{b}")
        self._mark(f"folded/{name}")


def count_tokens(docs: DataFrame, tokenizers: dict[str, tuple[str, str]]) -> DataFrame:
    """One row (doc_id, source, lang, tokenizer, n_tokens) per row of docs and tokenizer: name -> (ranks file, pattern)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_slices(batch.column("text"), SLICE):
                keep = [batch.column(x).slice(a, b - a) for x in ("doc_id", "source", "lang")]
                texts = [x.decode() for x in texts]
                for name, (path, pattern) in tokenizers.items():
                    c = codec(path, pattern)
                    n = [len(c.encode(x)) for x in texts]
                    yield pa.RecordBatch.from_arrays([*keep, pa.array([name] * len(n), pa.string()), pa.array(n, pa.int64())], ["doc_id", "source", "lang", "tokenizer", "n_tokens"])

    small_batches(docs.sparkSession)
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(source as string) source", "cast(lang as string) lang", "cast(text as string) text")
    return rows.mapInArrow(run, "doc_id long, source string, lang string, tokenizer string, n_tokens long")


def as_changes(counts: DataFrame, op: str, seq: int = 0) -> DataFrame:
    return counts.select("doc_id", *KEYS, F.lit(op).alias("op"), F.lit(seq).cast("long").alias("seq"), F.col("n_tokens").cast("long").alias("n_tokens"))


def without_repeated_lines(text: Column) -> Column:
    return F.array_join(F.array_distinct(F.split(text, "\n", -1)), "\n")


def earlier_copies(docs: DataFrame) -> DataFrame:
    """doc_id of every document whose text a smaller doc_id has as well."""
    keyed = docs.where("text is not null").select("doc_id", F.sha2("text", 256).alias("h"))
    first = keyed.groupBy("h").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    return join_spread(keyed, first, ["h"], "doc_id").where("doc_id > first").select("doc_id")


def replay(docs: DataFrame, root: str, tokenizers: dict[str, tuple[str, str]]) -> TokenLedger:
    """A ledger of docs after three batches: all inserted; texts with repeated lines
    counted anew without them; copies of an earlier document deleted.  Batches
    that arrive twice count once."""
    ledger = TokenLedger(docs.sparkSession, root)
    new = without_repeated_lines(F.col("text"))
    ledger.commit("1-insert", as_changes(count_tokens(docs, tokenizers), "insert"))
    changed = docs.withColumn("_new", new).where(F.col("_new") != F.col("text")).withColumn("text", F.col("_new"))
    ledger.commit("2-revise", as_changes(count_tokens(changed, tokenizers), "revise", 1))
    none = F.lit(None).cast("string")
    each = F.explode(F.array(*map(F.lit, tokenizers))).alias("tokenizer")
    deletes = earlier_copies(docs).select("doc_id", none.alias("source"), none.alias("lang"), each, F.lit(0).alias("n_tokens"))
    ledger.commit("3-delete", as_changes(deletes, "delete", 2))
    ledger.commit("1-insert", as_changes(count_tokens(docs, tokenizers), "insert"))
    return ledger
