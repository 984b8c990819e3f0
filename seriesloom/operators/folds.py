"""Sequential folds over keyed rows whose states can be kept, resumed and branched.

A fold goes through the rows of a key in order and carries a state; each row
may give rows of output.  Rows stream past: a task holds one state and one
Arrow batch, however long a key is.  Beside the output, the state before the
first row of every bucket (a stretch of the order column) can be given out.
From such a state the fold goes on without the rows before it:

* `Timeline` keeps rows, states and output of versions as tables, so that rows
  that come late are folded in from the bucket they fall into;
* `branches` starts any number of what-if runs from states by a join.

A key is one task while it is folded, as each row depends on the state before;
put what does not depend on it (joins, pairing, residuals) before the fold.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import asdict, dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .lineage import cut

#: Output rows that leave a task together.
TOGETHER = 4096


@dataclass(frozen=True)
class Fold:
    """state: a dataclass of plain values, made without arguments; step(state, row) changes it and gives output tuples.

    row is a dict of `columns`; out is the schema of the output tuples.
    """

    state: Callable[..., Any]
    step: Callable[[Any, dict], Iterable[tuple]]
    columns: list[str]
    out: str


def bucket_of(on: str, width: int) -> Column:
    return F.floor(F.col(on) / width).cast("long")


def fold(rows: DataFrame, by: list[str], order: list[str], f: Fold, bucket: Column | None = None, start: DataFrame | None = None) -> DataFrame:
    """by, bucket, state and the columns of f.out: rows of output (state null) and, with a bucket, states (JSON) as they are
    before the first row of each bucket.

    start: by and state, from which keys go on; a key without one, or with a null one, starts anew.
    """
    spark = rows.sparkSession
    taken = rows.select(*by, *[F.col(c) for c in dict.fromkeys([*order, *f.columns]) if c not in by], (bucket if bucket is not None else F.lit(None).cast("long")).alias("_bucket"), F.lit(None).cast("string").alias("_state"))
    if start is not None:
        taken = taken.unionByName(start.where(F.col("state").isNotNull()).select(*by, F.col("state").alias("_state")), allowMissingColumns=True)
    taken = taken.withColumn("_first", F.when(F.col("_state").isNotNull(), 0).otherwise(1)).repartition(*by).sortWithinPartitions(*by, "_first", *order)
    keys = [rows.schema[c] for c in by]
    schema = StructType([*keys, StructField("bucket", LongType()), StructField("state", StringType()), *spark.createDataFrame([], f.out).schema.fields])
    kinds, names, width, stepped = to_arrow_schema(schema), [x.name for x in schema.fields], len(schema.fields) - len(by) - 2, bucket is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, at, held = None, None, None, []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*held, strict=True)) if held else [[] for _ in names]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds.types, strict=True)], names)

        for batch in batches:
            cols = {c: batch.column(c).to_pylist() for c in batch.schema.names}
            ids = list(zip(*(cols[c] for c in by), strict=True))
            for i, own in enumerate(ids):
                if own != key or at is None:
                    key, state, at = own, f.state(), (None,)
                if cols["_first"][i] == 0:
                    state = f.state(**json.loads(cols["_state"][i]))
                    continue
                b = cols["_bucket"][i]
                if stepped and at != (b,):
                    at = (b,)
                    held.append((*own, b, json.dumps(asdict(state)), *[None] * width))
                held.extend((*own, b, None, *out) for out in f.step(state, {c: cols[c][i] for c in f.columns}))
                if len(held) >= TOGETHER:
                    yield flush()
        yield flush()

    return taken.mapInArrow(run, schema)


def output(folded: DataFrame) -> DataFrame:
    return folded.where("state is null").drop("state")


def states(folded: DataFrame, by: list[str]) -> DataFrame:
    return folded.where("state is not null").select(*by, "bucket", "state")


def last_state(kept: DataFrame, wanted: DataFrame, by: list[str], label: list[str]) -> DataFrame:
    """by, label, bucket and state: for each row of wanted (by, label, bucket) the latest state at or before its bucket, or none."""
    met = wanted.join(kept.withColumnRenamed("bucket", "_at"), by, "left").where(F.col("_at").isNull() | (F.col("_at") <= F.col("bucket")))
    best = met.groupBy(*by, *label).agg(F.max_by(F.struct(F.col("_at").alias("bucket"), "state"), "_at").alias("s"))
    return wanted.select(*by, *label).distinct().join(best, [*by, *label], "left").select(*by, *label, "s.bucket", "s.state")


def branches(rows: DataFrame, kept: DataFrame, by: list[str], order: list[str], on: str, width: int, f: Fold, plan: DataFrame, alter: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """Output of f for every branch of plan (by, branch, at): the run as it was up to `at`, altered from there on.

    A branch starts from the latest kept state (by, bucket of `on`, state) whose
    bucket is not behind `at`; no row before that bucket is read for it.  alter
    gets the rows with branch and changed (whether they lie at or behind `at`)
    and may change their values.  Only output at or behind `at` is returned,
    where f.out names `on`; else all from the bucket on.
    """
    wanted = plan.withColumn("bucket", bucket_of("at", width))
    begin = last_state(kept, wanted.select(*by, "branch", "bucket"), by, ["branch"])
    plan = plan.select(*by, "branch", F.col("at").alias("_departs"))
    begin = cut(begin.join(plan, [*by, "branch"]))
    behind = rows.withColumn("_bucket", bucket_of(on, width)).join(begin.select(*by, "branch", "_departs", F.col("bucket").alias("_from")), by)
    behind = behind.where(F.col("_from").isNull() | (F.col("_bucket") >= F.col("_from")))
    behind = alter(behind.withColumn("changed", F.col(on) >= F.col("_departs")).drop("_bucket", "_from", "_departs"))
    key = [*by, "branch"]
    out = output(fold(behind, key, order, f, None, begin.select(*key, "state"))).drop("bucket")
    if on not in out.columns:
        return out
    return out.join(plan, key).where(F.col(on) >= F.col("_departs")).drop("_departs")


class Timeline:
    """Rows, states and output of a fold in versions, under a folder that all executors share.

    `commit` adds rows, in any order of time, under a version number.  Of every
    key it touches it takes the latest state before the first new row, reads
    the rows from that state's bucket on (whole bucket folders before are not
    read) and folds them again.  A version's folders are overwritten when it is
    committed again, and only versions up to the one read count, so a commit
    that broke off is repeated without harm.
    """

    def __init__(self, spark: SparkSession, root: str, by: list[str], order: list[str], on: str, width: int, f: Fold):
        self.spark, self.root, self.by, self.order, self.on, self.width, self.f = spark, root.rstrip("/"), by, order, on, width, f
        self.versions: list[int] = []

    def _read(self, name: str) -> DataFrame | None:
        paths = [f"{self.root}/{name}/version={v}" for v in self.versions]
        return self.spark.read.option("basePath", f"{self.root}/{name}").parquet(*paths) if paths else None

    def commit(self, new: DataFrame, version: int) -> None:
        """Fold new rows in; versions are committed in rising order."""
        self.versions = [v for v in self.versions if v < version]
        before = self.states()
        new = new.withColumn("_bucket", bucket_of(self.on, self.width))
        new.write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.root}/rows/version={version}")
        self.versions.append(version)
        rows = self._read("rows")
        touched = rows.where(F.col("version") == version).groupBy(*self.by).agg(F.min("_bucket").alias("bucket"))
        if before is None:
            begin = touched.select(*self.by, F.lit(None).cast("long").alias("bucket"), F.lit(None).cast("string").alias("state"))
        else:
            begin = last_state(before, touched, self.by, [])
        begin.write.mode("overwrite").parquet(f"{self.root}/begins/version={version}")
        begin = self.spark.read.schema(begin.schema).parquet(f"{self.root}/begins/version={version}")
        first = begin.agg(F.min("bucket"), F.sum(F.col("bucket").isNull().cast("long"))).first()
        if not first[1] and first[0] is not None:
            rows = rows.where(F.col("_bucket") >= first[0])
        again = rows.join(begin.select(*self.by, F.col("bucket").alias("_from")), self.by).where(F.col("_from").isNull() | (F.col("_bucket") >= F.col("_from")))
        folded = fold(again.drop("_from", "version"), self.by, self.order, self.f, F.col("_bucket"), begin.select(*self.by, "state"))
        folded.withColumn("kind", F.when(F.col("state").isNull(), "row").otherwise("state")).write.mode("overwrite").partitionBy("kind").parquet(f"{self.root}/folded/version={version}")

    def _valid(self) -> DataFrame | None:
        """What has been folded and no later version has folded again."""
        folded, begins = self._read("folded"), self._read("begins")
        if folded is None:
            return None
        later = begins.groupBy(*self.by).agg(F.collect_list(F.struct(F.col("version").alias("v"), F.col("bucket").alias("b"))).alias("_later"))
        again = F.exists("_later", lambda x: (x["v"] > F.col("version")) & (x["b"].isNull() | (x["b"] <= F.col("bucket"))))
        return folded.join(later, self.by).where(~again).drop("_later", "version")

    def states(self) -> DataFrame | None:
        valid = self._valid()
        return valid if valid is None else valid.where("kind = 'state'").select(*self.by, "bucket", "state")

    def output(self) -> DataFrame:
        return self._valid().where("kind = 'row'").drop("kind", "state", "bucket")
