"""Named queries over the driver's tables, each with its DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audit, auditing, building, estimation, evaluation, events, matching, objects, snapping, terminals

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**events.QUERIES, **objects.QUERIES, **audit.QUERIES, **building.QUERIES, **evaluation.QUERIES, **estimation.QUERIES, **matching.QUERIES, **auditing.QUERIES, **snapping.QUERIES, **terminals.QUERIES}
SQL: dict[str, str] = {**events.SQL, **objects.SQL, **audit.SQL, **building.SQL, **evaluation.SQL, **estimation.SQL, **matching.SQL, **auditing.SQL, **snapping.SQL, **terminals.SQL}
