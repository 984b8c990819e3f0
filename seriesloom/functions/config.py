"""Typed parameter sheets: defaults, files, overrides; and tables for reports."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, fields, replace
from typing import TypeVar

from pyspark.sql import DataFrame

T = TypeVar("T")


def overridden(sheet: T, text: str) -> T:
    """sheet (a frozen dataclass) with 'k=v,k=v' applied; values take the field's type, unknown keys are errors."""
    kinds = {f.name: type(getattr(sheet, f.name)) for f in fields(sheet)}
    new = {}
    for part in filter(None, (p.strip() for p in text.split(","))):
        key, eq, value = (x.strip() for x in part.partition("="))
        if key not in kinds or not eq:
            raise KeyError(f"unknown or malformed parameter {part!r}")
        new[key] = value.lower() in ("1", "true", "yes", "on") if kinds[key] is bool else kinds[key](value)
    return replace(sheet, **new)


def loaded(sheet: T, path: str) -> T:
    """sheet with the values of a JSON file; unknown keys are errors."""
    with open(path) as f:
        values = json.load(f)
    if unknown := values.keys() - {x.name for x in fields(sheet)}:
        raise KeyError(f"unknown parameters {sorted(unknown)}")
    return replace(sheet, **values)


def digest(sheet) -> str:
    """A name for results that depend on the sheet alone."""
    return hashlib.sha256(json.dumps(asdict(sheet), sort_keys=True).encode()).hexdigest()[:16]


def markdown(df: DataFrame, digits: int = 3, most: int = 200) -> str:
    """An aligned Markdown table of a small result; the report is cut after `most` rows and says so."""
    rows = df.limit(most + 1).collect()
    show = lambda v: "" if v is None else f"{v:,.{digits}f}" if isinstance(v, float) else f"{v:,}" if isinstance(v, int) and not isinstance(v, bool) else str(v)
    body = [[show(v) for v in r] for r in rows[:most]]
    width = [max(map(len, [n, *(r[i] for r in body)])) for i, n in enumerate(df.columns)]
    right = [t in ("int", "bigint", "double", "float") for _, t in df.dtypes]
    line = lambda cells: "| " + " | ".join(c.rjust(w) if r else c.ljust(w) for c, w, r in zip(cells, width, right, strict=True)) + " |"
    rule = "|" + "|".join("-" * (w + 1) + (":" if r else "-") for w, r in zip(width, right, strict=True)) + "|"
    return "\n".join([line(df.columns), rule, *map(line, body)] + ["More rows are not shown."] * (len(rows) > most))
