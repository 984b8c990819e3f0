"""Row rules: coercion, validity, guards, truncation, normalised codes, lookup tables, small physics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number(text: Column) -> Column:
    """A double, or null for anything that is not a finite number."""
    x = text.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def valid_fix(us: Column, lat: Column, lon: Column, status: Column) -> Column:
    known = us.isNotNull() & lat.between(-90, 90) & lon.between(-180, 180) & (status >= 0)
    return F.coalesce(known & ~((lat == 0) & (lon == 0)), F.lit(False))


def guarded(value: Column, most: float) -> Column:
    """Null where a value is out of range; the row and its stamp stay."""
    return F.when(F.abs(value) <= most, value)


def clamped(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def code_of(name: Column, codes: dict[str, list[str]]) -> Column:
    """The code whose aliases hold the lower-cased name; others raise an error."""
    n = F.lower(F.trim(name))
    out = F
    for code, aliases in codes.items():
        out = out.when(n.isin(*aliases), code)
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown name: "), name)))


def table_1d(x: Column, grid: list[float], values: list[float]) -> Column:
    """Clamped linear interpolation in a small table."""
    out = F.when(x <= grid[0], F.lit(values[0]))
    for (a, va), (b, vb) in zip(zip(grid, values, strict=True), list(zip(grid, values, strict=True))[1:], strict=False):
        out = out.when(x <= b, va + (vb - va) * ((x - a) / (b - a)))
    return F.when(x.isNotNull(), out.otherwise(F.lit(values[-1])))


def table_2d(x: Column, y: Column, nx: int, ny: int, step_x: float, step_y: float, values: list[float]) -> Column:
    """Clamped bilinear interpolation on an even grid from 0; values row by row."""
    p, q = (clamped(c / s, 0.0, n - 1.0) for c, s, n in ((x, step_x, nx), (y, step_y, ny)))
    i, j = F.least(F.floor(p), F.lit(nx - 2)), F.least(F.floor(q), F.lit(ny - 2))
    at = lambda a, b: F.get(F.lit(values), ((i + a) * ny + j + b).cast("int"))
    u, v = p - i, q - j
    return at(0, 0) * (1 - u) * (1 - v) + at(1, 0) * u * (1 - v) + at(0, 1) * (1 - u) * v + at(1, 1) * u * v


def sigma_of(*parts: Column) -> Column:
    """The root of the sum of squares."""
    return F.sqrt(sum((p * p for p in parts[1:]), parts[0] * parts[0]))


def resistance(v: Column, a: float, b: float, c: float) -> Column:
    """Running resistance, against the motion."""
    return F.signum(v) * (a + b * F.abs(v) + c * v * v)


def drive_force(u: Column, v: Column, most: float, power: float) -> Column:
    """Force for a demand in -1..1: limited by force, and by power for traction at speed."""
    limit = F.least(F.lit(most), power / F.greatest(F.abs(v), F.lit(0.1)))
    return F.when(u >= 0, u * limit).otherwise(u * most)


def adhesion_clip(force: Column, mu: float, load: float) -> Column:
    return clamped(force, -mu * load, mu * load)


def median_of(values: Column) -> Column:
    """The median of a small array."""
    s, n = F.array_sort(values), F.size(values)
    return (F.get(s, ((n - 1) / 2).cast("int")) + F.get(s, (n / 2).cast("int"))) / 2


def published(df: DataFrame, by: list[str], arrival: str, stamp: str) -> DataFrame:
    """Rows whose stamp is later than all before them, in arrival order."""
    w = Window.partitionBy(*by).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    last = F.max(stamp).over(w)
    return df.withColumn("_last", last).where(F.col("_last").isNull() | (F.col(stamp) > F.col("_last"))).drop("_last")


def start_sorted(df: DataFrame, by: str, arrival: str, stamp: str, span: int) -> DataFrame:
    """df with place: rows that arrive within span of the first stand in stamp order, the others in arrival order."""
    start = F.min(arrival).over(Window.partitionBy(by))
    df = df.withColumn("_late", (F.col(arrival) >= start + span).cast("int"))
    key = F.when(F.col("_late") == 0, F.col(stamp)).otherwise(F.col(arrival))
    return df.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy("_late", key, arrival))).drop("_late")


def confirmed(df: DataFrame, by: list[str], on: str, value: str, last: int, tolerance: float, persist: int) -> DataFrame:
    """df with agreed: the last rows lie within the tolerance and span at least persist."""
    w = Window.partitionBy(*by).orderBy(on).rowsBetween(1 - last, 0)
    near = (F.count(value).over(w) == last) & (F.max(value).over(w) - F.min(value).over(w) <= tolerance)
    return df.withColumn("agreed", near & (F.col(on) - F.min(on).over(w) >= persist))


def decimated(df: DataFrame, by: list[str], order: str, k: int, value: str) -> DataFrame:
    """Every k-th row and the last, with peak: the greatest |value| within k // 2 rows."""
    w = Window.partitionBy(*by).orderBy(order)
    df = df.withColumn("_n", F.row_number().over(w) - 1).withColumn("_all", F.count("*").over(Window.partitionBy(*by)))
    df = df.withColumn("peak", F.max(F.abs(F.col(value))).over(w.rowsBetween(-(k // 2), k // 2)))
    return df.where((F.col("_n") % k == 0) | (F.col("_n") == F.col("_all") - 1)).drop("_n", "_all")


def densified(df: DataFrame, by: str, order: str, x: str, y: str, spacing: float) -> DataFrame:
    """by, node, x, y: points at every spacing of arc length along each line."""
    w = Window.partitionBy(by).orderBy(order)
    step = F.sqrt((F.col(x) - F.lag(x).over(w)) ** 2 + (F.col(y) - F.lag(y).over(w)) ** 2)
    df = df.withColumn("_d", F.coalesce(step, F.lit(0.0))).withColumn("_s", F.sum("_d").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    seg = df.select(by, F.lag("_s").over(w).alias("a"), F.col("_s").alias("b"), F.lag(x).over(w).alias("xa"), F.lag(y).over(w).alias("ya"), F.col(x).alias("xb"), F.col(y).alias("yb")).where("b > a")
    # nodes in (a, b] of a segment, and the very first point
    low = F.floor(F.col("a") / spacing) + F.when(F.col("a") == 0, 0).otherwise(1)
    high = F.floor(F.col("b") / spacing)
    seg = seg.where(low <= high).withColumn("node", F.explode(F.sequence(low, high)))
    t = (F.col("node") * spacing - F.col("a")) / (F.col("b") - F.col("a"))
    return seg.select(by, "node", (F.col("xa") + (F.col("xb") - F.col("xa")) * t).alias("x"), (F.col("ya") + (F.col("yb") - F.col("ya")) * t).alias("y"))


def shaped(array: Column, width: int, least: int) -> Column:
    """An array as rows of that width; empty if it is null or shorter than least."""
    rows = F.transform(F.sequence(F.lit(0), F.floor(F.size(array) / width).cast("int") - 1), lambda i: F.slice(array, i * width + 1, F.lit(width)))
    return F.when(array.isNotNull() & (F.size(array) >= max(least, width)), rows).otherwise(F.array())


def valid_row(flag: Column, *values: Column) -> Column:
    """Is a row marked as valid, with all values finite."""
    ok = F.coalesce(flag, F.lit(False))
    for v in values:
        ok = ok & v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return F.coalesce(ok, F.lit(False))


def without_after(df: DataFrame, by: str, on: str, topic: str, gone: list[str], first: str, length: int) -> DataFrame:
    """df without the rows of the topics in gone that come `length` or more after the key's first row of the topic `first`."""
    begin = F.min(F.when(F.col(topic) == first, F.col(on))).over(Window.partitionBy(by))
    return df.withColumn("_begin", begin).where(~(F.col(topic).isin(gone) & F.coalesce(F.col(on) >= F.col("_begin") + length, F.lit(False)))).drop("_begin")


def fused(df: DataFrame, by: str, order: list[str], a: str, b: str, least: float, most: float, share: float) -> DataFrame:
    """df with point: at that share of the way from a to b where their distance is plausible (by_pair), else a and
    that share of the last plausible way."""
    way = F.when(F.abs(F.col(b) - F.col(a)).between(least, most), F.col(b) - F.col(a))
    last = F.last(way, True).over(Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("point", F.col(a) + share * F.coalesce(way, last)).withColumn("by_pair", way.isNotNull())


def bounded_by(df: DataFrame, by: list[str], level: str, rest: int, value: str) -> DataFrame:
    """df (a small table) with fixed: value, at levels above rest not below that of rest, below it not above; and whether the bound took effect."""
    base = df.where(F.col(level) == rest).select(*by, F.col(value).alias("_rest"))
    d = df.join(base, by)
    fixed = F.when(F.col(level) > rest, F.greatest(value, "_rest")).when(F.col(level) < rest, F.least(value, "_rest")).otherwise(F.col(value))
    return d.withColumn("fixed", fixed).withColumn("bound", F.col("fixed") != F.col(value)).drop("_rest")
