"""Mixing documents to target shares by iterative proportional fitting.

Documents are summed to cells (source, language, topic).  The cells' token
weights are raked to the target share of each dimension in turn, round after
round; the ratio of a cell's fitted to its observed tokens, scaled to a kept
share of all tokens, is the probability by which each of its documents is
sampled.  A cell cannot give more tokens than it has: a weight is held at that
bound in every step, so the rounds bring the rest to the targets, and `achieved`
tells what shares come of it.  Every document draws by a hash of its id, so a
rerun draws the same.

Only cells are raked: their number is bounded by the values of the dimensions,
not by documents, and the first sum is combined before it is shuffled.

Everything is built from DataFrame functions.

Defined results: null is a value of its own in every dimension; documents
without tokens count as one token; repeated rows share their fate; a value
without a target share, where no share is given for all others, is not sampled;
an empty table gives no rows; other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

WORD = r"[^\x20\x09-\x0D]+"
ROUNDS = 12
#: Cells up to this many are broadcast (some MB); more are joined by a shuffle.
BROADCAST_CELLS = 20_000
#: Rounds between two writes of the cells.
KEEP_EVERY = 3
#: In given shares: all values that are not named, in proportion to what they have.
OTHERS = "*"


def token_count(text: Column) -> Column:
    return F.greatest(F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)), F.lit(1)).cast("long")


def text_topic(text: Column, tokens: Column) -> Column:
    """A topic from the shape of a text: symbols, lists, long or short prose."""
    t = F.coalesce(text, F.lit(""))
    symbols = F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))
    lines = F.length(t) - F.length(F.translate(t, "\n", ""))
    return F.when(symbols * 2 > tokens, "symbols").when(lines * 20 > tokens, "lists").when(tokens > 400, "long").otherwise("short")


def draw(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the id and the seed."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f":{seed}")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def target_share(cells: DataFrame, d: str, target: dict | float, total: float) -> Column:
    """The target share of each cell's value in dimension d."""
    have = F.sum("tokens").over(Window.partitionBy(d)) / F.lit(total)
    if not isinstance(target, dict):
        parts = float(cells.groupBy(d).agg(F.pow(F.sum("tokens") / F.lit(total), F.lit(float(target))).alias("s")).agg(F.sum("s")).first()[0] or 1)
        return F.pow(have, F.lit(float(target))) / F.lit(parts)
    parts = float(sum(target.values()))
    given = {k: v / parts for k, v in target.items() if k not in (None, OTHERS)}
    named = F.col(d).isin(list(given)) if given else F.lit(False)
    named = F.when(F.col(d).isNull(), F.lit(None in target)).otherwise(named)
    rest = float(cells.where(~named).agg(F.sum("tokens")).first()[0] or total)
    share = F.lit(target.get(OTHERS, 0.0) / parts) * have * F.lit(total / rest)
    for k, v in given.items():
        share = F.when(F.col(d) == k, F.lit(v)).otherwise(share)
    return F.when(F.col(d).isNull() & F.lit(None in target), F.lit(target.get(None, 0.0) / parts)).otherwise(share)


def rake(cells: DataFrame, dims: list[str], targets: dict[str, dict | float], scratch: Scratch, rounds: int = ROUNDS, keep: float = 0.0, shares: bool = False) -> DataFrame:
    """cells (dims, tokens; a small table) with w: fitted tokens, of the same sum, whose shares meet each target.

    A target is a mapping from value to share (OTHERS: all that are not named),
    or an exponent that tempers the observed shares (1 keeps them, 0 makes them
    equal).  keep * w never exceeds tokens.  With shares the targets stay, as
    _t_ columns.
    """
    total = float(cells.agg(F.sum("tokens")).first()[0] or 1)
    df = cells.withColumn("w", F.col("tokens") / F.lit(total))
    df = df.withColumns({f"_t_{d}": target_share(cells, d, targets[d], total) for d in dims})
    df, before = scratch.keep(df, "raked-0"), "raked-0"
    most = F.col("tokens") / F.lit(keep * total) if keep else F.lit(float("inf"))
    for i in range(1, rounds + 1):
        for d in dims:
            have = F.sum("w").over(Window.partitionBy(d))
            df = df.withColumn("w", F.when(have > 0, F.least(F.col("w") * F.col(f"_t_{d}") / have, most)).otherwise(F.lit(0.0)))
        if i % KEEP_EVERY == 0 or i == rounds:
            df = scratch.keep(df, f"raked-{i}")
            scratch.drop(before)
            before = f"raked-{i}"
    df = df.withColumn("w", F.col("w") * F.lit(total))
    return df if shares else df.drop(*(f"_t_{d}" for d in dims))


def described(docs: DataFrame, topic: str | None = None) -> DataFrame:
    """docs with _tokens and _topic: the named column, or the shape of the text."""
    df = docs.withColumn("_tokens", token_count(F.col("text")))
    return df.withColumn("_topic", F.col(f"`{topic}`").cast("string") if topic else text_topic(F.col("text"), F.col("_tokens")))


DIMS = ["source", "lang", "_topic"]


def fitted_cells(df: DataFrame, targets: dict[str, dict | float], keep: float, rounds: int) -> DataFrame:
    """The cells of described documents with tokens, w and their targets."""
    scratch = Scratch(df.sparkSession, "mixing")
    cells = scratch.keep(df.groupBy(*DIMS).agg(F.sum("_tokens").alias("tokens")), "cells")
    return rake(cells, DIMS, {"source": targets["source"], "lang": targets["lang"], "_topic": targets["topic"]}, scratch, rounds, keep, True)


def with_rates(df: DataFrame, targets: dict[str, dict | float], keep: float = 0.5, rounds: int = ROUNDS, seed: int = 1) -> DataFrame:
    """Described documents with _p and _drawn.

    _p is fitted over observed tokens of the document's cell, scaled so that
    the sample expects the share `keep` of all tokens, and at most 1.
    """
    cells = fitted_cells(df, targets, keep, rounds)
    rates = cells.select(*(F.col(d).alias(f"c_{d}") for d in DIMS), F.least(F.lit(1.0), F.lit(float(keep)) * F.col("w") / F.col("tokens")).alias("_p"))
    if cells.count() <= BROADCAST_CELLS:
        rates = F.broadcast(rates)
    same = [F.col(d).eqNullSafe(F.col(f"c_{d}")) for d in DIMS]
    return df.join(rates, same[0] & same[1] & same[2]).withColumn("_drawn", draw(F.col("doc_id"), seed) < F.col("_p")).drop(*(f"c_{d}" for d in DIMS))


def achieved(docs: DataFrame, targets: dict[str, dict | float], keep: float = 0.5, rounds: int = ROUNDS, topic: str | None = None) -> DataFrame:
    """dimension, value, target, share: what part of the expected sample's tokens each value has, and should have."""
    cells = fitted_cells(described(docs.select("doc_id", "text", "source", "lang", *([f"`{topic}`"] if topic else [])), topic), targets, keep, rounds)
    total = F.sum(F.sum("w")).over(Window.partitionBy("dimension"))
    each = F.explode(F.array(*(F.struct(F.lit(d.strip("_")).alias("dimension"), F.col(d).alias("value"), F.col(f"_t_{d}").alias("target")) for d in DIMS))).alias("x")
    return cells.select("w", each).select("w", "x.*").groupBy("dimension", "value").agg(F.max("target").alias("target"), (F.sum("w") / total).alias("share"))


def sample_mix(docs: DataFrame, targets: dict[str, dict | float], keep: float = 0.5, rounds: int = ROUNDS, seed: int = 1, topic: str | None = None) -> DataFrame:
    """The sampled rows of docs, with its columns; topic names a column of docs, else the shape of the text stands for it."""
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")  # names of other columns cannot clash
    named = [F.col(f"`{topic}`").alias("_given")] if topic else []
    return with_rates(described(docs.select(whole, "doc_id", "text", "source", "lang", *named), "_given" if topic else None), targets, keep, rounds, seed).where("_drawn").select("_row.*")


def mixing_rates(docs: DataFrame, targets: dict[str, dict | float], keep: float = 0.5, rounds: int = ROUNDS, seed: int = 1) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, p, sampled of every row of docs."""
    small = described(docs.select("doc_id", "text", "source", "lang")).drop("text")
    # written once, so that texts are read once
    df = with_rates(Scratch(docs.sparkSession, "described").keep(small, "docs"), targets, keep, rounds, seed)
    return df.select("doc_id", "source", "lang", F.col("_topic").alias("topic"), F.col("_tokens").alias("n_tokens"), F.round("_p", 9).alias("p"), F.col("_drawn").alias("sampled"))


def mixing_sql(mix: dict[str, dict | float], keep: float = 0.5, rounds: int = ROUNDS, seed: int = 1) -> str:
    """`mixing_rates` over documents, in DuckDB's SQL."""
    dims = ["source", "lang", "topic"]
    n = "greatest(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')), 1)"
    steps = [
        f"d AS MATERIALIZED (SELECT doc_id, source, lang, coalesce(text, '') AS text, {n} AS n_tokens FROM documents)",
        "t AS MATERIALIZED (SELECT doc_id, source, lang, n_tokens, CASE WHEN (length(text) - length(translate(text, '#*$%&|<>', ''))) * 2 > n_tokens THEN 'symbols' "
        "WHEN (length(text) - length(replace(text, chr(10), ''))) * 20 > n_tokens THEN 'lists' WHEN n_tokens > 400 THEN 'long' ELSE 'short' END AS topic FROM d)",
        "s AS MATERIALIZED (SELECT CAST(sum(n_tokens) AS DOUBLE) AS total FROM t)",
        "c AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM t GROUP BY ALL)",
    ]
    targets = []
    for d in dims:
        have = f"sum(tokens) OVER (PARTITION BY {d}) / (SELECT total FROM s)"
        if isinstance(mix[d], dict):
            given = {k: v / sum(mix[d].values()) for k, v in mix[d].items()}
            named = f"{d} IN ({', '.join(repr(k) for k in given if k != OTHERS)})"
            steps.append(f"m_{d} AS MATERIALIZED (SELECT coalesce(sum(tokens), (SELECT total FROM s)) AS a FROM c WHERE NOT coalesce({named}, false))")
            whens = " ".join(f"WHEN {d} = {k!r} THEN {v!r}::DOUBLE" for k, v in given.items() if k != OTHERS)
            targets.append(f"CASE {whens} ELSE {given.get(OTHERS, 0.0)!r}::DOUBLE * {have} * ((SELECT total FROM s) / (SELECT a FROM m_{d})) END AS t_{d}")
        else:
            steps.append(f"m_{d} AS MATERIALIZED (SELECT {d}, pow(sum(tokens) / (SELECT total FROM s), {mix[d]}) AS a FROM c GROUP BY {d})")
            targets.append(f"pow({have}, {mix[d]}) / (SELECT sum(a) FROM m_{d}) AS t_{d}")
    steps.append(f"w0 AS MATERIALIZED (SELECT *, tokens / (SELECT total FROM s) AS w, {', '.join(targets)} FROM c)")
    last = "w0"
    for i in range(rounds):
        for d in dims:
            name = f"w{i + 1}_{d}"
            steps.append(f"{name} AS MATERIALIZED (SELECT * REPLACE (least(w * t_{d} / sum(w) OVER (PARTITION BY {d}), tokens / ({keep} * (SELECT total FROM s))) AS w) FROM {last})")
            last = name
    u = f"CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':{seed}'), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0"
    return f"WITH {', '.join(steps)}, p AS (SELECT source, lang, topic, least(1.0, {keep} * w * (SELECT total FROM s) / tokens) AS p FROM {last}) SELECT doc_id, t.source, t.lang, t.topic, n_tokens, round(p, 9) AS p, {u} < p AS sampled FROM t JOIN p ON t.source IS NOT DISTINCT FROM p.source AND t.lang IS NOT DISTINCT FROM p.lang AND t.topic = p.topic"
