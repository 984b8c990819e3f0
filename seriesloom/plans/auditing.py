"""The query of the run audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..operators import audit
from ..sources.tables import series
from .events import HOUR, S

QUERIES, SQL = {}, {}
DAY = 24 * HOUR
TOPICS, INPUTS = ["click", "view", "purchase", "signup", "error"], ["click", "view", "purchase"]
RULES = audit.AuditRules(late=12 * HOUR, gap=4 * DAY, slight=2 * HOUR, start=3 * DAY, epoch=HOUR, moving=90.0, looks=(2 * DAY, 5 * DAY))


def _sql(r: audit.AuditRules) -> str:
    glitch = f"rel > {r.start} AND abs(g) > {r.late}"
    f = {
        "n": "count(*)", "first_s": "min(rel) / 1e6", "tail_s": "(min(t1) - max(tb)) / 1e6", "rate": "(count(*) - 1) / nullif((max(tb) - min(tb)) / 1e6, 0)", "max_gap_s": "max(dtb) / 1e6",
        "gaps": f"count(*) FILTER (dtb > {r.late})", "long_gaps": f"count(*) FILTER (dtb > {r.gap})", "dropped_s": f"sum(dtb) FILTER (dtb > {r.late}) / 1e6", "arrival_dup": "count(*) FILTER (dtb = 0)",
        "stamp_gap_s": "max(dth) / 1e6", "back": "count(*) FILTER (dth < 0)", "back_max_s": "max(-dth) FILTER (dth < 0) / 1e6", "dup": "count(*) FILTER (dth = 0)", "zero": "count(*) FILTER (th = 0)",
        "off_med_s": "max(med) / 1e6", "off_min_s": "min(off) / 1e6", "off_max_s": "max(off) / 1e6", "off_std_s": "stddev_pop(off) / 1e6", "off_big": f"count(*) FILTER (off > {r.late})", "off_last_s": f"max(rel) FILTER (off > {r.late}) / 1e6",
        "epochs": f"count(*) FILTER (th <> 0 AND th % {r.epoch} = 0) / nullif(count(off), 0)", "start_backlog": f"count(*) FILTER (rel <= {r.start} AND g > {r.late})", "start_backlog_s": f"max(g) FILTER (rel <= {r.start}) / 1e6",
        "ahead": f"count(*) FILTER (rel > {r.start} AND g < -{r.late})", "behind": f"count(*) FILTER (rel > {r.start} AND g > {r.late})", "glitch_first_s": f"min(rel) FILTER ({glitch}) / 1e6", "glitch_last_s": f"max(rel) FILTER ({glitch}) / 1e6",
        "glitch_most_s": f"max(abs(g)) FILTER ({glitch}) / 1e6", "nulls": "count(*) - count(value)", "neg": "count(*) FILTER (value < 0)", "least": "min(value)", "most": "max(value)", "begins": "arg_min(value, struct_pack(a := tb, b := seq))",
        "changes": "count(*) FILTER (value <> pv)", "rest_share": "count(*) FILTER (value = 0) / nullif(count(value), 0)",
    }
    per = ", ".join(f"{f[k]} AS {k}" for k in audit.FIGURES)
    shown = lambda k, t: f"max({k}) FILTER (topic = '{t}')"
    side = ", ".join(f"round({shown(k, t)}, 5) + 0.0 AS {k}_{t}" for t in TOPICS for k in audit.FIGURES)
    looks = ", ".join(f"round(max(value) FILTER (rel <= {x}), 5) + 0.0 AS most_in_{x // 1_000_000}_s, max(value) FILTER (rel <= {x}) > {r.moving} AS moving_in_{x // 1_000_000}_s" for x in r.looks)
    sums = ", ".join(f"sum({k})::BIGINT AS all_{k}" for k in ("zero", "back", "off_big", "start_backlog"))
    inputs = ", ".join(f"'{t}'" for t in INPUTS)
    return f"""WITH {S}, r AS (SELECT run, topic, seq, us AS tb, CASE WHEN seq % 53 = 0 THEN 0 WHEN seq % 31 = 0 THEN us + 86400000000 WHEN seq % 29 = 0 THEN us - 172800000000 ELSE us // 600000000 * 600000000 - (seq % 7) * 600000000 END AS th, CASE WHEN seq % 19 = 0 THEN 0.0 ELSE value END AS value FROM s),
d AS (SELECT *, min(tb) OVER (PARTITION BY run) AS t0, max(tb) OVER (PARTITION BY run) AS t1, tb - lag(tb) OVER w AS dtb, th - lag(th) OVER w AS dth, lag(value) OVER w AS pv, CASE WHEN th <> 0 THEN tb - th END AS off FROM r WINDOW w AS (PARTITION BY run, topic ORDER BY tb, seq)),
m AS (SELECT run, topic, quantile_cont(off, 0.5) AS med FROM d GROUP BY run, topic), e AS (SELECT d.*, med, tb - t0 AS rel, off - med AS g FROM d JOIN m USING (run, topic)),
p AS (SELECT run, topic, {per} FROM e GROUP BY run, topic), w AS (SELECT run, min(tb) AS start, (max(tb) - min(tb)) / 1e6 AS seconds FROM r GROUP BY run),
q AS (SELECT run, sum(n)::BIGINT AS rows, count(*) AS topics, count(*) = {len(TOPICS)} AS complete, {sums}, round(max(off_last_s), 5) + 0.0 AS backlog_last_s, round(max(off_max_s), 5) + 0.0 AS worst_off_s, round(max(glitch_last_s - glitch_first_s), 5) + 0.0 AS glitch_span_s, {side} FROM p GROUP BY run),
k AS (SELECT *, tb - t0 AS rel, max(th) OVER (PARTITION BY run ORDER BY tb, seq ROWS UNBOUNDED PRECEDING) AS clock FROM d WHERE topic IN ({inputs})), l AS (SELECT *, clock - lag(clock) OVER (PARTITION BY run ORDER BY tb, seq) AS leap, clock - th AS late FROM k),
o AS (SELECT run, count(*) FILTER (rel <= {r.start} AND late > {r.slight}) AS late_start, round(max(late) FILTER (rel <= {r.start}) / 1e6, 5) + 0.0 AS late_start_s, count(*) FILTER (rel > {r.start} AND late > {r.slight}) AS late_mid, round(max(late) FILTER (rel > {r.start}) / 1e6, 5) + 0.0 AS late_mid_s,
count(*) FILTER (rel > {r.start} AND leap > {r.late}) AS leaps, round(max(leap) FILTER (rel > {r.start}) / 1e6, 5) + 0.0 AS leap_s, {looks} FROM l GROUP BY run)
SELECT w.start, round(w.seconds, 5) + 0.0 AS seconds, q.*, o.* EXCLUDE (run) FROM w JOIN q USING (run) LEFT JOIN o USING (run)"""


def run_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as they arrived; stamps lag a little, some are missing, some a day ahead or two behind."""
    k, us = F.col("seq"), F.col("us")
    ten = F.lit(600_000_000)
    th = F.when(k % 53 == 0, 0).when(k % 31 == 0, us + DAY).when(k % 29 == 0, us - 2 * DAY).otherwise(us - us % ten - k % 7 * ten)
    d = series(spark, sf_dir).select("run", "topic", "seq", us.alias("tb"), th.cast("long").alias("th"), F.when(k % 19 == 0, 0.0).otherwise(F.col("value")).alias("value"))
    d = audit.run_audit(d, TOPICS, INPUTS, RULES, 10 * DAY)
    sided = {f"{f}_{t}" for f in audit.FIGURES for t in TOPICS}
    doubles = {f.name for f in d.schema if isinstance(f.dataType, DoubleType)} | sided
    return d.select(*((F.round(F.col(c).cast("double"), 5) + 0.0).alias(c) if c in doubles else F.col(c) for c in d.columns))


QUERIES["run_audit"], SQL["run_audit"] = run_audit, _sql(RULES)
