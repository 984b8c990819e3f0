"""A sequential estimator per run: one step function, in batch and in Structured Streaming.

Messages come in arrival order.  A stamp within the base (not more than `back`
behind the clock nor `ahead` of it) advances the clock; grid nodes up to a
message's stamp are emitted before its value is used.  A stamp outside the base
is held; three held messages in line from two topics, or ten from one, confirm
a new base: a gap if it lies ahead by no more than `gap`, else a reset.  A bad
value still advances the clock.  At each node the values that are fresh are
averaged, and a one-dimensional Kalman filter smooths them.

A message, or a batch of a stream, brings about at most `most_nodes` nodes at
once.  One whose stamp the grid has not reached waits, with all behind it, in a
queue that is part of the state; so a small bound delays rows and changes none.  After a reset rows show
the path of the session before, marked as fallback, until the new one has seen
a value.  A state that is no longer finite starts anew and keeps its path.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from math import isfinite

import pandas as pd
from pyspark.sql import DataFrame

from ..operators.folds import Fold, fold, output

HOUR = 3_600_000_000
OUT = "run long, node long, us long, speed double, variance double, path double, session int, stale boolean, fallback boolean"


@dataclass(frozen=True)
class Settings:
    step: int = 6 * HOUR
    back: int = 240 * HOUR
    ahead: int = 480 * HOUR
    gap: int = 2400 * HOUR
    fresh: int = 48 * HOUR
    most_value: float = 400.0
    drift: float = 25.0
    noise: float = 100.0
    most_nodes: int = 100_000


@dataclass
class State:
    clock: int | None = None
    node: int = 0
    session: int = 0
    speed: float = 0.0
    variance: float = 1e4
    path: float = 0.0
    last: dict[str, list] = field(default_factory=dict)
    held: list[list] = field(default_factory=list)
    queue: list[list] = field(default_factory=list)
    fallback: float | None = None


def _step(s: State, c: Settings) -> dict:
    us = s.node * c.step
    seen = [v for t, v in s.last.values() if us - t <= c.fresh]
    s.variance += c.drift
    if seen:
        gain = s.variance / (s.variance + c.noise / len(seen))
        s.speed += gain * (sum(seen) / len(seen) - s.speed)
        s.variance *= 1 - gain
        s.fallback = None
    if not (isfinite(s.speed) and isfinite(s.variance)):
        s.speed, s.variance, s.last = 0.0, 1e4, {}
    s.path += max(s.speed, 0.0) * c.step / HOUR
    waits = s.fallback is not None
    row = {"node": s.node, "us": us, "speed": s.speed, "variance": s.variance, "path": s.fallback if waits else s.path, "session": s.session, "stale": not seen, "fallback": waits}
    s.node += 1
    return row


def drain(s: State, c: Settings) -> Iterator[dict]:
    """The rows that the waiting messages bring about, at most `most_nodes`."""
    left = c.most_nodes
    while s.queue:
        topic, us, value = s.queue[0]
        if s.clock is None:
            s.clock, s.node = us, us // c.step
        if not s.clock - c.back <= us <= s.clock + c.ahead:
            del s.queue[0]
            s.held = [h for h in s.held if abs(h[1] - us) <= c.ahead] + [[topic, us, value]]
            if len(s.held) < (3 if len({h[0] for h in s.held}) > 1 else 10):
                continue
            held, s.held = s.held, []
            first = min(h[1] for h in held)
            if not s.clock < first <= s.clock + c.gap:
                s.fallback = s.path if s.fallback is None else s.fallback
                s.session, s.speed, s.variance, s.path, s.last = s.session + 1, 0.0, 1e4, 0.0, {}
            s.clock, s.node = first, first // c.step
            s.queue[:0] = held
            continue
        s.held = []
        while s.node * c.step <= us:
            if not left:
                return
            left -= 1
            yield _step(s, c)
        del s.queue[0]
        s.clock = max(s.clock, us)
        if value is not None and value == value and abs(value) <= c.most_value:
            s.last[topic] = [us, value]


def feed(s: State, c: Settings, topic: str, us: int, value: float | None) -> Iterator[dict]:
    """The rows that one message brings about, after those that wait."""
    s.queue.append([topic, us, value])
    yield from drain(s, c)


def as_fold(settings: Settings, changed: dict[str, Settings] | None = None) -> Fold:
    """The runner as a fold over messages (topic, us, value); with changed, also over branch and changed (whether the
    message lies behind the branch's departure), from where on changed[branch] holds, if there is one."""
    names = [x.split()[0] for x in OUT.split(", ")][1:]

    def step(s: State, m: dict) -> list[tuple]:
        own = settings if changed is None or not m["changed"] else changed.get(m["branch"], settings)
        v = m["value"]
        rows = list(feed(s, own, m["topic"], m["us"], None if v is None or v != v else v))
        while rest := list(drain(s, own)):
            rows += rest
        return [tuple(r[c] for c in names) for r in rows]

    return Fold(State, step, ["topic", "us", "value", *([] if changed is None else ["branch", "changed"])], OUT.removeprefix("run long, "))


def in_batch(df: DataFrame, settings: Settings) -> DataFrame:
    """Rows of OUT for messages (run, topic, seq, us, value).  A run streams through one task, which holds its state and
    one batch of messages."""
    return output(fold(df, ["run"], ["seq"], as_fold(settings))).drop("bucket")


def in_stream(df: DataFrame, settings: Settings) -> DataFrame:
    """The same for a streaming df; state is kept per run, and a batch is taken in arrival order.

    A batch gives at most `most_nodes` rows of a run.  What the messages ask for
    beyond waits in the state for the batches of the run's next messages.
    """
    names = [x.split()[0] for x in OUT.split(", ")]

    def run(key, frames, state) -> Iterator[pd.DataFrame]:
        s = State(**json.loads(state.get[0])) if state.exists else State()
        pdf = pd.concat(list(frames), ignore_index=True).sort_values("seq")
        s.queue += [[t, int(us), None if pd.isna(v) else float(v)] for t, us, v in zip(pdf["topic"], pdf["us"], pdf["value"], strict=True)]
        out = list(drain(s, settings))
        state.update((json.dumps(asdict(s)),))
        yield pd.DataFrame([{"run": key[0], **r} for r in out], columns=names)

    return df.groupBy("run").applyInPandasWithState(run, OUT, "state string", "append", "NoTimeout")


def smoothed(df: DataFrame, settings: Settings) -> DataFrame:
    """run, seq, speed, variance: a one-dimensional Kalman filter over each run's values in order."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x, p, out = 0.0, 1e4, []
        pdf = pdf.sort_values("seq")
        for v in pdf["value"]:
            p += settings.drift
            if v == v:
                g = p / (p + settings.noise)
                x, p = x + g * (v - x), p * (1 - g)
            out.append((x, p))
        return pd.DataFrame({"run": key[0], "seq": pdf["seq"], "speed": [o[0] for o in out], "variance": [o[1] for o in out]})

    return df.groupBy("run").applyInPandas(run, "run long, seq long, speed double, variance double")
