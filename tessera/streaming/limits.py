"""Admission that depends on what was admitted before: rate limits and alerts with a cooldown.

Each works on the rows of one key in order of time. As a batch they run through ``applyInPandas``;
``stream`` runs the same fold over a stream, with the fold's state kept by Spark between batches.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class TokenBucket:
    """Up to ``burst`` tokens, refilled at ``rate`` a second; a request takes one."""

    rate: float
    burst: float
    tokens: float | None = None
    last: float | None = None

    def allow(self, now: float) -> bool:
        held = self.burst if self.tokens is None else min(self.burst, self.tokens + (now - self.last) * self.rate)
        self.last, ok = now, held >= 1.0
        self.tokens = held - 1 if ok else held
        return ok


@dataclass
class SlidingWindow:
    """Fewer than ``rate * window`` admitted in the last ``window`` seconds."""

    rate: float
    window: float
    admitted: list[float] = field(default_factory=list)

    def allow(self, now: float) -> bool:
        self.admitted = [t for t in self.admitted if t > now - self.window]
        ok = len(self.admitted) < int(self.rate * self.window)
        if ok:
            self.admitted.append(now)
        return ok


@dataclass
class FixedWindow:
    """At most ``rate * window`` admitted until ``window`` seconds have passed since the window began."""

    rate: float
    window: float
    began: float | None = None
    admitted: int = 0

    def allow(self, now: float) -> bool:
        if self.began is None or now - self.began > self.window:
            self.began, self.admitted = now, 0
        ok = self.admitted < int(self.rate * self.window)
        self.admitted += ok
        return ok


@dataclass
class Cooldown:
    """At least ``seconds`` since the last one allowed."""

    seconds: float
    last: float | None = None

    def allow(self, now: float) -> bool:
        ok = self.last is None or now - self.last >= self.seconds
        if ok:
            self.last = now
        return ok


def admitted(rows: DataFrame, rule: Callable[[], object], by: str, time: str, order: Sequence[str] = ()) -> DataFrame:
    """``rows`` with ``allowed``: whether each row of a key is admitted, in order of time, then ``order``.

    The rows of one key are handled in one place, as the answer depends on all before.
    """

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values([time, *order], kind="stable")
        state = rule()
        return group.assign(allowed=[state.allow(t.timestamp()) for t in group[time]])

    schema = rows.withColumn("allowed", F.lit(True)).schema
    return rows.groupBy(by).applyInPandas(fold, schema)


def stream(rows: DataFrame, rule: Callable[[], object], by: str, time: str, order: Sequence[str] = ()) -> DataFrame:
    """``admitted`` over a stream: batches of a key go on where the last one stopped."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    schema = rows.withColumn("allowed", F.lit(True)).schema

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = rule()
        if state.exists:
            now.__dict__.update(json.loads(state.get[0]))
        group = pd.concat(list(parts)).sort_values([time, *order], kind="stable")
        out = group.assign(allowed=[now.allow(t.timestamp()) for t in group[time]])
        state.update((json.dumps(now.__dict__),))
        yield out[[f.name for f in schema.fields]]

    return rows.groupBy(by).applyInPandasWithState(fold, schema, "state string", "append", GroupStateTimeout.NoTimeout)
