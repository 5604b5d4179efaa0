"""Which readers are due for a run, and whether anything has changed since their last one.

Each reader's state is the fingerprint of the last run, the newest one seen since,
and when the last run was. The first sign of a reader is a run; from then on a
timer of event time rings every ``every``, without any input: if the newest
fingerprint is that of the last run, the run is skipped (``unchanged``), else it
is due (``run``). A null or empty fingerprint never counts as unchanged. State is
bounded by one small row a reader.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DUE = "user string, at timestamp, action string, fingerprint string"
_STATE = "anchor long, done string, newest string, newest_at long"


def unchanged(a: Column, b: Column) -> Column:
    """Are two fingerprints there and equal?"""
    return F.coalesce((F.length(a) > 0) & (a == b), F.lit(False))


def due_runs(stream: DataFrame, every_minutes: int, late: str) -> DataFrame:
    """(user, at, action, fingerprint) of every due time, from a stream of (user, at, fingerprint); signs later than ``late`` may be missed.

    A due time passes when the reader's own signs, or the watermark, have passed it.
    """
    every = every_minutes * 60_000_000

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        anchor, done, newest, newest_at = state.get if state.exists else (None, None, None, None)
        out: list[tuple] = []

        def ring(until: int) -> None:
            nonlocal anchor, done
            while anchor is not None and anchor + every <= until:
                anchor += every
                same = bool(newest) and newest == done
                done = newest
                out.append((key[0], anchor, "unchanged" if same else "run", newest))

        signs = []
        if not state.hasTimedOut:
            for frame in frames:
                micros = frame["at"].astype("datetime64[us]").astype("int64")
                signs += [(t, None if f is None or f != f else f) for t, f in zip(micros.tolist(), frame["fingerprint"].tolist(), strict=True)]
        for at, fingerprint in sorted(signs, key=lambda s: (s[0], s[1] or "")):
            ring(at - 1)  # what arrives at the due time itself still counts for it
            if newest_at is None or at >= newest_at:
                newest, newest_at = fingerprint, at
            if anchor is None:
                anchor, done = at, fingerprint
                out.append((key[0], at, "run", fingerprint))
        ring(state.getCurrentWatermarkMs() * 1000)
        state.update((anchor, done, newest, newest_at))
        state.setTimeoutTimestamp(max((anchor + every) // 1000, state.getCurrentWatermarkMs() + 1))
        if out:
            rows = pd.DataFrame(out, columns=["user", "at", "action", "fingerprint"])
            rows["at"] = pd.to_datetime(rows["at"], unit="us")
            yield rows

    keyed = stream.select(F.col("user").cast("string").alias("user"), F.col("at").cast("timestamp").alias("at"), F.col("fingerprint").cast("string").alias("fingerprint"))
    keyed = keyed.filter("user is not null and at is not null").withWatermark("at", late)
    return keyed.groupBy("user").applyInPandasWithState(step, DUE, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def run_summary(runs: DataFrame) -> DataFrame:
    """(action, n, users) over all due times."""
    return runs.groupBy("action").agg(F.count("*").alias("n"), F.countDistinct("user").alias("users"))
