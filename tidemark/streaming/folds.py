"""Streaming forms of two folds: event-time bucket maxima with a watermark, and change points with state per stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def bucket_maxima(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """The strongest event of each stream and tumbling bucket; rows later than the watermark are dropped. events: (stream_id, ts timestamp, strength)."""
    return events.withWatermark("ts", late).groupBy("stream_id", F.window("ts", width)).agg(F.max("strength").alias("strength"), F.count("*").alias("n")).select("stream_id", F.col("window.start").alias("start"), "strength", "n")


def change_points(events: DataFrame, gap: float = 8.0) -> DataFrame:
    """Min-gap thinning as rows arrive: a stream's last point is held until one at least `gap` later comes, then it is final.
    events: (stream_id long, at double, strength double), in order within a stream."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else None
        out = []
        for at, strength in sorted(x for b in batches for x in b[["at", "strength"]].itertuples(index=False, name=None)):
            if held is not None and at - held[0] < gap:
                held = (at, strength) if strength >= held[1] else held
            else:
                out += [(key[0], *held)] if held is not None else []
                held = (at, strength)
        if held is not None:
            state.update(held)
        yield pd.DataFrame(out, columns=["stream_id", "at", "strength"])

    return events.groupBy("stream_id").applyInPandasWithState(step, "stream_id long, at double, strength double", "at double, strength double", "append", GroupStateTimeout.NoTimeout)
