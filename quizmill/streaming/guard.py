"""Structured Streaming: guarded transitions per request, windowed counts with late data, resumable progress."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from quizmill.operators.lifecycle import EDGES

OUT = "rid string, seq long, from_state string, to_state string, accepted boolean"


def guarded(events: DataFrame, lenient: bool = False) -> DataFrame:
    """events (rid, seq, state) with the state before and whether the transition is allowed; a rejected one leaves the state as it is.

    One short state per request. Rows of a micro-batch are taken in order of seq. lenient: repeating the state is no event.
    """
    graph = set(EDGES)

    def step(key, frames, state):
        now = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values("seq")
        out = []
        for seq, to in zip(rows["seq"], rows["state"], strict=True):
            if lenient and now == to:
                continue
            ok = to == "REQUESTED" if now is None else (now, to) in graph
            out.append((key[0], seq, now, to, ok))
            now = to if ok else now
        if now is not None:
            state.update((now,))
        yield pd.DataFrame(out, columns=["rid", "seq", "from_state", "to_state", "accepted"])

    keyed = events.select(F.col("rid").cast("string").alias("rid"), F.col("seq").cast("long").alias("seq"), "state")
    return keyed.groupBy("rid").applyInPandasWithState(step, OUT, "state string", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, time: str, size: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Counts by state and tumbling (or sliding) window; data later than the watermark is dropped by definition of the feature."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return events.withWatermark(time, late).groupBy(w, "state").count()


def sessions(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap), key).count()


def progress(stream: DataFrame, path: str, checkpoint: str):
    """Appends a stream as JSON lines with a checkpoint, so that it goes on where it stopped."""
    return stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
