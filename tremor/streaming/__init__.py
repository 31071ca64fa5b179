"""Streaming extensions: hysteresis state per recording, and windowed energies with late data."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def hysteresis_stream(scores: DataFrame, enter: float = 0.75, exit_: float = 0.40) -> DataFrame:
    """(recording_id, n, p, state) of a stream of scores, in order of n within each batch; the state lives between batches."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        active = state.get[0] if state.exists else 0
        for pdf in sorted(frames, key=lambda f: f["n"].min()):
            rows = pdf.sort_values("n")
            mark = pd.Series(float("nan"), index=rows.index).mask(rows["p"] >= enter, 1.0).mask(rows["p"] < exit_, 0.0)
            on = mark.ffill().fillna(active).astype(int)
            active = int(on.iloc[-1]) if len(on) else active
            yield pd.DataFrame({"recording_id": key[0], "n": rows["n"], "p": rows["p"], "state": on})
        state.update((active,))

    return scores.groupBy("recording_id").applyInPandasWithState(step, "recording_id long, n long, p double, state int", "active int", "append", GroupStateTimeout.NoTimeout)


def windowed_energy(events: DataFrame, time: str = "ts", late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Energy and count of each event type per window; rows later than the watermark are left out."""
    rows = events.withColumn("__ts", F.col(time).cast("timestamp")).withWatermark("__ts", late)
    made = rows.groupBy(F.window("__ts", size), "event_type").agg(F.sum(F.col("value") * F.col("value")).alias("energy"), F.count("*").alias("n"))
    return made.select("event_type", F.col("window.start").alias("start"), "energy", "n")
