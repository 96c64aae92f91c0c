"""The canonical decoding on a stream of frames.

A track's open run is state: it is emitted when a frame with another label or a gap comes, or when no frame of the
track has come for a while. Frames of a track are taken in order within a batch; a frame at or before the last one of
the state is late and left out. Centred features need frames to come and stay a matter of batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trackloom.operators.decode import thresholds, winner

OUT = "track string, action string, start_frame bigint, stop_frame bigint"
STATE = "action string, start_frame bigint, last_frame bigint"


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, idle_ms: int | None) -> Iterator[pd.DataFrame]:
    done, open_run = [], state.get if state.exists else (None, None, None)
    action, start, last = open_run

    def close() -> None:
        if action is not None:
            done.append((key[0], action, start, last + 1))

    if state.hasTimedOut:
        close()
        state.remove()
    else:
        frames = pd.concat(list(batches)).sort_values("frame")
        for frame, label in zip(frames["frame"].tolist(), frames["action"].tolist(), strict=True):
            label = label if isinstance(label, str) else None
            if last is not None and frame <= last:
                continue
            if label != action or last is None or frame != last + 1:
                close()
                action, start = label, frame
            last = frame
        state.update((action, start, last))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
    yield pd.DataFrame(done, columns=["track", "action", "start_frame", "stop_frame"])


def stream_intervals(frames: DataFrame, track: list[str], cutoffs: dict[str, float], idle_ms: int | None = 60_000) -> DataFrame:
    """frames: a streaming table of track, frame and a probability for each action of cutoffs. Intervals come with the
    track's columns joined by `/`. A track without frames for idle_ms is closed; with None its last run waits for more."""
    name, best = winner({a: F.col(a) for a in cutoffs})
    chosen = frames.withColumns({"_name": name, "_best": best})
    chosen = chosen.select(F.concat_ws("/", *track).alias("track"), "frame", F.when(F.col("_best") >= thresholds(cutoffs, F.col("_name")), F.col("_name")).alias("action"))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        return _step(key, batches, state, idle_ms)

    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return chosen.groupBy("track").applyInPandasWithState(step, OUT, STATE, "append", timeout)
