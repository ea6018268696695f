"""Streaming short-time spectra: frames that span micro-batches are completed from per-signal state."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_frames(stream: DataFrame, width: int, hop: int) -> DataFrame:
    """(signal_id, frame, m) from a stream of (signal_id, i, x): the spectrum of every complete frame, as soon as it is.

    The state of a signal is the tail that its next frame needs, at most a frame's length plus what has just arrived.
    """

    def step(key, batches, state: GroupState):
        tail, frame = state.get if state.exists else ([], 0)
        tail = list(tail)
        rows = pd.concat(list(batches)).sort_values("i")
        tail.extend(rows["x"].tolist())
        out = []
        while len(tail) >= width:
            out.append((key[0], frame, np.abs(np.fft.rfft(tail[:width])).tolist()))
            frame += 1
            tail = tail[hop:]
        state.update((tail, frame))
        yield pd.DataFrame(out, columns=["signal_id", "frame", "m"])

    return stream.groupBy("signal_id").applyInPandasWithState(step, "signal_id long, frame long, m array<double>", "tail array<double>, frame long", "append", GroupStateTimeout.NoTimeout)
