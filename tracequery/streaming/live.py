"""Live traces: last values and stalls of an unbounded change stream.

An extension: the state of a signal is its last value and the time of its last
change.  A change that comes ``min_duration`` ticks or more after the one
before it ends a stall, which is then emitted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_OUT = "signal_id long, start_time long, end_time long, duration long, value_held string"


def stalls(changes: DataFrame, min_duration: int) -> DataFrame:
    """(signal_id, start_time, end_time, duration, value_held) from a streaming frame (timestamp, seq, signal_id, value_raw).

    Changes of one signal are put in order within a batch; one that is older
    than the signal's last change is late and dropped.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, seq, held = state.get if state.exists else (None, None, None)
        rows = pd.concat(list(batches)).sort_values(["timestamp", "seq"])
        found = []
        for t, s, v in zip(rows["timestamp"].tolist(), rows["seq"].tolist(), rows["value_raw"].tolist(), strict=True):
            if last is not None and (t, s) <= (last, seq):
                continue
            if last is not None and t - last >= min_duration:
                found.append((key[0], last, t, t - last, held))
            last, seq, held = t, s, v
        state.update((last, seq, held))
        yield pd.DataFrame(found, columns=["signal_id", "start_time", "end_time", "duration", "value_held"]).astype({"signal_id": "int64", "start_time": "int64", "end_time": "int64", "duration": "int64"})

    return changes.groupBy("signal_id").applyInPandasWithState(step, _OUT, "last long, seq long, held string", "append", GroupStateTimeout.NoTimeout)
