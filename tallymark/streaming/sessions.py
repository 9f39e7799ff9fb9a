"""Calls of logs that arrive bit by bit (R10), with keyed state across batches and restarts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CALLS = "user_id long, event_id long, run_no long, seconds double"
#: what is known of a log after its last line: the loads so far, and that line if it is a call that no line has ended yet
STATE = "run_no long, event_id long, sec double"


def closed_calls(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Calls (lines that are no loads) that the new lines of a log end, in order of time.

    A load starts a new run and discards the call that is open; lines before the first load
    belong to no run. The new lines must not be older than those of earlier batches.
    """
    run_no, open_id, open_sec = state.get if state.exists else (0, None, None)
    lines = pd.concat(list(batches)).sort_values(["sec", "event_id"], kind="stable")
    run = run_no + lines["is_load"].astype(int).cumsum()
    before = lines[["event_id", "sec"]].shift(1)
    was_call, before_run = (~lines["is_load"]).shift(1, fill_value=False), run.shift(1, fill_value=run_no)
    if open_id is not None:
        before.iloc[0] = [open_id, open_sec]
        was_call.iloc[0] = True
    ended = was_call & ~lines["is_load"] & (before_run > 0) & (lines["sec"] > before["sec"])
    found = pd.DataFrame({"user_id": key[0], "event_id": before["event_id"][ended].astype("int64"), "run_no": before_run[ended].astype("int64"), "seconds": (lines["sec"] - before["sec"])[ended]})
    last = lines.iloc[-1]
    is_call = not last["is_load"]
    state.update((int(run.iloc[-1]), int(last["event_id"]) if is_call else None, float(last["sec"]) if is_call else None))
    if len(found):
        yield found


def session_stream(lines: DataFrame) -> DataFrame:
    """The closed calls of a stream of lines (user_id, event_id, sec, is_load); only the last line of each log is state."""
    return lines.groupBy("user_id").applyInPandasWithState(closed_calls, CALLS, STATE, "append", GroupStateTimeout.NoTimeout)
