"""Account states over a stream of events, and debounced refreshes.

Batch and stream share the transition function, so both give the same states.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE = "status string, cycle int, step int, last_sent timestamp, next_eligible timestamp, violations int"
OUTPUT = f"account_id string, seq long, event string, {STATE}"
COLUMNS = ("account_id", "seq", "event", "status", "cycle", "step", "last_sent", "next_eligible", "violations")
START = ("PLANNED", 0, 0, None, None, 0)
SLA = pd.Timedelta(days=30)


def transition(state: tuple, event: str, at: pd.Timestamp) -> tuple:
    """The state after a send or an outcome; unknown events change nothing."""
    status, cycle, step, sent, eligible, late = state
    if event == "send":
        late += int(sent is not None and at > sent + SLA)
        return "SENT", cycle, step + 1, at, at + SLA, late
    if event == "verified":
        return "CRA_RESPONDED_VERIFIED", cycle, step, sent, None, late
    if event == "updated":
        return "CRA_RESPONDED_UPDATED", cycle, step, sent, None, late
    if event == "deleted":
        return "COMPLETED", cycle + 1, 0, sent, None, late
    if event == "nochange":
        return "CRA_RESPONDED_NOCHANGE", cycle, step, sent, (sent if sent is not None else at) + SLA, late
    return state


def _clean(state) -> tuple:
    return tuple(None if v is None or (isinstance(v, pd.Timestamp) and pd.isna(v)) or v is pd.NaT else v for v in state)


class AccountProcessor(StatefulProcessor):
    """One row per event with the state after it; events of a batch in the order of seq."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("account", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = _clean(self.state.get()) if self.state.exists() else START
        events = pd.concat(list(rows)).sort_values(["seq"], kind="stable")
        out = []
        for e in events.itertuples(index=False):
            state = transition(state, str(e.event).lower(), e.at)
            out.append((key[0], int(e.seq), e.event, *state))
        self.state.update(state)
        yield pd.DataFrame(out, columns=list(COLUMNS))

    def close(self) -> None:
        pass


def follow(events: DataFrame) -> DataFrame:
    """``account_id, seq, event, at`` to states; works on streams and on tables."""
    return events.groupBy("account_id").transformWithStateInPandas(statefulProcessor=AccountProcessor(), outputStructType=OUTPUT, outputMode="Append", timeMode="None")


def debounced(events: DataFrame, key: str, at: str, gap: str) -> DataFrame:
    """One refresh per burst of events of a key: a burst ends when nothing comes for ``gap``."""
    return events.groupBy(key, F.session_window(at, gap)).agg(F.count(F.lit(1)).alias("events")).select(key, F.col("session_window.start").alias("first_at"), F.col("session_window.end").alias("refresh_at"), "events")
