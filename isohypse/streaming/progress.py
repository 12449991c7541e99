"""Sources' progress as a stream: the newest state of each source, kept up to date."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: A state can only be left for a later one.
ORDER = ("waiting", "running", "done", "failed", "cancelled")
_OUT = "source string, state string, started double, finished double, n_events bigint"


def states(events: DataFrame) -> DataFrame:
    """events (source, at seconds, state) -> a row for each source that changed in a batch.

    A finished source stays as it is; elapsed time is finished less started.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        name, started, finished, n = state.get if state.exists else ("waiting", None, None, 0)
        for pdf in frames:
            for r in pdf.sort_values("at", kind="stable").itertuples():
                n += 1
                if ORDER.index(name) >= 2 or r.state not in ORDER or ORDER.index(r.state) < ORDER.index(name):
                    continue
                name = r.state
                started = r.at if name == "running" and started is None else started
                finished = r.at if ORDER.index(name) >= 2 else finished
        state.update((name, started, finished, n))
        yield pd.DataFrame([(key[0], name, started, finished, n)], columns=["source", "state", "started", "finished", "n_events"])

    return events.groupBy("source").applyInPandasWithState(update, _OUT, "state string, started double, finished double, n bigint", "update", GroupStateTimeout.NoTimeout)
