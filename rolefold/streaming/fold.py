"""The queue fold as a stream: state per item survives between micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.queue import step

OUTPUT = "target string, state string, illegal int, entries int"


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    now, illegal, entries = state.get if state.exists else ("pending", 0, 0)
    rows = pd.concat(list(batches)).sort_values("lid")
    for action in rows["action"]:
        now, legal = step(now, action)
        illegal += not legal
        entries += 1
    state.update((now, illegal, entries))
    yield pd.DataFrame([(key[0], now, illegal, entries)], columns=["target", "state", "illegal", "entries"])


def fold_stream(log: DataFrame) -> DataFrame:
    """Updates of each item's state from a stream of (target, lid, action); entries arrive in lid order per item."""
    return log.groupBy("target").applyInPandasWithState(
        _advance, OUTPUT, "state string, illegal int, entries int", "update", GroupStateTimeout.NoTimeout
    )
