"""First-wins dedup of a stream: a key's first row is given out once, whatever batch later rows of the key arrive in."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def first_wins(rows: DataFrame, key: list[str], order: list[str], event_time: str | None = None, expiry: str = "1 day") -> DataFrame:
    """The first row of each key of a streaming DataFrame; of those of one batch the first by `order`.

    The state holds one flag a key. With `event_time` the stream has a watermark of `expiry`: a key's flag goes once the
    watermark is that long past its first row, so state is bounded by the keys of twice that time, rows that are later than
    the watermark are dropped, and a key that comes again after its flag is gone is a new one. Without it flags stay for
    good. A key's rows of one batch come in pieces, of which only the best row is kept, so no group is held whole; null
    keys are keys. Every output column is that of the input.
    """
    wait = pd.Timedelta(expiry)
    if event_time:
        rows = rows.withWatermark(event_time, expiry)
    names = [f.name for f in rows.schema.fields]
    ordered = [n for n in order if n not in key] or order

    def step(_, pieces, state: GroupState):
        best = None
        for piece in pieces:
            least = piece.sort_values(ordered, kind="stable").head(1)
            best = least if best is None else pd.concat([best, least]).sort_values(ordered, kind="stable").head(1)
        if state.hasTimedOut:
            state.remove()
            return
        if state.exists or best is None:
            return
        state.update((True,))
        if event_time:
            after = max(int(best[event_time].iloc[0].timestamp() * 1000), state.getCurrentWatermarkMs())
            state.setTimeoutTimestamp(after + int(wait.total_seconds() * 1000))
        yield best[names]

    timeout = GroupStateTimeout.EventTimeTimeout if event_time else GroupStateTimeout.NoTimeout
    return rows.groupBy(*map(F.col, key)).applyInPandasWithState(step, rows.schema, "seen boolean", "append", timeout)


def first_hits(lines: DataFrame) -> DataFrame:
    """One hit a line over a stream of code lines (project_id, path, language, line_no, code): the first rule by name of each
    line, once, though the file may arrive again in a later batch."""
    from taintloom.operators import rules

    return first_wins(rules.scan(lines), ["project_id", "path", "line_no"], ["rule_id"])
