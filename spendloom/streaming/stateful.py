"""What has to be remembered between triggers: running totals and open tool runs.

The streaming twins of ``codex.counter_deltas`` and ``claude.pair_tools``. State is
kept per session by ``transformWithStateInPandas``; a trigger's rows per session
are bounded by the files it takes in.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.codex import COUNTERS

DELTA_COLUMNS = (
    "session_uid STRING, ordinal BIGINT, input BIGINT, cache_read BIGINT, generated BIGINT, reasoning BIGINT, sized BOOLEAN"
)
PAIR_COLUMNS = "session_uid STRING, call_key STRING, tool STRING, us BIGINT, seconds DOUBLE, is_error BOOLEAN"


def _present(value) -> bool:
    return value is not None and not pd.isna(value)


class CounterDeltas(StatefulProcessor):
    """Keeps the newest running total of a session."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.total = handle.getValueState("total", ", ".join(f"{c} BIGINT" for c in COUNTERS))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        (session,) = key
        before = self.total.get() if self.total.exists() else None
        out = []
        for row in pd.concat(rows).sort_values("ordinal").to_dict("records"):
            total = [row[f"total_{c}"] for c in COUNTERS]
            last = [row[f"last_{c}"] for c in COUNTERS]
            base, has_last = before, any(map(_present, last))
            if any(map(_present, total)):
                before = tuple(int(t) if _present(t) else 0 for t in total)
            if base is None and not has_last:
                continue
            now = [int(t) if _present(t) else 0 for t in total]
            steps = [
                int(stated) if _present(stated) else n - (base[i] if base else 0)
                for i, (stated, n) in enumerate(zip(last, now))
            ]
            raw, cached, made, thought = (max(s, 0) for s in steps)
            out.append((session, row["ordinal"], max(raw - cached, 0), cached, made, min(thought, made), min(steps) >= 0))
        if before is not None:
            self.total.update(before)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in DELTA_COLUMNS.split(", ")])

    def close(self) -> None:
        pass


def counter_deltas(events: DataFrame) -> DataFrame:
    """Per-call usage of a stream of ``session_uid, ordinal, total_<counter>, last_<counter>`` rows."""
    return events.groupBy("session_uid").transformWithStateInPandas(
        statefulProcessor=CounterDeltas(), outputStructType=DELTA_COLUMNS, outputMode="Append", timeMode="None"
    )


class ToolPairs(StatefulProcessor):
    """Keeps the uses of a session that no result has answered yet."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getMapState("open", "id STRING", "name STRING, us BIGINT")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        (session,) = key
        out = []
        for row in pd.concat(rows).sort_values(["ordinal", "pos"]).to_dict("records"):
            name_key = (row["id"],)
            us = int(row["us"]) if _present(row["us"]) else None
            if row["use"]:
                self.open.updateValue(name_key, (row["name"], us))
                out.append((session, f"tool:{row['id']}", row["name"], us, 0.0, False))
                continue
            name, asked = self.open.getValue(name_key) if self.open.containsKey(name_key) else ("", None)
            if self.open.containsKey(name_key):
                self.open.removeKey(name_key)
            took = (us - asked) / 1e6 if us is not None and asked is not None and us > asked else 0.0
            out.append((session, f"tool:{row['id']}", name, us if us is not None else asked, took, bool(row["is_error"])))
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in PAIR_COLUMNS.split(", ")])
        yield frame.astype({"us": "Int64"})

    def close(self) -> None:
        pass


def pair_tools(blocks: DataFrame) -> DataFrame:
    """Tool rows of a stream of ``session_uid, ordinal, pos, use, id, name, us, is_error`` blocks.

    A use is emitted at once and its row again, complete, when the result comes;
    the keyed write lets the later row win.
    """
    return blocks.groupBy("session_uid").transformWithStateInPandas(
        statefulProcessor=ToolPairs(), outputStructType=PAIR_COLUMNS, outputMode="Append", timeMode="None"
    )
