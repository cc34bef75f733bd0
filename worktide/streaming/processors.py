"""Stateful processor for intervals that grow: incidents and sustained runs.

Times come as seconds, so that no time zone of a worker plays a part. State holds the intervals of a
key that may still grow; a timer of event time drops the others.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

INTERVAL_OUT = "key string, opened bigint, last_end bigint, periods bigint, hits bigint, is_open boolean"


class IntervalProcessor(StatefulProcessor):
    """Joins periods that are at most ``gap`` seconds apart, in whichever order they come.

    Each period comes once, after its own end: so an interval stays for ``length``, the longest
    period, beyond the time at which a period could still begin. An interval is named by its start; where two become one, the later
    start is returned with no periods.
    """

    def __init__(self, gap: int, length: int) -> None:
        self.gap = gap
        self.stay = gap + length

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getMapState(
            "intervals", "opened bigint", "last_end bigint, periods bigint, hits bigint"
        )

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        known = {k[0]: tuple(v) for k, v in self.state.iterator()} if self.state.exists() else {}
        changed: set[int] = set()
        for row in rows:
            opened, end, periods, hits = row.bucket, row.bucket + row.period, 1, row.n
            for start, (last, count, total) in list(known.items()):
                if opened - last <= self.gap and start - end <= self.gap:
                    del known[start]
                    changed.add(start)
                    opened, end = min(opened, start), max(end, last)
                    periods, hits = periods + count, hits + total
            known[opened] = (end, periods, hits)
            changed.add(opened)
        for start in changed:
            if start in known:
                self.state.updateValue((start,), known[start])
                self.handle.registerTimer((known[start][0] + self.stay) * 1000 + 1)
            else:
                if self.state.containsKey((start,)):
                    self.state.removeKey((start,))
            end, periods, hits = known.get(start, (start, 0, 0))
            yield Row(key=key[0], opened=start, last_end=end, periods=periods, hits=hits, is_open=True)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        for k, v in list(self.state.iterator()):
            if (v[0] + self.stay) * 1000 < now:
                self.state.removeKey(k)
                yield Row(key=key[0], opened=k[0], last_end=v[0], periods=v[1], hits=v[2], is_open=False)

    def close(self) -> None:
        pass
