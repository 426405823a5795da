"""Keyed state of the transition guard."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import Row


class TransitionGuard(StatefulProcessor):
    """Judges the status changes of one run in the order of (time, event id).

    ``open`` holds the events that the watermark has not passed, one entry with all that a batch brought, ``mark`` the status of the
    last judged one and the time (in milliseconds) of the timer: when the earliest open event can be judged.  No event can still
    come before the watermark, so those up to it are in their final order; they leave ``open`` as they are judged.  An event id that
    comes again at its time replaces itself.  Each call on the state is a round trip and each entry a write of its own, so a run's
    events are put, read and taken out together, not one by one."""

    def __init__(self, allowed: Sequence[str], id_type: str) -> None:
        self.allowed, self.id_type = frozenset(allowed), id_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", f"us array<bigint>, event_id array<{self.id_type}>, status array<string>")
        self.mark = handle.getValueState("mark", "last string, ms bigint")

    def _wake(self, last: str | None, ms: int | None, us: int) -> None:
        """Have one timer, for the earliest open event."""
        new = us // 1000 + 1
        if ms is not None:
            if ms <= new:
                return
            self.handle.deleteTimer(ms)
        self.handle.registerTimer(new)
        self.mark.update((last, new))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803 (Spark's names)
        # the closing event has no id
        new = [(r.us, r.event_id, r.status) for r in rows if r.event_id is not None]
        if new:
            us, ids, status = map(list, zip(*new, strict=True))
            self.open.appendValue((us, ids, status))
            self._wake(*(self.mark.get() or (None, None)), min(us))
        return iter([])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        previous, ms = self.mark.get() or (None, None)
        if ms != expiredTimerInfo.getExpiryTimeInMs():
            return
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        came = {(us, i): status for entry in self.open.get() for us, i, status in zip(*entry, strict=True)}
        waiting = sorted(came.items(), key=lambda e: e[0])
        judged = 0
        for (us, event_id), status in waiting:
            if us > passed:
                break
            judged += 1
            if previous is not None and status is not None and previous != status and f"{previous}>{status}" not in self.allowed:
                yield Row(run=key[0], event_id=event_id, us=us, status=status, previous=previous)
            previous = status
        rest = waiting[judged:]
        if rest:
            self.open.put([([us for (us, _), _ in rest], [i for (_, i), _ in rest], [status for _, status in rest])])
            self._wake(previous, None, rest[0][0][0])
        else:
            self.open.clear()
            self.mark.update((previous, None))
