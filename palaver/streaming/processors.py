"""Keyed stateful processing shared by the streaming jobs."""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def as_frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    """Plain object columns, which the Arrow writer takes whatever number of frames it joins."""
    return pd.DataFrame(rows, columns=columns, dtype=object)


class RuleProcessor(StatefulProcessor):
    """Feeds the rows of each key in order to a live rule, which is kept between micro-batches.

    Rows of one key within a micro-batch are put in order first. A row whose ``end`` column is set closes the rule, and
    rows behind it open a new one, in the same micro-batch as in a later one.

    With ``idle_ms`` a key that is silent for longer than that is closed as well: by a timer once the watermark has passed
    its last row by that much, or by the first row behind the silence, whichever comes first, so the result does not depend
    on how rows fall into micro-batches. The column ``CLOCK`` then has the event time in milliseconds, and the state of a
    silent key is dropped.
    """

    CLOCK = "clock_ms"

    def __init__(self, key: str, order: list[str], columns: list[str], out: list[str], rule: Callable[[], object], end: str | None = None, idle_ms: int | None = None) -> None:
        self.key, self.order, self.columns, self.out, self.rule, self.end, self.idle_ms = key, order, columns, out, rule, end, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "data binary, last_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows), ignore_index=True).sort_values(self.order, kind="stable")
        cols = {c: frame[c].to_numpy() for c in self.columns}
        ends = np.flatnonzero(frame[self.end].to_numpy().astype(bool)).tolist() if self.end else []
        known = self.state.get()
        rule, last = (pickle.loads(known[0]), known[1]) if known else (None, None)
        pauses, latest = self._pauses(frame, last)
        out: list[tuple] = []
        a = 0
        # an end mark is left out, a pause stands before its row; the open rest of the micro-batch is kept
        for b, width in sorted([*((e, 1) for e in ends), *((p, 0) for p in pauses), (len(frame), 0)]):
            if a < b:
                rule = rule or self.rule()
                out += rule.feed({c: v[a:b] for c, v in cols.items()})
            if b < len(frame) and rule:
                out += rule.close()
                rule = None
            a = b + width
        self._keep(rule, last, latest)
        yield as_frame([(key[0], *r) for r in out], [self.key, *self.out])

    def _pauses(self, frame: pd.DataFrame, last: int | None) -> tuple[list[int], int | None]:
        """Rows that come after a silence, and the latest event time of the key."""
        if self.idle_ms is None:
            return [], None
        reached = np.maximum.accumulate(frame[self.CLOCK].to_numpy().astype(np.int64))
        if last is not None:
            reached = np.maximum(reached, last)
        before = np.append(reached[0] if last is None else last, reached[:-1])
        return np.flatnonzero(reached - before > self.idle_ms).tolist(), int(reached[-1])

    def _keep(self, rule: object | None, last: int | None, latest: int | None) -> None:
        if last is not None:
            self.handle.deleteTimer(last + self.idle_ms)
        if rule is None:
            self.state.clear()
            return
        self.state.update((pickle.dumps(rule), latest))
        if latest is not None:
            self.handle.registerTimer(latest + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known = self.state.get()
        if known is not None and known[1] + self.idle_ms == expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
            yield as_frame([(key[0], *r) for r in pickle.loads(known[0]).close()], [self.key, *self.out])

    def close(self) -> None:
        pass


class BucketProcessor(StatefulProcessor):
    """Entries of many keys in one state, for rules that do little for a row.

    A call for each key, and each look at its state or timers, takes as long as hundreds of rows. So the rows are grouped by
    a bucket of keys: its entries are read and written once in a micro-batch, and it has one timer, at the next time
    that one of them asks for. Rules go by the key inside the bucket. An entry is a tuple of the fields that ``ENTRY`` names, the
    key first; entries are kept as columns, in blocks.
    """

    ENTRY: dict[str, str]
    COLUMNS: list[str]
    BLOCK = 10_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.blocks = handle.getListState("blocks", ", ".join(f"{name} array<{kind}>" for name, kind in self.ENTRY.items()))

    def wakes(self, entry: tuple) -> int | None:
        """When the entry has to be looked at, in event time."""
        raise NotImplementedError

    def next_wake(self, entries: list[tuple]) -> int | None:
        return min((at for at in map(self.wakes, entries) if at is not None), default=None)

    def read(self) -> list[tuple]:
        return [entry for block in self.blocks.get() for entry in zip(*block)]

    def packed(self, entries: list[tuple]) -> list[tuple]:
        return [tuple(map(list, zip(*entries[i : i + self.BLOCK]))) for i in range(0, len(entries), self.BLOCK)]

    def write(self, entries: list[tuple]) -> None:
        if entries:
            self.blocks.put(self.packed(entries))
        else:
            self.blocks.clear()

    def add(self, entries: list[tuple]) -> None:
        """Entries behind those that are there; their timer stands beside an earlier one."""
        if entries:
            self.blocks.appendList(self.packed(entries))
            self.handle.registerTimer(self.next_wake(entries))

    def change(self, before: list[tuple], after: list[tuple], fired: int | None = None) -> None:
        """New entries of the bucket and their timer, instead of those read. A timer that fired goes by itself."""
        was, now = self.next_wake(before), self.next_wake(after)
        self.write(after)
        if was != now:
            if was is not None and was != fired:
                self.handle.deleteTimer(was)
            if now is not None:
                self.handle.registerTimer(now)

    def close(self) -> None:
        pass


class EndReminder(BucketProcessor):
    """One reminder at the calendar end of a meeting that is still being recorded.

    Rows are (job_id, ts, recording, event_id, end_ms). The entry of a job is its current event, due or not; a stop or another
    event takes it away, and an end already past is not due. A row that comes after the end in event time finds the
    reminder due, as the watermark does, so the result does not depend on how rows fall into micro-batches.
    """

    ENTRY = {"job_id": "string", "event_id": "string", "end_ms": "long", "due": "boolean"}
    COLUMNS = ["job_id", "event_id", "at_ms"]

    def wakes(self, entry):
        return entry[2] if entry[3] else None

    def handleInputRows(self, key, rows, timerValues):
        frame = pd.concat(list(rows), ignore_index=True).sort_values("ts", kind="stable")
        times = (frame["ts"].to_numpy("datetime64[us]").astype(np.int64) // 1000).tolist()
        before = self.read()
        current = {e[0]: e for e in before}
        told = []
        for at, job, recording, event_id, end_ms in zip(times, *(frame[c].tolist() for c in ("job_id", "recording", "event_id", "end_ms"))):
            known = current.get(job)
            if known is not None and known[3] and known[2] <= at:
                told.append(known[:3])
                known = current[job] = (*known[:3], False)
            if not recording or not event_id or pd.isna(end_ms):
                current.pop(job, None)
            elif known is None or known[1] != event_id:
                current[job] = (job, event_id, int(end_ms), int(end_ms) > at)
        self.change(before, list(current.values()))
        yield as_frame(told, self.COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        before = self.read()
        until = timerValues.getCurrentWatermarkInMs()
        due = [e for e in before if e[3] and e[2] <= until]
        if due:
            self.change(before, [(*e[:3], e[3] and e[2] > until) for e in before], expiredTimerInfo.getExpiryTimeInMs())
            yield as_frame([e[:3] for e in due], self.COLUMNS)


class DueNotices(BucketProcessor):
    """One notice per calendar event, ahead of its start.

    Rows are (calendar_id, ms, recorded, event_id, start_ms): a poll that lists an event, or the start of its recording. A
    poll asks for a notice ``lead_ms`` before the start if that is at most ``ahead_ms`` away and at most ``late_ms`` ago; a past
    one is told at once. A recording takes a notice back that has not been told, and an event that was recorded or told
    gets no other one. Notices that were told before the stream began come in as initial state.

    Entries are (calendar_id, event_id, at_ms, told): ``at_ms`` is the time of the notice, or of the recording. They are dropped
    ``keep_ms`` later, so the state holds what is scheduled and the last day. At one time a recording goes before a poll, and a
    notice that is due before both, so the result does not depend on how rows fall into micro-batches.
    """

    ENTRY = {"calendar_id": "string", "event_id": "string", "at_ms": "long", "told": "boolean"}
    COLUMNS = ["calendar_id", "event_id", "at_ms"]

    def __init__(self, lead_ms: int, ahead_ms: int, late_ms: int, keep_ms: int) -> None:
        self.lead_ms, self.ahead_ms, self.late_ms, self.keep_ms = lead_ms, ahead_ms, late_ms, keep_ms

    def wakes(self, entry):
        return entry[2] + self.keep_ms if entry[3] else entry[2]

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.add([(c, e, int(at), True) for c, e, at in zip(*(initialState[c].tolist() for c in self.COLUMNS))])

    def handleInputRows(self, key, rows, timerValues):
        frame = pd.concat(list(rows), ignore_index=True).sort_values(["ms", "recorded"], ascending=[True, False], kind="stable")
        before = self.read()
        known: dict[str, dict[str, tuple[int, bool]]] = {}
        waiting: dict[str, list[tuple[int, str]]] = {}
        for calendar, event_id, at, was_told in before:
            known.setdefault(calendar, {})[event_id] = (at, was_told)
            if not was_told:
                waiting.setdefault(calendar, []).append((at, event_id))
        for queue in waiting.values():
            heapq.heapify(queue)
        told: list[tuple[str, str, int]] = []

        def tell(calendar: str, until: int) -> None:
            queue = waiting.get(calendar)
            while queue and queue[0][0] <= until:
                at, e = heapq.heappop(queue)
                if known[calendar].get(e) == (at, False):
                    told.append((calendar, e, at))
                    known[calendar][e] = (at, True)

        for calendar, ms, recorded, event_id, start_ms in zip(*(frame[c].tolist() for c in ("calendar_id", "ms", "recorded", "event_id", "start_ms"))):
            tell(calendar, int(ms))
            if not isinstance(event_id, str) or not event_id:
                continue
            events = known.setdefault(calendar, {})
            found = events.get(event_id)
            if recorded:
                if found is None or not found[1]:
                    events[event_id] = (int(ms), True)
            elif found is None and not pd.isna(start_ms):
                at = int(start_ms) - self.lead_ms
                if -self.late_ms <= at - ms <= self.ahead_ms:
                    at = max(at, int(ms))
                    events[event_id] = (at, False)
                    heapq.heappush(waiting.setdefault(calendar, []), (at, event_id))
                    tell(calendar, int(ms))
        self.change(before, [(c, e, *entry) for c, events in known.items() for e, entry in events.items()])
        yield as_frame(told, self.COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        before = self.read()
        until = timerValues.getCurrentWatermarkInMs()
        latest = {e[:2]: e for e in before}
        awake = {k for k, e in latest.items() if self.wakes(e) <= until}
        # a notice that is told now is kept, one that was told is dropped
        kept = [(*e[:3], e[3] or k in awake) for k, e in latest.items() if not (e[3] and k in awake)]
        self.change(before, kept, expiredTimerInfo.getExpiryTimeInMs())
        yield as_frame([e[:3] for k, e in latest.items() if k in awake and not e[3]], self.COLUMNS)
