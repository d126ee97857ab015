"""A run that goes forward day by day as a stateful stream: activation, weekly signals, missed cycles.

Events say that a day is open (``calendar``), that daily bars are complete through a day (``data``)
or that someone looks on a day whether a signal is due (``check``). Each protocol has a state of its
own. Events wait in it until the watermark has passed them and are then taken in order of their
time, so the log doesn't depend on how they arrived: late (within the watermark), repeated, or in
other micro-batches after a restart. A signal that nobody asked for in time is missed when the
watermark passes the end of its day, and is never made up for.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

LOG = "protocol string, event_id string, event_type string, trade_date string, reason string, payload string"
_FIELDS = [c.split()[0] for c in LOG.split(", ")]
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_DAY_MS, _HOUR_MS = 86_400_000, 3_600_000
#: For how long (ms of event time) the ids of events that were taken are known.
_REPEATED = 3 * _DAY_MS
#: Events or rows of the log that a task collects before it writes them.
_HELD = 50_000


@lru_cache(4096)
def end_of_day(day: str) -> int:
    """Milliseconds (UTC) at which the day is over."""
    return int(datetime.strptime(day, "%Y%m%d").replace(tzinfo=timezone.utc).timestamp() * 1000) + _DAY_MS


@lru_cache(4096)
def week(day: str) -> tuple[int, int]:
    d = datetime.strptime(day, "%Y%m%d")
    return d.year, d.isocalendar()[1]


@dataclass
class Progress:
    """What a protocol knows: open days still of use, bars through, since when it is active, the last signal made or missed."""

    days: list[str] = field(default_factory=list)
    through: str | None = None
    through_open: bool = False
    activation: str | None = None
    last: str | None = None
    made: bool = False

    def next_signal(self) -> str | None:
        """The last open day of the first week that is neither before the activation nor over; found once for what is known."""
        known = self.__dict__.get("_signal")
        if known is None or known[0] is not self.days or known[1:3] != (self.activation, self.last):
            known = self.__dict__["_signal"] = (self.days, self.activation, self.last, self._next_signal())  # a list of days is never changed in place
        return known[3]

    def _next_signal(self) -> str | None:
        open_ = [d for d in self.days if self.activation and d >= self.activation and (self.last is None or d > self.last and week(d) != week(self.last))]
        return max(d for d in open_ if week(d) == min(map(week, open_))) if open_ else None

    def known(self, kind: str, day: str) -> None:
        if kind == "calendar":
            if day not in self.days:
                self.days = sorted([*self.days, day])
            self.through_open = self.through_open or day == self.through
        elif self.through is None or day > self.through:
            self.through, self.through_open = day, day in self.days

    def check(self, protocol: str, today: str) -> Iterator[tuple[str, str, str]]:
        """(event_type, trade_date, reason) of a look on ``today``."""
        if self.activation is None:
            later = [d for d in self.days if d > today]
            if later and self.through is not None and self.through_open and self.through <= today:
                self.activation = later[0]
                yield "forward_tracking_activated", later[0], "active"
            else:
                yield "activation_pending", today, "pending_data_update"
        signal = self.next_signal()
        if self.made and self.last == today:
            yield "due_check", today, "signal_already_generated"
        elif signal is None:
            yield "due_check", today, "no_eligible_signal_date"
        elif today < signal:
            yield "due_check", today, "not_due_yet"
        elif self.through is None or self.through < signal:
            yield "due_check", today, "daily_bar_not_ready"
        elif today > signal:
            yield "due_check", today, "missed_signal_cycle"
        else:
            yield "due_check", today, "signal_due"
            yield "signal", signal, "generated"
            self.last, self.made = signal, True
        # only the latest days matter: those of the week of the last signal, and later ones
        floor = min(x for x in (self.last, self.through, today) if x is not None)
        if self.days and self.days[0] < floor:
            self.days = [d for d in self.days if d >= floor]

    def over(self, day: str) -> Iterator[tuple[str, str, str]]:
        """The day has ended; a signal that waited for it is missed."""
        if self.next_signal() == day:
            self.last, self.made = day, False
            yield "missed_signal_cycle", day, "missed_signal_cycle"


def walk(protocol: str, state: Progress, events: list[tuple[int, str, str, str]], through_ms: float) -> tuple[list[tuple], list[tuple[int, str, str, str]]]:
    """Take (ms, event_id, kind, day) in order up to ``through_ms``; returns rows of the log and the events still waiting.

    Ends of days on which a signal waits are events as well.
    """
    heapq.heapify(events)
    out = []
    planned = {e[3] for e in events if e[2] == "over"}
    while events and events[0][0] <= through_ms:
        ms, event_id, kind, day = heapq.heappop(events)
        found = state.over(day) if kind == "over" else state.check(protocol, day) if kind == "check" else iter(())
        if kind in ("calendar", "data"):
            state.known(kind, day)
        for what, at, reason in found:
            name = f"{protocol}:{what}:{event_id if what in ('due_check', 'activation_pending') else at}"
            out.append((protocol, name, what, at, reason, f"{what}|{at}|{reason}"))
        signal = state.next_signal()
        if signal and signal not in planned:
            planned.add(signal)
            heapq.heappush(events, (max(ms, end_of_day(signal)), f"over:{signal}", "over", signal))
    return out, events


class ForwardRun(StatefulProcessor):
    """One protocol's events (event_id, kind, trade_date, ts) become rows of its log.

    Events wait in a bucket an hour, and one timer waits for the earliest of them. So work grows with
    the events, and a task holds an hour's events and the ids of the last days, however many wait.
    An id that comes again within :data:`_REPEATED` is a repeat; what has the earlier time counts.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.progress = handle.getValueState("progress", "days array<string>, through string, through_open boolean, activation string, last string, made boolean")
        self.timer = handle.getValueState("timer", "ms long")
        self.waiting = handle.getMapState("waiting", "hour long", "events string")
        self.taken = handle.getMapState("taken", "hour long", "ids string")

    def _wait(self, events: list[tuple[int, str, str, str]]) -> None:
        """Add events to the buckets of their hours; the end of a day only once."""
        by_hour: dict[int, list] = {}
        for e in events:
            by_hour.setdefault(e[0] // _HOUR_MS, []).append(e)
        for hour, some in by_hour.items():
            before = json.loads(self.waiting.getValue((hour,))[0]) if self.waiting.containsKey((hour,)) else []
            self.waiting.updateValue((hour,), (json.dumps(before + [e for e in some if e[2] != "over" or list(e) not in before]),))

    def _wake(self, ms: int) -> None:
        """Register a timer, unless there is one that isn't later."""
        if not self.timer.exists() or ms < self.timer.get()[0]:
            self.timer.update((ms,))
            self.handle.registerTimer(ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        """New events wait."""
        new: list[tuple[int, str, str, str]] = []
        first = None
        for some in rows:
            new += zip(map(int, some["ms"]), some["event_id"], some["kind"], some["trade_date"], strict=True)
            if len(new) >= _HELD:
                first = min(e[0] for e in new) if first is None else min(first, min(e[0] for e in new))
                self._wait(new)
                new = []
        if new:
            first = min(e[0] for e in new) if first is None else min(first, min(e[0] for e in new))
            self._wait(new)
        if first is not None:
            self._wake(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Take what the watermark has passed, hour by hour."""
        watermark = timerValues.getCurrentWatermarkInMs()
        if not self.timer.exists() or self.timer.get()[0] > watermark:
            return  # a timer that an earlier one has replaced
        self.timer.clear()
        state = Progress(*self.progress.get()) if self.progress.exists() else Progress()
        state.days = list(state.days)
        hours = sorted(k[0] for k in self.waiting.keys())
        taken = {k[0]: json.loads(v[0]) for k, v in self.taken.iterator()}
        known = {i for ids in taken.values() for i in ids}
        due, events, out = [h for h in hours if h * _HOUR_MS <= watermark], [], []
        for hour in due:
            for old in [h for h in taken if h < hour - _REPEATED // _HOUR_MS]:
                known.difference_update(taken.pop(old))
            fresh = []
            for e in sorted(map(tuple, json.loads(self.waiting.getValue((hour,))[0])), key=lambda e: (*e[:2], str(e[2:]))):
                if e[2] != "over" and e[0] <= watermark:
                    if e[1] in known:
                        continue
                    known.add(e[1])
                    taken.setdefault(hour, []).append(e[1])
                fresh.append(e)
            self.waiting.removeKey((hour,))
            made, events = walk(key[0], state, events + fresh, min(watermark, (hour + 1) * _HOUR_MS - 1))
            out += made
            if len(out) >= _HELD:
                yield pd.DataFrame(out, columns=_FIELDS)
                out = []
        made, events = walk(key[0], state, events, watermark)  # ends of days behind the last event
        out += made
        self._wait(events)
        for h in [k[0] for k in self.taken.keys()]:
            if h not in taken or (h + 1) * _HOUR_MS <= watermark - _REPEATED:
                self.taken.removeKey((h,))
        for h in due:
            if h in taken and (h + 1) * _HOUR_MS > watermark - _REPEATED:
                self.taken.updateValue((h,), (json.dumps(taken[h]),))
        self.progress.update(tuple(asdict(state).values()))
        later = [e[0] for e in events] + [h * _HOUR_MS for h in hours[len(due) :]]
        if later:
            self._wake(min(later))
        if out:
            yield pd.DataFrame(out, columns=_FIELDS)

    def close(self) -> None:
        pass


def forward_log(events: DataFrame, late: str = "2 days") -> DataFrame:
    """The log of a stream of events: protocol, event_id, kind, trade_date (yyyyMMdd), ts.

    An event that comes more than ``late`` behind the newest one is dropped.
    """
    own = events.select("protocol", "event_id", "kind", "trade_date", "ts", F.unix_millis("ts").alias("ms")).withWatermark("ts", late)
    return own.groupBy("protocol").transformWithStateInPandas(ForwardRun(), LOG, "append", "EventTime")


def run(events: DataFrame, log, checkpoint: str, late: str = "2 days"):
    """Start the stream into ``log``, a :class:`panelforge.sources.versions.Table` keyed by event_id; all that is there is read, then it ends.

    A micro-batch that is written again after a failure adds nothing: its rows are known by their ids.
    """
    spark: SparkSession = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)

    def keep(batch: DataFrame, _: int) -> None:
        log.append_unique(batch, "payload")

    return forward_log(events, late).writeStream.foreachBatch(keep).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
