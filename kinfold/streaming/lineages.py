"""Live lineages of each key over a stream of beginnings and ends, and the same over a table.

A row is an event (key, id, time, change): ``change`` is 1 where a lineage begins
and -1 where one ends. Rows come in any order and may come twice; each is counted once, in
the order of time and id, when the watermark has passed it. Rows behind what was
counted are late and dropped. Rows with a null in any of the four are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from kinfold.operators.prefix import running_sum

_STATE = "id long, micros long, live long, expired boolean"


def _given(events: DataFrame, key: str, id: str, time: str, change: str) -> DataFrame:
    named = events.select(F.col(key).alias("key"), F.col(id).cast("long").alias("id"), F.col(time).cast("timestamp").alias("time"), F.col(change).cast("long").alias("change"))
    return named.where("key IS NOT NULL AND id IS NOT NULL AND time IS NOT NULL AND change IS NOT NULL")


class LiveLineages(StatefulProcessor):
    """One state a key: rows that wait for the watermark, the lineages alive, and when a row was last counted.

    There is one timer a key, at its earliest waiting row or, if none waits, where its
    lineages expire; so waiting rows are gone through once each time the watermark moves.
    What waits lies in the state store and holds what comes within the delay of the watermark.
    """

    def __init__(self, idle_micros: int | None):
        self.idle = idle_micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "id long", "micros long, change long")
        self.count = handle.getValueState("count", "live long, last long")

    def _told(self) -> tuple[int, int | None]:
        return tuple(self.count.get()) if self.count.exists() else (0, None)

    def _set_timer(self, micros: int | None) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if micros is not None:
            self.handle.registerTimer(-(-micros // 1000))  # the millisecond at or after it

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        _, last = self._told()
        earliest = None
        for frame in rows:
            for id, micros, change in zip(frame["id"], frame["micros"], frame["change"]):
                if last is not None and micros <= last:  # counted already, or too late to be put in order
                    continue
                if not self.waiting.containsKey((int(id),)):
                    self.waiting.updateValue((int(id),), (int(micros), int(change)))
                    earliest = micros if earliest is None else min(earliest, micros)
        if earliest is not None:
            self._set_timer(int(min([earliest, *(t * 1000 for t in self.handle.listTimers())])))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        passed = timerValues.getCurrentWatermarkInMs() * 1000
        live, last = self._told()
        due, rest = [], None
        for (id,), (micros, change) in self.waiting.iterator():
            if micros <= passed:
                due.append((micros, id, change))
            else:
                rest = micros if rest is None else min(rest, micros)
        out = []
        for micros, id, change in sorted(due):
            self.waiting.removeKey((id,))
            if self.idle and live and last is not None and micros > last + self.idle:
                out.append((-1, last + self.idle, 0, True))
                live = 0
            live, last = live + change, micros
            out.append((id, micros, live, False))
        if self.idle and live and last + self.idle <= passed:
            out.append((-1, last + self.idle, 0, True))
            live = 0
        ends = last + self.idle if self.idle and live else None
        if live or rest is not None:
            self.count.update((live, last))
        else:
            self.count.clear()  # no state and a count of 0 are the same
        self._set_timer(min((t for t in (rest, ends) if t is not None), default=None))
        if out:
            yield pd.DataFrame([(key[0], *row) for row in out], columns=["key", "id", "micros", "live", "expired"])


def live_lineages(events: DataFrame, key: str, id: str, time: str, change: str, late: str = "2 hours", idle_seconds: int | None = None) -> DataFrame:
    """(key, id, time, live, expired): the lineages alive after each event of a stream.

    With ``idle_seconds``, a key's lineages are given up when no event came for so
    long: a row with a null id, live 0 and ``expired``. The session's state store must
    be the RocksDB one (``spark.sql.streaming.stateStore.providerClass``).
    """
    rows = _given(events, key, id, time, change).withWatermark("time", late).withColumn("micros", F.unix_micros("time"))
    processor = LiveLineages(idle_seconds * 1_000_000 if idle_seconds else None)
    found = rows.groupBy("key").transformWithStateInPandas(processor, f"key {rows.schema['key'].dataType.simpleString()}, {_STATE}", "Append", "EventTime")
    return found.select(F.col("key").alias(key), F.when(~F.col("expired"), F.col("id")).alias(id), F.timestamp_micros("micros").alias(time), "live", "expired")


def live_counts(events: DataFrame, key: str, id: str, time: str, change: str) -> DataFrame:
    """(key, id, time, live) of a table: what ``live_lineages`` gives for a stream of its rows if none is late and none expires. Long keys are cut into ranges."""
    rows = _given(events, key, id, time, change).dropDuplicates(["key", "id"]).withColumn("micros", F.unix_micros("time").cast("double"))
    summed = running_sum(rows, "micros", "change", "live", ("key",), ("id",))
    return summed.select(F.col("key").alias(key), F.col("id").alias(id), F.col("time").alias(time), "live")
