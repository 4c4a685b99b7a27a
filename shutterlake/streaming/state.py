"""Uploads told apart by kept state, and upload sessions with a life of a day.

``deduplicated`` keeps one small state for each (user, hash), so no user is a hot key and a micro-batch reads no table: the state
begins with the table's rows (live or in the trash), and events change it. A pending upload that is not confirmed within its life
is forgotten, by a timer in event time, so that it may be tried again; what the table had, or was confirmed, stays until it is
removed. ``sessions`` keeps a user's present session: a new one closes the one before, a timer closes it after its life.

Both take streams (with RocksDB as the state store) and tables. Within a micro-batch events of a key are taken by time, then by id.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LIVE, TRASH, PENDING = "live", "trash", "pending"
LIFE = 3600.0
DAY = 24 * 3600.0


class Uploads(StatefulProcessor):
    """Routes of the uploads of one (user, hash)."""

    def __init__(self, life: float):
        self.life = life

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "state string")

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        gone = initialState["deleted_at"].notna()
        self.known.update((TRASH if bool(gone.all()) else LIVE,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        events = pd.concat(list(rows)).sort_values(["ts", "event_id"], kind="stable")
        state, out, due = self.known.get()[0] if self.known.exists() else None, [], None
        for at, event_id, kind in zip(events["ts"], events["event_id"], events["kind"], strict=True):
            if state == PENDING and due is not None and at >= due:
                state, due = None, None
            if kind == "upload":
                route = {None: "new", TRASH: "restore"}.get(state, "duplicate")
                if state is None:
                    state, due = PENDING, at + pd.Timedelta(seconds=self.life)
                elif state == TRASH:
                    state = LIVE
                out.append((*key, event_id, at, route))
            elif kind == "stored" and state == PENDING:
                state, due = LIVE, None
            elif kind == "trashed" and state == LIVE:
                state = TRASH
            elif kind == "removed":
                state, due = None, None
        for timer in list(self.handle.listTimers()) if state != PENDING or due is not None else []:
            self.handle.deleteTimer(timer)
        if state is None:
            self.known.clear()
        else:
            self.known.update((state,))
            if due is not None:
                self.handle.registerTimer(int(due.timestamp() * 1000))
        yield pd.DataFrame(out, columns=["user_id", "hash", "event_id", "ts", "route"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.known.exists() and self.known.get()[0] == PENDING:
            self.known.clear()
        yield pd.DataFrame([], columns=["user_id", "hash", "event_id", "ts", "route"])

    def close(self) -> None:
        pass


_ROUTES = "user_id bigint, hash string, event_id bigint, ts timestamp, route string"


def deduplicated(events: DataFrame, media: DataFrame, life: float = LIFE, delay: str = "10 minutes") -> DataFrame:
    """(user_id, hash, event_id, ts, route) of the uploads among ``events`` (user_id, hash, event_id, ts, kind): "duplicate" of one that is
    live or pending, "restore" of one in the trash, else "new".

    ``kind``: upload, stored (a pending upload is in the table now), trashed, removed. ``media`` (user_id, hash, deleted_at): the table when
    the stream begins; of several items with one hash a live one counts.
    """
    own = events.select("user_id", "hash", "event_id", F.col("ts").cast("timestamp").alias("ts"), "kind")
    if events.isStreaming:
        own = own.withWatermark("ts", delay)
    if not events.isStreaming:
        return _walked(own, media, life)
    known = media.select("user_id", "hash", "deleted_at").groupBy("user_id", "hash")
    return own.groupBy("user_id", "hash").transformWithStateInPandas(statefulProcessor=Uploads(life), outputStructType=_ROUTES, outputMode="Append", timeMode="EventTime", initialState=known)


def _walked(events: DataFrame, media: DataFrame, life: float) -> DataFrame:
    """``deduplicated`` over a table: its events are dealt by key and put in order by Spark, and a task walks them with the state of one key.
    So work is a sort and a step an event, whatever the number of keys, and a key's events need not fit in memory."""
    first = F.when(F.every(F.col("deleted_at").isNotNull()), TRASH).otherwise(LIVE)
    begins = media.groupBy("user_id", "hash").agg(first.alias("kind")).select("user_id", "hash", F.lit(None).cast("bigint").alias("event_id"), F.lit(None).cast("timestamp").alias("ts"), "kind", F.lit(0).alias("step"))
    both = begins.unionByName(events.withColumn("step", F.lit(1)))
    order = ["user_id", "hash", "step", F.col("ts").asc_nulls_last(), F.col("event_id").asc_nulls_last()]
    length = round(life * 1_000_000)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, due = None, None, None
        for batch in batches:
            own = (batch.column(c).to_pylist() for c in ("user_id", "hash", "step", "micros", "kind"))
            at, routes = [], []
            for i, (user, hash_, step, now, kind) in enumerate(zip(*own, strict=True)):
                if key != (user, hash_):
                    key, state, due = (user, hash_), None, None
                if step == 0:
                    state = kind
                    continue
                if state == PENDING and due is not None and now is not None and now >= due:
                    state, due = None, None
                if kind == "upload":
                    at.append(i)
                    routes.append({None: "new", TRASH: "restore"}.get(state, "duplicate"))
                    if state is None:
                        state, due = PENDING, None if now is None else now + length
                    elif state == TRASH:
                        state = LIVE
                elif kind == "stored" and state == PENDING:
                    state, due = LIVE, None
                elif kind == "trashed" and state == LIVE:
                    state = TRASH
                elif kind == "removed":
                    state, due = None, None
            if at:
                own = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*(own.column(c) for c in ("user_id", "hash", "event_id", "ts")), pa.array(routes)], names=["user_id", "hash", "event_id", "ts", "route"])

    dealt = both.repartition("user_id", "hash").sortWithinPartitions(*order).withColumn("micros", F.unix_micros("ts"))
    return dealt.mapInArrow(task, _ROUTES)


class Sessions(StatefulProcessor):
    """The present session of one user."""

    def __init__(self, life: float):
        self.life = life

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "session bigint, started timestamp, events bigint")

    def _row(self, key: tuple, session: int, started: datetime.datetime, ended: pd.Timestamp, events: int, how: str) -> tuple:
        return (*key, session, started, ended, events, how)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        events = pd.concat(list(rows)).sort_values(["ts", "event_id"], kind="stable")
        session, started, n = self.now.get() if self.now.exists() else (None, None, 0)
        life, out = pd.Timedelta(seconds=self.life), []
        for at, event_id, begins in zip(events["ts"], events["event_id"], events["begins"], strict=True):
            if session is not None and at >= pd.Timestamp(started) + life:
                out.append(self._row(key, session, started, pd.Timestamp(started) + life, n, "expired"))
                session = None
            if begins:
                if session is not None:
                    out.append(self._row(key, session, started, at, n, "replaced"))
                session, started, n = int(event_id), at, 0
            if session is not None:
                n += 1
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if session is None:
            self.now.clear()
        else:
            self.now.update((session, pd.Timestamp(started).to_pydatetime(), n))
            self.handle.registerTimer(int((pd.Timestamp(started) + life).timestamp() * 1000))
        yield pd.DataFrame(out, columns=["user_id", "session", "started", "ended", "events", "how"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.now.exists():
            session, started, n = self.now.get()
            self.now.clear()
            yield pd.DataFrame([self._row(key, session, started, pd.Timestamp(started) + pd.Timedelta(seconds=self.life), n, "expired")], columns=["user_id", "session", "started", "ended", "events", "how"])

    def close(self) -> None:
        pass


def sessions(events: DataFrame, life: float = DAY, delay: str = "10 minutes") -> DataFrame:
    """(user_id, session, started, ended, events, how) of upload sessions of ``events`` (user_id, event_id, ts, begins): one begins with an
    event that says so and is named by it, and ends with the next one ("replaced") or after ``life`` seconds ("expired"); events
    outside of sessions count for none.

    A stream tells sessions that have ended. A table tells all: it deals a user's events to windows of a session's life, a beginning to
    two of them, so no window of a user is longer than two lives.
    """
    own = events.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "begins")
    kind = "user_id bigint, session bigint, started timestamp, ended timestamp, events bigint, how string"
    if events.isStreaming:
        own = own.withWatermark("ts", delay)
        return own.groupBy("user_id").transformWithStateInPandas(statefulProcessor=Sessions(life), outputStructType=kind, outputMode="Append", timeMode="EventTime")
    slot = F.floor(F.unix_micros("ts") / int(life * 1_000_000))
    heads = own.where("begins").select("user_id", "ts", "event_id", F.lit(True).alias("begins"), F.explode(F.array(slot, slot + 1)).alias("slot"), slot.alias("home"))
    rest = own.where("NOT begins").select("user_id", "ts", "event_id", "begins", slot.alias("slot"), slot.alias("home"))
    order = Window.partitionBy("user_id", "slot").orderBy("ts", "event_id")
    last = F.last(F.when(F.col("begins"), F.struct(F.col("event_id").alias("session"), F.col("ts").alias("started"))), True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    inside = heads.unionByName(rest).withColumn("s", last).where("s IS NOT NULL AND slot = home")
    inside = inside.where(F.unix_micros("ts") < F.unix_micros("s.started") + int(life * 1_000_000))
    counts = inside.groupBy("user_id", F.col("s.session").alias("session"), F.col("s.started").alias("started")).agg(F.count("*").alias("events"))
    # the next beginning within a life is in the same window or the next, where both stand
    after = Window.partitionBy("user_id", "slot").orderBy("ts", "event_id")
    next_ = heads.withColumn("next", F.lead("ts").over(after)).groupBy("user_id", F.col("event_id").alias("session"), F.col("ts").alias("started")).agg(F.min("next").alias("next"))
    out = counts.join(next_, ["user_id", "session", "started"])
    end = F.timestamp_micros(F.unix_micros("started") + int(life * 1_000_000))
    replaced = F.col("next") < end
    return out.select("user_id", "session", "started", F.when(replaced, F.col("next")).otherwise(end).alias("ended"), "events", F.when(replaced, "replaced").otherwise("expired").alias("how"))
