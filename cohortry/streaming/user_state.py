"""Users' fields and views held in a stream's own state, so that needs follow events without reading the base tables again."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

STATE = "user_id string, fields map<string,string>, views map<string,string>, us long, ended boolean"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def map_states(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which maps and timers need; the session's setting comes back afterwards."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


#: The two parts of a user's state, each with what makes an event's entry take the place of another: the last write of a field, the first sight of a view.
PARTS = {"fields": lambda new, old: new[1:] > old[1:], "views": lambda new, old: new[1:] < old[1:]}


class _Users(StatefulProcessor):
    """Users' latest fields and first-seen views, an entry of the bucket's map for each user that events touched.

    Each step of a state is a message to another process, so a bucket's users at the beginning are one value, from which a user goes to the map with
    the first event, and a batch's events are brought together before the states of their users are read and written, once each.
    """

    def __init__(self, keep_us: int):
        self.keep_us = keep_us

    def init(self, handle) -> None:
        self.handle = handle
        self.begun = handle.getValueState("begun", "users binary")
        self.users = handle.getMapState("users", "user_id string", "state string")
        self.timer = handle.getValueState("timer", "ms long")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        begun: dict = {}
        for text in initialState["users"]:
            for row in json.loads(text):
                user = begun.setdefault(row["user_id"], {part: {} for part in PARTS})
                for part in PARTS:
                    user[part] |= {name: value for name, value in (row.get(part) or {}).items() if value is not None}
        self._begin(begun)

    def _begin(self, users: dict) -> None:
        self.begun.update((zlib.compress(json.dumps(users).encode(), 1),))

    def _begun(self) -> dict:
        return json.loads(zlib.decompress(self.begun.get()[0])) if self.begun.exists() else {}

    def handleInputRows(self, key, rows, timerValues):
        changed: dict = {}
        for batch in rows:
            for user, event, kind, name, value, us in zip(*(batch[c].tolist() for c in ("user_id", "event_id", "kind", "field", "value", "us"))):
                new = changed.get(user)
                if new is None:
                    new = changed[user] = {"us": us, **{part: {} for part in PARTS}}
                new["us"] = max(new["us"], us)
                if part := {"profile": "fields", "view": "views"}.get(kind):
                    self._put(new[part], part, name, [value, us, event])
        begun, told = None, []
        for user, new in changed.items():
            if self.users.containsKey((user,)):
                state = json.loads(self.users.getValue((user,))[0])
            else:
                begun = self._begun() if begun is None else begun
                first = begun.get(user) or {part: {} for part in PARTS}
                state = {"us": new["us"], **{part: {name: [value, 0, ""] for name, value in first[part].items()} for part in PARTS}}
            state["us"] = max(state["us"], new["us"])
            for part in PARTS:
                for name, entry in new[part].items():
                    self._put(state[part], part, name, entry)
            self.users.updateValue((user,), (json.dumps(state),))
            told.append((user, state, False))
        self._wake(min(self._end(state) for _, state, _ in told))
        yield self._told(told)

    @staticmethod
    def _put(entries: dict, part: str, name: str, new: list) -> None:
        old = entries.get(name)
        if old is None or PARTS[part](new, old):
            entries[name] = new

    def _end(self, state: dict) -> int:
        return (state["us"] + self.keep_us) // 1000

    def _wake(self, ms: int) -> None:
        """Sets the bucket's one timer, unless it comes earlier anyway."""
        before = self.timer.get()[0] if self.timer.exists() else None
        if before is None or ms < before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(ms)
            self.timer.update((ms,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now, fired = timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()
        ends = {k[0]: (self._end(state), state) for k, v in self.users.iterator() for state in (json.loads(v[0]),)}
        ended = {user: state for user, (ms, state) in ends.items() if ms < now or ms == fired}
        self.timer.clear()
        if ended:
            for user in ended:
                self.users.removeKey((user,))
            begun = self._begun()
            if any(user in begun for user in ended):  # they don't begin again
                self._begin({user: state for user, state in begun.items() if user not in ended})
        if left := [ms for user, (ms, _) in ends.items() if user not in ended]:
            self._wake(min(left))
        if ended:
            yield self._told([(user, state, True) for user, state in ended.items()])

    @staticmethod
    def _told(rows: list) -> pd.DataFrame:
        parts = {part: [{} if ended else {name: entry[0] for name, entry in state[part].items()} for _, state, ended in rows] for part in PARTS}
        return pd.DataFrame({"user_id": [user for user, _, _ in rows], **parts, "us": [state["us"] for _, state, _ in rows], "ended": [ended for _, _, ended in rows]})

    def close(self) -> None:
        pass


#: Buckets of users, unless told otherwise; some hundred users in each keep states small and messages few.
BUCKETS, BUCKET_USERS = 256, 256


def user_states(events: DataFrame, initial: DataFrame | None = None, keep_days: int = 365, late: str = "1 day", buckets: int = BUCKETS) -> DataFrame:
    """``(user_id, fields, views, us, ended)``: of each user that a batch touches, once a batch, all fields (last written) and views (first seen).

    ``events(event_id, user_id, kind, field, value, ts)`` is a stream; ``initial(user_id, fields, views)``, maps of text, is read with
    the first batch only, and gives way to any event.  ``keep_days`` after a user's last event, by event time, the state ends
    and a row with ``ended`` and no fields tells so.  Rows later than the watermark are dropped; rows without user or time are left out.
    Users are kept in ``buckets`` by a hash of their id, a number that a stream keeps as long as its checkpoint.
    Start the stream inside ``map_states``, in update mode.
    """
    bucket = F.pmod(F.xxhash64("user_id"), F.lit(buckets)).alias("bucket")
    e = events.where("user_id IS NOT NULL AND ts IS NOT NULL AND field IS NOT NULL").withWatermark("ts", late)
    e = e.select(bucket, "user_id", F.coalesce("event_id", F.lit("")).alias("event_id"), "kind", "field", "value", F.unix_micros("ts").alias("us"), "ts")
    start = None
    if initial is not None:
        rows = initial.where("user_id IS NOT NULL").select(bucket, F.struct("user_id", "fields", "views").alias("user"))
        start = rows.groupBy("bucket").agg(F.to_json(F.collect_list("user")).alias("users")).groupBy("bucket")
    return e.groupBy("bucket").transformWithStateInPandas(_Users(keep_days * 86_400_000_000), STATE, "Update", "EventTime", initialState=start)
