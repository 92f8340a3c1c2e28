"""Event streams: latest profile fields, view sets, needs kept current, rejects, windows."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT = "event_id string, user_id string, kind string, field string, value string, ts timestamp"


def parsed(lines: DataFrame, schema: str = EVENT, column: str = "value") -> DataFrame:
    """Lines of JSON as events with ``error``: null, or why the line is rejected."""
    e = F.from_json(column, f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    p = lines.select(F.col(column).alias("line"), e.alias("e"))
    error = F.when(F.col("e").isNull() | F.col("e._bad").isNotNull(), "not JSON").when(F.col("e.user_id").isNull(), "no user_id").when(F.col("e.kind").isNull(), "no kind").when(F.col("e.ts").isNull(), "no time")
    return p.select("line", "e.*", error.alias("error")).drop("_bad")


def accepted(events: DataFrame) -> DataFrame:
    return events.where("error is null").drop("error", "line")


def rejected(events: DataFrame) -> DataFrame:
    return events.where("error is not null").select("line", "error")


def batch_summary(events: DataFrame) -> DataFrame:
    """Events by kind and error (a batch's summary, or a complete-mode stream)."""
    return events.groupBy(F.coalesce("kind", F.lit("?")).alias("kind"), F.coalesce("error", F.lit("ok")).alias("status")).agg(F.count("*").alias("n"))


def latest_fields(events: DataFrame) -> DataFrame:
    """The last written value of each (user, field); works on a stream in update or complete mode, and on a batch."""
    return events.where("kind = 'profile'").groupBy("user_id", "field").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.max("ts").alias("ts"))


def view_sets(events: DataFrame) -> DataFrame:
    """Each user's set of viewed cars, with the attributes first seen."""
    return events.where("kind = 'view'").groupBy("user_id", F.col("field").alias("car")).agg(F.min_by("value", F.struct("ts", "event_id")).alias("attributes"), F.min("ts").alias("first_seen"))


def journey_log(events: DataFrame) -> DataFrame:
    return events.where("kind = 'journey'").select("user_id", F.col("field").alias("journey_event"), "ts")


def live_counts(events: DataFrame, late: str = "1 hour", size: str = "1 day", slide: str | None = None) -> DataFrame:
    """Events by window (sliding if ``slide`` is given) and kind; rows later than the watermark are dropped."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "kind").agg(F.count("*").alias("n"), F.approx_count_distinct("user_id").alias("users")).select("w.start", "w.end", "kind", "n", "users")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """A user's events, each no later than ``gap`` after the one before, as one row, told when the watermark passes its end (last event and gap)."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", "w.start", "w.end", "n")


def followed(first: DataFrame, then: DataFrame, within: str = "7 days", late: str = "1 hour") -> DataFrame:
    """``(user_id, first_id, then_id, first_ts, then_ts)``: events of ``first`` with each of ``then`` of the same user no later than ``within`` after.

    Both are streams of events; rows leave the state when the watermark tells that no partner can come.  Rows later than the
    watermark are dropped.
    """
    a = first.select(F.col("user_id"), F.col("event_id").alias("first_id"), F.col("ts").alias("first_ts")).withWatermark("first_ts", late)
    b = then.select(F.col("user_id").alias("_user"), F.col("event_id").alias("then_id"), F.col("ts").alias("then_ts")).withWatermark("then_ts", late)
    near = F.col("then_ts").between(F.col("first_ts"), F.col("first_ts") + F.expr(f"INTERVAL {within}"))
    return a.join(b, (F.col("user_id") == F.col("_user")) & near).drop("_user")


def needs_per_batch(users_of: Callable[[DataFrame], DataFrame], infer: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: the batch's users, once each, get their needs derived again and written."""

    def run(batch: DataFrame, number: int) -> None:
        touched = batch.select("user_id").distinct()
        write(infer(users_of(touched)), number)

    return run


def windowed_events(events: DataFrame, windows: dict[str, int]) -> DataFrame:
    """Whether a user has each journey event within its observation window, kept as state that ends with the window.

    ``windows``: days an event stays observed.  Emits (user_id, journey_event, ts, until); state leaves when event time passes
    ``until``, so it doesn't grow with the stream.
    """

    def update(key: tuple, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        latest = state.get[0] if state.exists else None
        for b in batches:
            m = b["ts"].max()
            latest = m.value // 1000 if latest is None else max(latest, m.value // 1000)
        days = windows.get(key[1], 30)
        until = latest + days * 86_400_000_000
        state.update((latest,))
        watermark = state.getCurrentWatermarkMs() if state else 0
        if until // 1000 > watermark:
            state.setTimeoutTimestamp(until // 1000)
        yield pd.DataFrame({"user_id": [key[0]], "journey_event": [key[1]], "ts": [pd.Timestamp(latest, unit="us")], "until": [pd.Timestamp(until, unit="us")]})

    e = journey_log(events).withWatermark("ts", "1 day")
    return e.groupBy("user_id", "journey_event").applyInPandasWithState(update, "user_id string, journey_event string, ts timestamp, until timestamp", "latest long", "update", GroupStateTimeout.EventTimeTimeout)


def rule_flags(counts: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Windowed counts with one boolean column per rule."""
    return counts.withColumns(rules)
