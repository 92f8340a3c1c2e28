"""Registered streaming queries over the given events, each with the DuckDB SQL of the batch result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import needs as N
from ..streaming import events as E
from ..streaming.run import drained, newest, shared_folder
from ..streaming.user_state import BUCKET_USERS, BUCKETS, map_states, user_states
from . import need_queries
from .driver_tables import table

KIND = {"view": "view", "click": "profile", "signup": "journey", "error": "profile", "purchase": "journey"}


def stream(spark, d) -> DataFrame:
    """The given events as they would arrive: profile updates, car views and journey events."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    e = spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]")  # a pattern, for a file or a folder of files
    kind = F.lit(None).cast("string")
    for given, k in KIND.items():
        kind = F.when(F.col("event_type") == given, k).otherwise(kind)
    k = F.get_json_object("props", "$.k").cast("int")
    name = F.concat(F.when(kind == "view", "car").when(kind == "profile", "field").otherwise("E"), (k % 5).cast("string"))
    return e.select(
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("event_id"), F.col("user_id").cast("string").alias("user_id"), kind.alias("kind"), name.alias("field"), F.col("value").cast("string").alias("value"), F.col("ts").cast("timestamp").alias("ts")
    )


SQL = "e AS (SELECT lpad(CAST(event_id AS VARCHAR), 12, '0') AS event_id, CAST(user_id AS VARCHAR) AS user_id, kind, CASE kind WHEN 'view' THEN 'car' WHEN 'profile' THEN 'field' ELSE 'E' END || (k % 5) AS field, value, CAST(ts AS TIMESTAMP) AS ts FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k, CASE event_type WHEN 'view' THEN 'view' WHEN 'click' THEN 'profile' WHEN 'error' THEN 'profile' ELSE 'journey' END AS kind FROM events))"


def _text(c="ts"):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def st1_latest_fields(spark, d):
    return newest(E.latest_fields(stream(spark, d)), ["user_id", "field"]).select("user_id", "field", F.col("value").cast("double").alias("value"))


def st2_view_sets(spark, d):
    return newest(E.view_sets(stream(spark, d)), ["user_id", "car"]).select("user_id", "car", F.col("attributes").cast("double").alias("attributes"), _text("first_seen"))


def st3_needs_after_events(spark, d):
    """Needs of the users that a batch touches, once each a batch; the last batch of a user counts."""
    rules = N.need_rules(need_queries.WORDS)
    out = shared_folder(spark)

    def users_of(touched: DataFrame) -> DataFrame:
        return need_queries.users(touched.sparkSession, d).join(touched.select(F.col("user_id").cast("long").alias("user_id")), "user_id", "left_semi")

    def write(needs: DataFrame, number: int) -> None:
        N.need_rows(needs, rules).withColumn("batch", F.lit(number)).write.mode("append").parquet(out)

    each = E.needs_per_batch(users_of, lambda u: N.infer_needs(u, rules), write)
    query = stream(spark, d).writeStream.option("checkpointLocation", f"{out}-state").trigger(availableNow=True).foreachBatch(each).start()
    query.awaitTermination()
    rows = spark.read.parquet(out)
    last = rows.groupBy("user_id").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["user_id", "batch"]).select("user_id", "need")


_VIEW = "power_type string, body_type string, car_price_band string, car_size_level string"


def _known_users(spark, d) -> DataFrame:
    """The users' profile columns and views as maps of text."""
    u = need_queries.users(spark, d)
    names = [c for c in u.columns if c not in ("user_id", "views")]
    fields = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.col(n).cast("string") for n in names]))
    views = F.map_from_entries(F.transform("views", lambda v, i: F.struct(F.concat(F.lit("seen"), i.cast("string")), F.to_json(v))))
    return u.select(F.col("user_id").cast("string").alias("user_id"), fields.alias("fields"), views.alias("views"))


def users_of_states(states: DataFrame, schema: dict[str, str]) -> DataFrame:
    """States as users for need rules: columns of the given names and types, and the views that are whole."""
    views = F.filter(F.transform(F.map_values("views"), lambda v: F.from_json(v, _VIEW, {"mode": "PERMISSIVE"})), lambda v: v.isNotNull() & F.coalesce(*[v[x] for x in ("power_type", "body_type", "car_price_band", "car_size_level")]).isNotNull())
    return states.select(F.col("user_id").cast("long").alias("user_id"), *[F.col("fields")[n].cast(t).alias(n) for n, t in schema.items()], views.alias("views"))


def st3_state_needs(spark, d):
    """Needs of the users that events touch, from the stream's own state: the users' tables are read once, as its beginning."""
    rules = N.need_rules(need_queries.WORDS)
    schema = {n: t for n, t in need_queries.users(spark, d).dtypes if n not in ("user_id", "views")}
    with map_states(spark):
        buckets = max(BUCKETS, table(spark, d, "customer").count() // BUCKET_USERS)
        states = newest(user_states(stream(spark, d), _known_users(spark, d), 3650, buckets=buckets), ["user_id"])
    return N.need_rows(N.infer_needs(users_of_states(states.where("not ended"), schema), rules), rules)


def _lines(spark, d) -> DataFrame:
    s = stream(spark, d)
    n = F.col("event_id").cast("long")
    whole = F.to_json(F.struct("event_id", "user_id", "kind", "field", "value", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts")))
    return s.select(F.when(n % 10 == 0, "{broken").when(n % 10 == 1, F.to_json(F.struct("event_id", "kind"))).otherwise(whole).alias("value"))


def st4_rejects(spark, d):
    return newest(E.batch_summary(E.parsed(_lines(spark, d))), ["kind", "status"])


def st5_journey_log(spark, d):
    return drained(E.journey_log(stream(spark, d))).select("user_id", "journey_event", _text())


WINDOWS = {"E0": 7, "E1": 30, "E2": 365}


def st6_observation_windows(spark, d):
    out = drained(E.windowed_events(stream(spark, d), WINDOWS), "update")
    return out.groupBy("user_id", "journey_event").agg(F.max("until").alias("until")).select("user_id", "journey_event", _text("until"))


def st7_window_counts(spark, d):
    """Closed days' counts and a rule flag on them."""
    counts = E.live_counts(stream(spark, d)).drop("users")
    flagged = E.rule_flags(counts, {"busy": F.col("n") > 120})
    return drained(flagged).select(_text("start"), "kind", "n", "busy")


def st7_sliding_counts(spark, d):
    """Counts of closed days that begin every six hours."""
    return drained(E.live_counts(stream(spark, d), slide="6 hours").drop("users")).select(_text("start"), "kind", "n")


def st7_sessions(spark, d):
    """Closed sessions: events of a user with less than two days between them."""
    return drained(E.sessions(stream(spark, d), "2 days")).select("user_id", _text("start"), _text("end"), "n")


def st7_view_to_journey(spark, d):
    """Views with the journey events of the same user within three days."""
    s = stream(spark, d)
    return drained(E.followed(s.where("kind = 'view'"), stream(spark, d).where("kind = 'journey'"), "3 days")).select("user_id", "first_id", "then_id")


QUERIES = {f.__name__: f for f in (st1_latest_fields, st2_view_sets, st3_needs_after_events, st3_state_needs, st4_rejects, st5_journey_log, st6_observation_windows, st7_window_counts, st7_sliding_counts, st7_sessions, st7_view_to_journey)}

ORACLE = {
    "st1_latest_fields": f"WITH {SQL} SELECT user_id, field, arg_max(value, (ts, event_id)) AS value FROM e WHERE kind = 'profile' GROUP BY 1, 2",
    "st2_view_sets": f"WITH {SQL} SELECT user_id, field AS car, arg_min(value, (ts, event_id)) AS attributes, strftime(MIN(ts), '%Y-%m-%d %H:%M:%S') AS first_seen FROM e WHERE kind = 'view' GROUP BY 1, 2",
    "st3_needs_after_events": need_queries.ORACLE["d16_need_rows"] + " WHERE user_id IN (SELECT user_id FROM events)",
    "st3_state_needs": need_queries.ORACLE["d16_need_rows"] + " WHERE user_id IN (SELECT user_id FROM events)",
    "st4_rejects": f"WITH {SQL} SELECT CASE WHEN CAST(event_id AS BIGINT) % 10 = 0 THEN '?' ELSE kind END AS kind, CASE CAST(event_id AS BIGINT) % 10 WHEN 0 THEN 'not JSON' WHEN 1 THEN 'no user_id' ELSE 'ok' END AS status, COUNT(*) AS n FROM e GROUP BY 1, 2",
    "st5_journey_log": f"WITH {SQL} SELECT user_id, field AS journey_event, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM e WHERE kind = 'journey'",
    "st6_observation_windows": f"WITH {SQL} SELECT user_id, field AS journey_event, strftime(MAX(ts) + to_days(CASE field WHEN 'E0' THEN 7 WHEN 'E2' THEN 365 ELSE 30 END), '%Y-%m-%d %H:%M:%S') AS until FROM e WHERE kind = 'journey' GROUP BY 1, 2",
    "st7_window_counts": f"WITH {SQL} SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start, kind, COUNT(*) AS n, COUNT(*) > 120 AS busy FROM e WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT MAX(ts) - INTERVAL 1 HOUR FROM e) GROUP BY 1, 2",
    "st7_sliding_counts": f"WITH {SQL}, w AS (SELECT kind, time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') - INTERVAL 6 HOURS * unnest(range(4)) AS s FROM e) SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, kind, COUNT(*) AS n FROM w WHERE s + INTERVAL 1 DAY <= (SELECT MAX(ts) - INTERVAL 1 HOUR FROM e) GROUP BY 1, 2",
    "st7_sessions": f"WITH {SQL}, g AS (SELECT user_id, ts, SUM(CASE WHEN ts <= before + INTERVAL 2 DAYS THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, LAG(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM e)) SELECT user_id, strftime(MIN(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(MAX(ts) + INTERVAL 2 DAYS, '%Y-%m-%d %H:%M:%S') AS end, COUNT(*) AS n FROM g GROUP BY user_id, s HAVING MAX(ts) + INTERVAL 2 DAYS <= (SELECT MAX(ts) - INTERVAL 1 HOUR FROM e)",
    "st7_view_to_journey": f"WITH {SQL} SELECT a.user_id, a.event_id AS first_id, b.event_id AS then_id FROM e a JOIN e b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 3 DAYS WHERE a.kind = 'view' AND b.kind = 'journey'",
}
