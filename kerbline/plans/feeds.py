"""Live-feed queries: poll summaries on batches and on streams, and nested inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbline.functions.values import flag
from kerbline.operators import temporal as tmp
from kerbline.plans.registry import query
from kerbline.plans.risk import rounded
from kerbline.sources import store
from kerbline.streaming import traffic

POLLS = """p AS (SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS poll, count(DISTINCT user_id % 10) AS tiles, count(DISTINCT user_id) AS road_pieces, avg(value / 100) AS mean_level, avg((value / 100 < 5e-1)::INT) AS slow_share,
  count(*) FILTER (WHERE event_type = 'error') AS closures, count(*) AS readings FROM events GROUP BY 1)"""


def readings(t):
    return t.events.select("event_id", "ts", (F.col("user_id") % 10).alias("tile"), F.col("user_id").alias("piece"), (F.col("value") / 100).alias("level"), "event_type", "value", "props")


@query(
    "poll_series",
    f"WITH {POLLS} SELECT poll, tiles, road_pieces, round(mean_level, 9) AS mean_level, round(slow_share, 9) AS slow_share, closures, readings, (sum(road_pieces) OVER (ORDER BY poll))::BIGINT AS cumulative_pieces FROM p",
)
def poll_series(t):
    return rounded(traffic.poll_series(readings(t), "ts", "tile", "piece", "level", F.col("event_type") == "error"), 9)


@query(
    "hour_profile",
    """WITH a AS (SELECT hour(ts)::INT AS hour, avg(value / 100) AS mean_level FROM events GROUP BY 1), b AS (SELECT hour(ts)::INT AS hour, avg(value) AS click_value FROM events WHERE event_type = 'click' GROUP BY 1),
c AS (SELECT hour(o_orderdate + to_hours((o_orderkey % 20)::INT))::INT AS hour, avg(o_totalprice) AS order_price FROM orders GROUP BY 1)
SELECT coalesce(a.hour, b.hour, c.hour) AS hour, round(mean_level, 5) AS mean_level, round(click_value, 4) AS click_value, round(order_price, 2) AS order_price FROM a FULL JOIN b ON a.hour = b.hour FULL JOIN c ON c.hour = coalesce(a.hour, b.hour)""",
)
def hour_profile(t):
    r = readings(t)
    o = t.orders.withColumn("at", F.expr("timestampadd(HOUR, CAST(o_orderkey % 20 AS INT), o_orderdate)"))
    p = traffic.hour_profile(
        [(r, "ts", F.col("level"), "mean_level"), (r.filter(F.col("event_type") == "click"), "ts", F.col("value"), "click_value"), (o, "at", F.col("o_totalprice"), "order_price")]
    )
    return p.select("hour", F.round("mean_level", 5).alias("mean_level"), F.round("click_value", 4).alias("click_value"), F.round("order_price", 2).alias("order_price"))


FREE = "r AS (SELECT user_id % 10 AS site, user_id AS point, value AS speed, (props->>'$.k')::DOUBLE AS free FROM events)"
SUMMARY = f"""{FREE}, s AS (SELECT site, point, count(*) AS polls, avg(speed) AS mean_speed, quantile_cont(free, 5e-1) AS free_flow, min(speed / nullif(free, 0)) AS min_ratio, avg(speed / nullif(free, 0)) AS mean_ratio, count(*) FILTER (WHERE speed / nullif(free, 0) < 7e-1) AS readings_below FROM r GROUP BY 1, 2)"""


def point_rows(t):
    free = F.get_json_object("props", "$.k").cast("double")
    return t.events.select((F.col("user_id") % 10).alias("site"), F.col("user_id").alias("point"), "ts", F.col("value").alias("speed"), free.alias("free"))


@query(
    "point_summary",
    f"WITH {SUMMARY} SELECT site, point, polls, round(mean_speed, 4) AS mean_speed, free_flow, round(min_ratio, 5) AS min_ratio, round(mean_ratio, 5) AS mean_ratio, readings_below FROM s",
)
def point_summary(t):
    s = traffic.point_summary(point_rows(t), ["site", "point"], "speed", "free")
    return s.withColumns({"mean_speed": F.round("mean_speed", 4), "min_ratio": F.round("min_ratio", 5), "mean_ratio": F.round("mean_ratio", 5)})


@query(
    "live_warnings",
    f"WITH {SUMMARY} SELECT point, round(mean_ratio, 5) AS mean_ratio, (c_custkey % 4)::INT AS band FROM s JOIN customer ON c_custkey = point WHERE mean_ratio < 1 AND c_custkey % 4 >= 2",
)
def live_warnings(t):
    s = traffic.point_summary(point_rows(t), ["point"], "speed", "free")
    bands = t.customer.select(F.col("c_custkey").alias("point"), (F.col("c_custkey") % 4).cast("int").alias("band"))
    return rounded(traffic.live_warnings(s, bands, "point", 1.0).select("point", "mean_ratio", "band"), 5)


@query(
    "collection_status",
    """SELECT min(ts) AS first_reading, max(ts) AS last_reading, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 36e8, 3) AS hours_covered, count(DISTINCT time_bucket(INTERVAL 15 MINUTE, ts)) AS polls, count(*) AS readings, count(DISTINCT user_id) AS pieces FROM events""",
)
def collection_status(t):
    return rounded(traffic.collection_status(readings(t), "ts", "piece"), 3)


@query(
    "poll_accounting",
    "SELECT user_id % 10 AS tile, count(*) AS polls, sum((event_type <> 'error')::INT)::BIGINT AS ok, sum((event_type = 'error')::INT)::BIGINT AS errors, count(*) FILTER (WHERE event_type = 'error') AS polls_with_errors FROM events GROUP BY 1",
)
def poll_accounting(t):
    return traffic.poll_accounting(readings(t), "tile", flag(F.col("event_type") != "error"), flag(F.col("event_type") == "error"))


@query(
    "point_hour_matrix",
    """WITH h AS (SELECT user_id % 10 AS cell, date_trunc('hour', ts) AS hour, round(avg(value), 4) AS v FROM events GROUP BY 1, 2), b AS (SELECT date_trunc('hour', min(ts)) AS a, date_trunc('hour', max(ts)) AS z FROM events),
c AS (SELECT DISTINCT user_id % 10 AS cell FROM events), k AS (SELECT cell, unnest(generate_series(a, z, INTERVAL 1 HOUR)) AS hour FROM c, b)
SELECT k.cell, k.hour, v FROM k LEFT JOIN h ON h.cell = k.cell AND h.hour = k.hour""",
)
def point_hour_matrix(t):
    """Every cell x every hour of the whole span; hours without a reading stay NULL."""
    e = t.events.select((F.col("user_id") % 10).alias("cell"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "value")
    known = e.groupBy("cell", "hour").agg(F.round(F.avg("value"), 4).alias("v"))
    span = e.agg(F.struct(F.min("hour").alias("a"), F.max("hour").alias("z")).alias("s")).scalar()
    cells = e.select("cell").distinct().withColumn("s", span)
    grid = tmp.full_calendar(cells, F.col("s.a"), F.col("s.z")).drop("s")
    return grid.join(known, ["cell", "hour"], "left")


@query(
    "seen_once_pieces",
    "SELECT props, min(event_id) AS first_event FROM events GROUP BY 1",
)
def seen_once_pieces(t):
    """Dimension of distinct geometries with the first reading that showed them."""
    return t.events.groupBy("props").agg(F.min("event_id").alias("first_event"))


@query(
    "json_parallel_arrays",
    "SELECT user_id % 10 AS cell, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_id AS id, value FROM events",
)
def json_parallel_arrays(t):
    """Weather-reply shape: a JSON struct of parallel arrays per cell and hour block, read back to rows."""
    e = t.events.select((F.col("user_id") % 10).alias("cell"), F.date_format("ts", "yyyy-MM-dd").alias("day"), F.hour("ts").alias("h"), F.minute("ts").alias("m"), "event_id", "value")
    replies = e.groupBy("cell", "day", "h", "m").agg(F.collect_list(F.struct("event_id", "value")).alias("l")).select(
        "cell", "day", F.to_json(F.struct(F.struct(F.col("l.event_id").alias("id"), F.col("l.value").alias("value")).alias("hourly"))).alias("body")
    )
    parsed = replies.withColumn("r", F.from_json("body", "hourly struct<id: array<bigint>, value: array<double>>"))
    return store.rows_from_parallel_arrays(parsed, F.col("r.hourly"), ["cell", "day"])


@query("stream_dedupe", "SELECT event_id, user_id, value FROM events")
def stream_dedupe(t):
    """Every reading delivered twice; the stream keeps one."""
    s = traffic.file_stream(t.spark, t.path("events")).withColumn("t", F.col("ts").cast("timestamp"))
    twice = s.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    kept = traffic.without_repeats(twice, "t", ["event_id"]).select("event_id", "user_id", "value")
    return traffic.run_append(kept, "dedupe")


@query(
    "stream_window",
    f"WITH {POLLS} SELECT poll, tiles, road_pieces, round(mean_level, 9) AS mean_level, round(slow_share, 9) AS slow_share, closures, readings FROM p",
)
def stream_window(t):
    """The poll series of a stream, with late readings and exact distinct counts."""
    s = traffic.file_stream(t.spark, t.path("events")).select(
        F.col("ts").cast("timestamp").alias("t"), (F.col("user_id") % 10).alias("tile"), F.col("user_id").alias("piece"), (F.col("value") / 100).alias("level"), "event_type"
    )
    return rounded(traffic.run_poll_windows(s, "t", "tile", "piece", "level", F.col("event_type") == "error"), 9)
