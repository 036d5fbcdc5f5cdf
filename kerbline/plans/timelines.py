"""Series queries over events and orders: matched designs, offsets, nearest in time, gaps, islands."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbline.functions import geo, values
from kerbline.functions import text as tx
from kerbline.operators import relational as rel
from kerbline.operators import temporal as tmp
from kerbline.operators.ordered import scan
from kerbline.plans.registry import query
from kerbline.plans.risk import rounded


def events(t):
    return t.events.withColumn("cell", F.col("user_id") % 10)


CASES = """
cases AS (SELECT event_id, user_id % 10 AS cell, ts FROM events WHERE event_type = 'error'),
cc AS (SELECT event_id AS stratum_id, cell, ts + to_days((k * 7)::INT) AS ts, (k = 0)::INT AS is_case, (7 * k)::INT AS offset_days
  FROM cases, (SELECT unnest(range(-4, 5)) AS k) o
  WHERE month(ts + to_days((k * 7)::INT)) = month(ts) AND year(ts + to_days((k * 7)::INT)) = year(ts)),
buys AS (SELECT user_id % 10 AS cell, date_trunc('hour', ts) AS hour, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1, 2),
ex AS (SELECT cc.*, (coalesce(n, 0) > 0)::INT AS exposed FROM cc LEFT JOIN buys ON buys.cell = cc.cell AND buys.hour = date_trunc('hour', cc.ts))"""


def exposed_place_hours(t):
    e = events(t)
    cases = e.filter(F.col("event_type") == "error").select("event_id", "cell", "ts")
    cc = tmp.case_crossover(cases, "ts", stratum="event_id").withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    buys = (
        e.filter(F.col("event_type") == "purchase")
        .groupBy("cell", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return cc.join(buys, ["cell", "hour"], "left").withColumn("exposed", values.flag(F.col("n") > 0))


@query("case_crossover", f"WITH {CASES} SELECT stratum_id, cell, ts, is_case, offset_days, exposed FROM ex")
def case_crossover(t):
    return exposed_place_hours(t).select("stratum_id", "cell", "ts", "is_case", "offset_days", "exposed")


@query(
    "mh_odds_ratio",
    f"""WITH {CASES},
g AS (SELECT stratum_id, count(*) AS n, sum(is_case) AS cases, sum(exposed) AS tot, max(exposed) FILTER (WHERE is_case = 1) AS a FROM ex GROUP BY 1 HAVING sum(is_case) = 1 AND count(*) >= 2),
q AS (SELECT a, a * ((n - 1) - (tot - a)) / n AS r, (1 - a) * (tot - a) / n AS s, (a + (n - 1 - (tot - a))) / n AS p, ((1 - a) + (tot - a)) / n AS q FROM g),
z AS (SELECT sum(r) AS R1, sum(s) AS S1, sum(p * r) AS PR, sum(p * s) AS PS, sum(q * r) AS QR, sum(q * s) AS QS, count(*) AS sets_used, sum(a)::BIGINT AS cases_exposed FROM q),
v AS (SELECT *, PR / (2 * R1 * R1) + (PS + QR) / (2 * R1 * S1) + QS / (2 * S1 * S1) AS var FROM z)
SELECT round(R1 / S1, 5) AS odds_ratio, round(exp(ln(R1 / S1) - 196e-2 * sqrt(var)), 5) AS ci_low, round(exp(ln(R1 / S1) + 196e-2 * sqrt(var)), 5) AS ci_high,
  sets_used, cases_exposed, CASE WHEN exp(ln(R1 / S1) + 196e-2 * sqrt(var)) < 1 THEN 'fewer events' WHEN exp(ln(R1 / S1) - 196e-2 * sqrt(var)) > 1 THEN 'more events' ELSE 'no clear change' END AS reading,
  CASE WHEN exp(ln(R1 / S1) - 196e-2 * sqrt(var)) > 1 THEN round(R1 / S1, 3) ELSE 1.0::DOUBLE END AS multiplier FROM v""",
)
def mh_odds_ratio(t):
    mh = tmp.mantel_haenszel(exposed_place_hours(t), "stratum_id", "is_case", "exposed")
    low, high = F.col("ci_low"), F.col("ci_high")
    out = mh.withColumns({"reading": tmp.reading_of(low, high), "multiplier": tmp.safe_multiplier(F.col("odds_ratio"), low)})
    return rounded(out, 5)


@query(
    "complete_strata",
    f"WITH {CASES} SELECT stratum_id, ts FROM ex WHERE stratum_id IN (SELECT stratum_id FROM ex GROUP BY 1 HAVING sum(is_case) = 1 AND count(*) >= 2)",
)
def complete_strata(t):
    return rel.complete_strata(exposed_place_hours(t), "stratum_id", "is_case").select("stratum_id", "ts")


@query(
    "case_control_means",
    f"WITH {CASES} SELECT is_case, count(*) AS n, round(avg(exposed), 4) AS exposed_share, round(avg((hour(ts) < 6)::INT), 4) AS night_share FROM ex GROUP BY is_case",
)
def case_control_means(t):
    return rounded(
        exposed_place_hours(t)
        .groupBy("is_case")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("exposed").alias("exposed_share"),
            F.avg(values.flag(F.hour("ts") < 6)).alias("night_share"),
        )
    )


@query(
    "needed_hours",
    f"WITH {CASES} SELECT DISTINCT cell, date_trunc('hour', ts) - to_hours(k::INT) AS hour FROM ex, (SELECT unnest(range(0, 4)) AS k) o",
)
def needed_hours(t):
    return tmp.needed_hours(exposed_place_hours(t), "cell", "hour")


HOURLY = "h AS (SELECT user_id % 10 AS cell, date_trunc('hour', ts) AS hour, round(sum(value), 2) AS rain FROM events GROUP BY 1, 2)"


def hourly(t):
    return (
        events(t)
        .groupBy("cell", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"))
        .agg(F.round(F.sum("value"), 2).alias("rain"))
    )


@query(
    "needed_weather",
    f"""WITH {CASES}, {HOURLY} SELECT h.cell, h.hour, rain FROM h SEMI JOIN
(SELECT DISTINCT cell, date_trunc('hour', ts) - to_hours(k::INT) AS hour FROM ex, (SELECT unnest(range(0, 4)) AS k) o) n ON n.cell = h.cell AND n.hour = h.hour""",
)
def needed_weather(t):
    return hourly(t).join(tmp.needed_hours(exposed_place_hours(t), "cell", "hour"), ["cell", "hour"], "left_semi")


@query(
    "lag_lookup_3h",
    f"""WITH {HOURLY} SELECT h.cell, h.hour, h.rain, a.rain AS rain_lag1, b.rain AS rain_lag2, c.rain AS rain_lag3,
  round(coalesce(a.rain, 0) + coalesce(b.rain, 0) + coalesce(c.rain, 0), 2) AS rain_prev_sum, least(a.rain, b.rain, c.rain) AS rain_prev_min
FROM h LEFT JOIN h a ON a.cell = h.cell AND a.hour = h.hour - INTERVAL 1 HOUR LEFT JOIN h b ON b.cell = h.cell AND b.hour = h.hour - INTERVAL 2 HOUR
LEFT JOIN h c ON c.cell = h.cell AND c.hour = h.hour - INTERVAL 3 HOUR""",
)
def lag_lookup_3h(t):
    lagged = tmp.offset_values(hourly(t), ["cell"], "hour", "rain", (1, 2, 3))
    out = tmp.lag_build_up(lagged, "rain", (1, 2, 3))
    return out.withColumn("rain_prev_sum", F.round("rain_prev_sum", 2))


@query(
    "condition_flags",
    f"""WITH {HOURLY}, w AS (SELECT h.*, h.rain + coalesce(a.rain, 0) AS rain2, h.rain * 2 AS rh, h.rain % 17 AS wind, h.rain % 3 AS spread,
   CASE WHEN hour(h.hour) < 6 THEN 'dark' WHEN hour(h.hour) < 8 THEN 'civil_twilight' ELSE 'daylight' END AS light
   FROM h LEFT JOIN (SELECT cell, hour, rain AS rain FROM h) a ON a.cell = h.cell AND a.hour = h.hour - INTERVAL 1 HOUR)
SELECT cell, hour, (a_rain >= 5e-1)::INT AS cond_rain, (a_rain >= 4)::INT AS cond_heavy_rain, coalesce(rain2 >= 5e-1, false)::INT AS cond_wet_road,
  (rh >= 95 AND wind < 7 AND spread <= 1)::INT AS cond_fog_likely, (light = 'dark')::INT AS cond_dark, (light = 'civil_twilight')::INT AS cond_twilight
FROM (SELECT w.cell, w.hour, w.rain AS a_rain, rain2, rh, wind, spread, light FROM (SELECT cell, hour, rain, rain2, rh, wind, spread, light FROM w) w)""",
)
def condition_flags(t):
    w = tmp.offset_values(hourly(t), ["cell"], "hour", "rain", (1,))
    hod = F.hour("hour")
    w = w.withColumns(
        {
            "rain2": F.col("rain") + F.coalesce("rain_lag1", F.lit(0.0)),
            "rh": F.col("rain") * 2,
            "wind": F.col("rain") % 17,
            "spread": F.col("rain") % 3,
            "light": F.when(hod < 6, "dark").when(hod < 8, "civil_twilight").otherwise("daylight"),
        }
    )
    return w.select("cell", "hour", *values.condition_flags("rain", "rain2", "rh", "wind", "spread", "light"))


@query(
    "asof_nearest",
    """WITH l AS (SELECT event_id, user_id % 10 AS cell, ts FROM events WHERE event_type = 'error'),
r AS (SELECT event_id AS rid, user_id % 10 AS cell, ts AS rts, value FROM events WHERE event_type = 'click'),
j AS (SELECT l.event_id, l.cell, l.ts, r.rts, r.rid, r.value, row_number() OVER (PARTITION BY l.event_id ORDER BY abs(epoch_us(r.rts) - epoch_us(l.ts)), r.rts) AS rn
  FROM l JOIN r ON r.cell = l.cell AND r.rts BETWEEN l.ts - INTERVAL 30 MINUTE AND l.ts + INTERVAL 30 MINUTE)
SELECT l.event_id, l.cell, l.ts, rts AS matched_rts, rid AS matched_rid, value AS matched_value,
  round_even((epoch_us(rts) - epoch_us(l.ts)) / 6e7, 0)::INT AS offset_min
FROM l LEFT JOIN (SELECT * FROM j WHERE rn = 1) j USING (event_id)""",
)
def asof_nearest(t):
    e = events(t)
    left = e.filter(F.col("event_type") == "error").select("event_id", "cell", "ts")
    right = e.filter(F.col("event_type") == "click").select("cell", F.col("ts").alias("rts"), F.col("event_id").alias("rid"), "value")
    return tmp.nearest_in_time(left, right, ["cell"], "ts", "rts", 1800, ["rid", "value"], "event_id")


@query(
    "airport_flags",
    """WITH l AS (SELECT event_id, user_id % 10 AS cell, ts FROM events WHERE event_type = 'error'),
r AS (SELECT user_id % 10 AS cell, ts AS rts, value * 100 AS vis, CASE WHEN value % 3 < 1 THEN 'FG BR' WHEN value % 3 < 2 THEN '-RA' END AS codes FROM events WHERE event_type = 'click'),
j AS (SELECT l.event_id, r.rts, r.vis, r.codes, row_number() OVER (PARTITION BY l.event_id ORDER BY abs(epoch_us(r.rts) - epoch_us(l.ts)), r.rts) AS rn
  FROM l JOIN r ON r.cell = l.cell AND r.rts BETWEEN l.ts - INTERVAL 30 MINUTE AND l.ts + INTERVAL 30 MINUTE)
SELECT l.event_id, CASE WHEN rts IS NOT NULL THEN (coalesce(codes, '') LIKE '%FG%' OR coalesce(vis < 1000, false))::INT END AS fog,
 CASE WHEN rts IS NOT NULL THEN regexp_matches(coalesce(codes, ''), 'BR|HZ|DU')::INT END AS mist_haze,
 CASE WHEN rts IS NOT NULL THEN regexp_matches(coalesce(codes, ''), 'RA|DZ|TS')::INT END AS rain_thunder
FROM l LEFT JOIN (SELECT * FROM j WHERE rn = 1) j USING (event_id)""",
)
def airport_flags(t):
    e = events(t)
    left = e.filter(F.col("event_type") == "error").select("event_id", "cell", "ts")
    codes = F.when(F.col("value") % 3 < 1, "FG BR").when(F.col("value") % 3 < 2, "-RA")
    right = e.filter(F.col("event_type") == "click").select("cell", F.col("ts").alias("rts"), (F.col("value") * 100).alias("vis"), codes.alias("codes"))
    m = tmp.nearest_in_time(left, right, ["cell"], "ts", "rts", 1800, ["vis", "codes"], "event_id")
    return m.select("event_id", *values.airport_flags("matched_rts", "matched_vis", "matched_codes"))


@query(
    "gap_detection",
    """WITH s AS (SELECT user_id % 10 AS cell, ts, lag(ts) OVER (PARTITION BY user_id % 10 ORDER BY ts) AS prev FROM events)
SELECT cell, prev AS gap_starts_after, ts AS resumed_at, round_even((epoch_us(ts) - epoch_us(prev)) / 6e7, 0)::BIGINT AS gap_minutes
FROM s WHERE epoch_us(ts) - epoch_us(prev) > 10800 * 1000000::BIGINT""",
)
def gap_detection(t):
    return tmp.gaps(events(t).select("cell", "ts"), "ts", 3 * 3600, ["cell"])


@query(
    "outages_all_sources",
    """WITH s AS (SELECT ts, lag(ts) OVER (ORDER BY ts) AS prev FROM events)
SELECT prev AS gap_starts_after, ts AS resumed_at, round_even((epoch_us(ts) - epoch_us(prev)) / 6e7, 0)::BIGINT AS gap_minutes
FROM s WHERE epoch_us(ts) - epoch_us(prev) > 1500 * 1000000::BIGINT""",
)
def outages_all_sources(t):
    return tmp.gaps(t.events.select("ts"), "ts", 25 * 60)


@query(
    "running_total",
    """SELECT ts, event_id, count(*) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS cumulative_readings FROM events""",
)
def running_total(t):
    return scan(t.events.select("ts", "event_id"), ["ts", "event_id"], sums={"cumulative_readings": F.lit(1).cast("long")})


@query(
    "latest_wins",
    """WITH r AS (SELECT o_orderkey, o_custkey, o_orderdate, o_orderstatus, max((o_orderdate, o_orderkey)) OVER (PARTITION BY o_custkey) AS top,
  min(o_orderstatus) OVER (PARTITION BY o_custkey) <> max(o_orderstatus) OVER (PARTITION BY o_custkey) AS differs FROM orders)
SELECT o_custkey, o_orderkey, CASE WHEN (o_orderdate, o_orderkey) = top THEN 'kept' WHEN NOT differs THEN 'duplicate (identical content)'
  ELSE 'duplicate (superseded by newer report)' END AS status FROM r""",
)
def latest_wins(t):
    rows = t.orders.select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    return tmp.latest_wins(rows, "o_custkey", ["o_orderdate", "o_orderkey"], ["o_orderstatus"]).select("o_custkey", "o_orderkey", "status")


@query(
    "headway",
    """SELECT event_id, user_id, lag(event_type) OVER w AS leader_class, round((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6, 3) AS gap_to_leader_s,
  round((epoch_us(lead(ts) OVER w) - epoch_us(ts)) / 1e6, 3) AS gap_to_follower_s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
)
def headway(t):
    h = tmp.sessions_of_headway(t.events, "user_id", ["ts", "event_id"], "ts", "event_type")
    return rounded(h.select("event_id", "user_id", "leader_class", "gap_to_leader_s", "gap_to_follower_s"), 3)


@query(
    "pair_headway",
    """WITH h AS (SELECT user_id % 3 AS lane, event_type, lag(event_type) OVER w AS leader, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 AS gap
  FROM events WINDOW w AS (PARTITION BY user_id % 3 ORDER BY ts, event_id))
SELECT lane, event_type || '–' || leader AS pair, count(*) AS n, round(avg(gap), 3) AS mean, round(stddev_samp(gap), 3) AS sd, round(min(gap), 3) AS min, round(max(gap), 3) AS max
FROM h WHERE leader IS NOT NULL GROUP BY 1, 2""",
)
def pair_headway(t):
    e = t.events.withColumn("lane", F.col("user_id") % 3)
    h = tmp.sessions_of_headway(e, "lane", ["ts", "event_id"], "ts", "event_type").filter(F.col("leader_class").isNotNull())
    gap = F.col("gap_to_leader_s")
    return rounded(
        h.groupBy("lane", F.concat_ws("–", "event_type", "leader_class").alias("pair")).agg(
            F.count(F.lit(1)).alias("n"), F.avg(gap).alias("mean"), F.stddev_samp(gap).alias("sd"), F.min(gap).alias("min"), F.max(gap).alias("max")
        ),
        3,
    )


PIECES = """p AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS piece, l_quantity FROM lineitem)"""


@query(
    "turn_contrast",
    f"""WITH {PIECES}, n AS (SELECT *, lag(l_quantity) OVER w AS a, lead(l_quantity) OVER w AS b FROM p WINDOW w AS (PARTITION BY l_orderkey ORDER BY piece))
SELECT l_orderkey, piece, l_quantity, round(coalesce(l_quantity - (coalesce(a, b) + coalesce(b, a)) / 2, 0), 4) AS contrast FROM n""",
)
def turn_contrast(t):
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    out = tmp.turn_contrast(t.lineitem, "l_orderkey", order, "l_quantity")
    return rounded(out.select("l_orderkey", "piece", "l_quantity", "contrast"))


@query(
    "interval_occupancy",
    """WITH s AS (SELECT o_orderdate AS t_in, o_orderdate + to_days((o_orderkey % 30)::INT) AS t_out FROM orders), i AS (SELECT DISTINCT o_orderdate AS instant FROM orders),
e AS (SELECT t, sum(d) AS d FROM (SELECT t_in AS t, 1 AS d FROM s UNION ALL SELECT t_out, -1 FROM s) GROUP BY t),
c AS (SELECT t, sum(d) OVER (ORDER BY t) AS occupied FROM e)
SELECT instant, occupied::BIGINT AS occupied FROM i JOIN c ON c.t = i.instant""",
)
def interval_occupancy(t):
    stays = t.orders.select(F.col("o_orderdate").alias("t_in"), F.expr("timestampadd(DAY, CAST(o_orderkey % 30 AS INT), o_orderdate)").cast("timestamp_ntz").alias("t_out"))
    return tmp.occupancy(stays, "t_in", "t_out", t.orders.select(F.col("o_orderdate").alias("instant")), "instant")


@query(
    "date_islands",
    """WITH d AS (SELECT DISTINCT o_custkey % 50 AS cell, o_orderdate::DATE AS day FROM orders),
g AS (SELECT cell, day, day - (row_number() OVER (PARTITION BY cell ORDER BY day))::INT AS grp FROM d)
SELECT cell, row_number() OVER (PARTITION BY cell ORDER BY min(day)) AS run_no, min(day) AS first_day, max(day) AS last_day, count(*) AS days FROM g GROUP BY cell, grp""",
)
def date_islands(t):
    days = t.orders.select((F.col("o_custkey") % 50).alias("cell"), F.col("o_orderdate").cast("date").alias("day"))
    runs = tmp.date_islands(days, ["cell"], "day")
    return runs.select("cell", F.col("run_no").cast("long").alias("run_no"), F.col("start").alias("first_day"), F.col("end").alias("last_day"), "days")


@query(
    "request_runs",
    """WITH RECURSIVE d AS (SELECT cell, day, row_number() OVER (PARTITION BY cell ORDER BY day) AS rn FROM (SELECT DISTINCT o_custkey AS cell, o_orderdate::DATE AS day FROM orders)),
r AS (SELECT cell, rn, day AS s, day AS e, 1 AS run FROM d WHERE rn = 1
  UNION ALL SELECT d.cell, d.rn, CASE WHEN greatest(1, (d.day - r.s + 1) / 14) <= greatest(1, (r.e - r.s + 1) / 14) + 1 THEN r.s ELSE d.day END, d.day,
   CASE WHEN greatest(1, (d.day - r.s + 1) / 14) <= greatest(1, (r.e - r.s + 1) / 14) + 1 THEN r.run ELSE r.run + 1 END
  FROM r JOIN d ON d.cell = r.cell AND d.rn = r.rn + 1)
SELECT cell, min(s) AS first_day, max(e) AS last_day, (max(e) - min(s) + 1)::INT AS days, round_even(greatest(1, (max(e) - min(s) + 1) / 14), 2) AS est_weight FROM r GROUP BY cell, run""",
)
def request_runs(t):
    days = t.orders.select(F.col("o_custkey").alias("cell"), F.col("o_orderdate").cast("date").alias("day"))
    return tmp.request_runs(days, ["cell"], "day").withColumnsRenamed({"start": "first_day", "end": "last_day"})


@query(
    "year_split",
    """WITH c AS (SELECT o_custkey, min(o_orderdate)::DATE AS first_day, max(o_orderdate)::DATE AS last_day FROM orders GROUP BY 1)
SELECT o_custkey, y::INT AS year, greatest(first_day, make_date(y, 1, 1)) AS part_start, least(last_day, make_date(y, 12, 31)) AS part_end
FROM c, LATERAL (SELECT unnest(range(year(first_day), year(last_day) + 1)) AS y)""",
)
def year_split(t):
    c = t.orders.groupBy("o_custkey").agg(F.min("o_orderdate").cast("date").alias("first_day"), F.max("o_orderdate").cast("date").alias("last_day"))
    return rel.split_at_year_ends(c, "first_day", "last_day").select("o_custkey", "year", "part_start", "part_end")


@query(
    "calendar_parts",
    """SELECT event_id, year(ts)::INT AS year, month(ts)::INT AS month, hour(ts)::INT AS hour, dayname(ts) AS weekday,
 CASE WHEN month(ts) IN (12, 1, 2) THEN 'winter' WHEN month(ts) IN (3, 4, 5) THEN 'pre-monsoon' WHEN month(ts) IN (6, 7, 8, 9) THEN 'monsoon' ELSE 'post-monsoon' END AS season,
 CASE WHEN hour(ts) >= 22 OR hour(ts) <= 3 THEN 'late_night' WHEN hour(ts) <= 6 THEN 'early_morning' WHEN hour(ts) BETWEEN 17 AND 21 THEN 'evening' ELSE 'day' END AS time_band,
 (dayofweek(ts) IN (0, 6))::INT AS weekend, CASE WHEN minute(ts) IN (0, 30) THEN 'rounded_to_30min' ELSE 'minute' END AS time_precision,
 date_trunc('hour', ts - INTERVAL 330 MINUTE) AS utc_hour FROM events""",
)
def calendar_parts(t):
    ts = F.col("ts")
    return t.events.select(
        "event_id",
        *values.calendar_parts(ts),
        values.season(F.month(ts)).alias("season"),
        values.time_band(F.hour(ts)).alias("time_band"),
        values.weekend(ts).alias("weekend"),
        F.when(F.minute(ts).isin(0, 30), "rounded_to_30min").otherwise("minute").alias("time_precision"),
        F.date_trunc("hour", ts - F.expr("INTERVAL '5:30' HOUR TO MINUTE")).cast("timestamp_ntz").alias("utc_hour"),
    )


@query(
    "months_window",
    "SELECT event_id, ts FROM events WHERE strftime(ts, '%Y-%m') BETWEEN '2024-01' AND '2024-01'",
)
def months_window(t):
    return rel.in_months(t.events, "ts", "2024-01", "2024-01").select("event_id", "ts")


SUN = """sun AS (SELECT event_id, ts, 24 + (user_id * 37 % 4000) / 1000.0::DOUBLE AS lat, 90 + (user_id * 53 % 6000) / 1000.0::DOUBLE AS lon, epoch_us(ts) / 864e8 - 109575e-1 AS n FROM events),
s2 AS (SELECT *, radians((((28046e-2 + n * 9856474e-7) % 360) + 360) % 360) AS l, radians((((357528e-3 + n * 9856003e-7) % 360) + 360) % 360) AS g FROM sun),
s3 AS (SELECT *, l + radians(1915e-3 * sin(g) + 2e-2 * sin(2 * g)) AS ecl, radians(23439e-3 - n * 4e-7) AS tilt FROM s2),
s4 AS (SELECT *, asin(sin(tilt) * sin(ecl)) AS dc, atan2(cos(tilt) * sin(ecl), cos(ecl)) AS ra, (((28046061837e-8 + n * 36098564736629e-11) % 360) + 360) % 360 AS gmst FROM s3),
s5 AS (SELECT *, degrees(asin(sin(radians(lat)) * sin(dc) + cos(radians(lat)) * cos(dc) * cos(radians(gmst + lon) - ra))) AS h FROM s4),
s6 AS (SELECT event_id, CASE WHEN h > -575e-3 THEN h + 102e-2 / tan(radians(h + 103e-1 / (h + 511e-2))) / 60 ELSE h END AS e FROM s5)"""


@query(
    "sun_and_light",
    f"WITH {SUN} SELECT event_id, round(e, 3) AS sun_elevation_deg, CASE WHEN e <= -6 THEN 'dark' WHEN e <= 0 THEN 'civil_twilight' ELSE 'daylight' END AS light_computed FROM s6",
)
def sun_and_light(t):
    lat = 24 + (F.col("user_id") * 37 % 4000) / 1000.0
    lon = 90 + (F.col("user_id") * 53 % 6000) / 1000.0
    e = t.events.select("event_id", geo.sun_elevation(F.col("ts"), lat, lon).alias("e"))
    return e.select("event_id", F.round("e", 3).alias("sun_elevation_deg"), geo.light_class(F.col("e")).alias("light_computed"))


@query(
    "first_seen_tokens",
    """WITH f AS (SELECT user_id, min((ts, event_id)) AS seen FROM events GROUP BY 1), r AS (SELECT user_id, row_number() OVER (ORDER BY seen) AS n FROM f)
SELECT user_id, n AS row_no, 'V' || repeat('0', greatest(3 - length(n::VARCHAR), 0)::INT) || n AS token FROM r""",
)
def first_seen_tokens(t):
    """Stable pseudonyms in order of first appearance."""
    from kerbline.operators.ordered import number_rows

    first = t.events.groupBy("user_id").agg(F.min(F.struct("ts", "event_id")).alias("at"))
    numbered = number_rows(first, [F.col("at.ts"), F.col("at.event_id")])
    return numbered.select("user_id", "row_no", tx.padded_id("V", F.col("row_no"), 3).alias("token"))


@query(
    "previous_value_prefix",
    """WITH r AS (SELECT event_id, user_id, CASE WHEN event_id % 4 = 0 THEN coalesce(lag(event_type) OVER w, '') || ' ' || event_type ELSE event_type END AS v, lag(event_type) OVER w AS p
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, v AS raw_value, CASE WHEN p IS NOT NULL AND v <> p AND starts_with(v, p) AND trim(substr(v, length(p) + 1)) <> '' THEN trim(substr(v, length(p) + 1)) ELSE v END AS clean_value FROM r""",
)
def previous_value_prefix(t):
    e = scan(t.events, ["ts", "event_id"], ["user_id"], previous={"p": "event_type"})
    raw = F.when(F.col("event_id") % 4 == 0, F.concat(F.coalesce("p", F.lit("")), F.lit(" "), F.col("event_type"))).otherwise(F.col("event_type"))
    e = e.withColumn("raw_value", raw)
    clean = F.coalesce(tx.without_neighbour_prefix(F.col("raw_value"), F.col("p")), F.col("raw_value"))
    return e.select("event_id", "raw_value", clean.alias("clean_value"))
