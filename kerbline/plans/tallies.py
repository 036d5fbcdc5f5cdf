"""Group statistics queries: shares, cross-tabs, percentiles, scorecards, traffic-count style tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbline.functions import text as tx
from kerbline.functions import values
from kerbline.operators import aggregates as agg
from kerbline.operators import relational as rel
from kerbline.plans.registry import query
from kerbline.plans.risk import rounded
from kerbline.plans.timelines import events

STATUSES = ["F", "O", "P"]


@query(
    "value_share",
    "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(count(*) / (SELECT count(*) FROM orders), 6) AS share FROM orders GROUP BY 1, 2",
)
def value_share(t):
    return rounded(agg.value_shares(t.orders, ["o_orderstatus", "o_orderpriority"]), 6)


@query(
    "crosstab_share",
    """SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS F, count(*) FILTER (WHERE o_orderstatus = 'O') AS O, count(*) FILTER (WHERE o_orderstatus = 'P') AS P,
  round(count(*) FILTER (WHERE o_orderstatus = 'F') / count(*), 6) AS F_share, round(count(*) FILTER (WHERE o_orderstatus = 'O') / count(*), 6) AS O_share,
  round(count(*) FILTER (WHERE o_orderstatus = 'P') / count(*), 6) AS P_share FROM orders GROUP BY 1""",
)
def crosstab_share(t):
    return rounded(agg.cross_tab(t.orders, "o_orderpriority", "o_orderstatus", STATUSES), 6)


@query(
    "crosstab_column_share",
    """WITH c AS (SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS F, count(*) FILTER (WHERE o_orderstatus = 'O') AS O, count(*) FILTER (WHERE o_orderstatus = 'P') AS P FROM orders GROUP BY 1)
SELECT *, round(F / (SELECT sum(F) FROM c), 6) AS F_share, round(O / (SELECT sum(O) FROM c), 6) AS O_share, round(P / (SELECT sum(P) FROM c), 6) AS P_share FROM c""",
)
def crosstab_column_share(t):
    return rounded(agg.cross_tab(t.orders, "o_orderpriority", "o_orderstatus", STATUSES, by="column"), 6)


@query(
    "stats_pack",
    """SELECT l_returnflag, count(l_extendedprice) AS n, round(avg(l_extendedprice), 3) AS mean, round(stddev_samp(l_extendedprice), 3) AS sd,
  round(quantile_cont(l_extendedprice, 15e-2), 6) AS p15, round(quantile_cont(l_extendedprice, 5e-1), 6) AS p50, round(quantile_cont(l_extendedprice, 85e-2), 6) AS p85,
  round(quantile_cont(l_extendedprice, 98e-2), 6) AS p98, min(l_extendedprice) AS min, max(l_extendedprice) AS max FROM lineitem GROUP BY 1""",
)
def stats_pack(t):
    out = agg.stats_pack(t.lineitem, ["l_returnflag"], "l_extendedprice")
    digits = {"mean": 3, "sd": 3, "p15": 6, "p50": 6, "p85": 6, "p98": 6}
    return out.withColumns({c: F.round(c, n) for c, n in digits.items()})


@query(
    "weibull_percentile",
    """WITH r AS (SELECT l_returnflag, l_quantity AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) AS rn, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem),
h AS (SELECT *, greatest(1, least(15e-2 * (n + 1), n)) AS h15, greatest(1, least(5e-1 * (n + 1), n)) AS h50, greatest(1, least(98e-2 * (n + 1), n)) AS h98 FROM r)
SELECT l_returnflag, max(n) AS n,
 round(max(v) FILTER (WHERE rn = floor(h15)) + max(h15 - floor(h15)) * (max(v) FILTER (WHERE rn = ceil(h15)) - max(v) FILTER (WHERE rn = floor(h15))), 4) AS w15,
 round(max(v) FILTER (WHERE rn = floor(h50)) + max(h50 - floor(h50)) * (max(v) FILTER (WHERE rn = ceil(h50)) - max(v) FILTER (WHERE rn = floor(h50))), 4) AS w50,
 round(max(v) FILTER (WHERE rn = floor(h98)) + max(h98 - floor(h98)) * (max(v) FILTER (WHERE rn = ceil(h98)) - max(v) FILTER (WHERE rn = floor(h98))), 4) AS w98
FROM h GROUP BY 1""",
)
def weibull_percentile(t):
    return rounded(agg.weibull_percentiles(t.lineitem, ["l_returnflag"], "l_quantity", (0.15, 0.5, 0.98)))


@query(
    "field_profile",
    """WITH j AS (SELECT source, quality::VARCHAR AS quality, toxic::VARCHAR AS toxic, lang FROM documents LEFT JOIN labels USING (doc_id)),
l AS (SELECT unnest(['source', 'quality', 'toxic', 'lang']) AS field, unnest([source, quality, toxic, lang]) AS v FROM j)
SELECT field, round(avg((v IS NULL OR trim(v) = '')::INT), 6) AS blank_share, round(avg((coalesce(lower(trim(v)), '') IN ('0', 'src0'))::INT), 6) AS vague_share,
  round(avg((v IS NOT NULL AND trim(v) <> '' AND lower(trim(v)) NOT IN ('0', 'src0'))::INT), 6) AS usable_share FROM l GROUP BY field""",
)
def field_profile(t):
    j = t.documents.select("doc_id", "source", "lang").join(t.labels, "doc_id", "left")
    return rounded(agg.field_profile(j, ["source", "quality", "toxic", "lang"], ["0", "src0"]), 6)


@query(
    "missing_and_zero",
    """WITH j AS (SELECT n_chars, quality, toxic FROM documents LEFT JOIN labels USING (doc_id))
SELECT 'quality' AS feature, round(avg((quality IS NULL)::INT), 6) AS missing_share, round(avg(coalesce(quality = 0, false)::INT), 6) AS zero_share FROM j
UNION ALL SELECT 'toxic', round(avg((toxic IS NULL)::INT), 6), round(avg(coalesce(toxic = 0, false)::INT), 6) FROM j
UNION ALL SELECT 'n_chars', round(avg((n_chars IS NULL)::INT), 6), round(avg(coalesce(n_chars = 0, false)::INT), 6) FROM j""",
)
def missing_and_zero(t):
    j = t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id", "left")
    return rounded(agg.missing_and_zero(j, ["quality", "toxic", "n_chars"]), 6)


@query(
    "tag_coverage",
    """WITH p AS (SELECT event_type, CASE WHEN event_id % 3 = 0 THEN NULL ELSE (props->>'$.k')::BIGINT END AS k FROM events)
SELECT event_type, count(*) AS n, round(avg((k IS NOT NULL)::INT), 6) AS k_share, round(avg((k >= 50)::INT), 6) AS high_share FROM p GROUP BY 1""",
)
def tag_coverage(t):
    tags = F.from_json("props", "map<string,bigint>")
    k = F.when(F.col("event_id") % 3 != 0, F.try_element_at(tags, F.lit("k")))
    return rounded(
        t.events.withColumn("k", k)
        .groupBy("event_type")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(F.col("k").isNotNull().cast("double")).alias("k_share"),
            F.avg((F.col("k") >= 50).cast("double")).alias("high_share"),
        ),
        6,
    )


@query(
    "data_dictionary",
    """SELECT 'orders' AS table_name, unnest(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority']) AS column_name,
  unnest(['bigint', 'bigint', 'string', 'double', 'timestamp_ntz', 'string']) AS data_type,
  unnest([count(o_orderkey), count(o_custkey), count(o_orderstatus), count(o_totalprice), count(o_orderdate), count(o_orderpriority)]) AS non_null,
  unnest(['order id', '', '', '', '', '']) AS description FROM orders""",
)
def data_dictionary(t):
    return agg.data_dictionary(t.orders, "orders", {"o_orderkey": "order id"})


@query(
    "tvd",
    """WITH c AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2), q AS (SELECT c_mktsegment, sum(n) / (SELECT count(*) FROM customer) AS q FROM c GROUP BY 1),
s AS (SELECT c_nationkey, sum(n) AS size FROM c GROUP BY 1)
SELECT s.c_nationkey, round(sum(abs(coalesce(n, 0) / size - q)) / 2, 6) AS distance FROM s CROSS JOIN q LEFT JOIN c ON c.c_nationkey = s.c_nationkey AND c.c_mktsegment = q.c_mktsegment GROUP BY 1""",
)
def tvd(t):
    return rounded(agg.group_share_distance(t.customer, "c_nationkey", "c_mktsegment"), 6)


@query(
    "subset_distance",
    """WITH l AS (SELECT o_totalprice > 300000 AS s, unnest(['status', 'priority']) AS feature, unnest([o_orderstatus, o_orderpriority]) AS value FROM orders),
c AS (SELECT feature, value, count(*) AS a, count(*) FILTER (WHERE s) AS b FROM l GROUP BY 1, 2)
SELECT feature, round(sum(abs(b / tb - a / ta)) / 2, 6) AS distance FROM (SELECT *, sum(a) OVER (PARTITION BY feature) AS ta, sum(b) OVER (PARTITION BY feature) AS tb FROM c) x GROUP BY 1""",
)
def subset_distance(t):
    o = t.orders.select("o_totalprice", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    return rounded(agg.share_distance(o, F.col("o_totalprice") > 300000, ["status", "priority"]), 6)


@query(
    "aligned_distributions",
    """WITH a AS (SELECT l_quantity AS v, count(*) / (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R' AND l_quantity < 30) AS share_a FROM lineitem WHERE l_returnflag = 'R' AND l_quantity < 30 GROUP BY 1),
b AS (SELECT l_quantity AS v, count(*) / (SELECT count(*) FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 20) AS share_b FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 20 GROUP BY 1)
SELECT v, round(coalesce(share_a, 0), 6) AS share_a, round(coalesce(share_b, 0), 6) AS share_b, round(coalesce(share_a, 0) - coalesce(share_b, 0), 6) AS difference FROM a FULL JOIN b USING (v)""",
)
def aligned_distributions(t):
    li = t.lineitem.select("l_returnflag", F.col("l_quantity").alias("v"))
    a = agg.value_shares(li.filter((F.col("l_returnflag") == "R") & (F.col("v") < 30)), ["v"], share="share_a")
    b = agg.value_shares(li.filter((F.col("l_returnflag") == "A") & (F.col("v") > 20)), ["v"], share="share_b")
    return rounded(agg.aligned_difference(a, b, ["v"]), 6)


MASKS = """m AS (SELECT c.*, unnest(CASE WHEN c_acctbal >= 0 THEN ['all', 'solvent'] ELSE ['all'] END || CASE WHEN c_mktsegment = 'BUILDING' THEN ['building'] ELSE [] END || CASE WHEN c_nationkey < 10 THEN ['west'] ELSE [] END) AS region FROM customer c)"""


def scorecard(t):
    groups = {
        "all": F.lit(True),
        "solvent": F.col("c_acctbal") >= 0,
        "building": F.col("c_mktsegment") == "BUILDING",
        "west": F.col("c_nationkey") < 10,
    }
    return agg.overlapping_groups(
        t.customer,
        groups,
        [
            F.count(F.lit(1)).alias("customers"),
            F.countDistinct("c_nationkey").alias("nations"),
            F.round(F.avg("c_acctbal"), 4).alias("mean_balance"),
            F.round(F.avg((F.col("c_acctbal") < 0).cast("double")), 6).alias("debt_share"),
        ],
    )


@query(
    "overlap_scorecard",
    f"WITH {MASKS} SELECT region, count(*) AS customers, count(DISTINCT c_nationkey) AS nations, round(avg(c_acctbal), 4) AS mean_balance, round(avg((c_acctbal < 0)::INT), 6) AS debt_share FROM m GROUP BY region",
)
def overlap_scorecard(t):
    return scorecard(t)


@query(
    "scorecard_transposed",
    f"""WITH {MASKS}, g AS (SELECT region, count(*)::DOUBLE AS customers, count(DISTINCT c_nationkey)::DOUBLE AS nations, round(avg(c_acctbal), 4) AS mean_balance FROM m GROUP BY region),
l AS (SELECT region, unnest(['customers', 'nations', 'mean_balance']) AS measure, unnest([customers, nations, mean_balance]) AS v FROM g)
SELECT measure, max(v) FILTER (WHERE region = 'all') AS "all", max(v) FILTER (WHERE region = 'solvent') AS solvent, max(v) FILTER (WHERE region = 'building') AS building, max(v) FILTER (WHERE region = 'west') AS west FROM l GROUP BY measure""".replace('AS "all"', "AS everyone"),
)
def scorecard_transposed(t):
    wide = agg.transposed(scorecard(t), "region", ["customers", "nations", "mean_balance"], ["all", "solvent", "building", "west"])
    return wide.withColumnRenamed("all", "everyone")


@query(
    "exposure_ratio",
    """WITH c AS (SELECT p_type, count(*) FILTER (WHERE l_returnflag = 'R') AS fault, count(*) FILTER (WHERE l_returnflag <> 'R') AS other FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1)
SELECT p_type, fault, other, round(fault / (SELECT sum(fault) FROM c), 6) AS share_fault, round(other / (SELECT sum(other) FROM c), 6) AS share_other,
  round((fault / (SELECT sum(fault) FROM c)) / (other / (SELECT sum(other) FROM c)), 6) AS ratio FROM c""",
)
def exposure_ratio(t):
    j = t.lineitem.select("l_partkey", "l_returnflag").join(t.part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    return rounded(agg.exposure_ratio(j, "p_type", F.col("l_returnflag") == "R"), 6)


@query(
    "pair_configuration",
    """WITH j AS (SELECT l_orderkey, count(*) AS n, min(p_type) AS a, max(p_type) AS b, bool_or(l_returnflag = 'R') AS fatal FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1)
SELECT a || ' – ' || b AS pair, count(*) AS events, round(avg(fatal::INT), 6) AS fatal_share FROM j WHERE n = 2 GROUP BY 1 ORDER BY events DESC, pair LIMIT 15""",
)
def pair_configuration(t):
    """The fifteen most frequent pairs of classes among two-line orders."""
    j = t.lineitem.select("l_orderkey", "l_partkey", "l_returnflag").join(t.part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    pairs = agg.pair_configuration(j, "l_orderkey", "p_type", [F.bool_or(F.col("l_returnflag") == "R").alias("fatal")])
    out = pairs.agg(F.count(F.lit(1)).alias("events"), F.round(F.avg(F.col("fatal").cast("double")), 6).alias("fatal_share"))
    return out.orderBy(F.col("events").desc(), "pair").limit(15)


@query(
    "joined_values",
    "SELECT p_brand, array_to_string(list_sort(list(DISTINCT p_type)), ';') AS p_type FROM part GROUP BY 1",
)
def joined_values(t):
    return agg.joined_values(t.part, ["p_brand"], "p_type")


@query(
    "other_party",
    """WITH j AS (SELECT l_orderkey, l_returnflag, list_sort(list(DISTINCT l_returnflag) OVER (PARTITION BY l_orderkey)) AS classes FROM lineitem)
SELECT l_returnflag, CASE WHEN len(classes) > 1 THEN array_to_string(list_filter(classes, lambda x: x <> l_returnflag), ' – ') ELSE l_returnflag END AS other, count(*) AS n FROM j GROUP BY 1, 2""",
)
def other_party(t):
    """Which other classes each party met; the class set of an event has at most three members."""
    classes = t.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("classes"))
    counts = t.lineitem.groupBy("l_orderkey", "l_returnflag").agg(F.count(F.lit(1)).alias("c"))
    j = counts.join(classes, "l_orderkey")
    return (
        j.withColumn("other", agg.other_side(F.col("classes"), F.col("l_returnflag")))
        .groupBy("l_returnflag", "other")
        .agg(F.sum("c").alias("n"))
    )


FACTORS = {"1-URGENT": 3.0, "2-HIGH": 1.5, "3-MEDIUM": 1.0, "4-NOT SPECIFIED": 0.5, "5-LOW": 0.25}


@query(
    "weighted_class_counts",
    """WITH w AS (SELECT o_orderstatus, sum(CASE o_orderpriority WHEN '1-URGENT' THEN 3e0 WHEN '2-HIGH' THEN 15e-1 WHEN '3-MEDIUM' THEN 1e0 WHEN '4-NOT SPECIFIED' THEN 5e-1 WHEN '5-LOW' THEN 25e-2 ELSE 1e0 END) AS equivalents, count(*) AS vehicles, count(*) * 116e-2 AS reported FROM orders GROUP BY 1)
SELECT o_orderstatus, vehicles, equivalents, CASE WHEN abs(reported - equivalents) <= greatest(2e-2, abs(reported) * 5e-3) THEN 'MATCH' ELSE 'MISMATCH' END AS status FROM w""",
)
def weighted_class_counts(t):
    from kerbline.operators.quality import tolerance_status

    w = agg.weighted_counts(t.orders, FACTORS, "o_orderpriority", F.lit(1), ["o_orderstatus"])
    return w.withColumn("status", tolerance_status(F.col("vehicles") * 1.16, F.col("equivalents")))


@query(
    "peak_hour_factor",
    """WITH q AS (SELECT user_id % 10 AS cell, time_bucket(INTERVAL 15 MINUTE, ts) AS quarter, count(*) AS v FROM events GROUP BY 1, 2),
h AS (SELECT cell, quarter, v + lag(v) OVER w + lag(v, 2) OVER w + lag(v, 3) OVER w AS hour, greatest(v, lag(v) OVER w, lag(v, 2) OVER w, lag(v, 3) OVER w) AS top, lag(v, 3) OVER w IS NOT NULL AS ok FROM q WINDOW w AS (PARTITION BY cell ORDER BY quarter))
SELECT cell, max(hour) AS peak_hour_volume, round(arg_max(hour / (4 * top), (hour, -epoch_us(quarter))), 6) AS peak_hour_factor FROM h WHERE ok GROUP BY 1""",
)
def peak_hour_factor(t):
    quarter = F.timestamp_seconds(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 900000000) * 900).cast("timestamp_ntz")
    e = events(t).select("cell", quarter.alias("quarter"), F.lit(1).alias("v"))
    return rounded(agg.peak_hour(e, ["cell"], "quarter", "v"), 6)


@query(
    "od_expansion",
    """WITH l AS (SELECT o_orderpriority AS mode, c_nationkey AS origin, s_nationkey AS destination FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey),
c AS (SELECT mode, count(*) AS counted FROM l GROUP BY 1), i AS (SELECT o_orderpriority AS mode, count(*) AS interviewed FROM orders GROUP BY 1)
SELECT mode, origin, destination, count(*) AS trips, round(count(*) * (max(counted) / max(interviewed)), 4) AS expanded FROM l JOIN c USING (mode) JOIN i USING (mode) GROUP BY 1, 2, 3""",
)
def od_expansion(t):
    o = t.orders.select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("mode"))
    trips = (
        t.lineitem.select("l_orderkey", "l_suppkey")
        .join(o, F.col("o_orderkey") == F.col("l_orderkey"))
        .join(t.customer.select("c_custkey", F.col("c_nationkey").alias("origin")), F.col("c_custkey") == F.col("o_custkey"))
        .join(t.supplier.select("s_suppkey", F.col("s_nationkey").alias("destination")), F.col("s_suppkey") == F.col("l_suppkey"))
        .groupBy("mode", "origin", "destination")
        .agg(F.count(F.lit(1)).alias("trips"))
    )
    counted = trips.groupBy("mode").agg(F.sum("trips").alias("counted"))
    interviewed = o.groupBy("mode").agg(F.count(F.lit(1)).alias("interviewed"))
    return rounded(agg.od_expansion(trips, counted, interviewed, "mode", "trips").drop("factor"))


@query(
    "moving_observer",
    """WITH r AS (SELECT o_custkey AS site, (o_orderkey % 2)::INT AS dir, count(*) AS opposite, sum(o_totalprice) / 1e5 AS travel_h, (count(*) % 5)::BIGINT AS overtaking, (count(*) % 3)::BIGINT AS overtaken FROM orders GROUP BY 1, 2),
p AS (SELECT a.site, a.dir, (b.opposite + a.overtaking - a.overtaken) / (a.travel_h + b.travel_h) AS flow, a.travel_h, a.overtaking - a.overtaken AS net FROM r a JOIN r b ON a.site = b.site AND a.dir <> b.dir),
s AS (SELECT *, travel_h - net / nullif(flow, 0) AS stream_h FROM p)
SELECT site, dir, round(flow, 4) AS flow, round(stream_h, 4) AS stream_h, round(2 / nullif(stream_h, 0), 3) AS speed FROM s""",
)
def moving_observer(t):
    n = F.count(F.lit(1))
    runs = t.orders.groupBy(F.col("o_custkey").alias("site"), (F.col("o_orderkey") % 2).cast("int").alias("dir")).agg(
        n.alias("opposite"), (F.sum("o_totalprice") / 1e5).alias("travel_h"), (n % 5).alias("overtaking"), (n % 3).alias("overtaken"), F.lit(2.0).alias("length_km")
    )
    m = agg.moving_observer(runs, "site", "dir")
    return m.select("site", "dir", F.round("flow", 4).alias("flow"), F.round("stream_h", 4).alias("stream_h"), F.round("speed", 3).alias("speed"))


@query(
    "trap_speed",
    """SELECT event_id, round(1836e-1 / (1 + value % 20), 4) AS speed_kmh, CASE WHEN 1836e-1 / (1 + value % 20) > 120 THEN 'too fast' WHEN 1836e-1 / (1 + value % 20) < 10 THEN 'too slow' ELSE 'plausible' END AS label FROM events""",
)
def trap_speed(t):
    """Speed over a 51 m trap from entry and exit times, with a plausibility label."""
    speed = 51.0 * 3.6 / (1 + F.col("value") % 20)
    label = values.first_match([(speed > 120, "too fast"), (speed < 10, "too slow")], "plausible")
    return t.events.select("event_id", F.round(speed, 4).alias("speed_kmh"), label.alias("label"))


@query(
    "clock_durations",
    """WITH c AS (SELECT event_id, (event_id % 12)::VARCHAR || ':' || lpad((event_id % 60)::VARCHAR, 2, '0') AS time_in, (12 + event_id % 11)::VARCHAR || ':' || lpad((event_id * 7 % 60)::VARCHAR, 2, '0') AS time_out FROM events),
m AS (SELECT event_id, (12 * 60 + (event_id % 11) * 60 + event_id * 7 % 60 - (event_id % 12) * 60 - event_id % 60)::INT AS minutes FROM c)
SELECT event_id, minutes, (minutes = 600 + event_id % 100)::INT AS matches FROM m""",
)
def clock_durations(t):
    k = F.col("event_id")
    pad = lambda c: F.lpad(c.cast("string"), 2, "0")
    c = t.events.select(
        "event_id",
        F.concat_ws(":", (k % 12).cast("string"), pad(k % 60)).alias("time_in"),
        F.concat_ws(":", (12 + k % 11).cast("string"), pad(k * 7 % 60)).alias("time_out"),
    )
    minutes = tx.clock_minutes(F.col("time_out")) - tx.clock_minutes(F.col("time_in"))
    return c.select("event_id", minutes.alias("minutes")).withColumn("matches", values.flag(F.col("minutes") == 600 + k % 100))


@query(
    "histogram",
    """WITH b AS (SELECT floor(value / 5e-1)::BIGINT AS bin, count(*) AS n FROM events GROUP BY 1)
SELECT bin, n, round(bin * 5e-1, 4) AS bin_start, round(n / (SELECT sum(n) FROM b), 6) AS share, (sum(n) OVER (ORDER BY bin))::BIGINT AS upto FROM b""",
)
def histogram(t):
    return rounded(agg.histogram(t.events, "value", 0.5), 6)


@query(
    "coverage_ratio",
    "SELECT count(*) AS rows, count(DISTINCT o_custkey) AS customers, round(count(*) / 20000.0::DOUBLE, 6) AS coverage FROM orders",
)
def coverage_ratio(t):
    return t.orders.agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("o_custkey").alias("customers"), F.round(F.count(F.lit(1)) / 20000.0, 6).alias("coverage")
    )


@query(
    "plausible_range",
    "SELECT count(*) FILTER (WHERE c_acctbal BETWEEN 0 AND 8000) AS kept, count(*) FILTER (WHERE NOT c_acctbal BETWEEN 0 AND 8000) AS rejected, count(*) FILTER (WHERE c_acctbal IS NULL) AS missing FROM customer",
)
def plausible_range(t):
    return rel.plausible_with_rejects(t.customer, "c_acctbal", 0, 8000)


@query(
    "repeated_positions",
    """SELECT round(24 + (user_id * 37 % 4000) / 1000.0::DOUBLE, 5) AS lat, round(90 + (user_id * 53 % 6000) / 1000.0::DOUBLE, 5) AS lon, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) >= 5""",
)
def repeated_positions(t):
    e = t.events.select((24 + (F.col("user_id") * 37 % 4000) / 1000.0).alias("lat"), (90 + (F.col("user_id") * 53 % 6000) / 1000.0).alias("lon"))
    return agg.repeated_positions(e, "lat", "lon", 5)


@query(
    "grid_hotspots",
    """WITH g AS (SELECT c_custkey * 7919 % 10000 // 1000 AS cy, c_custkey * 104729 % 10000 // 1000 AS cx, count(*) AS n, count(*) FILTER (WHERE c_acctbal < 0) AS severe, arg_min(c_mktsegment, c_custkey) AS label FROM customer GROUP BY 1, 2)
SELECT cy AS cell_lat, cx AS cell_lon, n, severe, label, round(n / (SELECT sum(n) FROM g), 6) AS share FROM g WHERE n >= 3""",
)
def grid_hotspots(t):
    k = F.col("c_custkey")
    cy, cx = F.floor(k * 7919 % 10000 / 1000), F.floor(k * 104729 % 10000 / 1000)
    return rounded(agg.grid_hotspots(t.customer, cy, cx, F.col("c_acctbal") < 0, "c_mktsegment", "c_custkey", 3), 6)


@query(
    "severity_by_condition",
    """WITH l AS (SELECT (event_type = 'error')::INT AS fatal, (value > 50)::INT AS big, unnest(['night', 'weekend']) AS condition, unnest([hour(ts) < 6, dayofweek(ts) IN (0, 6)]) AS in_condition FROM events)
SELECT condition, in_condition, count(*) AS n, round(avg(fatal), 6) AS fatal_share, round(avg(big), 6) AS big_share FROM l GROUP BY 1, 2""",
)
def severity_by_condition(t):
    conditions = {"night": F.hour("ts") < 6, "weekend": F.dayofweek("ts").isin(1, 7)}
    outcomes = {"fatal": F.col("event_type") == "error", "big": F.col("value") > 50}
    return rounded(agg.condition_table(t.events, conditions, outcomes), 6)


@query(
    "measurement_agreement",
    """SELECT round(avg((hour(ts) < 12)::INT) FILTER (WHERE event_type = 'view'), 6) AS share_when_said, round(avg((hour(ts) < 12)::INT) FILTER (WHERE event_type <> 'view'), 6) AS share_when_not_said, count(*) FILTER (WHERE event_type = 'view') AS n_said FROM events""",
)
def measurement_agreement(t):
    from kerbline.operators.temporal import agreement

    return rounded(agreement(t.events, F.col("event_type") == "view", values.flag(F.hour("ts") < 12)), 6)


@query(
    "delay_profile",
    """WITH d AS (SELECT o_orderpriority, o_orderstatus, (epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 864e8 AS d FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(quantile_cont(d, 5e-1), 4) AS median, round(avg((d > 365)::INT), 6) AS share_over FROM d WHERE d BETWEEN 0 AND 1500 GROUP BY 1, 2""",
)
def delay_profile(t):
    from kerbline.operators.temporal import micros

    o = t.orders.select("o_orderkey", "o_orderdate", "o_orderpriority", "o_orderstatus")
    j = t.lineitem.select("l_orderkey", "l_shipdate").join(o, F.col("o_orderkey") == F.col("l_orderkey"))
    days = (micros(F.col("l_shipdate")) - micros(F.col("o_orderdate"))) / 8.64e10
    out = agg.delay_profile(j, days, ["o_orderpriority", "o_orderstatus"], 0, 1500, 365)
    return out.withColumns({"median": F.round("median", 4), "share_over": F.round("share_over", 6)})


@query(
    "monthly_counts",
    "SELECT o_orderstatus, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, count(*) FILTER (WHERE o_totalprice > 300000) AS large FROM orders GROUP BY 1, 2",
)
def monthly_counts(t):
    return agg.monthly_counts(t.orders, "o_orderdate", ["o_orderstatus"], {"n": F.lit(True), "large": F.col("o_totalprice") > 300000})


@query(
    "reporting_drift",
    """WITH m AS (SELECT n_regionkey, year(o_orderdate) AS y, strftime(o_orderdate, '%Y-%m') AS mo, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2, 3)
SELECT n_regionkey, round(avg(n) FILTER (WHERE y = 1996), 6) AS first_mean, round(avg(n) FILTER (WHERE y = 1998), 6) AS last_mean, round(avg(n) FILTER (WHERE y = 1998) / avg(n) FILTER (WHERE y = 1996), 6) AS growth FROM m GROUP BY 1""",
)
def reporting_drift(t):
    j = (
        t.orders.select("o_custkey", "o_orderdate")
        .join(t.customer.select("c_custkey", "c_nationkey"), F.col("c_custkey") == F.col("o_custkey"))
        .join(t.nation.select("n_nationkey", "n_regionkey"), F.col("n_nationkey") == F.col("c_nationkey"))
    )
    return rounded(agg.period_growth(j, "o_orderdate", "n_regionkey", 1996, 1998), 6)


@query(
    "occupancy_snapshots",
    """WITH s AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS instant, user_id, value > 10 AS occupied FROM events)
SELECT instant, count(*) FILTER (WHERE occupied) AS occupied, (count(*) FILTER (WHERE occupied) * 10)::BIGINT AS load_minutes, count(DISTINCT user_id) FILTER (WHERE occupied) AS tokens FROM s GROUP BY 1""",
)
def occupancy_snapshots(t):
    s = t.events.select(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("instant"), "user_id", (F.col("value") > 10).alias("occ"))
    return s.groupBy("instant").agg(
        F.count_if("occ").alias("occupied"),
        (F.count_if("occ") * 10).alias("load_minutes"),
        F.countDistinct(F.when(F.col("occ"), F.col("user_id"))).alias("tokens"),
    )


@query(
    "frequent_groups",
    "SELECT event_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY 1 HAVING count(*) >= 65)",
)
def frequent_groups(t):
    return rel.frequent_groups(t.events.select("event_id", "user_id"), ["user_id"], 65)


@query(
    "repeated_keys",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS times FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1",
)
def repeated_keys(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return rel.occurrences(rows, ["l_orderkey", "l_linenumber"]).filter(F.col("times") > 1)


@query(
    "member_flags",
    """SELECT o_orderkey, (o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'))::INT AS has_return, (o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49))::INT AS has_bulk FROM orders""",
)
def member_flags(t):
    li = t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey")
    groups = {"has_return": li.filter(F.col("l_returnflag") == "R"), "has_bulk": li.filter(F.col("l_quantity") >= 49)}
    return rel.member_flags(t.orders.select("o_orderkey"), "o_orderkey", groups)


@query(
    "checked_lookup",
    "SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey",
)
def checked_lookup(t):
    """Chain of left joins that fail when a lookup key repeats."""
    c = t.customer.select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    n = rel.checked_lookup(c, t.nation, ["n_nationkey"]).withColumnRenamed("n_regionkey", "r_regionkey")
    return rel.checked_lookup(n, t.region, ["r_regionkey"]).select("c_custkey", "n_name", "r_name")


@query(
    "link_rate",
    """WITH j AS (SELECT a.l_orderkey, b.o_orderkey FROM lineitem a LEFT JOIN (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_totalprice > 100000) b ON o_orderkey = l_orderkey AND o_orderstatus = l_linestatus)
SELECT count(*) AS rows, count(o_orderkey) AS linked, round(count(o_orderkey) / count(*), 6) AS link_rate FROM j""",
)
def link_rate(t):
    """Composite-key link with its success rate."""
    left = t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_linestatus").alias("s"))
    right = t.orders.filter(F.col("o_totalprice") > 100000).select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), "o_custkey")
    return rounded(rel.link_with_rate(left, right, ["k", "s"], "o_custkey")[1], 6)


@query(
    "union_roles",
    "SELECT 'customer' AS role, c_nationkey AS nation, count(*) AS n FROM customer GROUP BY 2 UNION ALL SELECT 'supplier', s_nationkey, count(*) FROM supplier GROUP BY 2",
)
def union_roles(t):
    tables = {
        "customer": t.customer.select(F.col("c_nationkey").alias("nation")),
        "supplier": t.supplier.select(F.col("s_nationkey").alias("nation")),
    }
    return rel.union_tagged(tables, "role").groupBy("role", "nation").agg(F.count(F.lit(1)).alias("n"))


@query(
    "first_per_key",
    "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1",
)
def first_per_key(t):
    rows = t.orders.select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return rel.first_per_key(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query(
    "top_per_group",
    "SELECT p_brand, p_partkey, p_retailprice, row_number() OVER w AS rank_in_group FROM part QUALIFY row_number() OVER w <= 8 WINDOW w AS (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey)".replace(
        "QUALIFY row_number() OVER w <= 8 WINDOW w AS (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey)",
        "WINDOW w AS (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) QUALIFY rank_in_group <= 8",
    ),
)
def top_per_group(t):
    rows = t.part.select("p_brand", "p_partkey", "p_retailprice")
    out = rel.top_n_per_group(rows, ["p_brand"], [F.col("p_retailprice").desc(), F.col("p_partkey")], 8)
    return out.withColumn("rank_in_group", F.col("rank_in_group").cast("long"))


@query(
    "month_intersection",
    "SELECT strftime(o_orderdate, '%Y-%m') AS month FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT strftime(l_shipdate, '%Y-%m') FROM lineitem",
)
def month_intersection(t):
    a = t.orders.filter(F.col("o_orderstatus") == "F").select(values.year_month(F.col("o_orderdate")).alias("month"))
    return a.distinct().intersect(t.lineitem.select(values.year_month(F.col("l_shipdate")).alias("month")).distinct())


@query(
    "remaining_work",
    "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity > 40)",
)
def remaining_work(t):
    """Units of a plan that are not in the done list."""
    done = t.lineitem.filter((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 40)).select(F.col("l_partkey").alias("p_partkey"))
    return t.part.select("p_partkey").join(done, "p_partkey", "left_anti")


@query(
    "completion_status",
    """WITH u AS (SELECT p_brand, p_partkey, p_size, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_shipdate < TIMESTAMP '2002-06-01') AS done FROM part),
g AS (SELECT p_brand, sum(p_size) AS weight, bool_and(done) AS complete FROM u GROUP BY 1)
SELECT round((SELECT avg(done::INT) FROM u), 6) AS units_done_share, round(coalesce(sum(weight) FILTER (WHERE complete), 0) / sum(weight), 6) AS weight_complete_share, count(*) FILTER (WHERE complete) AS groups_complete FROM g""",
)
def completion_status(t):
    from kerbline.sources.store import completion

    done = t.lineitem.filter((F.col("l_returnflag") == "R") & (F.col("l_shipdate") < F.lit("2002-06-01").cast("timestamp_ntz")))
    return rounded(completion(t.part, done.select(F.col("l_partkey").alias("p_partkey")), ["p_partkey"], "p_brand", "p_size"), 6)


@query(
    "sorted_rows",
    "SELECT o_orderkey, o_custkey, o_orderdate FROM orders",
)
def sorted_rows(t):
    return t.orders.select("o_orderkey", "o_custkey", "o_orderdate").orderBy("o_custkey", "o_orderdate", "o_orderkey")


@query(
    "best_of_each",
    "SELECT p_type, arg_max(p_partkey, (p_size, -p_partkey)) AS largest, arg_min(p_partkey, (p_size, p_partkey)) AS smallest FROM part GROUP BY 1",
)
def best_of_each(t):
    k = F.col("p_partkey")
    return t.part.groupBy("p_type").agg(
        F.max_by(k, F.struct("p_size", -k)).alias("largest"), F.min_by(k, F.struct("p_size", k)).alias("smallest")
    )


@query(
    "scalar_rules",
    """SELECT p_partkey, least(greatest(p_size, 5), 40) AS clipped, p_retailprice / nullif(p_size - 25, 0) AS ratio, CASE WHEN p_size BETWEEN 0 AND 30 THEN p_size END AS plausible,
 CASE WHEN p_size <= 0 THEN NULL WHEN p_size <= 10 THEN 'small' WHEN p_size <= 30 THEN 'medium' WHEN p_size <= 50 THEN 'large' END AS size_band,
 CASE WHEN p_type = 'SMALL' THEN 1 WHEN p_type = 'LARGE' THEN 3 ELSE 0 END AS mapped, (p_name LIKE '%ring%')::INT AS has_ring, regexp_replace(p_type, 'Y$', '') AS stripped,
 substr(sha256(p_name), 1, 12) AS name_hash, round_even(p_retailprice * 4, 0) / 4 AS snapped, (p_size * (p_type = 'SMALL')::INT) AS interaction FROM part""",
)
def scalar_rules(t):
    """Clips, ratios, bands, maps, flags, hashes and interactions on one table."""
    size, kind = F.col("p_size"), F.col("p_type")
    return t.part.select(
        "p_partkey",
        values.clip(size, 5, 40).alias("clipped"),
        values.ratio(F.col("p_retailprice"), size - 25).alias("ratio"),
        values.plausible(size, 0, 30).alias("plausible"),
        values.band(size, [0, 10, 30, 50], ["small", "medium", "large"]).alias("size_band"),
        values.mapped(kind, {"SMALL": 1, "LARGE": 3}, 0).alias("mapped"),
        values.flag(F.col("p_name").contains("ring")).alias("has_ring"),
        F.regexp_replace(kind, "Y$", "").alias("stripped"),
        tx.sha_prefix(F.col("p_name"), 256, 12).alias("name_hash"),
        values.snap(F.col("p_retailprice"), 4).alias("snapped"),
        (size * values.flag(kind == "SMALL")).alias("interaction"),
    )


@query(
    "median_fill",
    """WITH j AS (SELECT doc_id, quality, toxic FROM documents LEFT JOIN labels USING (doc_id))
SELECT doc_id, coalesce(quality, (SELECT quantile_cont(quality, 5e-1) FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)))::DOUBLE AS quality, coalesce(toxic::VARCHAR, 'unknown') AS toxic FROM j""",
)
def median_fill(t):
    j = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    filled = values.fill_median(j.withColumn("quality", F.col("quality").cast("double")), ["quality"])
    return filled.withColumn("toxic", F.coalesce(F.col("toxic").cast("string"), F.lit("unknown")))


@query(
    "delay_hours",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, round_even((epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 36e8, 2) AS delay_hours FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
)
def delay_hours(t):
    o = t.orders.select("o_orderkey", "o_orderdate")
    j = t.lineitem.join(o, F.col("o_orderkey") == F.col("l_orderkey"))
    return j.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice",
        values.hours_between(F.col("o_orderdate"), F.col("l_shipdate")).alias("delay_hours"),
    )


