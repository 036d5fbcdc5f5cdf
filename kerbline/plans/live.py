"""Record rules, selection by cross products, and streams that keep accounts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbline.functions import geometry
from kerbline.operators import record_rules as rules
from kerbline.operators import relational as rel
from kerbline.operators import selection as sel
from kerbline.operators import subsets
from kerbline.plans.models import model_rows
from kerbline.plans.registry import query
from kerbline.plans.risk import SEG, rounded
from kerbline.sources import store
from kerbline.streaming import traffic

ASKED = ["click", "view", "click :: purchase", "view :: purchase"]


@query(
    "record_rules",
    """WITH RECURSIVE e AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 0 ELSE user_id END AS report, event_type FROM events),
f AS (SELECT *, last_value(CASE WHEN event_type NOT IN ('purchase', 'error') THEN event_type END IGNORE NULLS) OVER (PARTITION BY report ORDER BY event_id) AS asked FROM e),
g AS (SELECT report, event_id, event_type = 'error' AS heading, CASE WHEN event_type = 'purchase' THEN coalesce(asked || ' :: purchase', 'purchase') ELSE event_type END AS label, row_number() OVER (PARTITION BY report ORDER BY event_id) AS i FROM f),
h AS (SELECT *, label IN ('click', 'view', 'click :: purchase', 'view :: purchase') AS known FROM g),
r AS (SELECT DISTINCT report, 0::BIGINT AS i, NULL::VARCHAR[] AS seen, 0::BIGINT AS record_no FROM h
 UNION ALL SELECT h.report, h.i, CASE WHEN heading THEN NULL WHEN seen IS NULL OR (known AND list_contains(seen, label)) THEN (CASE WHEN known THEN [label] ELSE []::VARCHAR[] END) WHEN known THEN list_append(seen, label) ELSE seen END,
  record_no + (NOT heading AND (seen IS NULL OR (known AND list_contains(seen, label))))::BIGINT FROM r JOIN h ON h.report = r.report AND h.i = r.i + 1)
SELECT h.report, h.event_id, h.label, r.record_no FROM r JOIN h ON h.report = r.report AND h.i = r.i WHERE NOT heading""",
)
def record_rules(t):
    """Records start after headings and where a known label would repeat; a repeated question is named by the one before."""
    e = t.events.select("event_id", F.when(F.col("event_id") % 10 == 0, 0).otherwise(F.col("user_id")).cast("long").alias("report"), "event_type")
    e = e.withColumn("label", F.when(F.col("event_type") != "error", F.col("event_type")))
    named = rules.rename_follow_ups(e, "report", ["event_id"], "label", F.col("event_type") == "purchase", "purchase")
    return rules.cut_records(named, "report", ["event_id"], "label", F.col("event_type") == "error", ASKED).select("report", "event_id", "label", "record_no")


GROUPS = {"shape": ["size_z", "price_k"], "kind": ["ring"], "length": ["offset"]}
STEPS = f"""{SEG}, m AS (SELECT id, past::DOUBLE AS y, id % 5 AS fold, (p_size - 25.5) / 14.4 AS a, p_retailprice / 1000.0 AS b, (p_name LIKE '%ring%')::INT::DOUBLE AS c, ln(greatest(length_m / 1000.0, 1e-2)) AS d FROM seg JOIN part ON p_partkey = id),
k AS (SELECT DISTINCT fold AS k FROM m)"""
FITS = """f AS (SELECT k, l2, avg(y) AS y0, avg(a) AS a0, avg(b) AS b0, avg(c) AS c0, avg(d) AS d0, covar_pop(a, y) / (var_pop(a) + l2) AS ba, covar_pop(b, y) / (var_pop(b) + l2) AS bb, covar_pop(c, y) / (var_pop(c) + l2) AS bc, covar_pop(d, y) / (var_pop(d) + l2) AS bd
 FROM m JOIN k ON fold <> k, p GROUP BY 1, 2)"""


@query(
    "ablation_log",
    f"""WITH {STEPS}, p AS (SELECT 0.0 AS l2), {FITS},
x(step, experiment, n_features, wa, wb, wc, wd) AS (VALUES ('all', 'all features', 4, 1, 1, 1, 1), ('drop one group', 'without shape', 2, 0, 0, 1, 1), ('only one group', 'only shape', 2, 1, 1, 0, 0),
 ('drop one group', 'without kind', 3, 1, 1, 0, 1), ('only one group', 'only kind', 1, 0, 0, 1, 0), ('drop one group', 'without length', 3, 1, 1, 1, 0), ('only one group', 'only length', 1, 0, 0, 0, 1))
SELECT step, experiment, n_features, round(-avg((y - y0 - wa * ba * (a - a0) - wb * bb * (b - b0) - wc * bc * (c - c0) - wd * bd * (d - d0)) ** 2), 6) AS score FROM m JOIN f ON k = fold, x GROUP BY 1, 2, 3""",
)
def ablation_log(t):
    """What each source of features carries: one pass for all sets and folds, one step per feature."""
    g = subsets.gram(model_rows(t), [f for m in GROUPS.values() for f in m], ["past"], "fold")
    return rounded(sel.experiment_log(t.spark, subsets.ablation(g, GROUPS, "past", one_step=True)), 6)


PENALTIES = [1.0, 0.0, 0.1, 0.5, 4.0, 100.0]


@query(
    "raced_search",
    f"""WITH RECURSIVE {STEPS}, p(i, l2) AS (VALUES (0, 1.0), (1, 0.0), (2, 0.1), (3, 0.5), (4, 4.0), (5, 100.0)), {FITS},
s AS (SELECT i, f.l2, fold, sum((y - y0 - ba * (a - a0) - bb * (b - b0) - bc * (c - c0) - bd * (d - d0)) ** 2) AS e FROM m JOIN f ON k = fold JOIN p ON p.l2 = f.l2 GROUP BY 1, 2, 3),
l AS (SELECT i, l2, list(e ORDER BY fold) AS es FROM s GROUP BY 1, 2), n AS (SELECT 1e-3 * count(*) AS thr FROM m),
r AS (SELECT i, l2, 5 AS used, list_sum(es) AS error, true AS won, list_sum(es) AS best FROM l WHERE i = 0
 UNION ALL SELECT l.i, l.l2, u.used, list_sum(es[1:u.used]), list_sum(es) < best - thr, CASE WHEN list_sum(es) < best - thr THEN list_sum(es) ELSE best END
 FROM r JOIN l ON l.i = r.i + 1, n, LATERAL (SELECT coalesce(list_filter([1, 2, 3, 4, 5], lambda j: list_sum(es[1:j]) >= best - thr)[1], 5) AS used) u)
SELECT i AS setting, l2::DOUBLE AS penalty, used AS folds_used, round(error, 4) AS error, won FROM r""",
)
def raced_search(t):
    """Penalties raced over folds: a setting leaves once it can't beat the best so far by the margin."""
    g = subsets.gram(model_rows(t), [f for m in GROUPS.values() for f in m], ["past"], "fold")
    _, log = subsets.raced_search(g, g.features, "past", PENALTIES, margin=0.001, one_step=True)
    rows = [(r["setting"], r["penalty"], r["folds_used"], round(r["error"], 4), r["won"]) for r in log]
    return t.spark.createDataFrame(rows, "setting int, penalty double, folds_used int, error double, won boolean")


def in_files(t, name: str, files: int):
    """Events as a stream of several files, of which a batch reads one."""
    path = f"{traffic.work_folder(t.spark, name)}/in"
    t.events.repartition(files, "event_id").write.parquet(path)
    return traffic.file_stream(t.spark, path, max_files=1)


@query(
    "stream_outages",
    """WITH e AS (SELECT DISTINCT user_id AS source, ts FROM events WHERE user_id % 7 <> 3 OR ts < TIMESTAMP '2024-01-10'), g AS (SELECT source, ts, lead(ts) OVER (PARTITION BY source ORDER BY ts) AS resumed_at, max(ts) OVER () AS now FROM e)
SELECT source, ts AS gap_starts_after, resumed_at, round((epoch_us(coalesce(resumed_at, now)) - epoch_us(ts)) / 60e6)::BIGINT AS gap_minutes FROM g WHERE epoch_us(coalesce(resumed_at, now)) - epoch_us(ts) > 86400e6""",
)
def stream_outages(t):
    """Silences of over a day, closed and still open, from a stream whose files come in no order of time."""
    read = in_files(t, "silent", 4).filter((F.col("user_id") % 7 != 3) | (F.col("ts") < F.lit("2024-01-10").cast("timestamp_ntz")))
    return traffic.run_outages(read.withColumnRenamed("user_id", "source"), "source", "ts", 86400)


@query(
    "stream_accounting",
    "SELECT 4::BIGINT AS batches, count(*) AS rows, count(*) AS stored, count(*) FILTER (WHERE event_type <> 'error') AS ok, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events",
)
def stream_accounting(t):
    """The manifest that batches write while they are stored, against the rows that are there."""
    counts = {"ok": F.count_if(F.col("event_type") != "error"), "errors": F.count_if(F.col("event_type") == "error")}
    stored, manifest = traffic.run_accounted(in_files(t, "accounts", 4), counts)
    return manifest.agg(
        F.countDistinct("batch").alias("batches"), F.sum("rows").alias("rows"), stored.agg(F.count(F.lit(1))).scalar().alias("stored"), F.sum("ok").alias("ok"), F.sum("errors").alias("errors")
    )


@query("stream_seen_once", "SELECT props, true AS in_events FROM events GROUP BY 1")
def stream_seen_once(t):
    """Each piece stored once, whatever batch brings it, in a dimension of hash buckets."""
    seen = traffic.run_seen_once(in_files(t, "pieces", 3), "props", 16)
    return seen.join(t.events.select("event_id", F.lit(True).alias("in_events")), "event_id", "left").select("props", F.coalesce("in_events", F.lit(False)).alias("in_events"))


@query(
    "binary_lines",
    """WITH p AS (SELECT o_custkey AS id, o_orderkey, o_totalprice / 7 AS x, -(o_orderkey * 37 % 1000) / 8.0 AS y FROM orders)
SELECT id, count(*) AS points, round(sum(x), 6) AS sum_x, round(sum(y), 6) AS sum_y, round(max(x), 9) AS max_x FROM p WHERE id % 3 <> 0 GROUP BY 1""",
)
def binary_lines(t):
    """Lines written as binary geometry in both byte orders and decoded again."""
    o = t.orders.filter(F.col("o_custkey") % 3 != 0).select("o_custkey", "o_orderkey", F.struct((F.col("o_totalprice") / 7).alias("x"), (-(F.col("o_orderkey") * 37 % 1000) / 8.0).alias("y")).alias("p"))
    lines = o.groupBy(F.col("o_custkey").alias("id")).agg(F.collect_list("p").alias("pts"))  # the orders of one customer
    wkb = F.when(F.col("id") % 2 == 0, geometry.to_wkb_line(F.col("pts"))).otherwise(geometry.to_wkb_line(F.col("pts"), little=False))
    points = lines.select("id", wkb.alias("wkb")).select("id", F.inline(geometry.parse_wkb_line(F.col("wkb"))))
    got = points.groupBy("id").agg(F.count(F.lit(1)).alias("points"), F.sum("x").alias("sum_x"), F.sum("y").alias("sum_y"), F.max("x").alias("max_x"))
    return got.select("id", "points", F.round("sum_x", 6).alias("sum_x"), F.round("sum_y", 6).alias("sum_y"), F.round("max_x", 9).alias("max_x"))


RANKED = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


@query(
    "target_ranks",
    "WITH f AS (SELECT l_extendedprice AS y, unnest(['l_quantity', 'l_discount', 'l_tax', 'l_linenumber']) AS feature, unnest([l_quantity::DOUBLE, l_discount::DOUBLE, l_tax::DOUBLE, CASE WHEN l_linenumber > 1 THEN l_linenumber::DOUBLE END]) AS x FROM lineitem), "
    "g AS (SELECT * FROM f WHERE x IS NOT NULL), r AS (SELECT feature, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY feature ORDER BY y) + (count(*) OVER (PARTITION BY feature, y) - 1) / 2.0 AS ry FROM g) "
    "SELECT feature, round(corr(rx, ry), 6) AS rho, count(*) AS n FROM r GROUP BY 1",
)
def target_ranks(t):
    """Rank correlation of each feature with the price, with ties and missing values."""
    items = t.lineitem.withColumn("l_linenumber", F.when(F.col("l_linenumber") > 1, F.col("l_linenumber")))
    return rounded(sel.target_rank_correlation(items, RANKED, "l_extendedprice"), 6)


@query(
    "exact_sample",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY substr(md5('7-' || o_orderkey), 1, 16), o_orderkey LIMIT 1000",
)
def exact_sample(t):
    """Exactly 1000 random orders, by the threshold of the thousandth digest."""
    return rel.sample_rows(t.orders, "o_orderkey", 1000, 7).select("o_orderkey", "o_totalprice")


HOURS = [f"h{h:02d}" for h in range(24)]


@query(
    "tile_hour_wide",
    "SELECT user_id AS tile, " + ", ".join(f"round(avg(value) FILTER (WHERE hour(ts) = {h}), 6) AS {n}" for h, n in enumerate(HOURS)) + " FROM events GROUP BY 1",
)
def tile_hour_wide(t):
    """One row per tile and one column per hour of the day; hours without a reading are NULL."""
    long = t.events.select(F.col("user_id").alias("tile"), F.hour("ts").alias("hour"), "value")
    wide = rel.wide_matrix(long, "tile", "hour", "value", list(range(24)), HOURS, block=10)
    return wide.select("tile", *[F.round(h, 6).alias(h) for h in HOURS])


@query(
    "log_with_rejects",
    "SELECT count(*) AS lines, count(*) FILTER (WHERE event_id % 7 <> 0) AS kept, count(*) FILTER (WHERE event_id % 7 = 0) AS rejected, sum(event_id) FILTER (WHERE event_id % 7 <> 0)::BIGINT AS id_sum FROM events",
)
def log_with_rejects(t):
    """A JSON log in which every seventh line is cut off: what parses, and what doesn't."""
    line = F.to_json(F.struct("event_id", "event_type", "value"))
    path = f"{traffic.work_folder(t.spark, 'log')}/in"
    t.events.select(F.when(F.col("event_id") % 7 == 0, F.substring(line, 1, 12)).otherwise(line).alias("value")).write.text(path)
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType())])
    kept, rejected = store.read_log_with_rejects(t.spark, path, schema)
    return kept.agg((F.count(F.lit(1)) + rejected.agg(F.count(F.lit(1))).scalar()).alias("lines"), F.count(F.lit(1)).alias("kept"), rejected.agg(F.count(F.lit(1))).scalar().alias("rejected"), F.sum("event_id").alias("id_sum"))


@query(
    "component_loadings",
    """WITH m AS (SELECT CASE WHEN corr(l_quantity, l_extendedprice) < 0 THEN -1 ELSE 1 END AS s, abs(corr(l_quantity, l_extendedprice)) AS r FROM lineitem)
SELECT c AS feature, k AS component, round(CASE WHEN k = 1 THEN (CASE WHEN c = 'l_quantity' THEN 1 ELSE s END) ELSE (CASE WHEN c = 'l_quantity' THEN 1 ELSE -s END) END * sqrt(0.5), 6) AS loading, round((1 + (CASE WHEN k = 1 THEN r ELSE -r END)) / 2, 6) AS share
FROM m, (VALUES ('l_quantity'), ('l_extendedprice')) f(c), (VALUES (1), (2)) g(k)""",
)
def component_loadings(t):
    """Two standardised columns: the components are their sum and their difference, signs fixed."""
    got = subsets.components(t.lineitem, ["l_quantity", "l_extendedprice"])
    return rounded(t.spark.createDataFrame(got.rows(), "feature string, component int, loading double, share double"), 6)
