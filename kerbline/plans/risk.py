"""Ranking queries. Segment = part, length = 100 + key·37 % 400 m, events = line items before/after 1998."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbline.operators import aggregates as agg
from kerbline.operators import ranking as rank
from kerbline.operators import relational as rel
from kerbline.operators.features import regional_rate
from kerbline.plans.registry import query

SPLIT = "1998-01-01"

SEG = """
seg AS (
  SELECT p_partkey AS id, p_brand, p_type, 100 + p_partkey * 37 % 400 AS length_m,
         coalesce(past, 0) AS past, coalesce(future, 0) AS future,
         coalesce(past_all, 0) AS past_all, coalesce(past_heavy, 0) AS past_heavy, coalesce(future_heavy, 0) AS future_heavy
  FROM part LEFT JOIN (
    SELECT l_partkey,
           count(*) FILTER (WHERE l_shipdate < TIMESTAMP '1998-01-01' AND l_returnflag <> 'N') AS past,
           count(*) FILTER (WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_returnflag <> 'N') AS future,
           count(*) FILTER (WHERE l_shipdate < TIMESTAMP '1998-01-01') AS past_all,
           count(*) FILTER (WHERE l_shipdate < TIMESTAMP '1998-01-01' AND l_quantity > 45) AS past_heavy,
           count(*) FILTER (WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_quantity > 45) AS future_heavy
    FROM lineitem GROUP BY l_partkey) e ON l_partkey = p_partkey
)"""
CURVE = (
    SEG
    + """,
scored AS (SELECT *, past + 1e-2 * past_all AS score FROM seg),
cum AS (
  SELECT *, sum(length_m) OVER w / (SELECT sum(length_m) FROM seg)::DOUBLE AS b,
            (sum(length_m) OVER w - length_m) / (SELECT sum(length_m) FROM seg)::DOUBLE AS a,
            sum(future) OVER w / (SELECT sum(future) FROM seg)::DOUBLE AS d,
            (sum(future) OVER w - future) / (SELECT sum(future) FROM seg)::DOUBLE AS c
  FROM scored
  WINDOW w AS (ORDER BY score + 1e-9 * length_m DESC, id ROWS UNBOUNDED PRECEDING)
)"""
)


def segments(t):
    """Per part: length and event counts by period, in one conditional aggregate."""
    before = F.col("l_shipdate") < F.lit(SPLIT).cast("timestamp_ntz")
    serious = F.col("l_returnflag") != "N"
    heavy = F.col("l_quantity") > 45
    counts = agg.period_counts(
        t.lineitem,
        "l_partkey",
        {
            "past": before & serious,
            "future": ~before & serious,
            "past_all": before,
            "past_heavy": before & heavy,
            "future_heavy": ~before & heavy,
        },
    )
    parts = t.part.select(
        F.col("p_partkey").alias("id"), "p_brand", "p_type", (100 + F.col("p_partkey") * 37 % 400).alias("length_m")
    )
    return agg.with_zero_counts(parts, counts.withColumnRenamed("l_partkey", "id"), "id")


def scored(t):
    return segments(t).withColumn("score", F.col("past") + 0.01 * F.col("past_all"))


def rounded(df, digits=4, skip=()):
    return df.select(
        *[F.round(c, digits).alias(c) if dtype == "double" and c not in skip else F.col(c) for c, dtype in df.dtypes]
    )


@query(
    "capture_curve",
    f"""WITH {CURVE},
pts AS (
  SELECT k, max(CASE WHEN a <= 0 THEN d ELSE c + (k / 1000.0::DOUBLE - a) / (b - a) * (d - c) END) AS cap
  FROM (SELECT unnest(range(1, 201)) AS k) g JOIN cum ON a < k / 1000.0::DOUBLE AND k / 1000.0::DOUBLE <= b GROUP BY k)
SELECT round(max(cap) FILTER (WHERE k = 10), 4) AS cap1, round(max(cap) FILTER (WHERE k = 50), 4) AS cap5,
       round(max(cap) FILTER (WHERE k = 100), 4) AS cap10, round(max(cap) FILTER (WHERE k = 200), 4) AS cap20,
       round(sum(cap) / 200, 4) AS area20 FROM pts""",
)
def capture_curve(t):
    return rounded(rank.capture(rank.risk_curve(scored(t), "score", "length_m", "future", "id")))


@query(
    "capture_steps",
    f"""WITH {CURVE}
SELECT round(sum(future) FILTER (WHERE b <= 1e-2) / sum(future), 4) AS cap1,
       round(sum(future) FILTER (WHERE b <= 5e-2) / sum(future), 4) AS cap5,
       round(sum(future) FILTER (WHERE b <= 1e-1) / sum(future), 4) AS cap10,
       round(sum(future) FILTER (WHERE b <= 2e-1) / sum(future), 4) AS cap20,
       count(*) FILTER (WHERE b <= 5e-2 AND future >= 5 AND past < 5) AS hotspots_in_top5,
       count(*) FILTER (WHERE future >= 5 AND past < 5) AS hotspots_total FROM cum""",
)
def capture_steps(t):
    fresh = ((F.col("future") >= 5) & (F.col("past") < 5)).cast("int")
    curve = rank.risk_curve(scored(t).withColumn("fresh", fresh), "score", "length_m", "future", "id")
    return rounded(rank.capture_steps(curve, "future", "fresh"))


RATE = """
rated AS (SELECT *, past * 1000.0::DOUBLE / length_m AS rate FROM seg),
acc AS (SELECT *, sum(length_m) OVER (ORDER BY rate DESC, id ROWS UNBOUNDED PRECEDING) / (SELECT sum(length_m) FROM seg)::DOUBLE AS s FROM rated),
cuts AS (SELECT max(rate) FILTER (WHERE s >= 1e-2) AS cut3, max(rate) FILTER (WHERE s >= 5e-2) AS cut2,
                max(rate) FILTER (WHERE s >= 2e-1) AS cut1 FROM acc)"""


def rated(t):
    return segments(t).withColumn("rate", F.col("past") * 1000.0 / F.col("length_m"))


@query("weighted_cutoffs", f"WITH {SEG}, {RATE} SELECT round(cut1, 4) AS cut1, round(cut2, 4) AS cut2, round(cut3, 4) AS cut3 FROM cuts")
def weighted_cutoffs(t):
    return rounded(rank.cutoffs(rated(t), "rate", "length_m", "id"))


BAND = "CASE WHEN {0} >= cut3 THEN 3 WHEN {0} >= cut2 THEN 2 WHEN {0} >= cut1 THEN 1 ELSE 0 END"


@query(
    "weighted_bands",
    f"WITH {SEG}, {RATE} SELECT id, round(rate, 4) AS rate, {BAND.format('rate')} AS band FROM rated, cuts",
)
def weighted_bands(t):
    r = rated(t)
    cuts = rank.cutoffs(r, "rate", "length_m", "id")
    return rounded(rank.with_bands(r, cuts, {"band": F.col("rate")}).select("id", "rate", "band"))


@query(
    "band_validation",
    f"""WITH {SEG}, {RATE}, b AS (
  SELECT {BAND.format('rate')} AS band, sum(length_m) / 1000.0::DOUBLE AS road_km, sum(future)::BIGINT AS target,
         count(*) FILTER (WHERE future >= 5 AND past < 5) AS new_hotspots FROM rated, cuts GROUP BY 1)
SELECT band, round(road_km, 4) AS road_km, target, new_hotspots, round(road_km / (SELECT sum(road_km) FROM b), 4) AS share_km,
       round(target / (SELECT sum(target) FROM b), 4) AS share_target, round(100 * target / road_km, 4) AS rate_per_100km FROM b""",
)
def band_validation(t):
    r = rated(t).withColumn("fresh", ((F.col("future") >= 5) & (F.col("past") < 5)).cast("int"))
    cuts = rank.cutoffs(r, "rate", "length_m", "id")
    return rounded(rank.band_validation(rank.with_bands(r, cuts, {"band": F.col("rate")}), "band", "length_m", "future", "fresh"))


SIGNAL = f"""{SEG}, {RATE},
mult AS (SELECT p_type, 1 + count(*) % 7 / 20.0::DOUBLE AS m_dark FROM part WHERE p_type <> 'SMALL' GROUP BY p_type),
sig AS (SELECT r.*, coalesce(m_dark, (SELECT avg(m_dark) FROM mult)) AS dark FROM rated r LEFT JOIN mult USING (p_type)),
banded AS (SELECT *, {BAND.format('rate')} AS static_band, {BAND.format('rate * (1 + (dark - 1) / 2)')} AS twilight_band,
  {BAND.format('rate * dark')} AS dark_band, {BAND.format('rate * 11e-1')} AS rain_band,
  (CASE WHEN past_all + past_heavy + future_heavy >= 3 THEN 1 ELSE 0 END) AS ped_flag,
  CASE WHEN past + future > 0 AND p_brand < 'Brand#2' THEN 'high' WHEN past + future > 0 OR p_brand < 'Brand#2' THEN 'medium' ELSE 'low' END AS confidence
  FROM sig, cuts)"""


def signal(t):
    """Risk under daylight, twilight, dark and rain; a class without a multiplier takes the mean one."""
    mult = t.part.filter(F.col("p_type") != "SMALL").groupBy("p_type").agg((1 + F.count(F.lit(1)) % 7 / 20.0).alias("dark"))
    r = rel.lookup_or_mean(rated(t), mult, "p_type", ["dark"]).withColumn("twilight", 1 + (F.col("dark") - 1) / 2)
    return rank.signal_table(
        r, "rate", "length_m", "id", "twilight", "dark", 1.1, ["past_all", "past_heavy", "future_heavy"],
        F.col("past") + F.col("future") > 0, F.col("p_brand") < "Brand#2",
    )


@query(
    "signal_table",
    f"WITH {SIGNAL} SELECT id, round(dark, 4) AS dark, static_band, twilight_band, dark_band, rain_band, ped_flag, confidence FROM banded",
)
def signal_table(t):
    cols = ["id", "dark", "static_band", "twilight_band", "dark_band", "rain_band", "ped_flag", "confidence"]
    return rounded(signal(t).select(*cols))


@query(
    "alert_load",
    f"""WITH {SIGNAL}, long AS (
  SELECT length_m, 'daylight' AS condition, static_band AS band FROM banded UNION ALL SELECT length_m, 'twilight', twilight_band FROM banded
  UNION ALL SELECT length_m, 'dark', dark_band FROM banded UNION ALL SELECT length_m, 'rain', rain_band FROM banded)
SELECT condition, round(sum(CASE WHEN band >= 2 THEN length_m ELSE 0 END) / 1000.0::DOUBLE, 4) AS band2plus_km,
       round(sum(CASE WHEN band >= 2 THEN length_m ELSE 0 END) / sum(length_m), 4) AS band2plus_share,
       round(sum(CASE WHEN band = 3 THEN length_m ELSE 0 END) / 1000.0::DOUBLE, 4) AS band3_km FROM long GROUP BY condition""",
)
def alert_load(t):
    bands = {"daylight": "static_band", "twilight": "twilight_band", "dark": "dark_band", "rain": "rain_band"}
    return rounded(rank.alert_load(signal(t), "length_m", bands))


@query("period_pivot", f"WITH {SEG} SELECT id, past, future, past_all, past_heavy, future_heavy FROM seg")
def period_pivot(t):
    return segments(t).select("id", "past", "future", "past_all", "past_heavy", "future_heavy")


@query(
    "hotspot_labels",
    f"""WITH {SEG}, h AS (SELECT id, (past >= 9 OR past_heavy >= 3)::INT AS hotspot_past, (future >= 9 OR future_heavy >= 3)::INT AS hotspot_future FROM seg)
SELECT *, (hotspot_future = 1 AND hotspot_past = 0)::INT AS hotspot_new FROM h""",
)
def hotspot_labels(t):
    h = segments(t).select(
        "id", rank.hotspot_flags("past", "past_heavy", "past", 9, 3), rank.hotspot_flags("future", "future_heavy", "future", 9, 3)
    )
    return h.withColumn("hotspot_new", ((F.col("hotspot_future") == 1) & (F.col("hotspot_past") == 0)).cast("int"))


EB = f"""{SEG}, mu AS (SELECT seg.*, avg(past) OVER (PARTITION BY p_brand) AS mu FROM seg),
k AS (SELECT greatest(sum((past - mu) * (past - mu) - mu) / sum(mu * mu), 1e-3) AS k FROM mu),
eb AS (SELECT mu.*, k, 1 / (1 + k * mu) * mu + (1 - 1 / (1 + k * mu)) * past AS eb FROM mu, k)"""


def with_brand_mean(t):
    return rel.group_values(segments(t), ["p_brand"], {"mu": F.avg("past")})


@query("eb_shrinkage", f"WITH {EB} SELECT id, round(mu, 4) AS mu, round(eb, 4) AS eb, round(k, 4) AS eb_k FROM eb")
def eb_shrinkage(t):
    return rounded(rank.empirical_bayes(with_brand_mean(t), "mu", "past").select("id", "mu", "eb", "eb_k"))


@query(
    "deployment_score",
    f"""WITH {EB} SELECT id, round((1 / (1 + k * mu * 80 / 40) * mu * 80 / 40 + (1 - 1 / (1 + k * mu * 80 / 40)) * (past + future))
  / greatest(length_m / 1000.0::DOUBLE, 1e-2) / (80 / 12.0::DOUBLE), 3) AS per_km_year FROM eb""",
)
def deployment_score(t):
    eb = rank.empirical_bayes(with_brand_mean(t), "mu", "past")
    rate = rank.deployment_rate(
        F.col("mu"), F.lit(40), F.col("past") + F.col("future"), F.lit(80), F.col("eb_k"), F.col("length_m")
    )
    return eb.select("id", F.round(rate, 3).alias("per_km_year"))


@query(
    "decile_calibration",
    f"""WITH {EB}, r AS (SELECT *, row_number() OVER (ORDER BY eb, id) AS rn, count(*) OVER () AS n FROM eb)
SELECT greatest(1, ceil((rn - 1) * 10 / (n - 1)))::INT AS bucket, count(*) AS segments, round(sum(length_m) / 1000.0::DOUBLE, 3) AS road_km,
       round(sum(eb), 3) AS predicted, sum(future)::BIGINT AS observed, round(sum(future) / sum(eb), 3) AS observed_over_predicted
FROM r GROUP BY 1""",
)
def decile_calibration(t):
    eb = rank.empirical_bayes(with_brand_mean(t), "mu", "past")
    return rounded(rank.calibration(eb, "eb", "eb", "future", "length_m", "id"), 3)


@query(
    "blend_grid",
    f"""WITH {SEG}, two AS (SELECT seg.*, avg(past) OVER (PARTITION BY p_brand) AS ma, avg(past) OVER (PARTITION BY p_type) AS mb FROM seg),
g AS (SELECT two.*, k AS step, (k / 10.0::DOUBLE) * ma + (1 - k / 10.0::DOUBLE) * mb AS blend FROM two, (SELECT unnest(range(0, 11)) AS k) s),
cum AS (SELECT step, past, future, blend, length_m,
   sum(length_m) OVER w / (sum(length_m) OVER (PARTITION BY step))::DOUBLE AS b, (sum(length_m) OVER w - length_m) / (sum(length_m) OVER (PARTITION BY step))::DOUBLE AS a,
   sum(future) OVER w / (sum(future) OVER (PARTITION BY step))::DOUBLE AS d, (sum(future) OVER w - future) / (sum(future) OVER (PARTITION BY step))::DOUBLE AS c
   FROM g WINDOW w AS (PARTITION BY step ORDER BY blend + 1e-9 * length_m DESC, id ROWS UNBOUNDED PRECEDING)),
pts AS (SELECT step, k, max(CASE WHEN a <= 0 THEN d ELSE c + (k / 1000.0::DOUBLE - a) / (b - a) * (d - c) END) AS cap
  FROM (SELECT unnest(range(1, 201)) AS k) q JOIN cum ON a < k / 1000.0::DOUBLE AND k / 1000.0::DOUBLE <= b GROUP BY step, k),
dev AS (SELECT step, 2 * (sum(CASE WHEN future > 0 THEN future * ln(future / blend) ELSE 0 END) - sum(future) * ln(sum(future) / sum(blend))) AS deviance FROM g GROUP BY step)
SELECT step::INT AS step, round(sum(cap) / 200, 4) AS area20, round(max(cap) FILTER (WHERE k = 50), 4) AS cap5, round(max(deviance), 2) AS deviance
FROM pts JOIN dev USING (step) GROUP BY step""",
)
def blend_grid(t):
    two = rel.group_values(
        rel.group_values(segments(t), ["p_brand"], {"ma": F.avg("past")}), ["p_type"], {"mb": F.avg("past")}
    )
    grid = rank.blend_grid(two, "ma", "mb")
    curve = rank.risk_curve(grid, "blend", "length_m", "future", "id", per=["step"])
    caps = rank.capture(curve, ["step"], (0.05,))
    dev = rank.level_free_deviance(grid, "blend", "future", ["step"])
    return caps.join(dev, "step").select(
        "step", F.round("area20", 4).alias("area20"), F.round("cap5", 4).alias("cap5"), F.round("deviance", 2).alias("deviance")
    )


@query(
    "poisson_deviance",
    f"""WITH {SEG}, m AS (SELECT past, avg(past) OVER (PARTITION BY p_brand) AS mu FROM seg)
SELECT round(2 * sum(CASE WHEN past > 0 THEN past * ln(past / mu) ELSE 0 END - (past - mu)), 3) AS deviance FROM m""",
)
def poisson_deviance(t):
    return with_brand_mean(t).agg(F.round(rank.poisson_deviance(F.col("mu"), F.col("past")), 3).alias("deviance"))


@query(
    "auc",
    """WITH d AS (SELECT n_chars AS s, quality FROM labels JOIN documents USING (doc_id)),
p AS (SELECT s, count(*) FILTER (WHERE quality = 1) AS pos, count(*) FILTER (WHERE quality = 0) AS neg FROM d GROUP BY s),
c AS (SELECT *, sum(neg) OVER (ORDER BY s) AS upto FROM p)
SELECT round(sum(pos * (upto - neg / 2)) / sum(pos) / sum(neg), 6) AS auc, sum(pos)::BIGINT AS positives, sum(neg)::BIGINT AS negatives FROM c""",
)
def auc(t):
    scored_labels = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id")
    out = rank.area_under_roc(scored_labels, "n_chars", "quality")
    return out.withColumn("auc", F.round("auc", 6))


@query(
    "log_loss",
    """WITH d AS (SELECT greatest(least(1 / (1 + exp(-(n_chars - 1500) / 2000.0::DOUBLE)), 1 - 1e-6), 1e-6) AS p, quality FROM labels JOIN documents USING (doc_id))
SELECT round(avg(-CASE WHEN quality = 1 THEN ln(p) ELSE ln(1 - p) END), 6) AS logloss FROM d""",
)
def log_loss(t):
    d = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id")
    p = 1 / (1 + F.exp(-(F.col("n_chars") - 1500) / 2000.0))
    return d.agg(F.round(rank.log_loss(p, F.col("quality")), 6).alias("logloss"))


GROUPS = "g AS (SELECT p_brand || '/' || p_type AS cell, count(*) AS n FROM part GROUP BY 1)"


def brand_types(t):
    return t.part.groupBy(F.concat_ws("/", "p_brand", "p_type").alias("cell")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "priority_rank",
    f"""WITH {GROUPS}, r AS (SELECT cell, n, row_number() OVER w AS priority, sum(n) OVER w AS cum_mass FROM g WINDOW w AS (ORDER BY n DESC, cell ROWS UNBOUNDED PRECEDING))
SELECT cell, n, priority, cum_mass::BIGINT AS cum_mass, round(cum_mass / (SELECT sum(n) FROM g), 4) AS cum_share,
       'E' || repeat('0', greatest(3 - length(priority::VARCHAR), 0)::INT) || priority AS cell_id FROM r""",
)
def priority_rank(t):
    from kerbline.functions.text import padded_id

    ranked = rank.priority_shares(brand_types(t), "n", "cell")
    return rounded(ranked.withColumn("cell_id", padded_id("E", F.col("priority"), 3)))


@query(
    "top_mass_filter",
    f"""WITH {GROUPS}, r AS (SELECT cell, n, sum(n) OVER (ORDER BY n DESC, cell ROWS UNBOUNDED PRECEDING) AS cum_mass FROM g)
SELECT cell, n, cum_mass::BIGINT AS cum_mass FROM r WHERE (cum_mass - n) / (SELECT sum(n) FROM g) < 97e-2""",
)
def top_mass_filter(t):
    return rel.top_mass(brand_types(t), "n", "cell", 0.97)


@query(
    "drift_relative_rate",
    """WITH o AS (SELECT c_custkey, n_regionkey, (100 + c_custkey * 37 % 400) / 1000.0::DOUBLE AS km, count(o_orderkey) AS n
  FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2, 3),
m AS (SELECT count(DISTINCT date_trunc('month', o_orderdate)) AS months FROM orders),
r AS (SELECT n_regionkey, sum(n) / sum(km) / (SELECT months FROM m) AS regional FROM o GROUP BY 1)
SELECT c_custkey, n, round(regional, 4) AS regional_rate, round((n / (SELECT months FROM m) + 1e-4) / (regional * greatest(km, 5e-2) + 1e-4), 4) AS relative
FROM o JOIN r USING (n_regionkey)""",
)
def drift_relative_rate(t):
    counts = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    months = t.orders.agg(F.countDistinct(F.date_format("o_orderdate", "yyyy-MM")))
    c = (
        t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select("c_custkey", "n_regionkey", ((100 + F.col("c_custkey") * 37 % 400) / 1000.0).alias("km"))
        .join(counts, "c_custkey", "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .withColumn("months", months.scalar())
    )
    rated_rows = regional_rate(c, ["n_regionkey"], "n", "km", F.col("months"))
    relative = (F.col("n") / F.col("months") + 1e-4) / (F.col("regional_rate") * F.greatest("km", F.lit(0.05)) + 1e-4)
    return rated_rows.select(
        "c_custkey", "n", F.round("regional_rate", 4).alias("regional_rate"), F.round(relative, 4).alias("relative")
    )


@query(
    "main_reasons",
    f"""WITH {SEG}, c AS (SELECT id, p_brand, ['heavy past events', 'long segment', 'busy segment'] AS names,
   [greatest(past_heavy - 2, 0) * 4e-1, greatest(length_m - 300, 0) / 400.0::DOUBLE, greatest(past_all - 12, 0) * 1e-1] AS v FROM seg),
l AS (SELECT id, unnest(names) AS name, unnest(v) AS x FROM c),
o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY x DESC, name) AS rn FROM l)
SELECT id, coalesce(string_agg(name, ' + ' ORDER BY rn) FILTER (WHERE rn <= 2 AND x > 1e-1), 'no standout factor') AS main_reasons FROM o GROUP BY id""",
)
def main_reasons(t):
    above = lambda c, base: F.greatest(F.col(c) - base, F.lit(0))
    parts = {
        "heavy past events": above("past_heavy", 2) * 0.4,
        "long segment": above("length_m", 300) / 400.0,
        "busy segment": above("past_all", 12) * 0.1,
    }
    return segments(t).select("id", rank.reasons(parts).alias("main_reasons"))


@query(
    "risk_classes",
    f"""WITH {SEG}, r AS (SELECT id, past, row_number() OVER (ORDER BY past, id) AS rn, count(*) OVER () AS n FROM seg)
SELECT id, CASE WHEN rn / n <= 5e-1 THEN 'low' WHEN rn / n <= 8e-1 THEN 'medium' WHEN rn / n <= 95e-2 THEN 'high' ELSE 'very high' END AS class FROM r""",
)
def risk_classes(t):
    """Percent-rank classes: a first-come rank over the count, banded right-closed."""
    from kerbline.functions.values import band
    from kerbline.operators.ordered import number_rows

    s = segments(t).select("id", "past")
    ranked = number_rows(s, ["past", "id"]).withColumn("share", F.col("row_no") / s.agg(F.count(F.lit(1))).scalar())
    return ranked.select("id", band(F.col("share"), [0.0, 0.5, 0.8, 0.95, 1.0], ["low", "medium", "high", "very high"]).alias("class"))


