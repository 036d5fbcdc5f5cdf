"""Model queries. Where a fit has a closed form on its data, the SQL twin is that closed form."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbline.functions import values
from kerbline.operators import boosting, features, ranking
from kerbline.operators import count_models as cm
from kerbline.operators import selection as sel
from kerbline.operators import temporal as tmp
from kerbline.plans.registry import query
from kerbline.plans.risk import SEG, rounded, segments
from kerbline.plans.timelines import CASES, exposed_place_hours
from kerbline.session import cut_lineage


def model_rows(t):
    """Segments with model terms; the count is the past events."""
    parts = t.part.select(F.col("p_partkey").alias("id"), "p_size", "p_retailprice", F.col("p_name").contains("ring").cast("int").alias("ring"))
    return segments(t).join(parts, "id").withColumns(
        {
            "large": (F.col("p_size") > 25).cast("int"),
            "size_z": (F.col("p_size") - 25.5) / 14.4,
            "price_k": F.col("p_retailprice") / 1000.0,
            "offset": F.log(F.greatest(F.col("length_m") / 1000.0, F.lit(0.01))),
            "fold": (F.col("id") % 5).cast("int"),
        }
    )


@query(
    "nb_rate_ratio",
    f"""WITH {SEG}, m AS (SELECT past, (p_size > 25)::INT AS large FROM seg JOIN part ON p_partkey = id)
SELECT 'intercept' AS term, round(avg(past) FILTER (WHERE large = 0), 5) AS ratio FROM m
UNION ALL SELECT 'large', round(avg(past) FILTER (WHERE large = 1) / avg(past) FILTER (WHERE large = 0), 5) FROM m""",
)
def nb_rate_ratio(t):
    """Negative binomial with one two-level term: the fit reproduces the group means."""
    fit = cm.fit_negative_binomial(model_rows(t), "past", ["large"], alpha=0.3)
    return rounded(fit.table(t.spark).select("term", "ratio"), 5)


@query("nb_glm")
def nb_glm(t):
    """Safety performance function: length offset, several terms, dispersion estimated."""
    fit = cm.fit_negative_binomial(model_rows(t), "past", ["size_z", "price_k", "ring"], "offset")
    return fit.table(t.spark).withColumn("alpha", F.lit(fit.alpha))


@query(
    "nb_out_of_fold",
    f"""WITH {SEG}, m AS (SELECT id, past, id % 5 AS fold, (p_size > 25)::INT AS large FROM seg JOIN part ON p_partkey = id),
g AS (SELECT f.fold, large, avg(past) AS mu FROM m, (SELECT DISTINCT fold FROM m) f WHERE m.fold <> f.fold GROUP BY 1, 2)
SELECT id, m.fold::INT AS fold, round(mu, 4) AS mu FROM m JOIN g ON g.fold = m.fold AND g.large = m.large""",
)
def nb_out_of_fold(t):
    rows = model_rows(t)
    fits = cm.fit_negative_binomial_by_fold(rows, "past", ["large"], "fold", 5, 0.3)
    return rounded(cm.predict_out_of_fold(rows, fits, "fold").select("id", "fold", "mu"))


PAIRS = """pairs AS (SELECT stratum_id, is_case, exposed FROM ex WHERE offset_days = 0 OR offset_days = (SELECT 7)),
both2 AS (SELECT stratum_id, max(exposed) FILTER (WHERE is_case = 1) AS a, max(exposed) FILTER (WHERE is_case = 0) AS b FROM pairs GROUP BY 1 HAVING count(*) = 2),
d AS (SELECT count(*) AS n, count(*) FILTER (WHERE a = 1 AND b = 0) AS n10, count(*) FILTER (WHERE a = 0 AND b = 1) AS n01 FROM both2)"""


@query(
    "cond_logit_pairs",
    f"""WITH {CASES}, {PAIRS} SELECT 'exposed' AS term, round(n10 / n01, 5) AS ratio, round(exp(ln(n10 / n01) - 196e-2 * sqrt(1 / n10 + 1 / n01)), 5) AS ci95_low, round(exp(ln(n10 / n01) + 196e-2 * sqrt(1 / n10 + 1 / n01)), 5) AS ci95_high FROM d""",
)
def cond_logit_pairs(t):
    """Conditional logit on pairs: the odds ratio is the ratio of discordant pairs."""
    pairs = exposed_place_hours(t).filter(F.col("offset_days").isin(0, 7))
    fit = cm.fit_conditional_logit(pairs, "stratum_id", "is_case", ["exposed"])
    return rounded(fit.table(t.spark).select("term", "ratio", "ci95_low", "ci95_high"), 5)


@query(
    "cond_logit",
    # a set lies in one place, so its likelihood has one slope: that of other places, or its sum with the interaction
    f"""WITH RECURSIVE {CASES},
g AS (SELECT busy, m, k, c, count(*) AS n FROM (SELECT stratum_id, (max(cell) < 5)::INT AS busy, count(*) AS m, sum(exposed) AS k, sum(exposed * is_case) AS c FROM ex GROUP BY 1 HAVING sum(is_case) = 1 AND count(*) >= 2) q GROUP BY ALL),
it AS (SELECT 0 AS step, busy, 0::DOUBLE AS th, 0::DOUBLE AS info FROM (SELECT DISTINCT busy FROM g) q
  UNION ALL
  SELECT step + 1, busy, th + sum(n * (c - p)) / sum(n * p * (1 - p)), sum(n * p * (1 - p)) FROM (SELECT it.step, it.busy, it.th, g.n, g.c, g.k * exp(it.th) / (g.k * exp(it.th) + g.m - g.k) AS p FROM it JOIN g USING (busy) WHERE it.step < 30) q GROUP BY step, busy, th),
z AS (SELECT max(th) FILTER (WHERE busy = 0) AS t0, max(th) FILTER (WHERE busy = 1) AS t1, max(1 / info) FILTER (WHERE busy = 0) AS v0, max(1 / info) FILTER (WHERE busy = 1) AS v1 FROM it WHERE step = 30),
b AS (SELECT 'exposed' AS term, t0 AS b, sqrt(v0) AS se FROM z UNION ALL SELECT 'exposed_x_busy', t1 - t0, sqrt(v0 + v1) FROM z),
pv AS (SELECT term, 1 - sqrt(2 / pi()) * sum((CASE WHEN i = 0 OR i = 1000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-power(abs(b / se) * i / 1000.0::DOUBLE, 2) / 2)) * abs(b / se) / 3000 AS p FROM b, (SELECT unnest(range(0, 1001)) AS i) q GROUP BY term, b, se),
f AS (SELECT term, b, exp(b) AS ratio, exp(b - 196e-2 * se) AS lo, exp(b + 196e-2 * se) AS hi, p FROM b JOIN pv USING (term))
SELECT term, round(b, 5) AS coefficient, round(ratio, 5) AS ratio, round(lo, 5) AS ci95_low, round(hi, 5) AS ci95_high, round(p, 5) AS p_value,
  CASE WHEN hi < 1 THEN 'fewer events' WHEN lo > 1 THEN 'more events' ELSE 'no clear change' END AS reading, CASE WHEN lo > 1 THEN round_even(ratio, 3) ELSE 1 END::DOUBLE AS multiplier FROM f""",
)
def cond_logit(t):
    """All controls, an exposure and its interaction with a place flag."""
    d = exposed_place_hours(t).withColumns({"busy": (F.col("cell") < 5).cast("int"), "exposed_x_busy": F.col("exposed") * (F.col("cell") < 5).cast("int")})
    fit = cm.fit_conditional_logit(d, "stratum_id", "is_case", ["exposed", "exposed_x_busy"])
    out = fit.table(t.spark)
    low, high = F.col("ci95_low"), F.col("ci95_high")
    return rounded(out.withColumns({"reading": tmp.reading_of(low, high), "multiplier": tmp.safe_multiplier(F.col("ratio"), low)}), 5)


@query(
    "logit_odds",
    """WITH e AS (SELECT (event_type = 'error')::INT AS y, (hour(ts) < 6)::INT AS night FROM events), p AS (SELECT avg(y) FILTER (WHERE night = 0) AS p0, avg(y) FILTER (WHERE night = 1) AS p1 FROM e)
SELECT 'intercept' AS term, round(p0 / (1 - p0), 5) AS ratio FROM p UNION ALL SELECT 'night', round(p1 / (1 - p1) / (p0 / (1 - p0)), 5) FROM p""",
)
def logit_odds(t):
    e = t.events.select((F.col("event_type") == "error").cast("int").alias("y"), (F.hour("ts") < 6).cast("int").alias("night"))
    return rounded(cm.fit_logistic(e, "y", ["night"]).table(t.spark).select("term", "ratio"), 5)


@query(
    "severity_multipliers",
    """WITH e AS (SELECT (event_type = 'error')::INT AS y, CASE WHEN hour(ts) < 6 THEN 'dark' WHEN hour(ts) < 8 THEN 'twilight' ELSE 'daylight' END AS scenario FROM events), p AS (SELECT scenario, avg(y) AS m FROM e GROUP BY 1)
SELECT scenario, round(m, 6) AS mean_probability, round_even(greatest(m / (SELECT m FROM p WHERE scenario = 'daylight'), 1), 3) AS multiplier FROM p""",
)
def severity_multipliers(t):
    """Everybody set to one light class, mean predicted probability, ratio to daylight floored at 1."""
    light = F.when(F.hour("ts") < 6, "dark").when(F.hour("ts") < 8, "twilight").otherwise("daylight")
    e = t.events.select((F.col("event_type") == "error").cast("int").alias("y"), *values.one_hot(light, ["daylight", "twilight", "dark"], "light"))
    fit = cm.fit_logistic(e, "y", ["light_twilight", "light_dark"])
    scenarios = {
        "daylight": {"light_twilight": 0, "light_dark": 0},
        "twilight": {"light_twilight": 1, "light_dark": 0},
        "dark": {"light_twilight": 0, "light_dark": 1},
    }
    out = cm.multipliers(cm.counterfactual_means(e, fit, scenarios), "daylight")
    return out.withColumn("mean_probability", F.round("mean_probability", 6))


@query("poisson_boost")
def poisson_boost(t):
    """Out-of-fold expected counts of boosted Poisson trees."""
    rows = model_rows(t)
    _, mu = boosting.fit_poisson_boost(rows, "id", "past", ["p_size", "p_retailprice", "length_m", "ring"], "fold", 5, trees=6, depth=3, bins=16)
    return mu


@query("boosted_classifier")
def boosted_classifier(t):
    """Boosted trees as a ceiling check, judged by AUC and log loss on the later half."""
    e = t.events.select(
        "ts", (F.col("event_type") == "purchase").cast("int").alias("y"), "value", F.hour("ts").alias("hour"), (F.col("user_id") % 10).alias("cell")
    )
    split = F.lit("2024-01-16").cast("timestamp_ntz")
    scored = cm.boosted_classifier(e.filter(F.col("ts") < split), e.filter(F.col("ts") >= split), "y", ["value", "hour", "cell"], 5, 3)
    auc = ranking.area_under_roc(scored, "p", "y")
    return auc.withColumn("logloss", scored.agg(ranking.log_loss(F.col("p"), F.col("y"))).scalar())


@query(
    "spearman",
    """WITH b AS (SELECT p_size::DOUBLE AS p_size, p_retailprice, (p_partkey * 37 % 400)::DOUBLE AS len FROM part),
r AS (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2 AS a, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2 AS b, rank() OVER (ORDER BY len) + (count(*) OVER (PARTITION BY len) - 1) / 2 AS c FROM b),
m AS (SELECT corr(a, b) AS ab, corr(a, c) AS ac, corr(b, c) AS bc FROM r)
SELECT unnest(['p_size','p_size','p_size','p_retailprice','p_retailprice','p_retailprice','len','len','len']) AS feature_a, unnest(['p_size','p_retailprice','len','p_size','p_retailprice','len','p_size','p_retailprice','len']) AS feature_b,
  unnest([1::DOUBLE, round(ab, 5), round(ac, 5), round(ab, 5), 1::DOUBLE, round(bc, 5), round(ac, 5), round(bc, 5), 1::DOUBLE]) AS rho FROM m""",
)
def spearman(t):
    p = t.part.select("p_size", "p_retailprice", (F.col("p_partkey") * 37 % 400).alias("len"))
    return rounded(sel.correlation_table(p, ["p_size", "p_retailprice", "len"]), 5)


@query(
    "vif",
    """WITH b AS (SELECT p_size::DOUBLE AS a, p_retailprice AS b, (p_partkey * 37 % 400)::DOUBLE AS c FROM part), m AS (SELECT corr(a, b) AS ab, corr(a, c) AS ac, corr(b, c) AS bc FROM b)
SELECT unnest(['p_size', 'p_retailprice', 'len']) AS feature, unnest([round(1 / (1 - (ab * ab + ac * ac - 2 * ab * ac * bc) / (1 - bc * bc)), 5), round(1 / (1 - (ab * ab + bc * bc - 2 * ab * ac * bc) / (1 - ac * ac)), 5), round(1 / (1 - (ac * ac + bc * bc - 2 * ab * ac * bc) / (1 - ab * ab)), 5)]) AS vif FROM m""",
)
def vif(t):
    p = t.part.select("p_size", "p_retailprice", (F.col("p_partkey") * 37 % 400).alias("len"))
    got = sel.variance_inflation(p, ["p_size", "p_retailprice", "len"])
    return rounded(t.spark.createDataFrame([(k, v) for k, v in got.items()], "feature string, vif double"), 5)


@query(
    "mutual_information",
    """WITH q AS (SELECT quantile_cont(p_size, [1e-1, 2e-1, 3e-1, 4e-1, 5e-1, 6e-1, 7e-1, 8e-1, 9e-1]) AS e1, quantile_cont(p_retailprice, [1e-1, 2e-1, 3e-1, 4e-1, 5e-1, 6e-1, 7e-1, 8e-1, 9e-1]) AS e2 FROM part),
l AS (SELECT p_type AS y, unnest(['p_size', 'p_retailprice']) AS feature, unnest([len(list_filter(e1, lambda x: x < p_size)), len(list_filter(e2, lambda x: x < p_retailprice))]) AS bin FROM part, q),
c AS (SELECT feature, bin, y, count(*) AS n FROM l GROUP BY 1, 2, 3),
d AS (SELECT *, sum(n) OVER (PARTITION BY feature, bin) AS nb, sum(n) OVER (PARTITION BY feature, y) AS ny, sum(n) OVER (PARTITION BY feature) AS nn FROM c)
SELECT feature, round(sum(n / nn * ln(n * nn / (nb * ny))), 6) AS mutual_information FROM d GROUP BY 1""",
)
def mutual_information(t):
    return rounded(sel.mutual_information(t.part, ["p_size", "p_retailprice"], "p_type", 10), 6)


@query("pca_variance")
def pca_variance(t):
    """Variance table of the standardised embedding coordinates."""
    wide = t.embeddings.select(*[F.get("embedding", i).cast("double").alias(f"e{i}") for i in range(64)])
    return sel.principal_components(wide, wide.columns)[0]


@query("redundant_features")
def redundant_features(t):
    """Groups of features with an average |rho| of at least 0.85, and the member kept."""
    p = model_rows(t).withColumns({"size_sq": F.col("p_size") ** 2, "price2": F.col("p_retailprice") * 2 + F.col("ring")})
    cols = ["p_size", "size_sq", "p_retailprice", "price2", "length_m", "ring"]
    groups = sel.redundancy_groups(sel.correlation_matrix(p, cols), cols)
    info = {r["feature"]: r["mutual_information"] for r in sel.mutual_information(p, cols, "past", 10).collect()}
    kept, dropped = sel.keep_most_informative(groups, info, {})
    profile = t.spark.createDataFrame([(c, groups[c], info[c]) for c in cols], "feature string, redundancy_group int, mutual_information double")
    return sel.feature_catalogue(profile, kept, dropped)


@query(
    "bootstrap_gain",
    f"""WITH {SEG}, s AS (SELECT id, length_m, future, past + 1e-2 * past_all AS sa, past_heavy + 1e-3 * past AS sb, p_brand AS block FROM seg),
bl AS (SELECT block, row_number() OVER (ORDER BY block) AS no, count(*) OVER () AS n FROM (SELECT DISTINCT block FROM s)),
dr AS (SELECT rep, ('0x' || substr(md5('3-' || rep || '-' || no), 1, 8))::BIGINT % n + 1 AS no FROM bl, (SELECT unnest(range(0, 300)) AS rep) r),
w AS (SELECT rep, block, count(*) AS weight FROM dr JOIN bl USING (no) GROUP BY 1, 2),
d AS (SELECT rep, id, length_m * weight AS l, future * weight AS y, sa, sb FROM s JOIN w USING (block)),
u AS (SELECT rep, id, l, y, 'a' AS which, sa + 1e-9 * l AS o FROM d UNION ALL SELECT rep, id, l, y, 'b', sb + 1e-9 * l FROM d),
cum AS (SELECT rep, which, sum(l) OVER w2 / (sum(l) OVER (PARTITION BY which, rep))::DOUBLE AS b, (sum(l) OVER w2 - l) / (sum(l) OVER (PARTITION BY which, rep))::DOUBLE AS a,
  sum(y) OVER w2 / (sum(y) OVER (PARTITION BY which, rep))::DOUBLE AS dd, (sum(y) OVER w2 - y) / (sum(y) OVER (PARTITION BY which, rep))::DOUBLE AS c FROM u WINDOW w2 AS (PARTITION BY which, rep ORDER BY o DESC, id ROWS UNBOUNDED PRECEDING)),
pts AS (SELECT which, rep, k, max(CASE WHEN a <= 0 THEN dd ELSE c + (k / 1000.0::DOUBLE - a) / (b - a) * (dd - c) END) AS cap FROM (SELECT unnest(range(1, 201)) AS k) q JOIN cum ON a < k / 1000.0::DOUBLE AND k / 1000.0::DOUBLE <= b GROUP BY 1, 2, 3),
m AS (SELECT rep, max(cap) FILTER (WHERE which = 'a' AND k = 50) - max(cap) FILTER (WHERE which = 'b' AND k = 50) AS cap5, (sum(cap) FILTER (WHERE which = 'a') - sum(cap) FILTER (WHERE which = 'b')) / 200 AS area20 FROM pts GROUP BY 1),
l AS (SELECT unnest(['cap5', 'area20']) AS measure, unnest([cap5, area20]) AS gain FROM m)
SELECT measure, round(avg(gain), 5) AS mean_gain, round(quantile_cont(gain, 25e-3), 5) AS ci_low, round(quantile_cont(gain, 975e-3), 5) AS ci_high, count(*) AS reps FROM l GROUP BY 1""",
)
def bootstrap_gain(t):
    s = segments(t).withColumns({"sa": F.col("past") + 0.01 * F.col("past_all"), "sb": F.col("past_heavy") + 0.001 * F.col("past")})
    return rounded(sel.bootstrap_gain(s, "p_brand", "sa", "sb", "length_m", "future", "id"), 5)


@query("perm_importance")
def perm_importance(t):
    """Importance of three features in a small forest (4 trees of depth 2 are this query's model parameters)."""
    # fit and shuffles read the rows some fifty times: the counts from the line items are made once
    rows = cut_lineage(model_rows(t).select("id", "past", "p_size", "p_retailprice", "length_m"))
    cols = ["p_size", "p_retailprice", "length_m"]
    forest, _ = boosting.fit_poisson_boost(rows, "id", "past", cols, trees=4, depth=2, bins=16)
    return sel.permutation_importance(rows, "id", "past", cols, forest.predict)


@query(
    "long_tail_transform",
    """SELECT p_partkey, round(CASE WHEN (SELECT min(p_size) >= 0 AND max(p_size) > 5 FROM part) THEN ln(1 + p_size) ELSE p_size END, 6) AS p_size, round(CASE WHEN (SELECT min(x) >= 0 AND max(x) > 5 FROM (SELECT p_size / 100.0::DOUBLE AS x FROM part)) THEN ln(1 + p_size / 100.0::DOUBLE) ELSE p_size / 100.0::DOUBLE END, 6) AS small FROM part""",
)
def long_tail_transform(t):
    p = t.part.select("p_partkey", F.col("p_size").cast("double").alias("p_size"), (F.col("p_size") / 100.0).alias("small"))
    return rounded(values.log_if_long_tailed(p, ["p_size", "small"]), 6)


HGEO = "g AS (SELECT c_custkey AS id, 24 + (c_custkey * 37 % 4000) / 1000.0::DOUBLE AS lat, 90 + (c_custkey * 53 % 6000) / 1000.0::DOUBLE AS lon, 100 + c_custkey * 37 % 400 AS length_m FROM customer)"


def geo_segments(t):
    k = F.col("c_custkey")
    return t.customer.select(
        k.alias("segment_id"), (24 + (k * 37 % 4000) / 1000.0).alias("lat"), (90 + (k * 53 % 6000) / 1000.0).alias("lon"), (100 + k * 37 % 400).alias("length_m")
    )


@query(
    "history_features",
    f"""WITH {HGEO}, e AS (SELECT o_custkey AS id, strftime(o_orderdate, '%Y-%m') AS month, (o_orderstatus <> 'P')::INT AS ksi, (o_orderpriority < '2')::INT AS fatal FROM orders WHERE strftime(o_orderdate, '%Y-%m') BETWEEN '1995-01' AND '1999-12'),
mo AS (SELECT count(DISTINCT month) AS n, (SELECT min(month) FROM (SELECT DISTINCT month FROM e ORDER BY month DESC LIMIT 12)) AS cut FROM e),
s AS (SELECT g.*, coalesce(sum(ksi), 0) AS ksi, count(ksi) AS ev, coalesce(sum(fatal), 0) AS fatal, coalesce(sum(ksi) FILTER (WHERE month >= (SELECT cut FROM mo)), 0) AS rec FROM g LEFT JOIN e USING (id) GROUP BY ALL),
p AS (SELECT a.id, 12742 * asin(sqrt(power(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin(radians(b.lon - a.lon) / 2), 2))) AS km, b.ksi, b.ev, b.fatal, b.rec FROM s a JOIN s b ON abs(a.lat - b.lat) < 1 AND a.id <> b.id),
nb AS (SELECT id, sum(ksi) FILTER (WHERE km <= 10) AS s10, sum(ksi) FILTER (WHERE km <= 20) AS m, sum(ev) FILTER (WHERE km <= 20) AS me, sum(fatal) FILTER (WHERE km <= 20) AS mf, sum(rec) FILTER (WHERE km <= 20) AS mr, sum(ksi) FILTER (WHERE km <= 60) AS l FROM p GROUP BY 1),
r AS (SELECT floor(lat / 5e-1) * 1000 + floor(lon / 5e-1) AS reg, sum(ksi) / (sum(length_m) / 1000.0::DOUBLE) / (SELECT n FROM mo) AS rate FROM s GROUP BY 1)
SELECT s.id AS segment_id, round(coalesce(s10, 0) / n, 5) AS nearby_ksi_small, round(coalesce(m, 0) / n, 5) AS nearby_ksi_mid, round(coalesce(l, 0) / n, 5) AS nearby_ksi_large, round(coalesce(me, 0) / n, 5) AS nearby_events_mid,
  round(coalesce(mf, 0) / n, 5) AS nearby_fatal_mid, round(coalesce(mr, 0) / 12, 5) AS nearby_ksi_mid_recent, round((coalesce(m, 0) / n + 1e-2) / (coalesce(me, 0) / n + 2e-2), 5) AS nearby_severity_ratio_mid, round(rate, 5) AS regional_rate,
  round((coalesce(m, 0) / n + 1e-4) / (rate * greatest(s.length_m / 100.0::DOUBLE - s.length_m / 1000.0::DOUBLE, 5e-2) + 1e-4), 4) AS nearby_ksi_mid_rel
FROM s CROSS JOIN mo LEFT JOIN nb ON nb.id = s.id JOIN r ON r.reg = floor(s.lat / 5e-1) * 1000 + floor(s.lon / 5e-1)""",
)
def history_features(t):
    e = t.orders.select(
        F.col("o_custkey").alias("segment_id"),
        values.year_month(F.col("o_orderdate")).alias("month"),
        (F.col("o_orderstatus") != "P").cast("int").alias("ksi"),
        (F.col("o_orderpriority") < "2").cast("int").alias("fatal"),
    )
    s = geo_segments(t).withColumns({"road_a": F.col("length_m") / 100.0, "road_b": F.col("length_m") / 50.0})
    h = features.history_features(s, e, "1995-01", "1999-12", radii=(10.0, 20.0, 60.0), road_km=("road_a", "road_b"))
    wanted = ["nearby_ksi_small", "nearby_ksi_mid", "nearby_ksi_large", "nearby_events_mid", "nearby_fatal_mid", "nearby_ksi_mid_recent", "nearby_severity_ratio_mid", "regional_rate"]
    return h.select("segment_id", *[F.round(c, 5).alias(c) for c in wanted], F.round("nearby_ksi_mid_rel", 4).alias("nearby_ksi_mid_rel"))


def where_rows(t):
    """Customers as segments with the columns the static features need."""
    k = F.col("c_custkey")
    kinds = F.array(*[F.lit(v) for v in ("trunk", "primary_link", "residential", "track", "service")])
    return t.customer.select(
        k.alias("segment_id"), (k - k % 4).alias("way_id"), (k % 4).alias("piece"), F.get(kinds, (k % 5).cast("int")).alias("highway"),
        F.when(k % 5 == 0, "NH 27").alias("ref"), F.when(k % 2 == 0, "yes").alias("oneway"), F.when(k % 7 == 0, "gravel").alias("surface"),
        (k % 11 == 0).cast("int").alias("is_bridge"), (k % 5 < 2).cast("int").alias("is_main_road"), (100 + k * 37 % 400).cast("double").alias("length_m"),
        (26 + (k * 7919 % 10000) / 50000.0).alias("mid_lat"), (92 + (k * 104729 % 10000) / 50000.0).alias("mid_lon"),
        (1 + k % 60 / 10.0).alias("sinuosity"), (k * 13 % 900).cast("double").alias("turn_deg_per_km"), (k % 3).alias("junctions"), (k % 50).cast("double").alias("junctions_per_km"),
        (k % 6).alias("poi200_total"), (k % 90 / 3.0).alias("night_light_nw"),
    )


@query("static_features")
def static_features(t):
    """Forty-odd context columns around each segment."""
    s = t.supplier.select(
        (26 + (F.col("s_suppkey") * 4729 % 10000) / 50000.0).alias("lat"), (92 + (F.col("s_suppkey") * 7919 % 10000) / 50000.0).alias("lon"),
        F.when(F.col("s_nationkey") < 12, "school").otherwise("cafe").alias("value"), (F.col("s_acctbal") / 100).alias("radiance_nw"),
    )
    return features.static_features(where_rows(t), s.select("lat", "lon", "value"), s.select("lat", "lon", "radiance_nw"))
