"""Fits against closed forms, gradients and small brute force; no leak between folds or windows."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from kerbline.operators import boosting, ranking
from kerbline.operators import count_models as cm
from kerbline.operators import selection as sel


def counts(spark, n=600, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=n)
    off = np.log(rng.uniform(0.2, 1.0, n))
    mu = np.exp(0.4 + 0.6 * x + off)
    y = rng.poisson(mu * rng.gamma(2.0, 0.5, n))
    rows = [(i, float(x[i]), float(off[i]), int(y[i]), i % 3) for i in range(n)]
    return spark.createDataFrame(rows, "id int, x double, off double, y int, fold int"), x, off, y


def test_negative_binomial_gradient_vanishes(spark):
    df, x, off, y = counts(spark)
    fit = cm.fit_negative_binomial(df, "y", ["x"], "off")
    mu = np.exp(fit.beta[0] + fit.beta[1] * x + off)
    score = (y - mu) / (1 + fit.alpha * mu)
    assert abs(score.sum()) < 1e-4 and abs((score * x).sum()) < 1e-4
    r = 1 / fit.alpha
    g = sum(sum(1 / (j + r) for j in range(k)) for k in y) + np.sum(math.log(r) + 1 - np.log(r + mu) - (r + y) / (r + mu))
    assert abs(g) < 0.05


def test_fold_models_never_see_their_fold(spark):
    df, *_ = counts(spark)
    fits = cm.fit_negative_binomial_by_fold(df, "y", ["x"], "fold", 3, 0.4, "off")
    changed = df.withColumn("y", F.when(F.col("fold") == 1, 50).otherwise(F.col("y")))
    again = cm.fit_negative_binomial_by_fold(changed, "y", ["x"], "fold", 3, 0.4, "off")
    assert np.allclose(fits[1].beta, again[1].beta, atol=1e-8) and not np.allclose(fits[0].beta, again[0].beta, atol=1e-3)


def test_conditional_logit_gradient(spark):
    rng = random.Random(1)
    rows = [(s, int(k == 0), float(rng.random() < (0.5 if k == 0 else 0.3))) for s in range(120) for k in range(3)]
    fit = cm.fit_conditional_logit(spark.createDataFrame(rows, "s int, c int, e double"), "s", "c", ["e"])
    g = 0.0
    for s in range(120):
        e = [r[2] for r in rows if r[0] == s]
        w = [math.exp(fit.beta[0] * v) for v in e]
        g += e[0] - sum(a * b for a, b in zip(w, e)) / sum(w)
    assert abs(g) < 1e-6


def test_boosting_learns_and_stays_out_of_fold(spark):
    rng = np.random.default_rng(0)
    rows = [(i, float(v), int(rng.poisson(4.0 if v > 0.5 else 1.0)), i % 2) for i, v in enumerate(rng.uniform(0, 1, 400))]
    df = spark.createDataFrame(rows, "id int, x double, y int, fold int")
    forest, mu = boosting.fit_poisson_boost(df, "id", "y", ["x"], "fold", 2, trees=4, depth=2, bins=8, rate=0.5, min_rows=10)
    got = {r["id"]: r["mu"] for r in mu.collect()}
    high = np.mean([got[r[0]] for r in rows if r[1] > 0.6])
    low = np.mean([got[r[0]] for r in rows if r[1] < 0.4])
    assert high > 2 * low and len(got) == 400
    redo = {r["id"]: r["p"] for r in forest.predict(df, "p", F.col("fold")).collect()}
    assert max(abs(redo[i] - got[i]) for i in got) < 1e-9


def test_capture_is_monotone_and_bounded(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(i, rng.random(), rng.randrange(50, 500), rng.randrange(4)) for i in range(150)], "id int, s double, len int, y int")
    c = ranking.capture(ranking.risk_curve(df, "s", "len", "y", "id"), shares=(0.01, 0.05, 0.1, 0.2, 0.5, 1.0)).first()
    vals = [c[f"cap{k}"] for k in (1, 5, 10, 20, 50, 100)]
    assert vals == sorted(vals) and abs(vals[-1] - 1) < 1e-12


def test_signal_parts(spark):
    df = spark.createDataFrame([(1, 5.0, 100), (2, 4.0, 400), (3, 4.0, 1500), (4, 0.0, 8000)], "id int, r double, len int")
    cuts = ranking.cutoffs(df, "r", "len", "id").first()
    assert (cuts["cut3"], cuts["cut2"], cuts["cut1"]) == (5.0, 4.0, 4.0)
    reason = ranking.reasons({"a": F.lit(0.3), "b": F.lit(0.05), "c": F.lit(0.9)})
    assert spark.range(1).select(reason).first()[0] == "c + a"


def test_selection_helpers(spark):
    rho = np.array([[1, 0.95, 0.1], [0.95, 1, 0.0], [0.1, 0.0, 1]])
    groups = sel.redundancy_groups(rho, ["a", "b", "c"])
    assert groups["a"] == groups["b"] != groups["c"]
    kept, dropped = sel.keep_most_informative(groups, {"a": 0.1, "b": 0.4, "c": 0.2}, {"c": 0.999})
    assert kept == ["b"] and set(dropped) == {"a", "c"}
    df = spark.createDataFrame([(i, float(i % 5)) for i in range(60)], "id int, v double")
    assert sorted(r["v"] for r in sel.permuted(df, "id", "v", 1).collect()) == sorted(float(i % 5) for i in range(60))


def test_history_ignores_later_months(spark):
    from kerbline.operators.features import history_features

    segs = spark.createDataFrame([(i, 26.0 + i * 0.004, 92.0, 300) for i in range(8)], "segment_id int, lat double, lon double, length_m int")
    ev = [(i % 8, f"2024-{1 + i % 4:02d}", i % 2, 0) for i in range(40)]
    schema = "segment_id int, month string, ksi int, fatal int"
    a = history_features(segs, spark.createDataFrame(ev, schema), "2024-01", "2024-04")
    b = history_features(segs, spark.createDataFrame(ev + [(3, "2024-05", 1, 1)] * 30, schema), "2024-01", "2024-04")
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert a.first()["data_months"] == 4


