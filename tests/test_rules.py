"""Null, rounding and tie rules on hand-typed rows."""

import datetime as dt

from pyspark.sql import functions as F

from kerbline.functions import geo, text, values
from kerbline.operators import aggregates, privacy, quality, relational
from kerbline.operators import temporal as tmp

D = dt.datetime


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_flags_with_missing_values(spark):
    df = spark.createDataFrame([(0.6,), (0.1,), (None,)], "rain double")
    assert [r[0] for r in df.select(values.flag(F.col("rain") >= 0.5)).collect()] == [1, 0, 0]
    seen = spark.createDataFrame([(1, 500.0), (1, None), (None, 500.0)], "at int, vis double")
    assert [r[0] for r in seen.select(values.flag_if_observed(F.col("at"), F.col("vis") < 1000)).collect()] == [1, 0, None]


def test_bands_are_right_closed_and_halves_go_to_even(spark):
    df = spark.createDataFrame([(0.5,), (0.51,), (5.0,), (None,)], "v double")
    assert [r[0] for r in df.select(values.band(F.col("v"), [-1, 0.5, 5], ["dark", "dim"])).collect()] == ["dark", "dim", "dim", None]
    assert one(spark, values.snap(F.lit(0.625), 4))[0] == 0.5 and one(spark, values.snap(F.lit(0.875), 4))[0] == 1.0
    assert one(spark, values.clip(F.lit(None).cast("double"), 0, 1))[0] is None


def test_typed_parsing(spark):
    ok = lambda c: one(spark, c)[0]
    assert ok(text.parse_timestamp(F.lit("05-Mar-2024 : 03:07 PM"))) == D(2024, 3, 5, 15, 7)
    assert ok(text.parse_timestamp(F.lit("yesterday"))) is None
    assert ok(text.parse_date(F.lit("2024-03-05T10:00:00Z"))) == dt.date(2024, 3, 5)
    assert ok(text.parse_date(F.lit("31/12/2023"))) == dt.date(2023, 12, 31)
    assert ok(text.parse_number(F.lit(" 40.5 KMPH "))) == 40.5 and ok(text.parse_number(F.lit("4 x 4"))) is None
    assert ok(text.parse_integer(F.lit("3.5"))) is None and ok(text.parse_integer(F.lit("3.0"))) == 3
    assert ok(text.clean_value(F.lit(" n/a "))) is None and ok(text.clean_value(F.lit("Not Known"))) == "Not Known"
    assert ok(text.padded_id("S", F.lit(1234567), 6)) == "S1234567"


def test_controls_stay_in_the_month(spark):
    cases = spark.createDataFrame([("a", D(2024, 3, 1, 23, 30), "x"), ("b", D(2024, 3, 31, 0, 10), "y")], "id string, t timestamp_ntz, sev string")
    cc = tmp.case_crossover(cases, "t", ["sev"], stratum="id").orderBy("stratum_id", "offset_days").collect()
    assert [(r["stratum_id"], r["offset_days"]) for r in cc] == [("a", 0), ("a", 7), ("a", 14), ("a", 21), ("a", 28), ("b", -28), ("b", -21), ("b", -14), ("b", -7), ("b", 0)]
    assert {r["sev"] for r in cc if r["is_case"] == 0} == {None}


def test_lags(spark):
    w = spark.createDataFrame([("c", D(2024, 1, 1, h), v) for h, v in [(0, 1.0), (1, 2.0), (3, 4.0), (9, 5.0)]], "cell string, h timestamp_ntz, rain double")
    out = {r["h"].hour: r for r in tmp.lag_build_up(tmp.offset_values(w, ["cell"], "h", "rain", (1, 2, 3)), "rain", (1, 2, 3)).collect()}
    assert out[3]["rain_prev_sum"] == 3.0 and out[3]["rain_lag1"] is None and out[3]["rain_prev_min"] == 1.0
    assert out[9]["rain_prev_sum"] == 0.0 and out[9]["rain_prev_min"] is None


def test_nearest_in_time_ties_and_tolerance(spark):
    left = spark.createDataFrame([(1, "s", D(2024, 1, 1, 12)), (2, "s", D(2024, 1, 1, 14)), (3, "z", D(2024, 1, 1, 12))], "id int, st string, t timestamp_ntz")
    right = spark.createDataFrame([("s", D(2024, 1, 1, 11, 50), 1), ("s", D(2024, 1, 1, 12, 10), 2), ("s", D(2024, 1, 1, 14, 30), 3)], "st string, r timestamp_ntz, v int")
    out = {r["id"]: r for r in tmp.nearest_in_time(left, right, ["st"], "t", "r", 1800, ["v"], "id").collect()}
    assert (out[1]["matched_v"], out[1]["offset_min"]) == (1, -10)
    assert out[2]["matched_v"] == 3 and out[3]["matched_v"] is None


def test_matched_odds_ratio_of_constant_exposure(spark):
    df = spark.createDataFrame([(s, int(k == 0), 1 if s % 2 else 0) for s in range(6) for k in range(3)], "s int, c int, e int")
    r = tmp.mantel_haenszel(df, "s", "c", "e").first()
    assert r["odds_ratio"] is None and r["sets_used"] == 6


def test_request_runs_and_gaps(spark):
    days = spark.createDataFrame([("c", dt.date(2024, 1, d)) for d in (1, 2, 20)] + [("c", dt.date(2024, 4, 1))], "cell string, day date")
    runs = tmp.request_runs(days, ["cell"], "day").orderBy("start").collect()
    assert [(r["start"].day, r["end"].day, r["days"]) for r in runs] == [(1, 20, 20), (1, 1, 1)]
    polls = spark.createDataFrame([(D(2024, 1, 1, 0, m),) for m in (0, 25)] + [(D(2024, 1, 1, 0, 51),)], "t timestamp_ntz")
    assert [r["gap_minutes"] for r in tmp.gaps(polls, "t", 1500).collect()] == [26]


def test_checked_lookup_fails_on_repeats(spark):
    import pytest

    left = spark.createDataFrame([(1,)], "k int")
    right = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(Exception, match="repeats key"):
        relational.checked_lookup(left, right, ["k"]).collect()


def test_release_guards(spark):
    df = spark.createDataFrame([("call 9876543210", "NH 15"), ("AS 01 AB 1234", "AS 01 AB 1234"), ("fine", "SH-3")], "note string, road_number string")
    clean = privacy.blank_patterns(df, ["note", "road_number"], ["road_number"]).collect()
    assert [(r[0], r[1]) for r in clean] == [(None, "NH 15"), (None, None), ("fine", "SH-3")]
    ids = spark.createDataFrame([("RAM LAL DAS",), ("UNKNOWN 12",)], "n string")
    known = privacy.known_identifiers({"p": (ids, ["n"])})
    assert [r[0] for r in known.collect()] == ["RAM LAL DAS"]
    pub = spark.createDataFrame([(1, "ram lal das"), (2, "ram lal das"), (3, "bus")], "k int, v string")
    assert {r["k"]: r["v"] for r in privacy.blank_rare_identifiers(pub, "k", ["v"], known).collect()} == {1: None, 2: None, 3: "bus"}
    thrice = pub.unionAll(spark.createDataFrame([(4, "ram lal das")], "k int, v string"))
    assert all(r["v"] for r in privacy.blank_rare_identifiers(thrice, "k", ["v"], known).collect())


def test_tolerance_and_weibull(spark):
    s = lambda a, b: one(spark, quality.tolerance_status(F.lit(a), F.lit(b)))[0]
    assert s(10.0, 10.04) == "MATCH" and s(10.0, 10.06) == "MISMATCH" and s(1.0, 1.015) == "MATCH"
    df = spark.createDataFrame([("g", float(v)) for v in (10, 20, 30, 40)], "g string, v double")
    r = aggregates.weibull_percentiles(df, ["g"], "v", (0.5, 0.85, 0.98)).first()
    assert (r["w50"], r["w98"]) == (25.0, 40.0) and abs(r["w85"] - 40.0) < 1e-9


def test_sun_and_utm(spark):
    noon = F.lit(D(2024, 3, 20, 5, 50)).cast("timestamp_ntz")  # equinox, about solar noon at 92.5 E
    up = one(spark, geo.sun_elevation(noon, F.lit(26.0), F.lit(92.5)))[0]
    assert abs(up - 64.0) < 0.3
    e, n = geo.utm_forward(F.lit(26.0), F.lit(93.0))
    got = one(spark, e, n)
    assert abs(got[0] - 500000.0) < 1e-6 and abs(got[1] / 0.9996 - 2876724.0) < 3000
