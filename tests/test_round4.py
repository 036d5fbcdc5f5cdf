"""Separated sets, joins that broadcast exploded rows, work that is made once: small cases of the fourth round."""

import math
import struct
import warnings

import pytest
from pyspark.sql import functions as F

from kerbline.functions import geometry
from kerbline.operators import count_models as cm
from kerbline.operators import selection as sel
from kerbline.operators import skew
from kerbline.operators import spatial as sp


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("case, ratio", [(1, math.inf), (0, 0.0)])
def test_separated_pairs_have_no_finite_ratio(spark, case, ratio):
    rows = [(s, c, case if c else 1 - case) for s in range(40) for c in (1, 0)]
    df = spark.createDataFrame(rows, "stratum int, is_case int, x int")
    with warnings.catch_warnings(record=True):
        fit = cm.fit_conditional_logit(df, "stratum", "is_case", ["x"])
        got = fit.table(spark).first()
    assert not fit.converged and got.ratio == ratio and (got.ci95_low, got.ci95_high, got.p_value) == (0.0, math.inf, 1.0)


def test_separated_interaction_leaves_the_other_term(spark):
    pairs = [(1, 0, 0)] * 30 + [(0, 1, 0)] * 10 + [(1, 0, 1)] * 20
    rows = [(s, c, x, x * busy) for s, (a, b, busy) in enumerate(pairs) for c, x in ((1, a), (0, b))]
    df = spark.createDataFrame(rows, "stratum int, is_case int, x int, xb int")
    with warnings.catch_warnings(record=True):
        fit = cm.fit_conditional_logit(df, "stratum", "is_case", ["x", "xb"])
    x, xb = fit.table(spark).collect()
    assert math.isclose(x.ratio, 3.0, rel_tol=1e-6) and xb.ratio == math.inf and 1 < x.ci95_low < 3 < x.ci95_high < math.inf


def test_exploded_edges_are_never_broadcast(spark):
    """Small files of edges: the planner took their cells for few rows."""
    points = spark.range(500).select(F.col("id"), (F.col("id") * 7 % 100).cast("double").alias("px"), (F.col("id") * 13 % 100).cast("double").alias("py"))
    edges = spark.range(20).select(F.col("id").alias("line"), (F.col("id") * 3.0).alias("x1"), (F.col("id") * 5.0).alias("y1"), F.lit(90.0).alias("x2"), F.lit(10.0).alias("y2"))
    want = {r.id: (r.line, r.snap_distance) for r in sp.nearest_line(points, edges, "id", "line", 8.0).collect()}
    before, skew.FEW_ROWS = skew.FEW_ROWS, 10
    try:
        pairs = sp.close_pairs(points, edges, 8.0)
        assert "SortMergeJoin" in plan_of(pairs)
        got = {r.id: (r.line, r.snap_distance) for r in sp.nearest_line(points, edges, "id", "line", 8.0).collect()}
    finally:
        skew.FEW_ROWS = before
    assert got == want and len(got) == 500


def test_more_edges_make_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(sp, "EDGES_PER_TASK", 5)
    points = spark.range(60).select((F.col("id") % 3).alias("kind"), (F.col("id") % 20).cast("double").alias("px"), F.lit(0.0).alias("py"))
    edges = spark.range(100).select((F.col("id") % 50).alias("line"), (F.col("id") % 50).cast("double").alias("x1"), F.lit(0.0).alias("y1"), (F.col("id") % 50 + 1).cast("double").alias("x2"), F.lit(0.0).alias("y2"))
    out = sp.counts_near_lines(points, edges, "line", 1.0, "kind")
    assert plan_of(out).count("REPARTITION_BY_NUM") == 2 and ", 20)" in plan_of(out)
    got = {(r.line, r.kind): r.n for r in out.collect()}
    spots = [(i % 3, i % 20) for i in range(60)]
    want = {}
    for line in range(50):
        for kind, x in spots:
            if line - 1 <= x <= line + 2:
                want[line, kind] = want.get((line, kind), 0) + 1
    assert got == want


def test_binary_line_work_grows_with_its_length(spark):
    """The parser names the bytes once; it named them again for every use, inside the loop over the points."""
    big = [(i / 7, -i / 3) for i in range(2_000)]
    made = struct.pack("<BII" + "d" * (2 * len(big)), 1, 2, len(big), *sum(big, ()))
    df = spark.createDataFrame([(made, 1)], "wkb binary, id int")
    got = df.select(geometry.parse_wkb_line(F.col("wkb")).alias("p")).first().p
    assert [tuple(q) for q in got] == big
    back = df.select(geometry.to_wkb_line(geometry.parse_wkb_line(F.col("wkb")), little=False).alias("b")).first().b
    assert bytes(back) == struct.pack(">BII" + "d" * (2 * len(big)), 0, 2, len(big), *sum(big, ()))
    assert geometry.parse_wkb_line(F.col("wkb"))._jc.toString().count("wkb") == 1


def test_pairs_of_target_ranks_are_counted_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def marked(x):
        seen.add(1)
        return x

    df = spark.range(100).select(marked(F.col("id").cast("double")).alias("a"), (F.col("id") * 2.0).alias("y"))
    assert sel.target_rank_correlation(df, ["a"], "y").first().rho == pytest.approx(1.0)
    assert seen.value == 100
