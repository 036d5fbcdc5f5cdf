"""Binary lines, exact samples, ranks with ties, wide matrices, rejected lines and components on small cases."""

import struct

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbline.functions import geometry
from kerbline.operators import relational as rel
from kerbline.operators import selection as sel
from kerbline.operators import subsets
from kerbline.sources import store


def test_binary_lines_of_both_orders(spark):
    pts = [(92.5, -0.1), (0.0, 1e-12), (-1.5e300, 3.0), (1 / 3, -123456.789)]
    made = [struct.pack("<BII" + "d" * 8, 1, 2, 4, *sum(pts, ())), struct.pack(">BII" + "d" * 8, 0, 2, 4, *sum(pts, ())), struct.pack("<BII", 1, 2, 0), struct.pack("<BIdd", 1, 1, 1.0, 2.0), b"\x01", None]
    df = spark.createDataFrame([(i, m) for i, m in enumerate(made)], "id int, wkb binary")
    lines = df.select("id", geometry.parse_wkb_line(F.col("wkb")).alias("p"))
    got = {r.id: r.p and [tuple(q) for q in r.p] for r in lines.collect()}
    assert got[0] == got[1] == pts and not got[2] and got[3] is got[4] is got[5] is None
    back = lines.filter("id = 0").select(geometry.to_wkb_line(F.col("p")).alias("a"), geometry.to_wkb_line(F.col("p"), little=False).alias("b")).first()
    assert [bytes(back.a), bytes(back.b)] == made[:2]


def test_exactly_k_rows(spark):
    df = spark.range(500).withColumn("key", F.col("id") % 400)
    for k in (0, 1, 37, 499, 500, 900):
        got = rel.sample_rows(df, "key", k, 3)
        assert got.count() == min(k, 500) and got.columns == df.columns
    assert {r.id for r in rel.sample_rows(df, "key", 20).collect()} <= {r.id for r in rel.sample_rows(df, "key", 60).collect()}
    assert rel.sample_rows(df.withColumn("key", F.lit(1)), "key", 7).count() == 7


def test_target_ranks_with_ties_and_gaps(spark):
    import pandas as pd

    rng = np.random.default_rng(6)
    t = pd.DataFrame({"a": rng.integers(0, 5, 200).astype(float), "b": rng.standard_normal(200), "c": 1.0, "y": rng.integers(0, 9, 200).astype(float)})
    t.loc[::7, "b"] = None
    df = spark.createDataFrame([tuple(None if v != v else v for v in r) for r in t.itertuples(index=False)], "a double, b double, c double, y double")
    got = {r.feature: r.rho for r in sel.target_rank_correlation(df, ["a", "b", "c"], "y").collect()}
    for f in ("a", "b"):
        own = t[[f, "y"]].dropna().rank()
        assert np.isclose(got[f], own[f].corr(own["y"]))
    assert got["c"] is None


def test_matrix_columns_follow_the_calendar(spark):
    long = spark.createDataFrame([("p", 1, 2.0), ("p", 1, 4.0), ("q", 3, 1.0), ("q", 9, 5.0)], "point string, hour int, v double")
    wide = rel.wide_matrix(long, "point", "hour", "v", [1, 2, 3], ["h1", "h2", "h3"], block=2)
    assert sorted(map(tuple, wide.collect())) == [("p", 3.0, None, None), ("q", None, None, 1.0)]


def test_no_log_line_is_lost(spark, tmp_path):
    (tmp_path / "log.json").write_text('{"v": 1}\nnot json\n\n{"v": "x"}\n{"v": 2, "w": 3}\n{"v":\n')
    kept, rejected = store.read_log_with_rejects(spark, str(tmp_path / "log.json"), T.StructType([T.StructField("v", T.LongType())]))
    assert sorted(r.v for r in kept.collect()) == [1, 2] and {r.value for r in rejected.collect()} == {'not json', '{"v": "x"}', '{"v":'}


def test_components_in_blocks_of_columns(spark):
    x = np.random.default_rng(3).standard_normal((300, 10)) @ np.diag(range(1, 11))
    x[:, 1] += x[:, 0] * 3
    cols = [f"x{i}" for i in range(10)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{c} double" for c in cols))
    got = subsets.components(df, cols)
    values, vectors = np.linalg.eigh(np.corrcoef(x.T))
    assert np.allclose(got.shares, values[::-1] / 10) and np.allclose(abs((got.loadings * vectors[:, ::-1]).sum(0)), 1)
    assert got.needed(1.0) == 10 and got.needed(got.shares[0]) == 1
    assert set(subsets.block_components(df, {"p": cols[:2], "q": cols[2:]})) == {"p", "q"}
