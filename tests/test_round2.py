"""Word gaps, the date line, whole issue values, late readings, and the shared folder."""

import math

import pytest
from pyspark.sql import functions as F

from kerbline import session
from kerbline.functions.text import contains_in_order
from kerbline.operators import quality, selection, spatial
from kerbline.streaming import traffic


def found(spark, text, phrase):
    return spark.createDataFrame([(text, phrase)], "t string, p string").select(contains_in_order(F.col("t"), F.col("p"))).first()[0]


@pytest.mark.parametrize(
    "text, phrase, want",
    [
        ("alpha " + "x " * 38 + "beta", "alpha beta", True),
        ("alpha " + "x " * 39 + "beta", "alpha beta", False),
        ("alpha " + "longerword " * 30 + "beta", "alpha beta", True),
        ("prealphapost and xbetax", "alpha beta", True),
        ("alpha " + "x " * 60 + "alpha y beta", "alpha beta", True),  # a second start
        ("beta alpha", "alpha beta", False),
        ("a.c", "a.c", True),
        ("abc", "a.c", False),
        ("anything", "", False),
        # the nearest second word is taken, and from there the third is too far
        ("one two " + "x " * 20 + "two " + "x " * 30 + "three", "one two three", False),
    ],
)
def test_words_in_order(spark, text, phrase, want):
    assert found(spark, text, phrase) is want


def test_words_in_order_on_a_long_text(spark):
    assert found(spark, "the a " * 20_000, "the a the b") is False


def test_radius_sum_round_the_date_line(spark):
    rows = [(1, 0.0, 179.99, 1.0), (2, 0.0, -179.99, 2.0), (3, 0.0, 0.0, 4.0), (4, 60.0, 179.9, 8.0), (5, 60.0, -179.9, 16.0)]
    points = spark.createDataFrame(rows, "id long, lat double, lon double, w double")
    out = {r["id"]: r["nearby"] for r in spatial.radius_sum(points, "lat", "lon", "w", spatial.Globe(30.0)).collect()}
    assert out == {1: 2.0, 2: 1.0, 3: 0.0, 4: 16.0, 5: 8.0}


def test_edge_cells_of_a_long_diagonal(spark):
    edges = [(0.0, 0.0, 3535.0, 3535.0), (10.0, 5.0, 10.0, 900.0), (700.0, 3.0, -50.0, 3.0), (5.0, 5.0, 5.0, 5.0), (0.0, 50.0, 80.0, -700.0)]
    table = spark.createDataFrame(edges, "x1 double, y1 double, x2 double, y2 double")
    got = {tuple(r) for r in spatial.edge_cells(table, 5.0, 5.0).select("x1", "y1", "x2", "y2", "cx", "cy").collect()}

    def away(px, py, x1, y1, x2, y2):
        n = (x2 - x1) ** 2 + (y2 - y1) ** 2
        t = 0.0 if n == 0 else max(0.0, min(1.0, ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / n))
        return math.hypot(px - x1 - t * (x2 - x1), py - y1 - t * (y2 - y1))

    want = set()
    for e in edges[1:]:
        for cx in range(int(min(e[0], e[2]) // 5) - 3, int(max(e[0], e[2]) // 5) + 4):
            for cy in range(int(min(e[1], e[3]) // 5) - 3, int(max(e[1], e[3]) // 5) + 4):
                # a cell is needed if its square comes within reach of the edge; the cell's centre tells, but for the corners
                if away((cx + 0.5) * 5, (cy + 0.5) * 5, *e) < 5.0 + 2.5 - 1e-6:
                    want.add((*e, cx, cy))
    assert want <= got and len([g for g in got if g[2] == 3535.0]) < 6000


def test_issue_values_are_whole(spark):
    table = spark.createDataFrame([("r", "v" * 3000)], "id string, x string")
    rule = quality.Rule("error", "x", F.col("x"), "bad", F.lit(True))
    assert len(quality.issues(table, "id", "t", [rule]).first()["value"]) == 3000


def test_late_readings_stay(spark, tmp_path):
    schema = "event long, t timestamp, tile int, piece int, level double, closed boolean"
    for n, rows in enumerate([[(1, "2024-01-01 12:00:00", 1, 1, 0.2), (2, "2024-01-03 12:00:00", 1, 2, 0.8)], [(3, "2024-01-01 12:05:00", 2, 1, 0.6), (1, "2024-01-01 12:00:00", 1, 1, 0.2)]]):
        df = spark.createDataFrame([(*r, False) for r in rows], "event long, s string, tile int, piece int, level double, closed boolean")
        df.withColumn("t", F.col("s").cast("timestamp")).drop("s").select("event", "t", "tile", "piece", "level", "closed").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: traffic.file_stream(spark, str(tmp_path / "in"), max_files=1)
    assert spark.read.schema(schema).parquet(str(tmp_path / "in")).count() == 4
    once = traffic.run_append(traffic.without_repeats(stream(), "t", ["event"]), "once")
    assert sorted(r["event"] for r in once.collect()) == [1, 2, 3]
    polls = {r["poll"].day: (r["tiles"], r["road_pieces"], r["readings"]) for r in traffic.run_poll_windows(stream(), "t", "tile", "piece", "level", F.col("closed")).collect()}
    assert polls == {1: (2, 1, 3), 3: (1, 1, 1)}


def test_quantile_edges_are_exact(spark):
    df = spark.range(1, 102).select(F.col("id").alias("a"), (F.col("id") * 2).alias("b"))
    assert selection.quantile_edges(df, ["a", "b"], 4) == {"a": [26.0, 51.0, 76.0], "b": [52.0, 102.0, 152.0]}


def test_no_local_folder_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Spark:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        session.shared_folder(Spark())
