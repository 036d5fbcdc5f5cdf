"""Streams equal batches; readers and writers keep their dialects."""

import datetime as dt

from pyspark.sql import functions as F

from kerbline.operators import temporal as tmp
from kerbline.sources import store
from kerbline.streaming import traffic

D = dt.datetime


def polls(spark):
    rows = [(D(2024, 1, 1, h, m), "a", i) for i, (h, m) in enumerate([(0, 0), (0, 15), (1, 30), (1, 45), (3, 0)])]
    return spark.createDataFrame(rows, "ts timestamp_ntz, source string, id int")


def test_outages_across_batches(spark, tmp_path):
    p = polls(spark)
    for i in (3, 0, 4, 1, 2):  # late ones come first
        p.filter(F.col("id") == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = traffic.file_stream(spark, str(tmp_path / "in"), max_files=1)
    got = traffic.run_outages(s, "source", "ts", 1500).select("gap_minutes").collect()
    want = tmp.gaps(p, "ts", 1500, ["source"]).select("gap_minutes").collect()
    assert sorted(r[0] for r in got) == sorted(r[0] for r in want) == [75, 75]


def test_stretches_inside_others_and_open_outages(spark):
    h = D(2024, 1, 1)
    rows = [("a", h, h.replace(hour=4)), ("a", h.replace(hour=1), h.replace(hour=2)), ("a", h.replace(hour=4, minute=25), h.replace(hour=5)), ("a", h.replace(hour=6), h.replace(hour=6)), ("b", h, h)]
    df = spark.createDataFrame(rows, "source string, s timestamp_ntz, e timestamp_ntz")
    made = traffic.islands(df, "source", "s", "e", 1500)
    assert sorted((r.source, r.starts.hour, r.ends.hour) for r in made.collect()) == [("a", 0, 5), ("a", 6, 6), ("b", 0, 0)]
    gaps = traffic.silences(made, "source", 1500)
    assert sorted((r.source, r.resumed_at is None, r.gap_minutes) for r in gaps.collect()) == [("a", False, 60), ("b", True, 360)]


def test_stream_partitions_and_dimension(spark, tmp_path):
    p = polls(spark)
    p.write.parquet(str(tmp_path / "in"))
    s = traffic.file_stream(spark, str(tmp_path / "in")).withColumn("hour", F.hour("ts"))
    assert traffic.run_append(s, "hours", ["hour"]).count() == 5
    add = traffic.grow_dimension(str(tmp_path / "dim"), "source", p.schema, 4)
    other = p.filter("id < 2").withColumn("source", F.lit("b"))
    add(p, 0), add(p, 1), add(p, 0), add(other.unionByName(p), 2), add(other, 2)
    assert sorted(r.source for r in spark.read.parquet(str(tmp_path / "dim")).collect()) == ["a", "b"]


def test_manifest_of_repeated_batches(spark, tmp_path):
    keep = traffic.write_accounted(str(tmp_path), {"late": F.count_if(F.hour("ts") > 0)})
    p = polls(spark)
    keep(p, 0), keep(p.filter("id > 2"), 1), keep(p, 0), keep(p.limit(0), 2)
    manifest = {r.batch: (r.rows, r.late) for r in spark.read.parquet(str(tmp_path / "manifest")).collect()}
    assert manifest == {0: (5, 3), 1: (2, 2), 2: (0, 0)}
    assert spark.read.parquet(str(tmp_path / "rows")).count() == 7


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("#note\nstation,valid,vsby,wxcodes,relh,metar\nVEXX,2024-01-01 00:30,0.5,FG,M,x\nVEXX,2024-01-01 01:00,M,M,90,y\n")
    rows = store.read_airport_csv(spark, str(tmp_path / "a.csv")).orderBy("time_utc").collect()
    assert rows[0]["visibility_m"] == 805.0 and rows[0]["relh"] is None and rows[1]["visibility_m"] is None
    (tmp_path / "log.json").write_text('{"v": 1, "src": "x"}\nnot json\n{"v": 2, "src": "y"}\n')
    assert [r["v"] for r in store.read_json_log(spark, str(tmp_path / "log.json"), "v int, src string", F.col("src") == "y").collect()] == [2]
    store.write_settings(spark, {"k": 0.5, "n": 3}, str(tmp_path / "set"))
    assert spark.read.json(str(tmp_path / "set")).first()["n"] == 3
    store.append_manifest(store.manifest_row(spark, "tiles", 7, url="http://x/y?key=abc&z=1"), str(tmp_path / "m"))
    assert "abc" not in spark.read.parquet(str(tmp_path / "m")).first()["url"]
    store.write_bundle({"one": spark.range(3), "two": spark.range(2)}, str(tmp_path / "b"))
    store.write_csv_parts(spark.range(10), str(tmp_path / "c"), parts=2)
    assert store.combine_parts(spark, str(tmp_path / "b" / "*"), ["id"]).count() == 3
    assert store.read_csv(spark, str(tmp_path / "c"), "id bigint").count() == 10
