"""Readers and writers: CSV dialects, JSON shapes, part files, manifests, bundles, resume."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_parquet(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str], schema: T.StructType | None = None) -> DataFrame:
    """Parquet scan of the named columns only."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    paths = [path] if isinstance(path, str) else list(path)
    return reader.parquet(*paths).select(*columns)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, columns: Sequence[str] | None = None) -> DataFrame:
    """CSV with a header and a declared schema, no inference pass."""
    df = spark.read.schema(schema).option("header", True).csv(path)
    return df.select(*columns) if columns else df


def read_airport_csv(spark: SparkSession, path: str) -> DataFrame:
    """Airport report dialect: '#' comments, 'M' missing, 'valid' as the time, visibility in miles to metres."""
    schema = "station STRING, valid TIMESTAMP_NTZ, vsby DOUBLE, wxcodes STRING, relh DOUBLE, metar STRING"
    df = (
        spark.read.schema(schema)
        .option("header", True).option("comment", "#").option("nullValue", "M").option("timestampNTZFormat", "yyyy-MM-dd HH:mm")
        .csv(path)
    )
    return df.withColumnsRenamed({"station": "icao", "valid": "time_utc"}).withColumn("visibility_m", F.rint(F.col("vsby") * 1609.34)).drop("vsby")


def rows_from_parallel_arrays(df: DataFrame, arrays: Column, keep: Sequence[str]) -> DataFrame:
    """Struct of parallel arrays to one row per position, constant columns attached."""
    fields = df.select(arrays.alias("a")).schema["a"].dataType.names
    zipped = F.arrays_zip(*[arrays[f].alias(f) for f in fields])
    return df.select(*keep, F.inline(zipped))


def read_json_log(spark: SparkSession, path: str, schema: T.StructType | str, keep: Column | None = None) -> DataFrame:
    """JSON lines; malformed lines drop out, and only wanted records stay."""
    df = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return df.filter(keep) if keep is not None else df


def read_log_with_rejects(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """JSON lines as (records, rejected lines): no line is lost, a line that doesn't parse comes out as its text.

    Both tables read the lines once each and share no cache, so a log of any size may be split over executors.  Blank
    lines are neither.
    """
    whole = T.StructType([*schema.fields, T.StructField("__line", T.StringType())])
    lines = spark.read.text(path).filter(F.trim("value") != "")
    said = lines.select(F.from_json("value", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__line"}).alias("r"), "value")
    bad = F.col("r").isNull() | F.col("r.__line").isNotNull()
    return said.filter(~bad).select(*[F.col(f"r.{f}") for f in schema.names]), said.filter(bad).select("value")


def combine_parts(spark: SparkSession, pattern: str, keys: Sequence[str]) -> DataFrame:
    """Many part files as one table, one row per key."""
    return spark.read.parquet(pattern).dropDuplicates(list(keys))


def write_table(df: DataFrame, path: str, sort_by: Sequence[str] = (), partition_by: Sequence[str] = ()) -> None:
    """Parquet sink; rows sorted inside tasks so later reads can skip row groups."""
    out = df.sortWithinPartitions(*sort_by) if sort_by else df
    writer = out.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv_parts(df: DataFrame, path: str, parts: int | None = None, max_rows: int | None = None) -> None:
    out = df.repartition(parts) if parts else df
    writer = out.write.mode("overwrite").option("header", True)
    (writer.option("maxRecordsPerFile", max_rows) if max_rows else writer).csv(path)


def write_settings(spark: SparkSession, settings: Mapping[str, object], path: str) -> None:
    """One JSON document of headline numbers."""
    spark.range(1).select(*[F.lit(v).alias(k) for k, v in settings.items()]).select(
        F.to_json(F.struct("*")).alias("value")
    ).write.mode("overwrite").text(path)


def write_bundle(tables: Mapping[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        write_table(df, f"{folder}/{name}")


def manifest_row(spark: SparkSession, source: str, rows: int, note: str = "", url: str = "", digest: str = "", size: int = 0) -> DataFrame:
    """One append-only log row; a key in the url is cut off."""
    row = spark.range(1).select(
        F.current_timestamp().alias("ts"), F.lit(source).alias("source"), F.lit(url).alias("url"),
        F.lit(size).cast("long").alias("bytes"), F.lit(digest).alias("sha256"), F.lit(rows).cast("long").alias("rows"), F.lit(note).alias("note"),
    )
    return row.withColumn("url", F.regexp_replace("url", r"([?&])(key|token|apikey)=[^&]*", "$1$2=…"))


def append_manifest(row: DataFrame, path: str) -> None:
    row.coalesce(1).write.mode("append").parquet(path)


def still_to_do(plan: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Units of the plan that are not in the done list."""
    return plan.join(done.select(*keys), list(keys), "left_anti")


def completion(plan: DataFrame, done: DataFrame, keys: Sequence[str], group: str, weight: str) -> DataFrame:
    """Share of units done, and share of weight in groups that are done completely."""
    marked = plan.join(done.select(*keys).distinct().withColumn("__done", F.lit(True)), list(keys), "left").withColumn(
        "__done", F.coalesce("__done", F.lit(False))
    )
    groups = marked.groupBy(group).agg(
        F.count(F.lit(1)).alias("u"), F.count_if("__done").alias("d"), F.sum(weight).alias("w"), F.bool_and("__done").alias("all")
    )
    return groups.agg(
        (F.sum("d") / F.sum("u")).alias("units_done_share"),
        (F.coalesce(F.sum(F.when(F.col("all"), F.col("w"))), F.lit(0)) / F.sum("w")).alias("weight_complete_share"),
        F.count_if("all").alias("groups_complete"),
    )
