"""Live traffic readings: the same summaries on batches and on Structured Streaming."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbline.functions.values import ratio
from kerbline.operators.aggregates import exact_percentiles
from kerbline.operators.ordered import scan
from kerbline.session import shared_folder


# ---------------------------------------------------------------- summaries (batch or stream input)
def minute_floor(ts: Column, minutes: int) -> Column:
    step = minutes * 60
    return F.timestamp_seconds(F.floor(F.unix_micros(ts.cast("timestamp")) / (step * 1_000_000)) * step).cast("timestamp_ntz")


def poll_aggregates(tile: str, piece: str, level: str, closed: Column) -> list[Column]:
    """Tiles, pieces, mean level, slow share and closures of one poll."""
    return [
        F.countDistinct(tile).alias("tiles"),
        F.countDistinct(piece).alias("road_pieces"),
        F.avg(level).alias("mean_level"),
        F.avg((F.col(level) < 0.5).cast("double")).alias("slow_share"),
        F.count_if(closed).alias("closures"),
        F.count(F.lit(1)).alias("readings"),
    ]


def poll_series(df: DataFrame, ts: str, tile: str, piece: str, level: str, closed: Column, minutes: int = 15) -> DataFrame:
    """One row per poll, with the cumulative number of readings."""
    polls = df.groupBy(minute_floor(F.col(ts), minutes).alias("poll")).agg(*poll_aggregates(tile, piece, level, closed))
    return scan(polls, ["poll"], sums={"cumulative_pieces": "road_pieces"})


def point_summary(df: DataFrame, keys: Sequence[str], speed: str, free: str, limit: float = 0.7) -> DataFrame:
    r = ratio(F.col(speed), F.col(free))
    middle = exact_percentiles(df, list(keys), free, {"free_flow": 0.5})
    sums = df.withColumn("__r", r).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("polls"),
        F.avg(speed).alias("mean_speed"),
        F.min("__r").alias("min_ratio"),
        F.avg("__r").alias("mean_ratio"),
        F.count_if(F.col("__r") < limit).alias("readings_below"),
    )
    return sums.join(middle, list(keys), "left")


def hour_profile(tables: Sequence[tuple[DataFrame, str, Column, str]]) -> DataFrame:
    """Hour-of-day means of several sources side by side: (table, time column, measure, name)."""
    out = None
    for df, ts, measure, name in tables:
        part = df.groupBy(F.hour(ts).alias("hour")).agg(F.avg(measure).alias(name))
        out = part if out is None else out.join(part, "hour", "full_outer")
    return out


def collection_status(df: DataFrame, ts: str, piece: str, minutes: int = 15) -> DataFrame:
    seconds = (F.unix_micros(F.max(F.col(ts)).cast("timestamp")) - F.unix_micros(F.min(F.col(ts)).cast("timestamp"))) / 3.6e9
    return df.agg(
        F.min(ts).alias("first_reading"),
        F.max(ts).alias("last_reading"),
        seconds.alias("hours_covered"),
        F.countDistinct(minute_floor(F.col(ts), minutes)).alias("polls"),
        F.count(F.lit(1)).alias("readings"),
        F.countDistinct(piece).alias("pieces"),
    )


def poll_accounting(log: DataFrame, source: str, ok: Column, errors: Column) -> DataFrame:
    return log.groupBy(source).agg(
        F.count(F.lit(1)).alias("polls"), F.sum(ok).cast("long").alias("ok"), F.sum(errors).cast("long").alias("errors"), F.count_if(errors > 0).alias("polls_with_errors")
    )


def live_warnings(ratios: DataFrame, bands: DataFrame, key: str, slow: float = 0.7, band: int = 2) -> DataFrame:
    """Places that are risky by band and slow right now; works with a stream on the left."""
    return ratios.join(bands, key).filter((F.col("mean_ratio") < slow) & (F.col("band") >= band))


# ---------------------------------------------------------------- streams
def file_stream(spark: SparkSession, path: str, schema: T.StructType | None = None, max_files: int | None = None) -> DataFrame:
    """Parquet files arriving in a folder. A path that is one single file is watched through its folder."""
    batch = spark.read.parquet(path)
    reader = spark.readStream.schema(schema or batch.schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isFile():
        folder, name = path.rstrip("/").rsplit("/", 1)
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def without_repeats(stream: DataFrame, ts: str, keys: Sequence[str], delay: str | None = None) -> DataFrame:
    """One reading per key, however late.  Only with a ``delay`` does the state forget keys, and then later readings are dropped."""
    if delay is None:
        return stream.dropDuplicates(list(keys))
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def run_poll_windows(stream: DataFrame, ts: str, tile: str, piece: str, level: str, closed: Column, minutes: int = 15) -> DataFrame:
    """The poll series of a stream, exact and with late readings.

    A batch writes sums per poll, tile and piece into a folder of its own, which a repeated batch writes again; polls
    are put together from these, so no watermark drops a reading and distinct counts stay exact.
    """
    spark = stream.sparkSession
    folder = work_folder(spark, "polls")

    def keep(batch: DataFrame, batch_id: int) -> None:
        level_of = F.col(level)
        batch.groupBy(minute_floor(F.col(ts), minutes).alias("poll"), tile, piece).agg(
            F.count(F.lit(1)).alias("readings"), F.count(level).alias("known"), F.sum(level).alias("level_sum"),
            F.count_if(level_of < 0.5).alias("slow"), F.count_if(closed).alias("closures"),
        ).write.mode("overwrite").parquet(f"{folder}/rows/batch={batch_id}")

    query = stream.writeStream.option("checkpointLocation", f"{folder}/state").foreachBatch(keep)
    query.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/rows").groupBy("poll").agg(
        F.countDistinct(tile).alias("tiles"), F.countDistinct(piece).alias("road_pieces"),
        (F.sum("level_sum") / F.sum("known")).alias("mean_level"), (F.sum("slow") / F.sum("known")).alias("slow_share"),
        F.sum("closures").alias("closures"), F.sum("readings").alias("readings"),
    )


def work_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def run_append(stream: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Run over the files that are there now, into a Parquet table; returns the table."""
    spark = stream.sparkSession
    folder = work_folder(spark, name)
    writer = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{folder}/state")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.option("path", f"{folder}/rows").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def _empty_table(spark: SparkSession, path: str) -> None:
    """A folder that can be read before the first batch has written to it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(place)


def grow_dimension(path: str, key: str, schema: T.StructType, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """foreachBatch writer that stores each key the first time it is seen, in hash buckets.

    A batch reads only the buckets that its keys fall into, and of these only what earlier batches wrote; it
    overwrites its own part of each bucket, so a repeated batch adds nothing.
    """
    stored = T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType()), T.StructField("batch", T.LongType())])

    def add(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        _empty_table(spark, path)
        fresh = batch.dropDuplicates([key]).select(*schema.names).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        fresh = fresh.persist()
        met = [r.bucket for r in fresh.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
        known = spark.read.schema(stored).parquet(path).filter(F.col("bucket").isin(met) & (F.col("batch") < batch_id))
        new = fresh.join(known.select("bucket", F.col(key).alias("__known")), (known["bucket"] == fresh["bucket"]) & (F.col("__known").eqNullSafe(F.col(key))), "left_anti")
        new = new.withColumn("batch", F.lit(batch_id).cast("long"))
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(path)
        fresh.unpersist()

    return add


def run_seen_once(stream: DataFrame, key: str, buckets: int = 64) -> DataFrame:
    """The keys of a stream with the row that brought each first, as a table."""
    spark = stream.sparkSession
    folder = work_folder(spark, "dimension")
    add = grow_dimension(f"{folder}/rows", key, stream.schema, buckets)
    query = stream.writeStream.option("checkpointLocation", f"{folder}/state").foreachBatch(add)
    query.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows").select(*stream.columns)


def write_accounted(folder: str, counts: Mapping[str, Column]) -> Callable[[DataFrame, int], None]:
    """foreachBatch writer of rows and of a manifest row per batch, from metrics observed while the rows are written.

    Rows and manifest are keyed by batch: a repeated batch writes both again in place.
    """

    def keep(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        seen = Observation()
        observed = batch.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(name) for name, c in counts.items()])
        observed.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch_id}")
        got = seen.get
        line = spark.range(1).select(*[F.lit(got[name] or 0).cast("long").alias(name) for name in ("rows", *counts)])
        line.write.mode("overwrite").parquet(f"{folder}/manifest/batch={batch_id}")

    return keep


def run_accounted(stream: DataFrame, counts: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """A stream's rows as a table, and its manifest: batch, rows and the observed counts."""
    spark = stream.sparkSession
    folder = work_folder(spark, "accounted")
    query = stream.writeStream.option("checkpointLocation", f"{folder}/state").foreachBatch(write_accounted(folder, counts))
    query.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/rows"), spark.read.parquet(f"{folder}/manifest")


def islands(df: DataFrame, source: str, starts: str, ends: str, longer_than_s: int) -> DataFrame:
    """(source, starts, ends): stretches without a silence of more than ``longer_than_s``, of readings or of smaller stretches.

    A sweep: a stretch is open from its start until so long after its end, and an island begins where nothing is open.
    Running sums over range slices, so a source with any share of the rows is spread.
    """
    micros = F.unix_micros(F.col(starts).cast("timestamp")), F.unix_micros(F.col(ends).cast("timestamp")) + longer_than_s * 1_000_000
    edges = df.filter(F.col(starts).isNotNull()).select(
        source, F.inline(F.array(F.struct(micros[0].alias("t"), F.lit(1).alias("d")), F.struct(micros[1].alias("t"), F.lit(-1).alias("d"))))
    )
    edges = edges.groupBy(source, "t", "d").agg(F.sum("d").alias("n"))
    at = ["t", -F.col("d")]  # what begins just when another would end goes on with it
    swept = scan(edges, at, [source], sums={"open": "n"})
    begins = (F.col("d") == 1) & (F.col("open") == F.col("n"))
    numbered = scan(swept, at, [source], sums={"island": F.when(begins, 1).otherwise(0).cast("long")})
    made = numbered.groupBy(source, "island").agg(F.min("t").alias("a"), F.max("t").alias("z"))
    kind = df.schema[starts].dataType
    return made.select(source, F.timestamp_micros("a").cast(kind).alias("starts"), F.timestamp_micros(F.col("z") - longer_than_s * 1_000_000).cast(kind).alias("ends"))


def silences(stretches: DataFrame, source: str, longer_than_s: int) -> DataFrame:
    """Gaps between a source's stretches, and an open one where it is still silent: source, gap_starts_after, resumed_at, gap_minutes.

    A source is silent when the newest reading of all is more than ``longer_than_s`` later than its own; an open gap has
    no ``resumed_at`` and lasts until that reading.
    """
    now = stretches.agg(F.max("ends")).scalar()
    next_start = scan(stretches, ["starts"], [source], following={"resumed_at": "starts"}).withColumn("__now", now)
    until = F.coalesce("resumed_at", "__now").cast("timestamp")
    seconds = (F.unix_micros(until) - F.unix_micros(F.col("ends").cast("timestamp"))) / 1_000_000
    return next_start.filter(seconds > longer_than_s).select(
        source, F.col("ends").alias("gap_starts_after"), "resumed_at", F.round(seconds / 60).cast("long").alias("gap_minutes")
    )


def run_outages(stream: DataFrame, source: str, ts: str, longer_than_s: int) -> DataFrame:
    """Outages of a stream's sources, exact however late a reading comes, with those that are still open.

    A batch keeps only its stretches without silence, in a folder of its own that a repeated batch writes again.  A
    gap is a gap of all stretches together, so a late batch closes or splits the gaps that it falls into.
    """
    spark = stream.sparkSession
    folder = work_folder(spark, "outages")

    def keep(batch: DataFrame, batch_id: int) -> None:
        islands(batch, source, ts, ts, longer_than_s).write.mode("overwrite").parquet(f"{folder}/rows/batch={batch_id}")

    query = stream.writeStream.option("checkpointLocation", f"{folder}/state").foreachBatch(keep)
    query.trigger(availableNow=True).start().awaitTermination()
    kept = spark.read.parquet(f"{folder}/rows").drop("batch")
    return silences(islands(kept, source, "starts", "ends", longer_than_s), source, longer_than_s)
