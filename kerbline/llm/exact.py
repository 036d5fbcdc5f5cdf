"""Exact dedup by content sort: equal texts become neighbours, and neighbours are compared in full."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbline.llm.common import SPACE, cut_lineage, parallelism, text_or_empty

HEAD = 24
SAMPLE_PER_SLICE = 32


def normalised(text: str = "text"):
    """The text without white space; null counts as empty."""
    return F.regexp_replace(text_or_empty(text), SPACE, "")


def _keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Sort key of each row: head of the normalised text, its digest, longest original first, smallest id first."""
    return (
        docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("t"))
        .select("id", F.length("t").alias("points"), normalised("t").alias("norm"))
        .select("id", "points", "norm", F.sha2(F.col("norm").cast("binary"), 256).alias("digest"))
        .withColumn("key", F.struct(F.substring("norm", 1, HEAD).alias("head"), "digest", (-F.col("points")).alias("less"), F.col("id")))
    )


def _with_slice(rows: DataFrame, sample: DataFrame, slices: int) -> DataFrame:
    """Number of the range slice between splitters, which are quantiles of the sampled keys."""
    cuts = sample.agg(F.sort_array(F.collect_list("key")).alias("s")).select(
        F.transform(F.sequence(F.lit(1), F.lit(slices - 1)), lambda i: F.get("s", F.floor(i * F.size("s") / slices).cast("int"))).alias("cuts")
    )
    hops = [1 << i for i in reversed(range((slices - 1).bit_length()))]
    found = F.aggregate(
        F.array(*[F.lit(h) for h in hops]), F.lit(0),
        lambda at, hop: F.when(F.get(F.col("cuts"), at + hop - 1) <= F.col("key"), at + hop).otherwise(at),
    )
    return rows.withColumn("cuts", cuts.scalar()).withColumn("slice", found).drop("cuts")


def content_sort(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slices: int | None = None) -> DataFrame:
    """Groups of equal normalised texts: id, keep_id, group_size, kept, text_sha256; one row per input row.

    Rows are range-partitioned by splitters sampled from the sort key, and sorted inside a slice, where each
    row's whole text is compared with its neighbour's.  The key ends in length and id, so a group that holds a
    third of all rows is cut over many slices; a table of the slices' first and last rows (two per slice) joins
    what the cuts separate.  The first row of a group (most code points, then smallest id) stays.

    Defined cases: a null text is an empty one, and all texts without characters other than white space are
    equal; a null id sorts before others; rows that repeat an id and a text are copies like any others, and
    exactly one row of a group has ``kept``; an empty table gives no rows; other columns are ignored.
    """
    slices = slices or parallelism(docs.sparkSession)
    # rows of the sample by hash, in the mean; only their keys travel, and the limit bounds odd tables of equal hashes
    share = min(1.0, slices * SAMPLE_PER_SLICE / max(docs.count(), 1))
    picked = F.shiftrightunsigned(F.xxhash64(id_col, F.length(text_col)), 12) < F.lit(int(share * (1 << 52)))
    sample = _keys(docs.filter(picked), id_col, text_col).select("key").limit(4 * slices * SAMPLE_PER_SLICE)
    rows = _with_slice(_keys(docs, id_col, text_col), sample, max(slices, 2))

    order = Window.partitionBy("slice").orderBy("key.head", "key.digest", "norm", "key.less", "key.id")
    before, after = F.lag("norm").over(order), F.lead("norm").over(order)
    # only the edges of a slice keep their text
    sorted_rows = cut_lineage(
        rows.select("*", before.alias("before"), after.alias("after"), F.row_number().over(order).alias("pos")).select(
            "slice", "pos", "id", "digest",
            (F.col("norm") != F.col("before")).alias("starts"),
            F.when(F.col("before").isNull(), F.col("norm")).alias("first_text"),
            F.when(F.col("after").isNull(), F.col("norm")).alias("last_text"),
        )
    )
    by_slice = Window.orderBy("slice")  # at most one row per slice
    edges = (
        sorted_rows.filter("first_text is not null or last_text is not null")
        .groupBy("slice").agg(F.max("first_text").alias("first_text"), F.max("last_text").alias("last_text"))
        .select("slice", F.coalesce(F.col("first_text") != F.lag("last_text").over(by_slice), F.lit(True)).alias("opens"))
    )
    runs = (
        sorted_rows.join(F.broadcast(edges), "slice")
        .withColumn("starts", F.coalesce("starts", "opens"))
        .withColumn("run", F.sum(F.col("starts").cast("int")).over(Window.partitionBy("slice").orderBy("pos")))
        .withColumn("keep_here", F.first("id").over(Window.partitionBy("slice", "run").orderBy("pos")))
        .withColumn("n_here", F.count(F.lit(1)).over(Window.partitionBy("slice", "run")))
    )
    # a run that began in an earlier slice is run 0 here: it belongs to the last slice before that opened a run
    earlier = by_slice.rowsBetween(Window.unboundedPreceding, -1)
    per_slice = (
        runs.groupBy("slice").agg(
            F.max("run").alias("last_run"), F.count_if(F.col("run") == 0).alias("lead_n"),
            F.max_by(F.struct("keep_here", "n_here"), "pos").alias("tail"),
        )
        .withColumn("opened", F.when(F.col("last_run") > 0, F.col("slice")))
        .withColumn("origin", F.last("opened", True).over(earlier))
        .withColumn("carried", F.last(F.when(F.col("last_run") > 0, F.col("tail")), True).over(earlier))
    )
    spill_over = per_slice.groupBy(F.col("origin").alias("slice")).agg(F.sum("lead_n").alias("more"))
    totals = per_slice.join(spill_over, "slice", "left").select(
        "slice", "last_run", "origin", F.col("carried.keep_here").alias("carried_keep"),
        (F.col("tail.n_here") + F.coalesce("more", F.lit(0))).alias("tail_n"),
    )
    carried_n = totals.select(F.col("slice").alias("origin"), F.col("tail_n").alias("carried_n"))
    totals = F.broadcast(totals.join(carried_n, "origin", "left"))
    lead, tail = F.col("run") == 0, F.col("run") == F.col("last_run")
    return runs.join(totals, "slice").select(
        F.col("id").alias(id_col),
        F.when(lead, F.col("carried_keep")).otherwise(F.col("keep_here")).alias("keep_id"),
        F.when(lead, F.col("carried_n")).when(tail, F.col("tail_n")).otherwise(F.col("n_here")).cast("long").alias("group_size"),
        F.col("starts").alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever their names; of rows equal in id and text, one."""
    kept = content_sort(docs, id_col, text_col).filter("kept").select(F.col(id_col).alias("keep"), F.col("text_sha256").alias("sum"))
    at = {c.lower(): f"c{i}" for i, c in enumerate(docs.columns)}
    own_id, own_text = at[id_col.lower()], at[text_col.lower()]
    marked = docs.toDF(*at.values()).withColumn("own_sum", F.sha2(normalised(own_text).cast("binary"), 256))
    # an equal digest and id may still come with another spelling of the white space: the longest text stays
    points = F.length(text_or_empty(own_text))
    most = Window.partitionBy(own_id, "own_sum").orderBy(points.desc(), F.xxhash64(own_text))
    return (
        marked.join(kept, F.col(own_id).eqNullSafe(F.col("keep")) & (F.col("own_sum") == F.col("sum")), "left_semi")
        .withColumn("nth", F.row_number().over(most)).filter("nth = 1").drop("nth", "own_sum").toDF(*docs.columns)
    )


SQL = r"""
with t as (
  select doc_id, length(coalesce(text, '')) points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') norm from documents
), g as (
  select doc_id, norm, first_value(doc_id) over (partition by norm order by points desc, doc_id) keep_id, count(*) over (partition by norm) group_size from t
)
select doc_id, keep_id, group_size, doc_id = keep_id kept, sha256(norm) text_sha256 from g
"""
