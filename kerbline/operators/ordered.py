"""Running totals, fills and neighbours over one global order, without one-task windows.

A plain window puts a whole partition key, or the whole table when there is no key, in one task.
``scan`` instead cuts the rows into range slices of (partition keys, order keys), runs the window
inside each slice, and repairs the slice borders from a border table.  Slices follow the order, so
a key continues over a border at most once per slice: the border table never has more than two rows
per slice, which is why broadcasting it is safe at any input size.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline.session import parallelism

SAMPLE_PER_SLICE = 64


def _column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def slice_rows(df: DataFrame, key: Column, slices: int, name: str = "__slice", keep_cuts: bool = False) -> DataFrame:
    """Add the range slice of ``key``; slice i lies from ``__cuts[i - 1]`` to before ``__cuts[i]``.

    The cut points come from the rows with the lowest key hashes: a repeatable sample whose size
    depends on the number of slices only.  Re-running a lost task gives the same slices.
    """
    sample = (
        df.select(key.alias("k"))
        .orderBy(F.xxhash64("k"))
        .limit(slices * SAMPLE_PER_SLICE)
        .agg(F.sort_array(F.collect_list("k")).alias("s"))
        .select(
            F.transform(
                F.sequence(F.lit(1), F.lit(slices - 1)),
                lambda i: F.get("s", F.floor(i * F.size("s") / slices).cast("int")),
            ).alias("cuts")
        )
    )
    # a binary search, one projection per step: a higher-order function would leave compiled code for every row
    found = df.withColumns({"__cuts": sample.scalar(), "__key": key, name: F.lit(0)})
    for hop in [1 << i for i in reversed(range((slices - 1).bit_length()))]:
        right = F.get("__cuts", F.col(name) + (hop - 1)) <= F.col("__key")
        found = found.withColumn(name, F.col(name) + F.when(right, hop).otherwise(0))
    return found.drop("__key") if keep_cuts else found.drop("__key", "__cuts")


def scan(
    df: DataFrame,
    order_by: Sequence[str | Column],
    partition_by: Sequence[str] = (),
    *,
    sums: Mapping[str, str | Column] | None = None,
    last_known: Mapping[str, str | Column] | None = None,
    next_known: Mapping[str, str | Column] | None = None,
    previous: Mapping[str, str | Column] | None = None,
    following: Mapping[str, str | Column] | None = None,
    slices: int | None = None,
) -> DataFrame:
    """Window results over (partition_by, order_by), safe for keys of any size.

    ``order_by`` must be a total ascending order inside a partition key (negate a number for
    descending).  ``sums`` are inclusive running totals, ``last_known`` / ``next_known`` the nearest
    non-NULL value at or before / at or after the row, ``previous`` / ``following`` the neighbour row.
    """
    sums, last_known, next_known = sums or {}, last_known or {}, next_known or {}
    previous, following = previous or {}, following or {}
    slices = slices or parallelism(df.sparkSession)
    parts = list(partition_by)
    order = [f"__o{i}" for i in range(len(order_by))]
    groups = {"s": sums, "l": last_known, "n": next_known, "p": previous, "f": following}
    work = df.select(
        "*",
        *[_column(c).alias(name) for name, c in zip(order, order_by)],
        *[_column(c).alias(f"__{tag}{i}") for tag, items in groups.items() for i, c in enumerate(items.values())],
    )
    key = F.struct(*[F.col(p).alias(f"__k{i}") for i, p in enumerate(parts)], *[F.col(o) for o in order])
    work = slice_rows(work, key, slices, keep_cuts=True)
    seams = work
    if parts:
        # only keys that a cut lies in go over a border: their rows alone are aggregated
        beside = [F.get("__cuts", F.col("__slice") + i) for i in (-1, 0)]
        held = [reduce(and_, [F.col(p).eqNullSafe(cut[f"__k{i}"]) for i, p in enumerate(parts)]) for cut in beside]
        # the partition number keeps the filter above the search, which would be made twice below it
        seams = work.withColumn("__seam", (held[0] | held[1]) & (F.spark_partition_id() >= 0)).filter("__seam")
    work = work.drop("__cuts")

    at = F.struct(*[F.col(o) for o in order])
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for i in range(len(sums)):
        aggs.append(F.sum(f"__s{i}").alias(f"__s{i}"))
    for i in range(len(last_known)):
        aggs.append(F.max_by(f"__l{i}", F.when(F.col(f"__l{i}").isNotNull(), at)).alias(f"__l{i}"))
    for i in range(len(next_known)):
        aggs.append(F.min_by(f"__n{i}", F.when(F.col(f"__n{i}").isNotNull(), at)).alias(f"__n{i}"))
    for i in range(len(previous)):
        aggs.append(F.max_by(F.struct(f"__p{i}"), at).alias(f"__p{i}"))
    for i in range(len(following)):
        aggs.append(F.min_by(F.struct(f"__f{i}"), at).alias(f"__f{i}"))
    over_slices = Window.partitionBy(*parts).orderBy("__slice")
    before = over_slices.rowsBetween(Window.unboundedPreceding, -1)
    after = over_slices.rowsBetween(1, Window.unboundedFollowing)
    whole = Window.partitionBy(*parts)
    carried = []
    carried += [F.sum(f"__s{i}").over(before).alias(f"__cs{i}") for i in range(len(sums))]
    carried += [F.last(f"__l{i}", True).over(before).alias(f"__cl{i}") for i in range(len(last_known))]
    carried += [F.first(f"__n{i}", True).over(after).alias(f"__cn{i}") for i in range(len(next_known))]
    carried += [F.lag(f"__p{i}").over(over_slices)[f"__p{i}"].alias(f"__cp{i}") for i in range(len(previous))]
    carried += [F.lead(f"__f{i}").over(over_slices)[f"__f{i}"].alias(f"__cf{i}") for i in range(len(following))]
    borders = (
        seams.groupBy("__slice", *parts)
        .agg(*aggs)
        .withColumn("__spans", F.count(F.lit(1)).over(whole))
        .select(
            F.col("__slice").alias("__e_slice"),
            *[F.col(p).alias(f"__e_{p}") for p in parts],
            "__spans",
            *carried,
        )
        .filter(F.col("__spans") > 1)
    )
    match = F.col("__slice") == F.col("__e_slice")
    for p in parts:
        match = match & F.col(p).eqNullSafe(F.col(f"__e_{p}"))
    joined = work.join(F.broadcast(borders), match, "left")

    local = Window.partitionBy("__slice", *parts).orderBy(*order)
    upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # a frame to the end of the slice would be summed anew for every row; read backwards it is a running one
    back = Window.partitionBy("__slice", *parts).orderBy(*[F.col(o).desc() for o in order])
    onward = back.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = []
    for i, name in enumerate(sums):
        out.append(
            (F.coalesce(F.sum(f"__s{i}").over(upto), F.lit(0)) + F.coalesce(F.col(f"__cs{i}"), F.lit(0))).alias(name)
        )
    for i, name in enumerate(last_known):
        out.append(F.coalesce(F.last(f"__l{i}", True).over(upto), F.col(f"__cl{i}")).alias(name))
    for i, name in enumerate(next_known):
        out.append(F.coalesce(F.last(f"__n{i}", True).over(onward), F.col(f"__cn{i}")).alias(name))
    first_here = F.row_number().over(local) == 1
    for i, name in enumerate(previous):
        out.append(F.when(first_here, F.col(f"__cp{i}")).otherwise(F.lag(f"__p{i}").over(local)).alias(name))
    last_here = F.lead(F.lit(1)).over(local).isNull()
    for i, name in enumerate(following):
        out.append(F.when(last_here, F.col(f"__cf{i}")).otherwise(F.lead(f"__f{i}").over(local)).alias(name))
    made = {*sums, *last_known, *next_known, *previous, *following}
    return joined.select(*[c for c in df.columns if c not in made], *out)


def number_rows(df: DataFrame, order_by: Sequence[str | Column], name: str = "row_no", **kw) -> DataFrame:
    """``row_number()`` over the whole table (or ``partition_by``) without one-task windows."""
    return scan(df, order_by, sums={name: F.lit(1).cast("long")}, **kw)


def total(df: DataFrame, agg: Column) -> Column:
    """A whole-table aggregate as a scalar subquery column."""
    return df.agg(agg).scalar()
