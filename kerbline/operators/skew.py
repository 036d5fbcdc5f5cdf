"""Joins that survive a key holding a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.session import parallelism

#: Rows of the smaller side of a join that may go to every task; more are shuffled.
FEW_ROWS = 100_000


def tasks_for(df: DataFrame, rows: int) -> int:
    """Tasks that hold about so many rows each, counted now; never fewer than the session's."""
    return max(parallelism(df.sparkSession), -(-df.count() // rows))


def salted_join(
    many: DataFrame, few: DataFrame, keys: Sequence[str], how: str = "inner", salt_on: Sequence[str] = ()
) -> DataFrame:
    """Equi-join where hot keys of ``many`` are split over several tasks.

    A key is hot when it holds more than 1/(4·tasks) of all rows, so there are fewer than 4·tasks hot
    keys: that bounds the broadcast table.  Rows of ``few`` are copied once per salt of their key only.
    The planner's guess of a side's size knows nothing of exploded rows, so it does not choose what is broadcast:
    ``many`` is, where it is counted to have few rows, and else both sides are shuffled and sorted.
    """
    if how not in ("inner", "left"):
        raise ValueError("salted_join keeps inner and left joins exact")
    tasks = parallelism(many.sparkSession)
    sizes = many.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    fair = sizes.agg((F.sum("__n") / (4 * tasks)).alias("t")).scalar()
    hot = (
        sizes.withColumn("__fair", F.greatest(fair, F.lit(1.0)))
        .filter(F.col("__n") > F.col("__fair"))
        .select(*[F.col(k).alias(f"__h_{k}") for k in keys], F.ceil(F.col("__n") / F.col("__fair")).cast("int").alias("__salts"))
    )
    match = F.lit(True)
    for k in keys:
        match = match & (F.col(k) == F.col(f"__h_{k}"))
    hot = F.broadcast(hot)
    seed = [F.col(c) for c in (salt_on or many.columns)]
    left = many.join(hot, match, "left").withColumn(
        "__salt", F.pmod(F.xxhash64(*seed), F.coalesce("__salts", F.lit(1))).cast("int")
    )
    right = few.join(hot, match, "left").withColumn(
        "__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))
    )
    drop = ["__salts", *[f"__h_{k}" for k in keys]]
    left, right = left.drop(*drop), right.drop(*drop)
    if how == "inner" and many.limit(FEW_ROWS + 1).count() <= FEW_ROWS:
        left = F.broadcast(left)
    else:
        right = right.hint("merge")
    return left.join(right, [*keys, "__salt"], how).drop("__salt")
