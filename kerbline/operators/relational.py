"""Filters, checked joins, membership flags, key alignment, expansion and sampling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline.operators.ordered import scan


def inside_box(df: DataFrame, lat: str, lon: str, south: float, north: float, west: float, east: float) -> DataFrame:
    """Rows with a position inside the box; NULL positions drop out."""
    return df.filter(F.col(lat).between(south, north) & F.col(lon).between(west, east))


def in_months(df: DataFrame, ts: str, start: str, end: str) -> DataFrame:
    """Rows whose month lies between two 'yyyy-MM' bounds, both inclusive.

    Written as a range on the raw column so the predicate reaches the Parquet scan.
    """
    lower = F.lit(f"{start}-01").cast("date").cast("timestamp_ntz")
    upper = F.add_months(F.lit(f"{end}-01").cast("date"), 1).cast("timestamp_ntz")
    return df.filter((F.col(ts) >= lower) & (F.col(ts) < upper))


def complete_strata(df: DataFrame, stratum: str, is_case: str) -> DataFrame:
    """Matched sets with exactly one case and at least one control."""
    ok = (
        df.groupBy(stratum)
        .agg(F.sum(is_case).alias("__c"), F.count(F.lit(1)).alias("__n"))
        .filter((F.col("__c") == 1) & (F.col("__n") >= 2))
        .select(stratum)
    )
    return df.join(ok, stratum, "left_semi")


def frequent_groups(df: DataFrame, keys: Sequence[str], at_least: int) -> DataFrame:
    """Rows of groups with at least n rows."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= at_least)
    return df.join(sizes.drop("__n"), list(keys), "left_semi")


def plausible_with_rejects(df: DataFrame, value: str, low: float, high: float) -> DataFrame:
    """One row: rows kept, rejected as implausible, missing."""
    ok = F.col(value).between(low, high)
    return df.agg(
        F.count_if(ok).alias("kept"),
        F.count_if(~ok).alias("rejected"),
        F.count_if(F.col(value).isNull()).alias("missing"),
    )


def checked_lookup(left: DataFrame, right: DataFrame, keys: Sequence[str], one_to_one: bool = False) -> DataFrame:
    """Left join that fails the job when the right side (or both, for 1:1) repeats a key."""

    def unique(df: DataFrame, side: str) -> DataFrame:
        rest = [c for c in df.columns if c not in keys]
        packed = df.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("__n"), F.first(F.struct(F.lit(1).alias("__in"), *rest)).alias("__v")
        )
        message = F.concat(F.lit(f"{side} side repeats key "), F.to_json(F.struct(*keys)))
        guarded = F.when(F.col("__n") > 1, F.raise_error(message).cast(packed.schema["__v"].dataType)).otherwise(F.col("__v"))
        return packed.select(*keys, guarded.alias("__v")).select(*keys, *[F.col(f"__v.{c}").alias(c) for c in rest])

    return (unique(left, "left") if one_to_one else left).join(unique(right, "right"), list(keys), "left")


def lookup_or_mean(left: DataFrame, table: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """Attach lookup values; rows without a match take the mean of the lookup table."""
    out = left.join(table.select(key, *values), key, "left")
    for v in values:
        out = out.withColumn(v, F.coalesce(F.col(v), table.agg(F.avg(v)).scalar()))
    return out


def member_flags(df: DataFrame, key: str, groups: Mapping[str, DataFrame]) -> DataFrame:
    """1/0 flags: does the key occur in each group table?"""
    out = df
    for name, members in groups.items():
        ids = members.select(key).distinct().withColumn(name, F.lit(1))
        out = out.join(ids, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def link_with_rate(left: DataFrame, right: DataFrame, keys: Sequence[str], marker: str) -> tuple[DataFrame, DataFrame]:
    """Left join plus a one-row table with the share of linked rows."""
    joined = left.join(right, list(keys), "left")
    rate = joined.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(marker).alias("linked"),
        (F.count(marker) / F.count(F.lit(1))).alias("link_rate"),
    )
    return joined, rate


def align_shares(a: DataFrame, b: DataFrame, keys: Sequence[str], share_a: str, share_b: str) -> DataFrame:
    """Outer alignment of two distributions; absent values have share 0."""
    return (
        a.select(*keys, share_a)
        .join(b.select(*keys, share_b), list(keys), "full_outer")
        .withColumns({s: F.coalesce(F.col(s), F.lit(0.0)) for s in (share_a, share_b)})
    )


def union_tagged(tables: Mapping[str, DataFrame], tag: str) -> DataFrame:
    """Stack aligned tables with a column naming where each row came from."""
    out = None
    for name, df in tables.items():
        part = df.withColumn(tag, F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per key: the lowest in the given order (an aggregate, so hot keys combine map-side)."""
    rest = [c for c in df.columns if c not in keys]
    at = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), at).alias("__b"))
    return best.select(*keys, *[F.col(f"__b.{c}").alias(c) for c in rest])


def sample_rows(df: DataFrame, key: str, k: int, seed: int = 0) -> DataFrame:
    """Repeatable random sample of exactly k rows (all, if fewer): those of the lowest digests of seed and key, ties by key.

    The k-th digest is found by counting: a histogram of four hex digits names the bin that holds it, and the next four
    digits are counted inside that bin.  At most 65,536 counts reach the driver at a time and one filter takes the rows,
    so k is bounded by no task's memory.  Only rows that share 16 digits with the k-th are ordered.
    """
    drawn = df.withColumn("__digest", F.substring(F.md5(F.concat_ws("-", F.lit(seed), F.col(key).cast("string"))), 1, 16))
    prefix, left = "", k
    while len(prefix) < 16 and left > 0:
        inside = drawn.filter(F.col("__digest").startswith(prefix))
        counts = inside.groupBy(F.substring("__digest", 1, len(prefix) + 4).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
        for r in sorted(counts):
            if left <= r.n:
                prefix = r.p
                break
            left -= r.n
        else:
            return df  # fewer than k rows
    if left <= 0:
        return df.limit(0)
    below = drawn.filter(F.col("__digest") < prefix)
    tied = drawn.filter(F.col("__digest") == prefix).orderBy(key).limit(left)
    return below.unionByName(tied).drop("__digest")


def wide_matrix(long: DataFrame, row: str, col: str, value: str, calendar: Sequence, names: Sequence[str], block: int = 200) -> DataFrame:
    """One row per ``row`` and one column per calendar entry, NULL where nothing was measured.

    Columns come from the calendar, not from the data.  They are made in blocks, so a plan holds at most ``block``
    aggregates; repeated values count once, as their mean.
    """
    out = None
    for at in range(0, len(calendar), block):
        cells = [F.avg(F.when(F.col(col) == F.lit(c), F.col(value))).alias(n) for c, n in zip(calendar[at : at + block], names[at : at + block])]
        part = long.groupBy(row).agg(*cells)
        out = part if out is None else out.join(part, row)
    return out if out is not None else long.select(row).distinct()


def expand_offsets(df: DataFrame, ts: str, offsets: Sequence[int], unit: str, name: str = "offset") -> DataFrame:
    """Row x offsets: copies of each row with the time moved by offset units."""
    moved = df.withColumn(name, F.explode(F.array(*[F.lit(o) for o in offsets])))
    return moved.withColumn(ts, F.expr(f"timestampadd({unit}, `{name}`, `{ts}`)").cast(df.schema[ts].dataType))


def split_at_year_ends(df: DataFrame, start: str, end: str) -> DataFrame:
    """Cut a date range at calendar-year borders."""
    years = df.withColumn("year", F.explode(F.sequence(F.year(start), F.year(end))))
    return years.withColumns(
        {
            "part_start": F.greatest(F.col(start).cast("date"), F.make_date("year", F.lit(1), F.lit(1))),
            "part_end": F.least(F.col(end).cast("date"), F.make_date("year", F.lit(12), F.lit(31))),
        }
    )


def top_mass(df: DataFrame, mass: str, key: str, share: float = 0.97) -> DataFrame:
    """Smallest set of groups holding a share of the mass: kept while the share before it is below."""
    ranked = scan(df, [-F.col(mass), F.col(key)], sums={"cum_mass": mass})
    before = (F.col("cum_mass") - F.col(mass)) / df.agg(F.sum(mass)).scalar()
    return ranked.filter(before < share)


def class_filter(tags: Column, rules: Sequence[tuple[str, Sequence[str] | None]]) -> Column:
    """First tag key that qualifies: listed value, or any value when the list is None."""
    out = F.lit(None).cast("string")
    for key, values in reversed(list(rules)):
        v = F.try_element_at(tags, F.lit(key))
        ok = v.isNotNull() if values is None else F.coalesce(v.isin(*values), F.lit(False))
        out = F.when(ok, F.lit(key)).otherwise(out)
    return out


def occurrences(df: DataFrame, keys: Sequence[str], name: str = "times") -> DataFrame:
    """Attach how often the row's key occurs: counts combine map-side, AQE splits a hot key in the join."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    return df.join(sizes, list(keys))


def group_values(df: DataFrame, keys: Sequence[str], aggs: Mapping[str, Column]) -> DataFrame:
    """Attach a group aggregate to its members.

    An aggregate plus a join instead of a key-wide window: counts combine map-side, and in the join AQE
    either broadcasts the small side or splits a hot key over tasks.
    """
    table = df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])
    return df.join(table, list(keys), "left")


def top_n_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """Highest n rows per group; Spark cuts to n per task before the shuffle (window group limit)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank_in_group", F.row_number().over(w)).filter(F.col("rank_in_group") <= n)
