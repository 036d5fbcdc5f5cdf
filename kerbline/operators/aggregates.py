"""Group statistics: shares, cross-tabs, percentiles, scorecards, profiles, traffic-count tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline.operators.ordered import scan, total
from kerbline.operators.relational import align_shares


def period_counts(df: DataFrame, key: str, periods: Mapping[str, Column]) -> DataFrame:
    """One conditional aggregate for all periods; rows without a key are not counted."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(*[F.count_if(c).alias(n) for n, c in periods.items()])


def with_zero_counts(entities: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """Left join of counts; entities without any event get zeros."""
    names = [c for c in counts.columns if c != key]
    return entities.join(counts, key, "left").withColumns({n: F.coalesce(F.col(n), F.lit(0)) for n in names})


def value_shares(df: DataFrame, keys: Sequence[str], count: str = "n", share: str = "share") -> DataFrame:
    """Value counts with their share of all rows; NULL keys are left out."""
    known = df.dropna(subset=list(keys))
    counts = known.groupBy(*keys).agg(F.count(F.lit(1)).alias(count))
    return counts.withColumn(share, F.col(count) / total(counts, F.sum(count)))


def cross_tab(df: DataFrame, row: str, col: str, levels: Sequence, by: str = "row") -> DataFrame:
    """Counts of row x level plus shares within the row or within the column."""
    counts = df.filter(F.col(row).isNotNull()).groupBy(row).pivot(col, list(levels)).count().na.fill(0)
    if by == "row":
        width = sum((F.col(f"`{v}`") for v in levels[1:]), F.col(f"`{levels[0]}`"))
        return counts.withColumns({f"{v}_share": F.col(f"`{v}`") / width for v in levels})
    sums = counts.agg(*[F.sum(f"`{v}`").alias(f"t{i}") for i, v in enumerate(levels)])
    return counts.withColumns(
        {f"{v}_share": F.col(f"`{v}`") / sums.select(f"t{i}").scalar() for i, v in enumerate(levels)}
    )


def stats_pack(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """n, mean, sample sd, p15, p50, p85, p98, min, max (linear percentiles)."""
    plain = df.groupBy(*keys).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("sd"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    ranks = exact_percentiles(df, keys, value, {"p15": 0.15, "p50": 0.5, "p85": 0.85, "p98": 0.98})
    return plain.join(ranks, list(keys), "left")


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, wanted: Mapping[str, float], weibull: bool = False) -> DataFrame:
    """Exact percentiles of groups of any size: linear (rank 1 + q·(n-1)) or Weibull (rank q·(n+1)).

    Spark's own ``percentile`` holds every distinct value of a group in one task. Here the values of a
    group are counted, put in order in slices, and only the two neighbours of each rank are kept.
    """
    known = df.filter(F.col(value).isNotNull())
    per_value = known.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c"))
    run = scan(per_value, [value], keys, sums={"__hi": "__c"})
    sizes = per_value.groupBy(*keys).agg(F.sum("__c").alias("__n"))
    ranked = run.join(sizes, list(keys)) if keys else run.withColumn("__n", sizes.scalar())

    def rank(q: float, n: Column) -> Column:
        if not weibull:
            return 1 + q * (n - 1)
        return F.greatest(F.lit(1.0), F.least(q * (n + 1), n.cast("double")))

    def at(r: Column) -> Column:
        return F.max(F.when((F.col("__hi") >= r) & (F.col("__hi") - F.col("__c") < r), F.col(value)))

    aggs = [F.max("__n").alias("__n")]
    for i, q in enumerate(wanted.values()):
        h = rank(q, F.col("__n"))
        aggs += [at(F.floor(h)).alias(f"__lo{i}"), at(F.ceil(h)).alias(f"__up{i}")]
    out = ranked.groupBy(*keys).agg(*aggs)
    made = []
    for i, (name, q) in enumerate(wanted.items()):
        h = rank(q, F.col("__n"))
        made.append((F.col(f"__lo{i}") + (h - F.floor(h)) * (F.col(f"__up{i}") - F.col(f"__lo{i}"))).alias(name))
    return out.select(*keys, *made)


def weibull_percentiles(df: DataFrame, keys: Sequence[str], value: str, qs: Sequence[float]) -> DataFrame:
    """Percentiles with rank h = q·(n+1), with the group size."""
    sizes = df.groupBy(*keys).agg(F.count(value).alias("n"))
    return sizes.join(exact_percentiles(df, keys, value, {f"w{round(q * 100)}": q for q in qs}, weibull=True), list(keys))


def field_profile(df: DataFrame, fields: Sequence[str], vague: Sequence[str]) -> DataFrame:
    """Blank, vague and usable share of each text field, from one pass over the rows."""
    aggs = [F.count(F.lit(1)).alias("__n")]
    for i, f in enumerate(fields):
        text = F.lower(F.trim(F.col(f).cast("string")))
        blank = F.col(f).isNull() | (text == "")
        aggs += [
            F.count_if(blank).alias(f"b{i}"),
            F.count_if(~blank & text.isin(*[v.lower() for v in vague])).alias(f"v{i}"),
        ]
    one = df.agg(*aggs)
    rows = [
        F.struct(F.lit(f).alias("field"), F.col(f"b{i}").alias("blank"), F.col(f"v{i}").alias("vague"))
        for i, f in enumerate(fields)
    ]
    long = one.select("__n", F.inline(F.array(*rows)))
    return long.select(
        "field",
        (F.col("blank") / F.col("__n")).alias("blank_share"),
        (F.col("vague") / F.col("__n")).alias("vague_share"),
        ((F.col("__n") - F.col("blank") - F.col("vague")) / F.col("__n")).alias("usable_share"),
    )


def missing_and_zero(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Missing share and zero share per numeric column, one pass."""
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.avg(F.col(c).isNull().cast("double")).alias(f"m{i}"), F.avg(F.coalesce(F.col(c) == 0, F.lit(False)).cast("double")).alias(f"z{i}")]
    rows = [F.struct(F.lit(c).alias("feature"), F.col(f"m{i}").alias("missing_share"), F.col(f"z{i}").alias("zero_share")) for i, c in enumerate(cols)]
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def data_dictionary(df: DataFrame, table: str, notes: Mapping[str, str]) -> DataFrame:
    """Column, type, non-null count and description, from the schema and one pass."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)])
    rows = [
        F.struct(
            F.lit(table).alias("table_name"),
            F.lit(c).alias("column_name"),
            F.lit(t).alias("data_type"),
            F.col(f"c{i}").alias("non_null"),
            F.lit(notes.get(c, "")).alias("description"),
        )
        for i, (c, t) in enumerate(df.dtypes)
    ]
    return counts.select(F.inline(F.array(*rows)))


def share_distance(df: DataFrame, subset: Column, features: Sequence[str], per: Sequence[str] = ()) -> DataFrame:
    """Total variation distance between a subset and the whole, per feature: half the sum of |p - q|."""
    long = df.select(
        *per,
        subset.alias("__in"),
        F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("value")) for f in features])),
    ).filter(F.col("value").isNotNull())
    counts = long.groupBy("feature", "value").agg(
        F.count(F.lit(1)).alias("n_all"), F.count_if(F.col("__in")).alias("n_sub")
    )
    totals = counts.groupBy("feature").agg(F.sum("n_all").alias("t_all"), F.sum("n_sub").alias("t_sub"))
    gap = F.abs(F.col("n_sub") / F.col("t_sub") - F.col("n_all") / F.col("t_all"))
    return counts.join(totals, "feature").groupBy("feature").agg((F.sum(gap) / 2).alias("distance"))


def group_share_distance(df: DataFrame, group: str, feature: str) -> DataFrame:
    """Total variation distance of every group's feature mix from the overall mix."""
    both = df.filter(F.col(group).isNotNull() & F.col(feature).isNotNull())
    cells = both.groupBy(group, feature).agg(F.count(F.lit(1)).alias("n"))
    sizes = cells.groupBy(group).agg(F.sum("n").alias("size"))
    overall = cells.groupBy(feature).agg(F.sum("n").alias("m"))
    q = overall.withColumn("q", F.col("m") / total(cells, F.sum("n")))
    # values a group never shows add q each: Σ|p−q| = Σ_seen(|p−q| − q) + 1
    seen = cells.join(sizes, group).join(q, feature)
    p = F.col("n") / F.col("size")
    return seen.groupBy(group).agg(((F.sum(F.abs(p - F.col("q")) - F.col("q")) + 1) / 2).alias("distance"))


def overlapping_groups(df: DataFrame, groups: Mapping[str, Column], aggs: Sequence[Column], name: str = "region") -> DataFrame:
    """Aggregate over groups a row can belong to several of: explode the matching names, one groupBy."""
    names = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in groups.items()]))
    return df.withColumn(name, F.explode(names)).groupBy(name).agg(*aggs)


def transposed(df: DataFrame, label: str, measures: Sequence[str], columns: Sequence[str], name: str = "measure") -> DataFrame:
    """Measures as rows and labels as columns."""
    long = df.select(label, F.inline(F.array(*[F.struct(F.lit(m).alias(name), F.col(m).cast("double").alias("__v")) for m in measures])))
    return long.groupBy(name).pivot(label, list(columns)).agg(F.first("__v"))


def exposure_ratio(df: DataFrame, cls: str, at_fault: Column) -> DataFrame:
    """Share of a class among the at-fault over its share among the others."""
    counts = df.filter(F.col(cls).isNotNull()).groupBy(cls).agg(F.count_if(at_fault).alias("fault"), F.count_if(~at_fault).alias("other"))
    share = lambda c: F.col(c) / total(counts, F.sum(c))
    return counts.withColumns({"share_fault": share("fault"), "share_other": share("other")}).withColumn(
        "ratio", F.col("share_fault") / F.nullif(F.col("share_other"), F.lit(0.0))
    )


def pair_configuration(df: DataFrame, key: str, cls: str, extra: Sequence[Column], by: Sequence[str] = (), sep: str = " – ") -> DataFrame:
    """Events with exactly two parties, counted by their sorted pair of classes.

    Only min, max and count per event are kept, so an event with many parties never becomes a list.
    """
    parties = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), F.min(cls).alias("__a"), F.max(cls).alias("__b"), *extra)
    pairs = parties.filter(F.col("__n") == 2).withColumn("pair", F.concat_ws(sep, "__a", "__b"))
    return pairs.groupBy("pair", *by)


def joined_values(df: DataFrame, keys: Sequence[str], value: str, sep: str = ";") -> DataFrame:
    """Sorted distinct values of a group joined to one text; for columns with few distinct values."""
    return df.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set(value)), sep).alias(value))


def other_side(classes: Column, own: Column) -> Column:
    """The classes of the other parties of an event; the own class again when all are alike, 'other' when unknown."""
    rest = F.array_except(classes, F.array(own))
    return F.when(own.isNull(), "other").when(F.size(rest) > 0, F.array_join(F.array_sort(rest), " – ")).otherwise(own)


def weighted_counts(df: DataFrame, factors: Mapping[str, float], cls: str, count: Column, keys: Sequence[str]) -> DataFrame:
    """Class counts times vehicle-equivalent factors."""
    from kerbline.functions.values import mapped

    weighted = count * mapped(F.col(cls), factors, 1.0)
    return df.groupBy(*keys).agg(F.sum(count).cast("long").alias("vehicles"), F.sum(weighted).alias("equivalents"))


def peak_hour(df: DataFrame, keys: Sequence[str], quarter: str, volume: str) -> DataFrame:
    """Highest total over four consecutive quarter-hours and the peak-hour factor."""
    quarters = df.groupBy(*keys, quarter).agg(F.sum(volume).alias("__v"))
    # one row per quarter-hour: a key's window is as long as the calendar, whatever the traffic
    w = Window.partitionBy(*keys).orderBy(quarter)
    lags = [F.lag("__v", k).over(w) for k in (1, 2, 3)]
    full = quarters.withColumns(
        {
            "__hour": F.col("__v") + lags[0] + lags[1] + lags[2],
            "__top": F.greatest(F.col("__v"), *lags),
        }
    ).filter(F.col("__hour").isNotNull())
    earliest = F.struct("__hour", -F.unix_micros(F.col(quarter).cast("timestamp")))
    return full.groupBy(*keys).agg(
        F.max("__hour").alias("peak_hour_volume"),
        F.max_by(F.col("__hour") / (4 * F.col("__top")), earliest).alias("peak_hour_factor"),
    )


def od_expansion(trips: DataFrame, counted: DataFrame, interviewed: DataFrame, mode: str, trip_count: str) -> DataFrame:
    """Scale sampled trips by counted / interviewed per mode."""
    factor = counted.join(interviewed, mode).withColumn("factor", F.col("counted") / F.col("interviewed"))
    return trips.join(factor.select(mode, "factor"), mode).withColumn("expanded", F.col(trip_count) * F.col("factor"))


def moving_observer(runs: DataFrame, site: str, direction: str) -> DataFrame:
    """Flow, stream travel time, speed and density from paired test runs in both directions.

    Each site's two directions meet in one aggregate instead of a self-join.
    Columns used: length_km, travel_h, opposite, overtaking, overtaken.
    """
    pick = lambda c, d: F.max(F.when(F.col(direction) == d, F.col(c)))
    cols = ["length_km", "travel_h", "opposite", "overtaking", "overtaken"]
    wide = runs.groupBy(site).agg(*[pick(c, d).alias(f"{c}_{d}") for c in cols for d in (0, 1)])
    sides = [
        F.struct(
            F.lit(d).alias(direction),
            *[F.col(f"{c}_{d}").alias(c) for c in cols],
            F.col(f"opposite_{1 - d}").alias("met"),
            F.col(f"travel_h_{1 - d}").alias("other_h"),
        )
        for d in (0, 1)
    ]
    s = wide.select(site, F.inline(F.array(*sides))).filter(F.col("travel_h").isNotNull() & F.col("other_h").isNotNull())
    flow = (F.col("met") + F.col("overtaking") - F.col("overtaken")) / (F.col("travel_h") + F.col("other_h"))
    s = s.withColumn("flow", flow)
    s = s.withColumn("stream_h", F.col("travel_h") - (F.col("overtaking") - F.col("overtaken")) / F.nullif(F.col("flow"), F.lit(0.0)))
    s = s.withColumn("speed", F.col("length_km") / F.nullif(F.col("stream_h"), F.lit(0.0)))
    return s.withColumn("density", F.col("flow") / F.nullif(F.col("speed"), F.lit(0.0)))


def histogram(df: DataFrame, value: str, width: float) -> DataFrame:
    """Fixed-width bins with relative frequency and the running check total."""
    bins = df.filter(F.col(value).isNotNull()).groupBy(F.floor(F.col(value) / width).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    run = scan(bins, ["bin"], sums={"upto": "n"})
    return run.withColumns({"bin_start": F.col("bin") * width, "share": F.col("n") / total(bins, F.sum("n"))})


def repeated_positions(df: DataFrame, lat: str, lon: str, at_least: int = 5, decimals: int = 5) -> DataFrame:
    """Positions written identically many times."""
    spots = df.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull()).groupBy(
        F.bround(lat, decimals).alias("lat"), F.bround(lon, decimals).alias("lon")
    )
    return spots.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= at_least)


def grid_hotspots(df: DataFrame, lat: Column, lon: Column, severe: Column, label: str, label_key: str, at_least: int) -> DataFrame:
    """Cells with their counts, severe counts, a representative label and the share of all rows."""
    cells = df.groupBy(lat.alias("cell_lat"), lon.alias("cell_lon")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(severe).alias("severe"), F.min_by(label, label_key).alias("label")
    )
    return cells.filter(F.col("n") >= at_least).withColumn("share", F.col("n") / total(cells, F.sum("n")))


def condition_table(df: DataFrame, conditions: Mapping[str, Column], outcomes: Mapping[str, Column]) -> DataFrame:
    """Rows and outcome shares inside and outside each condition."""
    long = df.select(
        *[c.cast("double").alias(n) for n, c in outcomes.items()],
        F.inline(F.array(*[F.struct(F.lit(n).alias("condition"), c.alias("in_condition")) for n, c in conditions.items()])),
    ).filter(F.col("in_condition").isNotNull())
    return long.groupBy("condition", "in_condition").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(n).alias(f"{n}_share") for n in outcomes]
    )


def delay_profile(df: DataFrame, delay: Column, keys: Sequence[str], low: float, high: float, over: float) -> DataFrame:
    """Median delay and share over a limit after dropping implausible delays."""
    ok = df.select(*keys, delay.alias("__d")).filter(F.col("__d").between(low, high))
    plain = ok.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("__d") > over).cast("double")).alias("share_over"))
    return plain.join(exact_percentiles(ok, keys, "__d", {"median": 0.5}), list(keys))


def monthly_counts(df: DataFrame, ts: str, keys: Sequence[str], counts: Mapping[str, Column]) -> DataFrame:
    return (
        df.filter(F.col(ts).isNotNull())
        .groupBy(*keys, F.date_format(ts, "yyyy-MM").alias("month"))
        .agg(*[F.count_if(c).alias(n) for n, c in counts.items()])
    )


def period_growth(df: DataFrame, ts: str, key: str, first_year: int, last_year: int) -> DataFrame:
    """Mean monthly count per period over months that contain data, and their ratio."""
    month, year = F.date_format(ts, "yyyy-MM"), F.year(ts)
    monthly = df.groupBy(key, year.alias("y"), month.alias("m")).agg(F.count(F.lit(1)).alias("n"))
    mean = lambda y: F.avg(F.when(F.col("y") == y, F.col("n")))
    return monthly.groupBy(key).agg(
        mean(first_year).alias("first_mean"), mean(last_year).alias("last_mean"), (mean(last_year) / mean(first_year)).alias("growth")
    )


def aligned_difference(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Two share tables side by side with their difference."""
    both = align_shares(a, b, keys, "share_a", "share_b")
    return both.withColumn("difference", F.col("share_a") - F.col("share_b"))
