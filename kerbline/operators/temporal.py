"""Series operators: offset lookups, nearest in time, gaps, stabs, islands, matched designs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.operators.ordered import scan
from kerbline.session import cut_lineage


def micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def offset_values(df: DataFrame, keys: Sequence[str], hour: str, value: str, lags: Sequence[int]) -> DataFrame:
    """Value exactly k hours earlier for the same key; NULL when that hour is missing.

    Each row is sent to its own hour and to the later hours that look back at it, and one aggregate
    puts them together: a single shuffle on (key, hour), no self-join.
    """
    sent = df.select(*keys, hour, value).withColumn("__k", F.explode(F.array(*[F.lit(k) for k in (0, *lags)])))
    sent = sent.withColumn(hour, F.expr(f"timestampadd(HOUR, __k, `{hour}`)").cast(df.schema[hour].dataType))
    aggs = [F.count_if(F.col("__k") == 0).alias("__own"), F.max(F.when(F.col("__k") == 0, F.col(value))).alias(value)]
    aggs += [F.max(F.when(F.col("__k") == k, F.col(value))).alias(f"{value}_lag{k}") for k in lags]
    return sent.groupBy(*keys, hour).agg(*aggs).filter(F.col("__own") > 0).drop("__own")


def lag_build_up(df: DataFrame, value: str, lags: Sequence[int]) -> DataFrame:
    """Sum over lags counts missing as 0; minimum skips missing and is NULL when all are missing."""
    cols = [F.col(f"{value}_lag{k}") for k in lags]
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cols[1:]), F.coalesce(cols[0], F.lit(0.0)))
    return df.withColumns({f"{value}_prev_sum": total, f"{value}_prev_min": F.least(*cols)})


def nearest_in_time(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_ts: str,
    right_ts: str,
    tolerance_s: int,
    values: Sequence[str],
    left_id: str,
) -> DataFrame:
    """As-of nearest within a tolerance, the earlier report on a tie.

    Both sides are stacked in one time order and the last report before and first report after each
    row are filled in, so the cost is linear: no candidate pairs, and a busy station is cut into slices.
    """
    report = F.struct(F.col(right_ts).alias("at"), *values)
    one = right.filter(F.col(right_ts).isNotNull()).groupBy(*keys, right_ts)
    reports = one.agg(F.min(F.struct(*values)).alias("__v")).select(*keys, right_ts, "__v.*")
    stacked = left.select(
        *keys, F.col(left_ts).alias("__t"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__row")
    ).unionByName(
        reports.select(*keys, F.col(right_ts).alias("__t"), F.lit(0).alias("__side"), report.alias("__rep")),
        allowMissingColumns=True,
    )
    filled = scan(
        stacked,
        ["__t", "__side", F.col(f"__row.{left_id}")],
        keys,
        last_known={"__before": "__rep"},
        next_known={"__after": "__rep"},
    ).filter(F.col("__side") == 1)
    gap = lambda c: F.abs(micros(F.col(f"{c}.at")) - micros(F.col("__t")))
    before_wins = F.col("__after").isNull() | (gap("__before") <= gap("__after"))
    best = F.when(F.col("__before").isNotNull() & before_wins, F.col("__before")).otherwise(F.col("__after"))
    chosen = filled.select("__row", "__t", best.alias("__best"))
    close = F.abs(micros(F.col("__best.at")) - micros(F.col("__t"))) <= tolerance_s * 1_000_000
    chosen = chosen.withColumn("__best", F.when(close, F.col("__best")))
    return chosen.select(
        "__row.*",
        F.col("__best.at").alias(f"matched_{right_ts}"),
        *[F.col(f"__best.{v}").alias(f"matched_{v}") for v in values],
        F.bround((micros(F.col("__best.at")) - micros(F.col("__t"))) / 6e7).cast("int").alias("offset_min"),
    )


def gaps(df: DataFrame, ts: str, longer_than_s: int, keys: Sequence[str] = (), tie: Sequence[str] = ()) -> DataFrame:
    """Silent stretches longer than a threshold: last seen, resumed at, minutes."""
    seen = scan(df, [ts, *tie], keys, previous={"gap_starts_after": ts})
    seconds = (micros(F.col(ts)) - micros(F.col("gap_starts_after"))) / 1e6
    return seen.filter(seconds > longer_than_s).select(
        *keys, "gap_starts_after", F.col(ts).alias("resumed_at"), F.bround(seconds / 60).cast("long").alias("gap_minutes")
    )


def occupancy(stays: DataFrame, start: str, end: str, instants: DataFrame, at: str) -> DataFrame:
    """How many stays cover each instant (start <= t < end), by a sweep of +1/-1 steps."""
    steps = (
        stays.select(F.explode(F.array(F.struct(F.col(start).alias("t"), F.lit(1).alias("d")), F.struct(F.col(end).alias("t"), F.lit(-1).alias("d")))).alias("s"))
        .groupBy("s.t")
        .agg(F.sum("s.d").cast("long").alias("d"))
        .select("t", F.lit(0).alias("side"), "d")
    )
    asked = instants.select(F.col(at).alias("t")).distinct().select("t", F.lit(1).alias("side"), F.lit(0).cast("long").alias("d"))
    swept = scan(steps.unionByName(asked), ["t", "side"], sums={"occupied": "d"})
    return swept.filter(F.col("side") == 1).select(F.col("t").alias(at), "occupied")


def date_islands(df: DataFrame, keys: Sequence[str], date: str) -> DataFrame:
    """Runs of consecutive dates per key."""
    days = df.select(*keys, date).distinct()
    # the run numbers need a second scan over the first one's result: write that result once
    marked = cut_lineage(scan(days, [date], keys, previous={"__prev": date}))
    starts = F.when(F.datediff(date, "__prev") == 1, 0).otherwise(1)
    runs = scan(marked, [date], keys, sums={"run_no": starts})
    return runs.groupBy(*keys, "run_no").agg(
        F.min(date).alias("start"), F.max(date).alias("end"), F.count(F.lit(1)).alias("days")
    )


def request_runs(df: DataFrame, keys: Sequence[str], date: str, weeks: int = 2) -> DataFrame:
    """Greedy runs of needed dates: extend a run while one longer request is not dearer than two.

    A request costs max(1, days / (7·weeks)).  The rule is sequential, so it folds over the sorted
    distinct dates of one key; a key has at most one entry per calendar day.
    """
    span = 7 * weeks
    cost = lambda days: F.greatest(F.lit(1.0), days / span)
    dates = df.groupBy(*keys).agg(F.array_sort(F.collect_set(F.col(date).cast("date"))).alias("ds"))
    run = lambda s, e: F.struct(s.alias("start"), e.alias("end"))

    def step(acc: Column, d: Column) -> Column:
        last = F.element_at(acc, -1)
        merged = cost(F.datediff(d, last["start"]) + 1)
        apart = cost(F.datediff(last["end"], last["start"]) + 1) + 1
        extended = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(run(last["start"], d)))
        return F.when(merged <= apart, extended).otherwise(F.concat(acc, F.array(run(d, d))))

    first = F.element_at("ds", 1)
    folded = F.aggregate(F.slice("ds", F.lit(2), F.size("ds")), F.array(run(first, first)), step)
    return (
        dates.select(*keys, F.inline(folded))
        .withColumn("days", F.datediff("end", "start") + 1)
        .withColumn("est_weight", F.bround(F.greatest(F.lit(1.0), F.col("days") / span), 2))
    )


def case_crossover(
    cases: DataFrame, ts: str, case_only: Sequence[str] = (), weeks: int = 4, stratum: str | None = None
) -> DataFrame:
    """Time-stratified controls: same weekday and clock time in the same calendar month as the case."""
    out = cases.withColumn("offset_days", F.explode(F.array(*[F.lit(7 * k) for k in range(-weeks, weeks + 1)])))
    moved = F.expr(f"timestampadd(DAY, offset_days, `{ts}`)").cast(cases.schema[ts].dataType)
    out = out.withColumn("__t", moved).filter(
        (F.year("__t") == F.year(ts)) & (F.month("__t") == F.month(ts))
    )
    out = out.withColumns({ts: F.col("__t"), "is_case": (F.col("offset_days") == 0).cast("int")}).drop("__t")
    for c in case_only:
        out = out.withColumn(c, F.when(F.col("is_case") == 1, F.col(c)))
    return out.withColumnRenamed(stratum, "stratum_id") if stratum else out


def needed_hours(place_hours: DataFrame, key: str, hour: str, lags: int = 3) -> DataFrame:
    """Distinct (key, hour) each place-hour needs: its own hour and the hours before it."""
    back = place_hours.filter(F.col(key).isNotNull()).select(key, hour)
    back = back.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(lags))))
    return back.select(key, F.expr(f"timestampadd(HOUR, -__k, `{hour}`)").cast(place_hours.schema[hour].dataType).alias(hour)).distinct()


def full_calendar(points: DataFrame, start: Column, end: Column, hour: str = "hour") -> DataFrame:
    """Every point x every hour between two times (exploded per point, no join)."""
    return points.withColumn(hour, F.explode(F.sequence(start, end, F.expr("INTERVAL 1 HOUR"))))


def mantel_haenszel(df: DataFrame, stratum: str, is_case: str, exposed: str) -> DataFrame:
    """Matched odds ratio over 1:m sets with the Robins-Breslow-Greenland 95% interval."""
    d = df.filter(F.col(exposed).isNotNull())
    case = F.col(is_case) == 1
    sets = (
        d.groupBy(stratum)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(is_case).alias("cases"),
            F.sum(exposed).alias("exp_total"),
            F.max(F.when(case, F.col(exposed))).alias("a"),
        )
        .filter((F.col("cases") == 1) & (F.col("n") >= 2))
    )
    a, n = F.col("a"), F.col("n")
    c, m = F.col("exp_total") - a, F.col("n") - 1
    sets = sets.withColumns({"r": a * (m - c) / n, "s": (1 - a) * c / n, "p": (a + (m - c)) / n, "q": ((1 - a) + c) / n})
    s = sets.agg(
        F.sum("r").alias("R"), F.sum("s").alias("S"),
        F.sum(F.col("p") * F.col("r")).alias("PR"), F.sum(F.col("p") * F.col("s")).alias("PS"),
        F.sum(F.col("q") * F.col("r")).alias("QR"), F.sum(F.col("q") * F.col("s")).alias("QS"),
        F.count(F.lit(1)).alias("sets_used"), F.sum("a").cast("long").alias("cases_exposed"),
    )
    R, S = F.nullif(F.col("R"), F.lit(0.0)), F.nullif(F.col("S"), F.lit(0.0))
    var = F.col("PR") / (2 * R * R) + (F.col("PS") + F.col("QR")) / (2 * R * S) + F.col("QS") / (2 * S * S)
    return s.select(
        (R / S).alias("odds_ratio"),
        F.exp(F.log(R / S) - 1.96 * F.sqrt(var)).alias("ci_low"),
        F.exp(F.log(R / S) + 1.96 * F.sqrt(var)).alias("ci_high"),
        "sets_used",
        "cases_exposed",
    )


def reading_of(low: Column, high: Column) -> Column:
    return F.when(high < 1, "fewer events").when(low > 1, "more events").otherwise("no clear change")


def safe_multiplier(odds: Column, low: Column) -> Column:
    """The odds ratio only when its lower bound is above 1, else exactly 1."""
    return F.when(low > 1, F.bround(odds, 3)).otherwise(F.lit(1.0))


def agreement(df: DataFrame, said: Column, measured: Column) -> DataFrame:
    """Share measured given said, given not said, and how many said so."""
    return df.agg(
        F.avg(F.when(said, measured)).alias("share_when_said"),
        F.avg(F.when(~said, measured)).alias("share_when_not_said"),
        F.count_if(said).alias("n_said"),
    )


def latest_wins(df: DataFrame, key: str, order: Sequence[str], content: Sequence[str]) -> DataFrame:
    """Label every copy of a key: kept, identical duplicate, or superseded by a newer one."""
    at = F.struct(*[F.col(o) for o in order])
    digest = F.sha2(F.to_json(F.struct(*content), {"ignoreNullFields": "false"}), 256)
    rows = df.withColumns({"__at": at, "__digest": digest})
    # distinct contents per key are counted in two steps so one hot key is combined map-side
    versions = rows.groupBy(key, "__digest").agg(F.max("__at").alias("__at"))
    chosen = versions.groupBy(key).agg(F.max("__at").alias("__top"), F.count(F.lit(1)).alias("__versions"))
    joined = rows.join(chosen, key)
    status = (
        F.when(F.col("__at") == F.col("__top"), "kept")
        .when(F.col("__versions") == 1, "duplicate (identical content)")
        .otherwise("duplicate (superseded by newer report)")
    )
    return joined.withColumn("status", status).drop("__at", "__digest", "__top", "__versions")


def conditional_counts(df: DataFrame, keys: Sequence[str], counts: Mapping[str, Column]) -> DataFrame:
    """Several conditional counts per key in one aggregate."""
    return df.groupBy(*keys).agg(*[F.count_if(c).alias(n) for n, c in counts.items()])


def turn_contrast(df: DataFrame, way: str, order: Sequence[str], value: str) -> DataFrame:
    """Piece number, and own value minus the mean of the previous and next piece of the way; 0 when alone."""
    near = scan(
        df, list(order), [way],
        sums={"piece": F.lit(1).cast("long")}, previous={"__p": value}, following={"__n": value},
    )
    both = F.array_compact(F.array("__p", "__n"))
    mean = F.aggregate(both, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(both), F.lit(0))
    return near.withColumn("contrast", F.coalesce(F.col(value) - mean, F.lit(0.0))).drop("__p", "__n")


def sessions_of_headway(df: DataFrame, lane: str, order: Sequence[str], t: str, cls: str) -> DataFrame:
    """Leader class and gaps to leader and follower in time order per lane."""
    near = scan(
        df, list(order), [lane],
        previous={"leader_class": cls, "__lead_t": t},
        following={"__next_t": t},
    )
    return near.withColumns(
        {
            "gap_to_leader_s": (micros(F.col(t)) - micros(F.col("__lead_t"))) / 1e6,
            "gap_to_follower_s": (micros(F.col("__next_t")) - micros(F.col(t))) / 1e6,
        }
    ).drop("__lead_t", "__next_t")


