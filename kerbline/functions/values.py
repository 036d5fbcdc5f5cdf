"""Scalar rules on columns: flags, bands, maps, clips, ratios and generalisation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flag(condition: Column) -> Column:
    """1/0 flag; a comparison with a missing value counts as 0, never NULL."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def flag_if_observed(observed: Column, condition: Column) -> Column:
    """1/0 flag that stays NULL when nothing was observed."""
    return F.when(observed.isNotNull(), flag(condition))


def present(c: Column) -> Column:
    return c.isNotNull().cast("int")


def first_match(rules: Sequence[tuple[Column, object]], default: object = None) -> Column:
    """Value of the first rule that holds."""
    out = None
    for condition, value in rules:
        out = F.when(condition, F.lit(value)) if out is None else out.when(condition, F.lit(value))
    return out.otherwise(F.lit(default))


def band(c: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed bands: label i covers (edges[i], edges[i+1]]; NULL outside."""
    out = F.when(c <= F.lit(edges[0]), F.lit(None))
    for upper, label in zip(edges[1:], labels):
        out = out.when(c <= F.lit(upper), F.lit(label))
    return out


def mapped(c: Column, mapping: Mapping, default: object = None) -> Column:
    """Look a value up in a fixed map."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c), F.lit(default))


def clip(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """Winsorise; NULL stays NULL."""
    out = c
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(c.isNotNull(), out)


def ratio(a: Column, b: Column) -> Column:
    """a / b with a zero denominator giving NULL."""
    return a / F.when(b != 0, b)


def plausible(c: Column, low: float, high: float) -> Column:
    return F.when(c.between(low, high), c)


def snap(c: Column, per_unit: float) -> Column:
    """Round half-even to a 1/per_unit grid."""
    return F.bround(c * per_unit) / per_unit


def hours_between(a: Column, b: Column) -> Column:
    """Hours from a to b, two decimals, half-even."""
    return F.bround((F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / 3.6e9, 2)


def year_month(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")


SEASONS = {  # fixed values: month -> season
    12: "winter", 1: "winter", 2: "winter", 3: "pre-monsoon", 4: "pre-monsoon", 5: "pre-monsoon",
    6: "monsoon", 7: "monsoon", 8: "monsoon", 9: "monsoon", 10: "post-monsoon", 11: "post-monsoon",
}


def season(month: Column) -> Column:
    rules: dict[str, list[int]] = {}
    for m, name in SEASONS.items():
        rules.setdefault(name, []).append(m)
    return first_match([(month.isin(ms), name) for name, ms in rules.items()])


def time_band(hour: Column) -> Column:
    """Bands that wrap midnight: 22-3 late night, 4-6 early morning, 17-21 evening, else day."""
    return first_match(
        [
            (hour.between(22, 23) | hour.between(0, 3), "late_night"),
            (hour.between(4, 6), "early_morning"),
            (hour.between(17, 21), "evening"),
        ],
        "day",
    )


def weekend(ts: Column) -> Column:
    return F.dayofweek(ts).isin(1, 7).cast("int")


def calendar_parts(ts: Column) -> list[Column]:
    return [
        F.year(ts).alias("year"),
        F.month(ts).alias("month"),
        F.hour(ts).alias("hour"),
        F.date_format(ts, "EEEE").alias("weekday"),
    ]


def valid_on(valid_until: Column, day: Column) -> Column:
    """'yes' / 'no' validity on a day, NULL when either date is missing."""
    return F.when(valid_until.isNull() | day.isNull(), F.lit(None)).when(valid_until >= day, "yes").otherwise("no")


def reported(c: Column, negatives: Sequence[str] = ("no", "none", "nil", "not applicable", "nan")) -> Column:
    """True when something other than a negative answer was written."""
    return c.isNotNull() & ~F.lower(c).isin(*negatives)


def condition_flags(rain: str, rain_4h: str, humidity: str, wind: str, spread: str, light: str) -> list[Column]:
    """Auditable condition thresholds on hourly weather and computed light."""
    return [
        flag(F.col(rain) >= 0.5).alias("cond_rain"),
        flag(F.col(rain) >= 4.0).alias("cond_heavy_rain"),
        flag(F.col(rain_4h) >= 0.5).alias("cond_wet_road"),
        flag((F.col(humidity) >= 95) & (F.col(wind) < 7) & (F.col(spread) <= 1)).alias("cond_fog_likely"),
        flag(F.col(light) == "dark").alias("cond_dark"),
        flag(F.col(light) == "civil_twilight").alias("cond_twilight"),
    ]


def airport_flags(observed: str, visibility: str, codes: str) -> list[Column]:
    """Fog, mist/haze and rain/thunder from airport report codes; NULL without a report."""
    text = F.coalesce(F.col(codes), F.lit(""))
    seen = F.col(observed)
    return [
        flag_if_observed(seen, text.contains("FG") | F.coalesce(F.col(visibility) < 1000, F.lit(False))).alias("fog"),
        flag_if_observed(seen, text.rlike("BR|HZ|DU")).alias("mist_haze"),
        flag_if_observed(seen, text.rlike("RA|DZ|TS")).alias("rain_thunder"),
    ]


def one_hot(c: Column, levels: Sequence[str], prefix: str, drop_first: bool = True) -> list[Column]:
    """Treatment coding against the first level."""
    kept = levels[1:] if drop_first else levels
    return [flag(c == F.lit(v)).cast("double").alias(f"{prefix}_{v}") for v in kept]


def log_if_long_tailed(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """log1p for columns with min >= 0 and max > 5, as one aggregate pass; other columns unchanged."""
    stats = df.agg(*[f(c).alias(f"{n}_{c}") for c in cols for n, f in (("lo", F.min), ("hi", F.max))])
    row = stats.first()
    out = df
    for c in cols:
        lo, hi = row[f"lo_{c}"], row[f"hi_{c}"]
        if lo is not None and lo >= 0 and hi > 5:
            out = out.withColumn(c, F.log1p(F.greatest(F.col(c), F.lit(0))))
    return out


def fill_median(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Missing numbers take the column median, used as a scalar subquery."""
    from kerbline.operators.aggregates import exact_percentiles

    out = df
    for c in cols:
        out = out.withColumn(c, F.coalesce(F.col(c), exact_percentiles(df, [], c, {"median": 0.5}).scalar()))
    return out


def fold_of(block: Column, folds: int = 5, seed: int = 42) -> Column:
    """Hash-based spatial fold: all rows of a block share a fold."""
    return F.pmod(F.xxhash64(block, F.lit(seed)), F.lit(folds)).cast("int")


def block_id(lat: Column, lon: Column, size: float = 0.2) -> Column:
    return F.concat_ws("_", F.floor(lat / size).cast("string"), F.floor(lon / size).cast("string"))
