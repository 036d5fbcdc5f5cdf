"""Ranking by risk under a length budget: capture, cut-offs, bands, calibration, shrinkage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.operators.ordered import number_rows, scan, total

SHARES = (0.01, 0.05, 0.10, 0.20)


def risk_order(score: str, length: str | None, key: str) -> list[Column]:
    """Highest score first; equal scores put the longer row first, then the key."""
    s = F.col(score) + (1e-9 * F.col(length) if length else F.lit(0.0))
    return [-s, F.col(key)]


def risk_curve(
    df: DataFrame, score: str, length: str, target: str, key: str, per: Sequence[str] = (), longer_first: bool = True
) -> DataFrame:
    """Each row with the share of length and of target up to and before it, riskiest first."""
    order = risk_order(score, length if longer_first else None, key)
    # lengths in whole 0.1 mm: exact sums, so the rows tile the length axis without gaps
    units = F.round(F.col(length) * 1e4).cast("long")
    run = scan(df.withColumn("__u", units), order, per, sums={"__cl": "__u", "__ct": target})
    totals = df.groupBy(*per).agg(F.sum(units).alias("__tl"), F.sum(target).alias("__tt"))
    if per:
        run = run.join(totals, list(per))
    else:
        run = run.withColumns({c: totals.select(c).scalar() for c in ("__tl", "__tt")})
    return shares_of(run, target)


def shares_of(run: DataFrame, target: str) -> DataFrame:
    """The shares of a curve's rows from their units ``__u``, running totals ``__cl``, ``__ct`` and totals ``__tl``, ``__tt``."""
    return run.withColumns(
        {
            "cum_length_share": F.col("__cl") / F.col("__tl"),
            "cum_target_share": F.col("__ct") / F.col("__tt"),
            "prev_length_share": (F.col("__cl") - F.col("__u")) / F.col("__tl"),
            "prev_target_share": (F.col("__ct") - F.col(target)) / F.col("__tt"),
        }
    ).drop("__u", "__cl", "__ct", "__tl", "__tt")


def _interpolated(q: Column) -> Column:
    a, b = F.col("prev_length_share"), F.col("cum_length_share")
    c, d = F.col("prev_target_share"), F.col("cum_target_share")
    return F.when(a <= 0, d).otherwise(c + (q - a) / (b - a) * (d - c))


def capture(curve: DataFrame, per: Sequence[str] = (), shares: Sequence[float] = SHARES) -> DataFrame:
    """Share of target in the top q of length, linear between rows, and the mean over 0.1%…20%."""
    a, b = F.col("prev_length_share"), F.col("cum_length_share")
    aggs = []
    for q in shares:
        hit = (a < q) & (F.lit(q) <= b)
        aggs.append(F.max(F.when(hit, _interpolated(F.lit(q)))).alias(f"cap{round(q * 100)}"))
    # a row answers exactly the grid points inside its own length interval
    first, last = F.floor(a * 1000).cast("int") + 1, F.least(F.floor(b * 1000), F.lit(200)).cast("int")
    points = F.when(last >= first, F.sequence(first, F.greatest(last, first)))
    area = F.aggregate(points, F.lit(0.0), lambda s, k: s + _interpolated(k / 1000.0))
    aggs.append((F.sum(area) / 200).alias("area20"))
    grouped = curve.groupBy(*per) if per else curve
    return grouped.agg(*aggs)


def capture_steps(curve: DataFrame, target: str, flag: str | None = None, shares: Sequence[float] = SHARES) -> DataFrame:
    """Step rule: target share of the rows whose cumulative length share is still within q."""
    b = F.col("cum_length_share")
    aggs = [
        (F.sum(F.when(b <= q, F.col(target)).otherwise(0)) / F.sum(target)).alias(f"cap{round(q * 100)}") for q in shares
    ]
    if flag:
        aggs += [
            F.sum(F.when(b <= 0.05, F.col(flag)).otherwise(0)).cast("long").alias("hotspots_in_top5"),
            F.sum(flag).cast("long").alias("hotspots_total"),
        ]
    return curve.agg(*aggs)


def cutoffs(df: DataFrame, score: str, length: str, key: str, shares: Sequence[float] = (0.01, 0.05, 0.20)) -> DataFrame:
    """Score at which the cumulative length first reaches each share: columns cut3, cut2, cut1."""
    run = scan(df.select(score, length, key), risk_order(score, None, key), sums={"__cl": length})
    share = F.col("__cl") / total(df, F.sum(length))
    names = [f"cut{len(shares) - i}" for i in range(len(shares))]
    return run.withColumn("__share", share).agg(
        *[F.max(F.when(F.col("__share") >= q, F.col(score))).alias(n) for q, n in zip(shares, names)]
    )


def band_of(score: Column, cuts: Mapping[int, Column]) -> Column:
    """Band number of a score under fixed cut-offs; 0 below all of them."""
    out = None
    for level in sorted(cuts, reverse=True):
        out = F.when(score >= cuts[level], level) if out is None else out.when(score >= cuts[level], level)
    return out.otherwise(0)


def with_bands(df: DataFrame, cuts: DataFrame, scores: Mapping[str, Column]) -> DataFrame:
    """Band columns for several scores under one cut-off row."""
    held = df.withColumns({f"__cut{i}": cuts.select(f"cut{i}").scalar() for i in (1, 2, 3)})
    levels = {i: F.col(f"__cut{i}") for i in (1, 2, 3)}
    return held.withColumns({n: band_of(s, levels) for n, s in scores.items()}).drop(*[f"__cut{i}" for i in (1, 2, 3)])


def band_validation(df: DataFrame, band: str, length_m: str, target: str, new_flag: str) -> DataFrame:
    """Length, target, shares and rate per 100 km by band."""
    per_band = df.groupBy(band).agg(
        (F.sum(length_m) / 1000).alias("road_km"),
        F.sum(target).cast("long").alias("target"),
        F.sum(new_flag).cast("long").alias("new_hotspots"),
    )
    return per_band.withColumns(
        {
            "share_km": F.col("road_km") / total(per_band, F.sum("road_km")),
            "share_target": F.col("target") / total(per_band, F.sum("target")),
            "rate_per_100km": 100 * F.col("target") / F.col("road_km"),
        }
    )


def alert_load(df: DataFrame, length_m: str, bands: Mapping[str, str]) -> DataFrame:
    """Length in band 2+ and band 3 for each condition column."""
    long = df.select(
        length_m,
        F.explode(F.array(*[F.struct(F.lit(n).alias("condition"), F.col(c).alias("band")) for n, c in bands.items()])).alias("c"),
    ).select(length_m, "c.*")
    return long.groupBy("condition").agg(
        (F.sum(F.when(F.col("band") >= 2, F.col(length_m)).otherwise(0)) / 1000).alias("band2plus_km"),
        (F.sum(F.when(F.col("band") >= 2, F.col(length_m)).otherwise(0)) / F.sum(length_m)).alias("band2plus_share"),
        (F.sum(F.when(F.col("band") == 3, F.col(length_m)).otherwise(0)) / 1000).alias("band3_km"),
    )


def equal_count_bucket(rank: Column, n: Column, buckets: int) -> Column:
    """Quantile-cut bucket of a 1-based rank: edges at 1 + (n-1)·k/buckets, right-closed."""
    return F.greatest(F.lit(1), F.ceil((rank - 1) * buckets / F.nullif(n - 1, F.lit(0)))).cast("int")


def calibration(df: DataFrame, score: str, predicted: str, observed: str, length_m: str, key: str, buckets: int = 10) -> DataFrame:
    """Predicted and observed totals by equal-count buckets of the score, ties by key order."""
    ranked = number_rows(df, [F.col(score), F.col(key)])
    placed = ranked.withColumn("bucket", equal_count_bucket(F.col("row_no"), total(df, F.count(F.lit(1))), buckets))
    return placed.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("segments"),
        (F.sum(length_m) / 1000).alias("road_km"),
        F.sum(predicted).alias("predicted"),
        F.sum(observed).alias("observed"),
        (F.sum(observed) / F.sum(predicted)).alias("observed_over_predicted"),
    )


def moment_k(mu: Column, y: Column) -> Column:
    """Over-dispersion by moments, at least 0.001 (an aggregate)."""
    return F.greatest(F.sum((y - mu) * (y - mu) - mu) / F.sum(mu * mu), F.lit(1e-3))


def shrink(mu: Column, y: Column, k: Column) -> Column:
    """Empirical Bayes: the model's view where it is sure, the own count where it is not."""
    w = 1 / (1 + k * mu)
    return w * mu + (1 - w) * y


def empirical_bayes(df: DataFrame, mu: str, y: str, name: str = "eb") -> DataFrame:
    k = total(df, moment_k(F.col(mu), F.col(y)))
    return df.withColumn("eb_k", k).withColumn(name, shrink(F.col(mu), F.col(y), F.col("eb_k")))


def deployment_rate(mu: Column, months_model: Column, count_all: Column, months_all: Column, k: Column, length_m: Column) -> Column:
    """Expected events per km and year using the whole history."""
    mu_all = mu * months_all / months_model
    return shrink(mu_all, count_all, k) / F.greatest(length_m / 1000, F.lit(0.01)) / (months_all / 12)


def blend_grid(df: DataFrame, a: str, b: str, steps: int = 10) -> DataFrame:
    """Each row under every blend weight 0, 0.1, … 1."""
    out = df.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    w = F.col("step") / steps
    return out.withColumns({"w": w, "blend": w * F.col(a) + (1 - w) * F.col(b)})


def poisson_deviance(mu: Column, y: Column) -> Column:
    """2·Σ(y·ln(y/mu) − (y − mu)), an aggregate."""
    return 2 * F.sum(F.when(y > 0, y * F.log(F.greatest(y, F.lit(1e-9)) / mu)).otherwise(0.0) - (y - mu))


def level_free_deviance(df: DataFrame, mu: str, y: str, per: Sequence[str] = ()) -> DataFrame:
    """Deviance after scaling the prediction to the observed level, in one aggregate.

    With mu' = mu·Y/M the deviance is 2·(Σ y·ln(y/mu) − Y·ln(Y/M)), so no second pass is needed.
    """
    m = F.greatest(F.col(mu), F.lit(1e-9))
    yy = F.col(y)
    inner = F.sum(F.when(yy > 0, yy * F.log(F.greatest(yy, F.lit(1e-9)) / m)).otherwise(0.0))
    dev = 2 * (inner - F.sum(yy) * F.log(F.sum(yy) / F.sum(m)))
    return (df.groupBy(*per) if per else df).agg(dev.alias("deviance"))


def area_under_roc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Exact AUC with half credit for ties: counts per distinct score, then a running total."""
    per_score = df.groupBy(score).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )
    run = scan(per_score, [F.col(score)], sums={"neg_upto": "neg"})
    won = F.sum(F.col("pos") * (F.col("neg_upto") - F.col("neg") / 2))
    return run.agg(
        (won / F.sum("pos") / F.sum("neg")).alias("auc"), F.sum("pos").alias("positives"), F.sum("neg").alias("negatives")
    )


def log_loss(p: Column, label: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.avg(-F.when(label == 1, F.log(q)).otherwise(F.log(1 - q)))


def priority_shares(groups: DataFrame, mass: str, key: str) -> DataFrame:
    """Rank by descending mass with the cumulative share."""
    ranked = scan(groups, [-F.col(mass), F.col(key)], sums={"priority": F.lit(1).cast("long"), "cum_mass": mass})
    return ranked.withColumn("cum_share", F.col("cum_mass") / total(groups, F.sum(mass)))


def reasons(contributions: Mapping[str, Column], floor: float = 0.1, default: str = "no standout factor") -> Column:
    """The two largest contributions above a floor as text."""
    items = F.array(*[F.struct((-c).alias("neg"), F.lit(label).alias("label")) for label, c in contributions.items()])
    best = F.slice(F.array_sort(items), 1, 2)
    text = F.array_join(F.transform(F.filter(best, lambda s: s["neg"] < -floor), lambda s: s["label"]), " + ")
    return F.when(text != "", text).otherwise(F.lit(default))


def hotspot_flags(serious: str, killed: str, prefix: str, min_serious: int = 5, min_killed: int = 10) -> Column:
    return ((F.col(serious) >= min_serious) | (F.col(killed) >= min_killed)).cast("int").alias(f"hotspot_{prefix}")


def signal_table(
    df: DataFrame,
    risk: str,
    length_m: str,
    key: str,
    twilight: str,
    dark: str,
    weather: Column | float,
    ped_parts: Sequence[str],
    has_history: Column,
    is_main: Column,
) -> DataFrame:
    """Risk x condition multipliers to bands under the daylight cut-offs, pedestrian flag, confidence."""
    cuts = cutoffs(df, risk, length_m, key)
    wx = weather if isinstance(weather, Column) else F.lit(float(weather))
    r = F.col(risk)
    banded = with_bands(
        df,
        cuts,
        {
            "static_band": r,
            "twilight_band": r * F.col(twilight),
            "dark_band": r * F.col(dark),
            "rain_band": r * F.greatest(wx, F.lit(1.0)),
        },
    )
    ped = sum((F.col(c) for c in ped_parts[1:]), F.col(ped_parts[0])) >= 3
    confidence = F.when(has_history & is_main, "high").when(has_history | is_main, "medium").otherwise("low")
    return banded.withColumns({"ped_flag": ped.cast("int"), "confidence": confidence})
