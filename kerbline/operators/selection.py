"""Feature studies: correlation, information, redundancy, components, importance, resampling, search."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from kerbline.operators import ranking
from kerbline.operators.aggregates import exact_percentiles
from kerbline.operators.ordered import number_rows, scan, slice_rows
from kerbline.session import cut_lineage, parallelism

#: Rows of a slice of the bootstrap, about: a task holds one slice.
SLICE_ROWS = 1 << 17


def _vectors(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    clean = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).dropna()
    return VectorAssembler(inputCols=list(cols), outputCol="v").transform(clean).select("v")


def correlation_matrix(df: DataFrame, cols: Sequence[str], method: str = "spearman") -> np.ndarray:
    """p x p matrix on the driver; the rows stay on Spark."""
    from pyspark.ml.stat import Correlation

    m = Correlation.corr(_vectors(df, cols), "v", method).first()[0].toArray()
    m = np.nan_to_num(m)
    np.fill_diagonal(m, 1.0)
    return m


def correlation_table(df: DataFrame, cols: Sequence[str], method: str = "spearman") -> DataFrame:
    m = correlation_matrix(df, cols, method)
    rows = [(a, b, float(m[i, j])) for i, a in enumerate(cols) for j, b in enumerate(cols)]
    return df.sparkSession.createDataFrame(rows, "feature_a string, feature_b string, rho double")


def target_rank_correlation(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Spearman correlation of each feature with the target: feature, rho, n.  Rows without a target or a feature value take no part in that feature.

    Rows are counted per (feature, value, target) once and kept; ranks and sums are made from the counts.  Mid-ranks come
    from counts per value: one long scan over (feature, value) for all features.  A feature's ranks of
    the target are those among its own rows, so missing values differ from feature to feature.
    """
    both = [F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x"), F.col(target).cast("double").alias("y")) for f in features]
    long = df.select(F.inline(F.array(*both))).dropna()

    def ranked(values: DataFrame, c: str, rank: str) -> DataFrame:
        counted = values.groupBy("feature", c).agg(F.sum("n").alias("__n"))
        upto = scan(counted, [c], ["feature"], sums={"__upto": "__n"})
        return upto.select("feature", c, (F.col("__upto") - (F.col("__n") - 1) / 2.0).alias(rank))

    pairs = cut_lineage(long.groupBy("feature", "x", "y").agg(F.count(F.lit(1)).alias("n")))
    pairs = pairs.join(ranked(pairs, "x", "rx"), ["feature", "x"]).join(ranked(pairs, "y", "ry"), ["feature", "y"])
    rows = pairs.groupBy("feature").agg(
        F.sum("n").alias("n"), *[F.sum(F.col("n") * e).alias(a) for a, e in (("sx", F.col("rx")), ("sy", F.col("ry")), ("xx", F.col("rx") ** 2), ("yy", F.col("ry") ** 2), ("xy", F.col("rx") * F.col("ry")))]
    )
    spread = F.sqrt((F.col("xx") - F.col("sx") ** 2 / F.col("n")) * (F.col("yy") - F.col("sy") ** 2 / F.col("n")))
    return rows.select("feature", F.when(spread > 0, (F.col("xy") - F.col("sx") * F.col("sy") / F.col("n")) / spread).alias("rho"), "n")


def quantile_edges(df: DataFrame, features: Sequence[str], bins: int) -> dict[str, list[float]]:
    """Exact inner quantiles of each feature, all in one pass: features x bins numbers reach the driver."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])))
    wanted = {f"q{i}": i / bins for i in range(1, bins)}
    return {r["feature"]: [r[q] for q in wanted] for r in exact_percentiles(long, ["feature"], "x", wanted).collect()}


def mutual_information(df: DataFrame, features: Sequence[str], target: str, bins: int = 20) -> DataFrame:
    """Information between quantile-binned features and target levels, all features in one aggregate."""
    edges = quantile_edges(df, features, bins)
    held = df.select(F.col(target).alias("y"), *[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)]).dropna()
    held = held.withColumns({f"e{i}": F.array(*[F.lit(e) for e in edges[f]]) for i, f in enumerate(features)})

    def bin_of(i: int) -> Column:
        return F.size(F.filter(f"e{i}", lambda c: c < F.col(f"x{i}")))

    long = held.select(
        "y",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(f).alias("feature"), bin_of(i).alias("bin"))
                    for i, f in enumerate(features)
                ]
            )
        ),
    )
    cells = long.groupBy("feature", "bin", "y").agg(F.count(F.lit(1)).alias("n"))
    rows = cells.groupBy("feature", "bin").agg(F.sum("n").alias("nb"))
    cols = cells.groupBy("feature", "y").agg(F.sum("n").alias("ny"))
    n = cells.groupBy("feature").agg(F.sum("n").alias("nn"))
    j = cells.join(rows, ["feature", "bin"]).join(cols, ["feature", "y"]).join(n, "feature")
    p = F.col("n") / F.col("nn")
    return j.groupBy("feature").agg(F.sum(p * F.log(F.col("n") * F.col("nn") / (F.col("nb") * F.col("ny")))).alias("mutual_information"))


def redundancy_groups(rho: np.ndarray, names: Sequence[str], cut: float = 0.15) -> dict[str, int]:
    """Average-linkage groups on 1 - |rho|, joined while the mean distance is within the cut."""
    groups = [[i] for i in range(len(names))]
    dist = 1 - np.abs(rho)
    while len(groups) > 1:
        best = min(
            ((float(np.mean(dist[np.ix_(a, b)])), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j),
            key=lambda t: t[0],
        )
        if best[0] > cut:
            break
        groups[best[1]] += groups.pop(best[2])
    return {names[i]: g for g, members in enumerate(groups, start=1) for i in members}


def keep_most_informative(groups: Mapping[str, int], info: Mapping[str, float], zero_share: Mapping[str, float], max_zero: float = 0.998) -> tuple[list[str], dict[str, str]]:
    """Best member per group; the rest and near-empty features are dropped with a reason."""
    kept, dropped = [], {}
    for g in sorted(set(groups.values())):
        members = sorted((f for f in groups if groups[f] == g), key=lambda f: (-info[f], f))
        for m in members[1:]:
            dropped[m] = f"redundant with {members[0]}"
        if zero_share.get(members[0], 0.0) > max_zero:
            dropped[members[0]] = "almost always zero"
        else:
            kept.append(members[0])
    return kept, dropped


def principal_components(df: DataFrame, cols: Sequence[str], k: int | None = None) -> tuple[DataFrame, np.ndarray]:
    """Variance table of standardised features, and loadings (features x components)."""
    from pyspark.ml.feature import PCA, StandardScaler

    v = _vectors(df, cols)
    scaled = StandardScaler(inputCol="v", outputCol="z", withMean=True, withStd=True).fit(v).transform(v)
    model = PCA(k=k or len(cols), inputCol="z", outputCol="pc").fit(scaled)
    shares = model.explainedVariance.toArray()
    rows = [(i + 1, float(s), float(c)) for i, (s, c) in enumerate(zip(shares, np.cumsum(shares)))]
    return df.sparkSession.createDataFrame(rows, "component int, explained_variance double, cumulative double"), model.pc.toArray()


def components_for(shares: Sequence[float], wanted: float) -> int:
    return int(np.searchsorted(np.cumsum(shares), wanted) + 1)


def variance_inflation(df: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    """Diagonal of the inverse correlation matrix."""
    inv = np.linalg.pinv(correlation_matrix(df, cols, "pearson"))
    return {c: float(inv[i, i]) for i, c in enumerate(cols)}


def prune_by_inflation(df: DataFrame, cols: Sequence[str], limit: float = 5.0) -> list[str]:
    """Drop the most inflated term until all are below the limit; one correlation pass serves all rounds."""
    kept, m = list(cols), correlation_matrix(df, cols, "pearson")
    while len(kept) > 1:
        idx = [list(cols).index(c) for c in kept]
        vif = np.diag(np.linalg.pinv(m[np.ix_(idx, idx)]))
        if vif.max() < limit:
            break
        kept.pop(int(vif.argmax()))
    return kept


def permuted(df: DataFrame, key: str, column: str, seed: int) -> DataFrame:
    """The table with one column shuffled over all rows: two hash orders joined by row number."""
    a = number_rows(df, [F.xxhash64(F.lit(seed), F.col(key)), F.col(key)], "__rn")
    b = number_rows(df.select(key, F.col(column).alias("__v")), [F.xxhash64(F.lit(seed + 7919), F.col(key)), F.col(key)], "__rn")
    return a.join(b.select("__rn", "__v"), "__rn").withColumn(column, F.col("__v")).drop("__rn", "__v")


def permutation_importance(df: DataFrame, key: str, y: str, features: Sequence[str], predict: Callable[[DataFrame], DataFrame], repeats: int = 3, seed: int = 0) -> DataFrame:
    """Mean rise of the Poisson deviance per row when a feature is shuffled."""

    def score(d: DataFrame) -> DataFrame:
        return predict(d).agg((ranking.poisson_deviance(F.col("mu"), F.col(y)) / F.count(F.lit(1))).alias("dev"))

    base = score(df).select(F.lit("").alias("feature"), F.lit(-1).alias("r"), "dev")
    table = base
    for i, f in enumerate(features):
        for r in range(repeats):
            table = table.unionAll(score(permuted(df, key, f, seed + 101 * i + r)).select(F.lit(f), F.lit(r), "dev"))
    scores = table.collect()  # features x repeats numbers
    ref = next(s["dev"] for s in scores if s["r"] == -1)
    rows = [(f, float(np.mean([s["dev"] - ref for s in scores if s["feature"] == f]))) for f in features]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


def draw_index(n: Column, *parts: Column) -> Column:
    """Repeatable draw in 0…n-1 from a digest of its parts; the same in any SQL engine."""
    digest = F.md5(F.concat_ws("-", *[p.cast("string") for p in parts]))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), n)


def block_weights(df: DataFrame, block: str, reps: int, seed: int = 3) -> DataFrame:
    """Bootstrap weights: per repetition, blocks drawn with replacement as often as there are blocks."""
    blocks = number_rows(df.select(block).distinct(), [block], "__no")
    n = df.agg(F.countDistinct(block)).scalar()
    draws = blocks.select(F.col("__no").alias("j"), F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep")).withColumn("__n", n)
    picked = draws.select("rep", (draw_index(F.col("__n"), F.lit(seed), F.col("rep"), F.col("j")) + 1).alias("__no"))
    counts = picked.groupBy("rep", "__no").agg(F.count(F.lit(1)).alias("weight"))
    return counts.join(blocks, "__no").select("rep", block, "weight")


def _answering_rows(shares: Sequence[float], exact: bool):
    """Of one slice in order, the rows of each repetition whose length interval holds a point that ``ranking.capture`` asks."""

    def pick(rows: pa.Table, reps: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        order = np.argsort(rows.column("__at").to_numpy(), kind="stable")
        pairs, code = np.unique(rows.column("pair").to_numpy()[order], return_inverse=True)
        blank = rows.column("__u").is_null().to_numpy(zero_copy_only=False)[order]
        u, y = (rows.column(c).fill_null(0).to_numpy()[order] for c in ("__u", "__y"))
        empty_y = rows.column("__y").is_null().to_numpy(zero_copy_only=False)[order]
        which = rows.column("which")[0].as_py() if len(order) else None
        out = []
        for r in reps.to_pylist():
            drawn = np.zeros(len(pairs), bool)
            drawn[np.searchsorted(pairs, np.array(r["pairs"], np.int64))] = True
            own = np.flatnonzero(drawn[code])
            length = np.cumsum(u[own]) + r["__bl"]
            if r["__tl"]:
                after, before = length / r["__tl"], (length - u[own]) / r["__tl"]
                first, last = np.floor(before * 1000) + 1, np.minimum(np.floor(after * 1000), 200)
                asked = last >= first
                for q in shares:
                    asked |= (before < q) & (q <= after)
                asked &= ~blank[own]
            else:  # no length to share out: one row shows that
                asked = np.arange(len(own)) == 0
            held = np.flatnonzero(asked)
            upto = np.cumsum(y[own])[held] + r["__bt"]
            out += [
                (which, r["rep"], None if blank[i] else int(u[i]), None if empty_y[i] else y[i].item(), int(cl), ct.item())
                for i, cl, ct in zip(own[held], length[held], upto)
            ]
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64() if exact else pa.float64(), pa.int64(), pa.int64() if exact else pa.float64()]
        columns = zip(*out) if out else [()] * len(kinds)
        return pa.Table.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["which", "rep", "__u", "__y", "__cl", "__ct"])

    return pick


def weighted_captures(
    df: DataFrame, weights: DataFrame, block: str, scores: Mapping[str, str], length: str, target: str, key: str, shares: Sequence[float]
) -> DataFrame:
    """``ranking.capture`` of the curve of each score (``which``) in each ``rep``, where ``weights`` multiplies lengths and targets by block.

    A row has the same place among the others in all repetitions that give it the same weight, so it is sorted once per
    weight, not once per repetition.  Range slices of that order hold about SLICE_ROWS rows; a slice knows its
    blocks' weights and every repetition's totals before it, and returns the few rows that answer a point of the curve.
    """
    # a number for each (block, weight), fixed by the checkpoint
    pairs = cut_lineage(weights.groupBy(block, "weight").agg(F.collect_list("rep").alias("reps")).withColumn("pair", F.monotonically_increasing_id()))
    drawn = df.join(pairs.select(block, "weight", "pair"), block).withColumns({"__len": F.col(length) * F.col("weight"), "__y": F.col(target) * F.col("weight")})
    exact = isinstance(drawn.schema["__y"].dataType, IntegralType)
    places = [F.struct(F.lit(tag).alias("which"), ranking.risk_order(s, "__len", key)[0].alias("__o")) for tag, s in scores.items()]
    units = F.round(F.col("__len") * 1e4).cast("long").alias("__u")
    dealt = cut_lineage(
        drawn.select("pair", units, F.col("__y").cast("long" if exact else "double").alias("__y"), F.col(key).alias("__k"), F.inline(F.array(*places)))
    )
    slices = max(parallelism(df.sparkSession), -(-dealt.count() // SLICE_ROWS))
    sliced = cut_lineage(slice_rows(dealt, F.struct("which", "__o", "__k"), slices))
    parts = sliced.groupBy("which", "__slice", "pair").agg(F.sum("__u").alias("__u"), F.sum("__y").alias("__y"))
    held = parts.join(pairs.select("pair", F.explode("reps").alias("rep")), "pair").groupBy("which", "__slice", "rep")
    held = held.agg(F.sum("__u").alias("__u"), F.sum("__y").alias("__y"), F.collect_list("pair").alias("pairs"))
    every = Window.partitionBy("which", "rep")
    before = every.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    held = cut_lineage(
        held.select(
            "which", "__slice", "rep", "pairs", F.coalesce(F.sum("__u").over(before), F.lit(0)).alias("__bl"), F.coalesce(F.sum("__y").over(before), F.lit(0)).alias("__bt"),
            F.sum("__u").over(every).alias("__tl"), F.sum("__y").over(every).alias("__tt"),
        )
    )
    totals = held.groupBy("which", "rep").agg(F.first("__tl").alias("__tl"), F.first("__tt").alias("__tt"))
    inside = Window.partitionBy("which", "__slice").orderBy("__o", "__k")
    ranked = sliced.withColumn("__at", F.row_number().over(inside)).select("which", "__slice", "__at", "pair", "__u", "__y")
    kind = "long" if exact else "double"
    answers = ranked.groupBy("which", "__slice").cogroup(held.groupBy("which", "__slice")).applyInArrow(
        _answering_rows(shares, exact), f"which string, rep int, __u long, __y {kind}, __cl long, __ct {kind}"
    )
    curve = ranking.shares_of(answers.join(totals, ["which", "rep"]), "__y")
    return totals.select("which", "rep").join(ranking.capture(curve, ["which", "rep"], shares), ["which", "rep"], "left")


def bootstrap_gain(df: DataFrame, block: str, score_a: str, score_b: str, length: str, target: str, key: str, reps: int = 300, seed: int = 3) -> DataFrame:
    """Block bootstrap of the capture difference of two rankings: mean and 95% interval per measure."""
    rows = cut_lineage(df.select(*dict.fromkeys([block, score_a, score_b, length, target, key])))
    captures = weighted_captures(rows, block_weights(rows, block, reps, seed), block, {"a": score_a, "b": score_b}, length, target, key, (0.05,))
    per_score = [captures.filter(F.col("which") == tag).select("rep", F.col("cap5").alias(f"cap5_{tag}"), F.col("area20").alias(f"area20_{tag}")) for tag in "ab"]
    both = per_score[0].join(per_score[1], "rep")
    gains = both.select(
        F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), (F.col(f"{m}_a") - F.col(f"{m}_b")).alias("gain")) for m in ("cap5", "area20")]))
    )
    return gains.groupBy("measure").agg(
        F.avg("gain").alias("mean_gain"),
        F.percentile("gain", F.lit(0.025)).alias("ci_low"),
        F.percentile("gain", F.lit(0.975)).alias("ci_high"),
        F.count(F.lit(1)).alias("reps"),
    )


def experiment_log(spark, rows: Sequence[dict]) -> DataFrame:
    return spark.createDataFrame(
        [(r["step"], r["experiment"], r["n_features"], float(r["score"])) for r in rows],
        "step string, experiment string, n_features int, score double",
    )


def feature_catalogue(profile: DataFrame, kept: Sequence[str], dropped: Mapping[str, str]) -> DataFrame:
    """Profile rows with the decision and its reason."""
    reason = F.lit("not kept")
    for f, why in dropped.items():
        reason = F.when(F.col("feature") == f, why).otherwise(reason)
    kept_col = F.col("feature").isin(list(kept))
    return profile.withColumns({"kept": kept_col, "reason": F.when(kept_col, "kept").otherwise(reason)})
