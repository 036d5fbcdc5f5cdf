"""Poisson boosted trees on binned features; all folds and nodes of a level grow from one aggregate."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline.operators.selection import quantile_edges
from kerbline.session import cut_lineage


@dataclass
class Forest:
    features: list[str]
    edges: list[list[float]]
    models: int
    depth: int
    base: list[float]
    # per tree: split feature and bin by model·2^depth + node, leaf value by model·2^depth + leaf
    trees: list[tuple[list[int], list[int], list[float]]] = field(default_factory=list)

    def bins(self) -> Column:
        """Bin numbers of all features: how many edges lie below the value; missing values fall in bin 0."""
        one = lambda f, e: F.coalesce(F.size(F.filter(F.lit(e), lambda c: c < F.col(f).cast("double"))), F.lit(0)) if e else F.lit(0)
        return F.array(*[one(f, e) for f, e in zip(self.features, self.edges)])

    def leaf(self, bins: Column, model: Column, feat: list[int], cut: list[int], levels: int) -> Column:
        """Node reached after some levels; a node without a split sends everything left."""
        size = 2**self.depth
        node = F.lit(1)
        for _ in range(levels):
            at = model * size + node
            right = F.get(bins, F.get(F.lit(feat), at)) > F.get(F.lit(cut), at)
            node = node * 2 + F.coalesce(right, F.lit(False)).cast("int")
        return node

    def predict(self, df: DataFrame, name: str = "mu", model: Column | int = 0, offset: str | None = None) -> DataFrame:
        """Expected count: exp(base + all trees)."""
        m = F.lit(model) if isinstance(model, int) else model
        held = df.withColumn("__bins", self.bins())
        size = 2**self.depth
        total = F.get(F.lit(self.base), m)
        for feat, cut, val in self.trees:
            total = total + F.get(F.lit(val), m * size + self.leaf(F.col("__bins"), m, feat, cut, self.depth) - size)
        if offset:
            total = total + F.col(offset)
        return held.withColumn(name, F.exp(total)).drop("__bins")


def fit_poisson_boost(
    df: DataFrame,
    key: str,
    y: str,
    features: Sequence[str],
    fold: str | None = None,
    folds: int = 1,
    offset: str | None = None,
    trees: int = 20,
    depth: int = 3,
    bins: int = 32,
    rate: float = 0.1,
    min_rows: int = 20,
    l2: float = 1.0,
    settle_every: int = 5,
) -> tuple[Forest, DataFrame]:
    """Returns the forest and, per key, the out-of-fold expected count (in-sample without folds).

    The driver sees split tables only: at most models · 2^depth rows per level.
    """
    features = list(features)
    quantiles = quantile_edges(df, features, bins)
    edges = [sorted(set(quantiles.get(f, []))) for f in features]
    models = folds if fold else 1
    off = F.col(offset) if offset else F.lit(0.0)
    held_out = F.col(fold) if fold else F.lit(-1)
    forest = Forest(features, edges, models, depth, [0.0] * models)
    rows = df.select(
        F.col(key).alias("key"), F.col(y).cast("double").alias("y"), off.cast("double").alias("off"), held_out.cast("int").alias("fold"), forest.bins().alias("bins")
    )
    rows = rows.withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(models - 1))))
    start = rows.filter("m <> fold").groupBy("m").agg(F.sum("y").alias("y"), F.sum(F.exp("off")).alias("e")).collect()
    for r in start:
        forest.base[r["m"]] = math.log(max(r["y"], 1e-9) / r["e"])
    rows = rows.withColumn("margin", F.col("off") + F.get(F.lit(forest.base), F.col("m")))
    rows = cut_lineage(rows)
    size = 2**depth
    for t in range(trees):
        feat, cut, val = [-1] * (models * size), [-1] * (models * size), [0.0] * (models * size)
        frontier = {(m, 1) for m in range(models)}
        for level in range(depth):
            train = rows.filter("m <> fold").withColumn("node", forest.leaf(F.col("bins"), F.col("m"), feat, cut, level))
            mu = F.exp("margin")
            hist = (
                train.select("m", "node", (mu - F.col("y")).alias("g"), mu.alias("h"), F.posexplode("bins").alias("f", "b"))
                .groupBy("m", "node", "f", "b")
                .agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count(F.lit(1)).alias("n"))
            )
            # at most `bins` rows per window
            order = Window.partitionBy("m", "node", "f").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
            whole = Window.partitionBy("m", "node", "f")
            s = hist.select(
                "m", "node", "f", "b",
                *[F.sum(c).over(order).alias(f"l{c}") for c in "ghn"], *[F.sum(c).over(whole).alias(f"t{c}") for c in "ghn"],
            ).withColumns({f"r{c}": F.col(f"t{c}") - F.col(f"l{c}") for c in "ghn"})
            gain = (
                F.col("lg") ** 2 / (F.col("lh") + l2) + F.col("rg") ** 2 / (F.col("rh") + l2) - F.col("tg") ** 2 / (F.col("th") + l2)
            )
            ok = (F.col("ln") >= min_rows) & (F.col("rn") >= min_rows) & (gain > 1e-9)
            best = s.groupBy("m", "node").agg(
                F.max_by(F.struct("f", "b", "lg", "lh", "rg", "rh"), F.when(ok, F.struct(gain, -F.col("f"), -F.col("b")))).alias("s"),
                F.first("tg").alias("tg"), F.first("th").alias("th"),
            ).collect()
            grown = set()
            last = level == depth - 1
            for r in best:
                m, node = r["m"], r["node"]
                if (m, node) not in frontier:
                    continue
                at = m * size + node
                if r["s"] is None:
                    _fill(val, m, node, depth, size, -rate * r["tg"] / (r["th"] + l2))
                    continue
                feat[at], cut[at] = r["s"]["f"], r["s"]["b"]
                for side, child in (("l", 2 * node), ("r", 2 * node + 1)):
                    if last:
                        _fill(val, m, child, depth, size, -rate * r["s"][f"{side}g"] / (r["s"][f"{side}h"] + l2))
                    else:
                        grown.add((m, child))
            frontier = grown
            if not frontier and not last:
                break
        forest.trees.append((feat, cut, val))
        leaf = forest.leaf(F.col("bins"), F.col("m"), feat, cut, depth) - size
        rows = rows.withColumn("margin", F.col("margin") + F.get(F.lit(val), F.col("m") * size + leaf))
        if (t + 1) % settle_every == 0 and t + 1 < trees:
            rows = cut_lineage(rows)  # keeps the plan of later trees short
    wanted = rows.filter("m = fold") if fold else rows
    return forest, wanted.select(F.col("key").alias(key), F.exp("margin").alias("mu"))


def _fill(val: list[float], m: int, node: int, depth: int, size: int, value: float) -> None:
    """Give a finished node's value to all leaves below it."""
    width = 1
    while node < size:
        node, width = node * 2, width * 2
    for k in range(node, node + width):
        val[m * size + k - size] = value
