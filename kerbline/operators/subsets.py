"""Many fits from one pass: cross-product sums per fold, from which any set of features, target and penalty is scored.

A least-squares fit and its held-out error need only sums of products.  These are aggregated once per fold, in
blocks of columns that are part of the group key; after that, ablations, eliminations and searches cost no pass over
the rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 8


def gram_blocks(df: DataFrame, columns: Sequence[str], key: str, block: int = BLOCK) -> DataFrame:
    """key, i, j, sums: products of the columns of block i with those of block j (i <= j), row by row of the block.

    A row is repeated once per pair of blocks, so one aggregate holds ``block`` squared sums however many columns there are.
    """
    blocks = [list(columns[at : at + block]) for at in range(0, len(columns), block)]
    held = [F.array(*[F.col(c).cast("double") for c in b], *[F.lit(0.0)] * (block - len(b))) for b in blocks]
    pairs = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), held[i].alias("a"), held[j].alias("b")) for i in range(len(blocks)) for j in range(i, len(blocks))]
    long = df.select(F.col(key).alias("key"), F.inline(F.array(*pairs)))
    sums = F.array(*[F.sum(F.col("a")[k] * F.col("b")[m]) for k in range(block) for m in range(block)])
    return long.groupBy("key", "i", "j").agg(sums.alias("sums"))


@dataclass
class Gram:
    """Cross products per fold of 1, the features and the targets; rows with a missing value take no part."""

    features: list[str]
    targets: list[str]
    sums: dict[int, np.ndarray]

    @property
    def rows(self) -> float:
        return sum(m[0, 0] for m in self.sums.values())

    def moments(self, held_out: int) -> tuple[np.ndarray, np.ndarray]:
        """Means and covariances over all folds but one."""
        total = sum(m for k, m in self.sums.items() if k != held_out)
        mean = total[0] / total[0, 0]
        return mean, total / total[0, 0] - np.outer(mean, mean)

    def squared_error(self, fold: int, features: Sequence[str], target: str, learn: str | None = None, l2: float = 0.0, one_step: bool = False) -> float:
        """Held-out squared error on ``target`` of a fit to ``learn`` (the target itself by default) on the other folds.

        ``one_step`` takes each feature's own step, as if features were not correlated.
        """
        at = [1 + self.features.index(f) for f in features]
        y, t = (1 + len(self.features) + self.targets.index(c) for c in (target, learn or target))
        mean, cov = self.moments(fold)
        own = cov[np.ix_(at, at)]
        if one_step:
            own = np.diag(np.diag(own))
        b = np.linalg.lstsq(own + l2 * np.eye(len(at)), cov[at, t], rcond=None)[0] if at else np.zeros(0)
        # the error as a combination of 1, the features and the target
        w = np.zeros(len(mean))
        w[0], w[y] = -(mean[t] - b @ mean[at]), 1.0
        w[at] = -b
        return float(w @ self.sums[fold] @ w)

    def score(self, features: Sequence[str], target: str, learn: str | None = None, l2: float = 0.0, one_step: bool = False) -> float:
        """Minus the mean held-out squared error."""
        return -sum(self.squared_error(k, features, target, learn, l2, one_step) for k in self.sums) / self.rows


def gram(df: DataFrame, features: Sequence[str], targets: Sequence[str], fold: str) -> Gram:
    """The sums of all folds, by one aggregate; folds x columns squared numbers reach the driver."""
    columns = ["__one", *features, *targets]
    ready = df.select(fold, F.lit(1.0).alias("__one"), *features, *targets).dropna()
    sums: dict[int, np.ndarray] = {}
    wide = -(-len(columns) // BLOCK) * BLOCK
    for r in gram_blocks(ready, columns, fold).collect():
        m = sums.setdefault(r.key, np.zeros((wide, wide)))
        part = np.array(r.sums).reshape(BLOCK, BLOCK)
        i, j = r.i * BLOCK, r.j * BLOCK
        m[i : i + BLOCK, j : j + BLOCK] = part
        m[j : j + BLOCK, i : i + BLOCK] = part.T
    n = len(columns)
    return Gram(list(features), list(targets), {k: sums[k][:n, :n] for k in sorted(sums)})


def _line(step: str, experiment: str, features: Sequence[str], score: float) -> dict:
    return {"step": step, "experiment": experiment, "n_features": len(features), "score": score}


def ablation(g: Gram, groups: Mapping[str, Sequence[str]], target: str, **fit) -> list[dict]:
    """All features, all but one group, only one group."""
    everything = [f for g_ in groups.values() for f in g_]
    log = [_line("all", "all features", everything, g.score(everything, target, **fit))]
    for name, members in groups.items():
        rest = [f for f in everything if f not in members]
        log.append(_line("drop one group", f"without {name}", rest, g.score(rest, target, **fit)))
        log.append(_line("only one group", f"only {name}", members, g.score(members, target, **fit)))
    return log


def group_elimination(g: Gram, groups: Mapping[str, Sequence[str]], target: str, gain: float = 0.001, **fit) -> tuple[list[str], list[dict]]:
    """Drop the whole group whose absence helps most, as long as the score grows by more than ``gain``."""
    kept, log = dict(groups), []
    current = g.score([f for m in kept.values() for f in m], target, **fit)
    while len(kept) > 1:
        tries = []
        for name in kept:
            rest = [f for other, m in kept.items() if other != name for f in m]
            tries.append((g.score(rest, target, **fit), name))
            log.append(_line("group elimination", f"without {name}", rest, tries[-1][0]))
        best, gone = max(tries)
        if best <= current + gain:
            break
        current = best
        del kept[gone]
    return list(kept), log


def backward_elimination(g: Gram, candidates: Sequence[str], features: Sequence[str], target: str, margin: float = 0.0005, **fit) -> tuple[list[str], list[dict]]:
    """Candidates, least useful first, leave where the score falls by no more than ``margin`` below the best so far."""
    kept, log = list(features), []
    best = g.score(kept, target, **fit)
    for c in candidates:
        rest = [f for f in kept if f != c]
        score = g.score(rest, target, **fit)
        log.append(_line("backward", f"without {c}", rest, score))
        if score >= best - margin:
            kept, best = rest, max(best, score)
    return kept, log


def target_variants(g: Gram, features: Sequence[str], target: str, others: Sequence[str], **fit) -> list[dict]:
    """Fits to other targets, judged on the one that matters."""
    return [_line("target", f"fit to {t}", features, g.score(features, target, learn=t, **fit)) for t in (target, *others)]


def raced_search(g: Gram, features: Sequence[str], target: str, penalties: Sequence[float], margin: float = 0.0, one_step: bool = False) -> tuple[float, list[dict]]:
    """The penalty that wins: the first is the default, and another must beat the best so far by ``margin``.

    Folds are scored one after another; errors only grow, so a setting leaves at the fold where it can't reach the
    margin any more.  The winner is that of full evaluation.
    """
    log, best, winner = [], float("inf"), penalties[0]
    for number, l2 in enumerate(penalties):
        bar = best - margin * g.rows if number else float("inf")
        error, used = 0.0, 0
        for fold in g.sums:
            error += g.squared_error(fold, features, target, l2=l2, one_step=one_step)
            used += 1
            if error >= bar:
                break
        won = bool(error < bar)
        log.append({"setting": number, "penalty": float(l2), "folds_used": used, "error": error, "won": won})
        if won:
            best, winner = error, l2
    return winner, log


@dataclass
class Components:
    """Principal components of standardised columns: shares of the variance, and a column of loadings for each."""

    columns: list[str]
    shares: np.ndarray
    loadings: np.ndarray

    def needed(self, share: float) -> int:
        """How many components explain that share."""
        return int(np.searchsorted(np.cumsum(self.shares), share - 1e-12) + 1)

    def rows(self) -> list[tuple[str, int, float, float]]:
        """(column, component, loading, share); of a component's loadings, the first of the largest size is positive."""
        return [(c, k + 1, float(self.loadings[i, k]), float(self.shares[k])) for k in range(len(self.shares)) for i, c in enumerate(self.columns)]


def components(df: DataFrame, columns: Sequence[str]) -> Components:
    """Components from one aggregate of cross products in blocks, so no row and no aggregate holds all pairs of columns."""
    g = gram(df.withColumn("__all", F.lit(0)), columns, [], "__all")
    m = g.sums[0]
    mean = m[0] / m[0, 0]
    cov = (m / m[0, 0] - np.outer(mean, mean))[1:, 1:]
    size = np.sqrt(np.diag(cov))
    held = size > 0
    scale = np.where(held, size, 1.0)
    values, vectors = np.linalg.eigh(cov / np.outer(scale, scale))
    order = np.argsort(-values)
    values, vectors = np.maximum(values[order], 0.0), vectors[:, order]
    largest = (np.abs(vectors) >= np.abs(vectors).max(0) - 1e-9).argmax(0)
    vectors = vectors * np.where(vectors[largest, np.arange(len(values))] < 0, -1.0, 1.0)
    return Components(list(columns), values / max(values.sum(), 1e-300), vectors)


def block_components(df: DataFrame, groups: Mapping[str, Sequence[str]]) -> dict[str, Components]:
    """Components of each group of columns on its own, from the rows that are complete in it."""
    return {name: components(df, members) for name, members in groups.items()}
