"""Fits from cross products against row-wise least squares, and record rules against a loop."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbline.operators import record_rules as rules
from kerbline.operators import subsets


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((600, 11))
    x[:, 3] = x[:, 2] + 0.01 * rng.standard_normal(600)
    y = 2 * x[:, 0] - x[:, 2] + 0.5 * rng.standard_normal(600) + 3
    z = y + 0.5 * x[:, 5]
    rows = [(i % 4, *map(float, r), float(a), float(b)) for i, (r, a, b) in enumerate(zip(x, y, z))]
    cols = ["fold", *[f"x{i}" for i in range(11)], "y", "z"]
    df = spark.createDataFrame(rows + [(1, *[None] * 13)], "fold int, " + ", ".join(f"{c} double" for c in cols[1:]))
    return x, y, z, subsets.gram(df, cols[1:12], ["y", "z"], "fold")


def direct(x, y, learn, at, l2=0.0):
    total, fold = 0.0, np.arange(len(y)) % 4
    for k in range(4):
        a, b = x[fold != k][:, at], learn[fold != k]
        c = a - a.mean(0)
        w = np.linalg.solve(c.T @ c / len(b) + l2 * np.eye(len(at)), c.T @ (b - b.mean()) / len(b)) if at else np.zeros(0)
        total += ((y[fold == k] - b.mean() - (x[fold == k][:, at] - a.mean(0)) @ w) ** 2).sum()
    return -total / len(y)


def test_scores_of_any_set_target_and_penalty(table):
    x, y, z, g = table
    assert g.rows == 600
    for at in ([], [0], [0, 2], [1, 3, 10], list(range(11))):
        names = [f"x{i}" for i in at]
        for l2 in (0.0, 0.3):
            assert np.isclose(g.score(names, "y", l2=l2), direct(x, y, y, at, l2))
        assert np.isclose(g.score(names, "y", learn="z"), direct(x, y, z, at))
    assert np.isclose(g.score(["x4"], "y", one_step=True), direct(x, y, y, [4]))


def test_eliminations_and_race(table):
    x, y, z, g = table
    groups = {"good": ["x0", "x2"], "copy": ["x3"], "noise": [f"x{i}" for i in range(4, 11)]}
    log = subsets.ablation(g, groups, "y")
    by = {r["experiment"]: r["score"] for r in log}
    assert len(log) == 7 and by["without good"] < by["without noise"] and np.isclose(by["only copy"], direct(x, y, y, [3]))
    kept, steps = subsets.group_elimination(g, groups, "y", gain=1e-6)
    assert "good" in kept and "noise" not in kept and len(steps) >= 3
    left, steps = subsets.backward_elimination(g, [f"x{i}" for i in range(10, -1, -1)], g.features, "y")
    assert "x0" in left and len(left) < 8 and len(steps) == 11
    assert [r["experiment"] for r in subsets.target_variants(g, ["x0"], "y", ["z"])] == ["fit to y", "fit to z"]
    for penalties in ([100.0, 0.0, 1.0, 0.01, 50.0], [0.0, 100.0, 5.0], [1.0]):
        best, log = subsets.raced_search(g, g.features, "y", penalties, margin=0.002)
        full, want = -np.inf, None
        for p in penalties:  # every fold of every setting
            s = g.score(g.features, "y", l2=p)
            if want is None or s > full + 0.002:
                full, want = s, p
        assert best == want and [r["penalty"] for r in log] == penalties
    assert min(r["folds_used"] for r in subsets.raced_search(g, g.features, "y", [0.0, 100.0], margin=0.0)[1]) < 4


def loop(codes, state=rules.CLOSED):
    out, n = [], 0
    for c in codes:
        state, new = rules.step(state, c)
        n += new
        out.append(n)
    return state, out


def test_transition_tables_against_a_loop():
    rng = random.Random(1)
    for _ in range(2000):
        codes = [rng.choice([-2, -1, 0, 1, 2, 3]) for _ in range(rng.randint(1, 12))]
        t = rules.transition(codes)
        for state in (rules.CLOSED, *range(16)):
            after, numbers = loop(codes, state)
            assert t.apply(state) == (after, numbers[-1])


@pytest.mark.parametrize("hot", [False, True])
def test_records_over_slices(spark, hot):
    rng = random.Random(2)
    rows = [(1 if hot and rng.random() < 0.4 else rng.randint(1, 40), i, rng.choice(["h", "a", "b", "c", "d", "?", None])) for i in range(1500)]
    df = spark.createDataFrame(rows, "report int, pos int, label string").repartition(5)
    got = {r.pos: r.record_no for r in rules.cut_records(df, "report", ["pos"], "label", F.col("label") == "h", ["a", "b", "c", "d"]).collect()}
    code = {"h": -2, "a": 0, "b": 1, "c": 2, "d": 3}
    want = {}
    for report in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == report]
        want |= {r[1]: n for r, n in zip(own, loop([code.get(r[2], -1) for r in own])[1]) if r[2] != "h"}
    assert got == want
    assert rules.cut_records(df.limit(0), "report", ["pos"], "label", F.col("label") == "h", ["a"]).count() == 0
