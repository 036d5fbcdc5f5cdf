"""Work that no longer grows with repetitions, borders or rows of a shuffle: small cases of the fifth round."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import Window
from pyspark.sql import functions as F

from kerbline.llm import hat_trie
from kerbline.operators import ordered
from kerbline.operators import selection as sel


def gains_by_hand(rows, weights, reps):
    """Capture at 5 % and its mean over 0.1 to 20 % for both scores, drawn row by drawn row."""
    out = []
    for r in range(reps):
        both = []
        for s in (0, 1):
            drawn = [(-(row[2 + s] + 1e-9 * row[4] * w), row[0], row[4] * w, row[5] * w) for row in rows for w in [weights.get((r, row[1]), 0)] if w]
            drawn.sort()
            b, d = (np.concatenate([[0], np.cumsum([x[k] for x in drawn])]) for k in (2, 3))
            at = np.arange(1, 201) / 1000
            curve = np.where(at <= b[1] / b[-1], d[1] / d[-1], np.interp(at, b / b[-1], d / d[-1]))  # the first row counts whole
            both.append((curve[49], curve.mean()))
        out.append((both[0][0] - both[1][0], both[0][1] - both[1][1]))
    return np.array(out)


@pytest.mark.parametrize("slice_rows", [40, 1 << 17])
def test_bootstrap_sorts_a_row_once_per_weight(spark, monkeypatch, slice_rows):
    rng = np.random.default_rng(5)
    rows = [(i, f"b{i % 9}", float(rng.integers(4)), float(rng.normal()), int(rng.integers(1, 60)), int(rng.integers(5))) for i in range(360)]
    df = spark.createDataFrame(rows, "id int, block string, sa double, sb double, len int, y int")
    reps, sliced, plain = 30, [], sel.slice_rows
    monkeypatch.setattr(sel, "SLICE_ROWS", slice_rows)
    monkeypatch.setattr(sel, "slice_rows", lambda d, key, slices: (sliced.append((d.count(), slices)), plain(d, key, slices))[1])
    weights = {(w["rep"], w["block"]): w["weight"] for w in sel.block_weights(df, "block", reps).collect()}
    got = {r["measure"]: r for r in sel.bootstrap_gain(df, "block", "sa", "sb", "len", "y", "id", reps).collect()}
    want = gains_by_hand(rows, weights, reps)
    for k, name in enumerate(("cap5", "area20")):
        assert got[name]["reps"] == reps and np.isclose(got[name]["mean_gain"], want[:, k].mean(), atol=1e-6)
        assert np.allclose([got[name]["ci_low"], got[name]["ci_high"]], np.quantile(want[:, k], [0.025, 0.975]), atol=1e-6)
    per_weight = 2 * 40 * len({(b, w) for (_, b), w in weights.items()})  # not 2 * 360 rows in each of 30 repetitions
    assert sliced == [(per_weight, max(4, -(-per_weight // slice_rows)))] and per_weight < 2 * 360 * 6


def test_scan_aggregates_only_keys_on_a_border(spark):
    rng = np.random.default_rng(6)
    sizes = [1] * 150 + [None, 400, 3, 90]  # small keys, a null key, keys over several slices
    rows = [(None if n is None else k, (i * 7919) % 10007, int(rng.integers(9))) for k, n in enumerate(sizes) for i in range(n or 60)]
    df = spark.createDataFrame(rows, "key int, at int, v int")
    work = {"sums": {"upto": F.col("v").cast("long")}, "previous": {"before": "v"}, "following": {"after": "v"}}
    got = ordered.scan(df, ["at"], ["key"], slices=9, **work)
    here = Window.partitionBy("key").orderBy("at")
    want = df.withColumns({"upto": F.sum("v").over(here), "before": F.lag("v").over(here), "after": F.lead("v").over(here)})
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter __seam" in plan and "CASE WHEN (__cuts" in plan  # the search is compiled, not a function over an array


def test_runs_are_one_row_a_partition(spark, monkeypatch):
    monkeypatch.setattr(hat_trie, "PARTS", 5)
    monkeypatch.setattr(hat_trie, "RUN_BYTES", 4000)
    rng, numbers, want, made = np.random.default_rng(7), hat_trie.Numbers(), Counter(), []
    for _ in range(3):
        trie = hat_trie.HatTrie()
        found = [f"ü{w}".encode() for w in rng.zipf(1.4, 800) % 300]
        ids = numbers.of(found)
        for packed in hat_trie.sequences("de", ids, numbers.hashes, 1, 4, None):
            trie.add(*packed)
        want.update(b" ".join(found[i : i + k]).decode() for k in range(1, 5) for i in range(len(found) - k + 1))
        made += list(hat_trie._runs("de", trie.spill(0), numbers))
    runs = pa.Table.from_batches(made)
    sizes = [len(phrases.encode()) for phrases in runs.column("phrases").to_pylist()]
    assert runs.num_rows <= 5 * len(made) and sum(sizes) // 4000 <= len(made) < len(want) / 20  # a row for each phrase before
    rows = spark.createDataFrame(runs.to_pylist(), "part int, lang string, phrases string, ns array<long>")
    got = hat_trie.merged(rows).collect()
    assert len(got) == len(want) and all(r["lang"] == "de" and want[r["phrase"]] == r["n"] for r in got)
