"""Exact, near and substring duplicates against plain Python on texts with every odd case."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from kerbline.llm import components, exact, minhash, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, rows):
    schema = "doc_id long, text string, id long, digest string, n int"  # clashing names must not matter
    return spark.createDataFrame([(i, t, 5, "x", 1) for i, t in rows], schema)


def corpus():
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(300)] + ["É", "ß", "日本", "a b"]
    base = [" ".join(rng.choices(vocab, k=rng.randint(1, 90))) for _ in range(40)]
    out = [None, "", " \t\n", "one", "one two", "ONE  two", "a\x0bb", "ab", "a\u00a0b", "same", "sa me", " same "]
    for t in base:
        out.append(t)
        words = t.split(" ")
        for _ in range(rng.randint(0, 4)):  # near copies
            w = list(words)
            w[rng.randrange(len(w))] = "CHANGED"
            out.append(" ".join(w))
    passage = " ".join(rng.choices(vocab, k=60))
    out += [f"{rng.choice(base)} {passage} {rng.choice(base)}" for _ in range(12)]
    out += ["go " * 200, " ".join(["rep"] * 45), base[0], base[0]]
    out.append(" ".join(rng.choices(vocab, k=30_000)))  # very long
    rng.shuffle(out)
    return list(enumerate(out))


def test_content_sort(spark):
    rows = corpus() + [(500 + i, "same text") for i in range(200)]  # a large group, cut over slices
    norm = {i: re.sub(r"[\x20\x09-\x0D]", "", t or "") for i, t in rows}
    groups = {}
    for i, t in rows:
        groups.setdefault(norm[i], []).append((-len(t or ""), i))
    for slices in (2, 5, 64):
        got = {r.doc_id: r for r in exact.content_sort(docs(spark, rows), slices=slices).collect()}
        assert len(got) == len(rows)
        for i, _ in rows:
            keep = min(groups[norm[i]])[1]
            assert (got[i].keep_id, got[i].group_size, got[i].kept) == (keep, len(groups[norm[i]]), keep == i)
            assert got[i].text_sha256 == hashlib.sha256(norm[i].encode()).hexdigest()


def test_content_sort_repeated_rows_null_ids_and_empty_table(spark):
    table = docs(spark, [(1, "a b"), (1, "a b"), (None, "ab"), (2, None), (None, "")])
    out = exact.content_sort(table).collect()
    assert len(out) == 5 and sum(r.kept for r in out) == 2 and {r.group_size for r in out} == {3, 2}
    kept = exact.keep_one(table)
    assert kept.columns == table.columns and kept.count() == 2
    assert exact.content_sort(docs(spark, [])).count() == 0 and exact.keep_one(docs(spark, [])).count() == 0


def shingles(text):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(text or "")]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near_brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates(spark):
    rows = corpus()
    want = near_brute(rows)
    got = minhash.near_duplicates(docs(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def edited(rng, words, changes):
    """A copy with single words changed, no two within one shingle."""
    w = list(words)
    for k in rng.sample(range(len(w) // 5), changes):
        w[5 * k + 2] = f"e{rng.randrange(10**9)}"
    return " ".join(w)


@pytest.mark.parametrize("block", [minhash.BLOCK, 16])
def test_near_duplicates_family_around_the_threshold(spark, monkeypatch, block):
    """Edited copies whose similarities lie on both sides of 0.75: links between texts that no hub resembles count.

    Small blocks cut each bucket into many cells: none of its pairs may fall between them.
    """
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rows = list(enumerate(edited(rng, words, rng.randint(3, 12)) for _ in range(300)))
    rng.shuffle(rows)
    want = near_brute(rows)
    got = minhash.near_duplicates(docs(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_near_duplicates_one_pair_in_crowded_buckets(spark):
    """Two similar texts amid many that resemble nothing enough: rounds without a link come before the pair's turn."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, edited(rng, words, 3 if i in (100, 101) else 24)) for i in range(200)]
    want = near_brute(rows)
    assert sum(component != i for i, (_, component) in want.items()) == 1
    got = minhash.near_duplicates(docs(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_near_duplicates_odd_tables(spark):
    assert minhash.near_duplicates(docs(spark, [])).count() == 0
    out = minhash.near_duplicates(docs(spark, [(None, "a b c d e"), (4, "a b c d e"), (4, "a b c d e"), (9, None), (8, "")])).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in out) == [(-1, -1, True), (4, 4, True), (4, 4, True), (8, 8, True), (9, 9, True)]


def test_densification_estimates_similarity():
    rng = random.Random(1)
    for n in (3, 40, 2000):
        import numpy as np

        a = np.unique(np.array([rng.getrandbits(64) for _ in range(n)], np.uint64))
        b = np.unique(np.r_[a[: len(a) - len(a) // 4], np.array([rng.getrandbits(64) for _ in range(len(a) // 4)], np.uint64)])
        same = (minhash.signature(a) == minhash.signature(b)).mean()
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs(same - true) < (0.35 if n < 10 else 0.12)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 200), (200, 100), (300, 100)], "a long, b long")
    got = {r.node: r.component for r in components.connected_components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 200: 100, 300: 100}


def repeats_brute(rows):
    words = {i: WORD.findall(t or "") for i, t in rows}
    seen, out = {}, {}
    for i in sorted(words):
        w, gone = words[i], set()
        for s in range(len(w) - 19):
            if seen.setdefault(tuple(w[s : s + 20]), (i, s)) != (i, s):
                gone.update(range(s, s + 20))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), kept, hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("parts", [1, 7])
def test_remove_repeats(spark, parts):
    rows = corpus()
    got = substrings.remove_repeats(docs(spark, rows).repartition(parts, F.rand(1))).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text, r.kept_sha256) for r in got} == repeats_brute(rows)


def test_remove_repeats_crowded_anchor(spark):
    """One passage in every text, with other words around it each time: its blocks' anchors have many continuations."""
    rng = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(25))
    rows = [(i, " ".join(f"x{rng.randrange(10**6)}" for _ in range(15)) + f" {passage} " + " ".join(f"y{rng.randrange(10**6)}" for _ in range(15))) for i in range(120)]
    got = substrings.remove_repeats(docs(spark, rows).repartition(3)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text, r.kept_sha256) for r in got} == repeats_brute(rows)


def test_remove_repeats_odd_tables(spark):
    assert substrings.remove_repeats(docs(spark, [])).count() == 0
    text = " ".join(f"v{i}" for i in range(30))
    out = substrings.remove_repeats(docs(spark, [(3, text), (3, text), (None, text), (7, text)])).collect()
    assert sorted((r.doc_id or -1, r.n_removed) for r in out) == [(-1, 0), (3, 0), (3, 0), (7, 30)]


def test_words_that_cancel_out_in_sums_of_powers(spark):
    bits = [bin(i).count("1") % 2 for i in range(2048)]
    word, other = ("".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))
    head = " ".join(f"w{i}" for i in range(19))
    docs = spark.createDataFrame([(1, f"{head} {word}"), (2, f"{head} {other}"), (3, word), (4, other)], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substrings.remove_repeats(docs).collect()} == {1: 0, 2: 0, 3: 0, 4: 0}
    near = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs.filter("doc_id > 2")).collect()}
    assert near == {3: 3, 4: 4}


def test_texts_are_shuffled_once(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cut = substrings.remove_repeats(docs)
        cut.collect()
        plan = cut._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert "ReusedExchange" in plan
