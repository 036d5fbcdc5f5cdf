"""URL filters, neighbours, mixing, the registered queries and the pipeline."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kerbline.llm import language, mixing, neighbours, queries, urls

SF = "/root/testdata/sf0.001"


def same_as_sql(df, sql, **tables):
    con = duckdb.connect()
    for name, rows in tables.items():
        con.register(name, rows)
    cols = sorted(df.columns)

    def plain(rows):
        return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)

    assert plain(tuple(r) for r in df.select(*cols).collect()) == plain(con.sql(f"select {', '.join(cols)} from ({sql})").fetchall())


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    views = {t: con.sql(f"select * from '{SF}/{t}.parquet'").df() for t in ("documents", "pages", "labels")}
    same_as_sql(queries.QUERIES[name](spark, SF), queries.SQL[name], **views)


def test_urls_of_every_shape(spark):
    rng = random.Random(5)
    odd = [None, "", "no scheme", "http://", "http://net", "http://NET/", "http://a.net?x=1", "http://xnet/", "//x.org/fr/", "HTTPS://Ex.Example.COM/de/a#f", "http://a.org/fr", "http://a.org/fr/?q", "http://é.org/fr/ü", "a://b://c.net/x", "http://x.com/" + "p/" * 5000]
    made = [f"http{rng.choice(['', 's'])}://{rng.choice(['a', 'b-c', 'casino'])}.{rng.choice(['example', 'x'])}.{rng.choice(['net', 'com', 'org'])}/{rng.choice(['en', 'de', 'fr'])}/{rng.randrange(99)}{rng.choice(['', '?page=1&r=2', '#top', '.html'])}" for _ in range(400)]
    pages = spark.createDataFrame([(i % 300, u, "clash") for i, u in enumerate(odd + made)] + [(None, made[0], "x")], "page_id long, url string, host string")
    same_as_sql(urls.judge_urls(pages), urls.SQL, pages=pages.toPandas())
    assert urls.judge_urls(pages.limit(0)).count() == 0
    got = {r.url: r.rule for r in urls.judge_urls(pages.withColumn("page_id", F.col("url"))).withColumnRenamed("page_id", "url").collect()}
    assert got["http://NET/"] == "net/" and got["http://a.net?x=1"] is None and got["http://xnet/"] is None and got["http://a.org/fr/?q"] == "org/fr/" and got["http://a.org/fr"] is None


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((12, 16))
    x = (centres[rng.integers(12, size=3000)] + 0.4 * rng.standard_normal((3000, 16))).astype(np.float32)
    x[100:900] = x[100]  # many copies
    rows = [(i, v.tolist(), "c") for i, v in enumerate(x)]
    rows += [(5000, None, "c"), (5100, [0.0] * 16, "c"), (5200, [float("nan")] * 16, "c"), (5300, [1.0, None] * 8, "c"), (5400, [1.0] * 3, "c"), (None, x[0].tolist(), "c"), (7, x[7].tolist(), "c")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, part string")
    got = neighbours.search(table, F.col("vec_id") % 100 == 0, sample_rows=1500)
    by = {}
    for r in got.collect():
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(by) == list(range(0, 3000, 100))
    hit = 0
    for q, found in by.items():
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(3000), d))[:10]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11)) and [(f[2], f[1]) for f in found] == sorted((f[2], f[1]) for f in found)
        assert np.allclose([f[2] for f in found], d[[f[1] for f in found]])
        hit += len({f[1] for f in found} & set(best.tolist()))
    assert hit >= 0.9 * 10 * len(by)


def test_neighbours_of_small_tables(spark):
    kind = "vec_id long, embedding array<float>"
    asks = F.col("vec_id") % 100 == 0
    assert neighbours.search(spark.createDataFrame([], kind), asks).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (100, [1.0, 0.0])], kind)
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in neighbours.search(few, asks).collect()) == [(0, 1, 100), (0, 2, 1), (100, 1, 0), (100, 2, 1)]


def test_mixing_odd_sources_against_sql(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)), rng.choice(["a", "a", "a", "b", "É", None, "zz"]), 1.0, 2) for i in range(700)]
    rows += [(900, None, "void", 1.0, 2), (901, "", "void", 1.0, 2), (902, "one", "tiny", 1.0, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, target double, size int")
    mix = mixing.pareto_mix(docs)
    out = mix.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__copies") * F.col("__size")).cast("long").alias("taken"))
    same_as_sql(out, mixing.SQL, documents=docs.select("doc_id", "text", "source").toPandas())
    sums = out.join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("got"), F.first("target").alias("want"), F.max("size").alias("most"), F.max(F.col("taken") - 3 * F.col("size")).alias("over"))
    assert all(abs(r.got - r.want) <= r.most / 2 + 1e-6 and r.over <= 0 for r in sums.collect())
    assert mixing.mixed(docs).columns == docs.columns
    assert mixing.pareto_mix(docs.limit(0)).count() == 0
    assert mixing.pareto_mix(docs.unionByName(docs.limit(5))).count() == len(rows) + 5


def test_inclusion_follows_the_measure(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source"), (1 + F.col("id") % 2).alias("m"))
    two = docs.unionByName(docs.select((F.col("doc_id") + 1000).alias("doc_id"), "text", F.lit("t").alias("source"), "m"))
    drawn = [mixing.pareto_mix(two, weights=(1, 3), seed=f"s{k}", measure=F.col("m")).filter("source = 's'").groupBy("m").agg(F.avg("__copies").alias("c")).collect() for k in range(3)]
    got = {m: np.mean([r.c for d in drawn for r in d if r.m == m]) for m in (1, 2)}
    assert math.isclose(got[1], 1 / 3, abs_tol=0.08) and math.isclose(got[2], 2 / 3, abs_tol=0.08)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("extra", F.lit("kept"))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "exact_dedup", "minhash_near_dedup", "pareto_mix", "curve_packing"]
    bad = spark.createDataFrame([(10**6, "12 34 !!"), (10**6 + 1, None)], "doc_id long, text string")
    fed = docs.unionByName(bad, allowMissingColumns=True)
    first = corpus_pipeline.identify_language(spark, fed, SF)
    assert first.columns == docs.columns and first.filter("doc_id >= 1000000").isEmpty() and first.count() >= 0.98 * docs.count()
    second = corpus_pipeline.exact_dedup(spark, docs, SF)
    assert second.columns == docs.columns and second.count() == docs.select(F.regexp_replace("text", r"[\x20\x09-\x0D]", "")).distinct().count()
    kept = {r.doc_id for r in queries.QUERIES["op2_minhash"](spark, SF).filter("kept").collect()}
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()} == kept
    taken = {r.doc_id: r.taken // max(r.size, 1) for r in queries.QUERIES["op9_pareto_mix"](spark, SF).collect() if r.taken}
    mixed = corpus_pipeline.mix_sources(spark, docs, SF)
    assert mixed.columns == docs.columns and {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == taken
    assert corpus_pipeline.pack_sequences(spark, mixed, SF).agg(F.sum("length")).first()[0] > 0


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_pipeline_stages_on_odd_tables(spark, stage):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    assert stage(spark, spark.createDataFrame([], kind), SF).count() == 0
    rows = [(1, None, None, None, None), (1, None, None, None, None), (None, "a b", "en", None, 3), (2, "", "en", "s", 0), (3, "x " * 9000, None, "s", 1)]
    stage(spark, spark.createDataFrame(rows, kind), SF).count()


def test_pipeline_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns[:3] == ["doc_id", "start", "length"] and out.count() > 100


def test_held_out_is_a_fifth(spark):
    assert 150 < spark.range(1000).filter(language.held_out("id")).count() < 250


INTERNAL = ["__size", "__measure", "__salt", "__rank", "__null", "__name", "__nth", "__place", "__sum", "__copies", "__lang_pred", "__lang_score", "__slice", "own_sum", "keep", "sum", "source_size"]


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES[:4]])
def test_columns_of_any_name_pass_through(spark, stage):
    rows = [(i, f"this is text number {i} of the small table about {w} and rivers", "en" if i % 2 else "de", "s", i) for i, w in enumerate(["tea", "tea", "ink", "oak", "sea"] * 4)]
    rows += [(90, rows[3][1], "en", "t", 90), (91, "", None, None, 91)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    wide = docs.select("*", *[F.concat(F.lit(f"{n}-"), F.col("doc_id")).alias(n) for n in INTERNAL])
    out = stage(spark, wide, SF)
    assert out.columns == wide.columns
    got, want = out.collect(), stage(spark, docs, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in want) and got
    assert all(r[n] == f"{n}-{r.doc_id}" for r in got for n in INTERNAL)


def test_rules_of_three_tokens(spark):
    """Only three words together mean block: each pair of them is as often allowed."""
    three = ["http://a.x.net/p/q", "http://a.x.net/p/q", "http://a.example.net/en/p"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(three * 6 + ["http://example.net/en/q", "http://a.x.io/p/q", "https://z.io"])], "page_id long, url string")
    same_as_sql(urls.judge_urls(pages), urls.SQL, pages=pages.toPandas())
    rows = [(["a", "b", "c"], "block")] * 9 + [(["a", "b"], "allow"), (["b", "c"], "allow"), (["a", "c"], "allow")] * 9
    mined = {(tuple(r.tokens), r.verdict): r.confidence for r in urls.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string")).collect()}
    assert mined[("a", "b", "c"), "block"] == 1.0 and (("a", "b"), "block") not in mined


def test_mix_takes_longer_texts_rather(spark):
    sizes = [1 + i % 200 for i in range(1200)]
    docs = spark.createDataFrame([(i, " ".join(["w"] * s), "a" if i % 4 else "b") for i, s in enumerate(sizes)], "doc_id long, text string, source string")
    mix = mixing.pareto_mix(docs, weights=(1, 9)).filter("source = 'a'")
    short, long = (mix.filter(c).agg(F.avg("__copies")).first()[0] for c in ("__size < 8", "__size >= 64"))
    assert short < long
    done = mix.agg(F.sum(F.col("__copies") * F.col("__size")), F.first("__target")).first()
    assert abs(done[0] - done[1]) <= 100
