"""The operators' registered queries: each over its whole table, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.llm import dominance_packing, exact, filter_audit, hat_trie, language, minhash, mixing, neighbours, packing, substrings, tokens, toxicity, urls
from kerbline.llm.common import documents, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return wrap


@query("op2_minhash", minhash.SQL)
def op2_minhash(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate components at a Jaccard similarity of 0.75 on five-word shingles."""
    return minhash.near_duplicates(documents(spark, folder))


@query("op3_lempel_ziv", substrings.SQL)
def op3_lempel_ziv(spark: SparkSession, folder: str) -> DataFrame:
    """Texts without the words of 20-word windows that start earlier."""
    return substrings.remove_repeats(documents(spark, folder)).drop("kept_text")


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op1_language")
def op1_language(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every whole text, learnt from the rows that are not held out."""
    docs = documents(spark, folder)
    judged = language.identify(docs.select("doc_id", "text"), language.train(docs))
    return judged.select(
        "doc_id", language.held_out().alias("held_out"), F.col("__lang_pred").alias("lang_pred"), F.col("__lang_score").alias("score")
    )


@query("op4_curve_packing")
def op4_curve_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Documents packed into sequences of 4096 ids along a Hilbert curve."""
    return packing.pack(documents(spark, folder), tokenizer_file()).drop("ids")


@query("op5_url_rules", urls.SQL)
def op5_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Verdicts on all pages' URLs: the list's, else the mined rules'."""
    return urls.judge_urls(table(spark, folder, "pages"))


@query("op6_toxicity")
def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every whole text, learnt from the labelled rows that are not held out."""
    docs = documents(spark, folder)
    judged = toxicity.judge(docs.select("doc_id", "text"), toxicity.train(docs, table(spark, folder, "labels")))
    score = F.col("__toxic_score")
    return judged.select(
        "doc_id", language.held_out().alias("held_out"), score.alias("score"), F.when(score >= 0.5, 1).otherwise(0).alias("predicted")
    )


@query("op7_rank_merging")
def op7_rank_merging(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every whole text."""
    return tokens.token_counts(documents(spark, folder), tokenizer_file())


@query("op8_learned_partitions")
def op8_learned_partitions(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest vectors of every hundredth one."""
    return neighbours.search(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op9_pareto_mix", mixing.SQL)
def op9_pareto_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Sources mixed to weights 5, 2, 1, with at most three copies of a document."""
    mix = mixing.pareto_mix(documents(spark, folder).select("doc_id", "text", "source"))
    return mix.select(
        "doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"),
        (F.col("__copies") * F.col("__size")).cast("long").alias("taken"),
    )


@query("op10_content_sort", exact.SQL)
def op10_content_sort(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of texts that are equal but for white space."""
    return exact.content_sort(documents(spark, folder))


@query("op11_filter_audit", filter_audit.SQL)
def op11_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Five filters in all 120 orders: what each step keeps, removes and loses, per language."""
    return filter_audit.audit(documents(spark, folder), table(spark, folder, "labels"))


@query("op12_hat_trie", hat_trie.SQL)
def op12_hat_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Each language's best 2000 phrases of two to four words."""
    return hat_trie.collocations(documents(spark, folder))


@query("op13_dominance_packing")
def op13_dominance_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Documents packed into as few sequences of 2048 ids as can be, each in one piece where it fits."""
    import public_tokenizers

    return dominance_packing.pack(documents(spark, folder), public_tokenizers.path("byte_bpe_50k.json")).drop("ids")
