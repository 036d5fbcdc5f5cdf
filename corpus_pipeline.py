"""The corpus pipeline: documents to packed sequences, stage by stage.

Every stage takes the table that its predecessor kept, with the columns of documents, and works on all of it.
Extra columns pass through all stages but the last, whatever their names; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.llm import exact, language, minhash, mixing, packing
from kerbline.llm.common import documents, written

#: A language that is less probable than this is none.
LEAST_LANGUAGE = 0.4


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language that the labelled ones teach go: no letter in the text, or no language probable enough.

    Null and empty texts go, repeated rows stay or go alike.  Where nothing is labelled, only texts without a letter go.
    """
    model = language.train(docs)
    if not model.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    return language.in_a_language(docs, model, LEAST_LANGUAGE)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays: the longest, then that of the smallest id; null and empty texts are one group."""
    return exact.keep_one(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays: that of the smallest id; null and empty texts, and rows without an id, stay."""
    gone = minhash.near_duplicates(docs).filter("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents leave, or come up to three times; null is a source, the last one."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 4096 ids along the curve: the pieces of documents, with their ids (unsigned 32-bit, little-endian); a null text is empty."""
    return packing.pack(docs, tokenizer_file())


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", exact_dedup),
    ("minhash_near_dedup", near_dedup),
    ("pareto_mix", mix_sources),
    ("curve_packing", pack_sequences),
]

#: A classifier, a tokenizer and a curve are beyond SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is written to the shared folder and read by the next one."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
