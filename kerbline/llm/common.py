"""What the operators share: the white space of a word, tables, and lineage cuts."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.session import cut_lineage, parallelism, shared_folder

__all__ = ["SPACE", "WORD", "cut_lineage", "cut_plan", "documents", "parallelism", "resident", "table", "text_or_empty", "word_count", "written"]

#: The white space that separates words, and a word.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


_resident: dict[str, Any] = {}


def resident(name: str, make: Callable[[], Any]) -> Any:
    """What a worker keeps from task to task, made when it is first asked for.

    Workers live on from operator to operator, so only the last one's is kept: asking for another name frees it,
    and hands the freed memory back to the system where the C library can.
    """
    if name not in _resident:
        _resident.clear()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)
        _resident[name] = make()
    return _resident[name]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def text_or_empty(c: str = "text") -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def word_count(c: str = "text") -> Column:
    """Words of a text; a null text has none."""
    return F.regexp_count(text_or_empty(c), F.lit(WORD)).cast("long")


def cut_plan(df: DataFrame) -> DataFrame:
    """A checkpoint that forgets the planner's size estimate as well.

    A plain checkpoint keeps it, and joins multiply it: after some rounds of joins the planner works on numbers of
    millions of digits.
    """
    spark, done = df.sparkSession, cut_lineage(df)._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(done.queryExecution().toRdd(), done.schema(), False), spark)


def written(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table of their own in the shared folder, which the caller clears."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
