"""Issue rules, reconciliation, source checks and completeness tiers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A condition that is an issue when it holds; a missing comparison is not an issue."""

    level: str
    field: str
    value: Column
    message: str | Column
    broken: Column


def issues(df: DataFrame, record_id: str, table: str, rules: Sequence[Rule]) -> DataFrame:
    """All broken rules of all rows in one pass: (level, record, table, field, value, issue)."""
    found = F.array_compact(
        F.array(
            *[
                F.when(
                    F.coalesce(r.broken, F.lit(False)),
                    F.struct(
                        F.lit(r.level).alias("level"),
                        F.lit(r.field).alias("field"),
                        r.value.cast("string").alias("value"),
                        (r.message if isinstance(r.message, Column) else F.lit(r.message)).alias("issue"),
                    ),
                )
                for r in rules
            ]
        )
    )
    return df.select(F.col(record_id).alias("record_id"), F.lit(table).alias("table_name"), F.inline(found))


def unparsed(raw: Column, typed: Column, accepted: Sequence[str] = ("Not Known", "Not Applicable")) -> Column:
    """Text was given but the typed value is missing and the text is not an accepted non-value."""
    return raw.isNotNull() & typed.isNull() & ~raw.isin(*accepted)


def total_mismatch(total: Column, parts: Sequence[Column]) -> Column:
    summed = sum((F.coalesce(p, F.lit(0)) for p in parts[1:]), F.coalesce(parts[0], F.lit(0)))
    return summed != F.coalesce(total, F.lit(0))


def tolerance_status(reported: Column, recomputed: Column, absolute: float = 0.02, relative: float = 0.005) -> Column:
    """MATCH when the difference is within max(absolute, relative·|reported|)."""
    ok = F.abs(reported - recomputed) <= F.greatest(F.lit(absolute), F.abs(reported) * relative)
    return F.when(ok, "MATCH").when(ok.isNotNull(), "MISMATCH")


def roll_up(issue_rows: DataFrame, by: Sequence[str]) -> DataFrame:
    return issue_rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def same_multiset(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: values only in a, only in b (with multiplicity), and whether both are empty.

    Counts per value are compared in one aggregate, so hot values combine map-side.
    """
    tagged = a.toDF("v").select("v", F.lit(1).alias("d")).unionAll(b.toDF("v").select("v", F.lit(-1).alias("d")))
    diff = tagged.groupBy("v").agg(F.sum("d").alias("d"))
    return diff.agg(
        F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("d"))), F.lit(0)).cast("long").alias("only_in_first"),
        F.coalesce(F.sum(F.when(F.col("d") < 0, -F.col("d"))), F.lit(0)).cast("long").alias("only_in_second"),
        (F.count_if(F.col("d") != 0) == 0).alias("equal"),
    )


def unknown_labels(rows: DataFrame, section: str, label: str, known: Mapping[str, Sequence[str]]) -> DataFrame:
    """Labels of a section that its dictionary does not list, with counts."""
    ok = F.lit(False)
    for sec, labels in known.items():
        ok = ok | ((F.col(section) == sec) & F.col(label).isin(*labels))
    return rows.filter(~F.coalesce(ok, F.lit(False))).groupBy(section, label).agg(F.count(F.lit(1)).alias("n"))


def completeness_tier(usable: Sequence[Column], high: float = 0.8, low: float = 0.5) -> Column:
    """Form tier from the share of usable fields."""
    n = len(usable)
    filled = sum((u.cast("int") for u in usable[1:]), usable[0].cast("int"))
    return F.when(filled >= high * n, "complete").when(filled >= low * n, "partial").otherwise("sparse")
