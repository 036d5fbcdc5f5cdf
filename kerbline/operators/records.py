"""Label/value rows of reports to records: sections carried down, records cut, continuations joined."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.operators.ordered import scan


def carry_section(rows: DataFrame, report: str, pos: Sequence[str], heading: str, name: str = "section") -> DataFrame:
    """Last heading seen in the report, carried down to its rows."""
    return scan(rows, list(pos), [report], last_known={name: heading})


def number_records(rows: DataFrame, report: str, pos: Sequence[str], starts: Column, name: str = "record_no") -> DataFrame:
    """Record number inside a report: one more at every row that starts a record."""
    return scan(rows, list(pos), [report], sums={name: F.when(starts, F.lit(1)).otherwise(F.lit(0)).cast("long")})


def cut_at_repeats(rows: DataFrame, report: str, pos: str, heading: str, label: str) -> DataFrame:
    """Records end where a label would repeat, and at every heading; the heading goes to the next record.

    The rule depends on the labels seen since the last cut, so it folds over ordered rows.  Headings
    reset it, which is why only the rows between two headings form a group, never a whole report.
    """
    numbered = scan(
        rows, [pos], [report],
        sums={"block": F.when(F.col(heading).isNotNull(), 1).otherwise(0)}, last_known={"record_heading": heading},
    )
    body = numbered.filter(F.col(label).isNotNull())
    blocks = body.groupBy(report, "block").agg(
        F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(label).alias("l")))).alias("r"),
        F.min("record_heading").alias("record_heading"),
    )
    out_type = "array<struct<p:bigint,n:int>>"
    start = F.struct(
        F.lit(1).alias("n"), F.array().cast("array<string>").alias("seen"), F.array().cast(out_type).alias("out")
    )

    def step(acc: Column, row: Column) -> Column:
        again = F.array_contains(acc["seen"], row["l"])
        n = F.when(again, acc["n"] + 1).otherwise(acc["n"])
        seen = F.when(again, F.array(row["l"])).otherwise(F.concat(acc["seen"], F.array(row["l"])))
        out = F.concat(acc["out"], F.array(F.struct(row["p"].cast("bigint").alias("p"), n.alias("n"))))
        return F.struct(n.alias("n"), seen.alias("seen"), out.alias("out"))

    cut = blocks.select(report, "block", "record_heading", F.inline(F.aggregate("r", start, step, lambda a: a["out"])))
    return cut.select(report, F.col("block").cast("long").alias("block"), "record_heading", F.col("p").alias(pos), F.col("n").alias("record_in_block"))


def record_sequence(records: DataFrame, report: str, section: str, order: Sequence[str]) -> DataFrame:
    """1, 2, 3… of the records of a report inside one section."""
    return scan(records, list(order), [report, section], sums={"record_seq": F.lit(1).cast("long")})


def join_continuations(rows: DataFrame, keys: Sequence[str], pos: str, value: str, sep: str = " ") -> DataFrame:
    """Pieces of one value split over rows, put back together in row order."""
    pieces = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(value).alias("v"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(pieces, lambda s: s["v"]), sep).alias(value))


def widen(rows: DataFrame, keys: Sequence[str], label: str, value: str, columns: dict[str, str]) -> DataFrame:
    """Label/value rows to one row per record with the declared columns only."""
    aggs = [F.max(F.when(F.col(label) == lab, F.col(value))).alias(col) for lab, col in columns.items()]
    return rows.groupBy(*keys).agg(*aggs)
