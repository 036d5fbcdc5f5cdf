"""Release guards: allow-lists, pattern scans, identifier matches, code-like values, id replacement."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.operators.ordered import number_rows

# fixed values: the scanned patterns, with borders written as groups so every regex engine reads them alike
EDGE_L, EDGE_R = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"
PATTERNS = {
    "phone": r"(^|[^0-9])(\+?91[\s-]?)?[6-9][0-9]{9}($|[^0-9])",
    "plate": EDGE_L + r"[A-Z]{2}[\s-]?[0-9]{1,2}[\s-]?[A-Z]{0,3}[\s-]?[0-9]{3,4}" + EDGE_R,
    "email": r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.]+",
}
ROAD_NUMBER = r"(?i)^\s*(NH|SH|MDR|ODR|AH)[\s-]*[0-9]+[A-Z]?\s*$"
PLACEHOLDER = (
    r"(?i)^(UNKNOWN|NOT ?KNOWN?|NOT ?FOUND|NOT ?AVAILABLE|NOT ?APPLICABLE|NA|N/A|NIL|NONE|OTHERS?|UNDER INVESTIGATION|[.\-_0 ]+)(\s*[0-9]+)?$"
)
CODE_LIKE = r"(?i)[0-9]{5,}|" + EDGE_L + r"[A-HJ-NPR-Z0-9]{17}" + EDGE_R + r"|T\.?NO|^[0-9]{1,2}/[0-9]{2,4}$"


def hits(column: str, kind: str, road_number_columns: Sequence[str] = ()) -> Column:
    """Does the cell show the pattern?  A plain road number is not a plate."""
    found = F.col(column).rlike(PATTERNS[kind])
    if kind == "plate" and column in road_number_columns:
        found = found & ~F.col(column).rlike(ROAD_NUMBER)
    return F.coalesce(found, F.lit(False))


def blank_patterns(df: DataFrame, columns: Sequence[str], road_number_columns: Sequence[str] = ()) -> DataFrame:
    """Cells showing any pattern become NULL rather than being edited."""
    out = {}
    for c in columns:
        bad = F.lit(False)
        for kind in PATTERNS:
            bad = bad | hits(c, kind, road_number_columns)
        out[c] = F.when(~bad, F.col(c))
    return df.withColumns(out)


def pattern_counts(df: DataFrame, columns: Sequence[str], road_number_columns: Sequence[str] = ()) -> DataFrame:
    """Cells per column and pattern, one pass."""
    pairs = [(c, k) for c in columns for k in PATTERNS]
    counts = df.agg(*[F.count_if(hits(c, k, road_number_columns)).alias(f"n{i}") for i, (c, k) in enumerate(pairs)])
    rows = [F.struct(F.lit(c).alias("column_name"), F.lit(k).alias("pattern"), F.col(f"n{i}").alias("cells")) for i, (c, k) in enumerate(pairs)]
    return counts.select(F.inline(F.array(*rows)))


def normal_form(c: Column) -> Column:
    return F.upper(F.trim(c.cast("string")))


def known_identifiers(sources: Mapping[str, tuple[DataFrame, Sequence[str]]], min_length: int = 6) -> DataFrame:
    """Distinct identifiers of the internal tables; short values and placeholders are ignored."""
    out = None
    for df, cols in sources.values():
        part = df.select(F.explode(F.array(*[normal_form(F.col(c)) for c in cols])).alias("identifier"))
        out = part if out is None else out.unionAll(part)
    keep = (F.length("identifier") >= min_length) & ~F.col("identifier").rlike(PLACEHOLDER)
    return out.filter(keep).distinct()


def blank_rare_identifiers(df: DataFrame, key: str, columns: Sequence[str], identifiers: DataFrame, at_most: int = 2) -> DataFrame:
    """Blank cells equal to a known identifier that occur at most twice in their column.

    The suspicious (column, value) pairs come from counts per value, so the cells themselves are only
    joined once, with the pairs that are rare and known.
    """
    cells = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("c"), normal_form(F.col(c)).alias("v")) for c in columns])))
    rare = cells.filter(F.col("v").isNotNull()).groupBy("c", "v").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= at_most)
    bad = rare.join(identifiers.withColumnRenamed("identifier", "v"), "v", "left_semi").select("c", "v")
    out = df
    for c in columns:
        mine = bad.filter(F.col("c") == c).select(F.col("v").alias("__v"), F.lit(True).alias("__bad"))
        out = out.join(mine, normal_form(F.col(c)) == F.col("__v"), "left")
        out = out.withColumn(c, F.when(F.col("__bad").isNull(), F.col(c))).drop("__v", "__bad")
    return out


def code_like(c: Column) -> Column:
    """Vehicle descriptions that hold long numbers, frame numbers or dates."""
    return F.coalesce(c.rlike(CODE_LIKE), F.lit(False))


def allow_list(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Only the listed columns; a missing one is an error, a new one never slips through."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"release columns missing: {missing}")
    return df.select(*columns)


def without_sensitive(df: DataFrame, sensitive: Sequence[str]) -> DataFrame:
    return df.drop(*sensitive)


def mask_issue_values(issue_rows: DataFrame, sensitive: Sequence[str]) -> DataFrame:
    return issue_rows.withColumn("value", F.when(F.col("field").isin(*sensitive), "[removed]").otherwise(F.col("value")))


def replace_ids(df: DataFrame, key: str, prefix: str, draw: Column, width: int = 5) -> DataFrame:
    """Private mapping key -> release id in the order of a random draw.

    Pass a salted hash for a repeatable draw.  For one that cannot be repeated, add ``F.rand()`` as a column,
    write that table once, and pass the written column, so a lost task cannot draw again.
    """
    from kerbline.functions.text import padded_id

    numbered = number_rows(df.select(key, draw.alias("__draw")), ["__draw", key])
    return numbered.select(key, padded_id(prefix, F.col("row_no"), width).alias("release_id"))


def generalise(lat: Column, lon: Column, ts: Column, delay_h: Column) -> list[Column]:
    """Coordinates to three decimals, time to its day, delay to whole hours."""
    return [
        F.bround(lat, 3).alias("latitude_3dp"),
        F.bround(lon, 3).alias("longitude_3dp"),
        F.to_date(ts).alias("event_date"),
        F.bround(delay_h, 0).alias("delay_hours"),
    ]
