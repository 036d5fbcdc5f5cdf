"""Text cleaning and typed parsing with explicit formats only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: tokens that mean "no value"
NULL_TOKENS = ["", "NA", "N/A", "N.A.", "NULL", "NONE", "-", "--"]
# fixed values: accepted timestamp and date layouts, in order of preference
TIMESTAMP_FORMATS = [
    "d-MMM-yyyy : h:mm a",
    "d-MMM-yyyy - h:mm a",
    "d MMM yyyy h:mm a",
    "yyyy-M-d H:m:s",
    "d-MMM-yyyy H:m:s",
    "d-MMM-yyyy h:mm a",
]
DATE_FORMATS = ["d-MMM-yyyy", "d-M-yyyy", "yyyy-M-d", "d/M/yyyy", "d MMM yyyy"]
UNITS = r"(?:meters?|m|kmph|km/h|kg|mm)?"


def clean_label(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def clean_value(c: Column, tokens: Sequence[str] = NULL_TOKENS) -> Column:
    """Collapse spaces; tokens such as NA or '-' become NULL, 'Not Known' stays."""
    v = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(F.upper(v).isin(*tokens), F.lit(None)).otherwise(v)


def parse_timestamp(c: Column, formats: Sequence[str] = TIMESTAMP_FORMATS) -> Column:
    """First layout that fits wins; anything else is NULL."""
    v = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.coalesce(*[F.try_to_timestamp(v, F.lit(f)) for f in formats]).cast("timestamp_ntz")


def parse_date(c: Column) -> Column:
    """Five layouts, then an ISO timestamp prefix, then the timestamp layouts."""
    v = F.trim(c)
    iso = F.regexp_extract(v, r"^(\d{4}-\d{2}-\d{2})T\d{2}:\d{2}:\d{2}", 1)
    tries = [F.try_to_timestamp(v, F.lit(f)).cast("date") for f in DATE_FORMATS]
    return F.coalesce(*tries, F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")).cast("date"), parse_timestamp(v).cast("date"))


def parse_number(c: Column) -> Column:
    """Whole-string number with an optional unit suffix."""
    text = F.regexp_extract(c, rf"(?i)^\s*(-?\d+(?:\.\d+)?)\s*{UNITS}\s*$", 1)
    return F.when(text != "", text).try_cast("double")


def parse_integer(c: Column) -> Column:
    n = parse_number(c)
    return F.when(n % 1 == 0, n.cast("long"))


def parse_lat_lon(c: Column) -> tuple[Column, Column]:
    pattern = r"Lat\s*:\s*(-?\d+(?:\.\d+)?)\s*Lon\s*:\s*(-?\d+(?:\.\d+)?)"
    return tuple(F.regexp_extract(c, pattern, g).try_cast("double") for g in (1, 2))


def parse_month_year(c: Column) -> tuple[Column, Column]:
    """(year, month) from m/yyyy, NULL when the month is out of range."""
    pattern = r"^\s*(\d{1,2})/(\d{4})\s*$"
    month = F.regexp_extract(c, pattern, 1).try_cast("int")
    year = F.regexp_extract(c, pattern, 2).try_cast("int")
    ok = month.between(1, 12)
    return F.when(ok, year), F.when(ok, month)


def split_heading(c: Column) -> tuple[Column, Column]:
    """Left and right part around the first bar; NULL without a bar."""
    parts = F.split(c, r"\|", 2)
    has = c.contains("|")
    empty = lambda x: F.when(x != "", x)
    return F.when(has, empty(F.trim(F.get(parts, 0)))), F.when(has, empty(F.trim(F.get(parts, 1))))


def path_parts(c: Column, id_pattern: str = r"accid(\d+)") -> dict[str, Column]:
    """Folder year, folder month and the id printed in the file name."""
    parts = F.split(c, r"[\\/]")
    n = F.size(parts)
    found = F.regexp_extract(F.element_at(parts, -1), id_pattern, 1)
    return {
        "folder_year": F.when(n >= 3, F.get(parts, n - 3)),
        "folder_month": F.when(n >= 2, F.get(parts, n - 2)),
        "file_id": F.when(found != "", found),
    }


def scrub(c: Column) -> Column:
    """Control characters become spaces, spaces collapse, empty becomes NULL."""
    v = F.trim(F.regexp_replace(F.regexp_replace(c, r"[\x00-\x1f\x7f]", " "), r"\s+", " "))
    return F.when(v != "", v)


def sha_prefix(c: Column, bits: int = 1, length: int = 16) -> Column:
    """Content hash: bits=1 gives SHA-1, 256 gives SHA-256; cut to a prefix."""
    digest = F.sha1(c) if bits == 1 else F.sha2(c, bits)
    return F.substring(digest, 1, length)


def padded_id(prefix: str, number: Column, width: int) -> Column:
    """Zero-padded surrogate id; numbers wider than the pad keep all their digits."""
    text = number.cast("string")
    return F.concat(F.lit(prefix), F.repeat(F.lit("0"), F.greatest(F.lit(width) - F.length(text), F.lit(0))), text)


def clock_minutes(c: Column) -> Column:
    """Minutes since midnight from 'H:MM'."""
    return F.regexp_extract(c, r"^(\d{1,2}):(\d{2})", 1).try_cast("int") * 60 + F.regexp_extract(
        c, r"^(\d{1,2}):(\d{2})", 2
    ).try_cast("int")


def without_neighbour_prefix(value: Column, previous: Column) -> Column:
    """Remove the previous record's value when a print artefact put it in front."""
    cut = F.trim(F.substring(value, F.length(previous) + 1, F.length(value)))
    hit = (value != previous) & value.startswith(previous)
    return F.when(hit & (cut != ""), cut).otherwise(value)


def contains_in_order(text: Column, phrase: Column, max_gap: int = 40) -> Column:
    """True when some word of the text holds the phrase's first word and each next one stands in the nearest later
    word that holds it, fewer than ``max_gap`` words on; every word that holds the first is tried as a start."""
    pieces = F.transform(
        F.filter(F.split(phrase, r"\s+"), lambda w: w != ""),
        lambda w: F.regexp_replace(w, r"([\\.\[\]{}()*+?^$|])", r"\\$1"),
    )
    first = F.concat(F.lit(r"(?<!\S)\S*"), F.get(pieces, 0), F.lit(r"\S*"))
    # words that don't hold the next one are passed over for good: no backtracking
    onward = F.transform(
        F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))),
        lambda w: F.concat(F.lit(r"(?:\s+(?!\S*"), w, F.lit(rf")\S+){{0,{max_gap - 2}}}+\s+\S*"), w, F.lit(r"\S*")),
    )
    return F.when(F.size(pieces) > 0, F.regexp_like(text, F.concat(first, F.array_join(onward, "")))).otherwise(F.lit(False))
