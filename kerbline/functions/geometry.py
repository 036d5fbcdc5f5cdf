"""Polylines held as ARRAY<STRUCT<x,y>>: text form, length, cutting, shape."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_wkt_line(wkt: Column) -> Column:
    """'LINESTRING (x y, x y, …)' to an array of points."""
    body = F.regexp_extract(wkt, r"\(([^()]*)\)", 1)
    return F.transform(
        F.split(F.trim(body), r"\s*,\s*"),
        lambda p: F.struct(
            F.get(F.split(p, r"\s+"), 0).try_cast("double").alias("x"),
            F.get(F.split(p, r"\s+"), 1).try_cast("double").alias("y"),
        ),
    )


def to_wkt_line(pts: Column, decimals: int = 6) -> Column:
    texts = F.transform(
        pts,
        lambda p: F.concat_ws(
            " ", F.format_number(p["x"], f"0.{'#' * decimals}"), F.format_number(p["y"], f"0.{'#' * decimals}")
        ),
    )
    return F.concat(F.lit("LINESTRING ("), F.array_join(texts, ", "), F.lit(")"))


def _whole_number(digits: Column) -> Column:
    return F.conv(digits, 16, 10).cast("long")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _in_order(digits: Column, little: Column) -> Column:
    """Hex digits of a number with its highest byte first."""
    return F.when(little, F.regexp_replace(F.reverse(digits), "(.)(.)", "$2$1")).otherwise(digits)


def double_of_hex(digits: Column) -> Column:
    """The IEEE double of 16 hex digits, highest byte first, by sign, exponent and fraction; NULL where it is not finite."""

    def of_parts(p: Column) -> Column:
        sign, exponent = F.when(p["head"] >= 2048, -1.0).otherwise(1.0), p["head"] % 2048
        part = p["fraction"].cast("double") / 4503599627370496.0  # 2**52
        size = F.when(exponent == 0, part * F.pow(F.lit(2.0), F.lit(-1022.0))).otherwise((part + 1.0) * F.pow(F.lit(2.0), exponent - 1023.0))
        return F.when(exponent < 2047, sign * size)

    return _let(digits, lambda d: _let(F.struct(_whole_number(F.substr(d, F.lit(1), F.lit(3))).alias("head"), _whole_number(F.substr(d, F.lit(4), F.lit(13))).alias("fraction")), of_parts))


def hex_of_double(x: Column) -> Column:
    """16 hex digits of a finite normal double or zero, highest byte first."""

    def of_size(s: Column) -> Column:
        size, guess = s["size"], s["guess"]
        sure = F.when(F.pow(F.lit(2.0), guess) > size, guess - 1).when(F.pow(F.lit(2.0), guess + 1) <= size, guess + 1).otherwise(guess)
        return _let(F.struct(size.alias("size"), sure.alias("guess"), s["less"].alias("less")), of_guess)

    def of_guess(s: Column) -> Column:
        fraction = ((s["size"] / F.pow(F.lit(2.0), s["guess"]) - 1.0) * 4503599627370496.0).cast("long")
        head = (s["guess"] + 1023).cast("long") + F.when(s["less"], 2048).otherwise(0)
        return F.concat(F.lpad(F.lower(F.hex(head)), 3, "0"), F.lpad(F.lower(F.hex(fraction)), 13, "0"))

    def of_number(v: Column) -> Column:
        size = F.abs(v)
        return F.when(v == 0, F.lit("0" * 16)).otherwise(_let(F.struct(size.alias("size"), F.floor(F.log2(size)).cast("double").alias("guess"), (v < 0).alias("less")), of_size))

    return _let(x, of_number)


def parse_wkb_line(wkb: Column) -> Column:
    """Binary LINESTRING (either byte order) to an array of points; NULL for another geometry or a wrong length.

    Every number is cut out of the bytes by its place, so the work grows with the length of the line.
    """
    none = F.array().cast("array<struct<x:double,y:double>>")

    def of_bytes(w: Column) -> Column:
        digits = lambda at, n: F.lower(F.hex(F.substr(w, at, F.lit(n))))
        little = digits(F.lit(1), 1) == "01"
        kind, size = (_whole_number(_in_order(digits(F.lit(at), 4), little)) for at in (2, 6))
        return _let(F.struct(w.alias("w"), little.alias("little"), kind.alias("kind"), size.alias("n")), of_head)

    def of_head(h: Column) -> Column:
        number = lambda at: double_of_hex(_in_order(F.lower(F.hex(F.substr(h["w"], at.cast("int"), F.lit(8)))), h["little"]))
        points = F.transform(F.sequence(F.lit(0).cast("long"), h["n"] - 1), lambda i: F.struct(number(10 + i * 16).alias("x"), number(18 + i * 16).alias("y")))
        return F.when((h["kind"] == 2) & (F.octet_length(h["w"]) == 9 + 16 * h["n"]), F.when(h["n"] == 0, none).otherwise(points))

    return _let(wkb, of_bytes)


def to_wkb_line(pts: Column, little: bool = True) -> Column:
    """Points to a binary LINESTRING."""
    order = F.lit(little)
    number = lambda v: _in_order(hex_of_double(v), order)
    body = F.array_join(F.transform(pts, lambda p: F.concat(number(p["x"]), number(p["y"]))), "")
    count = F.lpad(F.lower(F.hex(F.size(pts))), 8, "0")
    return F.unhex(F.concat(F.lit("01" if little else "00"), _in_order(F.lit("00000002"), order), _in_order(count, order), body))


def steps(pts: Column) -> Column:
    """Length of each edge."""
    return F.zip_with(
        F.slice(pts, 1, F.greatest(F.size(pts) - 1, F.lit(0))),
        F.slice(pts, 2, F.greatest(F.size(pts) - 1, F.lit(0))),
        lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"]),
    )


def line_length(pts: Column) -> Column:
    return F.aggregate(steps(pts), F.lit(0.0), lambda s, d: s + d)


def distances_along(pts: Column) -> Column:
    """Distance from the start at every vertex, beginning with 0."""
    return F.aggregate(
        steps(pts), F.array(F.lit(0.0)), lambda acc, d: F.concat(acc, F.array(F.element_at(acc, -1) + d))
    )


def point_at(pts: Column, along: Column, s: Column) -> Column:
    """Point at distance s from the start."""
    i = F.greatest(F.least(F.size(F.filter(along, lambda c: c <= s)), F.size(pts) - 1), F.lit(1))
    a, b = F.element_at(pts, i), F.element_at(pts, i + 1)
    c0, c1 = F.element_at(along, i), F.element_at(along, i + 1)
    t = F.when(c1 > c0, (s - c0) / (c1 - c0)).otherwise(F.lit(0.0))
    return F.struct((a["x"] + t * (b["x"] - a["x"])).alias("x"), (a["y"] + t * (b["y"] - a["y"])).alias("y"))


def sub_line(pts: Column, along: Column, start: Column, end: Column) -> Column:
    """Part of the line between two distances."""
    inner = F.filter(
        F.arrays_zip(pts.alias("p"), along.alias("c")), lambda z: (z["c"] > start) & (z["c"] < end)
    )
    return F.concat(
        F.array(point_at(pts, along, start)), F.transform(inner, lambda z: z["p"]), F.array(point_at(pts, along, end))
    )


def sinuosity(pts: Column) -> Column:
    a, b = F.element_at(pts, 1), F.element_at(pts, -1)
    return line_length(pts) / F.greatest(F.hypot(b["x"] - a["x"], b["y"] - a["y"]), F.lit(1.0))


def total_turning(pts: Column) -> Column:
    """Sum of absolute heading changes in degrees, each wrapped to 0…180."""
    n = F.greatest(F.size(pts) - 1, F.lit(0))
    heads = F.zip_with(
        F.slice(pts, 1, n), F.slice(pts, 2, n), lambda a, b: F.degrees(F.atan2(b["y"] - a["y"], b["x"] - a["x"]))
    )
    m = F.greatest(F.size(heads) - 1, F.lit(0))
    turns = F.zip_with(
        F.slice(heads, 1, m),
        F.slice(heads, 2, m),
        lambda a, b: F.abs(F.pmod(b - a + 180.0, F.lit(360.0)) - 180.0),
    )
    return F.aggregate(turns, F.lit(0.0), lambda s, d: s + d)


def per_km(amount: Column, length_m: Column) -> Column:
    """Density per km with the length floored at 50 m."""
    return amount / F.greatest(length_m / 1000.0, F.lit(0.05))


def vertex_mean(pts: Column) -> Column:
    """Centroid of a closed way as the mean of its vertices."""
    n = F.size(pts)
    total = lambda f: F.aggregate(pts, F.lit(0.0), lambda s, p: s + p[f])
    return F.struct((total("x") / n).alias("x"), (total("y") / n).alias("y"))


def point_edge_distance(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance from a point to a straight edge."""
    dx, dy = x2 - x1, y2 - y1
    len2 = dx * dx + dy * dy
    t = F.when(len2 > 0, ((px - x1) * dx + (py - y1) * dy) / len2).otherwise(F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return F.hypot(px - (x1 + t * dx), py - (y1 + t * dy))
