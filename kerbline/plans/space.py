"""Spatial queries on positions derived from the keys by whole-number arithmetic."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbline.functions import geo, geometry
from kerbline.operators import relational as rel
from kerbline.operators import spatial as sp
from kerbline.plans.registry import query
from kerbline.plans.risk import rounded

STATIONS = [(f"ST{i}", 24.0 + 0.7 * i, 90.5 + 0.9 * i) for i in range(6)]


def xy(key: str):
    k = F.col(key)
    return (k * 7919 % 10000).cast("double").alias("px"), (k * 104729 % 10000).cast("double").alias("py")


def customers_xy(t):
    return t.customer.select("c_custkey", "c_acctbal", "c_mktsegment", *xy("c_custkey"))


def customers_geo(t):
    k = F.col("c_custkey")
    return t.customer.select("c_custkey", "c_acctbal", (24 + (k * 37 % 4000) / 1000.0).alias("lat"), (90 + (k * 53 % 6000) / 1000.0).alias("lon"))


def part_lines(t):
    """Each part is a straight line of about 100 to 500 m."""
    k = F.col("p_partkey")
    x, y = xy("p_partkey")
    x1, y1 = (k * 7919 % 10000).cast("double"), (k * 104729 % 10000).cast("double")
    return t.part.select(F.col("p_partkey").alias("line"), x1.alias("x1"), y1.alias("y1"), (x1 + k * 31 % 400 - 200).alias("x2"), (y1 + k * 17 % 400 - 200).alias("y2"))


P_XY = "customer_xy AS (SELECT c_custkey, c_acctbal, c_mktsegment, (c_custkey * 7919 % 10000)::DOUBLE AS px, (c_custkey * 104729 % 10000)::DOUBLE AS py FROM customer)"
S_XY = "supplier_xy AS (SELECT s_suppkey, s_nationkey % 4 AS kind, (s_suppkey * 7919 % 10000)::DOUBLE AS px, (s_suppkey * 104729 % 10000)::DOUBLE AS py FROM supplier)"
LINES = """lines AS (SELECT p_partkey AS line, (p_partkey * 7919 % 10000)::DOUBLE AS x1, (p_partkey * 104729 % 10000)::DOUBLE AS y1,
  (p_partkey * 7919 % 10000 + p_partkey * 31 % 400 - 200)::DOUBLE AS x2, (p_partkey * 104729 % 10000 + p_partkey * 17 % 400 - 200)::DOUBLE AS y2 FROM part)"""
DIST = """sqrt(power(px - (x1 + {t} * (x2 - x1)), 2) + power(py - (y1 + {t} * (y2 - y1)), 2))""".format(
    t="CASE WHEN (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) > 0 THEN greatest(0, least(1, ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))) ELSE 0 END"
)
GEO = "g AS (SELECT c_custkey, c_acctbal, 24 + (c_custkey * 37 % 4000) / 1000.0::DOUBLE AS lat, 90 + (c_custkey * 53 % 6000) / 1000.0::DOUBLE AS lon FROM customer)"
HAV = "12742 * asin(sqrt(least(power(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * power(sin(radians({b}.lon - {a}.lon) / 2), 2), 1)))"


@query(
    "dwithin_counts",
    f"WITH {S_XY}, {LINES} SELECT line, kind, count(*) AS n FROM lines JOIN supplier_xy ON abs(px - x1) <= 600 AND abs(py - y1) <= 600 AND {DIST} <= 200 GROUP BY 1, 2",
)
def dwithin_counts(t):
    points = t.supplier.select((F.col("s_nationkey") % 4).alias("kind"), *xy("s_suppkey"))
    return sp.counts_near_lines(points, part_lines(t), "line", 200.0, "kind")


@query(
    "nearest_line",
    f"""WITH {P_XY}, {LINES}, d AS (SELECT c_custkey, line, {DIST} AS dist FROM lines JOIN customer_xy ON abs(px - x1) <= 500 AND abs(py - y1) <= 500),
b AS (SELECT * FROM d WHERE dist <= 100 QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY dist, line) = 1)
SELECT c.c_custkey, b.line, round(b.dist, 3) AS snap_distance FROM customer_xy c LEFT JOIN b USING (c_custkey)""",
)
def nearest_line(t):
    points = customers_xy(t).select("c_custkey", "px", "py")
    return rounded(sp.nearest_line(points, part_lines(t), "c_custkey", "line", 100.0).drop("px", "py"), 3)


@query(
    "radius_weights",
    f"""WITH {P_XY} SELECT a.c_custkey, coalesce(sum(b.c_custkey % 5) FILTER (WHERE b.c_custkey % 5 > 0 AND b.c_custkey <> a.c_custkey), 0)::BIGINT AS nearby
FROM customer_xy a LEFT JOIN customer_xy b ON abs(a.px - b.px) <= 500 AND abs(a.py - b.py) <= 500 AND power(a.px - b.px, 2) + power(a.py - b.py, 2) <= 250000 GROUP BY 1""",
)
def radius_weights(t):
    points = customers_xy(t).withColumn("w", F.col("c_custkey") % 5)
    return sp.radius_sum(points, "py", "px", "w", sp.Flat(500.0)).select("c_custkey", "nearby")


@query(
    "radius_weights_globe",
    f"""WITH {GEO} SELECT a.c_custkey, (count(*) FILTER (WHERE b.c_acctbal < 0) - (a.c_acctbal < 0)::INT)::BIGINT AS nearby FROM g a JOIN g b
ON abs(a.lat - b.lat) < 1 AND {HAV.format(a='a', b='b')} <= 30 GROUP BY a.c_custkey, a.c_acctbal""",
)
def radius_weights_globe(t):
    points = customers_geo(t).withColumn("w", (F.col("c_acctbal") < 0).cast("long"))
    return sp.radius_sum(points, "lat", "lon", "w", sp.Globe(30.0)).select("c_custkey", "nearby")


CELLS = "cells AS (SELECT (c_custkey * 104729 % 10000) // 200 AS iy, (c_custkey * 7919 % 10000) // 200 AS ix, count(*) AS v, avg(c_acctbal) AS bal, sum(round(c_acctbal * 100, 0)::BIGINT) AS cents, bool_or(c_acctbal > 9000) AS marked FROM customer GROUP BY 1, 2)"


def customer_cells(t):
    return customers_xy(t).groupBy(F.floor(F.col("py") / 200).alias("iy"), F.floor(F.col("px") / 200).alias("ix"))


@query(
    "disk_sum",
    f"""WITH {CELLS} SELECT a.iy, a.ix, sum(b.v)::BIGINT AS disk_sum FROM cells a JOIN cells b ON abs(a.iy - b.iy) <= 5 AND (power(a.iy - b.iy, 2) + power(a.ix - b.ix, 2)) * (2e-1 * 2e-1) <= 1 GROUP BY 1, 2""",
)
def disk_sum(t):
    cells = sp.grid_weights(customers_xy(t), F.col("py"), F.col("px"), 200.0, F.lit(1))
    return sp.disk_sum(cells, cells, 1.0, 0.2)


@query(
    "disk_mean_large",
    f"""WITH {CELLS} SELECT a.iy, a.ix, round(sum(b.cents)::BIGINT * 1e-2 / sum(b.v)::BIGINT, 3) AS mean_balance FROM cells a JOIN cells b ON (power(a.iy - b.iy, 2) + power(a.ix - b.ix, 2)) * 4e-2 <= 9 GROUP BY 1, 2""",
)
def disk_mean_large(t):
    """Mean within a large disk: two disk sums, money added in whole cents so they stay exact."""
    cells = customer_cells(t).agg(F.count(F.lit(1)).alias("n"), F.sum("c_acctbal").alias("v"))
    total = sp.disk_sum(cells, cells, 15.0, 1.0, "total", unit=0.01)
    count = sp.disk_sum(cells.withColumn("v", F.col("n")), cells, 15.0, 1.0, "count")
    return total.join(count, ["iy", "ix"]).select("iy", "ix", F.round(F.col("total") / F.greatest("count", F.lit(1)), 3).alias("mean_balance"))


@query(
    "raster_mean3",
    f"""WITH {CELLS}, {S_XY}, l AS (SELECT min(iy) AS y0, max(iy) AS y1, min(ix) AS x0, max(ix) AS x1 FROM cells),
q AS (SELECT DISTINCT floor(py / 180)::BIGINT AS iy, floor(px / 180)::BIGINT AS ix FROM supplier_xy)
SELECT q.iy, q.ix, round(avg(bal), 3) AS mean3 FROM q CROSS JOIN l LEFT JOIN cells c ON abs(c.iy - greatest(y0, least(y1, q.iy))) <= 1 AND abs(c.ix - greatest(x0, least(x1, q.ix))) <= 1 GROUP BY 1, 2""",
)
def raster_mean3(t):
    """Asked indices reach past the raster border on purpose."""
    pixels = customer_cells(t).agg(F.avg("c_acctbal").alias("v"))
    s = t.supplier.select(*xy("s_suppkey"))
    asked = s.select(F.floor(F.col("py") / 180).alias("iy"), F.floor(F.col("px") / 180).alias("ix"))
    return rounded(sp.mean_around(pixels, asked), 3)


@query(
    "nearest_marked_cell",
    f"""WITH {CELLS} SELECT a.iy, a.ix, round(least(coalesce(min(sqrt(power(a.iy - b.iy, 2) + power(a.ix - b.ix, 2))), 12), 12), 4) AS distance FROM cells a LEFT JOIN cells b ON b.marked AND abs(a.iy - b.iy) <= 12 GROUP BY 1, 2""",
)
def nearest_marked_cell(t):
    cells = customer_cells(t).agg(F.bool_or(F.col("c_acctbal") > 9000).alias("marked"))
    return rounded(sp.distance_to_marked(cells.filter("marked"), cells, 12.0))


RING = """ring AS (SELECT n_nationkey AS i, 5000 + (2500 + n_nationkey * 37 % 10 * 150) * cos(2 * pi() * n_nationkey / 25) AS x, 5000 + (2500 + n_nationkey * 37 % 10 * 150) * sin(2 * pi() * n_nationkey / 25) AS y FROM nation),
ring_edges AS (SELECT a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM ring a JOIN ring b ON b.i = (a.i + 1) % 25)"""


def ring_edges(t):
    """A closed ring with one corner per nation; every corner also names its successor."""
    import math

    def corner(i):
        radius = 2500 + i * 37 % 10 * 150
        angle = 2 * math.pi * i / 25
        return 5000 + radius * F.cos(angle), 5000 + radius * F.sin(angle)

    i = F.col("n_nationkey")
    (x1, y1), (x2, y2) = corner(i), corner((i + 1) % 25)
    return t.nation.select(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


@query(
    "inside_boundary",
    f"""WITH {P_XY}, {RING}, z AS (SELECT c_custkey, count(*) FILTER (WHERE (y1 > py) <> (y2 > py) AND px < (x2 - x1) * (py - y1) / (y2 - y1) + x1) % 2 AS odd, min({DIST}) AS d FROM customer_xy CROSS JOIN ring_edges GROUP BY 1)
SELECT c_custkey FROM z WHERE odd = 1 OR d <= 150""",
)
def inside_boundary(t):
    return sp.inside_polygon(customers_xy(t), ring_edges(t), "c_custkey", 500.0, 150.0).select("c_custkey")


VALUES = ", ".join(f"('{n}', {la!r}::DOUBLE, {lo!r}::DOUBLE)" for n, la, lo in STATIONS)


@query(
    "haversine_nearest_station",
    f"""WITH {GEO}, s(name, lat, lon) AS (VALUES {VALUES}), d AS (SELECT c_custkey, name, {HAV.format(a='g', b='s')} AS km FROM g CROSS JOIN s),
b AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY km, name) = 1)
SELECT c_custkey, round(km, 3) AS km, CASE WHEN round_even(km, 1) <= 30 THEN name END AS station FROM b""",
)
def haversine_nearest_station(t):
    g = customers_geo(t).withColumn("b", geo.nearest_fixed(F.col("lat"), F.col("lon"), STATIONS, 30.0))
    return g.select("c_custkey", F.round("b.km", 3).alias("km"), F.col("b.name").alias("station"))


@query(
    "box_filter",
    f"WITH {GEO} SELECT c_custkey, lat, lon FROM g WHERE lat BETWEEN 25 AND 26.5::DOUBLE AND lon BETWEEN 91 AND 93",
)
def box_filter(t):
    return rel.inside_box(customers_geo(t), "lat", "lon", 25, 26.5, 91, 93).select("c_custkey", "lat", "lon")


@query(
    "map_tiles",
    f"""WITH {GEO} SELECT c_custkey, floor((lon + 180) / 360 * 8192)::BIGINT AS tile_x, floor((1 - asinh(tan(radians(lat))) / pi()) / 2 * 8192)::BIGINT AS tile_y,
 'h' || lpad((floor((lon + 180) / 10)::INT)::VARCHAR, 2, '0') || 'v' || lpad((floor((90 - lat) / 10)::INT)::VARCHAR, 2, '0') AS big_tile,
 round_even((90 - lat) * 240 - 5e-1, 0)::INT AS pixel_row, floor(lat / 2e-1)::BIGINT || '_' || floor(lon / 2e-1)::BIGINT AS block, round_even(lat * 4, 0) / 4 AS cell_lat, round((lon - 929e-1) * 11132e-2 * cos(radians(262e-1)), 3) AS x_km, round((lat - 262e-1) * 11057e-2, 3) AS y_km FROM g""",
)
def map_tiles(t):
    from kerbline.functions.values import block_id, snap

    lat, lon = F.col("lat"), F.col("lon")
    tx_, ty_ = geo.slippy_tile(lat, lon, 13)
    row, _ = geo.pixel_index(lat, lon)
    x, y = geo.local_km(lat, lon)
    return customers_geo(t).select(
        "c_custkey", tx_.alias("tile_x"), ty_.alias("tile_y"), geo.ten_degree_tile(lat, lon).alias("big_tile"), row.alias("pixel_row"),
        block_id(lat, lon).alias("block"), snap(lat, 4).alias("cell_lat"), F.round(x, 3).alias("x_km"), F.round(y, 3).alias("y_km"),
    )


@query(
    "utm_metres",
    f"""WITH {GEO}, k AS (SELECT 6378137e0 AS a, 66943799901413e-16 AS e2), p AS (SELECT c_custkey, radians(lat) AS f, radians(lon - 93) AS dl, a, e2, e2 / (1 - e2) AS ep2 FROM g, k),
q AS (SELECT *, a / sqrt(1 - e2 * power(sin(f), 2)) AS n, power(tan(f), 2) AS t, ep2 * power(cos(f), 2) AS c, cos(f) * dl AS b,
 a * ((1 - e2 / 4 - 3 * e2 * e2 / 64 - 5 * power(e2, 3) / 256) * f - (3 * e2 / 8 + 3 * e2 * e2 / 32 + 45 * power(e2, 3) / 1024) * sin(2 * f) + (15 * e2 * e2 / 256 + 45 * power(e2, 3) / 1024) * sin(4 * f) - 35 * power(e2, 3) / 3072 * sin(6 * f)) AS m FROM p)
SELECT c_custkey, round(9996e-4 * n * (b + (1 - t + c) * power(b, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * power(b, 5) / 120) + 500000, 0) AS east,
 round(9996e-4 * (m + n * tan(f) * (b * b / 2 + (5 - t + 9 * c + 4 * c * c) * power(b, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * power(b, 6) / 720)), 0) AS north, true AS returns FROM q""",
)
def utm_metres(t):
    """Krueger series against the older power series in SQL, and the way back."""
    g = customers_geo(t)
    e, n = geo.utm_forward(F.col("lat"), F.col("lon"))
    m = g.select("c_custkey", "lat", "lon", e.alias("e"), n.alias("n"))
    la, lo = geo.utm_inverse(F.col("e"), F.col("n"))
    back = (F.abs(la - F.col("lat")) < 1e-9) & (F.abs(lo - F.col("lon")) < 1e-9)
    return m.select("c_custkey", F.round("e", 0).alias("east"), F.round("n", 0).alias("north"), back.alias("returns"))


def part_polylines(t):
    """Five-point polyline per part, written as text and read back."""
    k = F.col("p_partkey")
    text = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.concat_ws(" ", (i * 300).cast("string"), (k * (i + 1) * 37 % 190).cast("string")))
    wkt = F.concat(F.lit("LINESTRING ("), F.array_join(text, ", "), F.lit(")"))
    return t.part.select("p_partkey", wkt.alias("wkt")).withColumn("pts", geometry.parse_wkt_line(F.col("wkt")))


LINE5 = """v AS (SELECT p_partkey, i, i * 300.0::DOUBLE AS x, (p_partkey * (i + 1) * 37 % 190)::DOUBLE AS y FROM part, (SELECT unnest(range(0, 5)) AS i) s),
e AS (SELECT *, lag(x) OVER w AS x0, lag(y) OVER w AS y0, degrees(atan2(y - lag(y) OVER w, x - lag(x) OVER w)) AS head FROM v WINDOW w AS (PARTITION BY p_partkey ORDER BY i)),
f AS (SELECT *, sqrt(power(x - x0, 2) + power(y - y0, 2)) AS step, sum(sqrt(power(x - x0, 2) + power(y - y0, 2))) OVER (PARTITION BY p_partkey ORDER BY i) AS c1, head - lag(head) OVER (PARTITION BY p_partkey ORDER BY i) AS turn FROM e),
l AS (SELECT p_partkey, max(c1) AS len, sum(abs(turn)) AS turning, max(y) FILTER (WHERE i = 0) AS ya, max(y) FILTER (WHERE i = 4) AS yb, avg(y) AS ym FROM f GROUP BY 1)"""


@query(
    "line_shape",
    f"""WITH {LINE5}, m AS (SELECT f.p_partkey, x0 + (len / 2 - c0) / step * (x - x0) AS mx, y0 + (len / 2 - c0) / step * (y - y0) AS my FROM (SELECT *, coalesce(lag(c1) OVER (PARTITION BY p_partkey ORDER BY i), 0) AS c0 FROM f) f JOIN l USING (p_partkey) WHERE c0 <= len / 2 AND len / 2 < c1)
SELECT p_partkey, round(len, 3) AS length_m, round(mx, 3) AS mid_x, round(my, 3) AS mid_y, round(len / greatest(sqrt(1200 * 1200 + power(yb - ya, 2)), 1), 5) AS sinuosity,
  round(turning / greatest(len / 1000, 5e-2), 3) AS turn_deg_per_km, round(ym, 3) AS centre_y, round((p_partkey % 9) / greatest(len / 1000, 5e-2), 3) AS junctions_per_km FROM l JOIN m USING (p_partkey)""",
)
def line_shape(t):
    p = part_polylines(t).withColumns({"len": geometry.line_length(F.col("pts")), "along": geometry.distances_along(F.col("pts"))})
    mid = geometry.point_at(F.col("pts"), F.col("along"), F.col("len") / 2)
    return rounded(
        p.withColumn("mid", mid).select(
            "p_partkey",
            F.round("len", 3).alias("length_m"),
            F.round("mid.x", 3).alias("mid_x"),
            F.round("mid.y", 3).alias("mid_y"),
            geometry.sinuosity(F.col("pts")).alias("sinuosity"),
            F.round(geometry.per_km(geometry.total_turning(F.col("pts")), F.col("len")), 3).alias("turn_deg_per_km"),
            F.round(geometry.vertex_mean(F.col("pts"))["y"], 3).alias("centre_y"),
            F.round(geometry.per_km(F.col("p_partkey") % 9, F.col("len")), 3).alias("junctions_per_km"),
        ),
        5,
    )


@query(
    "cut_lines",
    f"""WITH {LINE5}, n AS (SELECT p_partkey, len, greatest(1, ceil(len / 500))::INT AS pieces FROM l), k AS (SELECT *, unnest(range(0, pieces))::INT AS piece FROM n)
SELECT k.p_partkey, piece, pieces, round(len / pieces, 3) AS length_m, (2 + count(*) FILTER (WHERE coalesce(c1, 0) > piece * len / pieces AND coalesce(c1, 0) < (piece + 1) * len / pieces))::INT AS vertices
FROM k JOIN f USING (p_partkey) GROUP BY 1, 2, 3, 4""",
)
def cut_lines(t):
    """Array form: every polyline row is cut into equal pieces of at most 500 m."""
    p = part_polylines(t).withColumns({"len": geometry.line_length(F.col("pts")), "along": geometry.distances_along(F.col("pts"))})
    p = p.withColumn("pieces", F.greatest(F.lit(1), F.ceil(F.col("len") / 500)).cast("int"))
    p = p.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    part = geometry.sub_line(F.col("pts"), F.col("along"), F.col("piece") * F.col("len") / F.col("pieces"), (F.col("piece") + 1) * F.col("len") / F.col("pieces"))
    return p.withColumn("sub", part).select(
        "p_partkey", "piece", "pieces", F.round(geometry.line_length(F.col("sub")), 3).alias("length_m"), F.size("sub").alias("vertices")
    )


WAYS = """vx AS (SELECT l_orderkey AS way, row_number() OVER w AS pos, l_partkey % 5000 AS node, row_number() OVER w * 100.0::DOUBLE AS x, (l_partkey % 50)::DOUBLE AS y, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice))"""
ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


@query(
    "graph_degree",
    f"""WITH {WAYS}, e AS (SELECT node, CASE WHEN lag(pos) OVER w IS NULL OR lead(pos) OVER w IS NULL THEN 1 ELSE 2 END AS d FROM vx WINDOW w AS (PARTITION BY way ORDER BY pos))
SELECT node, sum(d)::BIGINT AS degree, (sum(d) >= 3)::INT AS is_junction FROM e GROUP BY 1""",
)
def graph_degree(t):
    v = t.lineitem.select(F.col("l_orderkey").alias("way"), (F.col("l_partkey") % 5000).alias("node"), *ORDER)
    return sp.node_degree(v, "way", ORDER, "node")


@query(
    "cut_ways",
    f"""WITH {WAYS}, e AS (SELECT *, lag(x) OVER w AS x0, lag(y) OVER w AS y0 FROM vx WINDOW w AS (PARTITION BY way ORDER BY pos)),
f AS (SELECT *, sqrt(power(x - x0, 2) + power(y - y0, 2)) AS step, sum(coalesce(sqrt(power(x - x0, 2) + power(y - y0, 2)), 0)) OVER (PARTITION BY way ORDER BY pos) AS c1 FROM e),
l AS (SELECT way, max(c1) AS len, greatest(1, ceil(max(c1) / 250))::INT AS pieces FROM f GROUP BY 1 HAVING max(c1) > 0),
k AS (SELECT *, unnest(range(0, pieces))::INT AS piece FROM l)
SELECT k.way, piece, pieces, round(len / pieces, 3) AS length_m, round(x0 + (piece * (len / pieces) - c0) / step * (x - x0), 2) AS start_x, round(y0 + (piece * (len / pieces) - c0) / step * (y - y0), 2) AS start_y
FROM k JOIN (SELECT *, lag(c1) OVER (PARTITION BY way ORDER BY pos) AS c0 FROM f) f ON f.way = k.way AND step > 0 AND c0 <= piece * (len / pieces) AND piece * (len / pieces) < c1""",
)
def cut_ways(t):
    """Vertex-row form of the cut, for ways of any length; the x of a vertex is its place times 100."""
    from kerbline.operators.ordered import scan

    v = scan(t.lineitem, ORDER, ["l_orderkey"], sums={"pos": F.lit(1).cast("long")})
    from kerbline.session import cut_lineage

    v = cut_lineage(v.select(F.col("l_orderkey").alias("way"), "pos", (F.col("pos") * 100.0).alias("x"), (F.col("l_partkey") % 50).cast("double").alias("y")))
    pieces = sp.cut_ways(v, "way", ["pos"], 250.0)
    return pieces.select("way", "piece", "pieces", F.round("length_m", 3).alias("length_m"), F.round("start_x", 2).alias("start_x"), F.round("start_y", 2).alias("start_y"))


@query(
    "tag_filter",
    """SELECT event_id, CASE WHEN event_type IN ('purchase', 'signup') THEN 'event_type' WHEN event_id % 3 <> 0 AND event_type <> 'view' THEN 'k' END AS matched FROM events WHERE event_type IN ('purchase', 'signup') OR (event_id % 3 <> 0 AND event_type <> 'view')""",
)
def tag_filter(t):
    """First tag that qualifies: a listed class, else any value under a key."""
    k = F.when((F.col("event_id") % 3 != 0) & (F.col("event_type") != "view"), F.get_json_object("props", "$.k"))
    tags = F.map_filter(F.create_map(F.lit("event_type"), F.col("event_type"), F.lit("k"), k), lambda _, v: v.isNotNull())
    hit = rel.class_filter(tags, [("event_type", ["purchase", "signup"]), ("k", None)])
    return t.events.select("event_id", hit.alias("matched")).filter(F.col("matched").isNotNull())
