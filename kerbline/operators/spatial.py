"""Spatial joins as grid-cell equi-joins with an exact test, and grid sums by row sweeps."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline.functions.geo import haversine_km
from kerbline.functions.geometry import point_edge_distance
from kerbline.operators.ordered import scan
from kerbline.operators.skew import salted_join, tasks_for

#: Edges whose cells and pairs one task makes.
EDGES_PER_TASK = 20_000


def cell(c: Column, size: float) -> Column:
    return F.floor(c / size)


# ---------------------------------------------------------------- points and lines
def edge_cells(edges: DataFrame, size: float, reach: float) -> DataFrame:
    """One row per edge and grid cell that may hold a point within reach of the edge."""
    lo = lambda a, b: F.floor((F.least(a, b) - reach) / size)
    hi = lambda a, b: F.floor((F.greatest(a, b) + reach) / size)
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    out = edges.withColumn("cx", F.explode(F.sequence(lo(x1, x2), hi(x1, x2))))
    # of each column of cells only the rows beside the part of the edge that the column can reach
    at = lambda x: F.coalesce((x - x1) / F.nullif(x2 - x1, F.lit(0.0)), F.lit(0.0))
    left, right = at(F.col("cx") * size - reach), at((F.col("cx") + 1) * size + reach)
    inside = lambda t: F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    ends = [F.when(x1 == x2, y1).otherwise(y1 + inside(F.least(left, right)) * (y2 - y1)), F.when(x1 == x2, y2).otherwise(y1 + inside(F.greatest(left, right)) * (y2 - y1))]
    out = out.withColumn("cy", F.explode(F.sequence(lo(*ends), hi(*ends))))
    centre = point_edge_distance((F.col("cx") + 0.5) * size, (F.col("cy") + 0.5) * size, x1, y1, x2, y2)
    return out.filter(centre <= reach + size * math.sqrt(0.5) + 1e-6)


def close_pairs(points: DataFrame, edges: DataFrame, reach: float, size: float | None = None) -> DataFrame:
    """Point-edge pairs within reach. Points have px, py; edges x1, y1, x2, y2.

    A point lies in exactly one cell, so no pair appears twice; cells crowded with points are salted.
    """
    size = size or max(reach, 1.0)
    placed = points.withColumns({"cx": cell(F.col("px"), size), "cy": cell(F.col("py"), size)})
    pairs = salted_join(placed, edge_cells(edges, size, reach), ["cx", "cy"], salt_on=["px", "py"])
    d = point_edge_distance(*[F.col(c) for c in ("px", "py", "x1", "y1", "x2", "y2")])
    return pairs.withColumn("distance", d).filter(F.col("distance") <= reach).drop("cx", "cy")


def counts_near_lines(points: DataFrame, edges: DataFrame, line: str, reach: float, label: str | None = None) -> DataFrame:
    """Points within reach of each line, per label.

    Points at one position with one label are merged first, so copies never multiply the candidate pairs,
    and a position close to two edges of one line counts once.
    """
    keys = ["px", "py", *([label] if label else [])]
    merged = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    tasks = tasks_for(edges, EDGES_PER_TASK)
    pairs = close_pairs(merged, edges.select(line, "x1", "y1", "x2", "y2").repartition(tasks), reach)
    pairs = pairs.select(line, *keys, "__n").repartition(tasks, line, *keys).groupBy(line, *keys).agg(F.first("__n").alias("__n"))
    return pairs.groupBy(line, *([label] if label else [])).agg(F.sum("__n").alias("n"))


def nearest_line(points: DataFrame, edges: DataFrame, point: str, line: str, reach: float) -> DataFrame:
    """Nearest line within reach of each point, the lower line id on a tie; points without one are kept."""
    spots = points.select("px", "py").distinct()
    pairs = close_pairs(spots, edges.select(line, "x1", "y1", "x2", "y2").repartition(tasks_for(edges, EDGES_PER_TASK)), reach)
    best = pairs.groupBy("px", "py").agg(F.min(F.struct("distance", F.col(line).alias("line"))).alias("__b"))
    out = points.join(best, ["px", "py"], "left")
    return out.select(*points.columns, F.col("__b.line").alias(line), F.col("__b.distance").alias("snap_distance"))


# ---------------------------------------------------------------- polygons
def inside_polygon(points: DataFrame, edges: DataFrame, key: str, strip: float, margin: float = 0.0) -> DataFrame:
    """Points inside the rings, or within margin of them. Edges have x1, y1, x2, y2 (any number of rings).

    Crossing numbers are counted inside horizontal strips: a point meets only the edges of its strip.
    """
    y1, y2 = F.col("y1"), F.col("y2")
    strips = edges.withColumn("strip", F.explode(F.sequence(F.floor(F.least(y1, y2) / strip), F.floor(F.greatest(y1, y2) / strip))))
    spots = points.select("px", "py").distinct().withColumn("strip", F.floor(F.col("py") / strip))
    pairs = salted_join(spots, strips, ["strip"], salt_on=["px", "py"])
    spans = (y1 > F.col("py")) != (y2 > F.col("py"))
    at = (F.col("x2") - F.col("x1")) * (F.col("py") - y1) / F.nullif(y2 - y1, F.lit(0.0)) + F.col("x1")
    odd = pairs.groupBy("px", "py").agg((F.count_if(spans & (F.col("px") < at)) % 2).alias("__odd")).filter(F.col("__odd") == 1)
    hit = odd.select("px", "py")
    if margin > 0:
        near = close_pairs(points.select("px", "py").distinct(), edges.select("x1", "y1", "x2", "y2"), margin).select("px", "py")
        hit = hit.unionByName(near).distinct()
    return points.join(hit, ["px", "py"], "left_semi").select(*points.columns)


# ---------------------------------------------------------------- radius sums
class Flat:
    """Plane metres (or any plane unit): y and x share one cell size."""

    def __init__(self, radius: float):
        self.radius = radius

    def cells(self, y: Column, x: Column, split: int) -> tuple[Column, Column]:
        size = self.radius / split
        return F.floor(y / size), F.floor(x / size)

    def reach(self, cy: Column, split: int) -> tuple[Column, Column]:
        k = F.lit(split + 1)
        return k, k

    def bounds(self, a: str, b: str, split: int) -> tuple[Column, Column]:
        """(surely outside, surely inside) for all positions of two cells."""
        size = self.radius / split
        dy, dx = F.abs(F.col(f"{a}y") - F.col(f"{b}y")), F.abs(F.col(f"{a}x") - F.col(f"{b}x"))
        gap = F.hypot(F.greatest(dy - 1, F.lit(0)) * size, F.greatest(dx - 1, F.lit(0)) * size)
        span = F.hypot((dy + 1) * size, (dx + 1) * size)
        slack = 1e-9 * self.radius
        return gap > self.radius + slack, span < self.radius - slack

    def beside(self, cx: Column, k: Column, split: int) -> Column:
        return F.sequence(cx - k, cx + k)

    def within(self, y1: Column, x1: Column, y2: Column, x2: Column) -> Column:
        return F.pow(y1 - y2, 2) + F.pow(x1 - x2, 2) <= self.radius**2


class Globe:
    """Degrees with great-circle kilometres; cells get wider in degrees of longitude by a fixed factor.

    A whole number of cells goes round the globe, so cells on both sides of the 180th meridian are neighbours.
    """

    def __init__(self, radius_km: float, typical_lat: float = 26.0):
        self.radius = radius_km
        self.lat_deg = math.degrees(radius_km / 6371.0)
        self.round = max(1, math.floor(360 * math.cos(math.radians(typical_lat)) / self.lat_deg))
        self.lon_deg = 360 / self.round

    def cells(self, y: Column, x: Column, split: int) -> tuple[Column, Column]:
        return F.floor(y / (self.lat_deg / split)), F.pmod(F.floor((x + 180) / (self.lon_deg / split)), F.lit(self.round * split))

    def beside(self, cx: Column, k: Column, split: int) -> Column:
        """The cells at most k columns away, round the globe, each once."""
        n = self.round * split
        steps = F.sequence(-F.least(k, F.lit((n - 1) // 2)), F.least(k, F.lit(n // 2)))
        return F.transform(steps, lambda d: F.pmod(cx + d, F.lit(n)))

    def reach(self, cy: Column, split: int) -> tuple[Column, Column]:
        edge = F.least((F.abs(cy) + 1) * (self.lat_deg / split) + self.lat_deg, F.lit(89.0))
        half = math.sin(self.radius / 6371.0 / 2)
        wide = F.degrees(2 * F.asin(F.least(half / F.cos(F.radians(edge)), F.lit(1.0))))
        return F.lit(split + 1), F.ceil(wide / (self.lon_deg / split)).cast("int") + 1

    def bounds(self, a: str, b: str, split: int) -> tuple[Column, Column]:
        la, lo = self.lat_deg / split, self.lon_deg / split
        dy, dx = F.abs(F.col(f"{a}y") - F.col(f"{b}y")), F.abs(F.col(f"{a}x") - F.col(f"{b}x"))
        dx = F.least(dx, self.round * split - dx)

        def cosines(side: str) -> tuple[Column, Column]:
            south, north = F.col(f"{side}y") * la, (F.col(f"{side}y") + 1) * la
            c1, c2 = F.cos(F.radians(south)), F.cos(F.radians(north))
            low = F.greatest(F.least(c1, c2), F.lit(0.0))
            return low, F.when((south <= 0) & (north >= 0), F.lit(1.0)).otherwise(F.greatest(c1, c2))

        (la1, ha1), (la2, ha2) = cosines(a), cosines(b)
        half = lambda d: F.pow(F.sin(F.radians(d) / 2), 2)
        gap = half(F.greatest(dy - 1, F.lit(0)) * la) + la1 * la2 * half(F.greatest(dx - 1, F.lit(0)) * lo)
        span = half((dy + 1) * la) + ha1 * ha2 * half(F.least((dx + 1) * lo, F.lit(180.0)))
        limit = math.sin(self.radius / 12742.0) ** 2
        return gap > limit * (1 + 1e-9), span < limit * (1 - 1e-9)

    def within(self, y1: Column, x1: Column, y2: Column, x2: Column) -> Column:
        return haversine_km(y1, x1, y2, x2) <= self.radius


def radius_sum(
    points: DataFrame, y: str, x: str, weight: str | dict[str, str], metric: Flat | Globe, name: str = "nearby", coarse: int = 4, fine: int = 16
) -> DataFrame:
    """Weight of all other rows within the radius, own weight taken out, never below 0.

    ``weight`` is one column, or {result name: column} for several sums that share the search.
    Weights are summed per position, per fine and per coarse cell. A coarse cell pair that lies surely
    inside the radius adds one number; an unsure pair is looked at again by fine cells; only fine pairs
    that cross the circle are compared position by position. A crowded spot is therefore added as a sum
    and never meets itself row by row.
    """
    named = {name: weight} if isinstance(weight, str) else dict(weight)
    ws = [f"w{i}" for i in range(len(named))]
    spot = points.select(
        F.col(y).alias("py"), F.col(x).alias("px"), *[F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0)).alias(w) for c, w in zip(named.values(), ws)]
    ).filter(F.col("py").isNotNull() & F.col("px").isNotNull())
    some = F.greatest(*ws) > 0 if len(ws) > 1 else F.col(ws[0]) > 0

    def placed(df: DataFrame, side: str) -> DataFrame:
        cy, cx = metric.cells(F.col("py"), F.col("px"), coarse)
        fy, fx = metric.cells(F.col("py"), F.col("px"), fine)
        return df.withColumns({f"{side}0y": cy, f"{side}0x": cx, f"{side}1y": fy, f"{side}1x": fx})

    add = lambda tag="w": [F.sum(w).alias(w.replace("w", tag)) for w in ws]
    right = placed(spot.filter(some).groupBy("py", "px").agg(*add()), "r").withColumnsRenamed({"py": "ry", "px": "rx"})
    left = placed(spot.select("py", "px").distinct(), "l")
    r0 = right.groupBy("r0y", "r0x").agg(*add())
    r1 = right.groupBy("r0y", "r0x", "r1y", "r1x").agg(*add())
    l0 = left.select("l0y", "l0x").distinct()
    l1 = left.select("l0y", "l0x", "l1y", "l1x").distinct()

    ky, kx = metric.reach(F.col("l0y"), coarse)
    near = l0.withColumn("r0y", F.explode(F.sequence(F.col("l0y") - ky, F.col("l0y") + ky)))
    near = near.withColumn("r0x", F.explode(metric.beside(F.col("l0x"), kx, coarse)))
    outside, inside = metric.bounds("l0", "r0", coarse)
    pairs0 = near.filter(~outside).join(r0, ["r0y", "r0x"]).withColumn("sure", inside)
    sum0 = pairs0.filter("sure").groupBy("l0y", "l0x").agg(*add("a"))

    open0 = pairs0.filter(~F.col("sure")).select("l0y", "l0x", "r0y", "r0x")
    outside, inside = metric.bounds("l1", "r1", fine)
    pairs1 = open0.join(l1, ["l0y", "l0x"]).join(r1, ["r0y", "r0x"]).filter(~outside).withColumn("sure", inside)
    sum1 = pairs1.filter("sure").groupBy("l1y", "l1x").agg(*add("b"))

    open1 = pairs1.filter(~F.col("sure")).select("l1y", "l1x", "r1y", "r1x")
    pairs2 = open1.join(left.select("l1y", "l1x", "py", "px"), ["l1y", "l1x"]).join(
        right.select("r1y", "r1x", "ry", "rx", *ws), ["r1y", "r1x"]
    )
    exact = metric.within(F.col("py"), F.col("px"), F.col("ry"), F.col("rx"))
    sum2 = pairs2.filter(exact).groupBy("py", "px").agg(*add("c"))

    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    totals = (
        left.join(sum0, ["l0y", "l0x"], "left").join(sum1, ["l1y", "l1x"], "left").join(sum2, ["py", "px"], "left")
        .select(F.col("py").alias(y), F.col("px").alias(x), *[(zero(f"a{i}") + zero(f"b{i}") + zero(f"c{i}")).alias(f"__t{i}") for i in range(len(ws))])
    )
    out = points.join(totals, [y, x], "left")
    own = [F.coalesce(F.greatest(F.col(c), F.lit(0)), F.lit(0)) for c in named.values()]
    sums = [F.greatest(F.col(f"__t{i}") - o, F.lit(0)).alias(n) for i, (n, o) in enumerate(zip(named, own))]
    return out.select(*points.columns, *sums)


# ---------------------------------------------------------------- grid sums
def grid_weights(points: DataFrame, y: Column, x: Column, size: float, weight: Column) -> DataFrame:
    """Sum of weights per grid cell (iy, ix)."""
    return points.groupBy(F.floor(y / size).alias("iy"), F.floor(x / size).alias("ix")).agg(F.sum(weight).alias("v"))


def disk_rows(radius: float, size: float) -> list[tuple[int, int]]:
    """Half width of the disk in every row: cells with (dx²+dy²)·size² <= radius²."""
    n = math.ceil(radius / size)
    rows = []
    for dy in range(-n, n + 1):
        widths = [dx for dx in range(0, n + 1) if (dx**2 + dy**2) * size**2 <= radius**2]
        if widths:
            rows.append((dy, max(widths)))
    return rows


def disk_sum(cells: DataFrame, asked: DataFrame, radius: float, size: float, name: str = "disk_sum", unit: float | None = None) -> DataFrame:
    """Sum over the grid cells within a radius of each asked cell.

    A cell adds its value to one stretch per disk row, written as a plus where the stretch starts and a
    minus where it ends; a running sum along each grid row then gives every answer. That is two entries
    per disk row instead of one per disk cell, and sums of whole numbers stay exact. With ``unit``,
    fractional values are added as whole multiples of it, so plus and minus cancel exactly.
    """
    v = F.col("v") if unit is None else F.round(F.col("v") / unit).cast("long")
    stretches = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(h).alias("h")) for dy, h in disk_rows(radius, size)])
    spread = cells.select("iy", "ix", v.alias("v"), F.inline(stretches))
    spread = spread.select(
        (F.col("iy") + F.col("dy")).alias("iy"),
        F.inline(
            F.array(
                F.struct((F.col("ix") - F.col("h")).alias("ix"), F.col("v").alias("d")),
                F.struct((F.col("ix") + F.col("h") + 1).alias("ix"), (-F.col("v")).alias("d")),
            )
        ),
    ).withColumn("__asked", F.lit(False))
    wanted = asked.select("iy", "ix").distinct().select("iy", "ix", F.lit(0).cast(spread.schema["d"].dataType).alias("d"), F.lit(True).alias("__asked"))
    steps = spread.unionByName(wanted).groupBy("iy", "ix").agg(F.sum("d").alias("d"), F.max("__asked").alias("__asked"))
    # one row per distinct cell: a grid row is as long as the grid is wide, whatever the data
    along = Window.partitionBy("iy").orderBy("ix").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("d").over(along)
    swept = steps.withColumn(name, total if unit is None else total * unit).filter("__asked")
    return swept.select("iy", "ix", name)


def mean_around(pixels: DataFrame, asked: DataFrame, name: str = "mean3") -> DataFrame:
    """Mean of the 3x3 pixels around each asked index, missing pixels skipped, index clipped to the raster."""
    lim = pixels.agg(F.struct(F.min("iy").alias("y0"), F.max("iy").alias("y1"), F.min("ix").alias("x0"), F.max("ix").alias("x1")).alias("l"))
    held = asked.select("iy", "ix").distinct().withColumn("__l", lim.scalar())
    held = held.withColumns(
        {
            "jy": F.least(F.greatest("iy", "__l.y0"), F.col("__l.y1")),
            "jx": F.least(F.greatest("ix", "__l.x0"), F.col("__l.x1")),
        }
    )
    near = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    wide = pixels.filter(F.col("v").isNotNull()).select("iy", "ix", "v", F.inline(near)).groupBy(
        (F.col("iy") + F.col("a")).alias("jy"), (F.col("ix") + F.col("b")).alias("jx")
    )
    means = wide.agg(F.avg("v").alias(name))
    return held.join(means, ["jy", "jx"], "left").select("iy", "ix", name)


def distance_to_marked(marked: DataFrame, asked: DataFrame, cap: float, size: float = 1.0, name: str = "distance") -> DataFrame:
    """Distance from each asked cell to the nearest marked cell, capped.

    Search by halving blocks: start with the 3x3 blocks that cover the cap, and at every level keep only
    the blocks that can still hold the nearest cell (least possible distance within the smallest of the
    largest possible ones). Few blocks per cell survive, so no level compares all cells with all marks.
    """
    reach = cap / size
    top = max(0, math.ceil(math.log2(max(reach, 1.0))))
    marks = marked.select("iy", "ix").distinct()
    cells = asked.select("iy", "ix").distinct()

    def blocks(level: int) -> DataFrame:
        w = 2**level
        return marks.select(F.floor(F.col("iy") / w).alias("by"), F.floor(F.col("ix") / w).alias("bx")).distinct()

    def gap(i: Column, b: Column, level: int) -> tuple[Column, Column]:
        w = 2**level
        lo, hi = b * w, b * w + (w - 1)
        return F.greatest(lo - i, i - hi, F.lit(0)), F.greatest(F.abs(i - lo), F.abs(i - hi))

    around = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    w = 2**top
    live = cells.select("iy", "ix", F.inline(around)).select(
        "iy", "ix", (F.floor(F.col("iy") / w) + F.col("a")).alias("by"), (F.floor(F.col("ix") / w) + F.col("b")).alias("bx")
    ).join(blocks(top), ["by", "bx"])
    for level in range(top, -1, -1):
        if level < top:
            children = blocks(level).withColumns({"qy": F.floor(F.col("by") / 2), "qx": F.floor(F.col("bx") / 2)})
            live = live.withColumnsRenamed({"by": "qy", "bx": "qx"}).join(children, ["qy", "qx"]).drop("qy", "qx")
        ny, fy = gap(F.col("iy"), F.col("by"), level)
        nx, fx = gap(F.col("ix"), F.col("bx"), level)
        live = live.withColumns({"near2": ny * ny + nx * nx, "far2": fy * fy + fx * fx})
        best = F.min("far2").over(Window.partitionBy("iy", "ix"))
        live = live.withColumn("best", best).filter((F.col("near2") <= F.col("best")) & (F.col("near2") <= reach * reach))
        live = live.select("iy", "ix", "by", "bx", "near2")
    found = live.groupBy("iy", "ix").agg(F.min("near2").alias("d2"))
    out = cells.join(found, ["iy", "ix"], "left")
    return out.select("iy", "ix", F.least(F.coalesce(F.sqrt("d2") * size, F.lit(float(cap))), F.lit(float(cap))).alias(name))


# ---------------------------------------------------------------- polylines as vertex tables
def node_degree(vertices: DataFrame, way: str, order: Sequence[str], node: str) -> DataFrame:
    """Road-graph degree: an end vertex adds 1, an interior vertex adds 2; junctions have 3 or more."""
    ends = scan(vertices, list(order), [way], previous={"__p": F.lit(1)}, following={"__f": F.lit(1)})
    step = F.when(F.col("__p").isNull() | F.col("__f").isNull(), 1).otherwise(2)
    return ends.groupBy(node).agg(F.sum(step).cast("long").alias("degree")).withColumn("is_junction", (F.col("degree") >= 3).cast("int"))


def cut_ways(vertices: DataFrame, way: str, order: Sequence[str], longest: float = 500.0) -> DataFrame:
    """Cut each way into ceil(L/longest) equal pieces; works on vertex rows, so a way may have any length.

    One row per piece: number, count, length and end points.
    """
    from kerbline.session import cut_lineage

    # lengths along the way are whole nanometres: their sums do not depend on how rows are sliced,
    # so the edges of a way tile it without gap or overlap
    steps = scan(vertices, list(order), [way], previous={"x0": "x", "y0": "y"})
    metres = F.coalesce(F.hypot(F.col("x") - F.col("x0"), F.col("y") - F.col("y0")), F.lit(0.0))
    steps = cut_lineage(steps.withColumn("__step", F.round(metres * 1e9).cast("long")))
    run = scan(steps, list(order), [way], sums={"__c1": "__step"})
    length = run.groupBy(way).agg(F.max("__c1").alias("__len")).filter(F.col("__len") > 0)
    edges = run.join(length, way).withColumns(
        {
            "__c0": F.col("__c1") - F.col("__step"),
            "pieces": F.greatest(F.lit(1), F.ceil(F.col("__len") / (longest * 1e9))).cast("int"),
        }
    )
    piece_len = F.col("__len") / F.col("pieces")
    ks = F.filter(
        F.sequence(
            F.greatest(F.floor(F.col("__c0") / piece_len).cast("int") - 1, F.lit(0)),
            F.least(F.ceil(F.col("__c1") / piece_len).cast("int") + 1, F.col("pieces")),
        ),
        lambda k: F.when(k == F.col("pieces"), F.col("__c1") >= F.col("__len")).otherwise(
            (F.col("__c0") <= k * piece_len) & (k * piece_len < F.col("__c1"))
        ),
    )
    cut = edges.filter(F.col("__step") > 0).withColumn("k", F.explode(ks))
    t = F.least((F.col("k") * piece_len - F.col("__c0")) / F.col("__step"), F.lit(1.0))
    at = lambda a, b: F.col(a) + t * (F.col(b) - F.col(a))
    cut = cut.select(way, "pieces", (piece_len / 1e9).alias("length_m"), "k", at("x0", "x").alias("bx"), at("y0", "y").alias("by"))
    sides = cut.select(
        way, "pieces", "length_m", "bx", "by",
        F.inline(F.array(F.struct(F.col("k").alias("piece"), F.lit(0).alias("side")), F.struct((F.col("k") - 1).alias("piece"), F.lit(1).alias("side")))),
    ).filter((F.col("piece") >= 0) & (F.col("piece") < F.col("pieces")))
    pick = lambda c, s: F.max(F.when(F.col("side") == s, F.col(c)))
    return sides.groupBy(way, "piece").agg(
        F.max("pieces").alias("pieces"), F.max("length_m").alias("length_m"),
        pick("bx", 0).alias("start_x"), pick("by", 0).alias("start_y"), pick("bx", 1).alias("end_x"), pick("by", 1).alias("end_y"),
    )
