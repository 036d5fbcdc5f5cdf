"""Grid joins equal brute force on random points, crowded cells included."""

import math
import random


from kerbline.operators import spatial as sp


def crowd(n, seed, spread=2000):
    rng = random.Random(seed)
    pts = []
    for i in range(n):
        if i % 3 == 0:
            pts.append((i, 700.0 + rng.randrange(40), 700.0 + rng.randrange(40), rng.randrange(4)))
        else:
            pts.append((i, float(rng.randrange(spread)), float(rng.randrange(spread)), rng.randrange(4)))
    return pts


def test_radius_sum_flat(spark):
    pts = crowd(260, 1)
    df = spark.createDataFrame(pts, "id int, x double, y double, w int")
    for radius in (90.0, 400.0):
        got = {r["id"]: r["nearby"] for r in sp.radius_sum(df, "y", "x", "w", sp.Flat(radius)).collect()}
        want = {a[0]: sum(b[3] for b in pts if (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 <= radius**2) - a[3] for a in pts}
        assert got == want


def test_radius_sum_globe(spark):
    pts = [(i, 24 + y / 1000, 90 + x / 1000, w) for i, x, y, w in crowd(200, 2)]
    df = spark.createDataFrame(pts, "id int, lat double, lon double, w int")

    def km(a, b):
        p = math.pi / 180
        h = math.sin((b[1] - a[1]) * p / 2) ** 2 + math.cos(a[1] * p) * math.cos(b[1] * p) * math.sin((b[2] - a[2]) * p / 2) ** 2
        return 12742 * math.asin(math.sqrt(h))

    got = {r["id"]: r["nearby"] for r in sp.radius_sum(df, "lat", "lon", "w", sp.Globe(20.0)).collect()}
    assert got == {a[0]: sum(b[3] for b in pts if b is not a and km(a, b) <= 20.0) for a in pts}


def test_lines(spark):
    pts = crowd(120, 3)
    rng = random.Random(4)
    lines = [(j, x := float(rng.randrange(2000)), y := float(rng.randrange(2000)), x + rng.randrange(-400, 400), y + rng.randrange(-400, 400)) for j in range(40)]
    p = spark.createDataFrame([(i, x, y) for i, x, y, _ in pts], "id int, px double, py double")
    e = spark.createDataFrame(lines, "line int, x1 double, y1 double, x2 double, y2 double")

    def dist(px, py, l):
        dx, dy = l[3] - l[1], l[4] - l[2]
        q = dx * dx + dy * dy
        t = max(0, min(1, ((px - l[1]) * dx + (py - l[2]) * dy) / q)) if q else 0
        return math.hypot(px - l[1] - t * dx, py - l[2] - t * dy)

    want = {}
    for i, x, y, _ in pts:
        for l in lines:
            if dist(x, y, l) <= 100:
                want[l[0]] = want.get(l[0], 0) + 1
    assert {r["line"]: r["n"] for r in sp.counts_near_lines(p, e, "line", 100.0).collect()} == want
    near = {r["id"]: r["line"] for r in sp.nearest_line(p, e, "id", "line", 100.0).collect()}
    for i, x, y, _ in pts:
        best = min((dist(x, y, l), l[0]) for l in lines)
        assert near[i] == (best[1] if best[0] <= 100 else None)


def test_disks_and_marks(spark):
    rng = random.Random(6)
    cells = {(rng.randrange(40), rng.randrange(40)): rng.randrange(1, 5) for _ in range(150)}
    df = spark.createDataFrame([(a, b, v) for (a, b), v in cells.items()], "iy int, ix int, v int")
    got = {(r["iy"], r["ix"]): r["disk_sum"] for r in sp.disk_sum(df, df, 7.0, 1.0).collect()}
    assert got == {k: sum(v for c, v in cells.items() if (c[0] - k[0]) ** 2 + (c[1] - k[1]) ** 2 <= 49) for k in cells}
    marked = [k for i, k in enumerate(cells) if i % 25 == 0]
    m = spark.createDataFrame(marked, "iy int, ix int")
    got = {(r["iy"], r["ix"]): r["distance"] for r in sp.distance_to_marked(m, df, 9.0).collect()}
    for k in cells:
        assert abs(got[k] - min(9.0, min(math.dist(k, q) for q in marked))) < 1e-9


def test_polygon_with_hole(spark):
    square = [(0, 0, 100, 0), (100, 0, 100, 100), (100, 100, 0, 100), (0, 100, 0, 0)]
    hole = [(40, 40, 60, 40), (60, 40, 60, 60), (60, 60, 40, 60), (40, 60, 40, 40)]
    e = spark.createDataFrame([tuple(map(float, t)) for t in square + hole], "x1 double, y1 double, x2 double, y2 double")
    p = spark.createDataFrame([(1, 10.0, 10.0), (2, 50.0, 50.0), (3, 104.0, 50.0), (4, 150.0, 50.0)], "id int, px double, py double")
    assert {r["id"] for r in sp.inside_polygon(p, e, "id", 30.0).collect()} == {1}
    assert {r["id"] for r in sp.inside_polygon(p, e, "id", 30.0, 5.0).collect()} == {1, 3}


def test_cut_tiles_the_way(spark):
    pts = [("a", i, 130.0 * i, float(i % 3)) for i in range(12)] + [("b", 0, 0.0, 0.0), ("b", 1, 500.0, 0.0)]
    v = spark.createDataFrame(pts, "way string, pos int, x double, y double")
    out = sp.cut_ways(v, "way", ["pos"], 500.0).orderBy("way", "piece").collect()
    a = [r for r in out if r["way"] == "a"]
    assert len(a) == 3 and [r["piece"] for r in a] == [0, 1, 2]
    assert all(abs(a[i]["end_x"] - a[i + 1]["start_x"]) < 1e-6 for i in range(2)) and a[-1]["end_x"] == 1430.0
    assert [r["pieces"] for r in out if r["way"] == "b"] == [1]


