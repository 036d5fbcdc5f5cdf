"""Static features against a plain-Python grid on a few segments."""

import math

from kerbline.operators.features import static_features

KX, KY = 111.32 * math.cos(math.radians(26.2)), 110.57


def test_static_features(spark):
    segs = [
        (f"s{i}", i // 2, i % 2, hw, "NH 27" if i == 0 else None, "yes", None, 0, int(hw == "trunk"), 400.0, 26.0 + 0.004 * i, 92.0 + 0.003 * (i % 3), 1.2, 100.0 * i, i, 1.0, i, 2.0)
        for i, hw in enumerate(["trunk", "residential", "primary_link", "track", "trunk", "service"])
    ]
    schema = (
        "segment_id string, way_id int, piece int, highway string, ref string, oneway string, surface string, is_bridge int, is_main_road int, length_m double, mid_lat double, mid_lon double,"
        "sinuosity double, turn_deg_per_km double, junctions int, junctions_per_km double, poi200_total int, night_light_nw double"
    )
    places = [(26.001, 92.001, "school"), (26.004, 92.003, "cafe"), (26.02, 92.0, "fuel")]
    pixels = [(26.0, 92.0, 30.0), (26.01, 92.01, 5.0)]
    got = {
        r["segment_id"]: r
        for r in static_features(
            spark.createDataFrame(segs, schema),
            spark.createDataFrame(places, "lat double, lon double, value string"),
            spark.createDataFrame(pixels, "lat double, lon double, radiance_nw double"),
        ).collect()
    }
    km = lambda la, lo: ((lo - 92.9) * KX, (la - 26.2) * KY)
    at = {s[0]: km(s[10], s[11]) for s in segs}
    x0, y0 = min(x for x, _ in at.values()) - 6, min(y for _, y in at.values()) - 6
    cell = lambda x, y: (math.floor((y - y0) / 0.2), math.floor((x - x0) / 0.2))
    d2 = lambda a, b: (a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2
    for s in segs:
        me, r = cell(*at[s[0]]), got[s[0]]
        near = [p for p in places if d2(me, cell(*km(p[0], p[1]))) * 0.2**2 <= 0.5**2]
        assert r["poi_500m"] == len(near) and r["school_500m"] == sum(p[2] == "school" for p in near)
        road = sum(0.4 for o in segs if d2(me, cell(*at[o[0]])) * 0.2**2 <= 1.0)
        assert abs(r["road_km_1km"] - road) < 1e-6
        assert abs(r["dist_to_town_km"] - math.sqrt(d2(me, cell(*km(26.0, 92.0)))) * 0.2) < 1e-9
    assert [got[f"s{i}"]["hw_rank"] for i in range(6)] == [6, 1, 5, 0, 6, 0]
    assert got["s0"]["is_national_highway"] == 1 and got["s2"]["is_link"] == 1 and got["s0"]["is_divided"] == 1
    assert got["s1"]["turn_contrast"] == 100.0 and got["s0"]["turn_contrast"] == -100.0
