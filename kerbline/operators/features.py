"""Feature building around segments: static context, neighbourhood history, regional level."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.functions.geo import local_km
from kerbline.functions.values import clip, flag, mapped
from kerbline.operators.ordered import scan
from kerbline.operators.relational import group_values
from kerbline.session import cut_lineage
from kerbline.operators.spatial import Globe, disk_sum, distance_to_marked, radius_sum

GRID_KM = 0.2
# fixed values: road hierarchy
ROAD_RANK = {
    "motorway": 7, "trunk": 6, "primary": 5, "secondary": 4, "tertiary": 3, "unclassified": 2,
    "residential": 1, "living_street": 1, "service": 0, "track": 0,
}
UNPAVED = ["unpaved", "gravel", "dirt", "ground", "sand"]
EDUCATION = ["school", "college", "university", "kindergarten"]
PLACE_KINDS = ["market_shop", "education", "health", "transit", "eatery", "worship", "fuel", "total"]


def regional_rate(df: DataFrame, region: Sequence[str], count: str, km: str, months: Column) -> DataFrame:
    """Events per km and month of the whole region, the row itself included."""
    both = group_values(df, list(region), {"__events": F.sum(count), "__road": F.sum(km)})
    return both.withColumn("regional_rate", F.col("__events") / F.col("__road") / months).drop("__events", "__road")


class Grid:
    """200 m cells in a local km plane whose corner lies 6 km outside the segments."""

    def __init__(self, segments: DataFrame, lat: str, lon: str, pad: float = 6.0):
        x, y = local_km(F.col(lat), F.col(lon))
        corner = segments.agg(F.struct((F.min(x) - pad).alias("x"), (F.min(y) - pad).alias("y")).alias("c"))
        self.corner = corner

    def place(self, df: DataFrame, lat: str, lon: str) -> DataFrame:
        x, y = local_km(F.col(lat), F.col(lon))
        held = df.withColumn("__c", self.corner.scalar())
        return held.withColumns(
            {"iy": F.floor((y - F.col("__c.y")) / GRID_KM), "ix": F.floor((x - F.col("__c.x")) / GRID_KM)}
        ).drop("__c")


def cell_sums(placed: DataFrame, weight: Column) -> DataFrame:
    return placed.groupBy("iy", "ix").agg(F.sum(weight).alias("v"))


def around(rows: DataFrame, asked: DataFrame, cells: DataFrame, radius_km: float, name: str, whole: bool = False) -> DataFrame:
    """Attach the sum of cell values within a radius of each row's cell.

    ``asked`` holds the cells of the rows; it is passed apart from them so that a chain of attached sums
    stays a chain of joins and never repeats the work of the sums before.
    """
    sums = disk_sum(cells, asked, radius_km, GRID_KM, name, None if whole else 1e-6)
    return rows.join(sums, ["iy", "ix"], "left").withColumn(name, F.coalesce(F.col(name), F.lit(0)))


def static_features(segments: DataFrame, places: DataFrame, pixels: DataFrame) -> DataFrame:
    """Road class, geometry, junction, place, light and network columns that do not change with time.

    segments: segment_id, way_id, piece, highway, ref, oneway, surface, is_bridge, is_main_road, length_m,
    mid_lat, mid_lon, sinuosity, turn_deg_per_km, junctions, junctions_per_km, n_*, poi200_*, night_light_nw.
    places: lat, lon, value. pixels: lat, lon, radiance_nw.
    """
    grid = Grid(segments, "mid_lat", "mid_lon")
    hw = F.coalesce("highway", F.lit("other"))
    turn = clip(F.col("turn_deg_per_km"), 0, 5000)
    s = scan(
        segments.withColumn("__t", turn), ["piece", "segment_id"], ["way_id"], previous={"__p": "__t"}, following={"__n": "__t"}
    )
    near = F.array_compact(F.array("__p", "__n"))
    near_mean = F.aggregate(near, F.lit(0.0), lambda a, v: a + v) / F.nullif(F.size(near), F.lit(0))
    s = s.select(
        "*",
        mapped(F.regexp_replace(hw, "_link$", ""), ROAD_RANK, 1).alias("hw_rank"),
        flag(F.col("ref").rlike(r"(?i)\bNH")).alias("is_national_highway"),
        hw.endswith("_link").cast("int").alias("is_link"),
        flag((F.col("oneway") == "yes") & (F.col("is_main_road") == 1)).alias("is_divided"),
        flag(F.col("surface").isin(*UNPAVED)).alias("is_unpaved"),
        F.coalesce(F.col("__t") - near_mean, F.lit(0.0)).alias("turn_contrast"),
        (F.col("poi200_total") * F.col("is_main_road")).alias("ped_places_x_main"),
        clip(F.coalesce("night_light_nw", F.lit(0.0)), 0, 300).alias("night_light"),
    ).withColumns({"sinuosity": clip(F.col("sinuosity"), 1, 5), "turn_deg_per_km": F.col("__t"), "junctions_per_km": clip(F.col("junctions_per_km"), 0, 40)})
    s = grid.place(s.drop("__t", "__p", "__n"), "mid_lat", "mid_lon")

    own = grid.place(segments, "mid_lat", "mid_lon")
    asked = own.select("iy", "ix").distinct()
    km = F.col("length_m") / 1000
    spots = grid.place(places, "lat", "lon")
    light = grid.place(pixels, "lat", "lon")
    schools = cell_sums(spots.filter(F.col("value").isin(*EDUCATION)), F.lit(1))
    all_spots = cell_sums(spots, F.lit(1))
    road, main = cell_sums(own, km), cell_sums(own, km * F.col("is_main_road"))
    lit, seen = cell_sums(light, F.col("radiance_nw")), cell_sums(light, F.lit(1))
    s = around(s, asked, cell_sums(own, F.col("junctions")), 1.0, "junctions_1km", True)
    s = around(s, asked, all_spots, 0.5, "poi_500m", True)
    s = around(s, asked, all_spots, 2.0, "poi_2km", True)
    s = around(s, asked, schools, 0.5, "school_500m", True)
    for r in (3, 10):
        s = around(around(s, asked, lit, float(r), "__lit"), asked, seen, float(r), "__seen", True)
        s = s.withColumn(f"night_light_{r}km", F.col("__lit") / F.greatest("__seen", F.lit(1))).drop("__lit", "__seen")
    s = around(s, asked, road, 1.0, "road_km_1km")
    s = around(s, asked, road, 5.0, "road_km_5km")
    s = around(s, asked, main, 1.0, "main_road_km_1km")
    bright = light.filter(F.col("radiance_nw") >= 20)
    s = s.join(distance_to_marked(bright, asked, 50.0, GRID_KM, "dist_to_town_km"), ["iy", "ix"])
    s = s.join(distance_to_marked(main.filter(F.col("v") > 0), asked, 20.0, GRID_KM, "dist_to_main_road_km"), ["iy", "ix"])
    return s.withColumn("light_contrast", F.log1p("night_light") - F.log1p("night_light_3km")).drop("iy", "ix")


def history_features(
    segments: DataFrame, events: DataFrame, start: str, end: str, recent_months: int = 12, radii: tuple[float, float, float] = (0.5, 1.0, 3.0),
    region_deg: float = 0.5, road_km: tuple[str, str] | None = None,
) -> DataFrame:
    """Monthly event rates around each segment (own events excluded) in a window of 'yyyy-MM' months.

    segments: segment_id, lat, lon, length_m. events: segment_id, month, ksi, fatal.
    Rates divide by months that contain data. The regional level includes the segment itself, so it is
    the same for all segments of a region. ``road_km`` names columns with the road km within the middle and
    large radius; without it they come from the 200 m grid.
    """
    e = events.filter(F.col("month").between(start, end) & F.col("segment_id").isNotNull())
    months = e.select("month").distinct()
    n = F.greatest(months.agg(F.count(F.lit(1)).alias("n")).scalar(), F.lit(1))
    latest = months.orderBy(F.col("month").desc()).limit(recent_months)
    first_recent = latest.agg(F.min("month")).scalar()
    n_recent = F.greatest(latest.agg(F.count(F.lit(1))).scalar(), F.lit(1))
    counts = e.withColumn("__r", first_recent).groupBy("segment_id").agg(
        F.sum("ksi").alias("own_ksi"), F.count(F.lit(1)).alias("own_events"), F.sum("fatal").alias("own_fatal"),
        F.sum(F.when(F.col("month") >= F.col("__r"), F.col("ksi")).otherwise(0)).alias("own_ksi_recent"),
    )
    own = ["own_ksi", "own_events", "own_fatal", "own_ksi_recent"]
    s = segments.join(counts, "segment_id", "left").withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in own})
    s = cut_lineage(s)  # read by three searches and the regional totals
    small, mid, large = radii
    wanted = {
        small: {"__s": "own_ksi"},
        mid: {"__m": "own_ksi", "__e": "own_events", "__f": "own_fatal", "__r": "own_ksi_recent"},
        large: {"__l": "own_ksi"},
    }
    spots = s.select("segment_id", "lat", "lon", *own)
    for radius, sums in wanted.items():
        found = radius_sum(spots, "lat", "lon", sums, Globe(radius)).select("segment_id", *sums)
        s = s.join(found, "segment_id")
    s = s.withColumns({"data_months": n, "__nr": n_recent, "__km": F.col("length_m") / 1000})
    per = F.col("data_months")
    s = s.withColumns(
        {
            "nearby_ksi_small": F.col("__s") / per,
            "nearby_ksi_mid": F.col("__m") / per,
            "nearby_ksi_large": F.col("__l") / per,
            "nearby_events_mid": F.col("__e") / per,
            "nearby_fatal_mid": F.col("__f") / per,
            "nearby_ksi_mid_recent": F.col("__r") / F.col("__nr"),
            "region": F.floor(F.col("lat") / region_deg) * 1000 + F.floor(F.col("lon") / region_deg),
        }
    )
    s = regional_rate(s, ["region"], "own_ksi", "__km", per)
    if road_km:
        s = s.withColumns({"__road_m": F.col(road_km[0]), "__road_l": F.col(road_km[1])})
    else:
        grid = Grid(segments, "lat", "lon")
        placed = grid.place(segments, "lat", "lon")
        cells, asked = cell_sums(placed, F.col("length_m") / 1000), placed.select("iy", "ix").distinct()
        s = grid.place(s, "lat", "lon")
        s = around(around(s, asked, cells, mid, "__road_m"), asked, cells, large, "__road_l").drop("iy", "ix")
    expected = lambda c: F.col("regional_rate") * F.greatest(F.col(c) - F.col("__km"), F.lit(0.05)) + 1e-4
    s = s.withColumns(
        {
            "nearby_severity_ratio_mid": (F.col("nearby_ksi_mid") + 0.01) / (F.col("nearby_events_mid") + 0.02),
            "nearby_ksi_mid_rel": (F.col("nearby_ksi_mid") + 1e-4) / expected("__road_m"),
            "nearby_ksi_large_rel": (F.col("nearby_ksi_large") + 1e-4) / expected("__road_l"),
        }
    )
    return s.drop("__s", "__m", "__l", "__e", "__f", "__r", "__nr", "__km", "__road_m", "__road_l", "region")
