"""Distances and boxes on the globe, and elements of a map as tables."""

from __future__ import annotations

import math
from xml.sax.saxutils import quoteattr

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RADIUS_KM = 6372.8
EQUATOR_M = 6378137.0
NODE_RADIUS_M = 20.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.pow(F.sin(dlon / 2), 2) * F.cos(F.radians(lat1)) * F.cos(F.radians(lat2))
    return 2 * RADIUS_KM * F.asin(F.sqrt(a))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return haversine_km(lat1, lon1, lat2, lon2) * 1000


def box(lat: Column, lon: Column, metres: Column | float) -> dict[str, Column]:
    """South, west, north and east edges of the box around a point."""
    d = F.lit(metres) if isinstance(metres, (int, float)) else metres
    dlat, dlon = F.degrees(d / EQUATOR_M), F.degrees(d / (EQUATOR_M * F.cos(F.radians(lat))))
    return {"south": lat - dlat, "west": lon - dlon, "north": lat + dlat, "east": lon + dlon}


def box_offsets(lat: float, metres: float) -> tuple[float, float]:
    return math.degrees(metres / EQUATOR_M), math.degrees(metres / (EQUATOR_M * math.cos(math.radians(lat))))


def way_radius(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, lat, lon (mean of the nodes) and radius in metres: the distance to
    the farther of the corners (max, max) and (min, min)."""
    each = ways.select("id", F.explode("nodes").alias("node")).join(nodes.select(F.col("id").alias("node"), "lat", "lon"), "node")
    mid = each.groupBy("id").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.max("lat").alias("n"), F.max("lon").alias("e"), F.min("lat").alias("s"), F.min("lon").alias("w"))
    lat, lon = F.col("lat"), F.col("lon")
    return mid.select("id", "lat", "lon", F.greatest(haversine_m(lat, lon, F.col("n"), F.col("e")), haversine_m(lat, lon, F.col("s"), F.col("w"))).alias("radius"))


def has_tag(tags: Column, key: str, values: list[str] | None = None) -> Column:
    held = F.map_contains_key(tags, key)
    return held if values is None else held & F.element_at(tags, key).isin(*values)


def nearby(points: DataFrame, places: DataFrame, metres: float) -> DataFrame:
    """Places with any tag within the box around each point: (id, place). Both
    sides go to grid cells as large as a box at the widest, so it is an
    equi-join on the cell."""
    b = box(F.col("lat"), F.col("lon"), metres)
    p = points.select(F.col("id"), *[c.alias(k) for k, c in b.items()])
    step = math.degrees(metres / EQUATOR_M) * 2
    rows = p.select("*", F.explode(F.sequence(F.floor(F.col("south") / step), F.floor(F.col("north") / step))).alias("cell"))
    q = places.where("tags is not null and cardinality(tags) > 0").select(F.col("id").alias("place"), "lat", "lon", F.floor(F.col("lat") / step).alias("cell"))
    hit = (F.col("lat").between(F.col("south"), F.col("north"))) & (F.col("lon").between(F.col("west"), F.col("east")))
    return rows.join(q, "cell").where(hit).select("id", "place").distinct()


def decode_elements(text: Column) -> Column:
    """Elements of a map service's JSON answer."""
    kind = "elements array<struct<type string, id bigint, lat double, lon double, nodes array<bigint>, tags map<string,string>>>"
    return F.from_json(text, kind)["elements"]


def union_query(points: list[tuple[float, float]], metres: float, keys: list[str]) -> str:
    """The XML query for nodes and ways with any of the keys near the points."""
    parts = []
    for lat, lon in points:
        dlat, dlon = box_offsets(lat, metres)
        edges = " ".join(f'{k}="{v:.7f}"' for k, v in (("e", lon + dlon), ("n", lat + dlat), ("s", lat - dlat), ("w", lon - dlon)))
        parts += [f"<query type={quoteattr(kind)}><has-kv k={quoteattr(k)}/><bbox-query {edges}/></query>" for kind in ("node", "way") for k in keys]
    return f'<osm-script output="json"><union>{"".join(parts)}</union><print/></osm-script>'


def id_query(ids: list[int], kind: str = "node") -> str:
    parts = "".join(f"<id-query ref={quoteattr(str(i))} type={quoteattr(kind)}/>" for i in ids)
    return f'<osm-script output="json"><union>{parts}</union><print/></osm-script>'
