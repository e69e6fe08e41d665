"""Geography as expressions: points are structs of latitude and longitude, polygons an exterior ring and holes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS = 6_371_000.0


def distance(a: Column, lat: float, lon: float) -> Column:
    """Metres on the sphere between the point ``a`` and a place."""
    p, q = F.radians(a["latitude"]), F.radians(F.lit(float(lat)))
    dp, dl = q - p, F.radians(F.lit(float(lon)) - a["longitude"])
    h = F.pow(F.sin(dp / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin(dl / 2), 2)
    return 2 * RADIUS * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def ring(points: list[dict]) -> Column:
    """A literal ring."""
    return F.array(*(F.struct(F.lit(float(p["latitude"])).alias("latitude"), F.lit(float(p["longitude"])).alias("longitude")) for p in points))


def _edges(r: Column) -> Column:
    """A ring's edges, closed if it is not."""
    return F.zip_with(r, F.concat(F.slice(r, F.lit(2), F.size(r)), F.slice(r, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _cross(o, a, b):
    return (a["longitude"] - o["longitude"]) * (b["latitude"] - o["latitude"]) - (a["latitude"] - o["latitude"]) * (b["longitude"] - o["longitude"])


def _on(p, e):
    return (_cross(e["a"], e["b"], p) == 0) & p["longitude"].between(F.least(e["a"]["longitude"], e["b"]["longitude"]), F.greatest(e["a"]["longitude"], e["b"]["longitude"])) & p["latitude"].between(F.least(e["a"]["latitude"], e["b"]["latitude"]), F.greatest(e["a"]["latitude"], e["b"]["latitude"]))


def inside_ring(p: Column, r: Column) -> Column:
    """Strictly inside, by the crossings of a ray; the boundary is outside."""

    def crosses(e):
        a, b = e["a"], e["b"]
        spans = (a["latitude"] > p["latitude"]) != (b["latitude"] > p["latitude"])
        # the division is safe where the edge spans the ray's latitude
        at = a["longitude"] + F.try_divide((p["latitude"] - a["latitude"]) * (b["longitude"] - a["longitude"]), b["latitude"] - a["latitude"])
        return spans & (p["longitude"] < at)

    edges = _edges(r)
    return ~F.exists(edges, lambda e: _on(p, e)) & (F.size(F.filter(edges, crosses)) % 2 == 1)


def within(p: Column, polygon: dict) -> Column:
    """The point lies inside the exterior ring and in no hole; a missing point does not."""
    ok = inside_ring(p, ring(polygon["exterior"]))
    for hole in polygon.get("interiors") or []:
        r = ring(hole)
        ok &= ~(inside_ring(p, r) | F.exists(_edges(r), lambda e: _on(p, e)))
    return F.coalesce(ok, F.lit(False))


def _meet(e, f):
    d1, d2, d3, d4 = _cross(f["a"], f["b"], e["a"]), _cross(f["a"], f["b"], e["b"]), _cross(e["a"], e["b"], f["a"]), _cross(e["a"], e["b"], f["b"])
    proper = ((d1 > 0) != (d2 > 0)) & ((d3 > 0) != (d4 > 0)) & (d1 != 0) & (d2 != 0) & (d3 != 0) & (d4 != 0)
    return proper | _on(e["a"], f) | _on(e["b"], f) | _on(f["a"], e) | _on(f["b"], e)


def intersects(polygon: Column, other: dict) -> Column:
    """The polygons share a point; a polygon that lies wholly in the other's hole does not."""
    a, b = polygon["exterior"], ring(other["exterior"])
    touch = F.exists(_edges(a), lambda e: F.exists(_edges(b), lambda f: _meet(e, f)))
    first = F.get(a, F.lit(0))
    in_hole = F.lit(False)
    for hole in other.get("interiors") or []:
        r = ring(hole)
        in_hole |= inside_ring(first, r) & ~F.exists(_edges(a), lambda e: F.exists(_edges(r), lambda f: _meet(e, f)))
    b0 = F.get(b, F.lit(0))
    holes = F.coalesce(polygon["interiors"], F.array().cast("array<array<struct<latitude:double,longitude:double>>>"))
    in_own = F.exists(holes, lambda h: inside_ring(b0, h) & ~F.exists(_edges(h), lambda e: F.exists(_edges(b), lambda f: _meet(e, f))))
    return F.coalesce((touch | inside_ring(first, b) | inside_ring(b0, a)) & ~in_hole & ~in_own, F.lit(False))


def intersects_any(multi: Column, other: dict) -> Column:
    """Any polygon of a MultiPolygon column intersects."""
    return F.coalesce(F.exists(multi["polygons"], lambda p: intersects(p, other)), F.lit(False))
