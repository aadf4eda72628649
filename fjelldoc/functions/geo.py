"""Projection, planar geometry and web-map arithmetic as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# GRS80 ellipsoid and UTM zone 33 (Krueger series), sphere radius, map limits.
SEMI_MAJOR = 6378137.0
FLATTENING = 1 / 298.257222101
CENTRAL_MERIDIAN = 15.0
SCALE = 0.9996
FALSE_EASTING = 500000.0
CIRCLE_SEGMENTS = 64
QUARTER_SEGMENTS = 8
EMPTY_BOUNDS = (5.0, 58.0, 15.0, 71.0)
FLAT_PADDING = 0.01
FRAME = {"x": 354.0, "y": 214.0, "width": 892.0, "height": 660.0}
FRAME_PADDING = 0.6
MAX_TILES = 100
DEFAULT_ZOOM = 3
MIN_FEATURE_PIXELS = 20
FLY_ZOOM = [(0.005, 18), (0.05, 17), (0.5, 15), (2.0, 13)]
FLY_ZOOM_WIDE = 11

_n = FLATTENING / (2 - FLATTENING)
RECTIFYING = SEMI_MAJOR / (1 + _n) * (1 + _n**2 / 4 + _n**4 / 64)
ECC = 2 * math.sqrt(_n) / (1 + _n)
ALPHA = [_n / 2 - 2 * _n**2 / 3 + 5 * _n**3 / 16, 13 * _n**2 / 48 - 3 * _n**3 / 5, 61 * _n**3 / 240]
BETA = [_n / 2 - 2 * _n**2 / 3 + 37 * _n**3 / 96, _n**2 / 48 + _n**3 / 15, 17 * _n**3 / 480]
DELTA = [2 * _n - 2 * _n**2 / 3 - 2 * _n**3, 7 * _n**2 / 3 - 8 * _n**3 / 5, 56 * _n**3 / 15]

POINT = "struct<x:double,y:double>"


def point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def _sum(terms) -> Column:
    total = None
    for t in terms:
        total = t if total is None else total + t
    return total


def project_vertices(vertices: Column) -> Column:
    """Array of lon/lat points to metres in UTM 33, one pass per step so nothing is computed twice."""

    def conformal(v: Column) -> Column:
        s = F.sin(F.radians(v["y"]))
        return F.struct(
            F.sinh(F.atanh(s) - ECC * F.atanh(s * ECC)).alias("t"), F.radians(v["x"] - CENTRAL_MERIDIAN).alias("dl")
        )

    def spherical(v: Column) -> Column:
        return F.struct(
            F.atan2(v["t"], F.cos(v["dl"])).alias("xi"),
            F.atanh(F.sin(v["dl"]) / F.sqrt(1 + v["t"] * v["t"])).alias("eta"),
        )

    def planar(v: Column) -> Column:
        xi, eta = v["xi"], v["eta"]
        east = eta + _sum(F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j)) * a for j, a in enumerate(ALPHA, 1))
        north = xi + _sum(F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j)) * a for j, a in enumerate(ALPHA, 1))
        return point(east * (SCALE * RECTIFYING) + FALSE_EASTING, north * (SCALE * RECTIFYING))

    return F.transform(F.transform(F.transform(vertices, conformal), spherical), planar)


def unproject_vertices(vertices: Column) -> Column:
    """Array of UTM 33 points back to lon/lat."""

    def spherical(v: Column) -> Column:
        return F.struct(
            (v["y"] / (SCALE * RECTIFYING)).alias("xi"), ((v["x"] - FALSE_EASTING) / (SCALE * RECTIFYING)).alias("eta")
        )

    def corrected(v: Column) -> Column:
        xi, eta = v["xi"], v["eta"]
        return F.struct(
            (xi - _sum(F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j)) * b for j, b in enumerate(BETA, 1))).alias("xi"),
            (eta - _sum(F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j)) * b for j, b in enumerate(BETA, 1))).alias("eta"),
        )

    def geographic(v: Column) -> Column:
        return F.struct(
            F.asin(F.sin(v["xi"]) / F.cosh(v["eta"])).alias("chi"), F.atan2(F.sinh(v["eta"]), F.cos(v["xi"])).alias("dl")
        )

    def degrees(v: Column) -> Column:
        chi = v["chi"]
        lat = chi + _sum(F.sin(chi * (2 * j)) * d for j, d in enumerate(DELTA, 1))
        return point(F.degrees(v["dl"]) + CENTRAL_MERIDIAN, F.degrees(lat))

    return F.transform(F.transform(F.transform(F.transform(vertices, spherical), corrected), geographic), degrees)


def project_point(lon: Column, lat: Column) -> Column:
    return F.element_at(project_vertices(F.array(point(lon, lat))), 1)


# -- rings -------------------------------------------------------------------


def ring_edges(ring: Column) -> Column:
    """Consecutive vertex pairs (ax, ay, bx, by) of a closed ring or a line."""
    n = F.size(ring)
    return F.when(
        n > 1,
        F.zip_with(
            F.slice(ring, F.lit(1), n - 1),
            F.slice(ring, F.lit(2), n - 1),
            lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")),
        ),
    ).otherwise(F.array().cast("array<struct<ax:double,ay:double,bx:double,by:double>>"))


def rings_edges(rings: Column) -> Column:
    return F.flatten(F.transform(rings, ring_edges))


def _side(e: Column, x: Column, y: Column) -> Column:
    return (e["bx"] - e["ax"]) * (y - e["ay"]) - (x - e["ax"]) * (e["by"] - e["ay"])


def on_boundary(edges: Column, x: Column, y: Column) -> Column:
    return F.exists(
        edges,
        lambda e: (_side(e, x, y) == 0)
        & x.between(F.least(e["ax"], e["bx"]), F.greatest(e["ax"], e["bx"]))
        & y.between(F.least(e["ay"], e["by"]), F.greatest(e["ay"], e["by"])),
    )


def crossing_parity(edges: Column, x: Column, y: Column) -> Column:
    """True for an odd number of edges to the right of the point; holes count by parity."""

    def crosses(e: Column) -> Column:
        straddles = (e["ay"] > y) != (e["by"] > y)
        return straddles & ((_side(e, x, y) > 0) == (e["by"] > e["ay"])) & (_side(e, x, y) != 0)

    return F.size(F.filter(edges, crosses)) % 2 == 1


def strictly_within(edges: Column, x: Column, y: Column) -> Column:
    return crossing_parity(edges, x, y) & ~on_boundary(edges, x, y)


def boundary_distance(edges: Column, x: Column, y: Column) -> Column:
    """Smallest distance from the point to any edge."""

    def to_edge(e: Column) -> Column:
        dx, dy = e["bx"] - e["ax"], e["by"] - e["ay"]
        along = F.coalesce(F.try_divide((x - e["ax"]) * dx + (y - e["ay"]) * dy, dx * dx + dy * dy), F.lit(0.0))
        t = F.least(F.greatest(along, F.lit(0.0)), F.lit(1.0))
        return F.hypot(x - e["ax"] - t * dx, y - e["ay"] - t * dy)

    return F.array_min(F.transform(edges, to_edge))


def distance_to(edges: Column, is_area: Column, x: Column, y: Column) -> Column:
    """Planar distance from a point to a geometry: zero inside an area."""
    return F.when(is_area & crossing_parity(edges, x, y), F.lit(0.0)).otherwise(boundary_distance(edges, x, y))


def ring_centroid(ring: Column) -> Column:
    """Area centroid by the shoelace formula, relative to the first vertex; vertex mean when flat."""
    ox, oy = ring[0]["x"], ring[0]["y"]
    start = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def step(s: Column, e: Column) -> Column:
        ax, ay, bx, by = e["ax"] - ox, e["ay"] - oy, e["bx"] - ox, e["by"] - oy
        cross = ax * by - bx * ay
        return F.struct(
            (s["a"] + cross).alias("a"), (s["x"] + (ax + bx) * cross).alias("x"), (s["y"] + (ay + by) * cross).alias("y")
        )

    def finish(s: Column) -> Column:
        third = s["a"] * 3
        mean_x = F.aggregate(ring, F.lit(0.0), lambda t, v: t + v["x"]) / F.size(ring)
        mean_y = F.aggregate(ring, F.lit(0.0), lambda t, v: t + v["y"]) / F.size(ring)
        flat = s["a"] == 0
        return point(F.when(flat, mean_x).otherwise(ox + F.try_divide(s["x"], third)), F.when(flat, mean_y).otherwise(oy + F.try_divide(s["y"], third)))

    return F.aggregate(ring_edges(ring), start, step, finish)


def _near(ring: Column) -> Column:
    """The vertices relative to the first one."""
    return F.transform(ring, lambda v: point(v["x"] - ring[0]["x"], v["y"] - ring[0]["y"]))


def ring_area(ring: Column) -> Column:
    """Area inside a closed ring, whichever way round it runs."""
    return F.abs(F.aggregate(ring_edges(_near(ring)), F.lit(0.0), lambda s, e: s + e["ax"] * e["by"] - e["bx"] * e["ay"])) / 2


def _weighted(spots: Column, positive: bool = False) -> Column:
    """Mean of (x, y) by weight `w`, in one pass; the plain mean if the weights come to nothing, null if there is none.

    With `positive` also null unless the weights come to more than nothing.
    """
    zero = F.lit(0.0)
    start = F.struct(zero.alias("w"), zero.alias("wx"), zero.alias("wy"), zero.alias("x"), zero.alias("y"))

    def step(s: Column, v: Column) -> Column:
        w, x, y = v["w"], v["x"], v["y"]
        return F.struct((s["w"] + w).alias("w"), (s["wx"] + w * x).alias("wx"), (s["wy"] + w * y).alias("wy"), (s["x"] + x).alias("x"), (s["y"] + y).alias("y"))

    def finish(s: Column) -> Column:
        n = F.size(spots)
        mean = [F.when(s["w"] != 0, F.try_divide(s["w" + c], s["w"])).otherwise(F.try_divide(s[c], n)) for c in "xy"]
        return F.when((s["w"] > 0) if positive else (n > 0), point(*mean))

    return F.aggregate(spots, start, step, finish)


def centroid(kind: Column, parts: Column) -> Column:
    """Centroid of any geometry: by area with holes taken out, by length for lines, by count for points.

    parts: polygon, ring, vertices; lines and points have one ring per part. Polygons without area count by the length of their rings.
    """
    def placed(ring: Column, i: Column) -> Column:
        return F.struct(F.when(i == 0, ring_area(ring)).otherwise(-ring_area(ring)).alias("w"), ring_centroid(ring).alias("c"))

    # a lambda's value is computed wherever it is named, so each centroid is a field first and taken apart after
    centred = F.flatten(F.transform(parts, lambda polygon: F.transform(polygon, placed)))
    rings = F.transform(centred, lambda r: F.struct(r["w"].alias("w"), r["c"]["x"].alias("x"), r["c"]["y"].alias("y")))
    middle = lambda e: F.struct(F.hypot(e["bx"] - e["ax"], e["by"] - e["ay"]).alias("w"), ((e["ax"] + e["bx"]) / 2).alias("x"), ((e["ay"] + e["by"]) / 2).alias("y"))
    edges = F.flatten(F.transform(F.flatten(parts), lambda ring: F.transform(ring_edges(ring), middle)))
    spots = F.transform(F.flatten(F.flatten(parts)), lambda v: F.struct(F.lit(1.0).alias("w"), v["x"].alias("x"), v["y"].alias("y")))
    lines = F.coalesce(_weighted(edges), _weighted(spots))
    return F.when(kind.contains("Polygon"), F.coalesce(_weighted(rings, positive=True), lines)).when(kind.contains("Line"), lines).otherwise(_weighted(spots))


def bounding_ring(vertices: Column) -> Column:
    """Closed five-point rectangle around the vertices."""
    xs, ys = F.transform(vertices, lambda v: v["x"]), F.transform(vertices, lambda v: v["y"])
    x0, x1, y0, y1 = F.array_min(xs), F.array_max(xs), F.array_min(ys), F.array_max(ys)
    return F.array(point(x0, y0), point(x0, y1), point(x1, y1), point(x1, y0), point(x0, y0))


def disc_ring(x: Column, y: Column, radius: Column) -> Column:
    """Point buffer: a closed polygon with eight segments per quarter, clockwise from the east."""
    steps = 4 * QUARTER_SEGMENTS
    return F.transform(
        F.sequence(F.lit(0), F.lit(steps)),
        lambda i: point(x + radius * F.cos((i % steps) * (-2 * math.pi / steps)), y + radius * F.sin((i % steps) * (-2 * math.pi / steps))),
    )


# -- sphere and web map ------------------------------------------------------


def destination(lon: Column, lat: Column, metres: Column, bearing: Column) -> Column:
    """Point reached on the sphere after `metres` in direction `bearing` (degrees)."""
    d, b = metres / SEMI_MAJOR, F.radians(bearing)
    phi, lam = F.radians(lat), F.radians(lon)
    phi2 = F.asin(F.sin(phi) * F.cos(d) + F.cos(phi) * F.sin(d) * F.cos(b))
    lam2 = lam + F.atan2(F.sin(b) * F.sin(d) * F.cos(phi), F.cos(d) - F.sin(phi) * F.sin(phi2))
    return point(F.degrees(lam2), F.degrees(phi2))


def circle_ring(lon: Column, lat: Column, metres: Column) -> Column:
    """Circle as a closed ring of 64 segments."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(CIRCLE_SEGMENTS)),
        lambda i: destination(lon, lat, metres, (i % CIRCLE_SEGMENTS) * (360.0 / CIRCLE_SEGMENTS)),
    )


def mercator_x(lon: Column) -> Column:
    return (lon + 180) / 360


def mercator_y(lat: Column) -> Column:
    phi = F.radians(lat)
    return (1 - F.log(F.tan(phi) + 1 / F.cos(phi)) / math.pi) / 2


def mercator_lon(mx: Column) -> Column:
    return mx * 360 - 180


def mercator_lat(my: Column) -> Column:
    return F.degrees(F.atan(F.sinh((1 - 2 * my) * math.pi)))


def tile_x(lon: Column, zoom: Column) -> Column:
    return F.floor(mercator_x(lon) * F.pow(F.lit(2.0), zoom))


def tile_y(lat: Column, zoom: Column) -> Column:
    return F.floor(mercator_y(lat) * F.pow(F.lit(2.0), zoom))


def tile_zoom(min_x: Column, min_y: Column, max_x: Column, max_y: Column, limit: int = MAX_TILES) -> Column:
    """Largest zoom from 15 down whose tile cover is small enough, else 3."""

    def few(z: Column) -> Column:
        count = (tile_x(max_x, z) - tile_x(min_x, z) + 1) * (tile_y(min_y, z) - tile_y(max_y, z) + 1)
        return (count <= limit) & (count > 0)

    fitting = F.filter(F.sequence(F.lit(15), F.lit(1), F.lit(-1)), few)
    return F.coalesce(F.get(fitting, F.lit(0)), F.lit(DEFAULT_ZOOM))


def fly_zoom(min_x: Column, min_y: Column, max_x: Column, max_y: Column) -> Column:
    span = F.greatest(F.abs(max_x - min_x), F.abs(max_y - min_y))
    rule = None
    for limit, zoom in FLY_ZOOM:
        rule = F.when(span < limit, zoom) if rule is None else rule.when(span < limit, zoom)
    return rule.otherwise(FLY_ZOOM_WIDE)
