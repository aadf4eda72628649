"""Invariants of shapes that plain SQL cannot check."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fjelldoc.functions import geo, geojson
from fjelldoc.functions import rings as rg
from fjelldoc.operators import geometry, shapes
from fjelldoc.plans.geo_queries import seeds


def area(ring):
    return abs(rg.signed_area(rg.open_ring([p["x"] for p in ring], [p["y"] for p in ring])))


def test_known_positions(spark):
    df = spark.createDataFrame([(10.7522, 59.9139), (8.0182, 58.1599)], "lon double, lat double")
    got = [(round(r.x, 3), round(r.y, 3)) for r in geometry.project_points(df).collect()]
    assert got == [(262560.482, 6649443.584), (89604.952, 6467795.476)]


def test_voronoi_cells_tile_the_box(tables):
    s = seeds(tables).withColumn("collection_id", F.lit(0))
    cells = shapes.voronoi(s).collect()
    pts = np.array([(c.x, c.y) for c in cells])
    span = pts.max(axis=0) - pts.min(axis=0)
    assert sum(area(c.ring) for c in cells) == pytest.approx(float(np.prod(span * 2)), rel=1e-9)
    rng = np.random.default_rng(1)
    for c in cells:
        ring = rg.counter_clockwise(rg.open_ring([p["x"] for p in c.ring], [p["y"] for p in c.ring]))
        middle = ring.mean(axis=0)
        inside = middle + (ring[rng.integers(len(ring))] - middle) * 0.9
        assert np.argmin(((pts - inside) ** 2).sum(axis=1)) == cells.index(c)


def test_voronoi_random_and_clustered(spark):
    rng = np.random.default_rng(5)
    pts = np.vstack([rng.uniform(0, 200_000, (60, 2)), rng.normal(50_000, 300, (120, 2))])
    rows = [(7, i, float(x), float(y)) for i, (x, y) in enumerate(pts)]
    df = spark.createDataFrame(rows, "collection_id bigint, seed_id bigint, x double, y double")
    cells = {c.seed_id: c.ring for c in shapes.voronoi(df).collect()}
    lo, hi = pts.min(axis=0), pts.max(axis=0)
    lo, hi = lo - (hi - lo) / 2, hi + (hi - lo) / 2
    box = np.array([lo, [hi[0], lo[1]], hi, [lo[0], hi[1]]])
    for i, p in enumerate(pts):
        want = abs(rg.signed_area(rg.voronoi_clip(box, p, np.delete(pts, i, axis=0))))
        assert area(cells[i]) == pytest.approx(want, rel=1e-6)


def test_voronoi_rejections(spark):
    rows = [(1, 1, 0.0, 0.0), (2, 1, 0.0, 0.0), (2, 2, 0.0, 0.0), (3, 1, 0.0, 0.0), (3, 2, 0.0, 0.0), (3, 3, 1.0, 1.0), (4, 1, 0.0, 0.0), (4, 2, 5.0, 5.0)]
    df = spark.createDataFrame(rows, "collection_id bigint, seed_id bigint, x double, y double")
    got = {r.collection_id: r.error for r in shapes.voronoi_errors(df).collect()}
    assert got == {1: shapes.TOO_FEW, 2: shapes.TOO_FEW_DISTINCT, 3: shapes.DUPLICATES, 4: None}


def test_buffer_area_of_convex_shapes():
    square = np.array([[0, 0], [10, 0], [10, 10], [0, 10]], float)
    got = abs(rg.signed_area(rg.buffer_convex(square, 2.0)))
    disc = 16 * 4.0 * math.sin(math.pi / 16)
    assert got == pytest.approx(100 + 80 + disc, rel=1e-9)
    line = rg.buffer_convex(np.array([[0, 0], [10, 0]], float), 2.0)
    assert abs(rg.signed_area(line)) == pytest.approx(40 + disc, rel=1e-9)


def test_buffer_of_concave_shape_is_reported(spark):
    ring = [(0.0, 0.0), (10.0, 0.0), (5.0, 2.0), (5.0, 10.0), (0.0, 0.0)]
    df = spark.createDataFrame([(1, ring)], "id int, ring array<struct<x:double,y:double>>")
    row = shapes.buffer_rings(df, "ring", F.lit(1.0)).first()
    assert row.buffer is None and row.error == shapes.UNSUPPORTED


def test_intersection_is_inside_both(tables):
    from fjelldoc.plans.shape_queries import layer_boxes
    from fjelldoc.plans.geo_queries import site_polygons

    left = layer_boxes(tables).select("point_id", F.element_at("rings", 1).alias("a"), "min_x", "max_x", "min_y", "max_y")
    right = site_polygons(tables).select("site_id", F.element_at("rings", 1).alias("b"), "min_x", "max_x", "min_y", "max_y")
    rows = shapes.intersections(left, right, "a", "b").collect()
    assert rows and len({(r.point_id, r.site_id) for r in rows}) == len(rows)
    for r in rows:
        assert r.error is None and 0 < area(r.overlap) <= min(area(r.a), area(r.b)) * (1 + 1e-9)


def test_hole_and_boundary(spark):
    outer = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0), (0.0, 0.0)]
    hole = [(4.0, 4.0), (6.0, 4.0), (6.0, 6.0), (4.0, 6.0), (4.0, 4.0)]
    polys = geometry.with_extent(spark.createDataFrame([(1, [outer, hole])], "poly_id int, rings array<array<struct<x:double,y:double>>>"))
    pts = spark.createDataFrame([(1, 5.0, 5.0), (2, 1.0, 1.0), (3, 0.0, 5.0), (4, 10.0, 10.0), (5, 11.0, 5.0), (6, 4.0, 5.0)], "point_id int, x double, y double")
    assert {r.point_id for r in geometry.points_in_polygons(pts, polys, 3.0).collect()} == {2}


def test_boxes_of_all_sizes_meet_once(spark):
    """From points to half the plane, crowded cells cut: the pairs are those of brute force, and no box has more than four rows."""
    import random

    rng = random.Random(4)

    def boxes(n):
        rows = []
        for i in range(n):
            w, h = (rng.choice([0.0, 0.5, 3.0, 40.0, 900.0, 1e6]) * rng.random() for _ in range(2))
            x, y = (rng.choice([rng.uniform(-500, 500), rng.uniform(-5e5, 5e5), 0.0]) for _ in range(2))
            rows.append((i, x, x + w, y, y + h))
        return rows

    left, right = boxes(150), boxes(130)
    a, b = (spark.createDataFrame(rows, f"{name} int, min_x double, max_x double, min_y double, max_y double") for rows, name in ((left, "a"), (right, "b")))
    want = sorted((i, j) for i, x0, x1, y0, y1 in left for j, u0, u1, v0, v1 in right if x0 <= u1 and u0 <= x1 and y0 <= v1 and v0 <= y1)
    for crowd in (3, geometry.CROWD):
        pairs = geometry.meeting_boxes(a, b, crowd)
        assert sorted((r.a, r.b) for r in pairs.collect()) == want and pairs.columns[-4:] == ["right_min_x", "right_max_x", "right_min_y", "right_max_y"]
    assert geometry._covering_cells(geometry._with_level(a)).groupBy("a").count().agg(F.max("count")).first()[0] <= 4
    sites = a.withColumns({"edges": F.array().cast("array<struct<ax:double,ay:double,bx:double,by:double>>"), "is_area": F.lit(True)})
    points = spark.createDataFrame([(i, rng.uniform(-500, 500), rng.uniform(-500, 500)) for i in range(200)], "point_id int, x double, y double")
    near = {(r.point_id, r.a) for r in geometry._paired(points, sites, 50.0, 5).collect()}
    assert near == {(p.point_id, i) for p in points.collect() for i, x0, x1, y0, y1 in left if x0 - 50 <= p.x <= x1 + 50 and y0 - 50 <= p.y <= y1 + 50}


@pytest.mark.parametrize(
    "text, n, parts",
    [
        ('{"type":"Point","coordinates":[1,2.5]}', 1, 1),
        ('{"type":"MultiPoint","coordinates":[[1,2],[3,4]]}', 2, 2),
        ('{"type":"LineString","coordinates":[[1,2],[3,4]]}', 2, 1),
        ('{"type":"MultiLineString","coordinates":[[[1,2],[3,4]],[[5,6],[7,8]]]}', 4, 2),
        ('{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}', 4, 1),
        ('{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[1,1],[0,0]]],[[[5,5],[6,5],[6,6],[5,5]]]]}', 8, 2),
        ('{"type":"GeometryCollection","geometries":[{"type":"Point","coordinates":[-1,2e1]},{"type":"LineString","coordinates":[[1,2],[3,4]]}]}', 3, 2),
    ],
)
def test_every_geometry_type(spark, text, n, parts):
    row = spark.createDataFrame([(text,)], "g string").select(geojson.vertices(F.col("g")).alias("v"), geojson.geometry(F.col("g")).alias("g")).first()
    assert len(row.v) == n and len(row.g.parts) == parts
    assert [tuple(v) for v in row.v] == [tuple(v) for p in row.g.parts for r in p for v in r]


def test_nested_collections_and_round_trip(spark, tmp_path):
    from fjelldoc.operators import export

    inner = '{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"a":1},"geometry":{"type":"Point","coordinates":[1,2]}},{"type":"Point","coordinates":[3,4]}]}'
    outer = '{"type":"FeatureCollection","features":[%s,{"type":"Feature","properties":null,"geometry":null}]}' % inner
    layers = spark.createDataFrame([(1, "l", 'n"q', "s", None, outer)], "chat_id int, layer_id string, name string, shape string, visible boolean, geojson string")
    lines = export.feature_lines(export.layer_features(layers))
    assert [r.feature_id for r in lines.orderBy("feature_id").collect()] == ["l-1", "l-2"]
    export.write_features(lines, str(tmp_path / "out"))
    back = export.read_features(spark, str(tmp_path / "out")).orderBy("feature_id").collect()
    assert [r.geometry.type for r in back] == ["Point", "Point"]
    assert '"exportLayerVisible":true' in back[0].properties and '"a":1' in back[0].properties


def test_circle_radius(spark):
    ring = spark.range(1).select(geo.circle_ring(F.lit(10.0), F.lit(60.0), F.lit(500.0)).alias("r")).first().r
    assert len(ring) == 65 and tuple(ring[0]) == pytest.approx(tuple(ring[64]))


def test_nearest_beyond_the_old_border(spark):
    """Northings above 2^23 m keep their rows and their nearest seed."""
    points = spark.createDataFrame([(1, 500000.0, 8400000.0), (2, 500000.0, 8380000.0), (3, 500000.0, 9000000.0)], "point_id long, x double, y double")
    seeds = spark.createDataFrame([(1, 500000.0, 8300000.0), (2, 500000.0, 8395000.0), (3, 500000.0, 7000000.0)], "seed_id long, x double, y double")
    from fjelldoc.operators.geometry import nearest_seed

    got = {r.point_id: r.seed_id for r in nearest_seed(points, seeds).collect()}
    assert got == {1: 2, 2: 2, 3: 2}


def test_nested_collections_are_flattened(spark):
    from pyspark.sql import functions as F

    from fjelldoc.functions import geojson

    point = '{"type":"Point","coordinates":[1,2]}'

    def nested(kind, field, depth):
        text = point
        for _ in range(depth):
            text = f'{{"type":"{kind}","{field}":[{text},{point}]}}'
        return spark.createDataFrame([(text,)], "g string")

    for depth in (1, 2, 4):
        found = nested("FeatureCollection", "features", depth).select(geojson.features(F.col("g"))).first()[0]
        assert len(found) == depth + 1 and all('"geometry":{"type":"Point"' in f for f in found)
        assert len(nested("GeometryCollection", "geometries", depth).select(geojson.parts(F.col("g"))).first()[0]) == depth + 1
    for depth in (5, 40):  # one such row must not end the query: it has an error, or is walked when asked for
        row = nested("FeatureCollection", "features", depth).select(geojson.features(F.col("g")).alias("f"), geojson.depth_error(F.col("g")).alias("e"), geojson.features(F.col("g"), deep=True).alias("d")).first()
        assert row.f is None and "nested deeper" in row.e and len(row.d) == depth + 1
        row = nested("GeometryCollection", "geometries", depth).select(geojson.parts(F.col("g")).alias("p"), geojson.depth_error(F.col("g")).alias("e"), geojson.parts(F.col("g"), deep=True).alias("d")).first()
        assert row.p is None and "nested deeper" in row.e and len(row.d) == depth + 1
    shallow = nested("FeatureCollection", "features", 2).select(geojson.depth_error(F.col("g")).alias("e"), geojson.features(F.col("g"), deep=True).alias("d")).first()
    assert shallow.e is None and len(shallow.d) == 3


def test_few_bytes_of_boxes_are_dealt_over_many_tasks(spark):
    """The work is in the pairs: small tables must not put them all into the task or two that their bytes ask for."""
    spots = spark.range(400).select(F.col("id").alias("point_id"), (F.col("id") % 20 * 1000.0).alias("x"), (F.floor(F.col("id") / 20) * 1000.0).alias("y"))
    x, y = F.col("id") % 20 * 1000.0, F.floor(F.col("id") / 20) * 1000.0
    corners = F.array(*[geo.point(x + a, y + b) for a, b in ((-9, -9), (9, -9), (9, 9), (-9, 9), (-9, -9))])
    boxes = geometry.with_extent(spark.range(400).select(F.col("id").alias("site_id"), F.array(corners).alias("rings")))
    for pairs in (geometry.points_in_polygons(spots, boxes), geometry.meeting_boxes(boxes.drop("edges", "is_area", "rings"), boxes.withColumnRenamed("site_id", "other"))):
        held = pairs.groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert sum(r["count"] for r in held) == 400 and len(held) > 8


def test_centroids_compute_no_ring_twice(spark):
    """A column named twice in a lambda is computed twice: each ring's sums stand once in the plan for areas, and a few times in all."""
    rows = spark.createDataFrame([("Polygon",)], "kind string").withColumn("parts", F.array(F.array(F.array(geo.point(F.rand(1), F.rand(2))))))
    plan = rows.select(geo.centroid(F.col("kind"), F.col("parts")).alias("c"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("aggregate(") <= 25


def _spots_and_shapes(spark, n=300, m=90, seed=8):
    """Points, some of them on one place, and triangles, concave and open shapes of all sizes, two with an edge of no length."""
    rng = np.random.default_rng(seed)
    spots = [(i, *([500.0, 500.0] if i % 10 == 0 else rng.uniform(0, 4000, 2).tolist())) for i in range(n)]
    shapes_ = []
    for i in range(m):
        turn = np.sort(rng.uniform(0, 2 * math.pi, int(rng.integers(3, 9))))
        ring = rng.uniform(0, 4000, 2) + rng.choice([20.0, 300.0, 2500.0]) * rng.uniform(0.2, 1, len(turn))[:, None] * np.column_stack([np.cos(turn), np.sin(turn)])
        ring = np.vstack([ring, ring[:1], ring[:1]] if i % 40 == 0 else [ring, ring[:1]])
        shapes_.append((1000 - i, f"s{i}", [[tuple(map(float, p)) for p in ring]], i % 7 != 0))
    points = spark.createDataFrame(spots, "point_id long, x double, y double")
    sites = spark.createDataFrame(shapes_, f"site_id long, name string, rings array<array<{geo.POINT}>>, area boolean")
    return points, geometry.with_extent(sites, is_area=F.col("area")).drop("rings", "area")


def _all_pairs(points, sites):
    exact = geo.distance_to(F.col("edges"), F.col("is_area"), F.col("x"), F.col("y"))
    return [(r.point_id, r.site_id, r.d) for r in points.crossJoin(sites).select("point_id", "site_id", exact.alias("d")).collect()]


def test_blocks_hold_the_pairs_of_brute_force(spark, monkeypatch):
    """Distances, the nearest within each probe's reach and the covering polygon, in blocks of any size and cut into parts."""
    from fjelldoc.operators import blocks

    points, sites = _spots_and_shapes(spark)
    far = _all_pairs(points, sites)
    monkeypatch.setattr(blocks, "BLOCK", 20)
    monkeypatch.setattr(blocks, "CROWD", 7)
    got = geometry.within_distance(points, sites, 150.0).collect()
    want = {(p, s): d for p, s, d in far if d <= 150.0}
    assert len(got) == len(want) and all(r.distance == pytest.approx(want[r.point_id, r.site_id], abs=1e-9) for r in got) and all(r.name == f"s{1000 - r.site_id}" for r in got)
    nearest = {}
    for p, s, d in far:
        nearest[p] = min(nearest.get(p, (math.inf, 0)), (round(d, 6), s))
    found = geometry.nearest_polygon(points, sites, "site_id").collect()
    assert {r.point_id: (r.distance, r.site_id) for r in found} == nearest and len(found) == 300


def test_probes_get_their_nearest_sites_up_to_the_limit(spark, monkeypatch):
    from fjelldoc.operators import blocks

    lonlat = geo.unproject_vertices(F.array(geo.point(F.col("x") + 300_000, F.col("y") + 6_600_000)))
    points, sites = _spots_and_shapes(spark, 200, 120)
    moved = sites.select("site_id", "is_area", *[(F.col(c) + (300_000 if c.endswith("x") else 6_600_000)).alias(c) for c in blocks.BOX], F.transform("edges", lambda e: F.struct((e["ax"] + 300_000).alias("ax"), (e["ay"] + 6_600_000).alias("ay"), (e["bx"] + 300_000).alias("bx"), (e["by"] + 6_600_000).alias("by"))).alias("edges"))
    probes = points.select(F.col("point_id").alias("probe_id"), F.explode(lonlat).alias("p"), F.when(F.col("point_id") % 50 == 7, 5.0).otherwise(100.0 + F.col("point_id") * 10).alias("distance")).select("probe_id", F.col("p.x").alias("lon"), F.col("p.y").alias("lat"), "distance")
    placed = geometry.project_points(probes)
    reach = {r.probe_id: r.distance for r in probes.collect()}
    want = {}
    for p, s, d in _all_pairs(placed.withColumnRenamed("probe_id", "point_id"), moved):
        if round(d, 3) <= reach[p] and reach[p] >= 10:
            want.setdefault(p, []).append((round(d, 3), s))
    for block, crowd in ((1000, 20_000), (5, 3)):
        monkeypatch.setattr(blocks, "BLOCK", block)
        monkeypatch.setattr(blocks, "CROWD", crowd)
        got = {}
        for r in geometry.buffer_search(probes, moved, 6).orderBy("probe_id", "rank").collect():
            got.setdefault(r.probe_id, []).append((r.metres, r.site_id))
            assert r.rank == len(got[r.probe_id])
        assert got == {p: sorted(v)[:6] for p, v in want.items()}


@pytest.mark.parametrize("name", ["distance_join", "buffer_search"])
def test_pairs_are_made_in_blocks(spark, name):
    """No pair of a point and an edge list is a row of a join: blocks meet the geometries, their pairs are numpy tables."""
    import __spark_entry__ as entry

    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan or "FlatMapCoGroupsInPandas" in plan


def test_a_point_under_many_polygons_tries_few(spark):
    """Polygons over one place are tried by id until one holds the point."""
    import pyarrow as pa

    from fjelldoc.operators import blocks

    corners = [(0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (0.0, 9.0), (0.0, 0.0)]
    edges = [{"ax": a[0], "ay": a[1], "bx": b[0], "by": b[1]} for a, b in zip(corners, corners[1:])]
    n = 3000
    right = pa.table({"site_id": list(range(n, 0, -1)), "min_x": [0.0] * n, "max_x": [9.0] * n, "min_y": [0.0] * n, "max_y": [9.0] * n, "is_area": [True] * n, "edges": [edges] * n})
    left = pa.table({"x": [4.0, 5.0], "y": [4.0, 5.0], "reach": [1e-6, 1e-6]})
    sites, tried = blocks.Sites(right), []
    whole = sites.distances
    sites.distances = lambda x, y, some: tried.append(len(some)) or whole(x, y, some)
    found = [(i, right["site_id"][int(j)].as_py()) for a, b, _ in blocks.covering("site_id")(sites, left, right) for i, j in zip(a.tolist(), b.tolist())]
    assert sorted(found) == [(0, 1), (1, 1)] and sum(tried) <= 16


@pytest.mark.parametrize("name, function", [("polygon_intersections", "_overlap_udf"), ("line_intersections", "_segment_udf")])
def test_rings_go_to_the_clipping_as_they_are(spark, name, function):
    """No interpreted function of arrays takes the rings of a pair apart, before or after they are clipped."""
    import __spark_entry__ as entry

    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    above, found, _ = plan.partition(f"ArrowEvalPython [{function}")
    line = plan[len(above) :].split("\n")[0]
    assert found and "transform(" not in line and "transform(" not in above and "aggregate(" not in above


def test_convex_overlaps_of_open_closed_and_other_rings(spark):
    square = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    moved = [(x + 4, y + 4) for x, y in square]
    dent = [(0.0, 0.0), (10.0, 0.0), (5.0, 2.0), (5.0, 10.0), (0.0, 0.0)]
    box = {"min_x": F.array_min(F.transform("ring", lambda v: v["x"])), "max_x": F.array_max(F.transform("ring", lambda v: v["x"])), "min_y": F.array_min(F.transform("ring", lambda v: v["y"])), "max_y": F.array_max(F.transform("ring", lambda v: v["y"]))}
    frame = lambda rows, key: spark.createDataFrame(rows, f"{key} int, ring array<{geo.POINT}>").withColumns(box)
    left = frame([(1, square), (2, [*square, square[0]]), (3, square[::-1]), (4, dent), (5, [(90.0, 90.0), (91.0, 90.0), (91.0, 91.0)])], "a")
    right = frame([(1, [*moved, moved[0]])], "b").withColumnRenamed("ring", "other")
    got = {r.a: r for r in shapes.intersections(left, right, "ring", "other").withColumn("area", shapes.ring_area("overlap")).collect()}
    assert {k: r.area for k, r in got.items()} == {1: 36.0, 2: 36.0, 3: 36.0, 4: None} and got[4].error == shapes.UNSUPPORTED
    assert all(r.overlap[0] == r.overlap[-1] and len(r.overlap) == 5 for k, r in got.items() if k < 4)
    lines = frame([(1, [(0.0, 5.0), (20.0, 5.0)]), (2, [(0.0, 0.0), (5.0, 0.0)]), (3, [(4.0, 0.0), (4.0, 20.0)])], "a")
    cut = {r.a: [tuple(v) for v in r.overlap] for r in shapes.line_intersections(lines, right, "ring", "other").collect()}
    assert cut == {1: [(4.0, 5.0), (14.0, 5.0)], 3: [(4.0, 4.0), (4.0, 14.0)]}
