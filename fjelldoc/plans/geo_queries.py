"""Projection, spatial joins, distance search and map export."""

from __future__ import annotations

from pyspark.sql import functions as F

from fjelldoc.functions import geo, geojson
from fjelldoc.operators import export, geometry
from fjelldoc.plans.registry import query
from fjelldoc.sources.tables import Tables, with_tables


def _lit(v: float) -> str:
    return f"{v!r}" if "e" in repr(v) else f"{v!r}e0"


def utm_sql(source: str, keep: str, lon: str = "lon", lat: str = "lat") -> str:
    """DuckDB text projecting lon/lat of `source` to x, y next to the columns `keep`."""
    k = _lit(geo.SCALE * geo.RECTIFYING)
    ex = " + ".join(f"{_lit(a)} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(geo.ALPHA, 1))
    ny = " + ".join(f"{_lit(a)} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(geo.ALPHA, 1))
    e = _lit(geo.ECC)
    return f"""SELECT {keep}, 500000e0 + {k} * (eta + {ex}) AS x, {k} * (xi + {ny}) AS y
      FROM (SELECT *, atan2(t, cos(dl)) AS xi, atanh(sin(dl) / sqrt(1e0 + t * t)) AS eta
      FROM (SELECT *, radians({lon} - 15e0) AS dl, sinh(atanh(sin(radians({lat}))) - {e} * atanh({e} * sin(radians({lat})))) AS t FROM {source}))"""


def inverse_sql(source: str, keep: str, x: str = "x", y: str = "y") -> str:
    k = _lit(geo.SCALE * geo.RECTIFYING)
    bx = " + ".join(f"{_lit(b)} * sin({2 * j} * xi0) * cosh({2 * j} * eta0)" for j, b in enumerate(geo.BETA, 1))
    by = " + ".join(f"{_lit(b)} * cos({2 * j} * xi0) * sinh({2 * j} * eta0)" for j, b in enumerate(geo.BETA, 1))
    dd = " + ".join(f"{_lit(d)} * sin({2 * j} * chi)" for j, d in enumerate(geo.DELTA, 1))
    return f"""SELECT {keep}, 15e0 + degrees(dl2) AS lon, degrees(chi + {dd}) AS lat
      FROM (SELECT *, asin(sin(xi1) / cosh(eta1)) AS chi, atan2(sinh(eta1), cos(xi1)) AS dl2
      FROM (SELECT *, xi0 - ({bx}) AS xi1, eta0 - ({by}) AS eta1 FROM (SELECT *, {y} / {k} AS xi0, ({x} - 500000e0) / {k} AS eta0 FROM {source})))"""


def projected_points(t: Tables):
    return geometry.project_points(geometry.dealt(t.points))


def site_polygons(t: Tables):
    """Projected site rectangles with edges and extent."""
    corners = F.array(
        *[geo.point(F.col("lon") + dx, F.col("lat") + dy) for dx, dy in ((-0.25, -0.25), (0.25, -0.25), (0.25, 0.25), (-0.25, 0.25), (-0.25, -0.25))]
    )
    rings = geometry.dealt(t.sites).select("site_id", "name", F.array(geo.project_vertices(corners)).alias("rings"))
    return geometry.with_extent(rings)


PTS = f"pts AS ({utm_sql('points', 'point_id')})"
CORNERS = """
  corners AS (SELECT site_id, c.i AS i, lon + c.dx AS lon, lat + c.dy AS lat FROM sites,
     (VALUES (1, -0.25e0, -0.25e0), (2, 0.25e0, -0.25e0), (3, 0.25e0, 0.25e0), (4, -0.25e0, 0.25e0), (5, -0.25e0, -0.25e0)) c(i, dx, dy))"""
EDGES = CORNERS + f""",
  ring AS ({utm_sql('corners', 'site_id, i')}),
  edges AS (SELECT a.site_id, a.i, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM ring a JOIN ring b ON a.site_id = b.site_id AND b.i = a.i + 1)"""


@query(with_tables("points").rstrip() + "," + PTS + " SELECT point_id, round(x, 3) AS x, round(y, 3) AS y FROM pts")
def projection_to_metres(t: Tables):
    return projected_points(t).select("point_id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query(with_tables("points") + "SELECT point_id, round(lon, 7) AS lon, round(lat, 7) AS lat FROM points")
def projection_round_trip(t: Tables):
    """Metres back to degrees gives the original position."""
    back = projected_points(t).withColumn("p", F.element_at(geo.unproject_vertices(F.array(geo.point(F.col("x"), F.col("y")))), 1))
    return back.select("point_id", F.round("p.x", 7).alias("lon"), F.round("p.y", 7).alias("lat"))


WITHIN = f"""{PTS},{EDGES},
  pairs AS (SELECT point_id, site_id, sum(((ay > y) <> (by_ > y) AND x < (bx - ax) * (y - ay) / nullif(by_ - ay, 0) + ax)::INTEGER) % 2 = 1 AS inside,
      min(sqrt((x - ax - tt * (bx - ax)) ** 2 + (y - ay - tt * (by_ - ay)) ** 2)) AS edge_distance
    FROM (SELECT *, least(greatest(((x - ax) * (bx - ax) + (y - ay) * (by_ - ay)) / ((bx - ax) ** 2 + (by_ - ay) ** 2), 0e0), 1e0) AS tt FROM pts, edges)
    GROUP BY point_id, site_id)"""


@query(with_tables("points", "sites").rstrip() + "," + WITHIN + " SELECT point_id, site_id FROM pairs WHERE inside AND edge_distance > 0")
def point_in_polygon(t: Tables):
    return geometry.points_in_polygons(projected_points(t), site_polygons(t)).select("point_id", "site_id")


@query(with_tables("points", "sites").rstrip() + "," + WITHIN + """,
  n AS (SELECT site_id, count(*) FILTER (inside) AS num_points FROM pairs GROUP BY site_id)
  SELECT site_id, num_points, CASE WHEN num_points > 0 THEN num_points || ' point(s) found inside the polygon.' ELSE 'No points found inside the polygon.' END AS message FROM n""")
def point_in_polygon_counts(t: Tables):
    inside = geometry.points_in_polygons(projected_points(t), site_polygons(t)).groupBy("site_id").agg(F.count("*").alias("n"))
    counts = t.sites.select("site_id").join(inside, "site_id", "left").select("site_id", F.coalesce("n", F.lit(0)).alias("num_points"))
    found = F.concat(F.col("num_points").cast("string"), F.lit(" point(s) found inside the polygon."))
    return counts.withColumn("message", F.when(F.col("num_points") > 0, found).otherwise("No points found inside the polygon."))


@query(with_tables("points", "sites").rstrip() + "," + WITHIN + """
  SELECT point_id, site_id, round(CASE WHEN inside THEN 0e0 ELSE edge_distance END, 3) AS distance FROM pairs WHERE inside OR edge_distance <= 20000""")
def distance_join(t: Tables):
    near = geometry.within_distance(projected_points(t).select("point_id", "x", "y"), site_polygons(t).drop("name", "rings"), 20_000.0)
    return near.select("point_id", "site_id", F.round("distance", 3).alias("distance"))


PROBES = """
  probes AS (SELECT p.point_id AS probe_id, CASE WHEN c_mktsegment = 'BUILDING' AND c_acctbal < 0 THEN 95e0 ELSE lat END AS lat, lon,
                    CASE WHEN c_mktsegment = 'MACHINERY' AND c_acctbal < 0 THEN 5e0 ELSE 1000e0 + c_nationkey * 2000e0 END AS distance FROM points p JOIN customer ON c_custkey = p.point_id)"""


def probes(t: Tables):
    c = t.customer.select(F.col("c_custkey").alias("point_id"), "c_mktsegment", "c_acctbal", "c_nationkey")
    p = geometry.dealt(t.points.join(c, "point_id"))
    bad = F.col("c_acctbal") < 0
    return p.select(
        F.col("point_id").alias("probe_id"),
        F.when((F.col("c_mktsegment") == "BUILDING") & bad, 95.0).otherwise(F.col("lat")).alias("lat"),
        "lon",
        F.when((F.col("c_mktsegment") == "MACHINERY") & bad, 5.0).otherwise(F.lit(1000.0) + F.col("c_nationkey") * 2000.0).alias("distance"),
    )


@query(with_tables("points").rstrip() + "," + PROBES + """
  SELECT probe_id, CASE WHEN NOT (lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180) THEN 'Ugyldige koordinater.'
    WHEN NOT distance BETWEEN 10 AND 50000 THEN 'Avstand må være mellom 10 og 50000 meter.' END AS error FROM probes""")
def probe_range_check(t: Tables):
    return geometry.check_probes(probes(t)).select("probe_id", "error")


@query(with_tables("points", "sites").rstrip() + "," + PROBES + f""",
  good AS (SELECT * FROM probes WHERE lat BETWEEN -90 AND 90 AND distance BETWEEN 10 AND 50000),
  pr AS ({utm_sql('good', 'probe_id, distance')}),{EDGES},
  m AS (SELECT probe_id, site_id, distance, round(CASE WHEN sum(((ay > y) <> (by_ > y) AND x < (bx - ax) * (y - ay) / nullif(by_ - ay, 0) + ax)::INTEGER) % 2 = 1 THEN 0e0
           ELSE min(sqrt((x - ax - tt * (bx - ax)) ** 2 + (y - ay - tt * (by_ - ay)) ** 2)) END, 3) AS metres
        FROM (SELECT *, least(greatest(((x - ax) * (bx - ax) + (y - ay) * (by_ - ay)) / ((bx - ax) ** 2 + (by_ - ay) ** 2), 0e0), 1e0) AS tt FROM pr, edges)
        GROUP BY probe_id, site_id, distance)
  SELECT probe_id, site_id, metres, (row_number() OVER (PARTITION BY probe_id ORDER BY metres, site_id))::INTEGER AS rank FROM m WHERE metres <= distance
  QUALIFY row_number() OVER (PARTITION BY probe_id ORDER BY metres, site_id) <= 200""")
def buffer_search(t: Tables):
    return geometry.buffer_search(probes(t), site_polygons(t).drop("name", "rings")).select("probe_id", "site_id", "metres", "rank")


def seeds(t: Tables):
    s = geometry.project_points(geometry.dealt(t.sites))
    return s.select(F.col("site_id").alias("seed_id"), "x", "y")


SEEDS = f"seeds AS ({utm_sql('sites', 'site_id AS seed_id')})"


@query(with_tables("points", "sites").rstrip() + f""",{PTS},{SEEDS}
  SELECT p.point_id, s.seed_id, round(sqrt((p.x - s.x) ** 2 + (p.y - s.y) ** 2), 3) AS distance FROM pts p, seeds s
  QUALIFY row_number() OVER (PARTITION BY p.point_id ORDER BY round(sqrt((p.x - s.x) ** 2 + (p.y - s.y) ** 2), 6), s.seed_id) = 1""")
def nearest_seed(t: Tables):
    return geometry.nearest_seed(projected_points(t), seeds(t)).select("point_id", "seed_id", F.round("distance", 3).alias("distance"))


@query(with_tables("points", "sites").rstrip() + "," + WITHIN + """,
  d AS (SELECT point_id, site_id, CASE WHEN inside THEN 0e0 ELSE round(edge_distance, 6) END AS distance FROM pairs)
  SELECT point_id, site_id, round(distance, 3) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY distance, site_id) = 1""")
def nearest_polygon(t: Tables):
    return geometry.nearest_polygon(projected_points(t), site_polygons(t), "site_id").select("point_id", "site_id", F.round("distance", 3).alias("distance"))


@query(with_tables("points") + """
  SELECT count(*) FILTER (lon < 20) AS seed_count, count(DISTINCT (lon, lat)) FILTER (lon < 20) AS distinct_seed_count FROM points""")
def seed_statistics(t: Tables):
    """Positions east of twenty degrees count as missing; the whole table is read."""
    known = t.points.select(F.when(F.col("lon") < 20, F.col("lon")).alias("x"), F.col("lat").alias("y"))
    return geometry.seed_statistics(known)


# -- single-geometry functions ----------------------------------------------

SHAPES = """
  shapes AS (SELECT layer_id, key, segment, geojson, CASE WHEN segment IN ('BUILDING') THEN 1 WHEN segment = 'AUTOMOBILE' THEN 2 WHEN segment = 'MACHINERY' THEN 5 ELSE 7 END AS n,
     lon::DECIMAL(9,3)::DOUBLE AS x0, lat::DECIMAL(9,3)::DOUBLE AS y0, x1::DOUBLE AS x1, y1::DOUBLE AS y1 FROM layers JOIN (SELECT layer_id, x1, y1 FROM layer_coords) USING (layer_id) WHERE geojson IS NOT NULL)"""


@query(with_tables("layers").rstrip() + "," + SHAPES + """
  SELECT layer_id, n::BIGINT AS n, round(CASE segment WHEN 'BUILDING' THEN x0 WHEN 'AUTOMOBILE' THEN x0 + x1 WHEN 'MACHINERY' THEN 3 * x0 + 2 * x1 ELSE 4 * x0 + 3 * x1 END, 6) AS sum_x FROM shapes""")
def geometry_vertices(t: Tables):
    v = export.exportable(t.layers).select("layer_id", geojson.vertices(F.col("geojson")).alias("v"))
    return v.select(
        "layer_id", F.size("v").cast("bigint").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda a, p: a + p["x"]), 6).alias("sum_x")
    )


FEATURES = """
  feats AS (SELECT layer_id, 0 AS ix, CASE segment WHEN 'AUTOMOBILE' THEN 'f' || key ELSE layer_id || '-1' END AS feature_id,
                   CASE segment WHEN 'BUILDING' THEN 'Point' WHEN 'AUTOMOBILE' THEN 'LineString' ELSE 'Polygon' END AS kind, chat_id, name, visible, segment, key, x0, y0, x1, y1
            FROM layer_coords WHERE segment IN ('BUILDING', 'AUTOMOBILE', 'MACHINERY')
            UNION ALL SELECT layer_id, 0, 'f' || key, 'LineString', chat_id, name, visible, segment, key, x0, y0, x1, y1 FROM layer_coords WHERE segment = 'HOUSEHOLD'
            UNION ALL SELECT layer_id, 1, layer_id || '-2', 'Polygon', chat_id, name, visible, segment, key, x0, y0, x1, y1 FROM layer_coords WHERE segment = 'HOUSEHOLD')"""


def shaped_layers(t: Tables):
    return t.layers.withColumn("shape", F.col("segment"))


@query(with_tables("layers").rstrip() + "," + FEATURES + """
  SELECT layer_id, ix::INTEGER AS feature_ix, feature_id, kind,
     CASE WHEN kind = 'LineString' THEN '{"kind":"line",' ELSE '{' END || '"exportLayerId":"' || layer_id || '","exportLayerName":"' || name || '","exportLayerShape":"' || segment
       || '","exportLayerVisible":' || visible || '}' AS properties FROM feats""")
def layer_features(t: Tables):
    f = export.layer_features(shaped_layers(t))
    return f.select("layer_id", "feature_ix", "feature_id", F.get_json_object("geometry", "$.type").alias("kind"), "properties")


@query(with_tables("layers").rstrip() + "," + FEATURES + """
  SELECT c.chat_id, c.n AS layer_count, f.n AS feature_count FROM (SELECT chat_id, count(*) AS n FROM layers WHERE geojson IS NOT NULL GROUP BY chat_id) c
  JOIN (SELECT chat_id, count(*) AS n FROM feats GROUP BY chat_id) f USING (chat_id)""")
def export_counts(t: Tables):
    return export.export_totals(export.layer_records(shaped_layers(t)))


@query(with_tables("layers") + """
  SELECT layer_id, '{"id":"' || layer_id || '","name":"' || name || '","shape":"' || segment || '","visible":' || visible || ',"featureCount":'
    || CASE segment WHEN 'HOUSEHOLD' THEN 2 ELSE 1 END || ',"geoJson":' || geojson || '}' AS record FROM layers WHERE geojson IS NOT NULL""")
def json_export_records(t: Tables):
    return export.layer_records(shaped_layers(t)).select("layer_id", "record")


@query()
def feature_collection_lines(t: Tables):
    """Every feature of every layer as one line of GeoJSON."""
    return export.feature_lines(export.layer_features(shaped_layers(t)))


@query()
def rows_as_features(t: Tables):
    """Site rows with their rectangle as geometry and the other columns as properties."""
    lonlat = geo.unproject_vertices(F.element_at("rings", 1))
    rows = site_polygons(t).select("site_id", "name", geojson.polygon_text(lonlat).alias("geojson"))
    return export.rows_to_features(rows, "geojson")


@query()
def parsed_geometries(t: Tables):
    """Geometry structs of all layer features."""
    f = export.layer_features(shaped_layers(t)).select("layer_id", "feature_id", geojson.geometry(F.col("geometry")).alias("g"))
    return f.select("layer_id", "feature_id", "g.type", F.size("g.parts").alias("n_parts"))


@query(with_tables("layers").rstrip() + "," + FEATURES + """
  SELECT feature_id, layer_id, kind AS type, CASE kind WHEN 'Point' THEN '[' || x0::DOUBLE || ',' || y0::DOUBLE || ']'
    WHEN 'LineString' THEN '[[' || x0::DOUBLE || ',' || y0::DOUBLE || '],[' || x1::DOUBLE || ',' || y1::DOUBLE || ']]'
    ELSE '[[[' || x0::DOUBLE || ',' || y0::DOUBLE || '],[' || x1::DOUBLE || ',' || y0::DOUBLE || '],[' || x1::DOUBLE || ',' || y1::DOUBLE || '],[' || x0::DOUBLE || ',' || y1::DOUBLE
      || '],[' || x0::DOUBLE || ',' || y0::DOUBLE || ']]]' END AS coordinates FROM feats""")
def coordinate_lists(t: Tables):
    """Type and nested coordinates, numbers in their shortest form."""
    f = export.layer_features(shaped_layers(t))
    return f.select("feature_id", "layer_id", F.get_json_object("geometry", "$.type").alias("type"), geojson.coordinates(F.col("geometry")).alias("coordinates"))


@query("""
  SELECT c_custkey AS point_id, span, CASE WHEN span < 0.005 THEN 18 WHEN span < 0.05 THEN 17 WHEN span < 0.5 THEN 15 WHEN span < 2 THEN 13 ELSE 11 END AS zoom
  FROM (SELECT c_custkey, (c_custkey % 1000) * (c_custkey % 7 + 1) * 0.0005e0 AS span FROM customer)""")
def fly_zooms(t: Tables):
    """Zoom for boxes from a point to several degrees, wider or higher."""
    span = F.col("c_custkey") % 1000 * (F.col("c_custkey") % 7 + 1) * 0.0005
    flat = F.col("c_custkey") % 2 == 0
    rows = t.customer.select(F.col("c_custkey").alias("point_id"), span.alias("span"), F.when(flat, span).otherwise(span / 3).alias("w"), F.when(flat, span / 2).otherwise(span).alias("h"))
    return rows.select("point_id", "span", geo.fly_zoom(F.lit(0.0), F.lit(0.0), F.col("w"), F.col("h")).alias("zoom"))


@query(with_tables("sites").rstrip() + "," + CORNERS + f""",
  ring AS ({utm_sql('corners', 'site_id, i')}),
  box AS (SELECT site_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM ring GROUP BY site_id),
  five AS (SELECT site_id, 0 AS pos, x0 AS x, y0 AS y FROM box UNION ALL SELECT site_id, 1, x0, y1 FROM box UNION ALL SELECT site_id, 2, x1, y1 FROM box
           UNION ALL SELECT site_id, 3, x1, y0 FROM box UNION ALL SELECT site_id, 4, x0, y0 FROM box)
  SELECT site_id, pos, round(lon, 7) AS lon, round(lat, 7) AS lat FROM ({inverse_sql('five', 'site_id, pos')})""")
def envelopes(t: Tables):
    """Bounding rectangle in metres, given back in degrees."""
    env = site_polygons(t).select("site_id", geo.unproject_vertices(geo.bounding_ring(F.flatten("rings"))).alias("ring"))
    return env.select("site_id", F.posexplode("ring").alias("pos", "v")).select("site_id", "pos", F.round("v.x", 7).alias("lon"), F.round("v.y", 7).alias("lat"))


@query(with_tables("sites").rstrip() + "," + EDGES + """,
  o AS (SELECT site_id, arg_min(ax, i) AS ox, arg_min(ay, i) AS oy FROM edges GROUP BY site_id),
  c AS (SELECT e.site_id, ox, oy, sum((ax - ox) * (by_ - oy) - (bx - ox) * (ay - oy)) AS a,
          sum((ax - ox + bx - ox) * ((ax - ox) * (by_ - oy) - (bx - ox) * (ay - oy))) AS sx, sum((ay - oy + by_ - oy) * ((ax - ox) * (by_ - oy) - (bx - ox) * (ay - oy))) AS sy
        FROM edges e JOIN o USING (site_id) GROUP BY e.site_id, ox, oy)
  SELECT site_id, round(ox + sx / (3 * a), 3) AS x, round(oy + sy / (3 * a), 3) AS y FROM c""")
def centroids(t: Tables):
    c = site_polygons(t).select("site_id", geo.ring_centroid(F.element_at("rings", 1)).alias("c"))
    return c.select("site_id", F.round("c.x", 3).alias("x"), F.round("c.y", 3).alias("y"))


@query(with_tables("points").rstrip() + """,
  r AS (SELECT *, radians(lat) AS phi, radians(lon) AS lam, (500e0 + point_id % 1000) / 6378137e0 AS d, unnest(range(0, 65)) AS i FROM points),
  b AS (SELECT *, radians((i % 64) * 5.625e0) AS brg, asin(sin(phi) * cos(d) + cos(phi) * sin(d) * cos(radians((i % 64) * 5.625e0))) AS phi2 FROM r)
  SELECT point_id, i::INTEGER AS pos, round(degrees(lam + atan2(sin(brg) * sin(d) * cos(phi), cos(d) - sin(phi) * sin(phi2))), 7) AS lon, round(degrees(phi2), 7) AS lat FROM b""")
def circle_polygons(t: Tables):
    ring = geo.circle_ring(F.col("lon"), F.col("lat"), F.lit(500.0) + F.col("point_id") % 1000)
    return t.points.select("point_id", F.posexplode(ring).alias("pos", "v")).select("point_id", "pos", F.round("v.x", 7).alias("lon"), F.round("v.y", 7).alias("lat"))


@query(with_tables("points").rstrip() + f""",{PTS}
  SELECT point_id, i::INTEGER AS pos, round(x + (100e0 + point_id % 900) * cos(-2 * pi() * (i % 32) / 32), 3) AS x, round(y + (100e0 + point_id % 900) * sin(-2 * pi() * (i % 32) / 32), 3) AS y
  FROM (SELECT *, unnest(range(0, 33)) AS i FROM pts)""")
def point_buffers(t: Tables):
    ring = geo.disc_ring(F.col("x"), F.col("y"), F.lit(100.0) + F.col("point_id") % 900)
    return projected_points(t).select("point_id", F.posexplode(ring).alias("pos", "v")).select("point_id", "pos", F.round("v.x", 3).alias("x"), F.round("v.y", 3).alias("y"))


MERC = """
  mx AS (SELECT *, (lon + 180) / 360 AS mx, (1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 AS my FROM points)"""


@query(with_tables("points").rstrip() + "," + MERC + """
  SELECT point_id, round(mx, 9) AS mx, round(my, 9) AS my, round(mx * 360 - 180, 7) AS lon, round(degrees(atan(sinh(pi() * (1 - 2 * my)))), 7) AS lat,
         floor(mx * 4096)::BIGINT AS tile_x, floor(my * 4096)::BIGINT AS tile_y FROM mx""")
def web_mercator(t: Tables):
    m = t.points.withColumn("mx", geo.mercator_x(F.col("lon"))).withColumn("my", geo.mercator_y(F.col("lat")))
    return m.select(
        "point_id", F.round("mx", 9).alias("mx"), F.round("my", 9).alias("my"), F.round(geo.mercator_lon(F.col("mx")), 7).alias("lon"),
        F.round(geo.mercator_lat(F.col("my")), 7).alias("lat"), geo.tile_x(F.col("lon"), F.lit(12)).alias("tile_x"), geo.tile_y(F.col("lat"), F.lit(12)).alias("tile_y"),
    )


# -- map frame ---------------------------------------------------------------

VERTS = FEATURES + """,
  verts AS (SELECT chat_id, layer_id, feature_id, unnest(CASE kind WHEN 'Point' THEN [x0] WHEN 'LineString' THEN [x0, x1] ELSE [x0, x1, x1, x0, x0] END)::DOUBLE AS x,
                   unnest(CASE kind WHEN 'Point' THEN [y0] WHEN 'LineString' THEN [y0, y1] ELSE [y0, y0, y1, y1, y0] END)::DOUBLE AS y FROM feats)"""


def feature_vertices(t: Tables):
    return export.vertices(export.layer_features(shaped_layers(t)), "chat_id", "layer_id", "feature_id")


@query(with_tables("layers").rstrip() + "," + VERTS + """
  SELECT layer_id, round(CASE WHEN max(x) - min(x) < 1e-9 THEN min(x) - 0.01 ELSE min(x) END, 6) AS min_x, round(CASE WHEN max(x) - min(x) < 1e-9 THEN max(x) + 0.01 ELSE max(x) END, 6) AS max_x,
         round(CASE WHEN max(y) - min(y) < 1e-9 THEN min(y) - 0.01 ELSE min(y) END, 6) AS min_y, round(CASE WHEN max(y) - min(y) < 1e-9 THEN max(y) + 0.01 ELSE max(y) END, 6) AS max_y,
         17::INTEGER AS fly_zoom FROM verts GROUP BY layer_id""")
def layer_bounds(t: Tables):
    """Bounds per layer; the fly-to zoom is taken from the padded span (0.02 degrees here)."""
    b = export.bounds(feature_vertices(t), "layer_id")
    cols = [F.col(c) for c in ("min_x", "min_y", "max_x", "max_y")]
    return b.select("layer_id", *[F.round(c, 6).alias(c) for c in ("min_x", "min_y", "max_x", "max_y")], geo.fly_zoom(*cols).alias("fly_zoom"))


BOX = VERTS + """,
  bnd AS (SELECT chat_id, CASE WHEN max(x) - min(x) < 1e-9 THEN min(x) - 0.01 ELSE min(x) END AS bx0, CASE WHEN max(x) - min(x) < 1e-9 THEN max(x) + 0.01 ELSE max(x) END AS bx1,
                 CASE WHEN max(y) - min(y) < 1e-9 THEN min(y) - 0.01 ELSE min(y) END AS by0, CASE WHEN max(y) - min(y) < 1e-9 THEN max(y) + 0.01 ELSE max(y) END AS by1 FROM verts GROUP BY chat_id)"""
PROJ = BOX + """,
  mer AS (SELECT *, (bx0 + 180) / 360 AS mx0, (bx1 + 180) / 360 AS mx1, (1 - ln(tan(radians(by1)) + 1 / cos(radians(by1))) / pi()) / 2 AS my0,
                 (1 - ln(tan(radians(by0)) + 1 / cos(radians(by0))) / pi()) / 2 AS my1 FROM bnd),
  org AS (SELECT *, mx0 - 0.6e0 * (mx1 - mx0) AS ox, my0 - 0.6e0 * (my1 - my0) AS oy, 2.2e0 * (mx1 - mx0) AS sx, 2.2e0 * (my1 - my0) AS sy FROM mer),
  scl AS (SELECT *, least(892 / sx, 660 / sy) AS scale FROM org),
  prj AS (SELECT *, 354 + (892 - sx * scale) / 2 AS offx, 214 + (660 - sy * scale) / 2 AS offy FROM scl),
  vis AS (SELECT *, ((354 - offx) / scale + ox) * 360 - 180 AS vx0, ((1246 - offx) / scale + ox) * 360 - 180 AS vx1,
                 degrees(atan(sinh(pi() * (1 - 2 * ((214 - offy) / scale + oy))))) AS vy1, degrees(atan(sinh(pi() * (1 - 2 * ((874 - offy) / scale + oy))))) AS vy0 FROM prj)"""


def chat_projectors(t: Tables):
    return export.projector(export.bounds(feature_vertices(t), "chat_id"))


@query(with_tables("layers").rstrip() + "," + PROJ + """
  SELECT chat_id, round(scale, 4) AS scale, round(offx, 4) AS offset_x, round(offy, 4) AS offset_y, round(vx0, 6) AS vx0, round(vx1, 6) AS vx1, round(vy0, 6) AS vy0, round(vy1, 6) AS vy1 FROM vis""")
def frame_projectors(t: Tables):
    p = chat_projectors(t)
    names = {"offset_x": "offset_x", "offset_y": "offset_y"}
    return p.select(
        "chat_id", F.round("scale", 4).alias("scale"), *[F.round(c, 4).alias(n) for c, n in names.items()],
        F.round("visible_min_x", 6).alias("vx0"), F.round("visible_max_x", 6).alias("vx1"), F.round("visible_min_y", 6).alias("vy0"), F.round("visible_max_y", 6).alias("vy1"),
    )


PIXELS = PROJ + """,
  pix AS (SELECT v.chat_id, v.layer_id, v.feature_id, offx + ((x + 180) / 360 - ox) * scale AS px, offy + ((1 - ln(tan(radians(y)) + 1 / cos(radians(y))) / pi()) / 2 - oy) * scale AS py
          FROM verts v JOIN prj USING (chat_id))"""


@query(with_tables("layers").rstrip() + "," + PIXELS + """
  SELECT layer_id, feature_id, round(greatest(max(px) - min(px), max(py) - min(py)), 4) AS size, round(avg(px), 4) AS center_x, round(avg(py), 4) AS center_y,
         greatest(max(px) - min(px), max(py) - min(py)) < 20 AS marker FROM pix GROUP BY layer_id, feature_id""")
def feature_pixel_extents(t: Tables):
    px = export.to_pixels(feature_vertices(t), chat_projectors(t), "chat_id")
    e = export.pixel_extents(px, "layer_id", "feature_id")
    return e.select("layer_id", "feature_id", *[F.round(c, 4).alias(c) for c in ("size", "center_x", "center_y")], "marker")


@query(with_tables("layers").rstrip() + "," + PIXELS + " SELECT layer_id, round(avg(px), 4) AS x, round(avg(py), 4) AS y FROM pix GROUP BY layer_id")
def layer_centroids(t: Tables):
    px = export.to_pixels(feature_vertices(t), chat_projectors(t), "chat_id")
    return px.groupBy("layer_id").agg(F.round(F.avg("px"), 4).alias("x"), F.round(F.avg("py"), 4).alias("y"))


_TY = "floor((1 - ln(tan(radians({0})) + 1 / cos(radians({0}))) / pi()) / 2 * (1 << z))::BIGINT"
_TX = "floor(({0} + 180) / 360 * (1 << z))::BIGINT"
ZOOM = PROJ + f""",
  zs AS (SELECT chat_id, vx0, vx1, vy0, vy1, unnest(range(1, 16)) AS z FROM vis),
  zc AS (SELECT *, {_TX.format('vx0')} AS tx0, {_TX.format('vx1')} AS tx1, {_TY.format('vy1')} AS ty0, {_TY.format('vy0')} AS ty1 FROM zs),
  zoom AS (SELECT chat_id, coalesce(max(z) FILTER ((tx1 - tx0 + 1) * (ty1 - ty0 + 1) BETWEEN 1 AND 100), 3) AS zoom FROM zc GROUP BY chat_id),
  span AS (SELECT zc.* FROM zc JOIN zoom ON zc.chat_id = zoom.chat_id AND zc.z = zoom.zoom)"""


@query(with_tables("layers").rstrip() + "," + ZOOM + " SELECT chat_id, zoom::INTEGER AS zoom FROM zoom")
def tile_zooms(t: Tables):
    vb = [F.col(c) for c in ("visible_min_x", "visible_min_y", "visible_max_x", "visible_max_y")]
    return chat_projectors(t).select("chat_id", geo.tile_zoom(*vb).alias("zoom"))


@query(with_tables("layers").rstrip() + "," + ZOOM + """,
  cx AS (SELECT *, unnest(range(tx0 - 1, tx1 + 2)) AS tx FROM span), cells AS (SELECT *, unnest(range(greatest(ty0 - 1, 0), least(ty1 + 1, (1 << z) - 1) + 1)) AS ty FROM cx)
  SELECT chat_id, ((tx % (1 << z) + (1 << z)) % (1 << z))::BIGINT AS x, ty::BIGINT AS y,
    'https://tiles.example/' || z || '/' || ((tx % (1 << z) + (1 << z)) % (1 << z)) || '/' || ty || '.png' AS url FROM cells""")
def tile_cover(t: Tables):
    return export.tile_cover(chat_projectors(t), "chat_id", "https://tiles.example/{z}/{x}/{y}.png").select("chat_id", "x", "y", "url")


@query(with_tables("sites") + "SELECT site_id, name, strftime(TIMESTAMP '1985-01-01' + site_id * INTERVAL 1 DAY, '%Y-%m-%d') AS vernedato, round(lon, 6) AS lon, round(lat, 6) AS lat FROM sites")
def site_listing(t: Tables):
    """All sites with an ISO date and their position converted from metres to degrees."""
    stored = geometry.project_points(t.sites)
    back = F.element_at(geo.unproject_vertices(F.array(geo.point(F.col("x"), F.col("y")))), 1)
    date = F.date_format(F.timestamp_seconds(F.lit(473385600) + F.col("site_id") * 86400), "yyyy-MM-dd")
    return stored.withColumn("p", back).select("site_id", "name", date.alias("vernedato"), F.round("p.x", 6).alias("lon"), F.round("p.y", 6).alias("lat"))
