"""Layer export: features, bounds, projector, tiles and GeoJSON or JSON output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fjelldoc.functions import geo, geojson


def exportable(layers: DataFrame) -> DataFrame:
    return layers.filter(F.col("geojson").isNotNull())


def layer_features(layers: DataFrame) -> DataFrame:
    """One row per feature with geometry, decorated with an id and the layer's export properties."""
    rows = exportable(layers).select("*", F.posexplode_outer(geojson.features(F.col("geojson"))).alias("feature_ix", "feature"))
    fields = rows.select(
        *layers.columns,
        "feature_ix",
        F.get_json_object("feature", "$.geometry").alias("geometry"),
        F.coalesce(
            F.get_json_object("feature", "$.id"), F.concat_ws("-", "layer_id", (F.col("feature_ix") + 1).cast("string"))
        ).alias("feature_id"),
        F.get_json_object("feature", "$.properties").alias("own_properties"),
    ).filter(F.col("geometry").isNotNull())
    export = F.to_json(
        F.struct(
            F.col("layer_id").alias("exportLayerId"),
            F.col("name").alias("exportLayerName"),
            F.col("shape").alias("exportLayerShape"),
            F.coalesce("visible", F.lit(True)).alias("exportLayerVisible"),
        )
    )
    return fields.withColumn("properties", geojson.merge_json(F.col("own_properties"), export)).drop("own_properties")


def feature_lines(features: DataFrame) -> DataFrame:
    """GeoJSON text of every feature, one per line: a collection of any size is written without gathering it."""
    return features.select(
        "chat_id", "layer_id", "feature_id",
        F.concat(
            F.lit('{"type":"Feature","id":'), F.to_json(F.struct(F.col("feature_id").alias("v"))).substr(F.lit(6), F.length("feature_id") + 2),
            F.lit(',"geometry":'), F.col("geometry"), F.lit(',"properties":'), F.col("properties"), F.lit("}"),
        ).alias("feature"),
    )


def rows_to_features(rows: DataFrame, geometry_column: str) -> DataFrame:
    """Feature text per row: the named column is the geometry, every other column a property."""
    others = [c for c in rows.columns if c != geometry_column]
    properties = F.to_json(F.struct(*others), {"ignoreNullFields": "false"})
    return rows.select(*others, geojson.feature_text(F.col(geometry_column), properties).alias("feature"))


def write_features(lines: DataFrame, path: str, column: str = "feature") -> None:
    """Line-delimited GeoJSON, written in parallel."""
    lines.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def read_features(spark, path: str) -> DataFrame:
    """Features of line-delimited GeoJSON files; each line may be a geometry, Feature or FeatureCollection."""
    lines = spark.read.text(path)
    rows = lines.select(F.posexplode_outer(geojson.features(F.col("value"))).alias("feature_ix", "feature"))
    return rows.select(
        "feature_ix",
        F.get_json_object("feature", "$.id").alias("feature_id"),
        geojson.geometry(F.get_json_object("feature", "$.geometry")).alias("geometry"),
        F.get_json_object("feature", "$.properties").alias("properties"),
    )


def layer_records(layers: DataFrame) -> DataFrame:
    """One JSON record per exportable layer with its feature count (GeoJSON of a layer is at most 5 MB)."""
    rows = exportable(layers)
    with_geometry = F.filter(geojson.features(F.col("geojson")), lambda f: F.get_json_object(f, "$.geometry").isNotNull())
    counted = rows.withColumn("feature_count", F.coalesce(F.size(with_geometry), F.lit(0)))
    meta = F.to_json(
        F.struct(
            F.col("layer_id").alias("id"), "name", "shape", F.coalesce("visible", F.lit(True)).alias("visible"), F.col("feature_count").alias("featureCount")
        )
    )
    record = F.concat(F.regexp_replace(meta, r"\}$", ""), F.lit(',"geoJson":'), F.col("geojson"), F.lit("}"))
    return counted.select("chat_id", "layer_id", "feature_count", record.alias("record"))


def export_totals(records: DataFrame) -> DataFrame:
    return records.groupBy("chat_id").agg(F.count("*").alias("layer_count"), F.sum("feature_count").alias("feature_count"))


def vertices(features: DataFrame, *keys: str) -> DataFrame:
    """One row per coordinate pair."""
    rows = features.select(*keys, F.explode_outer(geojson.vertices(F.col("geometry"))).alias("v")).filter("v IS NOT NULL")
    return rows.select(*keys, F.col("v.x").alias("x"), F.col("v.y").alias("y"))


def bounds(vertex_rows: DataFrame, *keys: str) -> DataFrame:
    """Extent per key with flat sides widened; no finite extent gives the default one."""
    raw = vertex_rows.groupBy(*keys).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    none = F.col("x0").isNull() | F.col("y0").isNull()

    def side(lo: str, hi: str, default_lo: float, default_hi: float) -> tuple[Column, Column]:
        pad = F.when(F.abs(F.col(hi) - F.col(lo)) < 1e-9, geo.FLAT_PADDING).otherwise(0.0)
        return (
            F.when(none, default_lo).otherwise(F.col(lo) - pad),
            F.when(none, default_hi).otherwise(F.col(hi) + pad),
        )

    d = geo.EMPTY_BOUNDS
    min_x, max_x = side("x0", "x1", d[0], d[2])
    min_y, max_y = side("y0", "y1", d[1], d[3])
    return raw.select(*keys, min_x.alias("min_x"), min_y.alias("min_y"), max_x.alias("max_x"), max_y.alias("max_y"))


def projector(bounds_rows: DataFrame, frame: dict = geo.FRAME, padding: float = geo.FRAME_PADDING) -> DataFrame:
    """Adds scale, offsets, padded origin and visible bounds of the letterboxed frame."""
    mx0, mx1 = geo.mercator_x(F.col("min_x")), geo.mercator_x(F.col("max_x"))
    my0, my1 = geo.mercator_y(F.col("max_y")), geo.mercator_y(F.col("min_y"))
    staged = bounds_rows.withColumns({"_mx0": mx0, "_mx1": mx1, "_my0": my0, "_my1": my1})
    span_x, span_y = F.col("_mx1") - F.col("_mx0"), F.col("_my1") - F.col("_my0")
    staged = staged.withColumns(
        {
            "origin_x": F.col("_mx0") - span_x * padding,
            "origin_y": F.col("_my0") - span_y * padding,
            "_sx": span_x * (1 + 2 * padding),
            "_sy": span_y * (1 + 2 * padding),
        }
    ).withColumn("scale", F.least(F.lit(frame["width"]) / F.col("_sx"), F.lit(frame["height"]) / F.col("_sy")))
    staged = staged.withColumns(
        {
            "offset_x": F.lit(frame["x"]) + (F.lit(frame["width"]) - F.col("_sx") * F.col("scale")) / 2,
            "offset_y": F.lit(frame["y"]) + (F.lit(frame["height"]) - F.col("_sy") * F.col("scale")) / 2,
        }
    )

    def back_x(px: float) -> Column:
        return geo.mercator_lon((F.lit(px) - F.col("offset_x")) / F.col("scale") + F.col("origin_x"))

    def back_y(py: float) -> Column:
        return geo.mercator_lat((F.lit(py) - F.col("offset_y")) / F.col("scale") + F.col("origin_y"))

    return staged.withColumns(
        {
            "visible_min_x": back_x(frame["x"]),
            "visible_max_x": back_x(frame["x"] + frame["width"]),
            "visible_max_y": back_y(frame["y"]),
            "visible_min_y": back_y(frame["y"] + frame["height"]),
        }
    ).drop("_mx0", "_mx1", "_my0", "_my1", "_sx", "_sy")


def to_pixels(vertex_rows: DataFrame, projectors: DataFrame, key: str) -> DataFrame:
    p = projectors.select(key, "scale", "offset_x", "offset_y", "origin_x", "origin_y")
    return vertex_rows.join(p, key).withColumns(
        {
            "px": F.col("offset_x") + (geo.mercator_x(F.col("x")) - F.col("origin_x")) * F.col("scale"),
            "py": F.col("offset_y") + (geo.mercator_y(F.col("y")) - F.col("origin_y")) * F.col("scale"),
        }
    )


def pixel_extents(pixels: DataFrame, *keys: str) -> DataFrame:
    """Longest side and vertex mean per feature; small ones are drawn as a marker."""
    side = F.greatest(F.max("px") - F.min("px"), F.max("py") - F.min("py"))
    rows = pixels.groupBy(*keys).agg(side.alias("size"), F.avg("px").alias("center_x"), F.avg("py").alias("center_y"))
    return rows.withColumn("marker", F.col("size") < geo.MIN_FEATURE_PIXELS)


def tile_cover(projectors: DataFrame, key: str, template: str) -> DataFrame:
    """Tiles of the visible bounds with one extra on every side; y clamped, x wrapped around."""
    vb = [F.col(c) for c in ("visible_min_x", "visible_min_y", "visible_max_x", "visible_max_y")]
    z = projectors.select(key, *vb, geo.tile_zoom(*vb).alias("zoom"))
    n = F.pow(F.lit(2.0), F.col("zoom")).cast("bigint")
    spans = z.select(
        key,
        "zoom",
        n.alias("n"),
        (geo.tile_x(vb[0], F.col("zoom")) - 1).alias("x0"),
        (geo.tile_x(vb[2], F.col("zoom")) + 1).alias("x1"),
        F.greatest(geo.tile_y(vb[3], F.col("zoom")) - 1, F.lit(0).cast("bigint")).alias("y0"),
        F.least(geo.tile_y(vb[1], F.col("zoom")) + 1, n - 1).alias("y1"),
    )
    rows = F.when(F.col("y0") <= F.col("y1"), F.sequence("y0", "y1"))
    cells = spans.select(key, "zoom", "n", F.explode_outer(F.sequence("x0", "x1")).alias("tx"), rows.alias("rows"))
    cells = cells.select(key, "zoom", F.pmod("tx", "n").alias("x"), "tx", F.explode_outer("rows").alias("y")).filter("y IS NOT NULL")
    url = F.lit(template)
    for mark, value in (("{z}", "zoom"), ("{x}", "x"), ("{y}", "y")):
        url = F.replace(url, F.lit(mark), F.col(value).cast("string"))
    return cells.withColumn("url", url)
