"""GeoJSON text to geometry structs and back."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fjelldoc.functions.geo import POINT

#: Levels of collections inside collections that column functions flatten; deeper ones are null with an error, or walked on demand.
DEPTH = 4

PARTS = f"array<array<array<{POINT}>>>"


def _json(g: Column, path: str) -> Column:
    return F.get_json_object(g, path)


def _points(pairs: Column) -> Column:
    return F.transform(pairs, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))


def _simple_parts(g: Column) -> Column:
    """Polygon -> ring -> vertex nesting for the six plain types; lines and points use one ring."""
    kind, c = _json(g, "$.type"), _json(g, "$.coordinates")
    pairs = _points(F.from_json(c, "array<array<double>>"))
    nested = F.transform(F.from_json(c, "array<array<array<double>>>"), _points)
    deep = F.transform(F.from_json(c, "array<array<array<array<double>>>>"), lambda poly: F.transform(poly, _points))
    return (
        F.when(kind == "Point", F.array(F.array(_points(F.array(F.from_json(c, "array<double>"))))))
        .when(kind == "LineString", F.array(F.array(pairs)))
        .when(kind == "MultiPoint", F.transform(pairs, lambda p: F.array(F.array(p))))
        .when(kind == "Polygon", F.array(nested))
        .when(kind == "MultiLineString", F.transform(nested, lambda line: F.array(line)))
        .when(kind == "MultiPolygon", deep)
    )


def _flattened(g: Column, kind: str, field: str, deep: bool = False) -> Column:
    """The members of a collection; the value itself if it is none.

    A collection of more than DEPTH levels is null, or with `deep` walked in Arrow batches like any other.
    """

    def members(v: Column) -> Column:
        listed = F.from_json(_json(v, f"$.{field}"), "array<string>")
        return F.when(_json(v, "$.type") == kind, F.coalesce(listed, F.array().cast("array<string>"))).otherwise(F.array(v))

    out = members(g)
    for _ in range(DEPTH - 1):
        out = F.flatten(F.transform(out, members))
    deeper = F.exists(out, lambda v: F.coalesce(_json(v, "$.type") == kind, F.lit(False)))
    return F.when(~deeper, out).otherwise(_walked(F.when(deeper, g), F.lit(kind), F.lit(field)) if deep else None)


@F.arrow_udf(T.ArrayType(T.StringType()))
def _walked(values, kinds, fields):
    """All members of a collection of any depth in order, as text; rows that the column functions have done come as null."""
    import pyarrow as pa

    out = []
    for text, kind, field in zip(values.to_pylist(), kinds.to_pylist(), fields.to_pylist(), strict=True):
        if text is None:
            out.append(None)
            continue
        flat, waiting = [], [json.loads(text)]
        while waiting:
            value = waiting.pop()
            if isinstance(value, dict) and value.get("type") == kind:
                waiting += reversed(value.get(field) or [])
            else:
                flat.append(json.dumps(value, ensure_ascii=False, separators=(",", ":")))
        out.append(flat)
    return pa.array(out, pa.list_(pa.string()))


def depth_error(g: Column) -> Column:
    """An error text for values whose collections are nested too deep for the column functions, else null."""
    lost = [(_json(g, "$.type") == kind) & _flattened(g, kind, field).isNull() for kind, field in (("FeatureCollection", "features"), ("GeometryCollection", "geometries"))]
    return F.when(lost[0] | lost[1], F.lit(f"collections nested deeper than {DEPTH} levels"))


def parts(g: Column, deep: bool = False) -> Column:
    """Parts of any GeoJSON geometry, collections flattened."""
    nested = F.flatten(F.transform(_flattened(g, "GeometryCollection", "geometries", deep), _simple_parts))
    return F.when(_json(g, "$.type") == "GeometryCollection", nested).otherwise(_simple_parts(g))


def geometry(g: Column, deep: bool = False) -> Column:
    return F.struct(_json(g, "$.type").alias("type"), parts(g, deep).alias("parts"))


def vertices(g: Column) -> Column:
    """Every coordinate pair of a geometry of any type and nesting, in text order."""
    source = F.coalesce(_json(g, "$.coordinates"), _json(g, "$.geometries"), g)
    innermost = F.regexp_extract_all(source, F.lit(r"\[\s*-?[0-9][-+0-9.eE,\s]*\]"), F.lit(0))
    return _points(F.from_json(F.concat(F.lit("["), F.array_join(innermost, ","), F.lit("]")), "array<array<double>>"))


#: How deep the coordinates of each type nest.
NESTING = {"Point": 1, "LineString": 2, "MultiPoint": 2, "Polygon": 3, "MultiLineString": 3, "MultiPolygon": 4}


def coordinates(g: Column) -> Column:
    """The nested coordinates of a geometry as text, numbers in their shortest form; null for a collection or what is no geometry."""
    kind, c = _json(g, "$.type"), _json(g, "$.coordinates")
    out = F.lit(None).cast("string")
    for depth in range(1, 5):
        nested = "array<" * depth + "double" + ">" * depth
        out = F.when(kind.isin(*[k for k, n in NESTING.items() if n == depth]), F.to_json(F.from_json(c, nested))).otherwise(out)
    return out


def features(g: Column, deep: bool = False) -> Column:
    """Features of any GeoJSON value: bare geometries are wrapped, collections flattened."""
    typed = F.filter(_flattened(g, "FeatureCollection", "features", deep), lambda f: _json(f, "$.type").isNotNull())
    wrapped = F.transform(
        typed,
        lambda f: F.when(_json(f, "$.type") == "Feature", f).otherwise(
            F.concat(F.lit('{"type":"Feature","properties":{},"geometry":'), f, F.lit("}"))
        ),
    )
    return F.when(_json(g, "$.type").isNotNull(), wrapped)


def merge_json(text: Column, extra: Column) -> Column:
    """Adds the fields of a JSON object text to another one."""
    base = F.coalesce(text, F.lit("{}"))
    comma = F.when(base.rlike(r"^\{\s*\}$"), "").otherwise(",")
    return F.concat(F.regexp_replace(base, r"\}$", ""), comma, F.substring(extra, 2, 1 << 30))


def feature_text(geometry_text: Column, properties: Column) -> Column:
    return F.concat(
        F.lit('{"type":"Feature","geometry":'), F.coalesce(geometry_text, F.lit("null")), F.lit(',"properties":'), properties, F.lit("}")
    )


def polygon_text(ring: Column) -> Column:
    """Polygon geometry text of one ring."""
    pairs = F.transform(ring, lambda v: F.array(v["x"], v["y"]))
    return F.concat(F.lit('{"type":"Polygon","coordinates":'), F.to_json(F.array(pairs)), F.lit("}"))
