"""Shapes to and from GeoJSON documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutloom.operators import geometry as G

COLLECTION = "struct<type:string,image_width:int,image_height:int,shape_count:int,features:array<struct<type:string,id:bigint,geometry:struct<type:string,coordinates:array<array<array<double>>>>,properties:struct<id:bigint,area:double,has_holes:boolean,hole_count:int,perimeter:double>>>>"


def _coordinates(ring: Column, close: bool) -> Column:
    pairs = F.transform(ring, lambda p: F.array(p["x"], p["y"]))
    return F.when(F.size(ring) > 0, F.concat(pairs, F.slice(pairs, 1, 1))).otherwise(pairs) if close else pairs


def to_geojson(shapes: DataFrame, width: Column, height: Column, close_rings: bool = False) -> DataFrame:
    """image_id, geojson: a FeatureCollection for each image from (image_id, shape_id, exterior, holes), features by shape_id.

    Rings go out as they are stored unless close_rings; an area that isn't finite is written as 0. An image's document is one row by definition.
    """
    area = G.shape_area(F.col("exterior"), F.col("holes"))
    finite = F.when(F.isnan(area) | (F.abs(area) == float("inf")), F.lit(0.0)).otherwise(area)
    rings = F.concat(F.array(_coordinates(F.col("exterior"), close_rings)), F.transform("holes", lambda h: _coordinates(h, close_rings)))
    props = F.struct(F.col("shape_id").alias("id"), finite.alias("area"), (F.size("holes") > 0).alias("has_holes"), F.size("holes").alias("hole_count"), G.shape_perimeter(F.col("exterior"), F.col("holes")).alias("perimeter"))
    feature = F.struct(F.lit("Feature").alias("type"), F.col("shape_id").alias("id"), F.struct(F.lit("Polygon").alias("type"), rings.alias("coordinates")).alias("geometry"), props.alias("properties"))
    per = shapes.select("image_id", "shape_id", feature.alias("f"), width.alias("w"), height.alias("h")).groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("shape_id", "f"))).alias("fs"), F.max("w").alias("w"), F.max("h").alias("h"))
    whole = F.struct(F.lit("FeatureCollection").alias("type"), F.col("w").alias("image_width"), F.col("h").alias("image_height"), F.size("fs").alias("shape_count"), F.transform("fs", lambda x: x["f"]).alias("features"))
    return per.select("image_id", F.to_json(whole).alias("geojson"))


def from_geojson(documents: DataFrame, json_col: str = "geojson") -> DataFrame:
    """Document columns with shape (its place), exterior, holes of every Polygon; error where width or height is missing.

    The first ring is the exterior. Features of other geometries are left out.
    """
    doc = documents.withColumn("doc", F.from_json(json_col, COLLECTION))
    lacking = F.col("doc").isNull() | F.col("doc.image_width").isNull() | F.col("doc.image_height").isNull()
    polygons = F.filter("doc.features", lambda f: f["geometry"]["type"] == "Polygon")
    rows = doc.withColumns({"error": F.when(lacking, F.lit("image_width and image_height are required")), "polygons": F.when(~lacking, polygons)})
    rows = rows.select(*[c for c in documents.columns if c != json_col], "error", F.col("doc.image_width").alias("image_width"), F.col("doc.image_height").alias("image_height"), F.posexplode_outer("polygons").alias("shape", "f"))
    ring = lambda r: F.transform(r, lambda p: F.struct(F.get(p, 0).alias("x"), F.get(p, 1).alias("y")))
    coords = F.col("f.geometry.coordinates")
    return rows.withColumns({"exterior": ring(F.get(coords, 0)), "holes": F.transform(F.slice(coords, 2, F.greatest(F.size(coords), F.lit(1))), ring)}).drop("f")


def to_typed_geojson(shapes: DataFrame, width: Column, height: Column) -> DataFrame:
    """image_id, geojson in the typed form: the collection tagged by its kind, features without id, dimensions nested in foreign_members."""
    doc = F.from_json("geojson", COLLECTION)
    bare = F.transform("d.features", lambda f: F.struct(F.lit(None).cast("string").alias("bbox"), f["geometry"].alias("geometry"), F.lit(None).cast("bigint").alias("id"), f["properties"].alias("properties")))
    members = F.struct(F.col("d.image_width").alias("image_width"), F.col("d.image_height").alias("image_height"), F.col("d.shape_count").alias("shape_count"))
    tagged = F.struct(F.struct(bare.alias("features"), members.alias("foreign_members")).alias("FeatureCollection"))
    return to_geojson(shapes, width, height).select("image_id", doc.alias("d")).select("image_id", F.to_json(tagged).alias("geojson"))


def metadata(documents: DataFrame, json_col: str = "geojson") -> DataFrame:
    """Document columns with image_width, image_height, shape_count and n_features."""
    doc = documents.withColumn("doc", F.from_json(json_col, COLLECTION))
    return doc.select(*[c for c in documents.columns if c != json_col], "doc.image_width", "doc.image_height", "doc.shape_count", F.size("doc.features").alias("n_features"))


def features_with_holes(properties: DataFrame) -> DataFrame:
    """Rows whose properties can't be read (null) are left out."""
    return properties.filter(F.coalesce("has_holes", F.lit(False)))


def features_by_area(properties: DataFrame, least: float, most: float) -> DataFrame:
    """Both ends included."""
    return properties.filter(F.col("area").between(least, most))
