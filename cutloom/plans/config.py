"""Configuration, GeoJSON and region queries."""

from pyspark.sql import functions as F

from cutloom.operators import geometry as G
from cutloom.sources import adapters as A
from cutloom.sources import config as C
from cutloom.sources import geojson as J
from cutloom.sources import topojson as T

INCLUDED_REGIONS = ("AFRICA", "ASIA", "REGION_1", "REGION_3")


def _documents(s, d):
    """A configuration for each nation, a clip for each of its suppliers: splices with both ways to write a range, clips without an operation, defaults, and keys to be ignored."""
    k = F.col("s_suppkey")
    op = F.when(k % 4 == 0, F.format_string('{"type": "splice", "params": {"segments": [{"start": %1$d, "end": %1$d.5}, [%1$d, %1$d.25]]}}', k))
    op = op.when(k % 4 == 1, F.format_string('{"type": "sequentise", "params": {"period": [%1$d, %1$d.75], "format": "png"}}', k))
    op = op.when(k % 4 == 3, F.format_string('{"type": "sequentise", "params": {"period": {"start": %1$d, "end": %1$d.5}, "format": "png", "fps": 12.5, "quality": 5}}', k)).otherwise(F.lit("null"))
    clip = F.format_string('{"name": "clip %d", "description": "a clip", "start": 1, "extra": {"a": []}, "operation": %s}', k, op)
    listed = A.read(s, d, "supplier").groupBy("s_nationkey").agg(F.array_sort(F.collect_list(F.struct("s_suppkey", clip.alias("clip")))).alias("c"))
    return listed.select(F.format_string('{"path": "nation %d.mp4", "output_dir": "out", "clips": [%s]}', "s_nationkey", F.array_join(F.transform("c", lambda c: c["clip"]), ", ")).alias("json"))


def _clips(s, d):
    return _listed(C.clips_from_json(_documents(s, d)))


def _toml(s, d):
    """The same clips out as TOML and in again."""
    return _listed(C.clips_from_toml(C.clips_to_toml(C.clips_from_json(_documents(s, d)))))


def _listed(clips):
    rows = C.runnable(clips)
    spans = F.coalesce(F.col("segments"), F.array("period"))
    return rows.select("path", "clip_ord", "name", "op_type", F.posexplode(spans).alias("seg", "r"), F.coalesce("fps", F.lit(0.0)).alias("fps"), F.coalesce("quality", F.lit(0)).alias("quality")).select("path", "clip_ord", "name", "op_type", "seg", F.col("r.start").alias("start"), F.col("r.end").alias("stop"), "fps", "quality")


def _round_trip(s, d):
    """Rings out as GeoJSON and in again."""
    shapes = A.rings(s, d).select((F.col("shape_id") % 50).alias("image_id"), "shape_id", F.col("ring").alias("exterior"), F.array().cast(f"array<{G.RING}>").alias("holes"))
    docs = J.to_geojson(shapes, F.lit(8), F.lit(8))
    back = J.from_geojson(docs)
    return back.select("image_id", "shape", F.size("exterior").alias("points"), F.round(G.ring_area(F.col("exterior")), 6).alias("area"), F.size("holes").alias("holes"), "image_width")


def _ring_documents(s, d, write):
    shapes = A.rings(s, d).select((F.col("shape_id") % 50).alias("image_id"), "shape_id", F.col("ring").alias("exterior"), F.array().cast(f"array<{G.RING}>").alias("holes"))
    return write(shapes, F.lit(8), F.lit(6))


def _typed(s, d):
    """What a reader of the typed form finds in it: the dimensions and each feature's own values."""
    found = "struct<FeatureCollection:struct<features:array<struct<geometry:struct<type:string,coordinates:array<array<array<double>>>>,id:bigint,properties:struct<id:bigint,has_holes:boolean>>>,foreign_members:struct<image_width:int,image_height:int,shape_count:int>>>"
    doc = _ring_documents(s, d, J.to_typed_geojson).select("image_id", F.from_json("geojson", found)["FeatureCollection"].alias("d"))
    rows = doc.select("image_id", "d.foreign_members.*", F.explode("d.features").alias("f"))
    return rows.select("image_id", "image_width", "image_height", "shape_count", F.col("f.properties.id").alias("shape_id"), F.col("f.id").isNull().alias("bare"), F.size(F.col("f.geometry.coordinates")[0]).alias("points"), F.round(F.col("f.geometry.coordinates")[0][0][0], 6).alias("x"))


def _topology(s, d):
    """Two polygons a nation from two shared arcs, one of them within a multipolygon that also goes round it the other way."""
    k = F.col("n_nationkey")
    text = F.format_string('{"arcs": [[[%1$d, 0], [%1$d.5, 0], [%1$d.5, 2]], [[%1$d.5, 2], [%1$d, 2], [%1$d, 0]]], "objects": {"units": {"geometries": [{"type": "Polygon", "properties": {"name": "one %1$d"}, "arcs": [[0, 1]]}, {"type": "MultiPolygon", "properties": {"name": "two %1$d"}, "arcs": [[[0, 1]], [[-2, -1]]]}, {"type": "Point", "coordinates": [0, 0]}]}}}', k)
    found = T.features(A.read(s, d, "nation").select(text.alias("json")))
    return found.select("name", F.size("rings").alias("n_rings"), F.size(F.col("rings")[0]).alias("points"), G.ring_area(F.col("rings")[0]).alias("area"), F.col("rings")[0][1]["x"].alias("second_x"))


def _regions(s, d):
    n, r = A.read(s, d, "nation"), A.read(s, d, "region")
    return n.join(r.filter(F.col("r_name").isin(*INCLUDED_REGIONS)), n.n_regionkey == r.r_regionkey, "left_semi").select("n_nationkey", "n_name")


QUERIES = {
    "config_clips": _clips,
    "config_toml_round_trip": _toml,
    "geojson_round_trip": _round_trip,
    "geojson_metadata": lambda s, d: J.metadata(_ring_documents(s, d, J.to_geojson)),
    "geojson_typed": _typed,
    "topojson_features": _topology,
    "region_include": _regions,
}

_CLIPS = """WITH c AS (SELECT *, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS INTEGER) AS clip_ord, CAST(s_suppkey AS DOUBLE) AS k, s_suppkey % 4 AS kind FROM supplier),
spans AS (SELECT *, 0 AS seg, k + CASE kind WHEN 1 THEN 0.75 ELSE 0.5 END::DOUBLE AS stop FROM c WHERE kind <> 2 UNION ALL SELECT *, 1, k + 0.25::DOUBLE FROM c WHERE kind = 0)
SELECT 'nation ' || CAST(s_nationkey AS VARCHAR) || '.mp4' AS path, clip_ord, 'clip ' || CAST(s_suppkey AS VARCHAR) AS name, CASE kind WHEN 0 THEN 'splice' ELSE 'sequentise' END AS op_type, seg, k AS "start", stop,
  CASE kind WHEN 0 THEN 0.0 WHEN 1 THEN 25.0 ELSE 12.5 END::DOUBLE AS fps, CASE kind WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 5 END AS quality FROM spans"""
_AREA = "round(abs(sum(x * coalesce(ny, fy) - coalesce(nx, fx) * y)) / 2, 6)"
ORACLE = {
    "config_clips": _CLIPS,
    "config_toml_round_trip": _CLIPS,
    "geojson_metadata": "SELECT vec_id % 50 AS image_id, 8 AS image_width, 6 AS image_height, CAST(count(*) AS INTEGER) AS shape_count, CAST(count(*) AS INTEGER) AS n_features FROM embeddings GROUP BY ALL",
    "geojson_typed": "SELECT vec_id % 50 AS image_id, 8 AS image_width, 6 AS image_height, CAST(count(*) OVER (PARTITION BY vec_id % 50) AS INTEGER) AS shape_count, vec_id AS shape_id, true AS bare, 32 AS points, round(CAST(embedding[1] AS DOUBLE), 6) AS x FROM embeddings",
    "topojson_features": """SELECT kind || ' ' || CAST(n_nationkey AS VARCHAR) AS name, 1 AS n_rings, 5 AS points, 1.0::DOUBLE AS area, CASE WHEN back THEN CAST(n_nationkey AS DOUBLE) ELSE n_nationkey + 0.5::DOUBLE END AS second_x
FROM nation, (VALUES ('one', false), ('two', false), ('two', true)) v(kind, back)""",
    "geojson_round_trip": f"""WITH {A.RINGS}, e AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny, first_value(x) OVER w AS fx, first_value(y) OVER w AS fy FROM pts WINDOW w AS (PARTITION BY shape_id ORDER BY k)),
m AS (SELECT shape_id, {_AREA} AS area FROM e GROUP BY shape_id)
SELECT shape_id % 50 AS image_id, CAST(row_number() OVER (PARTITION BY shape_id % 50 ORDER BY shape_id) - 1 AS INTEGER) AS shape, 32 AS points, area, 0 AS holes, 8 AS image_width FROM m""",
    "region_include": f"SELECT n_nationkey, n_name FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name IN {INCLUDED_REGIONS!r})",
}
