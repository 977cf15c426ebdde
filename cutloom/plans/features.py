"""Features of every type over ``embeddings``: a vector's 32 points as a point, points, a line, two lines, a polygon with a hole, or two polygons."""

from pyspark.sql import functions as F

from cutloom.operators import features as X
from cutloom.operators import geometry as G
from cutloom.plans.geometry import visvalingam_sql
from cutloom.sources import adapters as A

TYPES = ("Point", "MultiPoint", "LineString", "MultiLineString", "Polygon", "MultiPolygon")


def features(s, d):
    ring = F.col("ring")
    some = lambda a, n: F.slice(ring, a + 1, n)
    closed = lambda a, n: F.concat(some(a, n), some(a, 1))
    kind = F.element_at(F.array(*map(F.lit, TYPES)), (F.col("shape_id") % 6 + 1).cast("int"))
    k = F.col("shape_id") % 6
    parts = F.when(k == 0, F.array(F.array(some(0, 1)))).when(k <= 2, F.array(F.array(ring))).when(k == 3, F.array(F.array(some(0, 16), some(16, 16))))
    parts = parts.when(k == 4, F.array(F.array(closed(0, 24), closed(24, 8)))).otherwise(F.array(F.array(closed(0, 16)), F.array(closed(16, 16))))
    return A.rings(s, d).select(F.col("shape_id").alias("name"), X.geometry(kind, parts).alias("geometry"))


def _measures(s, d):
    g = F.col("geometry")
    m = features(s, d).select("name", g["type"].alias("type"), X.box(g).alias("b"), X.middle(g).alias("m"), F.round(X.geometry_area(g), 6).alias("area"), F.round(X.feature_area(g, X.box(g)), 6).alias("box_area"))
    return m.select("name", "type", *[F.round(f"b.{c}", 6).alias(c) for c in ("x0", "y0", "x1", "y1")], F.round("m.x", 6).alias("mid_x"), F.round("m.y", 6).alias("mid_y"), "area", "box_area")


def _long(df):
    g = df.select("name", F.col("geometry.type").alias("type"), F.posexplode("geometry.parts").alias("part", "p"))
    g = g.select("name", "type", "part", F.posexplode("p").alias("line", "l")).select("name", "type", "part", "line", F.posexplode("l").alias("k", "at"))
    return g.select("name", "type", "part", "line", "k", (F.round("at.x", 6) + 0.0).alias("x"), (F.round("at.y", 6) + 0.0).alias("y"))


def _kept(s, d):
    shown = A.read(s, d, "embeddings").filter("label % 2 = 0").select(F.col("vec_id").alias("name"))
    out = X.generalised(features(s, d), shown, 0.02, 0.02, 0.05)
    g = F.col("geometry")
    lines = F.flatten(g["parts"])
    return out.select("name", g["type"].alias("type"), F.size(g["parts"]).alias("parts"), F.size(lines).alias("lines"), F.size(X.points(g)).alias("points"), F.round("area", 6).alias("area"), (F.round(F.aggregate(X.points(g), F.lit(0.0), lambda a, p: a + p["x"] + p["y"]), 5) + 0.0).alias("total"))


QUERIES = {
    "feature_measures": _measures,
    "feature_rounding": lambda s, d: _long(features(s, d).withColumn("geometry", X.rounded(F.col("geometry")))),
    "feature_geojson": lambda s, d: _long(features(s, d).withColumn("geometry", X.from_geojson(X.to_geojson(F.col("geometry"))))),
    "feature_generalised": _kept,
}

FEATURES = f"""{A.RINGS}, put AS MATERIALIZED (
  SELECT shape_id AS name, label, k, x, y, shape_id % 6 AS kind, CASE WHEN shape_id % 6 = 5 THEN k // 16 ELSE 0 END AS part,
    CASE shape_id % 6 WHEN 3 THEN k // 16 WHEN 4 THEN CASE WHEN k < 24 THEN 0 ELSE 1 END ELSE 0 END AS line FROM pts WHERE shape_id % 6 > 0 OR k = 0
), shut AS MATERIALIZED (
  SELECT * EXCLUDE (nth), CAST(nth - 1 AS INTEGER) AS nth FROM (SELECT *, row_number() OVER (PARTITION BY name, part, line ORDER BY k) AS nth FROM put)
  UNION ALL SELECT name, label, NULL, arg_min(x, k), arg_min(y, k), kind, part, line, CAST(count(*) AS INTEGER) FROM put WHERE kind >= 4 GROUP BY name, label, kind, part, line
), named AS (SELECT *, {list(TYPES)!r}[kind + 1] AS type FROM shut
), area AS (SELECT name, part, line, abs(sum(x * ny - nx * y)) / 2 AS a FROM (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM shut WHERE kind >= 4 WINDOW w AS (PARTITION BY name, part, line ORDER BY nth)) GROUP BY ALL
), box AS (SELECT name, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM shut GROUP BY name)"""
_ROUND = "sign({0}) * floor(abs({0}) * 1000.0::DOUBLE + 0.5::DOUBLE) / 1000.0::DOUBLE"
_WHOLE = "CASE WHEN kind >= 2 THEN {r} ELSE {c} END"

ORACLE = {
    "feature_measures": f"""WITH {FEATURES} SELECT name, type, round(x0, 6) AS x0, round(y0, 6) AS y0, round(x1, 6) AS x1, round(y1, 6) AS y1, round((x0 + x1) / 2, 6) AS mid_x, round((y0 + y1) / 2, 6) AS mid_y,
  round(coalesce(a, 0.0), 6) AS area, round((x1 - x0) * (y1 - y0), 6) AS box_area
FROM (SELECT DISTINCT name, type FROM named) JOIN box USING (name) LEFT JOIN (SELECT name, sum(a) AS a FROM area WHERE line = 0 GROUP BY name) USING (name)""",
    "feature_rounding": f"WITH {FEATURES} SELECT name, type, CAST(part AS INTEGER) AS part, CAST(line AS INTEGER) AS line, nth AS k, round({_WHOLE.format(r=_ROUND.format('x'), c='x')}, 6) + 0.0 AS x, round({_WHOLE.format(r=_ROUND.format('y'), c='y')}, 6) + 0.0 AS y FROM named",
    "feature_geojson": f"WITH {FEATURES} SELECT name, type, CAST(part AS INTEGER) AS part, CAST(line AS INTEGER) AS line, nth AS k, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y FROM named",
    "feature_generalised": f"""WITH RECURSIVE {FEATURES}, shown AS (SELECT name, (x1 - x0) * (y1 - y0) AS area FROM box WHERE name IN (SELECT vec_id FROM embeddings WHERE label % 2 = 0) AND (x1 - x0) * (y1 - y0) >= 0.05),
worth AS (SELECT * FROM shut WHERE name IN (SELECT name FROM shown) AND kind >= 2 AND (kind < 4 OR line = 0 OR (name, part, line) IN (SELECT (name, part, line) FROM area WHERE a >= 0.02))),
listed AS MATERIALIZED (SELECT (name, part, line) AS shape_id, list(x ORDER BY nth) AS xs, list(y ORDER BY nth) AS ys FROM worth GROUP BY name, part, line), {visvalingam_sql(0.02, 'listed')},
lines AS MATERIALIZED (SELECT shape_id[1] AS name, shape_id[2] AS part, shape_id[3] AS line, xs, ys FROM vw WHERE len(xs) >= CASE WHEN shape_id[1] % 6 >= 4 THEN 4 ELSE 2 END),
stay AS (SELECT *, true AS r FROM lines l WHERE name % 6 < 4 OR EXISTS (SELECT 1 FROM lines e WHERE e.name = l.name AND e.part = l.part AND e.line = 0)
  UNION ALL SELECT name, part, line, list(x ORDER BY nth), list(y ORDER BY nth), false FROM shut WHERE kind < 2 AND name IN (SELECT name FROM shown) GROUP BY name, part, line)
SELECT name, {list(TYPES)!r}[name % 6 + 1] AS type, CAST(count(DISTINCT part) AS INTEGER) AS parts, CAST(count(*) AS INTEGER) AS lines, CAST(sum(len(xs)) AS INTEGER) AS points, round(any_value(area), 6) AS area,
  round(sum(list_sum(list_transform(list_concat(xs, ys), lambda v: CASE WHEN r THEN {_ROUND.format('v')} ELSE v END))), 5) + 0.0 AS total FROM stay JOIN shown USING (name) GROUP BY name""",
}
