"""Topologies over ``embeddings``: a vector's 32 points are a border of 12 that two polygons share, and an outer arc of 10 for each."""

from pyspark.sql import functions as F

from cutloom.operators import features as X
from cutloom.plans.geometry import visvalingam_sql
from cutloom.sources import adapters as A
from cutloom.sources import topology as T

TOLERANCE = 0.02


def documents(s, d):
    xy = F.transform("ring", lambda p: F.array(p["x"], p["y"]))
    some = lambda a, n: F.slice("xy", a + 1, n)
    arcs = F.to_json(F.array(some(0, 12), F.concat(some(11, 11), some(0, 1)), F.concat(some(0, 1), some(22, 10), some(11, 1))))
    units = '{"units":{"geometries":[{"type":"Polygon","properties":{"name":"left"},"arcs":[[0,1]]},{"type":"MultiPolygon","properties":{"name":"right"},"arcs":[[[-1,2]]]},{"type":"LineString","properties":{"name":"border"},"arcs":[0]}]}}'
    rows = A.rings(s, d).withColumn("xy", xy)
    return rows.select(F.col("shape_id").alias("doc_id"), F.concat(F.lit('{"type":"Topology","arcs":'), arcs, F.lit(f',"objects":{units}}}')).alias("json"))


def _generalised(s, d):
    out = T.generalised(documents(s, d), TOLERANCE)
    g = F.col("geometry")
    total = F.aggregate(X.points(g), F.lit(0.0), lambda a, p: a + p["x"] + 2 * p["y"])
    return out.select("doc_id", "name", g["type"].alias("type"), F.size(X.points(g)).alias("points"), (F.round(total, 5) + 0.0).alias("total"), F.round(X.geometry_area(g), 5).alias("area"))


def _shared(s, d):
    """Of each document, how many edges of the left polygon the right one has backwards: all of the border's, as simplified, and both outer arcs where each has become one and the same edge."""
    rings = T.generalised(documents(s, d), TOLERANCE).filter("name <> 'border'").select("doc_id", "name", X.points(F.col("geometry")).alias("p"))
    edges = rings.select("doc_id", "name", F.explode(F.transform(F.sequence(F.lit(0), F.size("p") - 2), lambda i: F.struct(F.get("p", i).alias("a"), F.get("p", i + 1).alias("b")))).alias("e")).select("doc_id", "name", "e.a", "e.b")
    left, right = edges.filter("name = 'left'").select("doc_id", "a", "b"), edges.filter("name = 'right'").select("doc_id", F.col("b").alias("a"), F.col("a").alias("b"))
    return left.join(right, ["doc_id", "a", "b"]).groupBy("doc_id").agg(F.count("*").alias("shared"))


QUERIES = {"topology_generalised": _generalised, "topology_shared_borders": _shared}

SIMPLE = f"""{A.RINGS}, arc AS (
  SELECT shape_id, 0 AS arc, k AS nth, x, y FROM pts WHERE k < 12 UNION ALL SELECT shape_id, 1, CASE k WHEN 0 THEN 99 ELSE k END, x, y FROM pts WHERE k BETWEEN 11 AND 21 OR k = 0
  UNION ALL SELECT shape_id, 2, CASE k WHEN 11 THEN 99 ELSE k END, x, y FROM pts WHERE k >= 22 OR k IN (0, 11)
), listed AS MATERIALIZED (SELECT (shape_id, arc) AS shape_id, list(x ORDER BY nth) AS xs, list(y ORDER BY nth) AS ys FROM arc GROUP BY shape_id, arc), {visvalingam_sql(TOLERANCE, 'listed')},
a AS MATERIALIZED (SELECT shape_id[1] AS doc_id, shape_id[2] AS arc, xs, ys FROM vw),
whole AS MATERIALIZED (SELECT b.doc_id, l.xs AS lx, l.ys AS ly, r.xs AS rx, r.ys AS ry, b.xs AS bx, b.ys AS by_ FROM a b JOIN a l ON l.doc_id = b.doc_id AND l.arc = 1 JOIN a r ON r.doc_id = b.doc_id AND r.arc = 2 WHERE b.arc = 0),
shape AS MATERIALIZED (SELECT doc_id, 'left' AS name, 'Polygon' AS type, list_concat(bx, lx[2:]) AS xs, list_concat(by_, ly[2:]) AS ys FROM whole
  UNION ALL SELECT doc_id, 'right', 'MultiPolygon', list_concat(list_reverse(bx), rx[2:]), list_concat(list_reverse(by_), ry[2:]) FROM whole UNION ALL SELECT doc_id, 'border', 'LineString', bx, by_ FROM whole)"""

ORACLE = {
    "topology_generalised": f"""WITH RECURSIVE {SIMPLE} SELECT doc_id, name, type, CAST(len(xs) AS INTEGER) AS points, round(list_sum(xs) + 2 * list_sum(ys), 5) + 0.0 AS total,
  round(CASE WHEN name = 'border' THEN 0.0 ELSE abs(list_sum(list_transform(range(1, len(xs) + 1), lambda i: xs[i] * ys[i % len(xs) + 1] - xs[i % len(xs) + 1] * ys[i]))) / 2 END, 5) AS area FROM shape""",
    "topology_shared_borders": f"""WITH RECURSIVE {SIMPLE}, edge AS (SELECT doc_id, name, xs[i] AS ax, ys[i] AS ay, xs[i + 1] AS bx, ys[i + 1] AS by_ FROM (SELECT *, unnest(range(1, len(xs))) AS i FROM shape WHERE name <> 'border'))
SELECT l.doc_id, count(*) AS shared FROM edge l JOIN edge r ON l.doc_id = r.doc_id AND l.name = 'left' AND r.name = 'right' AND l.ax = r.bx AND l.ay = r.by_ AND l.bx = r.ax AND l.by_ = r.ay GROUP BY l.doc_id""",
}
