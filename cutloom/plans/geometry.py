"""Ring and shape queries over ``embeddings`` (32-point rings) and ``part`` (rectangles)."""

from pyspark.sql import functions as F

from cutloom.operators import claims as C
from cutloom.operators import geometry as G
from cutloom.operators import raster as R
from cutloom.sources import adapters as A
from cutloom.sources import geojson as J

r6 = lambda c: F.round(c, 6) + 0.0


def _measures(s, d):
    ring = F.col("ring")
    box, mid = G.bounding_box(ring), G.centroid(ring)
    m = A.rings(s, d).select("shape_id", "ring", G.ring_area(ring).alias("area"), G.ring_perimeter(ring).alias("perimeter"), box.alias("box"), mid.alias("mid"))
    far = F.abs(F.col("area")) < 0.001  # the centroid of a thin ring is ill-conditioned
    return m.select("shape_id", r6("area").alias("area"), r6("perimeter").alias("perimeter"), *[r6(f"box.{c}").alias(c) for c in ("x0", "y0", "x1", "y1")], *[F.when(far, 0.0).otherwise(F.round(f"mid.{c}", 4) + 0.0).alias(f"mid_{c}") for c in "xy"])


def _areas(s, d):
    return A.rings(s, d).select("shape_id", "label", r6(G.ring_area(F.col("ring"))).alias("area"))


def _validated(s, d):
    """Rings whole, of two points, with an infinite x, with a y that is no number, and with a null point."""
    odd = lambda x, y: F.concat("ring", F.array(F.struct(F.lit(x).cast("double").alias("x"), F.lit(y).cast("double").alias("y"))))
    kind = F.col("shape_id") % 6
    ring = F.when(kind == 0, F.slice("ring", 1, 2)).when(kind == 1, odd("infinity", 0)).when(kind == 2, odd(0, "NaN")).when(kind == 3, odd(None, None)).when(kind == 4, odd("-infinity", 0)).otherwise(F.col("ring"))
    return A.rings(s, d).withColumn("ring", ring).select("shape_id", F.size(G.valid_ring(F.col("ring"))).alias("points"))


def _stars(s, d):
    """Each vector as a star of 32 points round one of nine centres of its label's image, at a size that its id gives: many lie in each other."""
    e = A.read(s, d, "embeddings")
    k = F.col("vec_id")
    size, cx, cy = (1 + k * 7919 % 61).cast("double"), (k % 3 * 90).cast("double"), (F.floor(k / 3) % 3 * 90).cast("double")
    step = lambda i: F.lit(2 * 3.141592653589793 / 32) * i
    r = lambda i: F.col("size") * (1 + F.get("embedding", i).cast("double") * 0.5)
    ring = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.struct((F.col("cx") + r(i) * F.cos(step(i))).alias("x"), (F.col("cy") + r(i) * F.sin(step(i))).alias("y")))
    return e.withColumns({"size": size, "cx": cx, "cy": cy}).select(F.col("label").alias("image_id"), F.col("vec_id").alias("shape_id"), ring.alias("ring"))


QUERIES = {
    "holes_contained_rings": lambda s, d: C.contained_rings(_stars(s, d)).fillna(-1, ["owner_id"]),
    "ring_measures": _measures,
    "ring_decimate": lambda s, d: G.points_of(A.rings(s, d).withColumn("ring", G.decimate(F.col("ring"), 3))),
    "ring_smooth": lambda s, d: G.points_of(A.rings(s, d).withColumn("ring", G.smooth(F.col("ring"), 3))),
    "ring_chaikin": lambda s, d: G.points_of(G.chaikin_rounds(A.rings(s, d), "ring", 1)),
    "ring_round": lambda s, d: G.points_of(A.rings(s, d).withColumn("ring", G.round_ring(F.col("ring")))),
    "ring_validate": _validated,
    "min_area_filter": lambda s, d: G.over_area(A.rings(s, d), "ring", 0.1, 6).select("shape_id", r6(G.ring_area(F.col("ring"))).alias("area")),
    "largest_feature": lambda s, d: G.largest_by(_areas(s, d), "label"),
    "features_by_area": lambda s, d: J.features_by_area(_areas(s, d), 0.02, 0.2).select("shape_id", "area"),
    "features_topk": lambda s, d: G.top_features(_areas(s, d), 20).select("shape_id", "area"),
    "holes_containment": lambda s, d: G.contained_boxes(A.boxes(s, d)).fillna(-1, ["owner_id"]),
    "holes_area_ratio": lambda s, d: C.area_ratio_holes(A.boxes(s, d)).fillna(-1, ["owner_id"]),
    "ring_douglas_peucker": lambda s, d: G.points_of(G.map_rings(A.rings(s, d), lambda p: G.douglas_peucker(p, 0.1))),
    "ring_visvalingam": lambda s, d: G.points_of(G.map_rings(A.rings(s, d), lambda p: G.visvalingam(p, 0.005))),
    "ring_hull": lambda s, d: G.points_of(G.map_rings(A.rings(s, d), G.convex_hull)),
    "contours": lambda s, d: G.image_contours(A.rasters(s, d)).select("image_id", "contour", F.size("ring").alias("points"), r6(G.ring_area(F.col("ring"))).alias("area")),
    "features_smoothed_outline": lambda s, d: G.points_of(G.map_rings(G.chaikin_rounds(A.rings(s, d), "ring", 2), lambda p: G.douglas_peucker(p, 0.05))),
    "contours_blurred": lambda s, d: G.image_contours(R.gaussian_blur(A.rasters(s, d), 1)).groupBy("image_id").agg(F.count("*").alias("n"), F.sum(F.size("ring")).alias("points")),
}

NEXT = f"""{A.RINGS}, e AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny, first_value(x) OVER w AS fx, first_value(y) OVER w AS fy FROM pts WINDOW w AS (PARTITION BY shape_id ORDER BY k)),
c AS (SELECT *, coalesce(nx, fx) AS ax, coalesce(ny, fy) AS ay, x * coalesce(ny, fy) - coalesce(nx, fx) * y AS cr FROM e),
m AS (SELECT shape_id, label, sum(cr) / 2 AS sa, sum(sqrt((nx - x) ** 2 + (ny - y) ** 2)) AS per, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, sum((x + ax) * cr) AS sx, sum((y + ay) * cr) AS sy FROM c GROUP BY ALL),
areas AS (SELECT shape_id, label, round(abs(sa), 6) + 0.0 AS area FROM m)"""
XY = "round({0}, 5) + 0.0 AS x, round({1}, 5) + 0.0 AS y"

ORACLE = {
    "ring_measures": f"""WITH {NEXT} SELECT shape_id, round(abs(sa), 6) + 0.0 AS area, round(per, 6) + 0.0 AS perimeter, round(x0, 6) + 0.0 AS x0, round(y0, 6) + 0.0 AS y0, round(x1, 6) + 0.0 AS x1, round(y1, 6) + 0.0 AS y1,
  CASE WHEN abs(sa) < 0.001 THEN 0.0 ELSE round(sx / (6 * sa), 4) + 0.0 END AS mid_x, CASE WHEN abs(sa) < 0.001 THEN 0.0 ELSE round(sy / (6 * sa), 4) + 0.0 END AS mid_y FROM m""",
    "ring_decimate": f"WITH {A.RINGS} SELECT shape_id, CAST(k // 3 AS INTEGER) AS k, {XY.format('x', 'y')} FROM pts WHERE k % 3 = 0",
    "ring_smooth": f"WITH {A.RINGS} SELECT a.shape_id, CAST(a.k AS INTEGER) AS k, {XY.format('sum(b.x) / 3', 'sum(b.y) / 3')} FROM pts a JOIN pts b ON a.shape_id = b.shape_id AND b.k IN ((a.k + 31) % 32, a.k, (a.k + 1) % 32) GROUP BY ALL",
    "ring_chaikin": f"""WITH {NEXT}, cut AS (SELECT shape_id, 2 * k + 1 AS k, x * 0.75 + nx * 0.25 AS cx, y * 0.75 + ny * 0.25 AS cy FROM c WHERE nx IS NOT NULL UNION ALL SELECT shape_id, 2 * k + 2, x * 0.25 + nx * 0.75, y * 0.25 + ny * 0.75 FROM c WHERE nx IS NOT NULL
  UNION ALL SELECT shape_id, 0, x, y FROM c WHERE k = 0 UNION ALL SELECT shape_id, 63, x, y FROM c WHERE k = 31) SELECT shape_id, CAST(k AS INTEGER) AS k, {XY.format('cx', 'cy')} FROM cut""",
    "ring_round": f"WITH {A.RINGS} SELECT shape_id, CAST(k AS INTEGER) AS k, {XY.format('sign(x) * floor(abs(x) * 1000.0::DOUBLE + 0.5::DOUBLE) / 1000.0::DOUBLE', 'sign(y) * floor(abs(y) * 1000.0::DOUBLE + 0.5::DOUBLE) / 1000.0::DOUBLE')} FROM pts",
    "ring_validate": "SELECT vec_id AS shape_id, CASE WHEN vec_id % 6 = 5 THEN 32 ELSE 0 END AS points FROM embeddings",
    "min_area_filter": f"WITH {NEXT} SELECT shape_id, area FROM areas WHERE area >= 0.1",
    "largest_feature": f"WITH {NEXT} SELECT label, shape_id, area FROM areas QUALIFY row_number() OVER (PARTITION BY label ORDER BY area DESC, shape_id DESC) = 1",
    "features_by_area": f"WITH {NEXT} SELECT shape_id, area FROM areas WHERE area BETWEEN 0.02 AND 0.2",
    "features_topk": f"WITH {NEXT} SELECT shape_id, area FROM areas ORDER BY area DESC, shape_id LIMIT 20",
    "holes_containment": f"""WITH {A.BOXES}, sized AS (SELECT *, (x1 - x0) * (y1 - y0) AS area FROM boxes), own AS (
  SELECT i.image_id, i.shape_id, arg_max(o.shape_id, (o.area, -o.shape_id)) AS owner_id FROM sized i JOIN sized o ON i.image_id = o.image_id AND o.x0 < i.x0 AND o.y0 < i.y0 AND o.x1 > i.x1 AND o.y1 > i.y1 GROUP BY ALL)
SELECT s.image_id, s.shape_id, s.area, coalesce(own.owner_id, -1) AS owner_id FROM sized s LEFT JOIN own USING (image_id, shape_id)""",
}


# Simplification as recursive queries over lists of a ring's x and y.
LISTS = """rl AS (SELECT vec_id AS shape_id, label, list_transform(range(32), lambda k: CAST(embedding[2 * k + 1] AS DOUBLE)) AS xs, list_transform(range(32), lambda k: CAST(embedding[2 * k + 2] AS DOUBLE)) AS ys FROM embeddings)"""


def visvalingam_sql(tolerance: float, source: str = "rl") -> str:
    """vw: source with the xs and ys that are left; a round takes the point of least area from each ring whose least is under tolerance."""
    area = "abs((xs[i] - xs[i - 1]) * (ys[i + 1] - ys[i - 1]) - (xs[i + 1] - xs[i - 1]) * (ys[i] - ys[i - 1])) / 2"
    return f"""step AS (SELECT shape_id, xs, ys FROM {source} UNION ALL
  SELECT shape_id, list_concat(xs[:p - 1], xs[p + 1:]), list_concat(ys[:p - 1], ys[p + 1:]) FROM (SELECT *, list_position(a, list_min(a)) + 1 AS p FROM (
    SELECT *, list_transform(range(2, len(xs)), lambda i: {area}) AS a FROM step)) WHERE list_min(a) < {tolerance}),
vw AS (SELECT shape_id, arg_min(xs, len(xs)) AS xs, arg_min(ys, len(ys)) AS ys FROM step GROUP BY shape_id)"""


def douglas_peucker_sql(tolerance: float, source: str = "rl") -> str:
    """dp: the points that stay, as (shape_id, k, x, y); a round cuts each stretch at its farthest point if that is over tolerance away."""
    away = "CASE WHEN len_ = 0 THEN sqrt((xs[i] - xs[a]) ** 2 + (ys[i] - ys[a]) ** 2) ELSE abs((xs[b] - xs[a]) * (ys[i] - ys[a]) - (ys[b] - ys[a]) * (xs[i] - xs[a])) / len_ END"
    return f"""cut AS (SELECT shape_id, xs, ys, CAST(1 AS BIGINT) AS a, CAST(len(xs) AS BIGINT) AS b FROM {source} UNION ALL
  SELECT shape_id, xs, ys, unnest([a, m]) AS a, unnest([m, b]) AS b FROM (SELECT *, a + list_position(d, list_max(d)) AS m FROM (
    SELECT *, list_transform(range(a + 1, b), lambda i: {away}) AS d FROM (SELECT *, sqrt((xs[b] - xs[a]) ** 2 + (ys[b] - ys[a]) ** 2) AS len_ FROM cut))) WHERE list_max(d) > {tolerance}),
kept AS (SELECT DISTINCT shape_id, xs[nth] AS x, ys[nth] AS y, nth FROM (SELECT shape_id, xs, ys, unnest([a, b]) AS nth FROM cut)),
dp AS (SELECT shape_id, CAST(row_number() OVER (PARTITION BY shape_id ORDER BY nth) - 1 AS INTEGER) AS k, x, y FROM kept)"""


def _cut_corners(values: str) -> str:
    return f"list_concat([{values}[1]], flatten(list_transform(range(1, len({values})), lambda i: [{values}[i] * 0.75 + {values}[i + 1] * 0.25, {values}[i] * 0.25 + {values}[i + 1] * 0.75])), [{values}[-1]])"


_TURNS = """image AS (SELECT image_id, list(shape_id ORDER BY k) AS ids, list(held ORDER BY k) AS held, count(*) AS n FROM kids GROUP BY image_id),
turn AS (SELECT image_id, CAST(1 AS BIGINT) AS k, list_transform(ids, lambda v: CAST(0 AS BIGINT)) AS own FROM image UNION ALL
  SELECT t.image_id, t.k + 1, list_transform(own, lambda v, j: CASE WHEN v = 0 AND own[t.k] = 0 AND list_contains(held[t.k], j) THEN t.k ELSE v END) FROM turn t JOIN image USING (image_id) WHERE t.k <= n),
done AS (SELECT t.image_id, ids, own, unnest(range(1, n + 1)) AS j FROM turn t JOIN image USING (image_id) WHERE t.k = n + 1)
SELECT image_id, ids[j] AS shape_id, CASE WHEN own[j] > 0 THEN ids[own[j]] ELSE -1 END AS owner_id FROM done"""

ORACLE |= {
    "ring_visvalingam": f"WITH RECURSIVE {LISTS}, {visvalingam_sql(0.005)} SELECT shape_id, CAST(i - 1 AS INTEGER) AS k, {XY.format('xs[i]', 'ys[i]')} FROM (SELECT *, unnest(range(1, len(xs) + 1)) AS i FROM vw)",
    "ring_douglas_peucker": f"WITH RECURSIVE {LISTS}, {douglas_peucker_sql(0.1)} SELECT shape_id, k, {XY.format('x', 'y')} FROM dp",
    "features_smoothed_outline": f"""WITH RECURSIVE {LISTS}, c1 AS (SELECT shape_id, {_cut_corners('xs')} AS xs, {_cut_corners('ys')} AS ys FROM rl), c2 AS (SELECT shape_id, {_cut_corners('xs')} AS xs, {_cut_corners('ys')} AS ys FROM c1),
{douglas_peucker_sql(0.05, 'c2')} SELECT shape_id, k, {XY.format('x', 'y')} FROM dp""",
    # An edge is on the hull if no point lies to its right; those to the right (lower chain) come first, by their start, then those back.
    "ring_hull": f"""WITH {A.RINGS}, p AS (SELECT DISTINCT shape_id, x, y FROM pts),
out_ AS (SELECT a.shape_id, a.x, a.y, b.x AS bx, b.y AS by_ FROM p a JOIN p b ON a.shape_id = b.shape_id AND (a.x, a.y) <> (b.x, b.y) WHERE NOT EXISTS (SELECT 1 FROM p c WHERE c.shape_id = a.shape_id AND (b.x - a.x) * (c.y - a.y) < (b.y - a.y) * (c.x - a.x))),
edge AS (SELECT *, (bx, by_) > (x, y) AS lower FROM out_),
walk AS (SELECT shape_id, x, y, row_number() OVER (PARTITION BY shape_id ORDER BY lower DESC, CASE WHEN lower THEN x ELSE -x END, CASE WHEN lower THEN y ELSE -y END) - 1 AS k FROM edge),
closed AS (SELECT * FROM walk UNION ALL SELECT shape_id, arg_min(x, k), arg_min(y, k), max(k) + 1 FROM walk GROUP BY shape_id)
SELECT shape_id, CAST(k AS INTEGER) AS k, {XY.format('x', 'y')} FROM closed""",
    # A point lies in a ring if a ray to the right crosses it an odd number of times (none lies on a border here).
    "holes_contained_rings": f"""WITH RECURSIVE star AS MATERIALIZED (SELECT label AS image_id, vec_id AS shape_id, k, vec_id % 3 * 90 + (1 + vec_id * 7919 % 61) * (1 + CAST(embedding[k + 1] AS DOUBLE) * 0.5) * cos(2 * pi() / 32 * k) AS x,
  vec_id // 3 % 3 * 90 + (1 + vec_id * 7919 % 61) * (1 + CAST(embedding[k + 1] AS DOUBLE) * 0.5) * sin(2 * pi() / 32 * k) AS y FROM embeddings, range(32) r(k)),
edge AS MATERIALIZED (SELECT a.image_id, a.shape_id, a.k, a.x, a.y, b.x AS bx, b.y AS by_ FROM star a JOIN star b ON a.shape_id = b.shape_id AND b.k = (a.k + 1) % 32),
box AS MATERIALIZED (SELECT image_id, shape_id, abs(sum(x * by_ - bx * y)) / 2 AS area, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM edge GROUP BY ALL),
cand AS MATERIALIZED (SELECT o.image_id, o.shape_id AS h, i.shape_id AS c FROM box o JOIN box i ON o.image_id = i.image_id AND o.shape_id <> i.shape_id AND o.x0 <= i.x0 AND o.x1 >= i.x1 AND o.y0 <= i.y0 AND o.y1 >= i.y1 AND (o.area, -o.shape_id) > (i.area, -i.shape_id)),
hit AS MATERIALIZED (SELECT cand.image_id, h, c, p.k, count(*) FILTER (((e.y > p.y) <> (e.by_ > p.y)) AND p.x < e.x + (p.y - e.y) * (e.bx - e.x) / (e.by_ - e.y)) % 2 = 1 AS within FROM cand JOIN star p ON p.shape_id = c JOIN edge e ON e.shape_id = h GROUP BY ALL),
kept AS MATERIALIZED (SELECT image_id, h, c FROM hit GROUP BY ALL HAVING bool_and(within)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY area DESC, shape_id) AS k FROM box),
kids AS (SELECT o.image_id, o.k, o.shape_id, coalesce(list(i.k) FILTER (i.k IS NOT NULL), []) AS held FROM ranked o LEFT JOIN kept ON kept.h = o.shape_id LEFT JOIN ranked i ON i.shape_id = kept.c GROUP BY ALL),
{_TURNS}""",
    # One round a rank: the shape there, if nobody has claimed it, claims those of its list that are free.
    "holes_area_ratio": f"""WITH RECURSIVE {A.BOXES}, ranked AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY area DESC, shape_id) AS k FROM (SELECT *, (x1 - x0) * (y1 - y0) AS area FROM boxes)),
kids AS (SELECT o.image_id, o.k, o.shape_id, coalesce(list(i.k) FILTER (i.k IS NOT NULL), []) AS held FROM ranked o LEFT JOIN ranked i
  ON i.image_id = o.image_id AND i.k > o.k AND o.x0 < i.x0 AND o.y0 < i.y0 AND o.x1 > i.x1 AND o.y1 > i.y1 AND CAST(i.area AS DOUBLE) / o.area BETWEEN 0.01 AND 0.8 GROUP BY ALL),
{_TURNS}""",
}
