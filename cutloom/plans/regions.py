"""Regions of images, in tiles of 4 x 4 so that most reach over tiles. The oracles flood-fill by recursion, pixel by pixel."""

from pyspark.sql import functions as F

from cutloom.operators import geometry as C
from cutloom.operators import raster as R
from cutloom.operators import regions as G
from cutloom.plans.raster import _conv, _kernel, _out
from cutloom.sources import adapters as A

TILE = 4
LEVEL, LOW, HIGH = 0.02, 0.08, 0.25

def _borders(s, d):
    """How many borders each image's pixels over LEVEL have, and how many pixels are on one."""
    rings = C.image_contours(A.rasters(s, d), LEVEL)
    points = rings.select("image_id", F.explode("ring").alias("p")).distinct().groupBy("image_id").agg(F.count("*").alias("pixels"))
    return rings.groupBy("image_id").agg(F.count("*").alias("borders")).join(points, "image_id")


QUERIES = {
    "contour_borders": _borders,
    "image_regions": lambda s, d: G.regions(A.rasters(s, d), LEVEL, size=TILE).select("image_id", "region", "area", "left", "top", "right", "bottom", F.round("most", 6).alias("most"), "touches"),
    "raster_fill_holes": lambda s, d: R.pixels_of(G.fill_holes(A.rasters(s, d), LEVEL, 1.0, TILE), None),
    "raster_without_small": lambda s, d: R.pixels_of(G.without_small(A.rasters(s, d), 4, LEVEL, TILE), None),
    "raster_canny": lambda s, d: R.pixels_of(G.canny(A.rasters(s, d), 1, LOW, HIGH, TILE), None),
}


def flood(source: str, on: str, diagonal: bool, tag: str = "") -> str:
    """reg: image_id, x, y, v, region (its least pixel's number) of the pixels of source for which ``on`` holds; stat: the regions. tag goes behind every name."""
    near = "abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1" if diagonal else "abs(a.x - b.x) + abs(a.y - b.y) <= 1"
    return f"""on_{tag} AS MATERIALIZED (SELECT image_id, x, y, v, y * 8 + x AS i FROM {source} WHERE {on}),
beside{tag} AS MATERIALIZED (SELECT a.image_id, a.i, b.i AS j FROM on_{tag} a JOIN on_{tag} b ON a.image_id = b.image_id AND {near}),
reach{tag}(image_id, i, j) AS (SELECT image_id, i, i FROM on_{tag} UNION SELECT r.image_id, r.i, b.j FROM reach{tag} r JOIN beside{tag} b ON b.image_id = r.image_id AND b.i = r.j),
reg{tag} AS MATERIALIZED (SELECT o.image_id, x, y, v, region FROM on_{tag} o JOIN (SELECT image_id, i, min(j) AS region FROM reach{tag} GROUP BY ALL) USING (image_id, i)),
stat{tag} AS MATERIALIZED (SELECT image_id, region, count(*) AS area, min(x) AS "left", min(y) AS top, max(x) AS "right", max(y) AS bottom, max(v) AS most, bool_or(x IN (0, 7) OR y IN (0, 7)) AS touches FROM reg{tag} GROUP BY ALL)"""


def changed(source: str, which: str, value: str) -> str:
    return f"o AS (SELECT p.image_id, p.x, p.y, CASE WHEN {which} THEN {value} ELSE p.v END AS v FROM {source} p LEFT JOIN reg USING (image_id, x, y) LEFT JOIN stat USING (image_id, region))"


_PEAK = "(o.v >= coalesce(b.v, 0) AND o.v > coalesce(f.v, 0))"
_THIN = f"""dir AS (SELECT *, CASE WHEN abs(gy) <= abs(gx) * (sqrt(2.0::DOUBLE) - 1) THEN 1 WHEN abs(gy) >= abs(gx) * (sqrt(2.0::DOUBLE) + 1) THEN 0 WHEN gx * gy > 0 THEN 1 ELSE -1 END AS dx,
  CASE WHEN abs(gy) <= abs(gx) * (sqrt(2.0::DOUBLE) - 1) THEN 0 ELSE 1 END AS dy FROM grad),
thin AS MATERIALIZED (SELECT o.image_id, o.x, o.y, CASE WHEN {_PEAK} THEN o.v ELSE 0.0::DOUBLE END AS v FROM dir o
  LEFT JOIN grad b ON b.image_id = o.image_id AND b.x = o.x - o.dx AND b.y = o.y - o.dy LEFT JOIN grad f ON f.image_id = o.image_id AND f.x = o.x + o.dx AND f.y = o.y + o.dy)"""

_GRAD = """grad AS MATERIALIZED (SELECT image_id, x, y, gx, gy, sqrt(gx * gx + gy * gy) AS v FROM (
  SELECT p.image_id, p.x, p.y, coalesce(sum(q.v * gx_), 0.0) AS gx, coalesce(sum(q.v * gy_), 0.0) AS gy FROM bl p, k3 LEFT JOIN bl q ON q.image_id = p.image_id AND q.x = p.x + k3.dx AND q.y = p.y + k3.dy GROUP BY ALL))"""


def _sobel_table() -> str:
    rows = ", ".join(f"({dx}, {dy}, {R.SOBEL_X.get((dx, dy), 0.0)}::DOUBLE, {R.SOBEL_Y.get((dx, dy), 0.0)}::DOUBLE)" for dx, dy in R.window(1))
    return f"k3(dx, dy, gx_, gy_) AS (VALUES {rows})"


ORACLE = {
    # A region has one outer border, and one for each hole: a part of the others, joined by edges, that doesn't reach the image's rim. A pixel is on a border if one beside it is off or outside.
    "contour_borders": f"""WITH RECURSIVE {A.RASTERS}, {flood('px', f'v > {LEVEL}', True)}, {flood('px', f'v <= {LEVEL}', False, '2')},
rim AS (SELECT o.image_id, count(*) AS pixels FROM on_ o WHERE (SELECT count(*) FROM (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)) n(dx, dy) JOIN on_ p ON p.image_id = o.image_id AND p.x = o.x + n.dx AND p.y = o.y + n.dy) < 4 GROUP BY o.image_id)
SELECT image_id, outer_ + coalesce(holes, 0) AS borders, pixels FROM (SELECT image_id, count(*) AS outer_ FROM stat GROUP BY image_id) LEFT JOIN (SELECT image_id, count(*) AS holes FROM stat2 WHERE NOT touches GROUP BY image_id) USING (image_id) JOIN rim USING (image_id)""",
    "image_regions": f"""WITH RECURSIVE {A.RASTERS}, {flood('px', f'v > {LEVEL}', True)}
SELECT image_id, region, area, "left", top, "right", bottom, round(most, 6) AS most, touches FROM stat""",
    "raster_fill_holes": f"WITH RECURSIVE {A.RASTERS}, {flood('px', f'v <= {LEVEL}', False)}, {changed('px', 'NOT touches', '1.0::DOUBLE')} {_out('v')}",
    "raster_without_small": f"WITH RECURSIVE {A.RASTERS}, {flood('px', f'v > {LEVEL}', True)}, {changed('px', 'area < 4', '0.0::DOUBLE')} {_out('v')}",
    "raster_canny": f"WITH RECURSIVE {A.RASTERS}, {_kernel('g', R.gaussian(1))}, bl AS MATERIALIZED ({_conv('g')}), {_sobel_table()}, {_GRAD}, {_THIN}, {flood('thin', f'v > {LOW}', True)}, {changed('thin', f'most <= {HIGH}', '0.0::DOUBLE')} {_out(f'CASE WHEN v > {LOW} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END')}",
}
