"""Mask queries over ``events``: a pixel is a user's day, an object an event type."""

from pyspark.sql import functions as F

from cutloom.operators import masks as M
from cutloom.sources import adapters as A

PX = ["px", "py"]
N = 5


def _decoded(s, d):
    e = M.encode(A.presence(s, d), PX, N)
    return e.select(*PX, F.array_join(M.decode(F.col("r"), F.col("g"), F.col("b"), N).cast("array<string>"), ",").alias("ids"))


def _background(s, d):
    p = A.presence(s, d)
    return M.with_background(M.blended_colours(p, PX), p.select(*PX).distinct(), PX, (10, 20, 30))


def _scores(s, d):
    """A mask against itself with the threshold moved."""
    p = A.presence(s, d)
    return M.mask_scores(p, p.withColumn("v", F.when(F.col("px") % 3 == 0, F.col("v") - 0.2).otherwise(F.col("v") + 0.1)), PX)


QUERIES = {
    "mask_prime_encode": lambda s, d: M.encode(A.presence(s, d), PX, N),
    "mask_prime_decode": _decoded,
    "mask_color_blend": lambda s, d: M.blended_colours(A.presence(s, d), PX),
    "mask_background": _background,
    "mask_alpha_max": lambda s, d: M.combined_alpha(A.presence(s, d), PX),
    "mask_alpha_lastwins": lambda s, d: M.top_alpha(A.presence(s, d), M.alpha_ramp(A.presence(s, d).select("obj_id").distinct()), PX).withColumn("alpha", F.round("alpha", 6)),
    "mask_union": lambda s, d: M.mask_union(A.presence(s, d), PX).withColumn("v", F.round("v", 6)),
    "mask_overlay": lambda s, d: M.overlay(A.presence(s, d), PX),
    "mask_scores": _scores,
    "mask_object_colors": lambda s, d: s.range(1, 25).select(F.col("id").alias("obj_id"), *[M.object_colour(F.col("id"))[c].cast("long").alias(c) for c in "rgb"]),
}

_DIM = f"dim(obj_id, p) AS (VALUES {', '.join(f'({k}, {p})' for k, p in M.prime_mapping(N).items())})"
_CODES = f"{A.PRESENCE}, {_DIM}, codes AS (SELECT px, py, coalesce(CAST(product(p) FILTER (v > 0.5) AS BIGINT), 0) AS code FROM presence JOIN dim USING (obj_id) GROUP BY ALL)"
_PR = f"[{', '.join(map(str, M.PRIMES))}]"
_COL = f"greatest({_PR}[((obj_id - 1) % 18 + {{0}})::INT] * {{1}} % 256, 64)"
_COLS = f"{A.PRESENCE}, col AS (SELECT px, py, {_COL.format(1, 17)} AS r, {_COL.format(2, 23)} AS g, {_COL.format(3, 29)} AS b FROM presence WHERE v > 0.5), bl AS (SELECT px, py, CAST(sum(r) // count(*) AS BIGINT) AS r, CAST(sum(g) // count(*) AS BIGINT) AS g, CAST(sum(b) // count(*) AS BIGINT) AS b FROM col GROUP BY ALL)"
_SETS = f"{A.PRESENCE}, seen AS (SELECT px, py, obj_id, row_number() OVER (PARTITION BY px, py ORDER BY obj_id DESC) - 1 AS above FROM presence WHERE v > 0.5)"
_OVER = [[c[k] for c in M.OVERLAY_COLOURS] for k in range(3)]
_LAID = lambda k: f"CAST(floor(round(100 * power(0.6, count(*)) + sum(([{', '.join(map(str, _OVER[k]))}])[(obj_id % 5 + 1)::INT] * 0.4 * power(0.6, above)), 6)) AS BIGINT)"

ORACLE = {
    "mask_prime_encode": f"WITH {_CODES} SELECT px, py, code, (code >> 16) & 255 AS r, (code >> 8) & 255 AS g, code & 255 AS b FROM codes",
    "mask_prime_decode": f"WITH {A.PRESENCE} SELECT px, py, coalesce(string_agg(CAST(obj_id AS VARCHAR), ',' ORDER BY obj_id) FILTER (v > 0.5), '') AS ids FROM presence GROUP BY px, py",
    "mask_color_blend": f"WITH {_COLS} SELECT * FROM bl",
    "mask_background": f"WITH {_COLS} SELECT px, py, coalesce(r, 10) AS r, coalesce(g, 20) AS g, coalesce(b, 30) AS b FROM (SELECT DISTINCT px, py FROM presence) LEFT JOIN bl USING (px, py)",
    "mask_alpha_max": f"WITH {A.PRESENCE}, m AS (SELECT px, py, max(least(greatest(v, 0.0), 1.0)) AS m FROM presence GROUP BY ALL) SELECT px, py, CAST(CASE WHEN m > 0 THEN floor(m * 255) ELSE 255 END AS BIGINT) AS alpha FROM m",
    "mask_alpha_lastwins": f"WITH {A.PRESENCE}, n AS (SELECT count(DISTINCT obj_id) AS n FROM presence) SELECT px, py, CAST(max(obj_id) AS INTEGER) AS obj_id, round(0.1 + 0.9 * (max(obj_id) - 1) / (any_value(n) - 1), 6)::DOUBLE AS alpha FROM presence, n WHERE v > 0.5 GROUP BY px, py",
    "mask_union": f'WITH {A.PRESENCE} SELECT px, py, bool_or(v > 0.5) AS "on", round(max(v), 6) AS v FROM presence GROUP BY px, py',
    "mask_overlay": f"WITH {_SETS} SELECT px, py, {_LAID(0)} AS r, {_LAID(1)} AS g, {_LAID(2)} AS b FROM seen GROUP BY px, py",
    "mask_scores": f"""WITH {A.PRESENCE}, w AS (SELECT *, CASE WHEN px % 3 = 0 THEN v - 0.2::DOUBLE ELSE v + 0.1::DOUBLE END AS u FROM presence), s AS (SELECT obj_id, count(*) FILTER (v > 0.5) AS na, count(*) FILTER (u > 0.5) AS nb, count(*) FILTER (v > 0.5 AND u > 0.5) AS n FROM w GROUP BY obj_id)
SELECT CAST(obj_id AS INTEGER) AS obj_id, round(n / (na + nb - n), 6) AS iou, round(2 * n / (na + nb), 6) AS dice, round(n / na, 6) AS precision, round(n / nb, 6) AS recall FROM s WHERE na + nb > 0""",
    "mask_object_colors": f"SELECT obj_id, {_COL.format(1, 17)}::BIGINT AS r, {_COL.format(2, 23)}::BIGINT AS g, {_COL.format(3, 29)}::BIGINT AS b FROM range(1, 25) t(obj_id)",
}
