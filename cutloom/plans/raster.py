"""Raster queries over ``embeddings``, a vector being an 8 x 8 image. The oracles are joins of pixels with a kernel table."""

from pyspark.sql import functions as F

from cutloom.operators import outline as O
from cutloom.operators import raster as R
from cutloom.sources import adapters as A


def _scaled(s, d):
    """Whole numbers 0 to 255 for the integer operators."""
    return A.rasters(s, d).withColumn("pixels", F.transform("pixels", lambda v: F.floor((v + 1) * 127).cast("double")))


def _grey(s, d):
    """The 64 values as a 4 x 4 image of red, green, blue and alpha."""
    small = A.rasters(s, d).withColumns({"width": F.lit(4), "height": F.lit(4)})
    both = R.grayscale_image(small, 4).select("image_id", F.posexplode(F.arrays_zip(F.col("pixels").alias("grey"), F.col("alpha").alias("alpha"))).alias("i", "p"))
    return both.select("image_id", "i", F.round("p.grey", 6).alias("grey"), F.round("p.alpha", 6).alias("alpha"))


def _pyramid(s, d):
    p = R.pyramid(A.rasters(s, d), 3).select((F.col("image_id") * 10 + F.col("level")).alias("image_id"), "width", "pixels")
    return R.pixels_of(p, 6)


def _scenes(s, d):
    """Ten images with one last digit in a row are a clip."""
    clips = A.rasters(s, d).withColumn("clip_id", F.floor(F.col("image_id") / 10))
    return R.scene_changes(clips, "image_id", 0.1).select("image_id", "clip_id", F.round("change", 6).alias("change"))


def _smoothed(s, d):
    masks = R.pixels_of(A.rasters(s, d), None).select((F.col("image_id") % 7).alias("obj_id"), "x", "y", F.floor(F.col("image_id") / 7).alias("frame_idx"), "v")
    return R.temporal_smoothing(masks, 3).withColumn("v", F.round("v", 4) + 0.0)


def _labels(s, d):
    return A.read(s, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"))


def _batches(s, d):
    """Batches of 32 by id: the id's place comes from one count per thousand ids, then a window within each."""
    e = A.read(s, d, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 1000).alias("block"))
    from pyspark.sql import Window as W

    before = e.groupBy("block").agg(F.count("*").alias("n")).select("block", F.coalesce(F.sum("n").over(W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    placed = e.withColumn("nth", F.row_number().over(W.partitionBy("block").orderBy("vec_id"))).join(before, "block")
    return placed.select("vec_id", F.expr("(before + nth - 1) div 32").alias("batch"))


def _best(s, d):
    """Of each label the image of greatest first value, the score of a mask; the least id of equal ones."""
    e = A.rasters(s, d).withColumn("score", F.get("pixels", F.lit(0)))
    best = e.groupBy("label").agg(F.max(F.struct("score", (-F.col("image_id")).alias("back"))).alias("b"))
    return best.select("label", (-F.col("b.back")).alias("image_id"), F.round("b.score", 6).alias("score"))


QUERIES = {
    "raster_threshold": lambda s, d: R.pixels_of(R.threshold(A.rasters(s, d), 0.1), None),
    "raster_sobel": lambda s, d: R.pixels_of(R.outline(A.rasters(s, d))),
    "raster_blur": lambda s, d: R.pixels_of(R.gaussian_blur(A.rasters(s, d), 2)),
    "raster_box_filter": lambda s, d: R.pixels_of(R.box_filter(A.rasters(s, d), 1)),
    "raster_laplacian": lambda s, d: R.pixels_of(R.laplacian(A.rasters(s, d))),
    "raster_erode": lambda s, d: R.pixels_of(R.erode(A.rasters(s, d), 3)),
    "raster_dilate": lambda s, d: R.pixels_of(R.dilate(A.rasters(s, d), 3)),
    "raster_dilate_literal_seed": lambda s, d: R.pixels_of(R.dilate(A.rasters(s, d), 2, literal_seed=True)),
    "raster_open": lambda s, d: R.pixels_of(R.morphology_open(A.rasters(s, d), 3)),
    "raster_pipeline": lambda s, d: R.pixels_of(R.blur_outline_threshold(A.rasters(s, d), 2, 0.15)),
    "raster_minmax": lambda s, d: R.pixels_of(R.min_max(A.rasters(s, d)), None),
    "raster_grayscale": _grey,
    "raster_resize_nearest": lambda s, d: R.pixels_of(R.resize_nearest(A.rasters(s, d), 5, 11), 6),
    "raster_box_smooth": lambda s, d: R.pixels_of(R.box_smooth(_scaled(s, d)), None),
    "raster_boundary": lambda s, d: R.boundary(A.rasters(s, d), 0.0),
    "raster_otsu": lambda s, d: R.otsu_threshold(A.rasters(s, d)),
    "raster_kernel_batches": lambda s, d: R.pixels_of(R.kernel_batches(A.rasters(s, d), R.gaussian(2))),
    "raster_box_batches": lambda s, d: R.pixels_of(R.box_filter_batches(A.rasters(s, d), 1)),
    "raster_blur_batches": lambda s, d: R.pixels_of(R.gaussian_blur_batches(A.rasters(s, d), 2)),
    "raster_adaptive_batches": lambda s, d: R.pixels_of(R.adaptive_threshold_batches(A.rasters(s, d), 3, 0.05), None),
    "raster_close": lambda s, d: R.pixels_of(R.morphology_close(A.rasters(s, d), 3)),
    "raster_erode_twice": lambda s, d: R.pixels_of(R.iterated(R.erode, 2)(A.rasters(s, d))),
    "raster_motion_blur": lambda s, d: R.pixels_of(R.motion_blur(A.rasters(s, d), 3)),
    "raster_blur_by_sigma": lambda s, d: R.pixels_of(R.blur_by_sigma(A.rasters(s, d), 1.0)),
    "raster_adaptive": lambda s, d: R.pixels_of(O.adaptive_threshold_step(3, 0.05)(A.rasters(s, d)), None),
    "raster_advanced": lambda s, d: R.pixels_of(R.advanced_pipeline(A.rasters(s, d), 2, 3, 0.15)),
    "raster_sharpen": lambda s, d: R.pixels_of(R.sharpen(A.rasters(s, d))),
    "raster_median": lambda s, d: R.pixels_of(R.median_filter(A.rasters(s, d), 1)),
    "raster_pyramid": _pyramid,
    "scene_changes": _scenes,
    "mask_temporal_smoothing": _smoothed,
    "label_histogram": _labels,
    "batch_index": _batches,
    "best_mask": _best,
}


def _kernel(name: str, weights: dict) -> str:
    return f"{name}(dx, dy, w) AS (VALUES {', '.join(f'({dx}, {dy}, {w!r}::DOUBLE)' for (dx, dy), w in weights.items())})"


def _conv(kernel: str, source: str = "px") -> str:
    """Sums of weighted pixels: a pixel (x, y) takes from (x + dx, y + dy)."""
    return f"SELECT p.image_id, p.x - k.dx AS x, p.y - k.dy AS y, sum(p.v * k.w) AS v FROM {source} p, {kernel} k WHERE p.x - k.dx BETWEEN 0 AND 7 AND p.y - k.dy BETWEEN 0 AND 7 GROUP BY ALL"


def _out(v: str = "round(v, 4) + 0.0", source: str = "o") -> str:
    return f"SELECT image_id, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, {v} AS v FROM {source}"


def _window(pick: str, source: str, radius: int = 1, seed: str = "") -> str:
    """Least or greatest of the window, in which a missing neighbour counts as 0."""
    n = (2 * radius + 1) ** 2
    return f"SELECT p.image_id, p.x - k.dx AS x, p.y - k.dy AS y, {pick}({pick[:3]}(p.v), CASE WHEN count(*) < {n} THEN 0.0::DOUBLE ELSE {pick[:3]}(p.v) END{seed}) AS v FROM {source} p, k{radius} k WHERE p.x - k.dx BETWEEN 0 AND 7 AND p.y - k.dy BETWEEN 0 AND 7 GROUP BY p.image_id, p.x - k.dx, p.y - k.dy"


def _pick(kind: str, source: str, radius: int = 1, seed: str = "") -> str:
    return _window(kind, source, radius, seed).replace("least(lea(", "least(min(").replace("lea(p.v) END", "min(p.v) END").replace("greatest(gre(", "greatest(max(").replace("gre(p.v) END", "max(p.v) END")


_K1 = _kernel("k1", dict.fromkeys(R.window(1), 1.0))
_SOBEL = lambda src: f"sx AS ({_conv('kx', src)}), sy AS ({_conv('ky', src)}), so AS (SELECT sx.image_id, sx.x, sx.y, sqrt(sx.v * sx.v + sy.v * sy.v) AS v FROM sx JOIN sy USING (image_id, x, y))"
_KXY = f"{_kernel('kx', R.SOBEL_X)}, {_kernel('ky', R.SOBEL_Y)}"
_ALL = "grid AS (SELECT image_id, x, y FROM px)"

ORACLE = {
    "raster_threshold": f"WITH {A.RASTERS}, o AS (SELECT image_id, x, y, CASE WHEN v > 0.1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM px) {_out('v')}",
    "raster_sobel": f"WITH {A.RASTERS}, {_KXY}, {_SOBEL('px')} {_out(source='so')}",
    "raster_blur": f"WITH {A.RASTERS}, {_kernel('g', R.gaussian(2))}, o AS ({_conv('g')}) {_out()}",
    "raster_kernel_batches": f"WITH {A.RASTERS}, {_kernel('g', R.gaussian(2))}, o AS ({_conv('g')}) {_out()}",
    "raster_box_filter": f"WITH {A.RASTERS}, {_kernel('g', dict.fromkeys(R.window(1), 1.0 / 9))}, o AS ({_conv('g')}) {_out()}",
    "raster_laplacian": f"WITH {A.RASTERS}, {_kernel('g', R.LAPLACIAN)}, o AS ({_conv('g')}) {_out()}",
    "raster_erode": f"WITH {A.RASTERS}, {_K1}, o AS ({_pick('least', 'px')}) {_out()}",
    "raster_dilate": f"WITH {A.RASTERS}, {_K1}, o AS ({_pick('greatest', 'px')}) {_out()}",
    "raster_dilate_literal_seed": f"WITH {A.RASTERS}, {_K1}, o AS ({_pick('greatest', 'px', 1, ', 1.0::DOUBLE')}) {_out()}",
    "raster_open": f"WITH {A.RASTERS}, {_K1}, er AS ({_pick('least', 'px')}), o AS ({_pick('greatest', 'er')}) {_out()}",
    "raster_pipeline": f"WITH {A.RASTERS}, {_KXY}, {_kernel('g', R.gaussian(2))}, bl AS ({_conv('g')}), {_SOBEL('bl')} {_out('CASE WHEN v > 0.15 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END', 'so')}",
    "raster_minmax": f"WITH {A.RASTERS}, o AS (SELECT *, min(v) OVER w AS lo, max(v) OVER w AS hi FROM px WINDOW w AS (PARTITION BY image_id)) {_out('CASE WHEN hi > lo THEN floor((v - lo) / (hi - lo) * 255) ELSE 0.0 END')}",
    "raster_grayscale": "SELECT vec_id AS image_id, CAST(i AS INTEGER) AS i, round(CAST(embedding[4 * i + 1] AS DOUBLE) * 0.299::DOUBLE + CAST(embedding[4 * i + 2] AS DOUBLE) * 0.587::DOUBLE + CAST(embedding[4 * i + 3] AS DOUBLE) * 0.114::DOUBLE, 6) AS grey, round(CAST(embedding[4 * i + 4] AS DOUBLE), 6) AS alpha FROM embeddings, range(16) r(i)",
    "raster_box_batches": f"WITH {A.RASTERS}, {_kernel('g', dict.fromkeys(R.window(1), 1.0 / 9))}, o AS ({_conv('g')}) {_out()}",
    "raster_blur_batches": f"WITH {A.RASTERS}, {_kernel('g', R.gaussian(2))}, o AS ({_conv('g')}) {_out()}",
    "raster_adaptive_batches": f"WITH {A.RASTERS}, {_kernel('g', dict.fromkeys(R.window(1), 1.0 / 9))}, m AS ({_conv('g')}), o AS (SELECT p.image_id, p.x, p.y, CASE WHEN p.v > m.v - 0.05::DOUBLE THEN 255.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM px p JOIN m USING (image_id, x, y)) {_out('v')}",
    "raster_close": f"WITH {A.RASTERS}, {_K1}, di AS ({_pick('greatest', 'px')}), o AS ({_pick('least', 'di')}) {_out()}",
    "raster_erode_twice": f"WITH {A.RASTERS}, {_K1}, er AS ({_pick('least', 'px')}), o AS ({_pick('least', 'er')}) {_out()}",
    "raster_motion_blur": f"WITH {A.RASTERS}, {_kernel('g', {(k, 0): 1.0 / 3 for k in range(3)})}, o AS ({_conv('g')}) {_out()}",
    "raster_blur_by_sigma": f"""WITH {A.RASTERS}, k(dx, w) AS (SELECT i - 2, exp(-(i - 2) * (i - 2) / 2.0::DOUBLE) / (1 + 2 * exp(-0.5::DOUBLE) + 2 * exp(-2.0::DOUBLE)) FROM range(5) r(i)),
o AS (SELECT p.image_id, p.x, p.y, sum(q.v * a.w * b.w) AS v FROM px p, k a, k b JOIN px q ON true WHERE q.image_id = p.image_id AND q.x = greatest(0, least(7, p.x + a.dx)) AND q.y = greatest(0, least(7, p.y + b.dx)) GROUP BY ALL) {_out()}""",
    "raster_adaptive": f"WITH {A.RASTERS}, {_kernel('g', dict.fromkeys(R.window(1), 1.0 / 9))}, m AS ({_conv('g')}), o AS (SELECT p.image_id, p.x, p.y, CASE WHEN p.v > m.v - 0.05::DOUBLE THEN 255.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM px p JOIN m USING (image_id, x, y)) {_out('v')}",
    "raster_advanced": f"WITH {A.RASTERS}, {_K1}, {_KXY}, {_kernel('g', R.gaussian(2))}, bl AS ({_conv('g')}), {_SOBEL('bl')}, er AS ({_pick('least', 'so')}), di AS ({_pick('greatest', 'er')}) {_out('CASE WHEN v > 0.15 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END', 'di')}",
    "raster_resize_nearest": f"WITH {A.RASTERS}, o AS (SELECT p.image_id, i % 5 AS x, i // 5 AS y, p.v FROM range(55) r(i) JOIN px p ON p.x = (i % 5) * 8 // 5 AND p.y = (i // 5) * 8 // 11) {_out('round(v, 6) + 0.0')}",
    "raster_box_smooth": f"""WITH {A.RASTERS}, sc AS (SELECT image_id, x, y, floor((v + 1) * 127) AS v FROM px), {_K1}, s AS ({_conv('k1', 'sc')}),
o AS (SELECT sc.image_id, sc.x, sc.y, CASE WHEN sc.x BETWEEN 1 AND 6 AND sc.y BETWEEN 1 AND 6 THEN floor(s.v / 9) ELSE sc.v END AS v FROM sc JOIN s USING (image_id, x, y)) {_out('v')}""",
    "raster_boundary": f"""WITH {A.RASTERS}, {_K1}, onp AS (SELECT image_id, x, y, CASE WHEN v > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM px), s AS ({_conv('k1', 'onp')})
SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY y, x) - 1 AS INTEGER) AS nth, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y FROM onp JOIN s USING (image_id, x, y) WHERE onp.v = 1 AND s.v < 9""",
    "raster_otsu": f"""WITH {A.RASTERS}, mm AS (SELECT *, min(v) OVER w AS lo, max(v) OVER w AS hi FROM px WINDOW w AS (PARTITION BY image_id)),
bins AS (SELECT image_id, CAST(floor(CASE WHEN hi > lo THEN floor((v - lo) / (hi - lo) * 255) ELSE 0.0 END * 16 / 256) AS BIGINT) AS b FROM mm),
sums AS (SELECT image_id, t, count(*) FILTER (b <= t) AS n0, count(*) FILTER (b > t) AS n1, coalesce(sum(b) FILTER (b <= t), 0) AS s0, coalesce(sum(b) FILTER (b > t), 0) AS s1 FROM bins, range(15) r(t) GROUP BY ALL),
bet AS (SELECT image_id, t, CASE WHEN n0 > 0 AND n1 > 0 THEN round(CAST((s0 * n1 - s1 * n0) * (s0 * n1 - s1 * n0) AS DOUBLE) / (n0 * n1), 6) ELSE 0.0 END AS between_ FROM sums)
SELECT image_id, CAST(t AS INTEGER) AS level, between_ AS "between" FROM bet QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY between_ DESC, t) = 1""",
    "raster_sharpen": f"WITH {A.RASTERS}, {_kernel('g', R.SHARPEN)}, o AS ({_conv('g')}) {_out()}",
    "raster_median": f"""WITH {A.RASTERS}, {_K1}, w AS (SELECT p.image_id, p.x - k.dx AS x, p.y - k.dy AS y, list(p.v) AS vs FROM px p, k1 k WHERE p.x - k.dx BETWEEN 0 AND 7 AND p.y - k.dy BETWEEN 0 AND 7 GROUP BY ALL),
o AS (SELECT image_id, x, y, list_sort(list_concat(vs, list_transform(range(9 - len(vs)), lambda i: 0.0::DOUBLE)))[5] AS v FROM w) {_out()}""",
    "raster_pyramid": f"WITH {A.RASTERS}, o AS (SELECT image_id * 10 + l AS image_id, x // (1 << l) AS x, y // (1 << l) AS y, v FROM px, range(3) r(l) WHERE x % (1 << l) = 0 AND y % (1 << l) = 0) {_out('round(v, 6) + 0.0')}",
    "scene_changes": f"""WITH {A.RASTERS}, g AS (SELECT image_id, image_id // 10 AS clip_id, v, lag(v) OVER (PARTITION BY image_id // 10, x, y ORDER BY image_id) AS b FROM px)
SELECT image_id, clip_id, round(avg(abs(v - b)), 6) AS change FROM g WHERE b IS NOT NULL GROUP BY ALL HAVING avg(abs(v - b)) > 0.1""",
    "mask_temporal_smoothing": f"""WITH {A.RASTERS}, m AS (SELECT image_id % 7 AS obj_id, x, y, image_id // 7 AS frame_idx, v FROM px)
SELECT obj_id, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, frame_idx, round(avg(v) OVER (PARTITION BY obj_id, x, y ORDER BY frame_idx RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING), 4) + 0.0 AS v FROM m""",
    "label_histogram": "SELECT label, count(*) AS n FROM embeddings GROUP BY label",
    "batch_index": "SELECT vec_id, (row_number() OVER (ORDER BY vec_id) - 1) // 32 AS batch FROM embeddings",
    "best_mask": "SELECT label, vec_id AS image_id, round(CAST(embedding[1] AS DOUBLE), 6) AS score FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY embedding[1] DESC, vec_id) = 1",
}
