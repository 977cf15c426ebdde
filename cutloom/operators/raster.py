"""Raster operators on images (image_id, width, height, pixels ARRAY<DOUBLE>, row by row).

A kernel is a column expression: each output pixel is a fold over a fixed window of the same row's array, so
no operator shuffles and each is one projection. An array that a lambda reads is a column named more than once, and arrays
are unnested by posexplode_outer: otherwise Catalyst would put the array's own expression (into the lambda, or into a filter
on its size that explode implies) and compute it again for each pixel. ``kernel_batches`` is the NumPy twin for large images
(over about 64 x 64), where the interpreted fold would be the bottleneck. Outside pixels count as 0.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Images of a piece that is blurred together.
BLURRED = 256

SOBEL_X = {(-1, -1): -1.0, (1, -1): 1.0, (-1, 0): -2.0, (1, 0): 2.0, (-1, 1): -1.0, (1, 1): 1.0}
SOBEL_Y = {(dy, dx): w for (dx, dy), w in SOBEL_X.items()}
LAPLACIAN = {(0, -1): 1.0, (-1, 0): 1.0, (0, 0): -4.0, (1, 0): 1.0, (0, 1): 1.0}


def gaussian(radius: int) -> dict[tuple[int, int], float]:
    """Weights of sigma radius / 3 over the window, summing to 1 over all of it."""
    sigma = radius / 3
    raw = {(dx, dy): math.exp(-(dx * dx + dy * dy) / (2 * sigma * sigma)) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1)}
    total = sum(raw.values())
    return {k: v / total for k, v in raw.items()}


def window(radius: int) -> list[tuple[int, int]]:
    return [(dx, dy) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1)]


def tap(pixels: str, i: Column, dx: int, dy: int) -> Column:
    """The pixel dx to the right of and dy below pixel i, 0 outside."""
    w, h = F.col("width"), F.col("height")
    x, y = i % w + dx, F.floor(i / w) + dy
    return F.when((x >= 0) & (x < w) & (y >= 0) & (y < h), F.get(pixels, (i + dy * w + dx).cast("int"))).otherwise(F.lit(0.0))


def each_pixel(fn: Callable[[Column], Column]) -> Column:
    return F.transform(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1), lambda i: fn(i))


def weighted(pixels: str, weights: dict[tuple[int, int], float]) -> Column:
    def at(i):
        total = None
        for (dx, dy), w in weights.items():
            term = tap(pixels, i, dx, dy) * w
            total = term if total is None else total + term
        return total

    return each_pixel(at)


def convolve(images: DataFrame, weights: dict[tuple[int, int], float]) -> DataFrame:
    return images.withColumn("pixels", weighted("pixels", weights))


def outline(images: DataFrame) -> DataFrame:
    """Sobel gradient magnitude."""
    both = images.withColumns({"gx_": weighted("pixels", SOBEL_X), "gy_": weighted("pixels", SOBEL_Y)})
    return both.withColumn("pixels", F.zip_with("gx_", "gy_", lambda a, b: F.sqrt(a * a + b * b))).drop("gx_", "gy_")


def gaussian_blur(images: DataFrame, radius: int) -> DataFrame:
    """Weights of outside pixels count, so borders darken; radius 0 changes nothing."""
    return convolve(images, gaussian(radius)) if radius else images


def clamped(pixels: str, i: Column, dx: int, dy: int) -> Column:
    """The pixel dx to the right of and dy below pixel i, or the nearest one of the image."""
    w, h = F.col("width"), F.col("height")
    x, y = F.least(F.greatest(i % w + dx, F.lit(0)), w - 1), F.least(F.greatest(F.floor(i / w) + dy, F.lit(0)), h - 1)
    return F.get(pixels, (y * w + x).cast("int"))


def _falling(sigma: float) -> list[tuple[int, float]]:
    """Offsets up to 2 sigma and their weights, which sum to 1."""
    radius = math.ceil(2 * sigma)
    raw = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(-radius, radius + 1)]
    return list(zip(range(-radius, radius + 1), [v / sum(raw) for v in raw], strict=True))


def blur_by_sigma(images: DataFrame, sigma: float) -> DataFrame:
    """Gaussian blur whose window reaches 2 sigma, weights summing to 1, borders repeated: one pass along the rows and one along the columns."""
    weights = _falling(sigma)
    for across in (True, False):
        images = images.withColumn("pixels", each_pixel(lambda i, across=across: sum((clamped("pixels", i, k * across, k * (not across)) * w for k, w in weights), F.lit(0.0))))
    return images


def blur_by_sigma_batches(images: DataFrame, sigma: float) -> DataFrame:
    """blur_by_sigma by NumPy over Arrow batches: the same sums in the same order, other columns kept. A missing pixel, or one past the array's end, makes null what its window reaches."""
    weights = _falling(sigma)

    def blurred(pixels: np.ndarray) -> np.ndarray:
        for axis in (1, 0):
            at, last = np.arange(pixels.shape[axis]), pixels.shape[axis] - 1
            pixels = sum(pixels.take(np.clip(at + k, 0, last), axis) * w for k, w in weights)
        return pixels

    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, BLURRED):
                part = batch.slice(first, BLURRED)
                at, out, missing = part.schema.get_field_index("pixels"), [np.zeros(0)], [np.zeros(0, bool)]
                for w, h, cell in zip(part.column("width").to_pylist(), part.column("height").to_pylist(), part.column(at), strict=True):
                    values = cell.values.slice(0, w * h) if cell.is_valid else pa.array([], pa.float64())
                    image, unknown = np.zeros(w * h), np.ones(w * h, bool)
                    image[: len(values)], unknown[: len(values)] = values.to_numpy(zero_copy_only=False), values.is_null().to_numpy(zero_copy_only=False)
                    out.append(blurred(image.reshape(h, w)).ravel() if w * h else image)
                    missing.append(blurred(unknown.reshape(h, w).astype(float)).ravel() > 0 if unknown.any() else unknown)
                ends = pa.array(np.cumsum([0, *map(len, out[1:])]), pa.int32())
                yield part.set_column(at, "pixels", pa.ListArray.from_arrays(ends, pa.array(np.concatenate(out), mask=np.concatenate(missing))))

    return images.mapInArrow(run, images.withColumn("pixels", F.col("pixels").cast("array<double>")).schema)


def motion_blur(images: DataFrame, length: int = 3) -> DataFrame:
    """Mean of the pixel and the length - 1 to the right of it; missing ones count 0."""
    return convolve(images, {(dx, 0): 1.0 / length for dx in range(length)})


def efficient_pipeline(images: DataFrame, radius=2, edge=0.15, most=1.0) -> DataFrame:
    """Blur, outline and threshold in one plan without intermediate tables, which is how every chain here runs."""
    return blur_outline_threshold(images, radius, edge, most)


def iterated(step: Callable[[DataFrame], DataFrame], times: int) -> Callable[[DataFrame], DataFrame]:
    """step, so many times in a row: iterated(erode, 2)(images)."""

    def run(images: DataFrame) -> DataFrame:
        for _ in range(times):
            images = step(images)
        return images

    return run


def box_filter(images: DataFrame, radius: int = 1) -> DataFrame:
    size = (2 * radius + 1) ** 2
    return convolve(images, dict.fromkeys(window(radius), 1.0 / size))


def laplacian(images: DataFrame) -> DataFrame:
    return convolve(images, LAPLACIAN)


def threshold(images: DataFrame, t: float, most: float = 1.0) -> DataFrame:
    """most where the value is over t, else 0."""
    return images.withColumn("pixels", F.transform("pixels", lambda v: F.when(v > t, F.lit(most)).otherwise(F.lit(0.0))))


def _extreme(images: DataFrame, kernel: int, pick, seed: float | None) -> DataFrame:
    cells = window(kernel // 2)
    extra = [] if seed is None else [F.lit(seed)]
    return images.withColumn("pixels", each_pixel(lambda i: pick(*[tap("pixels", i, dx, dy) for dx, dy in cells], *extra)))


def erode(images: DataFrame, kernel: int = 3, literal_seed: bool = False) -> DataFrame:
    """Least value of the window of radius kernel // 2. literal_seed starts from 0, as the inverted seed of the shader does."""
    return _extreme(images, kernel, F.least, 0.0 if literal_seed else None)


def dilate(images: DataFrame, kernel: int = 3, literal_seed: bool = False) -> DataFrame:
    """Greatest value of the window; literal_seed starts from 1."""
    return _extreme(images, kernel, F.greatest, 1.0 if literal_seed else None)


def morphology_open(images: DataFrame, kernel: int = 3) -> DataFrame:
    return dilate(erode(images, kernel), kernel)


def morphology_close(images: DataFrame, kernel: int = 3) -> DataFrame:
    return erode(dilate(images, kernel), kernel)


def blur_outline_threshold(images: DataFrame, radius=2, edge=0.15, most=1.0) -> DataFrame:
    return threshold(outline(gaussian_blur(images, radius)), edge, most)


def advanced_pipeline(images: DataFrame, radius=2, kernel=3, t=0.15, most=1.0) -> DataFrame:
    return threshold(dilate(erode(outline(gaussian_blur(images, radius)), kernel), kernel), t, most)


def min_max(images: DataFrame) -> DataFrame:
    """Values scaled to 0..255 and cut; all 0 where they are all alike."""
    ranged = images.withColumns({"lo_": F.array_min("pixels"), "hi_": F.array_max("pixels")})
    scaled = F.transform("pixels", lambda v: F.when(F.col("hi_") > F.col("lo_"), F.floor((v - F.col("lo_")) / (F.col("hi_") - F.col("lo_")) * 255).cast("double")).otherwise(F.lit(0.0)))
    return ranged.withColumn("pixels", scaled).drop("lo_", "hi_")


def grayscale(r: Column, g: Column, b: Column) -> Column:
    return r * 0.299 + g * 0.587 + b * 0.114


def grayscale_image(images: DataFrame, channels: int = 3, planar: bool = False) -> DataFrame:
    """Colour images to grey ones. pixels holds ``channels`` values a pixel, together or (planar) one plane after the other; a fourth channel becomes the column alpha."""
    n = F.col("width") * F.col("height")
    at = lambda i, k: F.get("pixels", ((i + n * k) if planar else (i * channels + k)).cast("int"))
    grey = each_pixel(lambda i: grayscale(at(i, 0), at(i, 1), at(i, 2)))
    kept = images.withColumn("alpha", each_pixel(lambda i: at(i, 3))) if channels == 4 else images
    return kept.withColumn("pixels", grey)


def resize_nearest(images: DataFrame, width: int, height: int) -> DataFrame:
    """Source pixel floor(x * w / width), floor(y * h / height)."""
    w, h = F.col("width"), F.col("height")

    def source(i):
        x = F.least(F.floor((i % width) * w / width), w - 1)
        y = F.least(F.floor(F.floor(i / width) * h / height), h - 1)
        return F.get("pixels", (y * w + x).cast("int"))

    each = F.sequence(F.lit(0), F.lit(width * height - 1))
    # size names pixels a second time: else what makes them would be computed again for every pixel of the result.
    sized = F.when(F.size("pixels") >= 0, F.transform(each, source)).otherwise(F.transform(each, lambda i: F.lit(None).cast("double")))
    return images.withColumn("pixels", sized).withColumns({"width": F.lit(width), "height": F.lit(height)})


def box_smooth(images: DataFrame) -> DataFrame:
    """Integer mean of the 3 x 3 window, cut; border pixels stay."""
    w, h = F.col("width"), F.col("height")

    def at(i):
        x, y = i % w, F.floor(i / w)
        total = sum((tap("pixels", i, dx, dy) for dx, dy in window(1)), F.lit(0.0))
        return F.when((x > 0) & (x < w - 1) & (y > 0) & (y < h - 1), F.floor(total / 9).cast("double")).otherwise(F.get("pixels", i))

    return images.withColumn("pixels", each_pixel(at))


def boundary(images: DataFrame, t: float) -> DataFrame:
    """image_id, nth, x, y of the pixels over t that have a neighbour, of eight, that isn't or is outside; row by row."""
    on = images.withColumn("pixels", F.transform("pixels", lambda v: F.when(v > t, F.lit(1.0)).otherwise(F.lit(0.0))))
    full = on.withColumn("full_", each_pixel(lambda i: sum((tap("pixels", i, dx, dy) for dx, dy in window(1)), F.lit(0.0))))
    edge = full.withColumn("edge_", F.filter(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1), lambda i: (F.get("pixels", i) == 1) & F.get("full_", i).isNotNull() & (F.get("full_", i) < 9)))
    return edge.select("image_id", "width", F.posexplode_outer("edge_").alias("nth", "i")).filter("nth is not null").select("image_id", "nth", (F.col("i") % F.col("width")).alias("x"), F.floor(F.col("i") / F.col("width")).cast("int").alias("y"))


def otsu_threshold(images: DataFrame, levels: int = 16) -> DataFrame:
    """image_id and the level that parts its min-max histogram of ``levels`` bins with the greatest variance between the two classes (the least such)."""
    binned = min_max(images).withColumn("bins_", F.transform("pixels", lambda v: F.floor(v * levels / 256).cast("int")))
    counts = F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), lambda b: F.size(F.filter("bins_", lambda x: x == b)).cast("long"))
    part = binned.withColumn("counts_", counts).select("image_id", "counts_", F.explode(F.sequence(F.lit(0), F.lit(levels - 2))).alias("level"))
    total = lambda lo, hi, fn: F.aggregate(F.sequence(lo, hi), F.lit(0).cast("long"), lambda a, b: a + fn(b))
    zero, top, t = F.lit(0), F.lit(levels - 1), F.col("level")
    count, mass = lambda b: F.get("counts_", b), lambda b: F.get("counts_", b) * b
    sums = part.select("image_id", "level", total(zero, t, count).alias("n0"), total(t + 1, top, count).alias("n1"), total(zero, t, mass).alias("s0"), total(t + 1, top, mass).alias("s1"))
    gap = F.col("s0") * F.col("n1") - F.col("s1") * F.col("n0")
    between = F.when((F.col("n0") > 0) & (F.col("n1") > 0), (gap * gap).cast("double") / (F.col("n0") * F.col("n1"))).otherwise(F.lit(0.0))
    return sums.withColumn("between", F.round(between, 6)).groupBy("image_id").agg(F.max(F.struct("between", (-t).alias("back"))).alias("b")).select("image_id", (-F.col("b.back")).alias("level"), F.col("b.between").alias("between"))


def pixels_of(images: DataFrame, digits: int | None = 4) -> DataFrame:
    """Long form: image_id, x, y, v."""
    v = F.col("v") if digits is None else F.round("v", digits) + 0.0
    long = images.select("image_id", "width", F.posexplode_outer("pixels").alias("i", "v")).filter("i is not null")
    return long.select("image_id", (F.col("i") % F.col("width")).alias("x"), F.floor(F.col("i") / F.col("width")).cast("int").alias("y"), v.alias("v"))


def _each_image(images: DataFrame, fn: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """image_id, width, height and fn of the pixels (height x width) of each image, by NumPy over Arrow's flat values. Images without pixels stay so."""

    def run(batches):
        for batch in batches:
            w, h = (batch.column(c).to_numpy(zero_copy_only=False) for c in (1, 2))
            out = [fn(np.asarray(v.values, np.float64).reshape(b, a)).ravel() if v.is_valid and a * b else np.zeros(0) for v, a, b in zip(batch.column(3), w.tolist(), h.tolist(), strict=True)]
            ends = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int32))
            pixels = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(out) if out else np.zeros(0)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pixels], ["image_id", "width", "height", "pixels"])

    rows = images.select("image_id", "width", "height", "pixels")
    return rows.mapInArrow(run, rows.schema)


def window_sums(pixels: np.ndarray, radius: int) -> np.ndarray:
    """Sum of each pixel's window, pixels outside counting 0: four look-ups in a summed-area table, whatever the radius."""
    h, w = pixels.shape
    total = np.zeros((h + 1, w + 1))
    np.cumsum(np.cumsum(pixels, axis=0), axis=1, out=total[1:, 1:])
    top, low = np.maximum(np.arange(h) - radius, 0), np.minimum(np.arange(h) + radius + 1, h)
    left, right = np.maximum(np.arange(w) - radius, 0), np.minimum(np.arange(w) + radius + 1, w)
    return total[np.ix_(low, right)] - total[np.ix_(top, right)] - total[np.ix_(low, left)] + total[np.ix_(top, left)]


def box_filter_batches(images: DataFrame, radius: int = 1) -> DataFrame:
    """box_filter for large images, at a constant cost a pixel."""
    return _each_image(images, lambda p: window_sums(p, radius) / (2 * radius + 1) ** 2)


def adaptive_threshold_batches(images: DataFrame, block: int = 11, c: float = 2.0) -> DataFrame:
    """255 where the pixel is over its block's mean less c, else 0, for large images."""
    return _each_image(images, lambda p: np.where(p > window_sums(p, block // 2) / (2 * (block // 2) + 1) ** 2 - c, 255.0, 0.0))


def separable(pixels: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The window sum weighted by weights[dy] * weights[dx], pixels outside counting 0: one pass down and one across."""
    radius = len(weights) // 2
    for axis in (0, 1):
        wide = np.pad(pixels, [(radius, radius) if a == axis else (0, 0) for a in (0, 1)])
        pixels = sum(w * np.take(wide, np.arange(k, k + pixels.shape[axis]), axis=axis) for k, w in enumerate(weights))
    return pixels


def gaussian_blur_batches(images: DataFrame, radius: int) -> DataFrame:
    """gaussian_blur for large images: its weights are a product, so 2 * (2 * radius + 1) of them a pixel do."""
    if not radius:
        return images.select("image_id", "width", "height", "pixels")
    raw = np.exp(-(np.arange(-radius, radius + 1) ** 2) / (2 * (radius / 3) ** 2))
    return _each_image(images, lambda p: separable(p, raw / raw.sum()))


def kernel_batches(images: DataFrame, weights: dict[tuple[int, int], float]) -> DataFrame:
    """convolve for large images, by NumPy over Arrow batches; same result. Columns image_id, width, height, pixels."""

    def run(batches):
        for batch in batches:
            w, h = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            out = []
            for k, values in enumerate(batch.column(3)):
                image = np.array(values.as_py(), float).reshape(h[k], w[k])
                total = np.zeros_like(image)
                for (dx, dy), weight in weights.items():
                    moved = np.zeros_like(image)
                    y0, y1, x0, x1 = max(0, -dy), min(h[k], h[k] - dy), max(0, -dx), min(w[k], w[k] - dx)
                    moved[y0:y1, x0:x1] = image[y0 + dy : y1 + dy, x0 + dx : x1 + dx]
                    total += moved * weight
                out.append(total.ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(out, pa.list_(pa.float64()))], ["image_id", "width", "height", "pixels"])

    return images.select("image_id", "width", "height", "pixels").mapInArrow(run, images.select("image_id", "width", "height", "pixels").schema)


def letterbox(images: DataFrame, side: int) -> DataFrame:
    """A square of ``side``: the image enlarged or reduced (nearest) to fit, centred on 0."""
    w, h = F.col("width"), F.col("height")
    scale = F.least(F.lit(side) / w, F.lit(side) / h)
    sized = images.withColumns({"nw_": F.floor(w * scale).cast("int"), "nh_": F.floor(h * scale).cast("int")})
    sized = sized.withColumns({"ox_": F.floor((side - F.col("nw_")) / 2).cast("int"), "oy_": F.floor((side - F.col("nh_")) / 2).cast("int")})

    def at(i):
        x, y = i % side - F.col("ox_"), F.floor(i / side) - F.col("oy_")
        sx, sy = F.least(F.floor(x * w / F.col("nw_")), w - 1), F.least(F.floor(y * h / F.col("nh_")), h - 1)
        return F.when((x >= 0) & (x < F.col("nw_")) & (y >= 0) & (y < F.col("nh_")), F.get("pixels", (sy * w + sx).cast("int"))).otherwise(F.lit(0.0))

    boxed = sized.withColumn("pixels", F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), at))
    return boxed.withColumns({"width": F.lit(side), "height": F.lit(side)}).drop("nw_", "nh_", "ox_", "oy_")


def normalise(images: DataFrame, mean: float, std: float) -> DataFrame:
    return images.withColumn("pixels", F.transform("pixels", lambda v: (v - mean) / std))


SHARPEN = {(0, -1): -1.0, (-1, 0): -1.0, (0, 0): 5.0, (1, 0): -1.0, (0, 1): -1.0}


def sharpen(images: DataFrame) -> DataFrame:
    return convolve(images, SHARPEN)


def median_filter(images: DataFrame, radius: int = 1) -> DataFrame:
    """Median of the window, outside pixels counting as 0."""
    cells = window(radius)
    return images.withColumn("pixels", each_pixel(lambda i: F.get(F.sort_array(F.array(*[tap("pixels", i, dx, dy) for dx, dy in cells])), F.lit(len(cells) // 2))))


def pyramid(images: DataFrame, levels: int) -> DataFrame:
    """image_id, level, width, height, pixels: each level half as wide and high as the one before (nearest), from level 0, the image."""
    def at(level: int) -> DataFrame:
        step = 2**level
        w, h = (F.greatest(F.floor(F.col(c) / step), F.lit(1)).cast("int") for c in ("w_", "h_"))
        source = F.transform(F.sequence(F.lit(0), w * h - 1), lambda i: F.get("pixels", (F.floor(i / w) * step * F.col("w_") + i % w * step).cast("int")))
        return images.withColumnsRenamed({"width": "w_", "height": "h_"}).select("image_id", F.lit(level).alias("level"), w.alias("width"), h.alias("height"), source.alias("pixels"))

    out = at(0)
    for level in range(1, levels):
        out = out.unionByName(at(level))
    return out


def scene_changes(images: DataFrame, order: str, threshold: float) -> DataFrame:
    """image_id, order, change: images whose mean absolute difference to the one before (by clip_id and order) is over threshold.

    The window carries one array from row to row within a clip.
    """
    from pyspark.sql import Window

    before = F.lag("pixels").over(Window.partitionBy("clip_id").orderBy(order))
    paired = images.withColumn("before_", before).filter("before_ is not null")
    gaps = paired.withColumn("gaps_", F.zip_with("pixels", "before_", lambda a, b: F.abs(a - b)))
    change = F.aggregate("gaps_", F.lit(0.0), lambda a, x: a + x) / F.size("gaps_")
    return gaps.withColumn("change", change).filter(F.col("change") > threshold).select("image_id", "clip_id", order, "change")


def temporal_smoothing(masks: DataFrame, width: int = 3) -> DataFrame:
    """Pixels of an object's mask (obj_id, x, y, frame_idx, v) averaged over ``width`` frames around each, as far as there are any."""
    from pyspark.sql import Window

    around = Window.partitionBy("obj_id", "x", "y").orderBy("frame_idx").rangeBetween(-(width // 2), width // 2)
    return masks.withColumn("v", F.avg("v").over(around))
