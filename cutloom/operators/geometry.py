"""Rings, shapes and features: measures, smoothing, simplification, holes.

A ring is ARRAY<STRUCT<x DOUBLE, y DOUBLE>>. What is local to a ring is a column expression; border following,
Douglas-Peucker, Visvalingam-Whyatt and hulls, which are sequential, are small Python steps over Arrow batches.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutloom.tables import materialize

RING = "array<struct<x:double,y:double>>"


def _at(ring: Column, i) -> Column:
    return F.get(ring, i)


def _sum(ring: Column, upto: Column, term: Callable[[Column], Column]) -> Column:
    return F.when(upto > 0, F.aggregate(F.sequence(F.lit(0), F.greatest(upto - 1, F.lit(0))), F.lit(0.0), lambda a, i: a + term(i))).otherwise(F.lit(0.0))


def _cross(ring: Column, i: Column) -> Column:
    a, b = _at(ring, i), _at(ring, (i + 1) % F.size(ring))
    return a["x"] * b["y"] - b["x"] * a["y"]


def signed_area(ring: Column) -> Column:
    """Shoelace sum over 2, the ring closed; 0 for fewer than 3 points."""
    return F.when(F.size(ring) < 3, F.lit(0.0)).otherwise(_sum(ring, F.size(ring), lambda i: _cross(ring, i)) / 2)


def ring_area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def ring_perimeter(ring: Column) -> Column:
    """Lengths of the stored edges; the closing edge isn't counted."""
    step = lambda i: F.sqrt(F.pow(_at(ring, i + 1)["x"] - _at(ring, i)["x"], 2) + F.pow(_at(ring, i + 1)["y"] - _at(ring, i)["y"], 2))
    return _sum(ring, F.size(ring) - 1, step)


def bounding_box(ring: Column) -> Column:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def centroid(ring: Column) -> Column:
    """Area-weighted; the middle of the bounding box where the area is 0."""
    n, area = F.size(ring), signed_area(ring)
    part = lambda c: _sum(ring, n, lambda i: (_at(ring, i)[c] + _at(ring, (i + 1) % n)[c]) * _cross(ring, i)) / (6 * area)
    box = bounding_box(ring)
    flat = area == 0
    return F.struct(F.when(flat, (box["x0"] + box["x1"]) / 2).otherwise(part("x")).alias("x"), F.when(flat, (box["y0"] + box["y1"]) / 2).otherwise(part("y")).alias("y"))


def shape_area(exterior: Column, holes: Column) -> Column:
    return ring_area(exterior) - F.aggregate(holes, F.lit(0.0), lambda a, h: a + ring_area(h))


def shape_perimeter(exterior: Column, holes: Column) -> Column:
    return ring_perimeter(exterior) + F.aggregate(holes, F.lit(0.0), lambda a, h: a + ring_perimeter(h))


def decimate(ring: Column, step: int = 2) -> Column:
    """Every step-th point; none of a ring that had fewer than 3."""
    return F.when(F.size(ring) < 3, F.array().cast(RING)).otherwise(F.filter(ring, lambda p, i: i % step == 0))


def smooth(ring: Column, width: int = 3) -> Column:
    """Mean of each point's window of ``width``, around the ring; rings of up to width points stay."""
    n, half = F.size(ring), width // 2
    mean = lambda i, c: sum((_at(ring, (i + k + n) % n)[c] for k in range(-half, width - half)), F.lit(0.0)) / width
    return F.when(n > width, F.transform(ring, lambda p, i: F.struct(mean(i, "x").alias("x"), mean(i, "y").alias("y")))).otherwise(ring)


def chaikin(ring: Column) -> Column:
    """One corner cut: each stored edge gives its points at a quarter and at three quarters, between the two ends, which stay."""
    n = F.size(ring)
    point = lambda i, w, c: _at(ring, i)[c] * (1 - w) + _at(ring, i + 1)[c] * w
    cut = lambda i, w: F.struct(point(i, w, "x").alias("x"), point(i, w, "y").alias("y"))
    inner = F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), lambda i: F.array(cut(i, 0.25), cut(i, 0.75))))
    return F.when(n >= 3, F.concat(F.array(_at(ring, 0)), inner, F.array(_at(ring, n - 1)))).otherwise(ring)


def chaikin_rounds(df: DataFrame, column: str, rounds: int) -> DataFrame:
    """chaikin ``rounds`` times, each a column of its own so that no round is computed within another."""
    for _ in range(rounds):
        df = df.withColumn(column, chaikin(F.col(column)))
    return df


def round_ring(ring: Column) -> Column:
    from cutloom.functions.scalars import round_coordinate

    return F.transform(ring, lambda p: F.struct(round_coordinate(p["x"]).alias("x"), round_coordinate(p["y"]).alias("y")))


def valid_ring(ring: Column) -> Column:
    """The ring, or an empty one if it has fewer than 3 points or one that isn't finite."""
    odd = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    bad = (F.size(ring) < 3) | F.exists(ring, lambda p: odd(p["x"]) | odd(p["y"]))
    return F.when(bad, F.array().cast(RING)).otherwise(ring)


def over_area(df: DataFrame, ring: str = "ring", least: float = 10.0, digits: int | None = None) -> DataFrame:
    """Rows whose ring has at least that area, rounded to ``digits`` first where given. The area is unnested, so that the filter doesn't take the ring's computation into its lambda."""
    area = ring_area(F.col(ring))
    sized = df.withColumn("area_", F.explode_outer(F.array(area if digits is None else F.round(area, digits))))
    return sized.filter(F.col("area_") >= least).drop("area_")


BOX = ("image_id", "x0", "y0", "x1", "y1")


def one_of_each_box(boxes: DataFrame) -> DataFrame:
    """BOX, shape_id, area: equal boxes of an image as one, of the least id. They hold and are held by the same ones, and none of them holds another strictly."""
    one = boxes.groupBy(*BOX).agg(F.min("shape_id").alias("shape_id"))
    return one.withColumn("area", (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))


def box_pairs(boxes: DataFrame, cell: int = 64) -> DataFrame:
    """Aliases o and i of boxes where o holds i strictly. They meet in the cells of a grid: a holder covers the cell of its content's lower corner, so the join is an
    equi-join on (image, cell). A box in every cell it covers is far more than the file it comes from, so no side is ever broadcast."""
    cover = lambda a, b: F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell))
    outer = boxes.withColumn("cx", F.explode(cover("x0", "x1"))).withColumn("cy", F.explode(cover("y0", "y1"))).alias("o")
    inner = boxes.withColumns({"cx": F.floor(F.col("x0") / cell), "cy": F.floor(F.col("y0") / cell)}).alias("i")
    o, i = (lambda c: F.col(f"o.{c}")), (lambda c: F.col(f"i.{c}"))
    inside = (o("x0") < i("x0")) & (o("y0") < i("y0")) & (o("x1") > i("x1")) & (o("y1") > i("y1"))
    return inner.join(outer.hint("merge"), (i("image_id") == o("image_id")) & (i("cx") == o("cx")) & (i("cy") == o("cy")) & inside)


def contained_boxes(boxes: DataFrame) -> DataFrame:
    """image_id, shape_id, area, owner_id of rectangles: the greedy claim of contours by the largest that holds them.

    Shapes go by area, largest first (ties by id); each that none has claimed claims all later ones inside it.
    Strict containment is transitive, so a shape's owner is simply the first shape that holds it. Only different boxes meet.
    """
    one = materialize(one_of_each_box(boxes), "boxes")
    owner = box_pairs(one).groupBy(*(F.col(f"i.{c}").alias(c) for c in BOX)).agg(F.max(F.struct(F.col("o.area").alias("area"), (-F.col("o.shape_id")).alias("back"))).alias("own"))
    sized = boxes.select(*BOX, "shape_id", ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("area"))
    return sized.join(owner.hint("merge"), list(BOX), "left").select("image_id", "shape_id", "area", (-F.col("own.back")).alias("owner_id"))


#: Up to so many points Python is faster than NumPy.
SHORT = 40


def douglas_peucker(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Ends stay; a stretch keeps its farthest point if that is over tolerance away (the first of equals)."""
    if len(points) < 3:
        return points
    keep = np.zeros(len(points), bool)
    keep[[0, -1]] = True
    stack = [(0, len(points) - 1)]
    xs, ys = points.T.tolist()
    usual = bool(np.abs(points).max() < 1e150)
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        px, py = xs[a], ys[a]
        dx, dy = xs[b] - px, ys[b] - py
        if usual and b - a <= SHORT and (dx or dy) and (length := math.sqrt(dx**2 + dy**2)):
            farthest, k = -1.0, 0
            for n in range(a + 1, b):
                away = abs(dx * (ys[n] - py) - dy * (xs[n] - px)) / length
                if away > farthest:
                    farthest, k = away, n - a - 1
        else:
            p, q, mid = points[a], points[b], points[a + 1 : b]
            d, off = q - p, (mid - p).T
            length = float(np.sqrt(d[0] ** 2 + d[1] ** 2))  # by pow, as SQL has it: in hypot the last digit differs, and points of one edge are equally far
            far = np.hypot(*off) if length == 0 else np.abs(d[0] * off[1] - d[1] * off[0]) / length
            k = int(np.argmax(far))
            farthest = far[k]
        if farthest > tolerance:
            keep[a + 1 + k] = True
            stack += [(a, a + 1 + k), (a + 1 + k, b)]
    return points[keep]


def visvalingam(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Removes the point of least triangle area, again and again, while that is under tolerance (the first of equals); ends stay."""
    n = len(points)
    if n < 3:
        return points
    left, right, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n

    def area(k):
        (ax, ay), (bx, by), (cx, cy) = points[left[k]], points[k], points[right[k]]
        return abs((bx - ax) * (cy - ay) - (cx - ax) * (by - ay)) / 2

    now = {k: area(k) for k in range(1, n - 1)}
    heap = [(a, k) for k, a in now.items()]
    heapq.heapify(heap)
    while heap:
        a, k = heapq.heappop(heap)
        if not alive[k] or now[k] != a:
            continue
        if a >= tolerance:
            break
        alive[k] = False
        right[left[k]], left[right[k]] = right[k], left[k]
        for m in (left[k], right[k]):
            if 0 < m < n - 1:
                now[m] = area(m)
                heapq.heappush(heap, (now[m], m))
    return points[np.array(alive)]


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Monotone chain, counter-clockwise, closed; degenerate inputs give their distinct points, closed."""
    distinct = sorted(set(map(tuple, points.tolist())))
    if len(distinct) < 3:
        return np.array([*distinct, *distinct[:1]])

    def chain(order):
        out: list[tuple[float, float]] = []
        for p in order:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    hull = chain(distinct) + chain(reversed(distinct))
    return np.array([*hull, hull[0]])


SLICE = 256


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most SLICE rows, so that a step's Python values are those of few rows, however large the batches that Spark makes."""
    for batch in batches:
        for k in range(0, batch.num_rows, SLICE):
            yield batch.slice(k, SLICE)


def ring_arrays(column: pa.Array) -> list[np.ndarray]:
    """Points (n x 2) of each ring of a column; null rings have none, null coordinates are NaN."""
    flat = column.flatten()
    xy = np.stack([flat.field(k).to_numpy(zero_copy_only=False).astype(float) for k in (0, 1)], 1)
    ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))]).astype(int)
    return [xy[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def ring_column(rings: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate([np.asarray(r, float).reshape(-1, 2) for r in rings]) if rings else np.zeros((0, 2))
    ends = pa.array(np.concatenate([[0], np.cumsum([len(r) for r in rings])]).astype(np.int32))
    return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(flat[:, k].copy()) for k in (0, 1)], ["x", "y"]))


def map_rings(df: DataFrame, fn: Callable[[np.ndarray], np.ndarray], id_col: str = "shape_id", ring_col: str = "ring") -> DataFrame:
    """id and fn(ring) for every row, in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), ring_column([fn(r) for r in ring_arrays(batch.column(1))])], [id_col, ring_col])

    picked = df.select(id_col, ring_col)
    return picked.mapInArrow(run, f"{id_col} {picked.schema[id_col].dataType.simpleString()}, {ring_col} {RING}")


#: Clockwise on a screen, from east.
_AROUND = [(1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1)]


def contours(image: np.ndarray) -> list[np.ndarray]:
    """Borders of the 8-connected on-regions and of their holes, by border following (Suzuki and Abe), as closed walks of (x, y) without the last point again."""
    h, w = image.shape
    wide = w + 2
    on = np.zeros((h + 2, wide), bool)
    on[1:-1, 1:-1] = image > 0
    f = on.ravel().astype(int).tolist()  # a list: single values are read, which arrays are slow at
    step = [dx + dy * wide for dx, dy in _AROUND]
    number, out = 1, []
    for start in np.flatnonzero(on.ravel() & ~(np.roll(on.ravel(), 1) & np.roll(on.ravel(), -1))).tolist():
        outer = f[start] == 1 and f[start - 1] == 0
        if not outer and not (f[start] >= 1 and f[start + 1] == 0):
            continue
        number += 1
        walk = [start]
        turn = next((k % 8 for k in range(4 if outer else 0, 12 if outer else 8) if f[start + step[k % 8]]), None)
        if turn is None:
            f[start] = -number
        else:
            first, at, back = start + step[turn], start, turn
            while True:
                east_was_off = False
                for k in range(back - 1, back - 9, -1):
                    if f[at + step[k % 8]]:
                        break
                    east_was_off |= k % 8 == 0
                following = at + step[k % 8]
                if east_was_off:
                    f[at] = -number
                elif f[at] == 1:
                    f[at] = number
                if following == start and at == first:
                    break
                at, back = following, (k + 4) % 8
                walk.append(at)
        out.append(np.stack(np.divmod(np.array(walk), wide)[::-1], 1).astype(float) - 1)
    return out


def image_contours(images: DataFrame, t: float = 0.0) -> DataFrame:
    """image_id, contour (from 0), ring: the borders of the pixels over t of every image."""

    def run(batches):
        for batch in slices(batches):
            ids, numbers, rings = [], [], []
            for k, (w, h, values) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True)):
                for n, ring in enumerate(contours(np.array(values, float).reshape(h, w) > t)):
                    ids.append(k)
                    numbers.append(n)
                    rings.append([{"x": x, "y": y} for x, y in ring.tolist()])
            kind = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int32())), pa.array(numbers, pa.int32()), pa.array(rings, kind)], ["image_id", "contour", "ring"])

    picked = images.select("image_id", "width", "height", "pixels")
    return picked.mapInArrow(run, f"image_id {picked.schema['image_id'].dataType.simpleString()}, contour int, ring {RING}")


def points_of(df: DataFrame, id_col: str = "shape_id", ring: str = "ring", digits: int = 5) -> DataFrame:
    long = df.select(id_col, F.posexplode_outer(ring).alias("k", "p")).filter("k is not null")
    return long.select(id_col, "k", (F.round("p.x", digits) + 0.0).alias("x"), (F.round("p.y", digits) + 0.0).alias("y"))


def top_features(df: DataFrame, n: int) -> DataFrame:
    """The n features of greatest area (ties by id): a bounded heap in each task, then one merge."""
    return df.orderBy(F.desc("area"), "shape_id").limit(n)


def largest_by(df: DataFrame, by: str) -> DataFrame:
    """Of each group the feature of greatest area, the last (greatest id) of equals."""
    best = df.groupBy(by).agg(F.max(F.struct("area", "shape_id")).alias("b"))
    return best.select(by, F.col("b.shape_id").alias("shape_id"), F.col("b.area").alias("area"))

