"""Connected regions of images: areas, boxes, hole filling, removal of small regions, Canny edges.

Images are cut into tiles, so that one large mask is the work of many tasks. In a tile, runs of pixels are joined by union-find;
across tile borders, local labels become edges where their runs touch, and connected components of these edges give the regions. A region is
named by its first pixel's number in row order (y * width + x). Nothing larger than a tile's pixels is ever in one Python step.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutloom.operators import raster as R
from cutloom.operators.components import components
from cutloom.tables import materialize

TILE = 512
SPLIT = ("image_id", "ty", "tx")


def to_tiles(images: DataFrame, size: int = TILE) -> DataFrame:
    """image_id, ty, tx, x0, y0, w, h (of the tile), width, height (of the image), pixels: each image as tiles of size x size, smaller at the right and lower edge."""
    c = F.col
    many = lambda n: F.sequence(F.lit(0), F.ceil(c(n) / size).cast("int") - 1)
    full = images.filter((c("width") > 0) & (c("height") > 0)).select("image_id", "width", "height", F.col("pixels").alias("whole"))
    cut = full.withColumn("ty", F.explode(many("height"))).withColumn("tx", F.explode(many("width")))
    cut = cut.withColumns({"x0": c("tx") * size, "y0": c("ty") * size})
    cut = cut.withColumns({"w": F.least(F.lit(size), c("width") - c("x0")), "h": F.least(F.lit(size), c("height") - c("y0"))})
    rows = F.transform(F.sequence(F.lit(0), c("h") - 1), lambda y: F.slice("whole", (c("y0") + y) * c("width") + c("x0") + 1, c("w")))
    return cut.select(*SPLIT, "x0", "y0", "w", "h", "width", "height", F.flatten(rows).alias("pixels"))


def from_tiles(tiles: DataFrame) -> DataFrame:
    """image_id, width, height, pixels: the images put together again, each in one row."""
    c = F.col
    rows = F.transform(F.sequence(F.lit(0), c("h") - 1), lambda y: F.struct((c("y0") + y).alias("y"), c("x0").alias("x"), F.slice("pixels", y * c("w") + 1, c("w")).alias("p")))
    whole = tiles.select("image_id", "width", "height", rows.alias("rows")).groupBy("image_id", "width", "height").agg(F.flatten(F.collect_list("rows")).alias("rows"))
    return whole.select("image_id", "width", "height", F.flatten(F.transform(F.array_sort("rows"), lambda r: r["p"])).alias("pixels"))


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of each maximal run of the mask's rows, in row order."""
    change = np.diff(np.pad(mask, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, start = np.nonzero(change == 1)
    return row, start, np.nonzero(change == -1)[1]


def joined(row: np.ndarray, start: np.ndarray, end: np.ndarray, width: int, reach: int) -> np.ndarray:
    """For each run the first one it hangs together with; runs of neighbouring rows touch if they overlap, by reach (1: corners count) farther."""
    stride = width + 4
    above = (row - 1) * stride
    lo = np.searchsorted(row * stride + end, above + start - reach, "right")
    hi = np.searchsorted(row * stride + start, above + end + reach, "left")
    root = list(range(len(row)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for b in np.flatnonzero(hi > lo).tolist():
        for a in range(int(lo[b]), int(hi[b])):
            x, y = find(a), find(b)
            if x != y:
                root[max(x, y)] = min(x, y)
    return np.array([find(x) for x in range(len(row))], np.int64)


def tile_labels(values: np.ndarray, t: float, on: bool, reach: int) -> tuple[np.ndarray, ...]:
    """Row, start, end and label (the number of the label's first run) of each run of pixels over t (of the others, if not on)."""
    row, start, end = runs((values > t) == on)
    return row, start, end, joined(row, start, end, values.shape[1], reach)


BORDER = pa.struct([("side", pa.string()), ("line", pa.int32()), ("bucket", pa.int32()), ("later", pa.bool_()), ("lo", pa.int32()), ("hi", pa.int32())])
LABELS = pa.schema([("first", pa.int64()), ("area", pa.int64()), ("left", pa.int32()), ("top", pa.int32()), ("right", pa.int32()), ("bottom", pa.int32()), ("most", pa.float64()), ("touches", pa.bool_()), ("borders", pa.list_(BORDER))])
LABELS_SQL = "first long, area long, left int, top int, right int, bottom int, most double, touches boolean, borders array<struct<side:string,line:int,bucket:int,later:boolean,lo:int,hi:int>>"


def _tiles(batch: pa.RecordBatch):
    names = ("ty", "tx", "x0", "y0", "w", "h", "width", "height")
    for k, place in enumerate(zip(*[batch.column(c).to_pylist() for c in names], strict=True)):
        at = dict(zip(names, place, strict=True))
        yield k, at, np.asarray(batch.column("pixels")[k].values, np.float64).reshape(at["h"], at["w"])


def _borders(at: dict, row, start, end, label) -> dict[int, list[dict]]:
    """Of each label, the stretches where it reaches a neighbouring tile: along lower and upper edges in global x (also for the tiles beside, where a corner may touch), along left and right ones in global y."""
    found: dict[int, list[dict]] = {}
    ends = ("row", "line", True, at["y0"] > 0, 0, at["ty"] - 1), ("row", "line", False, at["y0"] + at["h"] < at["height"], at["h"] - 1, at["ty"])
    for _, _, later, there, y, line in ends:
        for k in np.flatnonzero(row == y).tolist() if there else []:
            a, b = int(start[k]) + at["x0"], int(end[k]) + at["x0"]
            beside = [at["tx"], *([at["tx"] - 1] if start[k] == 0 and at["tx"] else []), *([at["tx"] + 1] if end[k] == at["w"] and at["x0"] + at["w"] < at["width"] else [])]
            found.setdefault(int(label[k]), []).extend({"side": "row", "line": line, "bucket": x, "later": later, "lo": a, "hi": b} for x in beside)
    for later, there, touching, line in ((True, at["x0"] > 0, start == 0, at["tx"] - 1), (False, at["x0"] + at["w"] < at["width"], end == at["w"], at["tx"])):
        for k in np.flatnonzero(touching).tolist() if there else []:
            y = int(row[k]) + at["y0"]
            found.setdefault(int(label[k]), []).append({"side": "column", "line": line, "bucket": at["ty"], "later": later, "lo": y, "hi": y + 1})
    return found


def _labelled(batches, t: float, on: bool, reach: int):
    for batch in batches:
        of, out = [], []
        for k, at, values in _tiles(batch):
            row, start, end, label = tile_labels(values, t, on, reach)
            if not len(row):
                continue
            y, a, b = row + at["y0"], start + at["x0"], end + at["x0"]
            flat = np.append(values.ravel(), -np.inf)
            most = np.maximum.reduceat(flat, np.stack([row * at["w"] + start, row * at["w"] + end], 1).ravel())[::2]
            edge = (y == 0) | (y == at["height"] - 1) | (a == 0) | (b == at["width"])
            names, own = np.unique(label, return_inverse=True)
            n = len(names)
            area = np.bincount(own, b - a, n).astype(np.int64)
            low, high = {}, {}
            for name, v in (("x", a), ("y", y)):
                low[name] = np.full(n, np.iinfo(np.int64).max)
                np.minimum.at(low[name], own, v)
            for name, v in (("x", b - 1), ("y", y), ("most", most), ("edge", edge.astype(int))):
                high[name] = np.full(n, -np.inf if name == "most" else -1, v.dtype)
                np.maximum.at(high[name], own, v)
            borders = _borders(at, row, start, end, label)
            for i, name in enumerate(names.tolist()):
                of.append(k)
                first = int(y[name]) * at["width"] + int(a[name])
                out.append({"first": first, "area": int(area[i]), "left": int(low["x"][i]), "top": int(low["y"][i]), "right": int(high["x"][i]), "bottom": int(high["y"][i]), "most": float(high["most"][i]), "touches": bool(high["edge"][i]), "borders": borders.get(name, [])})
        rows = pa.RecordBatch.from_pylist(out, LABELS)
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(of, pa.int32())) for c in SPLIT), *rows.columns], [*SPLIT, *LABELS.names])


def labels(tiles: DataFrame, t: float = 0.0, on: bool = True, diagonal: bool = True) -> DataFrame:
    """SPLIT, first, region and the measures of each tile's labels: pixels over t that hang together (of the others, if not on), by corners too if diagonal."""
    c, reach = F.col, int(diagonal)
    kind = tiles.schema["image_id"].dataType.simpleString()
    local = tiles.mapInArrow(lambda b: _labelled(b, t, on, reach), f"image_id {kind}, ty int, tx int, {LABELS_SQL}")
    local = materialize(local, "labels")
    border = local.select("image_id", "first", F.explode("borders").alias("b")).select("image_id", "first", "b.*")
    one, two = border.filter("not later").alias("one"), border.filter("later").alias("two")
    meet = [c(f"one.{k}") == c(f"two.{k}") for k in ("image_id", "side", "line", "bucket")]
    touch = (c("one.lo") < c("two.hi") + reach) & (c("two.lo") < c("one.hi") + reach)
    vertex = lambda side: F.struct(c(f"{side}.image_id").alias("image_id"), c(f"{side}.first").alias("first"))
    roots = components(one.join(two.hint("merge"), [*meet, touch]).select(vertex("one").alias("u"), vertex("two").alias("v")))
    roots = roots.select(c("v.image_id").alias("of_image"), c("v.first").alias("of_first"), c("root.first").alias("root"))
    met = local.drop("borders").join(roots.hint("merge"), (c("image_id") == c("of_image")) & (c("first") == c("of_first")), "left")
    return met.withColumn("region", F.coalesce("root", "first")).drop("of_image", "of_first", "root")


def measured(found: DataFrame) -> DataFrame:
    """image_id, region, area, left, top, right, bottom, most (the largest value), touches (the image's border) of each region of labels()."""
    sums = [F.sum("area").alias("area"), *[F.min(x).alias(x) for x in ("left", "top")], *[F.max(x).alias(x) for x in ("right", "bottom", "most", "touches")]]
    return found.groupBy("image_id", "region").agg(*sums)


def regions(images: DataFrame, t: float = 0.0, diagonal: bool = True, size: int = TILE) -> DataFrame:
    """measured() of the regions of pixels over t. Images of no pixels have none."""
    return measured(labels(to_tiles(images, size), t, True, diagonal))


def _redrawn(batches, t: float, on: bool, reach: int, value: float):
    for batch in batches:
        out = []
        for k, at, values in _tiles(batch):
            row, start, end, label = tile_labels(values, t, on, reach)
            name = (row[label] + at["y0"]) * at["width"] + start[label] + at["x0"] if len(row) else row
            chosen = np.isin(name, np.asarray(batch.column("chosen")[k].values if batch.column("chosen")[k].is_valid else [], np.int64))
            values = values.copy()
            for y, a, b in zip(row[chosen].tolist(), start[chosen].tolist(), end[chosen].tolist(), strict=True):
                values[y, a:b] = value
            out.append(values.ravel())
        ends = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int32)
        pixels = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(out) if out else np.zeros(0)))
        names = [c for c in batch.schema.names if c not in ("pixels", "chosen")]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pixels], [*names, "pixels"])


def redraw(tiles: DataFrame, which: Column, value: float, t: float = 0.0, on: bool = True, diagonal: bool = True) -> DataFrame:
    """tiles with the pixels of the regions for which ``which`` (over the columns of measured()) holds set to value."""
    found = materialize(labels(tiles, t, on, diagonal), "regions")
    chosen = measured(found).filter(which).select("image_id", "region")
    of = found.join(chosen.hint("merge"), ["image_id", "region"]).groupBy(*SPLIT).agg(F.collect_list("first").alias("chosen"))  # at most a tile's pixels
    kind = tiles.schema["image_id"].dataType.simpleString()
    schema = f"image_id {kind}, ty int, tx int, x0 int, y0 int, w int, h int, width int, height int, pixels array<double>"
    names = [*SPLIT, "x0", "y0", "w", "h", "width", "height", "pixels"]
    joined_ = tiles.select(*names).join(of.hint("merge"), list(SPLIT), "left").select(*names, "chosen")
    return joined_.mapInArrow(lambda b: _redrawn(b, t, on, int(diagonal), value), schema)


def fill_holes(images: DataFrame, t: float = 0.0, value: float = 1.0, size: int = TILE) -> DataFrame:
    """Images whose holes (regions of pixels up to t, joined by edges, that don't reach the image's border) are set to value."""
    return from_tiles(redraw(to_tiles(images, size), ~F.col("touches"), value, t, on=False, diagonal=False))


def without_small(images: DataFrame, least: int, t: float = 0.0, size: int = TILE) -> DataFrame:
    """Images without the regions (pixels over t, joined by corners too) of fewer than least pixels: those become 0."""
    return from_tiles(redraw(to_tiles(images, size), F.col("area") < least, 0.0, t))


def thin_edges(images: DataFrame) -> DataFrame:
    """Gradient magnitude (Sobel) where it is largest across the edge, 0 elsewhere.

    The direction is the gradient's, rounded to one of four; of equal neighbours along it the one further on (right, below) stays.
    """
    flat, steep = 2**0.5 - 1, 2**0.5 + 1
    both = images.withColumns({"gx_": R.weighted("pixels", R.SOBEL_X), "gy_": R.weighted("pixels", R.SOBEL_Y)})
    both = both.withColumn("pixels", F.zip_with("gx_", "gy_", lambda a, b: F.sqrt(a * a + b * b)))

    def kept(i: Column) -> Column:
        gx, gy, own = F.get("gx_", i.cast("int")), F.get("gy_", i.cast("int")), F.get("pixels", i.cast("int"))
        ax, ay = F.abs(gx), F.abs(gy)
        peak = lambda dx, dy: (own >= R.tap("pixels", i, -dx, -dy)) & (own > R.tap("pixels", i, dx, dy))
        top = F.when(ay <= ax * flat, peak(1, 0)).when(ay >= ax * steep, peak(0, 1)).when(gx * gy > 0, peak(1, 1)).otherwise(peak(-1, 1))
        return F.when(top, own).otherwise(F.lit(0.0))

    return both.withColumn("thin_", R.each_pixel(kept)).withColumn("pixels", F.col("thin_")).drop("gx_", "gy_", "thin_")


def canny(images: DataFrame, radius: int = 1, weak: float = 0.1, strong: float = 0.3, size: int = TILE) -> DataFrame:
    """1 where an edge is: of the blurred image's thin edges over weak, those that hang together with one over strong; 0 elsewhere."""
    thin = to_tiles(thin_edges(R.gaussian_blur(images, radius)), size)
    edges = redraw(thin, F.col("most") <= strong, 0.0, weak)
    return R.threshold(from_tiles(edges), weak)
