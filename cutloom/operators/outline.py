"""Mask outlines: a pipeline from images to shapes with holes, its builder, presets and commands.

``Pipeline.run`` is a DataFrame transform. Preprocessors are raster expressions, contours come from one Arrow map over
images, holes are claimed within an image's own contours in the same map, and postprocessors are ring
functions. Rows are (image_id, shape_id, exterior, holes).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cutloom.operators import geometry as G
from cutloom.operators import raster as R
from cutloom.operators.claims import inside
from cutloom.sources.errors import UnknownExtractor

RINGS = f"array<{G.RING}>"

# The commands, what they say, and their parameters (name, description).
COMMANDS = {
    "extract_outline": ("Extract basic polyline outline from mask image", ()),
    "extract_outline_with_simplification": ("Extract outline with Douglas-Peucker simplification to reduce point count", (("tolerance", "Simplification tolerance (0.1-10.0, higher = more simplified)"),)),
    "extract_outline_with_hole_detection": ("Extract outline with hole detection for complex shapes like donuts", ()),
    "extract_outline_with_custom_extractor": ("Extract outline using a named custom extraction algorithm", (("extractor_name", "Name of the custom extractor to use"),)),
}


def _area(ring: np.ndarray) -> float:
    x, y = ring.T
    return abs(float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1)))) / 2 if len(ring) > 2 else 0.0


def _claims(contours: list[np.ndarray], may: Callable[[float, float], bool]) -> list[tuple[np.ndarray, list[np.ndarray]]]:
    """Largest first, each contour that none has claimed claims all others inside it of whose area, and its own, ``may`` says so. Areas and boxes are taken once; only what lies in a box is looked at by points."""
    areas = [_area(c) for c in contours]
    order = sorted(range(len(contours)), key=areas.__getitem__, reverse=True)
    boxes = [(*c.min(0), *c.max(0)) if len(c) else None for c in contours]
    free, out = [True] * len(contours), []
    for k, o in enumerate(order):
        if not free[o]:
            continue
        free[o], holes, box = False, [], boxes[o]
        slack = 1e-9 * max(map(abs, box)) if box else 0.0
        for i in order[k + 1 :]:
            if not free[i] or not may(areas[i], areas[o]):
                continue
            if boxes[i] and box and np.isfinite(slack) and not (boxes[i][0] >= box[0] - slack and boxes[i][1] >= box[1] - slack and boxes[i][2] <= box[2] + slack and boxes[i][3] <= box[3] + slack):
                continue
            if inside(contours[i], contours[o]).all():
                free[i] = False
                holes.append(contours[i])
        out.append((contours[o], holes))
    return out


def containment_holes(contours: list[np.ndarray]) -> list[tuple[np.ndarray, list[np.ndarray]]]:
    """Largest first, each contour that none has claimed claims all others inside it. One of no area holds nothing; islands within holes are holes too."""
    return _claims(contours, lambda inner, outer: outer > 0)


def area_based_holes(contours: list[np.ndarray], least: float = 0.01, most: float = 0.8) -> list[tuple[np.ndarray, list[np.ndarray]]]:
    """As containment_holes, but a claim also needs an area ratio of least to most."""
    return _claims(contours, lambda inner, outer: least <= (inner / outer if outer else 0.0) <= most)


def no_holes(contours: list[np.ndarray]) -> list[tuple[np.ndarray, list[np.ndarray]]]:
    return [(c, []) for c in contours]


def _each_ring(fn: Callable[[Column], Column]) -> Callable[[DataFrame], DataFrame]:
    return lambda shapes: shapes.withColumns({"exterior": fn(F.col("exterior")), "holes": F.transform("holes", fn)})


def _each_ring_python(fn: Callable[[np.ndarray], np.ndarray]) -> Callable[[DataFrame], DataFrame]:
    turned = lambda rings: G.ring_column([fn(r) for r in G.ring_arrays(rings)])

    def run(batches):
        for batch in G.slices(batches):
            holes = batch.column(3)
            ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(holes), 0).to_numpy(zero_copy_only=False))])
            held = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), turned(holes.flatten()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), turned(batch.column(2)), held], ["image_id", "shape_id", "exterior", "holes"])

    return lambda shapes: shapes.select("image_id", "shape_id", "exterior", "holes").mapInArrow(run, shapes.select("image_id", "shape_id", "exterior", "holes").schema)


def threshold_step(t: float = 128) -> Callable[[DataFrame], DataFrame]:
    return lambda images: R.threshold(images, t, 255.0)


def adaptive_threshold_step(block: int = 11, c: float = 2.0) -> Callable[[DataFrame], DataFrame]:
    """On where the pixel is over its block's mean less c (a real one, where a fixed threshold would be a stub)."""
    radius = block // 2

    def run(images: DataFrame) -> DataFrame:
        both = images.withColumn("mean_", R.weighted("pixels", dict.fromkeys(R.window(radius), 1.0 / (2 * radius + 1) ** 2)))
        return both.withColumn("pixels", F.zip_with("pixels", "mean_", lambda v, m: F.when(v > m - c, F.lit(255.0)).otherwise(F.lit(0.0)))).drop("mean_")

    return run


def blur_step(sigma: float = 1.0) -> Callable[[DataFrame], DataFrame]:
    return lambda images: R.blur_by_sigma_batches(images, sigma)


def minimum_area_step(least: float = 10.0) -> Callable[[DataFrame], DataFrame]:
    return lambda shapes: shapes.filter(G.shape_area(F.col("exterior"), F.col("holes")) >= least)


def validate_step(shapes: DataFrame) -> DataFrame:
    """Exteriors of fewer than 3 points or with one that isn't finite become empty; such holes go."""
    return shapes.withColumns({"exterior": G.valid_ring(F.col("exterior")), "holes": F.filter(F.transform("holes", G.valid_ring), lambda h: F.size(h) > 0)})


def hull_step(shapes: DataFrame) -> DataFrame:
    return _each_ring_python(G.convex_hull)(shapes).withColumn("holes", F.array().cast(RINGS))


EXTRACTORS: dict[str, Callable[[np.ndarray], list[np.ndarray]]] = {"border": G.contours}


def register_extractor(name: str, fn: Callable[[np.ndarray], list[np.ndarray]]) -> None:
    """fn: a 0/1 image to its contours."""
    EXTRACTORS[name] = fn


@dataclass
class Pipeline:
    """Steps from images to shapes; run() is lazy."""

    preprocessors: list[Callable[[DataFrame], DataFrame]] = field(default_factory=list)
    extractor: str = "border"
    holes: Callable = containment_holes
    postprocessors: list[Callable[[DataFrame], DataFrame]] = field(default_factory=list)

    def info(self) -> str:
        return f"{len(self.preprocessors)} preprocessors, {self.extractor} contours, {self.holes.__name__}, {len(self.postprocessors)} postprocessors"

    def run(self, images: DataFrame) -> DataFrame:
        if self.extractor not in EXTRACTORS:
            raise UnknownExtractor(self.extractor)
        for step in self.preprocessors:
            images = step(images)
        shapes = _shapes(images, EXTRACTORS[self.extractor], self.holes)
        for step in self.postprocessors:
            shapes = step(shapes)
        return shapes.filter(F.size("exterior") > 0)


def _shapes(images: DataFrame, extract: Callable, holes: Callable) -> DataFrame:
    def run(batches):
        for batch in G.slices(batches):
            at, number, outer, inner, many = [], [], [], [], [0]
            for k, (w, h, values) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True)):
                image = np.asarray(values.values.to_numpy(zero_copy_only=False), float).reshape(h, w) > 0
                for n, (exterior, own) in enumerate(holes(extract(image))):
                    at.append(k)
                    number.append(n)
                    outer.append(exterior)
                    inner += own
                    many.append(len(inner))
            held = pa.ListArray.from_arrays(pa.array(many, pa.int32()), G.ring_column(inner))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), pa.array(number, pa.int32()), G.ring_column(outer), held], ["image_id", "shape_id", "exterior", "holes"])

    picked = images.select("image_id", "width", "height", "pixels")
    return picked.mapInArrow(run, f"image_id {picked.schema['image_id'].dataType.simpleString()}, shape_id int, exterior {G.RING}, holes {RINGS}")


class PipelineBuilder:
    """Pipelines step by step: PipelineBuilder().with_threshold(128).with_simplification(1.5).build()."""

    def __init__(self):
        self._made = Pipeline()

    def add_preprocessor(self, step) -> PipelineBuilder:
        self._made.preprocessors.append(step)
        return self

    def add_postprocessor(self, step) -> PipelineBuilder:
        self._made.postprocessors.append(step)
        return self

    def set_extractor(self, name: str) -> PipelineBuilder:
        self._made.extractor = name
        return self

    def set_hole_detector(self, holes: Callable) -> PipelineBuilder:
        self._made.holes = holes
        return self

    def with_threshold(self, t: float = 128) -> PipelineBuilder:
        return self.add_preprocessor(threshold_step(t))

    def with_blur(self, sigma: float = 1.0) -> PipelineBuilder:
        return self.add_preprocessor(blur_step(sigma))

    def with_simplification(self, tolerance: float) -> PipelineBuilder:
        return self.add_postprocessor(_each_ring_python(lambda p: G.douglas_peucker(p, tolerance)))

    def with_visvalingam(self, tolerance: float) -> PipelineBuilder:
        return self.add_postprocessor(_each_ring_python(lambda p: G.visvalingam(p, tolerance)))

    def with_chaikin(self, rounds: int = 1) -> PipelineBuilder:
        for _ in range(rounds):
            self.add_postprocessor(_each_ring(G.chaikin))
        return self

    def with_smoothing(self, width: int = 3) -> PipelineBuilder:
        return self.add_postprocessor(_each_ring(lambda r: G.smooth(r, width)))

    def with_decimation(self, step: int = 2) -> PipelineBuilder:
        return self.add_postprocessor(_each_ring(lambda r: G.decimate(r, step)))

    def with_minimum_area(self, least: float = 10.0) -> PipelineBuilder:
        return self.add_postprocessor(minimum_area_step(least))

    def with_hull(self) -> PipelineBuilder:
        return self.add_postprocessor(hull_step)

    def with_validation(self) -> PipelineBuilder:
        return self.add_postprocessor(validate_step)

    def build(self) -> Pipeline:
        return self._made

    @staticmethod
    def simple() -> Pipeline:
        return PipelineBuilder().set_hole_detector(no_holes).build()

    @staticmethod
    def comprehensive() -> Pipeline:
        """Blur 1, threshold 128, holes by area ratio, one round of corner cutting, simplification 1.5, validation."""
        return PipelineBuilder().with_blur(1.0).with_threshold(128).set_hole_detector(area_based_holes).with_chaikin(1).with_simplification(1.5).with_validation().build()


def execute(images: DataFrame, command: str, tolerance: float | None = None, extractor_name: str = "border") -> DataFrame:
    """Shapes by one of COMMANDS; holes are found by containment in all of them."""
    if command not in COMMANDS:
        raise ValueError(f"unknown command {command}; there are {', '.join(COMMANDS)}")
    builder = PipelineBuilder()
    if command == "extract_outline_with_simplification":
        if tolerance is None:
            raise ValueError("tolerance is required")
        builder.with_simplification(tolerance)
    if command == "extract_outline_with_custom_extractor":
        builder.set_extractor(extractor_name)
    return builder.build().run(images)


def command_table(spark: SparkSession) -> DataFrame:
    """command, description, parameter, parameter_description, required: what execute() takes."""
    rows = [(name, text, p, about, True) for name, (text, parameters) in COMMANDS.items() for p, about in parameters or ((None, None),)]
    return spark.createDataFrame([(a, b, c, d, e and c is not None) for a, b, c, d, e in rows], "command string, description string, parameter string, parameter_description string, required boolean")


def properties(shapes: DataFrame) -> DataFrame:
    """image_id, shape_id, area, has_holes, hole_count, perimeter."""
    area, length = G.shape_area(F.col("exterior"), F.col("holes")), G.shape_perimeter(F.col("exterior"), F.col("holes"))
    return shapes.select("image_id", "shape_id", area.alias("area"), (F.size("holes") > 0).alias("has_holes"), F.size("holes").alias("hole_count"), length.alias("perimeter"))


def totals(shapes: DataFrame) -> DataFrame:
    """image_id, shapes, area, mean_perimeter, points."""
    points = F.size("exterior") + F.aggregate("holes", F.lit(0), lambda a, h: a + F.size(h))
    p = shapes.select("image_id", G.shape_area(F.col("exterior"), F.col("holes")).alias("a"), G.shape_perimeter(F.col("exterior"), F.col("holes")).alias("p"), points.alias("n"))
    return p.groupBy("image_id").agg(F.count("*").alias("shapes"), F.sum("a").alias("area"), F.avg("p").alias("mean_perimeter"), F.sum("n").alias("points"))


def generalise(features: DataFrame, included, tolerance=0.01, least_ring=0.01, least_area=0.1, most: int | None = None) -> DataFrame:
    """Map features (name, rings) kept by name (``included`` is a list, or a table whose column name holds them), simplified, rounded and ordered: name, area, box, mid, rings.

    Rings of fewer than 4 points, before or after simplification, go, holes under least_ring too; a feature whose exterior goes is left out (a hole never
    takes its place); so is one whose bounding box covers less than least_area. Ordered by that area, largest first, then by name.
    """
    chosen = features.join(included.select("name").distinct(), "name", "left_semi") if isinstance(included, DataFrame) else features.filter(F.col("name").isin(*included))
    boxed = chosen.withColumn("box", G.bounding_box(F.flatten("rings"))).withColumn("area", (F.col("box.x1") - F.col("box.x0")) * (F.col("box.y1") - F.col("box.y0")))

    def run(batches):
        kind = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
        for batch in batches:
            out = []
            for rings in batch.column("rings").to_pylist():
                kept = []
                for k, ring in enumerate(rings):
                    points = np.array([(p["x"], p["y"]) for p in ring], float).reshape(-1, 2)
                    if len(points) < 4 or (k and _area(points) < least_ring):
                        if not k:
                            break
                        continue
                    simple = G.visvalingam(points, tolerance).tolist()
                    if len(simple) >= 4:
                        kept.append([{"x": x, "y": y} for x, y in simple])
                    elif not k:
                        break
                out.append(kept)
            at = batch.schema.get_field_index("rings")
            yield batch.set_column(at, "rings", pa.array(out, kind))

    wide = boxed.filter(F.col("area") >= least_area).select("name", "area", "box", "rings")
    done = wide.mapInArrow(run, wide.schema).filter(F.size("rings") > 0)
    mid = F.struct(((F.col("box.x0") + F.col("box.x1")) / 2).alias("x"), ((F.col("box.y0") + F.col("box.y1")) / 2).alias("y"))
    rounded = done.select("name", "area", "box", mid.alias("mid"), F.transform("rings", G.round_ring).alias("rings"))
    ordered = rounded.orderBy(F.desc("area"), "name")
    return ordered.limit(most) if most else ordered
