"""Map features of any geometry: boxes, centres, areas, rounding, simplification, and their GeoJSON.

A geometry is one tagged nested column, STRUCT<type, parts>: parts are polygons, a polygon's rings (or a line string's lines) are lists of points. A point is
one part of one line of one point, points are one line, lines one part, a polygon one part, polygons several. So one walk over
the same three levels serves every type, and all but simplification are column expressions. A collection has no parts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutloom.operators import geometry as G

PARTS = f"array<array<{G.RING}>>"
GEOMETRY = f"struct<type:string,parts:{PARTS}>"
AREAL, LINEAR = ("Polygon", "MultiPolygon"), ("LineString", "MultiLineString")
#: How deep a type's coordinates are nested in GeoJSON: a point's are 1.
DEPTH = {"Point": 1, "MultiPoint": 2, "LineString": 2, "MultiLineString": 3, "Polygon": 3, "MultiPolygon": 4}


def geometry(type_: Column, parts: Column) -> Column:
    return F.struct(type_.alias("type"), parts.cast(PARTS).alias("parts"))


def points(g: Column) -> Column:
    """Every point of a geometry, in order."""
    return F.flatten(F.flatten(g["parts"]))


def box(g: Column) -> Column:
    """x0, y0, x1, y1 over all points; null if there are none."""
    return F.when(F.size(points(g)) > 0, G.bounding_box(points(g)))


def middle(g: Column) -> Column:
    b = box(g)
    return F.when(b.isNotNull(), F.struct(((b["x0"] + b["x1"]) / 2).alias("x"), ((b["y0"] + b["y1"]) / 2).alias("y")))


def geometry_area(g: Column) -> Column:
    """The exteriors' areas, holes not taken off; 0 for what has no area."""
    total = F.aggregate(g["parts"], F.lit(0.0), lambda a, p: a + F.coalesce(G.ring_area(F.get(p, 0)), F.lit(0.0)))
    return F.when(g["type"].isin(*AREAL), total).otherwise(F.lit(0.0))


def feature_area(g: Column, bbox: Column | None = None) -> Column:
    """The box's area where the feature has one, its geometry's otherwise."""
    own = geometry_area(g)
    return own if bbox is None else F.coalesce((bbox["x1"] - bbox["x0"]) * (bbox["y1"] - bbox["y0"]), own)


def rounded(g: Column) -> Column:
    """Lines and polygons rounded to 3 digits; points stay as they are."""
    near = F.transform(g["parts"], lambda part: F.transform(part, G.round_ring))
    return F.when(g["type"].isin(*AREAL, *LINEAR), geometry(g["type"], near)).otherwise(g)


def from_geojson(text: Column) -> Column:
    """The geometry of a GeoJSON geometry object. Null for what is no JSON, or of no known type; numbers beyond x and y are left out."""
    kind, raw = F.get_json_object(text, "$.type"), F.get_json_object(text, "$.coordinates")
    xy = lambda p: F.struct(F.get(p, 0).alias("x"), F.get(p, 1).alias("y"))
    line = lambda ps: F.transform(ps, xy)
    lines = lambda ls: F.transform(ls, line)
    read = lambda depth: F.from_json(raw, "array<" * depth + "double" + ">" * depth)
    parts = (
        F.when(kind == "Point", F.array(F.array(F.array(xy(read(1))))))
        .when(kind.isin("MultiPoint", "LineString"), F.array(F.array(line(read(2)))))
        .when(kind.isin("MultiLineString", "Polygon"), F.array(lines(read(3))))
        .when(kind == "MultiPolygon", F.transform(read(4), lines))
    )
    return F.when(parts.isNotNull(), geometry(kind, parts))


def to_geojson(g: Column) -> Column:
    """The GeoJSON geometry object, as text."""
    kind = g["type"]
    xy = lambda p: F.array(p["x"], p["y"])
    deep = F.transform(g["parts"], lambda part: F.transform(part, lambda line: F.transform(line, xy)))
    text = F.when(kind == "Point", F.to_json(deep[0][0][0])).when(kind.isin("MultiPoint", "LineString"), F.to_json(deep[0][0])).when(kind.isin("MultiLineString", "Polygon"), F.to_json(deep[0])).when(kind == "MultiPolygon", F.to_json(deep))
    return F.concat(F.lit('{"type":"'), kind, F.lit('","coordinates":'), text, F.lit("}"))


def _offsets(counts: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))


def _simplified(batches, at: int, tolerance: float, least_ring: float):
    for batch in batches:
        kinds, parts = batch.column(at + 1).to_pylist(), batch.column(at + 2)
        rows, per_row = parts.flatten(), parts.value_lengths().fill_null(0).to_numpy()
        lines, per_part = rows.flatten(), rows.value_lengths().fill_null(0).to_numpy()
        flat, ends = lines.flatten(), np.concatenate([[0], np.cumsum(lines.value_lengths().fill_null(0).to_numpy())])
        xy = np.stack([flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1)], 1) if len(flat) else np.zeros((0, 2))
        part_of_line, row_of_part = np.repeat(np.arange(len(per_part)), per_part), np.repeat(np.arange(len(per_row)), per_row)
        nth = np.arange(len(part_of_line)) - (np.cumsum(per_part) - per_part)[part_of_line]
        kept, line_stays, part_stays = [], np.zeros(len(nth), bool), np.ones(len(per_part), bool)
        for i, part in enumerate(part_of_line.tolist()):
            kind, line = kinds[row_of_part[part]], xy[ends[i] : ends[i + 1]]
            if kind in LINEAR or kind in AREAL:
                least = 2 if kind in LINEAR else 4
                worth = len(line) >= least and part_stays[part] and (kind in LINEAR or not nth[i] or ring_size(line) >= least_ring)
                line = G.visvalingam(line, tolerance) if worth else line[:0]
                line_stays[i] = len(line) >= least
                if kind in AREAL and not nth[i] and not line_stays[i]:
                    part_stays[part] = False
            else:
                line_stays[i] = True
            if line_stays[i]:
                kept.append(line)
        lines_left = np.bincount(part_of_line[line_stays], minlength=len(per_part))
        part_stays &= lines_left > 0
        parts_left = np.bincount(row_of_part[part_stays], minlength=len(per_row))
        all_points = np.concatenate(kept) if kept else np.zeros((0, 2))
        inner = pa.ListArray.from_arrays(_offsets(np.array([len(x) for x in kept], int)), pa.StructArray.from_arrays([pa.array(all_points[:, k].copy()) for k in (0, 1)], ["x", "y"]))
        nested = pa.ListArray.from_arrays(_offsets(parts_left), pa.ListArray.from_arrays(_offsets(lines_left[part_stays]), inner))
        columns = list(batch.columns)
        columns[at + 2] = nested
        whole = pa.RecordBatch.from_arrays(columns, batch.schema.names)
        yield whole.filter(pa.array((parts_left > 0) | (per_row == 0)))


def ring_size(line: np.ndarray) -> float:
    x, y = line.T
    return abs(float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1)))) / 2 if len(line) > 2 else 0.0


def simplified(features: DataFrame, column: str = "geometry", tolerance: float = 0.01, least_ring: float = 0.01) -> DataFrame:
    """features with lines and polygons simplified (Visvalingam and Whyatt), points as they are.

    A line of fewer than 2 points goes, as do a ring of fewer than 4, before or after, and a hole under least_ring; a polygon goes with its exterior, and a feature whose
    every part goes is left out. Null geometries and those without parts stay.
    """
    names = [c for c in features.columns if c != column]
    flat = features.select(*[F.col(f"`{n}`") for n in names], F.lit(0).alias("at_"), F.col(f"`{column}`")["type"].alias("type_"), F.col(f"`{column}`")["parts"].alias("parts_"))
    at = len(names)
    done = flat.mapInArrow(lambda b: _simplified(b, at, tolerance, least_ring), flat.schema)
    return done.select(*[F.col(f"`{n}`") for n in names], F.when(F.col("type_").isNotNull(), geometry(F.col("type_"), F.col("parts_"))).alias(column)).select(*[F.col(f"`{n}`") for n in features.columns])


def generalised(features: DataFrame, included: DataFrame | None = None, tolerance=0.01, least_ring=0.01, least_area=0.1) -> DataFrame:
    """Map features (name, geometry) kept by the table ``included`` (its column name), boxed, simplified, over least_area (of the box) and rounded: name, geometry, area, box, mid."""
    chosen = features.select("name", "geometry")
    if included is not None:
        chosen = chosen.join(included.select("name").distinct(), "name", "left_semi")
    boxed = chosen.withColumn("box", box(F.col("geometry"))).withColumn("area", feature_area(F.col("geometry"), F.col("box"))).filter(F.col("area") >= least_area)
    done = simplified(boxed.withColumn("mid", middle(F.col("geometry"))), "geometry", tolerance, least_ring)
    return done.select("name", rounded(F.col("geometry")).alias("geometry"), "area", "box", "mid")
