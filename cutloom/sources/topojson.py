"""TopoJSON documents to features: shared arcs stitched to rings."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame

from cutloom.operators.geometry import RING


def decode(document: str, object_name: str) -> list[tuple[str | None, list[list[tuple[float, float]]]]]:
    """(name, rings) of each of the object's polygons; a multipolygon gives one for each of its own, under one name. Arc ~k is arc k backwards; a quantised topology's arcs are steps, scaled and moved."""
    topology = json.loads(document)
    scale, move = ((topology["transform"][k] for k in ("scale", "translate")) if "transform" in topology else ((1, 1), (0, 0)))
    arcs = []
    for arc in topology["arcs"]:
        x = y = 0
        points = []
        for px, py in arc:
            x, y = (x + px, y + py) if "transform" in topology else (px, py)
            points.append((float(x * scale[0] + move[0]), float(y * scale[1] + move[1])))
        arcs.append(points)

    def ring(refs):
        out: list[tuple[float, float]] = []
        for k in refs:
            points = arcs[k] if k >= 0 else arcs[~k][::-1]
            out += points[1:] if out else points
        return out

    found = []
    for g in topology["objects"][object_name].get("geometries", []):
        polygons = [g["arcs"]] if g["type"] == "Polygon" else g["arcs"] if g["type"] == "MultiPolygon" else []
        found += [((g.get("properties") or {}).get("name"), [ring(r) for r in p]) for p in polygons if p]
    return found


def features(documents: DataFrame, object_name: str = "units", json_col: str = "json") -> DataFrame:
    """name, rings (the exterior first) of each polygon of each document."""

    def run(batches):
        kind = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
        for batch in batches:
            rows = [f for text in batch.column(0).to_pylist() if text for f in decode(text, object_name)]
            rings = [[[{"x": x, "y": y} for x, y in r] for r in rs] for _, rs in rows]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in rows], pa.string()), pa.array(rings, kind)], ["name", "rings"])

    return documents.select(json_col).mapInArrow(run, f"name string, rings array<{RING}>")
