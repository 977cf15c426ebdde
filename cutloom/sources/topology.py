"""TopoJSON as tables: arcs once each, and who uses them; rings stitched from arcs after each arc was simplified once, so that neighbours keep one border.

Documents are (doc_id, json). One that is no topology, or lacks the object, has no rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutloom.operators import geometry as G

_POINTS = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))


def _read(text: str | None) -> dict:
    try:
        found = json.loads(text or "")
    except ValueError:
        return {}
    return found if isinstance(found, dict) and isinstance(found.get("arcs"), list) else {}


def _arc_points(topology: dict) -> Iterator[np.ndarray]:
    """Each arc's points; those of a quantised topology are steps, summed up, scaled and moved."""
    transform = topology.get("transform")
    for arc in topology.get("arcs", []):
        xy = np.array([p[:2] for p in arc], float).reshape(-1, 2)
        yield np.cumsum(xy, axis=0) * transform["scale"] + transform["translate"] if transform else xy


def arcs(documents: DataFrame) -> DataFrame:
    """doc_id, arc, points."""

    def run(batches):
        for batch in G.slices(batches):
            at, number, points = [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                for n, xy in enumerate(_arc_points(_read(text))):
                    at.append(k)
                    number.append(n)
                    points.append(xy)
            flat = np.concatenate(points) if points else np.zeros((0, 2))
            ends = pa.array(np.concatenate([[0], np.cumsum([len(p) for p in points])]).astype(np.int32))
            lists = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(flat[:, c].copy()) for c in (0, 1)], ["x", "y"]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), pa.array(number, pa.int32()), lists], ["doc_id", "arc", "points"])

    rows = documents.select("doc_id", "json")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, arc int, points {G.RING}")


def references(documents: DataFrame, object_name: str = "units") -> DataFrame:
    """doc_id, feature (number in its document), name, type, part, ring, nth, arc, backwards: the arcs of each polygon's rings and each line, in order. Other geometries have none."""

    def walk(g: dict) -> Iterator[tuple]:
        kind, used = g.get("type"), g.get("arcs", [])
        parts = {"Polygon": [used], "MultiPolygon": used, "LineString": [[used]], "MultiLineString": [used]}.get(kind, [])
        for p, part in enumerate(parts):
            for r, ring in enumerate(part):
                for n, k in enumerate(ring):
                    yield (g.get("properties") or {}).get("name"), kind, p, r, n, k if k >= 0 else ~k, k < 0

    def run(batches):
        for batch in G.slices(batches):
            rows = [(k, f, *row) for k, text in enumerate(batch.column(1).to_pylist()) for f, g in enumerate((_read(text).get("objects") or {}).get(object_name, {}).get("geometries", [])) for row in walk(g)]
            at, feature, name, kind, part, ring, nth, arc, back = zip(*rows, strict=True) if rows else [()] * 9
            numbers = [pa.array(c, pa.int32()) for c in (feature, part, ring, nth, arc)]
            columns = [batch.column(0).take(pa.array(at, pa.int32())), numbers[0], pa.array(name, pa.string()), pa.array(kind, pa.string()), *numbers[1:], pa.array(back, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "feature", "name", "type", "part", "ring", "nth", "arc", "backwards"])

    rows = documents.select("doc_id", "json")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, feature int, name string, type string, part int, ring int, nth int, arc int, backwards boolean")


def stitched(arc_table: DataFrame, used: DataFrame) -> DataFrame:
    """doc_id, feature, name, geometry (see operators/features.py) from arcs and references: where one arc ends the next begins, and that point stands once."""
    c = F.col
    met = used.join(arc_table, ["doc_id", "arc"]).withColumn("points", F.when(c("backwards"), F.reverse("points")).otherwise(c("points")))
    rings = met.groupBy("doc_id", "feature", "name", "type", "part", "ring").agg(F.array_sort(F.collect_list(F.struct("nth", "points"))).alias("arcs"))
    behind = F.transform("arcs", lambda a, i: F.when(i > 0, F.slice(a["points"], 2, F.greatest(F.size(a["points"]) - 1, F.lit(0)))).otherwise(a["points"]))
    rings = rings.withColumn("points", F.flatten(behind)).groupBy("doc_id", "feature", "name", "type", "part").agg(F.array_sort(F.collect_list(F.struct("ring", "points"))).alias("rings"))
    parts = rings.withColumn("rings", F.transform("rings", lambda r: r["points"])).groupBy("doc_id", "feature", "name", "type").agg(F.array_sort(F.collect_list(F.struct("part", "rings"))).alias("parts"))
    return parts.select("doc_id", "feature", "name", F.struct("type", F.transform("parts", lambda p: p["rings"]).alias("parts")).alias("geometry"))


def generalised(documents: DataFrame, tolerance: float = 0.01, object_name: str = "units", simplify: Callable[[np.ndarray, float], np.ndarray] = G.visvalingam) -> DataFrame:
    """stitched() from arcs that were simplified once each, their ends kept: features that share an arc share its simplified points too."""
    keyed = arcs(documents).withColumn("key", F.struct("doc_id", "arc"))
    simple = G.map_rings(keyed, lambda p: simplify(p, tolerance), "key", "points").select("key.doc_id", "key.arc", "points")
    return stitched(simple, references(documents, object_name))
