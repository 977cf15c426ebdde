"""Tracks over ``embeddings``: a vector is one of six objects of a clip's frame, its first values shake the box. No SQL: frames assign greedily one after the other."""

from pyspark.sql import functions as F

from cutloom.operators import tracking as T
from cutloom.sources import adapters as A


def detections(s, d):
    e = A.read(s, d, "embeddings")
    n, value = F.floor(F.col("vec_id") / 5), (lambda k: F.get("embedding", F.lit(k)).cast("double"))
    rows = e.select((F.col("vec_id") % 5).alias("clip_id"), F.floor(n / 6).alias("frame"), (n % 6).alias("det_id"), value(0).alias("a"), value(1).alias("b"), F.abs(value(2)).alias("score"))
    x, y = 30 * F.col("det_id") + F.col("frame") % 100 + 20 * F.col("a"), 20 * F.col("b")
    return rows.select("clip_id", "frame", "det_id", x.alias("x0"), y.alias("y0"), (x + 20).alias("x1"), (y + 20).alias("y1"), "score")


QUERIES = {
    "object_tracks": lambda s, d: T.tracks(detections(s, d), quality=0.01),
    "object_report": lambda s, d: T.report(T.tracks(detections(s, d), quality=0.01), 2),
}
ORACLE: dict[str, str] = {}
