"""Tracks of objects over a clip's frames: boxes of consecutive frames are assigned by overlap, and a track that isn't seen fades.

A track remembers its last box and a memory: each frame in which it is seen sets the memory to the detection's score, each in which it isn't
multiplies it by ``decay``; under ``least`` the track ends. Frames go in order, so a clip is one pass; the pass holds one frame's detections and the living tracks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Box = tuple[float, float, float, float]


def overlap(a: Box, b: Box) -> float:
    """Area of the intersection by that of the union; 0 if there is none."""
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    both = w * h
    return both / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both)


class Tracker:
    """Rows (frame, det_id, x0, y0, x1, y1, score) in order of (frame, det_id) to rows (frame, det_id, track, overlap, memory)."""

    def __init__(self, least_overlap: float = 0.3, decay: float = 0.5, least: float = 0.1, quality: float = 0.0):
        self.least_overlap, self.decay, self.least, self.quality = least_overlap, decay, least, quality
        self.tracks: dict[int, tuple[Box, float]] = {}
        self.frame: int | None = None
        self.next = 0
        self.held: list[tuple] = []

    def run(self, rows: Iterable[tuple]) -> Iterator[tuple]:
        """Results of every frame that a later one has followed."""
        for row in rows:
            if self.held and row[0] != self.held[0][0]:
                yield from self.close()
            self.held.append(row)

    def close(self) -> Iterator[tuple]:
        """Results of the frame at hand."""
        if not self.held:
            return
        held, self.held = self.held, []
        frame = held[0][0]
        seen = [r for r in held if r[6] >= self.quality]
        missed = 0 if self.frame is None else frame - self.frame - 1
        self.frame = frame
        tracks = {t: (box, m * self.decay**missed) for t, (box, m) in self.tracks.items() if m * self.decay**missed >= self.least}
        pairs = sorted((-o, t, r[1], k) for t, (box, _) in tracks.items() for k, r in enumerate(seen) if (o := overlap(box, r[2:6])) >= self.least_overlap)
        of: dict[int, tuple[int, float]] = {}
        taken = set()
        for o, t, _, k in pairs:
            if t not in taken and k not in of:
                of[k] = (t, -o)
                taken.add(t)
        faded = {t: (box, m * self.decay) for t, (box, m) in tracks.items() if t not in taken and m * self.decay >= self.least}
        for k, r in enumerate(seen):
            if k not in of:
                of[k] = (self.next, 0.0)
                self.next += 1
            track, o = of[k]
            faded[track] = (tuple(r[2:6]), r[6])
            yield frame, r[1], track, o, r[6]
        self.tracks = faded


NAMES = ("frame", "det_id", "x0", "y0", "x1", "y1", "score")
OUT = ("frame", "det_id", "track", "overlap", "memory")


def _tracked(batches, options: dict):
    """Rows arrive sorted by (clip, frame, detection)."""
    now, tracker = None, None
    for batch in batches:
        out: list[tuple] = []
        for clip, *row in zip(*[batch.column(c).to_pylist() for c in ("clip_id", *NAMES)], strict=True):
            if tracker is None or clip != now:
                out += [(now, *r) for r in tracker.close()] if tracker else []
                now, tracker = clip, Tracker(**options)
            out += [(clip, *r) for r in tracker.run([tuple(row)])]
        yield _rows(out, batch.schema.field("clip_id").type)
        kind = batch.schema.field("clip_id").type
    if tracker:
        yield _rows([(now, *r) for r in tracker.close()], kind)


def _rows(out: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*out, strict=True)) or [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (kind, pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)], ["clip_id", *OUT])


def tracks(detections: DataFrame, least_overlap: float = 0.3, decay: float = 0.5, least: float = 0.1, quality: float = 0.0) -> DataFrame:
    """clip_id, frame, det_id, track (from 0 in each clip), overlap (with the track's box before; 0 for a new one), memory of each detection of score quality or more.

    Of a frame's pairs of track and detection, those of greatest overlap go first (ties: lesser track, then lesser detection), from least_overlap on; the other detections begin
    tracks. Detections with a null take no part. Rows are sorted by clip and frame and pass once; state is one frame and the living tracks.
    """
    options = {"least_overlap": least_overlap, "decay": decay, "least": least, "quality": quality}
    rows = detections.select("clip_id", *[F.col(c).cast("long" if c in ("frame", "det_id") else "double").alias(c) for c in NAMES]).dropna()
    ordered = rows.repartition("clip_id").sortWithinPartitions("clip_id", "frame", "det_id")
    kind = rows.schema["clip_id"].dataType.simpleString()
    return ordered.mapInArrow(lambda b: _tracked(b, options), f"clip_id {kind}, frame long, det_id long, track long, overlap double, memory double")


def report(tracked: DataFrame, least_frames: int = 1) -> DataFrame:
    """clip_id, track, first_frame, last_frame, n_frames, mean_memory, mean_overlap (of all but a track's first) of the tracks seen in least_frames or more."""
    rows = tracked.groupBy("clip_id", "track").agg(
        F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.count("*").alias("n_frames"), F.avg("memory").alias("mean_memory"), F.avg(F.when(F.col("overlap") > 0, F.col("overlap"))).alias("mean_overlap")
    )
    return rows.filter(F.col("n_frames") >= least_frames)
