"""Timeline operators on frames (clip_id, idx, pts_us, payload and any more columns).

Each takes and gives a DataFrame, so ``df.transform(...)`` chains them; a chain is one plan. Windows are by clip.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FRAME_US = 40_000


def by_clip():
    return Window.partitionBy("clip_id")


def splice(frames: DataFrame, segments: list[tuple[int, int]] | DataFrame, frame_us: int = FRAME_US, bucket_us: int = 60_000_000) -> DataFrame:
    """Frames of the segments [start, end), one segment after the other in list order; times begin anew at 0.

    segments: one list for all clips, or a DataFrame (clip_id, ord, start_us, end_us). They may overlap, repeat
    and stand in any order; an empty list copies. A list needs no join: each frame meets the few segments in an array. With a table, a frame meets the
    segments that touch its time bucket, not all of its clip.
    """
    if not isinstance(segments, DataFrame):
        if not segments:
            return frames
        rows, offset = [], 0
        for k, (start, end) in enumerate(segments):
            rows.append(F.struct(F.lit(k).alias("ord"), F.lit(start).alias("start_us"), F.lit(end).alias("end_us"), F.lit(offset).alias("offset_us")))
            offset += end - start
        met = frames.withColumn("seg", F.explode(F.filter(F.array(*rows), lambda s: (F.col("pts_us") >= s["start_us"]) & (F.col("pts_us") < s["end_us"])))).select("*", "seg.*").drop("seg")
    else:
        before = Window.partitionBy("clip_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
        shifted = segments.withColumn("offset_us", F.coalesce(F.sum(F.col("end_us") - F.col("start_us")).over(before), F.lit(0)))
        span = F.sequence(F.expr(f"start_us div {bucket_us}"), F.expr(f"end_us div {bucket_us}"))
        spread = shifted.filter("start_us < end_us").select("clip_id", "ord", "start_us", "end_us", "offset_us", F.explode(span).alias("bucket_"))
        bucketed = frames.withColumn("bucket_", F.expr(f"pts_us div {bucket_us}"))
        met = bucketed.join(spread, ["clip_id", "bucket_"]).filter((F.col("pts_us") >= F.col("start_us")) & (F.col("pts_us") < F.col("end_us")))
    placed = met.withColumn("pts_us", F.col("pts_us") - F.col("start_us") + F.col("offset_us"))
    order = by_clip().orderBy("ord", "idx")
    return placed.withColumn("idx", F.row_number().over(order).cast("long") - 1).select(*frames.columns)


def sequentise(frames: DataFrame, start_us: int, end_us: int, fps: float = 25.0) -> DataFrame:
    """clip_id, shot, t_us, idx, payload: at each of floor(period * fps) times, the last frame shown by then (none before the first frame).

    The times go as rows between the frames of their clip, and a running last value finds the frame: one shuffle, no range join.
    """
    n = int((end_us - start_us) * fps // 1_000_000)
    step = F.lit(start_us) + F.floor(F.col("shot") * 1_000_000 / F.lit(float(fps))).cast("long")
    shots = frames.select("clip_id").distinct().select("clip_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("shot")) if n > 0 else frames.select("clip_id").limit(0).withColumn("shot", F.lit(0))
    marks = shots.select("clip_id", "shot", step.alias("t_us"), F.lit(None).cast("struct<idx:bigint,payload:double>").alias("f"))
    shown = frames.select("clip_id", F.lit(None).cast("int").alias("shot"), F.col("pts_us").alias("t_us"), F.struct("idx", "payload").alias("f"))
    order = by_clip().orderBy("t_us", F.col("shot").asc_nulls_first(), F.col("f.idx"))
    found = shown.unionByName(marks).withColumn("last", F.last("f", ignorenulls=True).over(order)).filter("shot is not null")
    return found.select("clip_id", F.col("shot").cast("long").alias("shot"), "t_us", F.col("last.idx").alias("idx"), F.col("last.payload").alias("payload")).filter("idx is not null")


def extracted(frames: DataFrame, output: str, start_us: int, end_us: int, fps: float = 25.0, quality: int = 2) -> DataFrame:
    """sequentise() with the file that each picture goes to, numbered from 00001 behind the output's name (less every ``.mp4`` at its end), and the quality it is written in."""
    stem = output
    while stem.endswith(".mp4"):
        stem = stem.removesuffix(".mp4")
    number = (F.col("shot") + 1).cast("string")
    file = F.concat(F.lit(f"{stem}_"), F.when(F.length(number) < 5, F.lpad(number, 5, "0")).otherwise(number), F.lit(".png"))
    return sequentise(frames, start_us, end_us, fps).withColumns({"file": file, "quality": F.lit(quality)})


def reverse(frames: DataFrame, frame_us: int = FRAME_US) -> DataFrame:
    """Frames in reverse order; times are mirrored, so the first is 0 again."""
    return _with_ends(frames).withColumns({"idx": F.col("top_") - F.col("idx"), "pts_us": F.col("last_") - F.col("pts_us")}).select(*frames.columns)


def _with_ends(frames: DataFrame) -> DataFrame:
    """frames with top_ and last_, its clip's greatest idx and pts_us: an aggregate joined back, so a long clip is a join Spark can split, not one task's window. Null clip ids are one clip."""
    ends = frames.groupBy(F.col("clip_id").alias("of_")).agg(F.max("idx").alias("top_"), F.max("pts_us").alias("last_"))
    return frames.join(ends, F.col("clip_id").eqNullSafe(F.col("of_"))).drop("of_")


def loop(frames: DataFrame, frame_us: int = FRAME_US) -> DataFrame:
    """Forward, then reversed: twice the frames, the turning one twice. Each frame becomes two rows."""
    both = _with_ends(frames).withColumn("turn_", F.explode(F.array(F.lit(0), F.lit(1))))
    back = F.col("turn_") == 1
    idx = F.when(back, 2 * F.col("top_") + 1 - F.col("idx")).otherwise(F.col("idx"))
    pts = F.when(back, 2 * F.col("last_") + frame_us - F.col("pts_us")).otherwise(F.col("pts_us"))
    return both.withColumns({"idx": idx, "pts_us": pts}).select(*frames.columns)


def has_audio(frames: DataFrame, audio: DataFrame) -> DataFrame:
    """clip_id, has_audio of every clip of frames."""
    heard = audio.select("clip_id").distinct().withColumn("has_audio", F.lit(True))
    return frames.select("clip_id").distinct().join(heard, "clip_id", "left").fillna(False, ["has_audio"])


def make_loop(frames: DataFrame, audio: DataFrame | None = None, keep_reversed: bool = False, sample_us: int = FRAME_US) -> DataFrame:
    """Every clip forward, then reversed, its sound too where it has any; rows as in frames, and part: 'video', 'audio' and, if kept, 'reversed' and 'reversed audio'."""
    parts = {"video": loop(frames)} | ({"audio": loop(audio, sample_us)} if audio is not None else {})
    if keep_reversed:
        parts |= {"reversed": reverse(frames)} | ({"reversed audio": reverse(audio)} if audio is not None else {})
    out = None
    for name, df in parts.items():
        named = df.withColumn("part", F.lit(name))
        out = named if out is None else out.unionByName(named)
    return out


def poster(frames: DataFrame, at_us: int) -> DataFrame:
    """clip_id, idx, pts_us, payload of each clip's frame nearest to the time (the earlier of two)."""
    best = frames.groupBy("clip_id").agg(F.min_by(F.struct("idx", "pts_us", "payload"), F.struct(F.abs(F.col("pts_us") - at_us), F.col("idx"))).alias("f"))
    return best.select("clip_id", "f.*")


class Timeline:
    """A chain of operations on one source, nothing run until the frames are used or saved: Timeline(df).splice([...]).reverse().save(path)."""

    def __init__(self, frames: DataFrame, first_splice_us: int | None = None, source: DataFrame | None = None):
        self.frames, self.first_splice_us = frames, first_splice_us
        self.source = frames if source is None else source

    def splice(self, segments) -> Timeline:
        at = segments[0][0] if segments and not isinstance(segments, DataFrame) else None
        return Timeline(splice(self.frames, segments), self.first_splice_us if self.first_splice_us is not None else at, self.source)

    def sequentise(self, start_us: int, end_us: int, fps: float = 25.0) -> DataFrame:
        return sequentise(self.frames, start_us, end_us, fps)

    def reverse(self) -> Timeline:
        return Timeline(reverse(self.frames), self.first_splice_us, self.source)

    def loop(self) -> Timeline:
        return Timeline(loop(self.frames), self.first_splice_us, self.source)

    def poster(self) -> DataFrame:
        """Each clip's frame of the source nearest to where the first splice's first segment begins there; to 0 without one."""
        return poster(self.source, self.first_splice_us or 0)

    def save(self, path: str, mode: str = "error") -> None:
        self.frames.write.mode(mode).parquet(path)
