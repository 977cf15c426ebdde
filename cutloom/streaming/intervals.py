"""Pauses between spoken intervals on a stream, and tracks of objects over frames: state by key, event-time timers.

Both need their rows in order, which a stream doesn't give: rows wait in the key's state until the watermark has passed them, then a timer takes
them in order. What waits is bounded by how late rows may come. The state lives in RocksDB (``with_state``) and outlasts a restart.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cutloom.operators.tracking import Tracker

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state(spark: SparkSession) -> None:
    """Stateful processors need a state store with column families."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class InOrder(StatefulProcessor):
    """Holds rows (at_ms first, then values) until the watermark has passed them, and gives them to ``passed`` in order."""

    columns: list[str]
    schema: str

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", self.schema)

    def passed(self, key, rows: list[tuple]) -> pd.DataFrame:
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [tuple(v.item() if hasattr(v, "item") else v for v in row) for frame in rows for row in frame[self.columns].itertuples(index=False, name=None)]
        if new:
            self.pending.appendList(new)
            self.handle.registerTimer(min(r[0] for r in new) + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        waiting = sorted(self.pending.get())
        ready = [r for r in waiting if r[0] < mark]
        left = waiting[len(ready) :]
        if ready:
            self.pending.put(left) if left else self.pending.clear()
            if left:
                self.handle.registerTimer(left[0][0] + 1)
            yield self.passed(key, ready)

    def close(self) -> None:
        pass


class Pauses(InOrder):
    """A row for each pause: the utterance before it, its middle, where the segment that it ends began, and that segment's number."""

    columns, schema = ["at_ms", "s_us", "utt_id", "e_us"], "at_ms long, s_us long, utt_id long, e_us long"
    output = "media_id long, utt_id long, break_us long, from_us long, seg long"

    def __init__(self, min_gap_us: int):
        self.min_gap_us = min_gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "utt_id long, e_us long, from_us long, seg long")

    def passed(self, key, rows):
        utt, end, begin, seg = self.last.get() if self.last.exists() else (None, None, 0, 0)
        out = []
        for _, start, new, new_end in rows:
            if utt is not None and start - end >= self.min_gap_us:
                middle = end + (start - end) // 2
                seg += 1
                out.append((key[0], utt, middle, begin, seg))
                begin = middle
            utt, end = new, new_end
        self.last.update((utt, end, begin, seg))
        return pd.DataFrame(out, columns=["media_id", "utt_id", "break_us", "from_us", "seg"]).astype("int64")


def live_breaks(utterances: DataFrame, late: str = "1 minute", min_gap_us: int = 2_000_000) -> DataFrame:
    """media_id, utt_id, break_us, from_us, seg of a stream of utterances (media_id, utt_id, s_us, e_us, ts; ts is when s_us is).

    The breaks are those that natural_breaks() finds among all rows that came in time; rows later than ``late`` are dropped by the watermark. A break comes out
    once the watermark has passed the utterance behind it. Rows with a null in any of these columns take no part.
    """
    rows = utterances.select("media_id", "utt_id", "s_us", "e_us", "ts").dropna().withWatermark("ts", late)
    rows = rows.withColumn("at_ms", F.unix_millis("ts"))
    return rows.groupBy("media_id").transformWithStateInPandas(statefulProcessor=Pauses(min_gap_us), outputStructType=Pauses.output, outputMode="Append", timeMode="EventTime")


class Tracks(InOrder):
    """A row for each detection, with its track."""

    columns, schema = ["at_ms", "frame", "det_id", "x0", "y0", "x1", "y1", "score"], "at_ms long, frame long, det_id long, x0 double, y0 double, x1 double, y1 double, score double"
    output = "clip_id long, frame long, det_id long, track long, overlap double, memory double"

    def __init__(self, options: dict):
        self.options = options

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.tracks = handle.getListState("tracks", "track long, x0 double, y0 double, x1 double, y1 double, memory double")
        self.seen = handle.getValueState("seen", "frame long, next long")

    def passed(self, key, rows):
        tracker = Tracker(**self.options)
        if self.seen.exists():
            tracker.frame, tracker.next = self.seen.get()
            tracker.tracks = {t: ((x0, y0, x1, y1), m) for t, x0, y0, x1, y1, m in self.tracks.get()}
        out = [(key[0], *r) for r in tracker.run([row[1:] for row in rows])] + [(key[0], *r) for r in tracker.close()]
        self.seen.update((tracker.frame, tracker.next))
        kept = [(t, *box, m) for t, (box, m) in tracker.tracks.items()]
        self.tracks.put(kept) if kept else self.tracks.clear()
        return pd.DataFrame(out, columns=["clip_id", "frame", "det_id", "track", "overlap", "memory"])


def live_tracks(detections: DataFrame, late: str = "1 minute", **options) -> DataFrame:
    """tracking.tracks() of a stream of detections (clip_id, frame, det_id, x0, y0, x1, y1, score, ts; ts is the frame's time, the same for all of a frame)."""
    names = ["clip_id", "frame", "det_id", "x0", "y0", "x1", "y1", "score", "ts"]
    rows = detections.select(*names).dropna().withWatermark("ts", late).withColumn("at_ms", F.unix_millis("ts"))
    return rows.groupBy("clip_id").transformWithStateInPandas(statefulProcessor=Tracks(options), outputStructType=Tracks.output, outputMode="Append", timeMode="EventTime")
