"""Speech and cue operators: pauses, segments, cut snapping, cue text.

Utterances: media_id, utt_id, s_us, e_us, transcript, speaker; their order is (s_us, utt_id). Times are whole microseconds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutloom.functions.scalars import format_cue_ms
from cutloom.sources.errors import NoResults


# What a cut says about itself.
NO_CHANGE = "No adjustment needed"
START_MOVED = "Adjusted start to avoid cutting mid-speech"
END_MOVED = "Adjusted end to avoid cutting mid-speech"
BOTH_MOVED = "Adjusted both start and end to avoid cutting mid-speech"


DAY_US = 86_400_000_000


def with_next(utterances: DataFrame, columns: list[str], bucket_us: int = DAY_US) -> DataFrame:
    """utterances with next_, those columns (s_us and utt_id first) of the one that follows in order; null after a medium's last.

    A medium may hold a third of all rows, so the window runs within (medium, day); the last of a day takes the first
    of the next day that has any, from a table of one row a medium and day.
    """
    dayed = utterances.withColumn("day_", F.expr(f"s_us div {bucket_us}"))
    own = F.struct("s_us", "utt_id", *columns)
    firsts = dayed.groupBy("media_id", "day_").agg(F.min(own).alias("first_"))
    after = firsts.select("media_id", "day_", F.lead("first_").over(Window.partitionBy("media_id").orderBy("day_")).alias("after_"))
    in_day = Window.partitionBy("media_id", "day_").orderBy("s_us", "utt_id")
    joined = dayed.withColumn("next_", F.lead(own).over(in_day)).join(after, ["media_id", "day_"])
    return joined.withColumn("next_", F.coalesce("next_", "after_")).select(*utterances.columns, "next_")


def with_next_start(utterances: DataFrame, bucket_us: int = DAY_US) -> DataFrame:
    """utterances with next_us, where the next one in order begins."""
    return with_next(utterances, [], bucket_us).withColumn("next_us", F.col("next_.s_us")).drop("next_")


def natural_breaks(utterances: DataFrame, min_gap_us: int = 2_000_000) -> DataFrame:
    """media_id, utt_id (the one before), break_us: the middle of each pause of min_gap_us or more. Overlaps make none."""
    gap = with_next_start(utterances).withColumn("gap_us", F.col("next_us") - F.col("e_us")).filter(F.col("gap_us") >= min_gap_us)
    return gap.select("media_id", "utt_id", F.expr("e_us + gap_us div 2").alias("break_us"))


def skeleton_segments(utterances: DataFrame, min_gap_us=2_000_000, max_us=300_000_000, tail_us=5_000_000, by_medium=False) -> DataFrame:
    """media_id, seg, start_us, end_us, name, description: spans between breaks, long ones split evenly.

    One longer than max_us becomes ceil(length / max_us) parts, the last one ending at the break. What follows
    the last break, up to tail_us after the last utterance's end, is one segment, never split, if it is longer than 0.
    The spans end at the breaks and at the last utterance, which has no next one; they rise by time, so where one begins and the
    number of its first part come from a window within (medium, day) and a table of one row a medium and day.
    by_medium brings a medium's spans together before they become parts, of which there may be many more: groups of
    whole media then need no shuffle of parts.
    """
    gap = with_next_start(utterances).withColumn("gap_", F.col("next_us") - F.col("e_us")).withColumn("last_", F.col("next_us").isNull())
    ends = gap.filter(F.col("last_") | (F.col("gap_") >= min_gap_us)).select("media_id", "last_", F.when(F.col("last_"), F.col("e_us") + tail_us).otherwise(F.expr("e_us + gap_ div 2")).alias("to_us"))
    day, earlier = F.expr(f"to_us div {DAY_US}"), Window.partitionBy("media_id").orderBy("day_").rowsBetween(Window.unboundedPreceding, -1)
    in_day = Window.partitionBy("media_id", "day_").orderBy("last_", "to_us")
    dayed = ends.withColumn("day_", day)
    before = dayed.groupBy("media_id", "day_").agg(F.max("to_us").alias("top_")).select("media_id", "day_", F.max("top_").over(earlier).alias("before_"))
    spans = dayed.withColumn("from_us", F.lag("to_us").over(in_day)).join(before, ["media_id", "day_"]).withColumn("from_us", F.coalesce("from_us", "before_", F.lit(0)))
    n = F.when(F.col("last_"), 1).otherwise(F.greatest(F.lit(1), F.ceil((F.col("to_us") - F.col("from_us")) / max_us))).cast("int")
    sized = spans.filter(~F.col("last_") | (F.col("from_us") < F.col("to_us"))).withColumn("n", n).select("media_id", "day_", "last_", "from_us", "to_us", "n")
    counts = sized.groupBy("media_id", "day_").agg(F.sum("n").alias("n_")).select("media_id", "day_", F.coalesce(F.sum("n_").over(earlier), F.lit(0)).alias("prior_"))
    running = F.sum("n").over(in_day.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    placed = sized.withColumn("run_", running).join(counts, ["media_id", "day_"])
    if by_medium:
        placed = placed.repartition(int(utterances.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.col("media_id").cast("string"))
    parts = placed.select("media_id", "from_us", "to_us", "n", (F.col("prior_") + F.col("run_") + 1).alias("first_"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    numbered = parts.select("media_id", (F.col("first_") + F.col("i")).alias("seg"), F.expr("from_us + i * (to_us - from_us) div n").alias("start_us"), F.expr("from_us + (i + 1) * (to_us - from_us) div n").alias("end_us"))
    tenths = lambda us: F.concat(F.expr(f"(({us}) + 50000) div 100000 div 10").cast("string"), F.lit("."), F.expr(f"(({us}) + 50000) div 100000 % 10").cast("string"))
    text = F.concat(F.lit("Natural segment "), F.col("seg").cast("string"), F.lit(" ("), tenths("start_us"), F.lit("s - "), tenths("end_us"), F.lit("s, duration: "), tenths("end_us - start_us"), F.lit("s)"))
    name = F.concat(F.lit("segment_"), F.when(F.col("seg") < 1000, F.lpad(F.col("seg").cast("string"), 3, "0")).otherwise(F.col("seg").cast("string")))
    return numbered.select("media_id", F.col("seg").cast("long").alias("seg"), "start_us", "end_us", name.alias("name"), text.alias("description"))


def skeleton_clips(utterances: DataFrame, output_dir: str = "out", **options) -> DataFrame:
    """The segments of skeleton_segments() as clips of a configuration (see sources/config.py): one splice of its own span each, in seconds; path is the medium."""
    s = skeleton_segments(utterances, **options)
    span = F.struct((F.col("start_us") / 1_000_000).alias("start"), (F.col("end_us") / 1_000_000).alias("end"))
    void = lambda kind: F.lit(None).cast(kind)
    return s.select(
        F.col("media_id").cast("string").alias("path"), F.lit(output_dir).alias("output_dir"), (F.col("seg") - 1).cast("int").alias("clip_ord"), "name", "description", F.lit("splice").alias("op_type"),
        F.array(span).alias("segments"), void("struct<start:double,end:double>").alias("period"), void("double").alias("fps"), void("string").alias("format"), void("int").alias("quality"),
    )


def speaker_cuts(utterances: DataFrame) -> DataFrame:
    """media_id, utt_id, cut_us: where another speaker begins than the one before, half-way through the gap (or overlap) between them."""
    seen = with_next(utterances, ["speaker"])
    return seen.filter(F.col("next_.speaker") != F.col("speaker")).select("media_id", F.col("next_.utt_id").alias("utt_id"), F.expr("(next_.s_us + e_us) div 2").alias("cut_us"))


def spanning(df: DataFrame, start: str, end: str, width_us: int) -> DataFrame:
    """df with a row for each time bucket that [start, end] touches."""
    return df.withColumn("bucket", F.explode(F.sequence(F.expr(f"{start} div {width_us}"), F.expr(f"{end} div {width_us}"))))


def optimal_cuts(utterances: DataFrame, desired: DataFrame, bucket_us: int = 60_000_000) -> DataFrame:
    """Desired segments with both ends moved out of the first utterance that each falls into (closed at both ends).

    An end nearer to the utterance's start goes 0.1 s before it, otherwise 0.1 s after its end. A point lies in
    one time bucket, so the interval join is an equi-join on (media, bucket) with a residual condition.
    Results may be negative or inverted.
    """
    points = desired.select("media_id", "seg_id", F.explode(F.array(F.struct(F.lit("s").alias("which"), F.col("start_us").alias("t")), F.struct(F.lit("e").alias("which"), F.col("end_us").alias("t")))).alias("p"))
    points = points.select("media_id", "seg_id", "p.which", "p.t").withColumn("bucket", F.expr(f"t div {bucket_us}"))
    spoken = spanning(utterances.select("media_id", "utt_id", "s_us", "e_us"), "s_us", "e_us", bucket_us)
    met = points.join(spoken, (points.media_id == spoken.media_id) & (points.bucket == spoken.bucket) & (F.col("t") >= F.col("s_us")) & (F.col("t") <= F.col("e_us")))
    first = met.groupBy(points.media_id, "seg_id").agg(*[F.min(F.when(F.col("which") == w, F.struct("s_us", "utt_id", "e_us"))).alias(w) for w in ("s", "e")])
    joined = desired.join(first, ["media_id", "seg_id"], "left")

    def moved(which: str, t: Column) -> tuple[Column, Column]:
        u = F.col(which)
        near_start = t - u["s_us"] < u["e_us"] - t
        return F.when(u.isNull(), t).when(near_start, u["s_us"] - 100_000).otherwise(u["e_us"] + 100_000), near_start

    start, _ = moved("s", F.col("start_us"))
    end, end_near_start = moved("e", F.col("end_us"))
    has_s, has_e = F.col("s").isNotNull(), F.col("e").isNotNull()
    reason = F.when(has_s & has_e, F.lit(BOTH_MOVED)).when(has_s, F.lit(START_MOVED)).when(has_e, F.lit(END_MOVED)).otherwise(F.lit(NO_CHANGE))
    return joined.select(
        "media_id", "seg_id", F.col("start_us").alias("wanted_start_us"), F.col("end_us").alias("wanted_end_us"), start.alias("start_us"), end.alias("end_us"),
        F.when(has_s, 0.9).otherwise(1.0).alias("start_confidence"),
        F.when(~has_e, 1.0).when(end_near_start, 0.9).otherwise(0.8).alias("end_confidence"), reason.alias("reason"),
    )


def overlapping_pairs(utterances: DataFrame, bucket_us: int = 60_000_000) -> DataFrame:
    """Pairs of utterances of one medium that overlap strictly, each once, by time buckets; a pair counts in the later one's first bucket."""
    spoken = spanning(utterances.select("media_id", "utt_id", "s_us", "e_us"), "s_us", "e_us", bucket_us)
    a, b = spoken.alias("a"), spoken.alias("b")
    first = F.expr(f"greatest(a.s_us, b.s_us) div {bucket_us}")
    met = a.join(b, (F.col("a.media_id") == F.col("b.media_id")) & (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.utt_id") < F.col("b.utt_id")) & (F.col("a.s_us") < F.col("b.e_us")) & (F.col("b.s_us") < F.col("a.e_us")) & (F.col("a.bucket") == first))
    return met.select(F.col("a.media_id").alias("media_id"), F.col("a.utt_id").alias("a_id"), F.col("b.utt_id").alias("b_id"), F.expr("least(a.e_us, b.e_us) - greatest(a.s_us, b.s_us)").alias("shared_us"))


def by_speaker(utterances: DataFrame) -> DataFrame:
    return utterances.groupBy(F.concat(F.lit("Speaker "), F.col("speaker").cast("string")).alias("speaker")).agg(
        F.count("*").alias("n"), F.sum(F.col("e_us") - F.col("s_us")).alias("spoken_us"), F.min("s_us").alias("first_us"), F.max("e_us").alias("last_us")
    )


def cue_file(cues: DataFrame, kind: str = "srt") -> DataFrame:
    """conv_id, content: each conversation's cues as one SRT or VTT text. A file's cues are one row by definition, so a conversation is one group."""
    sep, head = (",", "") if kind == "srt" else (".", "WEBVTT\n\n")
    times = F.concat(format_cue_ms(F.col("start_ms"), sep), F.lit(" --> "), format_cue_ms(F.col("end_ms"), sep), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("\n\n"))
    listed = cues.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", times.alias("cue")))).alias("cues"))
    entry = (lambda c, i: F.concat((i + 1).cast("string"), F.lit("\n"), c["cue"])) if kind == "srt" else (lambda c, i: c["cue"])
    return listed.select("conv_id", F.concat(F.lit(head), F.array_join(F.transform("cues", entry), "")).alias("content"))


@dataclass(frozen=True)
class SpeechOptions:
    """What a transcription was or will be asked for. The service itself is outside; its utterances are an input table."""

    language: str | None = None
    identify_speakers: bool = False
    word_timestamps: bool = True
    filter_profanity: bool = False
    custom_vocabulary: tuple[str, ...] = ()
    model: str | None = "nova-3"
    punctuation: bool = True
    utterances: bool = True
    audio_bitrate: int = 128
    auto_extract_audio: bool = True


def subtitles(utterances: DataFrame, language: str | None = None) -> DataFrame:
    """media_id, utt_id, start_us, end_us, text, speaker ('Speaker n', null stays null), language."""
    return utterances.select(
        "media_id", "utt_id", F.col("s_us").alias("start_us"), F.col("e_us").alias("end_us"), F.col("transcript").alias("text"),
        F.concat(F.lit("Speaker "), F.col("speaker").cast("string")).alias("speaker"), F.lit(language).cast("string").alias("language"),
    )


def speech_segments(utterances: DataFrame) -> DataFrame:
    """utterances, or NoResults if there are none. This one looks at the data: one row of it."""
    if utterances.isEmpty():
        raise NoResults("no speech was found")
    return utterances


def subtitles_json(cues: DataFrame) -> DataFrame:
    """conv_id, content: a conversation's cues as one JSON array, in order."""
    row = F.struct("turn", F.struct("start_ms", "end_ms", "text", "speaker").alias("cue"))
    return cues.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("c")).select("conv_id", F.to_json(F.transform("c", lambda x: x["cue"])).alias("content"))
