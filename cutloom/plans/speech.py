"""Speech queries over ``events`` and cue files over ``conversations``."""

from pyspark.sql import functions as F

from cutloom.operators import speech
from cutloom.sources import adapters as A
from cutloom.sources import config as C

MIN_GAP, MAX = 2_000_000, 3_600_000_000  # the events of a user are hours apart, so segments may last an hour

BREAKS = f"""breaks AS (
  SELECT media_id, utt_id, e_us + (nxt - e_us) // 2 AS break_us FROM (
    SELECT *, lead(s_us) OVER (PARTITION BY media_id ORDER BY s_us, utt_id) AS nxt FROM utterances) WHERE nxt - e_us >= {MIN_GAP})"""
TENTHS = "CAST((({0}) + 50000) // 100000 // 10 AS VARCHAR) || '.' || CAST((({0}) + 50000) // 100000 % 10 AS VARCHAR)"



def _clips(s, d):
    """The clips out as one document a medium, and in again."""
    back = C.clips_from_json(C.clips_to_json(speech.skeleton_clips(A.utterances(s, d), min_gap_us=MIN_GAP, max_us=MAX, by_medium=True)))
    return back.select("path", "clip_ord", "name", "op_type", F.size("segments").alias("n"), F.round(F.col("segments")[0]["start"], 6).alias("from_s"), F.round(F.col("segments")[0]["end"], 6).alias("to_s"))


QUERIES = {
    "speech_skeleton_clips": _clips,
    "speech_natural_breaks": lambda s, d: speech.natural_breaks(A.utterances(s, d)),
    "speech_skeleton_segments": lambda s, d: speech.skeleton_segments(A.utterances(s, d), MIN_GAP, MAX),
    "speech_speaker_cuts": lambda s, d: speech.speaker_cuts(A.utterances(s, d)),
    "speech_optimal_cuts": lambda s, d: speech.optimal_cuts(A.utterances(s, d), A.desired(s, d)),
    "speech_by_speaker": lambda s, d: speech.by_speaker(A.utterances(s, d)),
    "range_overlaps": lambda s, d: speech.overlapping_pairs(A.utterances(s, d)),
    "cues_srt": lambda s, d: speech.cue_file(A.cues(s, d), "srt"),
    "cues_vtt": lambda s, d: speech.cue_file(A.cues(s, d), "vtt"),
}


def _stamp(ms: str, sep: str) -> str:
    part = lambda e, n: f"lpad(CAST({e} AS VARCHAR), {n}, '0')"
    return f"{part(f'{ms} // 3600000', 2)} || ':' || {part(f'{ms} // 60000 % 60', 2)} || ':' || {part(f'{ms} // 1000 % 60', 2)} || '{sep}' || {part(f'{ms} % 1000', 3)}"


def _cues(kind: str) -> str:
    sep, head = (",", "''") if kind == "srt" else (".", "'WEBVTT' || chr(10) || chr(10)")
    number = "CAST(nth AS VARCHAR) || chr(10) || " if kind == "srt" else ""
    body = f"{number}{_stamp('start_ms', sep)} || ' --> ' || {_stamp('end_ms', sep)} || chr(10) || text || chr(10) || chr(10)"
    return f"""WITH {A.CUES}, numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth FROM cues)
SELECT conv_id, {head} || string_agg({body}, '' ORDER BY turn) AS content FROM numbered GROUP BY conv_id"""


def _first(which: str, t: str) -> str:
    return f"""{which}u AS (
  SELECT seg_id, s_us, e_us FROM (SELECT d.seg_id, u.s_us, u.e_us, row_number() OVER (PARTITION BY d.seg_id ORDER BY u.s_us, u.utt_id) AS nth
    FROM desired d JOIN utterances u ON d.media_id = u.media_id AND d.{t} BETWEEN u.s_us AND u.e_us) WHERE nth = 1)"""


_NUMBERED = f"""WITH {A.UTTERANCES}, {BREAKS}, spans AS (
  SELECT media_id, lag(break_us, 1, 0) OVER (PARTITION BY media_id ORDER BY break_us) AS a, break_us AS b FROM breaks
), counted AS (SELECT *, greatest(1, CAST(ceil((b - a) / {MAX}.0) AS BIGINT)) AS n FROM spans
), parts AS (SELECT media_id, a + i * (b - a) // n AS start_us, a + (i + 1) * (b - a) // n AS end_us FROM (SELECT *, unnest(range(n)) AS i FROM counted)
), ends AS (SELECT media_id, arg_max(e_us, (s_us, utt_id)) + 5000000 AS end_us FROM utterances GROUP BY media_id
), tails AS (SELECT e.media_id, coalesce(b.start_us, 0) AS start_us, e.end_us FROM ends e LEFT JOIN (SELECT media_id, max(break_us) AS start_us FROM breaks GROUP BY media_id) b ON e.media_id = b.media_id
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY start_us, end_us) AS seg FROM (SELECT * FROM parts UNION ALL SELECT * FROM tails WHERE start_us < end_us))"""

ORACLE = {
    "speech_natural_breaks": f"WITH {A.UTTERANCES}, {BREAKS} SELECT media_id, utt_id, break_us FROM breaks",
    "speech_skeleton_segments": f"""{_NUMBERED}
SELECT media_id, seg, start_us, end_us, 'segment_' || CASE WHEN seg < 1000 THEN lpad(CAST(seg AS VARCHAR), 3, '0') ELSE CAST(seg AS VARCHAR) END AS name,
  'Natural segment ' || CAST(seg AS VARCHAR) || ' (' || {TENTHS.format('start_us')} || 's - ' || {TENTHS.format('end_us')} || 's, duration: ' || {TENTHS.format('end_us - start_us')} || 's)' AS description FROM numbered""",
    "speech_skeleton_clips": f"""{_NUMBERED}
SELECT CAST(media_id AS VARCHAR) AS path, CAST(seg - 1 AS INTEGER) AS clip_ord, 'segment_' || CASE WHEN seg < 1000 THEN lpad(CAST(seg AS VARCHAR), 3, '0') ELSE CAST(seg AS VARCHAR) END AS name, 'splice' AS op_type, 1 AS n,
  round(start_us / 1000000.0::DOUBLE, 6) AS from_s, round(end_us / 1000000.0::DOUBLE, 6) AS to_s FROM numbered""",
    "speech_speaker_cuts": f"""WITH {A.UTTERANCES}, seen AS (SELECT *, lag(speaker) OVER w AS was, lag(e_us) OVER w AS before FROM utterances WINDOW w AS (PARTITION BY media_id ORDER BY s_us, utt_id))
SELECT media_id, utt_id, (s_us + before) // 2 AS cut_us FROM seen WHERE was <> speaker""",
    "speech_optimal_cuts": f"""WITH {A.UTTERANCES}, {A.DESIRED}, {_first('s', 'start_us')}, {_first('e', 'end_us')}
SELECT d.media_id, d.seg_id, d.start_us AS wanted_start_us, d.end_us AS wanted_end_us,
  CASE WHEN su.seg_id IS NULL THEN d.start_us WHEN d.start_us - su.s_us < su.e_us - d.start_us THEN su.s_us - 100000 ELSE su.e_us + 100000 END AS start_us,
  CASE WHEN eu.seg_id IS NULL THEN d.end_us WHEN d.end_us - eu.s_us < eu.e_us - d.end_us THEN eu.s_us - 100000 ELSE eu.e_us + 100000 END AS end_us,
  CASE WHEN su.seg_id IS NULL THEN 1.0::DOUBLE ELSE 0.9::DOUBLE END AS start_confidence,
  CASE WHEN eu.seg_id IS NULL THEN 1.0::DOUBLE WHEN d.end_us - eu.s_us < eu.e_us - d.end_us THEN 0.9::DOUBLE ELSE 0.8::DOUBLE END AS end_confidence,
  CASE WHEN su.seg_id IS NOT NULL AND eu.seg_id IS NOT NULL THEN '{speech.BOTH_MOVED}' WHEN su.seg_id IS NOT NULL THEN '{speech.START_MOVED}' WHEN eu.seg_id IS NOT NULL THEN '{speech.END_MOVED}' ELSE '{speech.NO_CHANGE}' END AS reason
FROM desired d LEFT JOIN su ON d.seg_id = su.seg_id LEFT JOIN eu ON d.seg_id = eu.seg_id""",
    "speech_by_speaker": f"WITH {A.UTTERANCES} SELECT 'Speaker ' || CAST(speaker AS VARCHAR) AS speaker, count(*) AS n, CAST(sum(e_us - s_us) AS BIGINT) AS spoken_us, min(s_us) AS first_us, max(e_us) AS last_us FROM utterances GROUP BY 1",
    "range_overlaps": f"WITH {A.UTTERANCES} SELECT a.media_id, a.utt_id AS a_id, b.utt_id AS b_id, least(a.e_us, b.e_us) - greatest(a.s_us, b.s_us) AS shared_us FROM utterances a JOIN utterances b ON a.media_id = b.media_id AND a.utt_id < b.utt_id AND a.s_us < b.e_us AND b.s_us < a.e_us",
    "cues_srt": _cues("srt"),
    "cues_vtt": _cues("vtt"),
}
