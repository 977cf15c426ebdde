"""Timeline queries over ``lineitem``, an order being a clip of 25 frames a second."""

from pyspark.sql import functions as F

from cutloom.operators import timeline as T
from cutloom.sources import adapters as A

SEGMENTS = [(80_000, 200_000), (0, 120_000), (40_000, 120_000)]
OUT = "clip_id, idx, pts_us, payload"


def _values() -> str:
    offset, rows = 0, []
    for k, (a, b) in enumerate(SEGMENTS):
        rows.append(f"({k}, {a}, {b}, {offset})")
        offset += b - a
    return f"segs(ord, a, b, off) AS (VALUES {', '.join(rows)})"


SPLICED = f"""{_values()}, spliced AS (
  SELECT clip_id, row_number() OVER (PARTITION BY clip_id ORDER BY ord, idx) - 1 AS idx, pts_us - a + off AS pts_us, payload FROM frames JOIN segs ON pts_us >= a AND pts_us < b)"""
REVERSED = "reversed AS (SELECT clip_id, max(idx) OVER w - idx AS idx, max(pts_us) OVER w - pts_us AS pts_us, payload FROM {0} WINDOW w AS (PARTITION BY clip_id))"
LOOPED = """looped AS (SELECT clip_id, idx, pts_us, payload FROM {0} UNION ALL
  SELECT clip_id, 2 * max(idx) OVER w + 1 - idx, 2 * max(pts_us) OVER w + 40000 - pts_us, payload FROM {0} WINDOW w AS (PARTITION BY clip_id))"""


def _made(s, d):
    """Loops with the reversed clips kept; the clips of urgent orders have sound, a sample a frame."""
    frames = A.frames(s, d)
    urgent = A.read(s, d, "orders").filter("o_orderpriority < '3'").select(F.col("o_orderkey").alias("clip_id"))
    return T.make_loop(frames, frames.join(urgent, "clip_id", "left_semi").withColumn("payload", -F.col("payload")), keep_reversed=True)


def _own_segments(s, d):
    """Each clip's own segments, from a table: one from its first to fourth frame on over two minutes, one of its first frames, an empty one."""
    clips = A.read(s, d, "orders").select(F.col("o_orderkey").alias("clip_id"), (F.col("o_orderkey") % 4 * 40_000).alias("from_us"))
    rows = F.array(*[F.struct(F.lit(k).alias("ord"), a.cast("long").alias("start_us"), b.cast("long").alias("end_us")) for k, (a, b) in enumerate([(F.col("from_us"), F.lit(130_000_000)), (F.lit(0), F.lit(90_000)), (F.lit(40_000), F.lit(40_000))])])
    return T.splice(A.frames(s, d), clips.select("clip_id", F.explode(rows).alias("r")).select("clip_id", "r.*"))


QUERIES = {
    "timeline_splice_table": _own_segments,
    "timeline_copy": lambda s, d: T.splice(A.frames(s, d), []),
    "timeline_make_loop": _made,
    "timeline_chain_poster": lambda s, d: T.Timeline(A.frames(s, d)).splice(SEGMENTS).reverse().loop().poster(),
    "timeline_extracted": lambda s, d: T.extracted(A.frames(s, d), "out.mp4.mp4", 20_000, 320_000, 30.0, 5),
    "timeline_splice": lambda s, d: T.splice(A.frames(s, d), SEGMENTS),
    "timeline_sequentise": lambda s, d: T.sequentise(A.frames(s, d), 20_000, 320_000, 30.0),
    "timeline_reverse": lambda s, d: T.reverse(A.frames(s, d)),
    "timeline_loop": lambda s, d: T.loop(A.frames(s, d)),
    "timeline_poster": lambda s, d: T.poster(A.frames(s, d), SEGMENTS[0][0]),
    "timeline_chain": lambda s, d: T.Timeline(A.frames(s, d)).splice(SEGMENTS).reverse().loop().frames,
}
ORACLE = {
    "timeline_make_loop": f"""WITH {A.FRAMES}, {LOOPED.format('frames')}, {REVERSED.format('frames')}, heard AS (SELECT o_orderkey FROM orders WHERE o_orderpriority < '3')
SELECT {OUT}, 'video' AS part FROM looped UNION ALL SELECT {OUT}, 'reversed' FROM reversed
UNION ALL SELECT clip_id, idx, pts_us, -payload, 'audio' FROM looped WHERE clip_id IN (FROM heard) UNION ALL SELECT clip_id, idx, pts_us, -payload, 'reversed audio' FROM reversed WHERE clip_id IN (FROM heard)""",
    "timeline_extracted": f"""WITH {A.FRAMES}, shots AS (SELECT clip_id, shot, 20000 + CAST(floor(shot * 1000000 / 30.0::DOUBLE) AS BIGINT) AS t_us FROM (SELECT DISTINCT clip_id FROM frames), range(9) r(shot))
SELECT s.clip_id, s.shot, s.t_us, max(f.idx) AS idx, arg_max(f.payload, f.idx) AS payload, 'out_' || lpad(CAST(s.shot + 1 AS VARCHAR), 5, '0') || '.png' AS file, 5 AS quality FROM shots s JOIN frames f ON f.clip_id = s.clip_id AND f.pts_us <= s.t_us GROUP BY ALL""",
    # The time is one of the file that the chain reads, whatever is done to its frames.
    "timeline_chain_poster": f"WITH {A.FRAMES} SELECT {OUT} FROM frames QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY abs(pts_us - {SEGMENTS[0][0]}), idx) = 1",
    "timeline_splice": f"WITH {A.FRAMES}, {SPLICED} SELECT {OUT} FROM spliced",
    "timeline_sequentise": f"""WITH {A.FRAMES}, shots AS (SELECT clip_id, shot, 20000 + CAST(floor(shot * 1000000 / 30.0::DOUBLE) AS BIGINT) AS t_us FROM (SELECT DISTINCT clip_id FROM frames), range(9) r(shot))
SELECT s.clip_id, s.shot, s.t_us, max(f.idx) AS idx, arg_max(f.payload, f.idx) AS payload FROM shots s JOIN frames f ON f.clip_id = s.clip_id AND f.pts_us <= s.t_us GROUP BY ALL""",
    "timeline_reverse": f"WITH {A.FRAMES}, {REVERSED.format('frames')} SELECT {OUT} FROM reversed",
    "timeline_loop": f"WITH {A.FRAMES}, {LOOPED.format('frames')} SELECT {OUT} FROM looped",
    "timeline_poster": f"WITH {A.FRAMES} SELECT {OUT} FROM frames QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY abs(pts_us - {SEGMENTS[0][0]}), idx) = 1",
    "timeline_chain": f"WITH {A.FRAMES}, {SPLICED}, {REVERSED.format('spliced')}, {LOOPED.format('reversed')} SELECT {OUT} FROM looped",
}
ORACLE |= {
    "timeline_copy": f"WITH {A.FRAMES} SELECT {OUT} FROM frames",
    "timeline_splice_table": f"""WITH {A.FRAMES}, own AS (SELECT o_orderkey AS clip_id, o_orderkey % 4 * 40000 AS a FROM orders), segs AS (SELECT clip_id, 0 AS ord, a, 130000000 AS b, 0 AS off FROM own UNION ALL SELECT clip_id, 1, 0, 90000, 130000000 - a FROM own)
SELECT clip_id, row_number() OVER (PARTITION BY clip_id ORDER BY ord, idx) - 1 AS idx, pts_us - a + off AS pts_us, payload FROM frames JOIN segs USING (clip_id) WHERE pts_us >= a AND pts_us < b""",
}
