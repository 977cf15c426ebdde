"""Scalar function queries."""

from pyspark.sql import functions as F

from cutloom.functions import scalars as S
from cutloom.sources import adapters as A

EXTENSIONS = ("mp4", "MKV", "3gp", "wav", "flac", "txt", "mov", "")


def _paths(s, d):
    ext = F.get(F.array(*[F.lit(x) for x in EXTENSIONS]), (F.col("page_id") % len(EXTENSIONS)).cast("int"))
    return A.read(s, d, "pages").select("page_id", F.concat(F.lit("/media/clip."), F.col("page_id").cast("string"), F.when(ext != "", F.concat(F.lit("."), ext)).otherwise(F.lit("/.mp4"))).alias("path"))


PATHS = f"""paths AS (SELECT page_id, '/media/clip.' || CAST(page_id AS VARCHAR) || CASE WHEN e = '' THEN '/.mp4' ELSE '.' || e END AS path
  FROM (SELECT page_id, ([{', '.join(repr(x) for x in EXTENSIONS)}])[page_id % {len(EXTENSIONS)} + 1] AS e FROM pages)),
  exts AS (SELECT *, nullif(lower(regexp_extract(path, '[^/]\\.([^./]+)$', 1)), '') AS ext FROM paths)"""


def _files(s, d):
    p = F.col("path")
    return _paths(s, d).select(
        "page_id", S.file_extension(p).alias("ext"), S.is_video_file(p).alias("is_video"), S.needs_audio_extraction(p).alias("needs_audio"),
        S.has_extension(p, S.SPEECH_EXTENSIONS).alias("supported"), S.mime_type(p).alias("mime"), S.poster_path(p).alias("poster"),
    )


def _times(s, d):
    v = F.col("value") * 60
    a, b = S.format_timestamp(v), S.format_cue_timestamp(v, ".")
    return A.read(s, d, "events").select("event_id", a.alias("stamp"), b.alias("cue_stamp"), F.round(S.parse_timestamp(a) * 1000).cast("long").alias("parsed_ms"))


def _parsed(s, d):
    text = F.when(F.col("event_id") % 4 == 0, F.concat((F.col("event_id") % 100).cast("string"), F.lit(":"), F.col("value").cast("decimal(10,2)").cast("string"))).when(F.col("event_id") % 4 == 1, F.lit("1:2:3:4")).when(F.col("event_id") % 4 == 2, F.lit("a:10")).otherwise(F.lit("99:99:5.5"))
    return A.read(s, d, "events").select("event_id", F.coalesce(F.round(S.parse_timestamp(text) * 100).cast("long"), F.lit(-1)).alias("centis"))


def _shapes(s, d):
    p = A.read(s, d, "part").select("p_partkey", (F.col("p_size") * 16).cast("long").alias("w"), (F.col("p_partkey") % 90 * 12).alias("h"))
    ratio = S.aspect_ratio(F.col("w"), F.col("h"))
    return p.select("p_partkey", ratio["width"].alias("ratio_w"), ratio["height"].alias("ratio_h"), S.is_standard_resolution(F.col("w"), F.col("h")).alias("standard"), (F.col("w") * F.col("h")).alias("area"))


def _boxed(s, d):
    b, c = A.boxes(s, d), F.col
    inside = S.rectangle_contains(c("x0"), c("y0"), c("x1") - c("x0"), c("y1") - c("y0"), F.lit(150), F.lit(150))
    return b.select("shape_id", inside.alias("inside"), F.round(S.distance(c("x0"), c("y0"), F.lit(150), F.lit(150)), 6).alias("away"), ((c("x1") - c("x0")) * (c("y1") - c("y0"))).alias("area"))


def _letterbox(s, d):
    c = F.col
    p = A.read(s, d, "part").select("p_partkey", (c("p_partkey") % 1024).alias("px"), (c("p_partkey") * 7 % 1024).alias("py"), (F.lit(320) + c("p_size") * 16).alias("ow"), (F.lit(200) + c("p_partkey") % 50 * 10).alias("oh"))
    xy = S.letterbox_inverse(c("px"), c("py"), c("ow"), c("oh"), F.lit(1024), F.lit(1024))
    return p.select("p_partkey", F.round(xy["x"], 4).alias("x"), F.round(xy["y"], 4).alias("y"))


def _prompts(s, d):
    c = F.col
    text = F.concat_ws(" ", F.concat_ws(",", c("p_partkey"), c("p_size")), F.when(c("p_partkey") % 3 == 0, F.lit("7,x")).otherwise(F.lit("1.5,2")))
    points = S.parse_points(text)
    p = A.read(s, d, "part").select("p_partkey", points.alias("points"), S.pad_labels(F.array(F.lit(0)), F.size(points)).alias("labels"))
    return p.select("p_partkey", F.posexplode(F.arrays_zip("points", "labels")).alias("nth", "p")).select("p_partkey", "nth", c("p.points.x").alias("x"), c("p.points.y").alias("y"), c("p.labels").alias("label"))


QUERIES = {
    "file_paths": _files,
    "file_size_format": lambda s, d: A.read(s, d, "documents").select("doc_id", S.format_file_size(F.col("n_chars") * F.col("n_chars") * (F.col("doc_id") % 5)).alias("size")),
    "ts_format": _times,
    "ts_parse": _parsed,
    "aspect_ratio_gcd": _shapes,
    "rect_contains": _boxed,
    "letterbox_inverse": _letterbox,
    "prompt_points": _prompts,
    "language_codes": lambda s, d: A.read(s, d, "documents").select("doc_id", S.language_code(F.col("lang")).alias("code"), S.speech_model(F.get(F.array(*[F.lit(x) for x in ("nova", "nova-2", "base", "tiny")]), (F.col("doc_id") % 4).cast("int"))).alias("model")),
    "coordinate_rounding": lambda s, d: A.rings(s, d).select("shape_id", F.posexplode("ring").alias("k", "p")).select("shape_id", "k", S.round_coordinate(F.col("p.x")).alias("x"), S.round_coordinate(F.col("p.y")).alias("y")),
}

_PAD = "lpad(CAST({0} AS VARCHAR), {1}, '0')"
_MS = "CAST(floor(v * 1000) AS BIGINT)"


def _unit() -> str:
    sizes = " ".join(f"WHEN b < {1024.0 ** (k + 1)!r}::DOUBLE THEN format('{{:.1f}} {u}', round_even(b / {1024.0**k!r}::DOUBLE, 1))" for k, u in enumerate(S.SIZE_UNITS[:-1]))
    return f"CASE WHEN b = 0 THEN '0 B' {sizes} ELSE format('{{:.1f}} TB', round_even(b / {1024.0**4!r}::DOUBLE, 1)) END"


ORACLE = {
    "file_paths": f"""WITH {PATHS} SELECT page_id, ext, coalesce(ext IN {S.VIDEO_EXTENSIONS!r}, false) AS is_video, coalesce(ext IN {S.SPEECH_VIDEO_EXTENSIONS!r}, false) AS needs_audio,
  coalesce(ext IN {S.SPEECH_EXTENSIONS!r}, false) AS supported, CASE ext {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in S.MIME_TYPES.items())} END AS mime,
  CASE WHEN ends_with(path, '.mp4') THEN replace(path, '.mp4', '_poster.png') WHEN ends_with(path, '.mov') THEN replace(path, '.mov', '_poster.png') WHEN ends_with(path, '.avi') THEN replace(path, '.avi', '_poster.png') ELSE path || '_poster.png' END AS poster FROM exts""",
    "file_size_format": f"SELECT doc_id, {_unit()} AS size FROM (SELECT doc_id, CAST(n_chars * n_chars * (doc_id % 5) AS DOUBLE) AS b FROM documents)",
    "ts_format": f"""WITH t AS (SELECT event_id, greatest(value * 60, 0.0) AS v FROM events), p AS (SELECT *, CAST(floor(v) AS BIGINT) AS w, CAST(floor((v - floor(v)) * 1000) AS BIGINT) AS f FROM t)
SELECT event_id, {_PAD.format('w // 3600', 2)} || ':' || {_PAD.format('w % 3600 // 60', 2)} || ':' || {_PAD.format('w % 60', 2)} || '.' || {_PAD.format('f', 3)} AS stamp,
  {_PAD.format(f'{_MS} // 3600000', 2)} || ':' || {_PAD.format(f'{_MS} // 60000 % 60', 2)} || ':' || {_PAD.format(f'{_MS} // 1000 % 60', 2)} || '.' || {_PAD.format(f'{_MS} % 1000', 3)} AS cue_stamp, w * 1000 + f AS parsed_ms FROM p""",
    "ts_parse": "SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_id % 100 * 6000 + CAST(CAST(value AS DECIMAL(10,2)) * 100 AS BIGINT) WHEN 3 THEN 99 * 360000 + 99 * 6000 + 550 ELSE -1 END AS centis FROM events",
    "aspect_ratio_gcd": "SELECT p_partkey, w // gcd(w, h) AS ratio_w, h // gcd(w, h) AS ratio_h, (w, h) IN ((1920, 1080), (3840, 2160), (1280, 720), (854, 480), (640, 360)) AS standard, w * h AS area FROM (SELECT p_partkey, CAST(p_size * 16 AS BIGINT) AS w, p_partkey % 90 * 12 AS h FROM part)",
    "rect_contains": f"WITH {A.BOXES} SELECT shape_id, 150 BETWEEN x0 AND x1 AND 150 BETWEEN y0 AND y1 AS inside, round(sqrt((150 - x0) * (150 - x0) + (150 - y0) * (150 - y0)), 6) AS away, (x1 - x0) * (y1 - y0) AS area FROM boxes",
    "letterbox_inverse": """WITH p AS (SELECT p_partkey, p_partkey % 1024 AS px, p_partkey * 7 % 1024 AS py, 320 + p_size * 16 AS ow, 200 + p_partkey % 50 * 10 AS oh FROM part), s AS (SELECT *, greatest(ow / 1024, oh / 1024) AS scale FROM p)
SELECT p_partkey, round((px - (1024 - ow / scale) / 2) * scale, 4) AS x, round((py - (1024 - oh / scale) / 2) * scale, 4) AS y FROM s""",
    "prompt_points": """SELECT p_partkey, 0 AS nth, CAST(p_partkey AS DOUBLE) AS x, CAST(p_size AS DOUBLE) AS y, 0 AS label FROM part UNION ALL
SELECT p_partkey, 1, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 1.5::DOUBLE END, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 2.0::DOUBLE END, 1 FROM part""",
    "language_codes": f"SELECT doc_id, CASE WHEN lang IN {S.LANGUAGES!r} THEN lang WHEN lang IS NOT NULL THEN 'en_US' END AS code, CASE doc_id % 4 WHEN 0 THEN 'Nova3' WHEN 1 THEN 'Nova2' WHEN 2 THEN 'Nova3' ELSE 'Nova2' END AS model FROM documents",
    "coordinate_rounding": f"WITH {A.RINGS} SELECT shape_id, CAST(k AS INTEGER) AS k, sign(x) * floor(abs(x) * 1000.0::DOUBLE + 0.5::DOUBLE) / 1000.0::DOUBLE AS x, sign(y) * floor(abs(y) * 1000.0::DOUBLE + 0.5::DOUBLE) / 1000.0::DOUBLE AS y FROM pts",
}


def _shapes(s, d):
    p = A.read(s, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("w"), (F.col("p_partkey") % 9).cast("double").alias("h"))
    moved = S.translate(F.col("w"), F.col("h"), F.lit(1.5), F.lit(-2.0))
    turned = S.affine(F.col("w"), F.col("h"), (0.0, -1.0, 10.0, 1.0, 0.0, 0.5))
    span = S.range_from_duration(F.col("p_partkey"), F.col("w").cast("long") - 25)
    return p.select(
        "p_partkey", S.size_area(F.col("w"), F.col("h")).alias("area"), F.round(S.size_aspect(F.col("w"), F.col("h")), 6).alias("aspect"), moved["x"].alias("mx"), moved["y"].alias("my"),
        turned["x"].alias("tx"), turned["y"].alias("ty"), F.coalesce(span["end"], F.lit(-1)).alias("range_end"), S.timecode(F.col("p_partkey") * 7_654_321).alias("timecode"),
    )


def _prompts(s, d):
    """Boxes and a prompt written out of each part's numbers, every seventh box not whole, and read again."""
    k, z = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    boxes = F.concat(k, F.lit(","), z, F.lit(",10.5,"), F.when(F.col("p_partkey") % 7 == 0, F.lit("x")).otherwise(z), F.lit("  1,2,3,4"))
    p = A.read(s, d, "part").select("p_partkey", S.parse_boxes(boxes).alias("b"), S.parse_prompt(F.concat(z, F.lit(":2:"), k, F.lit(",5"))).alias("q"))
    return p.select("p_partkey", F.size("b").alias("n"), F.col("b")[0]["x1"].alias("x1"), F.col("b")[0]["y2"].alias("y2"), F.col("b")[1]["y2"].alias("second"), "q.frame", "q.object", F.col("q.points")[0]["x"].alias("px"))


QUERIES |= {"shape_scalars": _shapes, "prompt_parse": _prompts}
ORACLE |= {
    "shape_scalars": """WITH p AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS w, CAST(p_partkey % 9 AS DOUBLE) AS h, p_partkey * 7654321 AS us FROM part)
SELECT p_partkey, w * h AS area, CASE WHEN h <> 0 THEN round(w / h, 6) END AS aspect, w + 1.5 AS mx, h - 2.0 AS my, 10.0 - h AS tx, w + 0.5 AS ty, CASE WHEN w > 25 THEN p_partkey + CAST(w AS BIGINT) - 25 ELSE -1 END AS range_end,
  concat_ws(':', CASE WHEN us // 3600000000 < 100 THEN lpad(CAST(us // 3600000000 AS VARCHAR), 2, '0') ELSE left(CAST(us // 3600000000 AS VARCHAR), 2) END, lpad(CAST(us // 60000000 % 60 AS VARCHAR), 2, '0'), lpad(CAST(us // 1000000 % 60 AS VARCHAR), 2, '0'), lpad(CAST(us % 1000000 * 25 // 1000000 AS VARCHAR), 2, '0')) AS timecode FROM p""",
    "prompt_parse": """SELECT p_partkey, 2 AS n, CASE WHEN p_partkey % 7 <> 0 THEN CAST(p_partkey AS DOUBLE) END AS x1, CASE WHEN p_partkey % 7 <> 0 THEN CAST(p_size AS DOUBLE) END AS y2, 4.0::DOUBLE AS second, CAST(p_size AS INTEGER) AS frame, 2 AS object, CAST(p_partkey AS DOUBLE) AS px FROM part""",
}
