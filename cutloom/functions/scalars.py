"""Scalar functions on columns: ranges, points, sizes, timestamps, file names and sizes, colours, prompts.

Errors of single values become nulls (Spark's try_ functions); times are seconds as DOUBLE unless a name ends in _us.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions, media types, languages and resolutions that the functions below know.
VIDEO_EXTENSIONS = ("mp4", "avi", "mov", "mkv", "webm", "flv", "wmv", "m4v")
SPEECH_VIDEO_EXTENSIONS = ("mp4", "avi", "mov", "webm", "mkv", "wmv", "m4v", "3gp", "flv")
SPEECH_EXTENSIONS = ("mp3", "mp4", "wav", "flac", "ogg", "m4a", "webm", "avi", "mov", "aac", "mkv", "wmv", "m4v", "3gp", "flv")
MIME_TYPES = {
    "mp3": "audio/mpeg", "mp4": "video/mp4", "wav": "audio/wav", "flac": "audio/flac", "ogg": "audio/ogg",
    "m4a": "audio/mp4", "webm": "video/webm", "avi": "video/x-msvideo", "mov": "video/quicktime", "aac": "audio/aac",
}
LANGUAGES = ("es", "fr", "de", "it", "pt", "ru", "ja", "ko", "zh", "nl", "tr", "pl", "sv", "bg", "cs", "da", "el", "fi", "et")
MODELS = {"nova-3": "Nova3", "nova-2": "Nova2", "nova": "Nova3", "enhanced": "Nova3", "base": "Nova3"}
STANDARD_RESOLUTIONS = ((1920, 1080), (3840, 2160), (1280, 720), (854, 480), (640, 360))
SIZE_UNITS = ("B", "KB", "MB", "GB", "TB")


def make_range(start: Column, end: Column) -> Column:
    """A (start, end) struct, null unless start < end."""
    return F.when(start < end, F.struct(start.alias("start"), end.alias("end")))


def range_from_duration(start: Column, duration: Column) -> Column:
    """A (start, end) struct of that length, null unless it is over 0."""
    return make_range(start, start + duration)


def translate(x: Column, y: Column, dx: Column, dy: Column) -> Column:
    return F.struct((x + dx).alias("x"), (y + dy).alias("y"))


def affine(x: Column, y: Column, m: tuple[float, float, float, float, float, float]) -> Column:
    """(a x + b y + c, d x + e y + f)."""
    a, b, c, d, e, f = m
    return F.struct((x * a + y * b + c).alias("x"), (x * d + y * e + f).alias("y"))


def size_area(width: Column, height: Column) -> Column:
    return width * height


def size_aspect(width: Column, height: Column) -> Column:
    """width / height, null for a height of 0."""
    return F.try_divide(width.cast("double"), height.cast("double"))


def timecode(us: Column, fps: int = 25) -> Column:
    """HH:MM:SS:FF of a time in microseconds, not under 0."""
    part = lambda e: F.lpad(e.cast("string"), 2, "0")
    s = F.floor(us / 1_000_000)
    return F.concat_ws(":", part(F.floor(s / 3600)), part(F.floor(s / 60) % 60), part(s % 60), part(F.floor(us % 1_000_000 * fps / 1_000_000)))


def range_duration(r: Column) -> Column:
    return r["end"] - r["start"]


def range_contains(r: Column, t: Column) -> Column:
    """Closed at both ends."""
    return (r["start"] <= t) & (t <= r["end"])


def ranges_overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Strict: ranges that only touch don't overlap."""
    return (a_start < b_end) & (b_start < a_end)


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))


def rectangle_contains(x: Column, y: Column, width: Column, height: Column, px: Column, py: Column) -> Column:
    """Closed on all sides."""
    return (px >= x) & (px <= x + width) & (py >= y) & (py <= y + height)


def gcd(a: Column, b: Column, steps: int = 48) -> Column:
    """Greatest common divisor of non-negative integers below 2**32: Euclid's steps, of which 48 are always enough there."""
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.try_mod(s["a"], s["b"]).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda s: s["a"])


def aspect_ratio(width: Column, height: Column) -> Column:
    """Width and height over their greatest common divisor; null for 0 x 0."""
    g = gcd(width, height)
    return F.when(g > 0, F.struct((width / g).cast("long").alias("width"), (height / g).cast("long").alias("height")))


def is_standard_resolution(width: Column, height: Column) -> Column:
    out = F.lit(False)
    for w, h in STANDARD_RESOLUTIONS:
        out = out | ((width == w) & (height == h))
    return out


def format_timestamp(seconds: Column) -> Column:
    """HH:MM:SS.mmm, the milliseconds cut from the fraction; negative times count as 0."""
    s = F.greatest(seconds.cast("double"), F.lit(0.0))
    whole = F.floor(s)
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(whole / 3600), F.floor((whole % 3600) / 60), whole % 60, F.floor((s - whole) * 1000))


def format_cue_timestamp(seconds: Column, separator: str = ",") -> Column:
    """HH:MM:SS,mmm from all milliseconds cut at once, which can differ from format_timestamp's by one; separator '.' for VTT."""
    return format_cue_ms(F.floor(F.greatest(seconds.cast("double"), F.lit(0.0)) * 1000), separator)


def format_cue_ms(ms: Column, separator: str = ",") -> Column:
    return F.format_string(f"%02d:%02d:%02d{separator}%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def parse_timestamp(text: Column) -> Column:
    """Seconds of HH:MM:SS or MM:SS, fractions allowed, no ranges checked; null for anything else."""
    parts = F.split(text, ":")
    number = lambda k: F.get(parts, k).try_cast("double")
    return F.when(F.size(parts) == 3, number(F.lit(0)) * 3600 + number(F.lit(1)) * 60 + number(F.lit(2))).when(F.size(parts) == 2, number(F.lit(0)) * 60 + number(F.lit(1)))


def format_file_size(n_bytes: Column) -> Column:
    """One decimal of the greatest unit up to TB; exact halves round to even."""
    n = n_bytes.cast("double")
    out = F.when(n_bytes == 0, F.lit("0 B"))
    for power, unit in enumerate(SIZE_UNITS):
        small = n < float(1024 ** (power + 1)) if power + 1 < len(SIZE_UNITS) else F.lit(True)
        out = out.when(small, F.concat(F.format_string("%.1f", F.bround(n / float(1024**power), 1)), F.lit(f" {unit}")))
    return out


def file_extension(path: Column) -> Column:
    """Lower-case extension of the file name, null if none; a leading dot alone makes none."""
    return F.lower(F.nullif(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1), F.lit("")))


def has_extension(path: Column, extensions) -> Column:
    return F.coalesce(file_extension(path).isin(*extensions), F.lit(False))


def is_video_file(path: Column) -> Column:
    return has_extension(path, VIDEO_EXTENSIONS)


def needs_audio_extraction(path: Column) -> Column:
    """Whether the speech reader takes the file for a video: is_video_file's extensions and 3gp."""
    return has_extension(path, SPEECH_VIDEO_EXTENSIONS)


def mime_type(path: Column) -> Column:
    """Media type for upload; null where there is none, which some supported formats lack too."""
    table = F.create_map(*[F.lit(x) for pair in MIME_TYPES.items() for x in pair])
    return F.try_element_at(table, file_extension(path))


def language_code(language: Column) -> Column:
    """en_US for en and for unknown codes; null stays null."""
    return F.when(language.isin(*LANGUAGES), language).when(language.isNotNull(), F.lit("en_US"))


def speech_model(model: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in MODELS.items() for x in pair])
    return F.when(model.isNotNull(), F.coalesce(F.try_element_at(table, model), F.lit("Nova2")))


def speaker_label(speaker: Column) -> Column:
    return F.concat(F.lit("Speaker "), speaker.cast("string"))


def round_coordinate(x: Column, scale: float = 1000.0) -> Column:
    """To three decimals, halves away from zero."""
    return F.signum(x) * F.floor(F.abs(x) * scale + 0.5) / scale


def rgb_to_integer(r: Column, g: Column, b: Column) -> Column:
    return F.shiftleft(r.cast("long"), 16) + F.shiftleft(g.cast("long"), 8) + b.cast("long")


def integer_to_rgb(value: Column) -> Column:
    v = value.cast("long")
    return F.struct(F.shiftright(v, 16).bitwiseAND(255).alias("r"), F.shiftright(v, 8).bitwiseAND(255).alias("g"), v.bitwiseAND(255).alias("b"))


def blend(base: Column, over: Column, alpha: Column) -> Column:
    """Channel value of over on base, cut to an integer; alpha clamped to 0..1."""
    a = F.least(F.greatest(alpha, F.lit(0.0)), F.lit(1.0))
    return F.floor(base * (1 - a) + over * a)


def parse_points(text: Column) -> Column:
    """'x,y x,y' to an array of (x, y); entries that aren't two numbers are null."""
    pairs = F.filter(F.split(F.trim(text), r"\s+"), lambda p: p != "")
    number = lambda p, k: F.get(F.split(p, ","), F.lit(k)).try_cast("double")
    whole = lambda p: (F.size(F.split(p, ",")) == 2) & number(p, 0).isNotNull() & number(p, 1).isNotNull()
    return F.transform(pairs, lambda p: F.when(whole(p), F.struct(number(p, 0).alias("x"), number(p, 1).alias("y"))))


def parse_boxes(text: Column) -> Column:
    """'x1,y1,x2,y2 x1,y1,x2,y2' to an array of (x1, y1, x2, y2); entries that aren't four numbers are null."""
    pairs = F.filter(F.split(F.trim(text), r"\s+"), lambda p: p != "")
    number = lambda p, k: F.get(F.split(p, ","), F.lit(k)).try_cast("double")
    names = ("x1", "y1", "x2", "y2")

    def box(p):
        whole = F.size(F.split(p, ",")) == 4
        for k in range(4):
            whole = whole & number(p, k).isNotNull()
        return F.when(whole, F.struct(*[number(p, k).alias(n) for k, n in enumerate(names)]))

    return F.transform(pairs, box)


def parse_prompt(text: Column) -> Column:
    """A prompt written as 'frame:object:points', as (frame, object, points); frame and object are 0 and 1 where they are left out or no numbers."""
    parts = F.split(text, ":")
    n = F.size(parts)
    whole = lambda k, default: F.coalesce(F.get(parts, k).try_cast("int"), F.lit(default))
    return F.struct(F.when(n > 2, whole(n - 3, 0)).otherwise(F.lit(0)).alias("frame"), F.when(n > 1, whole(n - 2, 1)).otherwise(F.lit(1)).alias("object"), parse_points(F.get(parts, n - 1)).alias("points"))


def pad_labels(labels: Column, n: Column) -> Column:
    """Labels cut or filled with 1 to the number of points."""
    return F.slice(F.concat(labels, F.array_repeat(F.lit(1), n.cast("int"))), F.lit(1), n.cast("int"))


def letterbox_inverse(px: Column, py: Column, original_w: Column, original_h: Column, processed_w: Column, processed_h: Column) -> Column:
    """Original coordinates of a point of the letterboxed image."""
    scale = F.greatest(original_w / processed_w, original_h / processed_h)
    off_x, off_y = (processed_w - original_w / scale) / 2, (processed_h - original_h / scale) / 2
    return F.struct(((px - off_x) * scale).alias("x"), ((py - off_y) * scale).alias("y"))


def poster_path(path: Column) -> Column:
    """Every '.mp4' (or '.mov', '.avi') of a path that ends in it becomes '_poster.png'; other paths get it appended."""
    out = F.concat(path, F.lit("_poster.png"))
    for ext in (".avi", ".mov", ".mp4"):
        out = F.when(F.endswith(path, F.lit(ext)), F.replace(path, F.lit(ext), F.lit("_poster.png"))).otherwise(out)
    return out
