"""Image directories as images (image_id, path, label, width, height, pixels), and results back to bytes."""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = ("jpg", "jpeg", "png", "bmp")


def _grey(image: Column) -> Column:
    """Grey values 0 to 1 of Spark's image struct, whose bytes are B, G, R (, A) or grey, row by row."""
    n, size = image["nChannels"], image["width"] * image["height"]
    byte = lambda i: F.conv(F.hex(F.substring(image["data"], i + 1, 1)), 16, 10).cast("double")
    at = lambda k: byte((k * n).cast("int"))
    mixed = lambda k: F.when(n < 3, at(k)).otherwise(byte((k * n + 2).cast("int")) * 0.299 + byte((k * n + 1).cast("int")) * 0.587 + at(k) * 0.114)
    return F.transform(F.sequence(F.lit(0), size - 1), lambda k: mixed(k) / 255)


def from_directory(spark: SparkSession, path: str) -> DataFrame:
    """Images right in the directory; files that aren't images are skipped, as unreadable ones are. image_id is a hash of the path."""
    return _read(spark.read.format("image").option("dropInvalid", True).load(path), F.lit(None).cast("string"))


def from_classification_directory(spark: SparkSession, path: str) -> DataFrame:
    """Images of the directories below, whose name is the label."""
    found = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(path)
    return _read(found, F.regexp_extract(F.col("image.origin"), r"([^/]+)/[^/]+$", 1))


def _read(found: DataFrame, label: Column) -> DataFrame:
    origin, ext = F.col("image.origin"), F.lower(F.regexp_extract(F.col("image.origin"), r"\.([^./]+)$", 1))
    rows = found.filter(ext.isin(*EXTENSIONS))
    return rows.select(F.xxhash64(origin).alias("image_id"), origin.alias("path"), label.alias("label"), F.col("image.width").alias("width"), F.col("image.height").alias("height"), _grey(F.col("image")).alias("pixels"))


def frames_from_directory(spark: SparkSession, path: str, max_frames: int | None = None) -> DataFrame:
    """from_directory with idx, the place by path. The paths of one directory are numbered in one window; the pixels don't pass it."""
    from pyspark.sql import Window

    images = from_directory(spark, path)
    order = images.select("image_id", (F.row_number().over(Window.orderBy("path")) - 1).alias("idx"))
    numbered = images.join(order, "image_id")
    return numbered.filter(F.col("idx") < max_frames) if max_frames is not None else numbered


def add_image(images: DataFrame, other: DataFrame) -> DataFrame:
    return images.unionByName(other, allowMissingColumns=True)


def one_size(images: DataFrame) -> DataFrame:
    """images, or an error if their dimensions differ."""
    sizes = images.select("width", "height").distinct().limit(2).collect()
    if len(sizes) > 1:
        raise ValueError("images of a batch must have one size")
    return images


def png_bytes(width: int, height: int, grey: bytes) -> bytes:
    """A greyscale PNG."""
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = b"".join(b"\0" + grey[y * width : (y + 1) * width] for y in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def encode_png(images: DataFrame) -> DataFrame:
    """image_id, name ({stem}_processed.png), png: values as from raster.min_max, cut to bytes."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True)
            out = [png_bytes(w, h, bytes(min(255, max(0, int(v))) for v in values)) for w, h, values in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["image_id", "png"])

    picked = images.select("image_id", "width", "height", "pixels")
    names = images.select("image_id", F.concat(F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"\.[^.]+$", ""), F.lit("_processed.png")).alias("name"))
    return picked.mapInArrow(run, f"image_id {picked.schema['image_id'].dataType.simpleString()}, png binary").join(names, "image_id").select("image_id", "name", "png")
