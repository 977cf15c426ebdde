"""The driver's tables seen as utterances, frames, cues, rasters, rings, boxes and presence.

SQL gives the same views for the oracles, as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def utterances(spark, sf_dir) -> DataFrame:
    e = read(spark, sf_dir, "events")
    start = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")
    return e.select(
        F.col("user_id").alias("media_id"), F.col("event_id").alias("utt_id"), start.alias("s_us"),
        (start + F.round(F.col("value") * 100).cast("long") * 10000).alias("e_us"),
        F.col("event_type").alias("transcript"), (F.col("event_id") % 3).alias("speaker"), F.col("value"),
    )


UTTERANCES = """utterances AS (
  SELECT user_id AS media_id, event_id AS utt_id, epoch_us(ts) - 1704067200000000 AS s_us,
    epoch_us(ts) - 1704067200000000 + CAST(round(value * 100) AS BIGINT) * 10000 AS e_us, event_type AS transcript, event_id % 3 AS speaker, value FROM events)"""


def desired(spark, sf_dir) -> DataFrame:
    """A wished segment for every utterance, from a third into it to an hour later, and the 24 hours of each medium's first day, most of which meet no utterance."""
    u = utterances(spark, sf_dir)
    start = F.expr("s_us + (e_us - s_us) div 3")
    said = u.select("media_id", F.col("utt_id").alias("seg_id"), start.alias("start_us"), (start + 3_600_000_000).alias("end_us"))
    hours = u.select("media_id").distinct().withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    fixed = hours.select("media_id", (-(F.col("media_id") * 24 + F.col("hour")) - 1).alias("seg_id"), (F.col("hour") * F.lit(3_600_000_000)).alias("start_us"), ((F.col("hour") + 1) * F.lit(3_600_000_000)).alias("end_us"))
    return said.unionByName(fixed)


DESIRED = """desired AS (SELECT media_id, utt_id AS seg_id, s_us + (e_us - s_us) // 3 AS start_us, s_us + (e_us - s_us) // 3 + 3600000000 AS end_us FROM utterances
  UNION ALL SELECT media_id, -(media_id * 24 + h) - 1, h * 3600000000, (h + 1) * 3600000000 FROM (SELECT DISTINCT media_id FROM utterances), range(24) r(h))"""


def frames(spark, sf_dir) -> DataFrame:
    """Each order is a clip at 25 frames a second; a frame for each of its lines."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    li = read(spark, sf_dir, "lineitem").withColumn("idx", F.row_number().over(order).cast("long") - 1)
    return li.select(F.col("l_orderkey").alias("clip_id"), "idx", (F.col("idx") * 40000).alias("pts_us"), F.col("l_quantity").alias("payload"))


FRAMES = """frames AS (
  SELECT clip_id, idx, idx * 40000 AS pts_us, payload FROM (
    SELECT l_orderkey AS clip_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS idx, l_quantity AS payload FROM lineitem))"""


def cues(spark, sf_dir) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    length = F.length("text").cast("long") * 50
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return c.select("conv_id", "turn", F.col("role").alias("speaker"), "text", length.alias("dur_ms")).withColumn("start_ms", F.coalesce(F.sum("dur_ms").over(before), F.lit(0))).withColumn("end_ms", F.col("start_ms") + F.col("dur_ms"))


CUES = """cues AS (
  SELECT conv_id, turn, role AS speaker, text, CAST(coalesce(sum(length(text) * 50) OVER w, 0) AS BIGINT) AS start_ms,
    CAST(coalesce(sum(length(text) * 50) OVER w, 0) AS BIGINT) + length(text) * 50 AS end_ms
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def rasters(spark, sf_dir) -> DataFrame:
    """Each vector as an 8 x 8 image, values as they are, row by row."""
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("image_id"), "label", F.lit(8).alias("width"), F.lit(8).alias("height"), F.col("embedding").cast("array<double>").alias("pixels"))


RASTERS = """px AS (
  SELECT image_id, label, i % 8 AS x, i // 8 AS y, CAST(e[i + 1] AS DOUBLE) AS v FROM (
    SELECT vec_id AS image_id, label, embedding AS e, unnest(range(64)) AS i FROM embeddings))"""


def rings(spark, sf_dir) -> DataFrame:
    """Each vector as 32 points, even values x and odd ones y."""
    e = read(spark, sf_dir, "embeddings")
    at = lambda k: F.get("embedding", k).cast("double")
    points = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: F.struct(at(2 * k).alias("x"), at(2 * k + 1).alias("y")))
    return e.select(F.col("vec_id").alias("shape_id"), "label", points.alias("ring"))


RINGS = """pts AS (
  SELECT shape_id, label, k, CAST(e[2 * k + 1] AS DOUBLE) AS x, CAST(e[2 * k + 2] AS DOUBLE) AS y FROM (
    SELECT vec_id AS shape_id, label, embedding AS e, unnest(range(32)) AS k FROM embeddings))"""


def boxes(spark, sf_dir) -> DataFrame:
    """A rectangle for each part; a brand is an image."""
    p = read(spark, sf_dir, "part")
    x, y, s = F.col("p_partkey") * 7919 % 400, F.col("p_partkey") * 104729 % 400, F.col("p_size").cast("long")
    return p.select(F.col("p_brand").alias("image_id"), F.col("p_partkey").alias("shape_id"), x.alias("x0"), y.alias("y0"), (x + s * s % 211 + 1).alias("x1"), (y + s * 5 + 1).alias("y1"))


BOXES = """boxes AS (
  SELECT p_brand AS image_id, p_partkey AS shape_id, p_partkey * 7919 % 400 AS x0, p_partkey * 104729 % 400 AS y0,
    p_partkey * 7919 % 400 + CAST(p_size AS BIGINT) * p_size % 211 + 1 AS x1, p_partkey * 104729 % 400 + CAST(p_size AS BIGINT) * 5 + 1 AS y1 FROM part)"""


def presence(spark, sf_dir) -> DataFrame:
    """Objects seen at pixels: a pixel is a user's day, an object an event type (1 to 5), its mask value from the event's."""
    e = read(spark, sf_dir, "events")
    day = F.expr("timestampdiff(DAY, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")
    kinds = e.select("event_type").distinct().select("event_type", F.row_number().over(Window.orderBy("event_type")).alias("obj_id"))
    seen = e.join(F.broadcast(kinds), "event_type")  # the types of one enumerated column
    return seen.groupBy(F.col("user_id").alias("px"), day.alias("py"), F.col("obj_id")).agg((F.max(F.col("value") % 10) / 10).alias("v"))


PRESENCE = """presence AS (
  SELECT user_id AS px, datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS py, obj_id, max(value % 10) / 10 AS v
  FROM events JOIN (SELECT event_type, row_number() OVER (ORDER BY event_type) AS obj_id FROM (SELECT DISTINCT event_type FROM events)) USING (event_type) GROUP BY ALL)"""
