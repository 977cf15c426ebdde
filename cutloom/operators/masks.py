"""Mask composition on long tables (pixel columns, obj_id, v): prime encoding, colours, alpha, overlays, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutloom.functions.scalars import integer_to_rgb, rgb_to_integer

# The primes that stand for objects, the greatest code of 24 bits, and overlay colours.
PRIMES = (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47, 53, 59, 61, 67, 71)
MOST_CODE = (1 << 24) - 1
OVERLAY_COLOURS = ((255, 255, 0), (255, 0, 255), (0, 255, 255), (255, 128, 0), (128, 255, 0))
MOST_OVERLAP_ID = 15


def prime_mapping(n: int) -> dict[int, int]:
    """Object id to prime for ids 1..n; an error if the product of all doesn't fit 24 bits (n over 8)."""
    product = 1
    for p in PRIMES[:n]:
        product *= p
    if n > len(PRIMES) or product > MOST_CODE:
        raise ValueError(f"{n} objects don't fit 24 bits; at most 8 do")
    return dict(zip(range(1, n + 1), PRIMES, strict=False))


def object_prime(obj_id: Column, n: int) -> Column:
    """Null for an id that has none."""
    return F.get(F.array(*[F.lit(p) for p in prime_mapping(n).values()]), (obj_id - 1).cast("int"))


def encode(masks: DataFrame, pixel: list[str], n: int, t: float = 0.5) -> DataFrame:
    """pixel, code, r, g, b: the product of the primes of the objects whose mask is over t, B the low byte; 0 without any.

    Logarithm-free: a pixel's objects are at most n bits, so the set is a bit mask that sums before the shuffle.
    """
    bit = F.when((F.col("v") > t) & F.col("obj_id").between(1, n), F.expr("shiftleft(1L, cast(obj_id - 1 as int))")).otherwise(F.lit(0).cast("long"))
    sets = masks.groupBy(*pixel).agg(F.bit_or(bit).alias("set"))
    code = F.lit(1).cast("long")
    for k, p in enumerate(list(prime_mapping(n).values())):
        code = code * F.when(F.col("set").bitwiseAND(F.lit(1 << k)) != 0, F.lit(p).cast("long")).otherwise(F.lit(1).cast("long"))
    coded = sets.withColumn("code", F.when(F.col("set") == 0, F.lit(0).cast("long")).otherwise(code))
    return coded.select(*pixel, "code", *[integer_to_rgb(F.col("code"))[c].alias(c) for c in "rgb"])


def decode(r: Column, g: Column, b: Column, n: int) -> Column:
    """The sorted ids whose primes divide the code; none for 0."""
    code = rgb_to_integer(r, g, b)
    ids = F.array_compact(F.array(*[F.when((code % p == 0) & (code > 0), F.lit(k)) for k, p in prime_mapping(n).items()]))
    return ids


def object_colour(obj_id: Column) -> Column:
    """(r, g, b) from three primes in a row times 17, 23, 29, modulo 256, 64 at least; repeats after 18 ids."""
    primes = F.array(*[F.lit(p) for p in PRIMES])
    base = (obj_id - 1) % (len(PRIMES) - 2)
    channel = lambda k, m: F.greatest(F.get(primes, (base + k).cast("int")) * m % 256, F.lit(64))
    return F.struct(channel(0, 17).alias("r"), channel(1, 23).alias("g"), channel(2, 29).alias("b"))


def blended_colours(masks: DataFrame, pixel: list[str], t: float = 0.5) -> DataFrame:
    """pixel, r, g, b: the mean colour of the objects there, cut; ids over 15 don't count."""
    seen = masks.filter((F.col("v") > t) & (F.col("obj_id") <= MOST_OVERLAP_ID)).withColumn("c", object_colour(F.col("obj_id")))
    return seen.groupBy(*pixel).agg(*[F.floor(F.sum(f"c.{k}") / F.count("*")).alias(k) for k in "rgb"])


def with_background(colours: DataFrame, grid: DataFrame, pixel: list[str], background=(0, 0, 0)) -> DataFrame:
    """Every pixel of the grid, the background where no object is."""
    joined = grid.join(colours, pixel, "left")
    return joined.select(*pixel, *[F.coalesce(k, F.lit(v)).cast("long").alias(k) for k, v in zip("rgb", background, strict=True)])


def combined_alpha(masks: DataFrame, pixel: list[str]) -> DataFrame:
    """pixel, alpha: 255 times the greatest mask value (clipped to 0..1), cut; 255 where that is 0."""
    top = masks.groupBy(*pixel).agg(F.max(F.least(F.greatest("v", F.lit(0.0)), F.lit(1.0))).alias("m"))
    return top.select(*pixel, F.when(F.col("m") > 0, F.floor(F.col("m") * 255)).otherwise(F.lit(255)).cast("long").alias("alpha"))


def alpha_ramp(objects: DataFrame) -> DataFrame:
    """obj_id, alpha: 0.1 to 1.0 in even steps over the ids in order; 1.0 for a lone one. objects has a row an id."""
    k, n = F.row_number().over(Window.orderBy("obj_id")) - 1, F.count("*").over(Window.partitionBy())
    return objects.select("obj_id", F.when(n == 1, F.lit(1.0)).otherwise(F.lit(0.1) + F.lit(0.9) * k / (n - 1)).alias("alpha"))


def top_alpha(masks: DataFrame, ramp: DataFrame, pixel: list[str], t: float = 0.5) -> DataFrame:
    """pixel, obj_id, alpha of the highest id whose mask is over t."""
    top = masks.filter(F.col("v") > t).groupBy(*pixel).agg(F.max("obj_id").alias("obj_id"))
    return top.join(ramp, "obj_id").select(*pixel, "obj_id", "alpha")


def mask_union(masks: DataFrame, pixel: list[str], t: float = 0.5) -> DataFrame:
    return masks.groupBy(*pixel).agg(F.bool_or(F.col("v") > t).alias("on"), F.max("v").alias("v"))


def overlay(masks: DataFrame, pixel: list[str], base=(100, 100, 100), keep: float = 0.6, t: float = 0.5) -> DataFrame:
    """pixel, r, g, b: the objects' colours (by id modulo 5) laid over the base one after the other, by id; each keeps ``keep`` of what is below."""
    colours = F.array(*[F.struct(*[F.lit(float(v)).alias(k) for k, v in zip("rgb", c, strict=True)]) for c in OVERLAY_COLOURS])
    listed = masks.filter(F.col("v") > t).groupBy(*pixel).agg(F.array_sort(F.collect_set("obj_id")).alias("ids"))
    start = F.struct(*[F.lit(float(v)).alias(k) for k, v in zip("rgb", base, strict=True)])
    mix = lambda a, i: F.struct(*[(a[k] * keep + F.get(colours, (i % len(OVERLAY_COLOURS)).cast("int"))[k] * (1 - keep)).alias(k) for k in "rgb"])
    done = listed.withColumn("c", F.aggregate("ids", start, mix))
    return done.select(*pixel, *[F.floor(F.round(f"c.{k}", 6)).alias(k) for k in "rgb"])


def red_overlay(masks: DataFrame, pixel: list[str], objects: list, base=(100, 100, 100), keep: float = 0.7, colour=(255, 0, 0), t: float = 0.5) -> DataFrame:
    """pixel, r, g, b: the frame darkened to ``keep`` once for each of its objects, in order, with the rest of the colour added where the object's mask is over t; each step rounded, halves to even."""
    found = masks.groupBy(*pixel).agg(F.collect_set(F.when(F.col("v") > t, F.col("obj_id"))).alias("ids"))
    start = F.struct(*[F.lit(float(v)).alias(k) for k, v in zip("rgb", base, strict=True)])
    shade = dict(zip("rgb", colour, strict=True))
    step = lambda a, o: F.struct(*[F.least(F.rint(a[k] * keep + F.when(F.array_contains("ids", o), F.lit(float(shade[k])) * (1 - keep)).otherwise(F.lit(0.0))), F.lit(255.0)).alias(k) for k in "rgb"])
    done = found.withColumn("c", F.aggregate(F.array(*[F.lit(o).cast(masks.schema["obj_id"].dataType) for o in objects]), start, step))
    return done.select(*pixel, *[F.col(f"c.{k}").cast("long").alias(k) for k in "rgb"])


def mask_scores(masks: DataFrame, truth: DataFrame, pixel: list[str], t: float = 0.5) -> DataFrame:
    """obj_id, iou, dice, precision, recall of two mask tables of the same pixels: one outer join and one aggregate."""
    a = masks.filter(F.col("v") > t).select(*pixel, "obj_id").withColumn("a", F.lit(1))
    b = truth.filter(F.col("v") > t).select(*pixel, "obj_id").withColumn("b", F.lit(1))
    both = a.join(b, [*pixel, "obj_id"], "full").groupBy("obj_id").agg(F.count("a").alias("na"), F.count("b").alias("nb"), F.count(F.col("a") + F.col("b")).alias("n"))
    share = lambda x, y: F.round(F.try_divide(x, y), 6)
    na, nb, n = F.col("na"), F.col("nb"), F.col("n")
    return both.select("obj_id", share(n, na + nb - n).alias("iou"), share(2 * n, na + nb).alias("dice"), share(n, na).alias("precision"), share(n, nb).alias("recall"))


# Colours of masks by their place, then the configured one.
MASK_COLOURS = ((255, 0, 0), (0, 255, 0), (0, 0, 255), (255, 255, 0), (255, 0, 255), (0, 255, 255))


def renamed_parameter(name: Column) -> Column:
    """A parameter's name in the other framework: without ``.weight`` and ``.bias``; a norm's scale and shift are its gamma and beta; attention's joint input is its query, its projection its output."""
    bare = F.replace(F.replace(name, F.lit(".weight")), F.lit(".bias"))
    norm = bare.contains("norm") & ~bare.contains("gamma") & ~bare.contains("beta")
    scale = lambda to: F.replace(bare, F.lit("norm"), F.lit(f"norm.{to}"))
    named = F.when(norm & name.endswith(".weight"), scale("gamma")).when(norm & name.endswith(".bias"), scale("beta")).otherwise(bare)
    return F.replace(F.replace(named, F.lit("attn.qkv"), F.lit("attn.query")), F.lit("attn.proj"), F.lit("attn.output"))


def merge_prompts(masks: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """key and the value of the last row in order: later prompts overwrite."""
    return masks.groupBy(*key).agg(F.max_by(value, F.struct(*order)).alias(value))


def frames_to_show(prompt: Column, n: Column) -> Column:
    """The prompt frame and those 10 to 50 before and after it, kept within the video, without repeats."""
    before = [F.greatest(F.lit(0), prompt - k) for k in (50, 40, 30, 20, 10)]
    after = [F.least(n - 1, prompt + k) for k in (10, 20, 30, 40, 50)]
    return F.array_distinct(F.array(*before, prompt, *after))


def prompt_frame(prompt: Column, n: Column) -> Column:
    """The frame itself, the middle one if it lies outside the video."""
    return F.when((prompt >= 0) & (prompt < n), prompt).otherwise(F.floor(n / 2))


def visualise(masks: DataFrame, pixel: list[str], base=(100, 100, 100), alpha: float = 0.6, colour=(30, 144, 255), t: float = 0.5) -> DataFrame:
    """pixel, r, g, b: each mask over t blended on what is below it, by id, cut to whole values at every step; the base without any."""
    table = F.array(*[F.struct(*[F.lit(float(v)).alias(k) for k, v in zip("rgb", c, strict=True)]) for c in (*MASK_COLOURS, colour)])
    shown = F.when(F.col("v") > t, F.col("obj_id"))
    listed = masks.groupBy(*pixel).agg(F.array_sort(F.collect_set(shown)).alias("ids"))
    start = F.struct(*[F.lit(float(v)).alias(k) for k, v in zip("rgb", base, strict=True)])
    over = lambda a, i: F.struct(*[F.floor(a[k] * (1 - alpha) + F.get(table, F.least(i - 1, F.lit(len(MASK_COLOURS))).cast("int"))[k] * alpha).cast("double").alias(k) for k in "rgb"])
    done = listed.withColumn("c", F.aggregate("ids", start, over))
    return done.select(*pixel, *[F.col(f"c.{k}").cast("long").alias(k) for k in "rgb"])
