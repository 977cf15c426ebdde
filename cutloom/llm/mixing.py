"""Mixing sources to target weights, by DataFrame functions alone.

Aggregate words per source, derive each source's repetition rate, then emit every document floor(rate)
times plus one hash-seeded Bernoulli copy with probability equal to the fraction. The draw comes from the id and a
hash of the text, so that rows without an id, or of one id, draw by themselves; of n rows that are equal in both, floor(n * fraction + draw)
get the copy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutloom.llm._tables import documents, materialize, picked

SEED = "mix-1"
ROWS_A_SALT = 10_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_digest(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def unit_hash(id_: Column, digest: Column, seed: str) -> Column:
    """A number in [0, 1) from the seed, the id and the text's digest: the first 52 bits of an MD5. A null id counts as the empty text."""
    whole = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(id_.cast("string"), F.lit("")), F.lit("|"), digest))
    return F.conv(F.substring(whole, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_rates(sized: DataFrame, weights=(3, 1, 2), budget=1.5, cap=2.0) -> DataFrame:
    """source, source_size, target, rate of each source in sized(source, size).

    Sources in code point order, null last, weigh ``weights`` in turn and share ``budget`` times all
    sizes. A target stops at ``cap`` times its source's size and the excess goes to the others by weight.
    With sources ordered by the level (target per weight) at which each reaches its cap, the level left
    to a source and all after it is ``(budget - caps before) / weights from here on``; it rises past
    every source that is capped and falls after the first that isn't, so its maximum is the final level.
    One row per source passes through these windows, never a document. A source of size 0 gets rate 0.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = Window.orderBy(F.col("source").asc_nulls_last())
    filling = Window.orderBy("full_at", "nth")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    onward = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everyone = Window.partitionBy()
    turn = F.array(*[F.lit(int(w)) for w in weights])
    leveled = (
        per.withColumn("nth", F.row_number().over(named) - 1)
        .withColumn("weight", F.element_at(turn, (F.col("nth") % len(weights) + 1).cast("int")))
        .withColumn("most", F.lit(float(cap)) * F.col("source_size"))
        .withColumn("full_at", F.col("most") / F.col("weight"))
        .withColumn("whole", F.lit(float(budget)) * F.sum("source_size").over(everyone))
        .withColumn("level", (F.col("whole") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
        .withColumn("final", F.max("level").over(everyone))
    )
    target = F.least(F.col("most"), F.col("final") * F.col("weight"))
    return leveled.select("source", "source_size", target.alias("target"), F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0).alias("rate"))


KEY = ("source", "doc_id", "digest")


def numbered(sized: DataFrame) -> DataFrame:
    """sized (KEY and any more columns) with ``nth``, counting from 0 the rows of equal KEY; which of them has which number is open.

    Only keys that stand there twice or more are counted through: salted, so that a key of any size is many small windows.
    """
    c = F.col
    many = sized.groupBy(*KEY).agg(F.count("*").alias("many")).filter("many > 1").select(*[c(k).alias(f"of_{k}") for k in KEY], F.ceil(c("many") / ROWS_A_SALT).alias("salts"))
    many = materialize(many, "repeated")
    met = sized.join(many, [c(k).eqNullSafe(c(f"of_{k}")) for k in KEY], "left").drop(*[f"of_{k}" for k in KEY])
    single = met.filter("salts is null").drop("salts").withColumn("nth", F.lit(0).cast("long"))
    repeated = materialize(met.filter("salts is not null").withColumn("salt", F.pmod(F.monotonically_increasing_id(), c("salts"))).drop("salts"), "repeated-rows")
    counts = repeated.groupBy(*KEY, "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy(*KEY).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[c(k).alias(f"of_{k}") for k in KEY], c("salt").alias("of_salt"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = repeated.withColumn("nth", F.row_number().over(Window.partitionBy(*KEY, "salt").orderBy("salt")) - 1)
    placed = within.join(materialize(offsets, "repeated-offsets"), [*[c(k).eqNullSafe(c(f"of_{k}")) for k in KEY], c("salt") == c("of_salt")])
    return single.unionByName(placed.withColumn("nth", c("nth") + c("before")).select(*single.columns))


def copies_of(rate: Column, draw: Column, nth: Column) -> Column:
    part = rate - F.floor(rate)
    return (F.floor(rate) + F.floor((nth + 1) * part + draw) - F.floor(nth * part + draw)).cast("long")


def _planned(sized: DataFrame, weights, budget, cap, seed: str) -> DataFrame:
    """sized (KEY, size, any more columns) with source_size, target and copies."""
    rates = source_rates(sized.select("source", "size"), weights, budget, cap).withColumnRenamed("source", "from_source")
    joined = numbered(sized).join(rates, F.col("source").eqNullSafe(F.col("from_source"))).drop("from_source")
    draw = unit_hash(F.col("doc_id"), F.col("digest"), seed)
    return joined.withColumn("copies", copies_of(F.col("rate"), draw, F.col("nth"))).drop("rate", "nth", "digest")


def mix_plan(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=(3, 1, 2), budget=1.5, cap=2.0, seed=SEED) -> DataFrame:
    """One row per document: doc_id, size (words), source_size, target, copies.

    Null and empty texts have size 0. Null sources are one source, sorted last. Rows of one id draw by their texts; of rows of one source that are equal
    in both, so many get the copy as the fraction says. An empty table gives an empty table. Other columns are ignored.
    The per-source table joins null-safely; a source with a third of all rows sits on the side that
    AQE can split, and the other side has one row for it.
    """
    rows = picked(docs, doc_id=id_col, text=text_col, source=source_col)
    sized = rows.select("source", "doc_id", text_digest(F.col("text")).alias("digest"), word_count(F.col("text")).alias("size"))
    return _planned(sized, weights, budget, cap, seed).select("doc_id", "size", "source_size", "target", "copies")


def mix(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=(3, 1, 2), budget=1.5, cap=2.0, seed=SEED) -> DataFrame:
    """docs with every row as often as the mix takes it, columns unchanged (their names may be any)."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    field = lambda name: F.col("row").getField(name)
    sized = row.select("row", field(source_col).alias("source"), field(id_col).alias("doc_id"), text_digest(field(text_col)).alias("digest"), word_count(field(text_col)).alias("size"))
    planned = _planned(sized, weights, budget, cap, seed)
    return planned.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy")).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    return mix_plan(documents(spark, sf_dir)).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.col("size") * F.col("copies")).alias("taken"))


ORACLE = f"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS digest, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS nth FROM sized GROUP BY source
), weighed AS (
  SELECT *, CASE nth % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, 2.0::DOUBLE * source_size AS most FROM per
), leveled AS (
  SELECT *, (1.5::DOUBLE * CAST(sum(source_size) OVER () AS BIGINT)
    - coalesce(sum(most) OVER (ORDER BY most / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / CAST(sum(weight) OVER (ORDER BY most / weight, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS level FROM weighed
), rated AS (
  SELECT source, source_size, least(most, weight * max(level) OVER ()) AS target FROM leveled
), drawn AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
    row_number() OVER (PARTITION BY sized.source, doc_id, digest) - 1 AS nth,
    CAST(CAST('0x' || substr(md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || digest), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0::DOUBLE AS draw
  FROM sized JOIN rated ON sized.source IS NOT DISTINCT FROM rated.source
)
SELECT doc_id, size, source_size, round(target, 6) AS target,
  size * CAST(floor(rate) + floor((nth + 1) * (rate - floor(rate)) + draw) - floor(nth * (rate - floor(rate)) + draw) AS BIGINT) AS taken FROM drawn
"""
