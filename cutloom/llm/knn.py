"""Exact top-k search by inner product: a Voronoi join.

Vectors become integers. Pivots from a bounded sample divide them into cells, every cell into rings by distance to
its pivot. A summary has a row a ring: how many vectors, and the ranges of their distances and norms. For integer vectors
2 * (q . x) = |q|^2 + |x|^2 - |q - x|^2, so the triangle inequality through the pivot, and Cauchy-Schwarz, bound each query's
scores with a ring from both sides. Rings that surely hold k better rows give a query its threshold; a ring is
sent to a group of queries (of one cell) only if one of them may still find a score there that reaches its threshold.
Each group then goes through the blocks that it got, the most promising first, with thresholds that rise as it goes.

Queries and blocks stand in rows of bounded size. A cell of many queries is several groups, and a group that needs many
blocks is dealt over several tasks, whose best k are put together.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutloom.llm._tables import embeddings, materialize
from cutloom.llm.vector_codes import integers

K = 5
#: Rows that pivots, rings and first thresholds come from: those of least hash.
SAMPLE = 4096
MOST_PIVOTS, RINGS, LLOYD = 256, 4, 4
#: Vectors in a block, queries in a group, blocks that one task takes for a group.
BLOCK, GROUP, TURN = 512, 4096, 128
#: Bounds give way by this share of the squares that they come from: more than their rounding.
SLACK = 2.0**-40
CELLS = 1 << 20


def padded(lists: list[list[int]], width: int) -> np.ndarray:
    out = np.zeros((len(lists), width), np.int64)
    for row, values in zip(out, lists, strict=True):
        row[: len(values)] = values
    return out


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """rows x width of an Arrow column of integer lists, zeros behind shorter ones."""
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def unpacked(blob: bytes, part: Partition) -> np.ndarray:
    return np.frombuffer(blob, part.stored).reshape(-1, part.width).astype(np.float64)


def squares(x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, x)


def to_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances, rows x pivots, of integer rows (as doubles) to integer pivots; squares are exact below 2**53."""
    return np.sqrt(np.maximum(squares(x)[:, None] - 2 * (x @ pivots.T) + squares(pivots)[None, :], 0))


@dataclass
class Partition:
    """Pivots, where each cell's rings end, and the sample that they came from: bounded by SAMPLE rows."""

    width: int
    stored: str
    pivots: np.ndarray
    ends: np.ndarray
    sample: np.ndarray
    rows: np.ndarray

    @staticmethod
    def fit(sample: np.ndarray, rows: np.ndarray, stored: str, many: int, rings: int) -> Partition:
        """many pivots by some Lloyd rounds over the sample, from evenly chosen rows of it, rounded to integers; rings of equal numbers."""
        x = sample.astype(np.float64)
        pivots = np.unique(x[np.linspace(0, len(x) - 1, many).astype(int)], axis=0)
        for _ in range(LLOYD):
            at = to_pivots(x, pivots).argmin(axis=1)
            used = np.unique(at)
            pivots = np.unique(np.rint(np.stack([x[at == c].mean(axis=0) for c in used])), axis=0)
        d = to_pivots(x, pivots)
        at, least = d.argmin(axis=1), d.min(axis=1)
        shares = np.arange(1, rings) / rings
        ends = np.stack([np.quantile(least[at == c], shares) if (at == c).any() else np.zeros(rings - 1) for c in range(len(pivots))])
        return Partition(sample.shape[1], stored, pivots, ends, x, rows)

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's ring (cell * rings + ring) and its distance to the cell's pivot."""
        d = to_pivots(x, self.pivots)
        cell = d.argmin(axis=1)
        least = d[np.arange(len(d)), cell]
        ring = (least[:, None] > self.ends[cell]).sum(axis=1)
        return cell * (self.ends.shape[1] + 1) + ring, least


def _placed(batches, part: Partition):
    for batch in batches:
        if not batch.num_rows:
            continue
        x = matrix(batch.column("v"), part.width)
        ring, distance = part.place(x.astype(np.float64))
        norm = np.sqrt(squares(x.astype(np.float64)))
        codes = pa.array([row.tobytes() for row in x.astype(part.stored)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("vec_id"), batch.column("asks"), pa.array(ring.astype(np.int32)), pa.array(distance), pa.array(norm), codes], ["row", "vec_id", "asks", "ring", "distance", "norm", "codes"])


@dataclass
class Summary:
    """A row a ring that holds vectors: its cell, its number, how many, and the ranges of distances to the pivot and of norms."""

    ring: np.ndarray
    cell: np.ndarray
    n: np.ndarray
    near: np.ndarray
    far: np.ndarray
    short: np.ndarray
    long: np.ndarray


def score_bounds(q2: np.ndarray, dots: np.ndarray, d: np.ndarray, near, far, short, long) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest score that queries (squared norms q2; dots and distances d with the pivot) can have with vectors of these ranges."""
    q = np.sqrt(q2)
    least = np.maximum((q2 + short**2 - (d + far) ** 2) / 2, dots - q * far)
    gap = np.maximum(np.maximum(d - far, near - d), 0)
    most = np.minimum(np.minimum((q2 + long**2 - gap**2) / 2, dots + q * far), q * long)
    slack = SLACK * (q2 + long**2 + (d + far) ** 2) + SLACK
    return least - slack, most + slack


def _k_largest(scores: np.ndarray, k: int) -> np.ndarray:
    """Of each row the k-th largest score, minus infinity if there are fewer."""
    if scores.shape[1] < k:
        return np.full(len(scores), -np.inf)
    return np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]


def thresholds(x: np.ndarray, rows: np.ndarray, part: Partition, s: Summary, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each query: a score that k rows but its own surely reach, and its largest possible score with each ring."""
    q2, dots, d = squares(x)[:, None], (x @ part.pivots.T)[:, s.cell], to_pivots(x, part.pivots)[:, s.cell]
    least, most = score_bounds(q2, dots, d, s.near, s.far, s.short, s.long)
    order = np.argsort(-least, axis=1, kind="stable")
    enough = np.cumsum(s.n[order], axis=1) >= k + 1  # its own row is one of them
    sure = np.where(enough.any(axis=1), np.take_along_axis(least, np.take_along_axis(order, enough.argmax(axis=1)[:, None], 1), 1)[:, 0], -np.inf)
    scores = x @ part.sample.T
    scores[rows[:, None] == part.rows[None, :]] = -np.inf
    return np.maximum(sure, _k_largest(scores, k)), most


def _runs(batches, keys: tuple[str, ...], most: int):
    """Consecutive rows of equal keys, at most ``most`` at a time, as tables; rows arrive sorted by the keys."""
    held: list[pa.RecordBatch] = []
    now, count = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        values = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        changes = np.flatnonzero(np.any([v[1:] != v[:-1] for v in values], axis=0)) + 1
        for a, b in zip([0, *changes.tolist()], [*changes.tolist(), batch.num_rows], strict=True):
            key = tuple(v[a].item() for v in values)
            while a < b:
                if held and (key != now or count == most):
                    yield now, pa.Table.from_batches(held)
                    held, count = [], 0
                now, take = key, min(b - a, most - count)
                held.append(batch.slice(a, take))
                count, a = count + take, a + take
    if held:
        yield now, pa.Table.from_batches(held)


def _joined(column: pa.ChunkedArray) -> bytes:
    return b"".join(column.to_pylist())


def _groups(batches, part: Partition, s: Summary, k: int, group: int, block: int, turn: int):
    """A group of queries of one cell a row: its thresholds, and a place for each ring that one of them needs."""
    for (_,), rows in _runs(batches, ("cell",), group):
        x, number = unpacked(_joined(rows["codes"]), part), rows["row"].to_numpy()
        sure, best = np.empty(len(x)), np.full(len(s.ring), -np.inf)
        for a in range(0, len(x), max(1, CELLS // SAMPLE)):
            b = a + max(1, CELLS // SAMPLE)
            sure[a:b], most = thresholds(x[a:b], number[a:b], part, s, k)
            best = np.maximum(best, np.where(most >= sure[a:b, None], most, -np.inf).max(axis=0))
        need = np.flatnonzero(best > -np.inf)
        turns = max(1, math.ceil(float((s.n[need] / block + 1).sum()) / turn))
        needs = [{"ring": int(s.ring[i]), "best": float(best[i])} for i in need]
        yield pa.RecordBatch.from_pylist([{"grp": int(number[0]), "turns": turns, "needs": needs, "rows": number.tobytes(), "codes": _joined(rows["codes"]), "sure": sure.tobytes()}], GROUPS)


GROUPS = pa.schema([("grp", pa.int64()), ("turns", pa.int32()), ("needs", pa.list_(pa.struct([("ring", pa.int32()), ("best", pa.float64())]))), ("rows", pa.binary()), ("codes", pa.binary()), ("sure", pa.binary())])


def _blocks(batches, block: int):
    """A block of vectors of one ring a row."""
    for (ring,), rows in _runs(batches, ("ring",), block):
        columns = [[rows["row"][0].as_py()], [ring], [rows["row"].combine_chunks().to_numpy().tobytes()], [rows["vec_id"].to_pylist()], [_joined(rows["codes"])]]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.list_(rows.schema.field("vec_id").type)), pa.array(columns[4], pa.binary())], ["block", "ring", "rows", "ids", "codes"])


class Best:
    """The best k of each query so far: (minus the score, whether the id is null, id, row), in order."""

    def __init__(self, x: np.ndarray, rows: np.ndarray, sure: np.ndarray, k: int):
        self.x, self.rows, self.sure, self.k = x, rows, sure, k
        self.norm = np.sqrt(squares(x))
        self.found: list[list[tuple]] = [[] for _ in rows]

    def look(self, y: np.ndarray, rows: np.ndarray, ids: list) -> None:
        """Compare the queries with a block of vectors; scores are exact integers (products below 2**53)."""
        long = float(np.sqrt(squares(y).max()))
        alive = np.flatnonzero(self.norm * long * (1 + SLACK) + SLACK >= self.sure)
        step = max(1, CELLS // len(y))
        for a in range(0, len(alive), step):
            at = alive[a : a + step]
            scores = self.x[at] @ y.T
            scores[self.rows[at][:, None] == rows[None, :]] = -np.inf
            hits = (scores >= self.sure[at][:, None]) & (scores > -np.inf)
            for i in np.flatnonzero(hits.any(axis=1)).tolist():
                self._add(int(at[i]), scores[i], np.flatnonzero(hits[i]), rows, ids)

    def _add(self, query: int, scores: np.ndarray, at: np.ndarray, rows: np.ndarray, ids: list) -> None:
        if len(at) > 4 * self.k:  # only those that the k-th score of this block leaves; equal ones stay for the ids to decide
            at = at[scores[at] >= np.partition(scores[at], len(at) - self.k)[len(at) - self.k]]
        new = [(-int(scores[j]), ids[j] is None, 0 if ids[j] is None else ids[j], int(rows[j])) for j in at.tolist()]
        found = sorted(self.found[query] + new)[: self.k]
        self.found[query] = found
        if len(found) == self.k:
            self.sure[query] = max(self.sure[query], -found[-1][0])


FOUND = "row long, score long, vec_id {kind}, other long"


def _solved(batches, part: Partition, k: int):
    """Rows arrive sorted by (group, turn, part, best first): the group's queries, then the blocks that it goes through. Gives each query's best k of them."""
    best = now = kind = None

    def result():
        rows = [(int(row), -score, None if none else vec_id, other) for row, found in zip(best.rows, best.found, strict=True) for score, none, vec_id, other in found]
        columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), kind, pa.int64()), strict=True)], ["row", "score", "vec_id", "other"])

    for batch in batches:
        kind = batch.schema.field("ids").type.value_type
        for i in range(batch.num_rows):
            at = {c: batch.column(c)[i] for c in ("grp", "turn", "part", "rows", "codes")}
            key = (at["grp"].as_py(), at["turn"].as_py())
            x, rows = unpacked(at["codes"].as_py(), part), np.frombuffer(at["rows"].as_py(), np.int64)
            if at["part"].as_py() == 0:
                if best:
                    yield result()
                now = key
                best = Best(x, rows, np.frombuffer(batch.column("sure")[i].as_py(), np.float64).copy(), k)
            elif key == now:
                best.look(x, rows, batch.column("ids")[i].as_py())
    if best:
        yield result()


def top_k(vectors: DataFrame, asks: Column, id_col="vec_id", vector_col="embedding", k=K, scale=256, pivots: int | None = None, rings=RINGS, sample=SAMPLE, group=GROUP, block=BLOCK, turn=TURN) -> DataFrame:
    """query_id, rank, vec_id, score: for each row for which ``asks`` (over the input's columns) holds, the k rows of largest integer inner product, its own row left out.

    Components become floor(scale * x). Equal scores go by id, null ids last, then by row. Rows whose vector is null or holds a null or non-finite component
    take no part; of vectors of different lengths, the shorter count as if zeros followed. Rows of one id are different rows: each leaves out
    itself alone, and a repeated query has its answers once a row. A query with fewer than k other rows gets them all. Integers beyond 31 bits, or
    vectors whose products might pass 2**53, are an error. An empty table gives an empty table; other columns are ignored.
    group: queries in a row at most; block: vectors in one; turn: blocks that a task goes through for a group, about.
    pivots: None for an eighth of the square root of the number of rows, at most MOST_PIVOTS.
    """
    spark, c = vectors.sparkSession, F.col
    rows = vectors.select(c(f"`{id_col}`").alias("vec_id"), F.coalesce(asks, F.lit(False)).alias("asks"), integers(f"`{vector_col}`", scale).alias("v")).filter("v is not null")
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    kind = rows.schema["vec_id"].dataType.simpleString()
    n, width, largest = rows.agg(F.count("*"), F.max(F.size("v")), F.max(F.greatest(F.array_max("v"), -F.array_min("v")))).first()
    if not n:
        return spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score long")
    width, largest = max(width, 1), largest or 0
    if largest >= 1 << 31 or width * (2 * largest) ** 2 >= 1 << 53:
        raise ValueError(f"products of vectors with a component of {largest} aren't exact")
    taken = rows.orderBy(F.xxhash64("v", "row"), "row").limit(sample).select("row", "v").collect()
    many = pivots or min(MOST_PIVOTS, max(1, math.isqrt(n) // 8))
    stored = "i2" if largest < 1 << 15 else "i4"
    part = Partition.fit(padded([r.v for r in taken], width), np.array([r.row for r in taken], np.int64), stored, min(many, len(taken)), rings)
    share = spark.sparkContext.broadcast(part)
    placed = rows.mapInArrow(lambda b: _placed(b, share.value), f"row long, vec_id {kind}, asks boolean, ring int, distance double, norm double, codes binary")
    placed = materialize(placed, "placed")
    ranges = placed.groupBy("ring").agg(F.count("*").alias("n"), *[f(x).alias(f"{x}_{f.__name__}") for x in ("distance", "norm") for f in (F.min, F.max)])
    found = ranges.orderBy("ring").toPandas()  # at most pivots x rings rows
    summary = Summary(found["ring"].to_numpy(), found["ring"].to_numpy() // rings, *[found[x].to_numpy() for x in ("n", "distance_min", "distance_max", "norm_min", "norm_max")])
    asking = placed.filter("asks").select(F.floor(c("ring") / rings).cast("int").alias("cell"), "row", "codes").repartitionByRange("cell", "row").sortWithinPartitions("cell", "row")
    groups = asking.mapInArrow(lambda b: _groups(b, share.value, summary, k, group, block, turn), "grp long, turns int, needs array<struct<ring:int,best:double>>, rows binary, codes binary, sure binary")
    groups = materialize(groups, "groups")
    blocks = placed.select("ring", "row", "vec_id", "codes").repartitionByRange("ring", "row").sortWithinPartitions("ring", "row")
    blocks = materialize(blocks.mapInArrow(lambda b: _blocks(b, block), f"block long, ring int, rows binary, ids array<{kind}>, codes binary"), "blocks")
    needs = materialize(groups.select("grp", "turns", F.explode("needs").alias("need")).select("grp", "turns", "need.ring", "need.best"), "needs")
    tasks = max(1, groups.agg(F.sum("turns")).first()[0] or 0)  # about a task a turn, which has ``turn`` blocks or so
    none = F.lit(None)
    sent = blocks.join(needs, "ring").select("grp", F.pmod(F.xxhash64("block"), c("turns")).cast("int").alias("turn"), F.lit(1).alias("part"), "best", "rows", "ids", "codes", none.cast("binary").alias("sure"))
    own = groups.select("grp", F.explode(F.sequence(F.lit(0), c("turns") - 1)).alias("turn"), F.lit(0).alias("part"), F.lit(0.0).alias("best"), "rows", none.cast(f"array<{kind}>").alias("ids"), "codes", "sure")
    together = own.unionByName(sent).repartition(tasks, "grp", "turn").sortWithinPartitions("grp", "turn", "part", F.desc("best"))
    parts = materialize(together.mapInArrow(lambda b: _solved(b, share.value, k), FOUND.format(kind=kind)), "parts")
    order = Window.partitionBy("row").orderBy(F.desc("score"), c("vec_id").asc_nulls_last(), "other")
    ranked = parts.withColumn("rank", F.row_number().over(order)).filter(c("rank") <= k)
    ids = placed.filter("asks").select("row", c("vec_id").alias("query_id"))
    return ranked.join(ids, "row").select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return top_k(embeddings(spark, sf_dir), F.col("vec_id") % 50 == 0)


#: Every query with every other row. Rows of one id are told apart by their place.
ORACLE = """
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS nth, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.nth, q.vec_id AS query_id, c.vec_id, c.nth AS other, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score FROM kept q JOIN kept c ON q.nth <> c.nth WHERE q.vec_id % 50 = 0
), ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY nth ORDER BY score DESC, vec_id NULLS LAST, other) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
