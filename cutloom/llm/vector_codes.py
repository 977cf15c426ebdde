"""Codes for vectors: product quantisation by Hamerly's Lloyd rounds over integers.

Every component x becomes floor(256 * x); a vector is cut into equal parts and each part gets the index of
its nearest entry in that part's codebook. Between rounds a table keeps, for every part of every vector, the
assigned entry, an upper bound of the distance to it and a lower bound of the distance to the second
nearest. When entries move, the bounds move with them, and only a part whose bounds no longer prove
strictly that its entry is nearest is compared with all entries, in integers. Codebooks are the only thing that goes
through the driver: parts x entries x width integers, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutloom.llm._tables import embeddings, materialize, picked

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: More than the rounding of a square root, an addition and a conversion together.
SLACK = 2.0**-49
ROWS = 2048


def integers(vector: str, scale: int = SCALE):
    """The column's vectors as arrays of floor(scale * x); null for those that are null or hold a null or non-finite component."""
    wide = F.transform(F.col(vector), lambda x: x.cast("double"))
    fine = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    most = F.lit(2.0**62)  # what is larger is too large for any use: callers refuse it
    return F.when(fine, F.transform(wide, lambda x: F.floor(F.greatest(F.least(x * float(scale), most), -most)).cast("long")))


def matrix(column: pa.Array) -> np.ndarray:
    """rows x width of a list column whose lists are of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def distances(parts: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances, rows x entries, of integer rows to the integer entries."""
    return ((parts[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)


def scanned(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row: the nearest entry (of equal ones the first), and both bounds, by comparing it with all entries."""
    d = distances(parts, book)
    at = d.argmin(axis=1)
    rows = np.arange(len(d))
    nearest = d[rows, at]
    if d.shape[1] == 1:
        return at, np.sqrt(nearest) * (1 + SLACK), np.full(len(d), np.inf)
    d[rows, at] = np.iinfo(np.int64).max
    return at, np.sqrt(nearest) * (1 + SLACK), np.sqrt(d.min(axis=1)) * (1 - SLACK)


@dataclass
class Moved:
    """How far each entry of each codebook moved, and half the distance from each to its nearest neighbour; rounded so that bounds stay bounds."""

    step: np.ndarray
    others: np.ndarray
    gap: np.ndarray

    @staticmethod
    def between(old: np.ndarray, new: np.ndarray) -> Moved:
        step = np.sqrt(((new - old) ** 2).sum(axis=2)) * (1 + SLACK)
        n = step.shape[1]
        others, gap = np.zeros_like(step), np.full_like(step, np.inf)
        if n > 1:
            order = np.sort(step, axis=1)
            others = np.where(step == order[:, -1:], np.where(order[:, -2:-1] == order[:, -1:], order[:, -1:], order[:, -2:-1]), order[:, -1:])
            for p, book in enumerate(new):
                d = distances(book, book)
                np.fill_diagonal(d, np.iinfo(np.int64).max)
                gap[p] = np.sqrt(d.min(axis=1)) / 2 * (1 - SLACK)
        return Moved(step, others, gap)


def reassigned(parts: np.ndarray, book: np.ndarray, at: np.ndarray, upper: np.ndarray, lower: np.ndarray, step: np.ndarray, others: np.ndarray, gap: np.ndarray) -> np.ndarray:
    """Hamerly's step for one part of many vectors, in place; the rows that had to be compared with all entries."""
    upper += step[at]
    upper *= 1 + SLACK
    lower -= others[at]
    lower -= np.abs(lower) * SLACK
    bound = np.maximum(lower, gap[at])
    doubtful = np.flatnonzero(upper >= bound)
    if len(doubtful):
        upper[doubtful] = np.sqrt(((parts[doubtful] - book[at[doubtful]]) ** 2).sum(axis=1)) * (1 + SLACK)
        doubtful = doubtful[upper[doubtful] >= bound[doubtful]]
    if len(doubtful):
        at[doubtful], upper[doubtful], lower[doubtful] = scanned(parts[doubtful], book)
    return doubtful


STATE = "code binary, upper binary, lower binary, scans int"


def _assigned(batches, book: np.ndarray, moved: Moved | None):
    """Each vector with its code, its bounds and how many of its parts were compared with all entries. moved: None in the first round, when there are no bounds."""
    parts, _, width = book.shape
    for whole in batches:
        for first in range(0, whole.num_rows, ROWS):
            batch = whole.slice(first, ROWS)
            values = matrix(batch.column("v")).reshape(-1, parts, width)
            n = len(values)
            if moved is None:
                at, upper, lower = np.zeros((n, parts), np.uint8), np.zeros((n, parts)), np.zeros((n, parts))
            else:
                at, upper, lower = (np.frombuffer(b"".join(batch.column(c).to_pylist()), kind).reshape(n, parts).copy() for c, kind in (("code", np.uint8), ("upper", float), ("lower", float)))
            scans = np.full(n, parts if moved is None else 0, np.int32)
            for p in range(parts):
                if moved is None:
                    at[:, p], upper[:, p], lower[:, p] = scanned(values[:, p], book[p])
                    continue
                a, u, low = at[:, p].astype(np.int64), upper[:, p].copy(), lower[:, p].copy()
                scans[reassigned(values[:, p], book[p], a, u, low, moved.step[p], moved.others[p], moved.gap[p])] += 1
                at[:, p], upper[:, p], lower[:, p] = a, u, low
            state = [pa.array([row.tobytes() for row in x], pa.binary()) for x in (at, upper, lower)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), batch.column("v"), *state, pa.array(scans)], ["vec_id", "label", "v", "code", "upper", "lower", "scans"])


def _sums(batches, shape: tuple[int, int, int]):
    """One row an entry's component (slot), and one its count, for the task: sums of the parts assigned to it."""
    parts, entries, width = shape
    sums, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        values = matrix(batch.column("v")).reshape(-1, parts, width)
        at = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, parts)
        for p in range(parts):
            counts[p] += np.bincount(at[:, p], minlength=entries)
            np.add.at(sums[p], at[:, p], values[:, p])
    used = np.flatnonzero(counts.ravel())
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(counts.ravel()[used]), pa.array(sums.reshape(-1, width)[used].tolist(), pa.list_(pa.int64()))], ["slot", "n", "total"])


def updated(state: DataFrame, book: np.ndarray) -> np.ndarray:
    """The codebooks with each used entry replaced by floor(sum / count) of its parts; added up in tasks, then per entry."""
    width = book.shape[2]
    partial = state.select("v", "code").mapInArrow(lambda b: _sums(b, book.shape), "slot long, n long, total array<long>")
    total = partial.groupBy("slot").agg(F.sum("n").alias("n"), *[F.sum(F.get("total", F.lit(i))).alias(f"c{i}") for i in range(width)])
    new = book.copy().reshape(-1, width)
    for r in total.collect():  # at most parts x entries rows
        new[r.slot] = [r[f"c{i}"] // r.n for i in range(width)]
    return new.reshape(book.shape)


@dataclass
class Codes:
    """What quantise() gives: the table (vec_id, label, code as bytes, error), and the final codebooks, parts x entries x width."""

    table: DataFrame
    books: np.ndarray
    scans: list[DataFrame]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def _errors(batches, book: np.ndarray):
    parts, _, width = book.shape
    for batch in batches:
        values = matrix(batch.column("v")).reshape(-1, parts, width)
        at = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, parts)
        error = ((values - book[np.arange(parts)[None, :], at]) ** 2).sum(axis=(1, 2))
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), batch.column("code"), pa.array(error)], ["vec_id", "label", "code", "error"])


def quantise(vectors: DataFrame, id_col="vec_id", vector_col="embedding", label_col="label", parts=PARTS, entries=ENTRIES, rounds=ROUNDS, scale=SCALE) -> Codes | None:
    """Codebooks and codes of all vectors; None if no row takes part.

    Rows whose vector is null or holds a null or non-finite component take no part, nor do those of another length than the
    first vector's, which has to be a multiple of ``parts``. The codebook of a part starts as that part of the ``entries``
    first rows by (id, null ids last, then vector); with fewer rows it is shorter. Ties go to the lower index;
    unused entries stay. Repeated rows count as often as they stand there. At most 256 entries. Components so large
    that a squared distance might not fit a long are an error. Other columns are ignored.
    """
    rows = picked(vectors, vec_id=id_col, vector=vector_col, label=label_col).select("vec_id", "label", integers("vector", scale).alias("v")).filter("v is not null and size(v) > 0")
    order = [F.col("vec_id").asc_nulls_last(), F.col("v")]
    first = rows.orderBy(*order).limit(1).collect()
    if not first:
        return None
    length = len(first[0].v)
    if length % parts:
        raise ValueError(f"vectors of {length} components can't be cut into {parts} equal parts")
    rows = rows.filter(F.size("v") == length)
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    book = np.array([r.v for r in rows.orderBy(*order).limit(entries).collect()], np.int64).reshape(-1, parts, length // parts).transpose(1, 0, 2).copy()
    largest = rows.agg(F.max(F.greatest(F.array_max("v"), -F.array_min("v")))).first()[0]
    if length * (2 * largest) ** 2 >= 1 << 63:
        raise ValueError(f"squared distances of vectors with a component of {largest} don't fit a long")
    schema = f"vec_id {kind['vec_id']}, label {kind['label']}, v array<long>, {STATE}"
    moved, scans = None, []
    for turn in range(rounds + 1):
        now = (book, moved)
        rows = materialize(rows.mapInArrow(lambda b, now=now: _assigned(b, *now), schema), f"codes-{turn}")
        scans.append(rows.select("scans"))
        if turn < rounds:
            new = updated(rows, book)
            moved, book = Moved.between(book, new), new
    final = book
    table = rows.mapInArrow(lambda b: _errors(b, final), f"vec_id {kind['vec_id']}, label {kind['label']}, code binary, error long")
    return Codes(table, book, scans)


def vector_codes(vectors: DataFrame, id_col="vec_id", vector_col="embedding", label_col="label", parts=PARTS, entries=ENTRIES, rounds=ROUNDS, scale=SCALE) -> DataFrame:
    """vec_id, code (two hexadecimal digits a part), error, label_error, codebooks_sha256 of every row that takes part; see quantise.

    label_error adds up the errors of equal labels, null labels together. An empty table, or one where no row takes part, gives an empty table.
    """
    done = quantise(vectors, id_col, vector_col, label_col, parts, entries, rounds, scale)
    kind = vectors.schema[id_col].dataType.simpleString()
    if done is None:
        return vectors.sparkSession.createDataFrame([], f"vec_id {kind}, code string, error long, label_error long, codebooks_sha256 string")
    coded = materialize(done.table, "coded")
    per_label = materialize(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors").withColumnRenamed("label", "of_label")
    joined = coded.join(per_label, F.col("label").eqNullSafe(F.col("of_label")))
    return joined.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(done.sha256()).alias("codebooks_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    return vector_codes(embeddings(spark, sf_dir))


_NEAREST = """SELECT vec_id, p, min(struct_pack(d := list_sum(list_transform(range(1, len(part) + 1), lambda i: (part[i] - entry[i]) * (part[i] - entry[i]))), k := k)) AS best FROM parts JOIN {book} USING (p) GROUP BY vec_id, p"""
_UPDATED = """SELECT p, k, list(CAST(floor(CAST(total AS DOUBLE) / n) AS BIGINT) ORDER BY i) AS entry FROM (
  SELECT p, best.k AS k, i, sum(part[i]) AS total, count(*) AS n FROM {at} JOIN parts USING (vec_id, p), range(1, 1 + (SELECT max(len(part)) FROM parts)) t(i) GROUP BY ALL) GROUP BY p, k
  UNION ALL SELECT p, k, entry FROM {book} WHERE (p, k) NOT IN (SELECT (p, best.k) FROM {at})"""

#: Every part compared with every entry, for tables of some thousand vectors without repeated ids.
ORACLE = f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT vec_id, p, v[p * len(v) // {PARTS} + 1:(p + 1) * len(v) // {PARTS}] AS part FROM kept, range({PARTS}) t(p)
), firsts AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM kept ORDER BY vec_id LIMIT {ENTRIES}
), book0 AS MATERIALIZED (SELECT p, k, part AS entry FROM parts JOIN firsts USING (vec_id)
), at0 AS MATERIALIZED ({_NEAREST.format(book="book0")}
), book1 AS MATERIALIZED ({_UPDATED.format(at="at0", book="book0")}
), at1 AS MATERIALIZED ({_NEAREST.format(book="book1")}
), book2 AS MATERIALIZED ({_UPDATED.format(at="at1", book="book1")}
), at2 AS MATERIALIZED ({_NEAREST.format(book="book2")}
), coded AS (
  SELECT vec_id, string_agg(lpad(lower(to_hex(best.k)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM at2 GROUP BY vec_id
), digest AS (SELECT sha256(string_agg(array_to_string(entry, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM book2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN kept USING (vec_id), digest
"""
