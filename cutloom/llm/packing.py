"""Best-fit packing of tokenised documents by linear grouping.

Tasks tokenise the texts and cut documents longer than a sequence. What the driver plans with is a
histogram of piece lengths, whose size depends on the capacity alone:

1. large lengths, longest first, fall into groups of equal cardinality and count as their group's longest;
2. a cutting-stock program over these few sizes (column generation) says how many sequences to fill by which configuration;
3. the actual pieces take the configurations' places by their rank, which Spark computes; their true lengths leave room;
4. small pieces go, longest first, where they fit best, again planned on histograms of lengths and rooms.

A plan row says: the pieces of this length with ranks from..to go there. Ranks come from counts by
(length, salt), so a length that a third of all pieces share is dealt over many tasks.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cutloom.llm import _bpe
from cutloom.llm._tables import documents, materialize, picked

CAPACITY = 1024
EOS = 2
SMALL = 3  # pieces of at most capacity / SMALL tokens are small
GROUPS = 128
ROWS_A_SALT = 1_000_000
PIECES = "piece int, start long, length long, ids_crc32 long"


def _id_bytes(text: str, path: str) -> bytes:
    """The text's ids as little-endian unsigned 32-bit integers."""
    if not _bpe.plain(text, path):
        return np.array(_bpe.library_ids(text, path), "<u4").tobytes()
    return b"".join(np.array(_bpe.plain_ids(part, path), "<u4").tobytes() for part in _bpe.stretches(text))


def _pieces(batches, path: str, capacity: int, eos: int):
    end = np.array([eos], "<u4").tobytes()
    for batch in batches:
        row, piece, start, length, crc = [], [], [], [], []
        for i, text in enumerate(batch.column(1).to_pylist()):
            raw = _id_bytes(text or "", path) + end
            n = len(raw) // 4
            first = n if n <= capacity else n % capacity or capacity
            at, size, k = 0, first, 0
            while at < n:
                row.append(i)
                piece.append(k)
                start.append(at)
                length.append(size)
                crc.append(zlib.crc32(raw[4 * at : 4 * (at + size)]))
                at, size, k = at + size, capacity, k + 1
        columns = [batch.column(0).take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])


def tokenized_pieces(docs: DataFrame, id_col="doc_id", text_col="text", capacity=CAPACITY, eos=EOS, tokenizer: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: a document's ids with eos at the end, cut into capacity-token pieces if longer, the first one shorter where it doesn't divide."""
    path = tokenizer or _bpe.tokenizer_path()
    rows = picked(docs, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lambda batches: _pieces(batches, path, capacity, eos), f"doc_id {kind}, {PIECES}")


def ranked(df: DataFrame, by: str, identity: list[str]) -> tuple[DataFrame, dict[int, int]]:
    """df with rank, counting from 0 within each value of by; and the count of each value (by takes few values).

    The salt spreads a common value over tasks; counts of (value, salt) give where each salt's ranks begin.
    """
    salts = 64
    total = df.count()
    while salts * ROWS_A_SALT < total:
        salts *= 2
    salted = df.withColumn("salt", F.pmod(F.xxhash64(*identity), F.lit(salts)))
    counts = salted.groupBy(by, "salt").agg(F.count("*").alias("n"))
    begins = Window.partitionBy(by).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(by, "salt", F.coalesce(F.sum("n").over(begins), F.lit(0)).alias("before"))
    within = Window.partitionBy(by, "salt").orderBy(*identity)
    out = salted.withColumn("nth", F.row_number().over(within)).join(offsets, [by, "salt"])
    histogram = {r[0]: r[1] for r in counts.groupBy(by).agg(F.sum("n").alias("n")).collect()}
    return out.withColumn("rank", F.col("before") + F.col("nth") - 1).drop("salt", "nth", "before"), histogram


@dataclass
class Group:
    size: int
    count: int


def linear_groups(histogram: dict[int, int], groups: int = GROUPS) -> list[Group]:
    """Lengths, longest first, in groups of equal cardinality (the last may be smaller); each counts as its longest length."""
    total = sum(histogram.values())
    each = -(-total // groups) if total else 0
    out: list[Group] = []
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if not out or out[-1].count == each:
                out.append(Group(length, 0))
            take = min(left, each - out[-1].count)
            out[-1].count += take
            left -= take
    merged: list[Group] = []
    for group in out:  # a length that fills several groups is one size to the program
        if merged and merged[-1].size == group.size:
            merged[-1].count += group.count
        else:
            merged.append(group)
    return merged


def _best_pattern(sizes: list[int], worth: np.ndarray, most: list[int], capacity: int) -> list[int]:
    """The pattern of greatest worth that fits: a bounded knapsack, by binary parts of each bound."""
    parts = []
    for k, (s, m) in enumerate(zip(sizes, most, strict=True)):
        m, t = min(m, capacity // s), 1
        while m > 0 and worth[k] > 1e-12:
            parts.append((k, min(t, m)))
            m, t = m - min(t, m), 2 * t
    best = np.zeros(capacity + 1)
    took = np.zeros((len(parts), capacity + 1), bool)
    for i, (k, n) in enumerate(parts):
        w = sizes[k] * n
        with_it = best[:-w] + worth[k] * n if w <= capacity else np.zeros(0)
        took[i, w:] = with_it > best[w:] + 1e-12
        best[w:] = np.where(took[i, w:], with_it, best[w:])
    pattern, room = [0] * len(sizes), capacity
    for i in reversed(range(len(parts))):
        if took[i, room]:
            k, n = parts[i]
            pattern[k] += n
            room -= sizes[k] * n
    return pattern


def configurations(groups: list[Group], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """(pattern, times): patterns[g] pieces of group g a sequence; together they place each group's count exactly.

    Gilmore and Gomory's column generation solves the linear program over the few sizes; its solution is
    rounded down, and what remains is placed by the best pattern of what is left, again and again.
    """
    if not groups:
        return []
    m, sizes = len(groups), [g.size for g in groups]
    demand = np.array([g.count for g in groups], float)
    basis = [[capacity // s if i == k else 0 for i in range(m)] for k, s in enumerate(sizes)]
    matrix = np.array(basis, float).T
    cost, stalled = np.inf, 0
    while stalled <= m:  # as long as patterns improve it; steps that change no count (x is 0 there) may come between
        inverse = np.linalg.inv(matrix)
        worth = inverse.sum(axis=0)  # every pattern costs one sequence
        column = _best_pattern(sizes, np.maximum(worth, 0), [capacity] * m, capacity)
        if float(np.dot(column, worth)) <= 1 + 1e-7:
            break
        direction, x = inverse @ np.array(column, float), inverse @ demand
        stalled = 0 if x.sum() < cost * (1 - 1e-12) else stalled + 1
        cost = min(cost, float(x.sum()))
        steps = np.where(direction > 1e-9, np.maximum(x, 0) / np.where(direction > 1e-9, direction, 1), np.inf)
        out = int(np.argmin(steps))
        basis[out], matrix[:, out] = column, column
    left = [g.count for g in groups]
    plan: list[tuple[list[int], int]] = []
    for column, x in zip(basis, np.linalg.solve(matrix, demand), strict=True):
        fits = min((left[k] // n for k, n in enumerate(column) if n), default=0)
        times = max(0, min(int(np.floor(x + 1e-9)), fits))
        if times:
            plan.append((column, times))
            left = [a - n * times for a, n in zip(left, column, strict=True)]
    while any(left):
        k = next(i for i, n in enumerate(left) if n)
        rest = [n - (i == k) for i, n in enumerate(left)]
        column = _best_pattern(sizes, np.array(sizes, float), rest, capacity - sizes[k]) if capacity > sizes[k] else [0] * m
        column[k] += 1
        times = min(left[i] // n for i, n in enumerate(column) if n)
        plan.append((column, times))
        left = [a - n * times for a, n in zip(left, column, strict=True)]
    return plan


def large_places(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> tuple[list[tuple], int]:
    """Rows (length, lo, hi, from_, every, sequence, slot) and the number of sequences.

    Pieces of that length with ranks lo..hi-1 take, in rank order and beginning at place from_ of a run of
    places, ``every`` places a sequence, from the run's first sequence on and from slot on within each.
    """
    grouped = linear_groups(histogram, groups)
    runs: list[list[tuple[int, int, int, int]]] = [[] for _ in grouped]
    sequences = 0
    for pattern, times in configurations(grouped, capacity):
        slot = 0
        for g, n in enumerate(pattern):
            if n:
                runs[g].append((n * times, n, sequences, slot))
                slot += n
        sequences += times
    flat = [[places, places, n, first, slot] for own in runs for places, n, first, slot in own]
    rows, at = [], 0
    for length in sorted(histogram, reverse=True):
        lo = 0
        while lo < histogram[length]:
            places, whole, n, first, slot = flat[at]
            take = min(places, histogram[length] - lo)
            rows.append((length, lo, lo + take, whole - places, n, first, slot))
            lo += take
            flat[at][0] -= take
            at += flat[at][0] == 0
    return rows, sequences


def small_places(histogram: dict[int, int], rooms: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple], int]:
    """Rows (length, lo, hi, room, first, offset) and the number of new sequences.

    Pieces of that length with ranks lo..hi-1 go to the sequences that had ``room`` left, one each, from the
    one of rank ``first`` on, at offset. New sequences are those of room capacity + 1. Longest first, a piece
    goes where the least room remains; sequences with one history are one run, so the plan's size doesn't
    depend on their number.
    """
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for room, n in rooms.items():
        if room > 0 and n:
            runs[room].append((room, 0, n))
    rows, opened = [], 0
    for length in sorted(histogram, reverse=True):
        lo = 0
        while lo < histogram[length]:
            room = min((r for r in runs if r >= length and runs[r]), default=None)
            need = histogram[length] - lo
            if room is None:
                new = -(-need // (capacity // length))
                runs[capacity].append((capacity + 1, opened, opened + new))
                opened += new
                continue
            origin, first, last = runs[room].pop()
            if not runs[room]:
                del runs[room]
            take = min(need, last - first)
            rows.append((length, lo, lo + take, origin, first, capacity - room))
            if take < last - first:
                runs[room].append((origin, first + take, last))
            if room > length:
                runs[room - length].append((origin, first, first + take))
            lo += take
    return rows, opened


def _placed(pieces: DataFrame, rows: list[tuple], names: str) -> DataFrame:
    """Ranked pieces joined to the plan's row that holds their rank. The plan's size is bounded by the capacity, so it is broadcast."""
    plan = pieces.sparkSession.createDataFrame(rows, f"at_length long, lo long, hi long, {names}")
    c = F.col
    return pieces.join(F.broadcast(plan), (c("length") == c("at_length")) & (c("rank") >= c("lo")) & (c("rank") < c("hi")))


def pack(pieces: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """pieces (doc_id, piece, length of 1 to capacity, any more columns) with sequence_id and offset.

    Offsets leave no gap from 0. Each sequence holds at most capacity tokens. Rows that are equal in doc_id,
    piece and length may swap places; nothing else depends on the order of rows. An empty table stays empty.
    """
    order = ["doc_id", "piece"]
    ranked_pieces, histogram = ranked(pieces, "length", order)
    ranked_pieces = materialize(ranked_pieces, "pack-ranked")
    small_to = capacity // SMALL
    large = {k: n for k, n in histogram.items() if k > small_to}
    small = {k: n for k, n in histogram.items() if k <= small_to}
    rows, sequences = large_places(large, capacity, groups)
    c = F.col
    place = c("from_") + c("rank") - c("lo")
    taken = _placed(ranked_pieces.filter(c("length") > small_to), rows, "from_ long, every long, sequence long, slot long")
    seats = Window.partitionBy("sequence_id").orderBy("seat")
    large_placed = materialize(
        taken.withColumn("sequence_id", c("sequence") + F.floor(place / c("every")))
        .withColumn("seat", c("slot") + place % c("every"))
        .withColumn("offset", F.coalesce(F.sum("length").over(seats.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("room", F.lit(capacity) - F.sum("length").over(Window.partitionBy("sequence_id")))
        .select(*pieces.columns, "sequence_id", "offset", "room"),
        "pack-large",
    )
    if not small:
        return large_placed.drop("room")
    open_ = large_placed.filter((c("offset") == 0) & (c("room") > 0)).select("room", c("sequence_id").alias("of_sequence"))
    ranked_open, rooms = ranked(open_, "room", ["of_sequence"])
    rows, _ = small_places(small, rooms, capacity)
    chosen = _placed(ranked_pieces.filter(c("length") <= small_to), rows, "in_room long, first long, offset long").withColumn("seq_rank", c("first") + c("rank") - c("lo"))
    joined = chosen.join(ranked_open.withColumnRenamed("rank", "open_rank"), (c("in_room") == c("room")) & (c("seq_rank") == c("open_rank")), "left")
    small_placed = joined.withColumn("sequence_id", F.coalesce(c("of_sequence"), F.lit(sequences) + c("seq_rank")))
    out = [*pieces.columns, "sequence_id", "offset"]
    return large_placed.select(*out).unionByName(small_placed.select(*out))


def pack_documents(docs: DataFrame, id_col="doc_id", text_col="text", capacity=CAPACITY, eos=EOS, groups=GROUPS, tokenizer: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one eos token. Repeated ids are packed once a row. Other columns are ignored.
    """
    return pack(materialize(tokenized_pieces(docs, id_col, text_col, capacity, eos, tokenizer), "pieces"), capacity, groups)


def query(spark, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
