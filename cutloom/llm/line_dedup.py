"""Line deduplication by a segment-partition edit join.

Every line with a word takes part, however short. Equal lines collapse first, by 128-bit keys. Two different lines within
EDITS edits share one of the EDITS + 1 segments of the shorter one, at a place near its own: each line longer than EDITS gives the keys
of its own segments (row kind 0) and those of its substrings that could be a segment of a line up to EDITS characters shorter
(kind 1). Keys that more than one line gives are meetings; a meeting of many lines is dealt in chunks, every
two of which meet in one group of bounded size. There a banded bit-parallel edit distance, run on thousands of pairs at once, decides.
A line stays if no earlier line of the corpus, by (document id, place in it), is within EDITS edits of it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutloom.llm import _words
from cutloom.llm._tables import documents, materialize, picked

EDITS = 1
CHUNK = 256
CELLS = 1 << 22
U = np.uint64


class Lines:
    """All lines of some texts: code points, each line's range, its text's index and its number there."""

    def __init__(self, texts: list[str | None]):
        self.points = np.frombuffer("\n".join(t or "" for t in texts).encode("utf-32-le"), "<u4")
        stops = np.append(np.flatnonzero(self.points == 10), len(self.points))
        self.start, self.end = np.append(0, stops[:-1] + 1), stops
        counts = np.array([(t or "").count("\n") + 1 for t in texts])
        self.text = np.repeat(np.arange(len(texts)), counts)
        self.number = np.arange(len(self.start)) - np.repeat(np.cumsum(counts) - counts, counts)
        self.length = self.end - self.start

    def sums(self, seed: int) -> np.ndarray:
        out = np.zeros(len(self.points) + 1, U)
        np.cumsum(_words.mix(self.points.astype(U), seed) * _words._power("up", len(self.points)), out=out[1:])
        return out

    def take(self, i: int) -> np.ndarray:
        return self.points[self.start[i] : self.end[i]]


def segment_places(length: np.ndarray, edits: int, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Where segment i of edits + 1 begins in a line of that length, and how long it is: even parts, the longer ones last."""
    short, more = length // (edits + 1), length % (edits + 1)
    brief = edits + 1 - more
    begin = short * i + np.maximum(i - brief, 0)
    return begin, short + (i >= brief)


def segment_keys(sums: np.ndarray, start: np.ndarray, length: np.ndarray, edits: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Keys of the lines' own segments, and of substrings that could be segments of a line ``shorter`` characters shorter (0 where the line has no such substring).

    A substring's place differs from the segment's by at most i from the left and, counted from the right end, by at most edits - i.
    """

    def key(i, of_length, begin, size):
        inside = np.where((begin >= 0) & (begin + size <= length), begin, 0)
        size = np.minimum(size, length)
        h = _words.range_hash(sums, start + inside, start + np.minimum(inside + size, length))
        k = _words.mix(h + of_length.astype(U) * U(0x9E3779B97F4A7C15), 0x100 + i)
        return np.where((begin >= 0) & (begin + size <= length) & (of_length > edits), np.maximum(k, U(1)), U(0))

    own = [key(i, length, *segment_places(length, edits, i)) for i in range(edits + 1)]
    probes = []
    for shorter in range(edits + 1):
        for i in range(edits + 1):
            begin, size = segment_places(np.maximum(length - shorter, 0), edits, i)
            for move in range(max(-i, shorter - (edits - i)), min(i, shorter + (edits - i)) + 1):
                if shorter or move:
                    probes.append(key(i, length - shorter, begin + move, size))
    return own, probes


def edits_within(left: list[np.ndarray], right: list[np.ndarray], most: int) -> np.ndarray:
    """For each pair of code point arrays, whether their edit distance is at most ``most``.

    Hyyro's banded form of Myers' bit vectors: one 64-bit word a pair holds the band of 2 * most + 1
    diagonals, and all pairs advance by one column together.
    """
    m, n = (np.array([len(x) for x in side]) for side in (left, right))
    swap = m < n
    first = [b if s else a for a, b, s in zip(left, right, swap, strict=True)]
    second = [a if s else b for a, b, s in zip(left, right, swap, strict=True)]
    m, n = np.maximum(m, n), np.minimum(m, n)
    result = np.zeros(len(first), bool)
    near = np.flatnonzero(m - n <= most)
    if not len(near):
        return result
    m, n = m[near], n[near]
    width = int(m.max())
    a = np.zeros((width + 2 * most + 1, len(near)), np.uint32)
    b = np.zeros((width + 1, len(near)), np.uint32)
    for k, x in enumerate(near.tolist()):
        a[most : most + len(first[x]), k] = first[x]
        b[: len(second[x]), k] = second[x]
    top, one = U(63), U(1)
    vp = np.full(len(near), (0xFFFFFFFFFFFFFFFF << (64 - most - 1)) & 0xFFFFFFFFFFFFFFFF, U)
    vn = np.zeros(len(near), U)
    score = np.full(len(near), most)
    for j in range(int(n.max())):
        eq = np.zeros(len(near), U)
        for d in range(2 * most + 1):
            row = j + d - most
            if row >= 0:
                eq |= ((a[j + d] == b[j]) & (row < m)).astype(U) << U(63 - (2 * most - d))
        d0 = (((eq & vp) + vp) ^ vp) | eq | vn
        hp = vn | ~(d0 | vp)
        hn = d0 & vp
        live = j < n
        slanting = j < m - most
        down = np.where(slanting, ~d0 >> top & one, U(0)).astype(np.int64)
        at = np.clip(62 - (j - (m - most)), 0, 63).astype(U)
        across = np.where(slanting, 0, (hp >> at & one).astype(np.int64) - (hn >> at & one).astype(np.int64))
        score += np.where(live, down + across, 0)
        vp = hn | ~((d0 >> one) | hp)
        vn = (d0 >> one) & hp
    result[near] = score <= most
    return result


def _read(batches, id_at: int, text_at: int):
    """(batch's rows from, rows, Lines) in stretches of bounded size."""
    for batch in batches:
        column = batch.column(text_at)
        for s in _words.slices(column):
            yield batch.slice(s.first, s.rows), Lines(column.slice(s.first, s.rows).to_pylist())


def _worded(lines: Lines) -> np.ndarray:
    """The numbers of the lines that have a word."""
    inked = np.append(0, np.cumsum(~np.isin(lines.points, (9, 10, 11, 12, 13, 32))))
    return np.flatnonzero(inked[lines.end] > inked[lines.start])


def _keyed(batches, edits: int):
    for part, lines in _read(batches, 0, 1):
        at = _worded(lines)
        sums = lines.sums(0x33)
        start, length = lines.start[at], lines.length[at]
        k1, k2 = (_words.range_hash(x, start, start + length) for x in (sums, lines.sums(0x44)))
        own, probes = segment_keys(sums, start, length, edits)
        keys = np.stack([*own, *probes], axis=1).view(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, keys.shape[1]), pa.int32()), pa.array(keys.ravel()))
        columns = [part.column(0).take(pa.array(lines.text[at])), pa.array(lines.number[at], pa.int32()), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), lists]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "line", "k1", "k2", "segments"])


def _fetched(batches):
    """Of each text, the lines asked for (ask: their numbers; keys: their k1, which must agree: rows of one id may differ)."""
    for part, lines in _read(batches, 0, 1):
        sums = lines.sums(0x33)
        first = np.searchsorted(lines.text, np.arange(part.num_rows + 1))
        asks = part.column(2)
        row = np.repeat(np.arange(part.num_rows), pc.list_value_length(asks).to_numpy(zero_copy_only=False))
        number, key = (pc.list_flatten(c).to_numpy(zero_copy_only=False) for c in (asks, part.column(3)))
        at = first[row] + number
        there = at < first[row + 1]
        row, number, key, at = row[there], number[there], key[there], at[there]
        same = _words.range_hash(sums, lines.start[at], lines.end[at]).view(np.int64) == key
        row, number, key, at = row[same], number[same], key[same], at[same]
        found = [lines.take(x).tobytes().decode("utf-32-le") for x in at.tolist()]
        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(number, pa.int32()), pa.array(key, pa.int64()), pa.array(found, pa.string())], ["doc_id", "line", "k1", "content"])


def _meeting_pairs(place: list[tuple], kind: np.ndarray, chunk: np.ndarray, length: np.ndarray, edits: int, alone: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (earlier, later) of a meeting's lines that are to be compared: not both by probes, lengths near, and of two chunks unless one chunk meets itself."""
    order = np.array(sorted(range(len(place)), key=place.__getitem__))
    rank = np.cumsum([0, *(place[a] != place[b] for a, b in zip(order[1:], order[:-1], strict=True))])
    a, b = np.triu_indices(len(order), 1)
    x, y = order[a], order[b]
    meets = (rank[a] != rank[b]) & ((kind[x] == 0) | (kind[y] == 0)) & (np.abs(length[x] - length[y]) <= edits) & ((chunk[x] == chunk[y]) == alone)
    _, once = np.unique(rank[a[meets]] * len(order) + rank[b[meets]], return_index=True)  # one line may give a key more than once
    return x[meets][once], y[meets][once]


def _judged(batches, edits: int):
    """Rows arrive sorted by (segment, i, j): in each run of equal ones, the lines of chunk i meet those of chunk j. Gives the lines that an earlier one is near."""
    held: list[tuple] = []
    pairs: list[tuple] = []
    now = out_type = None

    def decide():
        """The later lines of the near pairs, pairs of like length together, so many at a time that their band tables stay small."""
        pairs.sort(key=lambda p: len(p[1]))
        found, first = set(), 0
        while first < len(pairs):
            last = first + 1
            while last < len(pairs) and (last - first + 1) * (len(pairs[last][1]) + 2 * edits + 2) <= CELLS // 8:
                last += 1
            part = pairs[first:last]
            near = edits_within([p[1] for p in part], [p[2] for p in part], edits)
            found.update(p[0] for p, yes in zip(part, near, strict=True) if yes)
            first = last
        pairs.clear()
        done = sorted(found)
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in done], out_type), pa.array([p[1] for p in done], pa.int32()), pa.array([p[2] for p in done], pa.int64())], ["doc_id", "line", "k1"])

    def close():
        if len(held) > 1:
            kind, chunk = (np.array([r[k] for r in held]) for k in (1, 2))
            for x, y in zip(*_meeting_pairs([r[0] for r in held], kind, chunk, np.array([len(r[3]) for r in held]), edits, now[1] == now[2]), strict=True):
                pairs.append((held[y][0], held[x][3], held[y][3]))
        held.clear()

    for batch in batches:
        out_type = batch.column("doc_id").type
        for segment, i, j, kind, chunk, doc_id, line, k1, content in zip(*[batch.column(c).to_pylist() for c in ("segment", "i", "j", "kind", "chunk", "doc_id", "line", "k1", "content")], strict=True):
            if (segment, i, j) != now:
                close()
                now = (segment, i, j)
                if sum(len(p[1]) for p in pairs[-64:]) * len(pairs) > 64 * CELLS or len(pairs) > CELLS // 64:
                    yield decide()
            held.append(((doc_id, line, k1), kind, chunk, np.frombuffer(content.encode("utf-32-le"), "<u4")))
    close()
    if out_type is not None:
        yield decide()


def first_lines(docs: DataFrame, id_col="doc_id", text_col="text", edits=EDITS) -> DataFrame:
    """doc_id, line, k1 (a hash of its content): of the lines with a word, those that stay. See dedup_lines."""
    rows = picked(docs, doc_id=id_col, text=text_col).filter("doc_id is not null")
    kind = rows.schema["doc_id"].dataType.simpleString()
    keyed = rows.mapInArrow(lambda b: _keyed(b, edits), f"doc_id {kind}, line int, k1 long, k2 long, segments array<long>")
    firsts = keyed.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "line", "segments")).alias("f")).select("f.*", "k1")
    firsts = materialize(firsts, "lines")
    given = firsts.select("doc_id", "line", "k1", F.posexplode("segments").alias("nth", "segment")).filter("segment <> 0")
    given = given.select("segment", (F.col("nth") > edits).cast("int").alias("kind"), "doc_id", "line", "k1")
    shared = given.groupBy("segment").agg(F.count("*").alias("many"), F.min("kind").alias("least")).filter("many > 1 and least = 0").select("segment", F.ceil(F.col("many") / CHUNK).cast("int").alias("chunks"))
    shared = materialize(shared, "shared")  # a table, so that a hot segment is a join Spark can split
    met = materialize(given.join(shared, "segment"), "met")
    wanted = met.select("doc_id", "line", "k1").distinct().groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("line", "k1"))).alias("ask"))
    wanted = wanted.select(F.col("doc_id").alias("of_id"), F.col("ask.line").alias("ask"), F.col("ask.k1").alias("keys"))
    asked = rows.join(wanted.hint("merge"), F.col("doc_id") == F.col("of_id")).select("doc_id", "text", "ask", "keys")
    contents = asked.mapInArrow(_fetched, f"doc_id {kind}, line int, k1 long, content string")
    dealt = met.join(contents, ["doc_id", "line", "k1"]).withColumn("chunk", F.pmod(F.xxhash64("doc_id", "line", "k1"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("segment", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "kind", "chunk", "doc_id", "line", "k1", "content")
    together = dealt.repartition("segment", "i", "j").sortWithinPartitions("segment", "i", "j")
    dropped = together.mapInArrow(lambda b: _judged(b, edits), f"doc_id {kind}, line int, k1 long").distinct()
    return firsts.select("doc_id", "line", "k1").join(materialize(dropped, "near-lines"), ["doc_id", "line", "k1"], "left_anti")


def _stays(docs, id_col, text_col, edits) -> DataFrame:
    """doc_id, stay: the lines that stay, as (number, hash)."""
    return first_lines(docs, id_col, text_col, edits).groupBy("doc_id").agg(F.collect_list(F.struct("line", "k1")).alias("stay"))


def line_counts(docs: DataFrame, id_col="doc_id", text_col="text", edits=EDITS) -> DataFrame:
    """doc_id, n_lines, n_worded (lines with a word), n_kept, dropped (numbers of the lines that go, from 0) for every row with an id, as dedup_lines has it."""
    known = picked(docs, doc_id=id_col, text=text_col).filter("doc_id is not null")
    kind = known.schema["doc_id"].dataType.simpleString()

    def numbered(batches):
        for part, lines in _read(batches, 0, 1):
            at = _worded(lines)
            n = np.bincount(lines.text, minlength=part.num_rows)
            k1 = _words.range_hash(lines.sums(0x33), lines.start[at], lines.end[at])
            marks = pa.StructArray.from_arrays([pa.array(lines.number[at], pa.int32()), pa.array(k1.view(np.int64))], ["line", "k1"])
            ends = np.concatenate([[0], np.cumsum(np.bincount(lines.text[at], minlength=part.num_rows))])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), marks)], ["doc_id", "n_lines", "worded"])

    marks = "array<struct<line:int,k1:long>>"
    numbers = known.mapInArrow(numbered, f"doc_id {kind}, n_lines long, worded {marks}")
    stays = _stays(docs, id_col, text_col, edits)
    went = F.array_sort(F.array_except("worded", F.coalesce("stay", F.array().cast(marks))))["line"]
    out = numbers.join(stays, "doc_id", "left").withColumn("dropped", went)
    return out.select("doc_id", "n_lines", F.size("worded").cast("long").alias("n_worded"), (F.col("n_lines") - F.size("dropped")).alias("n_kept"), "dropped")


def dedup_lines(docs: DataFrame, id_col="doc_id", text_col="text", edits=EDITS) -> DataFrame:
    """docs with each text less its repeated lines; columns unchanged, every row stays.

    Lines are split at ``\\n``. One without a word (``[^\\x20\\x09-\\x0D]+``) stays. Another stays if no
    earlier line of the corpus is within ``edits`` edits (insertions, deletions, substitutions of code
    points) of it, equal ones included; earlier is by (id, place). A line of at most ``edits`` code points is only
    compared with equal ones, as every line of that length is near every other. A text that loses all lines is empty. Null texts
    and rows with a null id stay as they are. Repeated rows have the same lines in the same places, so they
    lose the same ones. Rows of one id with different texts share their places: there equal lines are one line, different ones
    stand in the order of their hashes. An empty table gives an empty table; other columns may have any names.
    """
    stays = _stays(docs, id_col, text_col, edits)
    names = docs.columns
    tidy = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at, ident = names.index(text_col), names.index(id_col)

    def written(batches):
        for part, lines in _read(batches, 0, at):
            stay = part.column(len(names))
            flat = pc.list_flatten(stay)
            of = np.repeat(np.arange(part.num_rows), pc.fill_null(pc.list_value_length(stay), 0).to_numpy(zero_copy_only=False))
            named = set(zip(of.tolist(), pc.struct_field(flat, 0).to_pylist(), pc.struct_field(flat, 1).to_pylist(), strict=True))
            worded = _worded(lines)
            k1 = _words.range_hash(lines.sums(0x33), lines.start[worded], lines.end[worded]).view(np.int64)
            keep = np.ones(len(lines.start), bool)
            keep[worded] = [mark in named for mark in zip(lines.text[worded].tolist(), lines.number[worded].tolist(), k1.tolist(), strict=True)]
            first = np.searchsorted(lines.text, np.arange(part.num_rows + 1))
            new = []
            for row, (text, known) in enumerate(zip(part.column(at).to_pylist(), part.column(ident).is_valid().to_pylist(), strict=True)):
                flags = keep[first[row] : first[row + 1]]
                if text is None or not known or flags.all():
                    new.append(text)
                else:
                    new.append("\n".join(x for x, yes in zip(text.split("\n"), flags.tolist(), strict=True) if yes))
            columns = list(part.columns[: len(names)])
            columns[at] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(columns, part.schema.names[: len(names)])

    joined = tidy.join(stays.withColumnRenamed("doc_id", "of_id"), F.col(f"c{ident}") == F.col("of_id"), "left").drop("of_id")
    return joined.mapInArrow(written, tidy.schema).toDF(*names)


def query(spark, sf_dir: str) -> DataFrame:
    counts = line_counts(documents(spark, sf_dir))
    return counts.withColumn("dropped", F.array_join(F.col("dropped").cast("array<string>"), ","))


#: With one edit, halves of two lines are equal. Of lines that share one, DuckDB's distance, which counts bytes, tells which may be near, and code points decide.
ORACLE = r"""
WITH l AS (SELECT doc_id, CAST(unnest(range(len(ls))) AS INTEGER) AS line, unnest(ls) AS t, len(ls) AS n_lines FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents WHERE doc_id IS NOT NULL)),
worded AS (SELECT doc_id, line, t, length(t) AS n FROM l WHERE regexp_matches(t, '[^\x20\x09-\x0D]')),
firsts AS (SELECT t, n, min((doc_id, line)) AS pos FROM worded GROUP BY t, n),
keyed AS (SELECT pos, t, n, m, unnest([left(t, m // 2), right(t, m - m // 2)]) AS half, unnest([0, 1]) AS side FROM (SELECT *, unnest([n, n - 1]) AS m FROM firsts) WHERE m > 1),
near AS (SELECT DISTINCT b.pos FROM keyed a JOIN keyed b ON a.m = b.m AND a.side = b.side AND a.half = b.half AND a.pos < b.pos AND abs(a.n - b.n) <= 1 AND (a.m = a.n OR b.m = b.n) WHERE levenshtein(a.t, b.t) <= 4
  AND CASE WHEN a.n = b.n THEN len(list_filter(range(1, a.n + 1), lambda i: a.t[i] <> b.t[i])) <= 1
      ELSE len(list_filter(range(0, least(a.n, b.n) + 1), lambda i: CASE WHEN a.n < b.n THEN left(b.t, i) || substr(b.t, i + 2) = a.t ELSE left(a.t, i) || substr(a.t, i + 2) = b.t END)) > 0 END),
gone AS (SELECT x.doc_id, x.line FROM worded x JOIN firsts f USING (t, n) WHERE (x.doc_id, x.line) <> f.pos OR f.pos IN (SELECT pos FROM near)),
went AS (SELECT doc_id, count(*) AS k, string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) AS dropped FROM gone GROUP BY doc_id)
SELECT d.doc_id, d.n_lines, d.n_worded, d.n_lines - coalesce(k, 0) AS n_kept, coalesce(dropped, '') AS dropped
FROM (SELECT doc_id, any_value(n_lines) AS n_lines, count(*) FILTER (regexp_matches(t, '[^\x20\x09-\x0D]')) AS n_worded FROM l GROUP BY doc_id) d LEFT JOIN went USING (doc_id)
"""
