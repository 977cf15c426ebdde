"""Spelling variants: words one edit apart, by a positional q-gram inverted index with a count filter.

A word of n letters, padded on both sides, has n + q - 1 positional q-grams. One inserted, deleted or replaced
letter spoils q of the longer word's at most, so two words one edit apart share max(n, m) - 1 of them, at positions
that differ by the difference of their lengths at most. So each word is found under its q + 1 rarest grams: whoever is one edit away
has one of those among its own rarest. Groups of one (gram, position, length) are indexed
by themselves: postings of a probing word's grams are merged on a heap, candidates with too few shared
grams are left out, and the others are compared letter by letter.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_left
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutloom.llm import _words
from cutloom.llm._tables import documents, materialize, picked

Q = 3
#: Of the words: letters at least, occurrences at least, and how many times the occurrences a form has.
LETTERS, OCCURRENCES, FACTOR = 6, 5, 5
#: One run in so many loses a letter, as its checksum has it.
THINNED = 199
CHUNK = 1024
SLICE = 1 << 20
HELD = 1 << 18
POSITION = 1 << 21

IS_LETTER = np.zeros(256, bool)
IS_LETTER[[*range(65, 91), *range(97, 123)]] = True
LEAD = 0xC3  # the first byte of U+00C0 to U+00FF in UTF-8, and of nothing else
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LETTER = np.zeros(256, np.int64)
LETTER[97:123] = np.arange(1, 27)
LETTER[0x80:0xC0] = np.arange(27, 91)
BEGIN, END = 0, 91


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


CRC = _crc_table()


def crc32s(data: np.ndarray, start: np.ndarray, end: np.ndarray, begun: np.ndarray) -> np.ndarray:
    """zlib.crc32(data[start:end], begun) of each range: all ranges a byte at a time, the last few long ones by zlib."""
    order = np.argsort(start - end, kind="stable")
    s, n = start[order], (end - start)[order]
    state = begun[order].astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    k, live = 0, len(s)
    while live > 16:
        live = int(np.searchsorted(-n, -k, "left"))
        now = state[:live]
        state[:live] = CRC[(now ^ data[s[:live] + k]) & np.uint32(255)] ^ (now >> np.uint32(8))
        k += 1
    state ^= np.uint32(0xFFFFFFFF)
    for i in range(live):
        if n[i] > k:
            state[i] = zlib.crc32(data[s[i] + k : s[i] + n[i]].tobytes(), int(state[i]))
    out = np.empty(len(s), np.uint32)
    out[order] = state
    return out


def runs(s: _words.Slice) -> _words.Words:
    """Maximal runs of ASCII letters and U+00C0 to U+00FF."""
    lead = s.data == LEAD
    solid = IS_LETTER[s.data] | lead
    solid[1:] |= lead[:-1]
    return _words.words(s, solid)


def strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The ranges of data as an Arrow column of strings."""
    ends = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
    at = np.repeat(start - ends[:-1], end - start) + np.arange(ends[-1])
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(ends.tobytes()), pa.py_buffer(data[at].tobytes()))


def _counted(batches, letters: int, thinned: int):
    """(word, n) of the task's runs, thinned and long enough; added up as far as the words fit in HELD entries."""
    held: list[pa.Table] = []
    rows = 0

    def merged() -> pa.Table:
        return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

    for batch in batches:
        ids = batch.column(0).to_pylist()
        for s in _words.slices(batch.column(1), SLICE):
            w = runs(s)
            low = LOWER[s.data]
            leads = np.concatenate([[0], np.cumsum(low == LEAD)])
            size = w.end - w.start - (leads[w.end] - leads[w.start])
            row = np.repeat(np.arange(s.rows), w.counts())
            keep = size >= letters
            start, end, size, row = w.start[keep], w.end[keep], size[keep], row[keep]
            begun = np.array([zlib.crc32(f"{'' if x is None else x}:".encode()) for x in ids[s.first : s.first + s.rows]], np.uint32)
            h = crc32s(low, start, end, begun[row])
            hit = h % np.uint32(thinned) == 0
            cut = []
            for a, b, n, x in zip(start[hit].tolist(), end[hit].tolist(), size[hit].tolist(), h[hit].tolist(), strict=True):
                if n > letters:
                    run = low[a:b].tobytes().decode()
                    cut.append(run[: x % n] + run[x % n + 1 :])
            for found in (strings(low, start[~hit], end[~hit]), pa.array(cut, pa.string())):
                counts = found.value_counts()
                held.append(pa.table({"word": counts.field(0), "n": counts.field(1)}))
                rows += len(counts)
            if rows > 2 * HELD:
                held = [merged()]
                rows = held[0].num_rows
                if rows > HELD:
                    yield from held[0].combine_chunks().to_batches()
                    held, rows = [], 0
    if held:
        yield from merged().combine_chunks().to_batches()


def word_counts(docs: DataFrame, id_col="doc_id", text_col="text", letters=LETTERS, occurrences=OCCURRENCES, thinned=THINNED) -> DataFrame:
    """word, n: of the runs of letters of all texts, A-Z lower-cased and thinned, those of enough letters and occurrences.

    A run loses the code point (h % length) if ``thinned`` divides h, the CRC-32 of ``<id>:<run>``; a null id is the empty text there.
    """
    found = picked(docs, id=id_col, text=text_col).select(F.col("id").cast("string"), "text")
    partial = found.mapInArrow(lambda b: _counted(b, letters, thinned), "word string, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= occurrences)


def grams(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the words' positional grams in order, their positions, and where each word's begin (one more at the end)."""
    if isinstance(words, pa.ChunkedArray):
        words = words.combine_chunks()
    words = words.cast(pa.large_string())
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64)
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    solid = np.flatnonzero(data != LEAD)
    first = np.searchsorted(solid, offsets - offsets[0])  # letters before each word
    n = np.diff(first)
    padded = np.full(len(solid) + 2 * (Q - 1) * len(words), END, np.int64)
    at = first[:-1] + 2 * (Q - 1) * np.arange(len(words))  # where each padded word begins
    for k in range(Q - 1):
        padded[at + k] = BEGIN
    padded[np.repeat(at + Q - 1 - first[:-1], n) + np.arange(len(solid))] = LETTER[data[solid]]
    starts = np.concatenate([[0], np.cumsum(n + Q - 1)])
    position = np.arange(starts[-1]) - np.repeat(starts[:-1], n + Q - 1)
    place = np.repeat(at, n + Q - 1) + position
    code = np.zeros(len(place), np.int64)
    for k in range(Q):
        code = code * 128 + padded[place + k]
    return code, position, starts


def _gram_counts(batches):
    total = np.zeros(128**Q, np.int64)
    for batch in batches:
        total += np.bincount(grams(batch.column(0))[0], minlength=len(total))
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["gram", "n"])


def gram_order(words: DataFrame) -> np.ndarray:
    """All grams of the words, rarest first (of equally rare ones the lesser code). At most 92 ** q: the alphabet has 90 letters and two pads."""
    total = words.select("word").mapInArrow(_gram_counts, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    found = total.toArrow()
    gram, n = found["gram"].to_numpy(), found["n"].to_numpy()
    return gram[np.lexsort((gram, n))].astype(np.int32)


BASE, EQUAL, LONGER = 0, 1, 2
KEY = ("gram", "position", "letters")


def _routed(batches, order, letters: int):
    """Each word under its q + 1 rarest grams: as a base of its length, and as a longer word that looks for shorter ones at the same place or one before."""
    by_code = np.argsort(order.value)
    codes = order.value[by_code]
    for batch in batches:
        code, position, starts = grams(batch.column("word"))
        n = np.diff(starts)
        word = np.repeat(np.arange(len(n)), n)
        rank = by_code[np.searchsorted(codes, code)]
        at = np.lexsort((position, rank, word))
        rare = at[np.arange(len(at)) - starts[word] < Q + 1]  # at is sorted by word, so places in it are as in starts
        word, gram, position, size = word[rare], code[rare], position[rare], n[word[rare]] - (Q - 1)
        long = size > letters
        before = long & (position > 0)
        parts = [(np.ones(len(word), bool), 0, 0, BASE), (long, 0, 1, LONGER), (before, 1, 1, LONGER)]
        at = np.concatenate([np.flatnonzero(which) for which, *_ in parts])
        role = np.concatenate([np.full(which.sum(), r) for which, _, _, r in parts])
        place = np.concatenate([position[which] - back for which, back, _, _ in parts])
        length = np.concatenate([size[which] - less for which, _, less, _ in parts])
        columns = [pa.array(x.astype(np.int32)) for x in (gram[at], place, length, role)]
        yield pa.RecordBatch.from_arrays([*columns, *(batch.column(c).take(pa.array(word[at])) for c in ("word", "n"))], [*KEY, "role", "word", "n"])


def one_edit(x: str, y: str) -> bool:
    """Whether different words x and y, x not the shorter, are one inserted, deleted or replaced code point apart."""
    i = next((k for k, (a, b) in enumerate(zip(x, y, strict=False)) if a != b), len(y))
    return x[i + 1 :] == y[i + (len(x) == len(y)) :]


class Postings:
    """An inverted index of words of one length: for each gram at its position, the numbers of the words that have it there."""

    def __init__(self):
        self.words: list[tuple[str, int]] = []
        self.lists: dict[int, list[int]] = defaultdict(list)

    def add(self, word: str, n: int, tokens: list[int]) -> None:
        for t in tokens:
            self.lists[t].append(len(self.words))
        self.words.append((word, n))

    def near(self, word: str, tokens: list[int], least: int):
        """The indexed words one edit from word, of those in ``least`` of the tokens' postings or more.

        Such a word is in one of the shortest postings, all but least - 1: these are merged on a heap, the others are searched.
        """
        lists = [found for t in tokens if (found := self.lists.get(t))]
        if len(lists) < least:
            return
        lists.sort(key=len)
        short, long = lists[: len(lists) - least + 1], lists[len(lists) - least + 1 :]
        last, seen = -1, 0
        for number in heapq.merge(*short, (len(self.words),)):
            if number == last:
                seen += 1
                continue
            if last >= 0 and self._enough(last, seen, long, least) and one_edit(word, self.words[last][0]):
                yield self.words[last]
            last, seen = number, 1

    @staticmethod
    def _enough(number: int, seen: int, long: list[list[int]], least: int) -> bool:
        for left, found in enumerate(long):
            if seen >= least or seen + len(long) - left < least:
                break
            i = bisect_left(found, number)
            seen += i < len(found) and found[i] == number
        return seen >= least


def _near(batches):
    """Rows arrive sorted by (key, chunk, role): in each run of equal (key, chunk) the bases are indexed, and every later row is looked up."""
    now, index = None, Postings()
    for batch in batches:
        out: list[tuple] = []
        code, position, starts = grams(batch.column("word"))
        tokens = (position % POSITION * POSITION + code).tolist()
        where = zip(*[batch.column(c).to_pylist() for c in (*KEY, "chunk")], strict=True)
        for row, (key, role, word, n) in enumerate(zip(where, *[batch.column(c).to_pylist() for c in ("role", "word", "n")], strict=True)):
            if key != now:
                now, index = key, Postings()
            own = tokens[starts[row] : starts[row + 1]]
            if index.words:
                asked = own if role != LONGER else own + [t - POSITION for t in own]
                found = index.near(word, asked, len(own) - Q)
                out.extend((word, n, *x) if len(x[0]) < len(word) or x[0] < word else (*x, word, n) for x in found)
            if role == BASE:
                index.add(word, n, own)
        columns = list(zip(*out, strict=True)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64()) * 2, strict=True)], ["word", "n", "near", "near_n"])


def near_pairs(words: DataFrame, letters=LETTERS, chunk=CHUNK) -> DataFrame:
    """word, n, near, near_n: each pair of words(word, n), of at least ``letters`` letters, that are one edit apart, once: near is the shorter, of equally long ones the first.

    A group of more than ``chunk`` bases is dealt in chunks; a base is looked up in the chunks before its own too, a longer word in all.
    """
    spark = words.sparkSession
    order = spark.sparkContext.broadcast(gram_order(words))
    routed = words.select("word", "n").mapInArrow(lambda b: _routed(b, order, letters), "gram int, position int, letters int, role int, word string, n long")
    hot = routed.filter(F.col("role") == BASE).groupBy(*KEY).agg(F.count("*").alias("many")).filter(F.col("many") > chunk)
    hot = materialize(hot.select(*KEY, F.ceil(F.col("many") / chunk).cast("int").alias("chunks")), "hot-grams")
    dealt = routed.join(hot, list(KEY), "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    own = F.pmod(F.xxhash64("word"), F.col("chunks")).cast("int")
    place = lambda c, role: F.struct(c.alias("chunk"), role.alias("role"))
    bases = F.transform(F.sequence(F.lit(0), own), lambda c: place(c, F.when(c == own, BASE).otherwise(EQUAL)))
    longer = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: place(c, F.lit(LONGER)))
    dealt = dealt.select(*KEY, "word", "n", F.explode(F.when(F.col("role") == BASE, bases).otherwise(longer)).alias("at"))
    together = dealt.select(*KEY, "at.chunk", "at.role", "word", "n").repartition(*KEY, "chunk").sortWithinPartitions(*KEY, "chunk", "role", "word")
    return together.mapInArrow(_near, "word string, n long, near string, near_n long").dropDuplicates(["word", "near"])


def followed(forms: DataFrame) -> DataFrame:
    """word, root for every row of forms(word, form): the last word that forms lead to. Each round doubles the steps taken, so chains of n words take log2(n) rounds."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialize(now.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if moved.filter("moved").limit(1).count() == 0:
            return moved.select("word", "root")
        now = moved.select("word", "root")


def spelling_variants(docs: DataFrame, id_col="doc_id", text_col="text", letters=LETTERS, occurrences=OCCURRENCES, factor=FACTOR, thinned=THINNED) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row a word of word_counts.

    Two words are near if one inserted, deleted or replaced code point makes one of the other. n_near counts a word's near ones; form is the one of
    largest n (ties: the first in code-point order) if that is ``factor`` times the word's n or more, form_n its n; root is where forms lead in the end, the
    word itself if it has none. Null and empty texts have no words; repeated rows count each time; a null id is the empty text in the checksum.
    An empty table gives an empty table; other columns are ignored.
    """
    words = materialize(word_counts(docs, id_col, text_col, letters, occurrences, thinned), "words")
    pairs = materialize(near_pairs(words, letters), "near-words")
    both = pairs.select("word", "near", "near_n").unionByName(pairs.select(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct(-F.col("near_n"), "near")).alias("best"))
    best = best.select("word", "n_near", F.col("best.near").alias("form"), (-F.col("best.col1")).alias("form_n"))
    formed = words.join(best, "word", "left").withColumn("has", F.coalesce(F.col("form_n") >= factor * F.col("n"), F.lit(False)))
    formed = materialize(formed.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("has"), F.col("form")).alias("form"), F.when(F.col("has"), F.col("form_n")).alias("form_n")), "forms")
    roots = followed(formed.filter("form is not null"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark, sf_dir: str) -> DataFrame:
    return spelling_variants(documents(spark, sf_dir))


#: Words one edit apart share what is left of them without one letter. CRC-32 by its table, a byte at a time.
ORACLE = r"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS t FROM (SELECT CAST(range AS BIGINT) AS b FROM range(256))
), runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), counted AS (SELECT doc_id, run, count(*) AS n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS digits FROM runs WHERE length(run) >= 6 GROUP BY ALL
), hashed AS (
  SELECT run, n, xor(list_reduce(list_transform(range(len(digits) // 2), lambda i: CAST('0x' || digits[2 * i + 1:2 * i + 2] AS BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) AS h FROM counted, crc
), words AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), less AS MATERIALIZED (SELECT word, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM words)
), near AS MATERIALIZED (
  SELECT a.word, b.word AS near FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND length(a.word) = length(b.word) AND a.word <> b.word
  UNION SELECT l.word, w.word FROM less l JOIN words w ON l.rest = w.word UNION SELECT w.word, l.word FROM less l JOIN words w ON l.rest = w.word
), best AS (SELECT near.word, count(*) AS n_near, min(struct_pack(m := -f.n, near := near)) AS best FROM near JOIN words f ON f.word = near GROUP BY near.word
), formed AS MATERIALIZED (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.m >= 5 * n THEN best.near END AS form, CASE WHEN -best.m >= 5 * n THEN -best.m END AS form_n FROM words LEFT JOIN best USING (word)
), led(word, root, form) AS (
  SELECT word, word, form FROM formed UNION ALL SELECT led.word, f.word, f.form FROM led JOIN formed f ON f.word = led.form
)
SELECT formed.word, formed.form, led.root, n, n_near, form_n FROM formed JOIN led ON led.word = formed.word AND led.form IS NULL
"""
