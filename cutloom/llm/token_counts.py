"""Token counts by a map-side two-tier lookup.

Tier one: a compact table (pre-token, length) of the corpus' most frequent pre-tokens, broadcast.
Tier two: pre-tokens it lacks are encoded from the tokenizer's file through a cache in each Python
worker. No pre-token occurrence is shuffled: the first pass leaves each task with one bounded
summary, whose rows alone are added up.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutloom.llm import _bpe
from cutloom.llm._tables import documents, picked

SUMMARY_ENTRIES = 4096
TABLE_ENTRIES = 32_768
LONGEST = 64
LIMIT = 512


def _summaries(batches, entries: int):
    """Misra-Gries over the task's pre-tokens: after each overflow the (entries+1)-th count is taken off all, so what remains is bounded and no frequent pre-token is lost."""
    seen: Counter[str] = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            for part in _bpe.stretches(text or ""):
                seen.update(_bpe.splitter(part))
            if len(seen) > 16 * entries:
                off = sorted(seen.values(), reverse=True)[entries]
                seen = Counter({k: n - off for k, n in seen.items() if n > off})
    top = [x for x in seen.most_common(entries) if len(x[0]) <= LONGEST]
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["pretoken", "n"])


def frequent_pretokens(docs: DataFrame, text_col="text", summary_entries=SUMMARY_ENTRIES, table_entries=TABLE_ENTRIES) -> list[str]:
    """At most table_entries pre-tokens, most frequent first, from all texts. The choice bears on speed only, never on a count."""
    found = picked(docs, text=text_col).mapInArrow(lambda batches: _summaries(batches, summary_entries), "pretoken string, n long")
    top = found.groupBy("pretoken").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "pretoken").limit(table_entries)
    return [r.pretoken for r in top.select("pretoken").collect()]


def compact(pretokens: list[str], lengths: list[int]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The table as it is broadcast: joined UTF-8, where each entry ends, and its length in tokens."""
    raw = [p.encode() for p in pretokens]
    return b"".join(raw), np.cumsum([len(x) for x in raw], dtype=np.int32), np.array(lengths, np.int16)


_lookup: dict = {}


def _cache(table, path: str, key: int) -> _bpe.Cache:
    """The worker's cache for one broadcast table, kept between tasks."""
    if _lookup.get("key") != (key, path):
        raw, ends, lengths = table
        starts = np.concatenate([[0], ends])[:-1].astype(int)
        first = {raw[s:e].decode(): int(n) for s, e, n in zip(starts.tolist(), ends.tolist(), lengths.tolist(), strict=True)}
        _lookup.update(key=(key, path), cache=_bpe.Cache(lambda p: len(_bpe.plain_ids(p, path)), first))
    return _lookup["cache"]


def _counted(batches, table, path: str):
    cache = _cache(table.value, path, table.id)
    length = cache.__getitem__
    for batch in batches:
        n_bytes, n_tokens = [], []
        for text in batch.column(1).to_pylist():
            text = text or ""
            n_bytes.append(len(text.encode()))
            if _bpe.plain(text, path):
                n_tokens.append(sum(sum(map(length, _bpe.splitter(part))) for part in _bpe.stretches(text)))
            else:
                n_tokens.append(len(_bpe.library_ids(text, path)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])


class _Table:
    """The broadcast table with an id that tells workers whether their cache is for it."""

    def __init__(self, broadcast, key: int):
        self._broadcast, self.id = broadcast, key

    @property
    def value(self):
        return self._broadcast.value


def token_counts(docs: DataFrame, id_col="doc_id", text_col="text", tokenizer: str | None = None, table_entries=TABLE_ENTRIES) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens of every whole text, as the library counts them.

    Null and empty texts have 0 of either. Special tokens' strings inside a text become those tokens,
    the library's default; nothing is truncated or padded. One row per input row, repeated ids
    included; other columns are ignored; an empty table gives an empty table.
    """
    path = tokenizer or _bpe.tokenizer_path()
    pretokens = frequent_pretokens(docs, text_col, table_entries=table_entries)
    lengths = [len(_bpe.library_ids(p, path)) for p in pretokens]
    broadcast = docs.sparkSession.sparkContext.broadcast(compact(pretokens, lengths))
    table = _Table(broadcast, hash((path, tuple(pretokens))))
    rows = picked(docs, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lambda batches: _counted(batches, table, path), f"doc_id {kind}, n_bytes long, n_tokens long")


def query(spark, sf_dir: str) -> DataFrame:
    counts = token_counts(documents(spark, sf_dir))
    return counts.withColumn("over_limit", F.col("n_tokens") > LIMIT)
