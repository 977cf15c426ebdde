"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader.

Features of a text: its tokens (runs of letters and digits, and runs of signs) and its token pairs, each
hashed to one of 2**BITS weights; a pair of two equal tokens is one feature of its own, whichever the
token. A text's vector holds the square root of each feature's count, scaled to length 1; its score is the
logistic function of the sparse dot product.

Training runs in one task on a bounded sample of labelled rows (MAX_TRAIN rows, chosen by hash), each as
sparse arrays that other tasks have made. Scoring is a map over whole texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutloom.llm import _words
from cutloom.llm._tables import documents, labels, materialize, picked

BITS = 18
MAX_TRAIN = 16_000
STEPS = 32_000
THRESHOLD = 0.3
U = np.uint64

#: What a byte is to the tokens: 0 white space, 1 letter or digit (all of non-ASCII), 2 sign.
_KIND = np.full(256, 2, np.uint8)
_KIND[_words.IS_SPACE] = 0
_KIND[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1


def features(s: _words.Slice, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a slice's rows: feature indices, their values, and where each row begins (one more at the end). Index 0 is the bias that every row has."""
    kind = _KIND[s.data]
    begins = np.ones(len(kind), bool)
    begins[1:] = kind[1:] != kind[:-1]
    begins[s.offsets[:-1][s.offsets[:-1] < len(kind)]] = True
    cuts = np.flatnonzero(begins)
    start, end = cuts, np.append(cuts[1:], len(kind))
    solid = kind[start] > 0
    start, end = start[solid], end[solid]
    rows = np.searchsorted(start, s.offsets)
    n = np.diff(rows)
    row = np.repeat(np.arange(s.rows), n)
    token = _words.range_hash(_words.prefix_sums(s.data), start, end)
    left, right, inside = token[:-1], token[1:], row[:-1] == row[1:]
    pair = np.where(left == right, U(0x77), _words.mix(left * U(3) + right))[inside]
    size = U(1 << bits)
    index = np.concatenate([np.zeros(s.rows, U), _words.mix(token, 1) % (size - U(1)) + U(1), _words.mix(pair, 2) % (size - U(1)) + U(1)])
    of_row = np.concatenate([np.arange(s.rows), row, row[:-1][inside]]).astype(U)
    key, count = np.unique((of_row << U(bits)) | index, return_counts=True)
    of_row, index = (key >> U(bits)).astype(np.int64), (key & (size - U(1))).astype(np.int64)
    first = np.searchsorted(of_row, np.arange(s.rows + 1))
    value = np.sqrt(count)
    norm = np.sqrt(np.maximum(np.add.reduceat(np.where(index > 0, count, 0), first[:-1]), 1)) if s.rows else np.zeros(0)
    value = np.where(index > 0, value / norm[of_row], 1.0)
    return index, value, first


def _sparse_rows(batches, bits: int):
    for batch in batches:
        for s in _words.slices(batch.column(0)):
            index, value, first = features(s, bits)
            part = batch.slice(s.first, s.rows)
            at = pa.array(first, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [part.column(1), part.column(2), pa.ListArray.from_arrays(at, pa.array(index, pa.int32())), pa.ListArray.from_arrays(at, pa.array(value, pa.float32()))],
                ["label", "at", "index", "value"],
            )


def _ftrl(batches, bits: int, steps: int, alpha: float, beta: float, l1: float, l2: float):
    """Per-coordinate follow-the-regularised-leader steps over the rows, in the order of their hash, in about ``steps`` steps (2 to 40 passes); yields the weights that aren't 0."""
    examples = []
    for batch in batches:
        index, value = batch.column(2), batch.column(3)
        ends, flat_index, flat_value = index.offsets.to_numpy(), index.values.to_numpy(), value.values.to_numpy()
        for k, y in enumerate(batch.column(0).to_numpy()):
            examples.append((y, flat_index[ends[k] : ends[k + 1]].copy(), flat_value[ends[k] : ends[k + 1]].copy()))
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)

    def weights(z_i, n_i):
        return np.where(np.abs(z_i) <= l1, 0.0, -(z_i - np.sign(z_i) * l1) / ((beta + np.sqrt(n_i)) / alpha + l2))

    for _ in range(max(2, min(40, steps // max(len(examples), 1)))):
        for y, i, v in examples:
            z_i, n_i = z[i], n[i]
            w = weights(z_i, n_i)
            g = (1 / (1 + np.exp(-np.clip(np.dot(w, v), -35, 35))) - y) * v
            z[i] = z_i + g - (np.sqrt(n_i + g * g) - np.sqrt(n_i)) / alpha * w
            n[i] = n_i + g * g
    w = weights(z, n)
    kept = np.flatnonzero(w)
    yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int32()), pa.array(w[kept], pa.float64())], ["index", "weight"])


def learnable(id_: Column) -> Column:
    return F.crc32(id_.cast("string")) % 5 != 0


def training_texts(docs: DataFrame, marks: DataFrame, id_col="doc_id", text_col="text", label_id_col="doc_id", label_col="quality", max_train=MAX_TRAIN) -> DataFrame:
    """text, label, at of labelled texts whose crc32(id) mod 5 isn't 0: about max_train of them, those of least hash (``at``) of (id, text, label).

    Rows with a null id or label aren't among them. Of an id with several texts or labels each pair is one; equal ones are one.
    """
    marked = marks.select(F.col(f"`{label_id_col}`").alias("doc_id"), F.col(f"`{label_col}`").cast("double").alias("label")).filter("doc_id is not null and label is not null")
    marked = marked.filter(learnable(F.col("doc_id")))
    rows = picked(docs, doc_id=id_col, text=text_col).withColumn("digest", F.xxhash64("text"))
    pairs = rows.select("doc_id", "digest").join(marked, "doc_id").distinct().withColumn("at", F.pmod(F.xxhash64("doc_id", "digest", "label"), F.lit(1 << 30)))
    pairs = materialize(pairs, "label-pairs")
    share = min(1.0, max_train / max(pairs.count(), 1))
    chosen = pairs.filter(F.col("at") < F.lit(int(share * (1 << 30))))
    texts = rows.join(F.broadcast(chosen), ["doc_id", "digest"])  # about max_train rows of four numbers
    return texts.dropDuplicates(["doc_id", "digest", "label"]).select("text", "label", "at")


def train(docs: DataFrame, marks: DataFrame, id_col="doc_id", text_col="text", label_id_col="doc_id", label_col="quality", max_train=MAX_TRAIN, bits=BITS, steps=STEPS, alpha=1.0, beta=1.0, l1=0.1, l2=0.1) -> np.ndarray:
    """Weights from training_texts(). With no label, all weights are 0.

    The one training task holds the features of these texts alone; it passes over them 2 to 40 times, about ``steps`` steps in all.
    """
    texts = training_texts(docs, marks, id_col, text_col, label_id_col, label_col, max_train)
    sparse = texts.mapInArrow(lambda b: _sparse_rows(b, bits), "label double, at long, index array<int>, value array<float>")
    one = sparse.repartition(1).sortWithinPartitions("at", "label", F.xxhash64("index"))
    rows = one.mapInArrow(lambda b: _ftrl(b, bits, steps, alpha, beta, l1, l2), "index int, weight double").toArrow()
    weights = np.zeros(1 << bits, np.float32)
    weights[rows.column("index").to_numpy()] = rows.column("weight").to_numpy()
    return weights


def _scores(batches, weights, column: int, bits: int):
    w = weights.value.astype(np.float64)
    for batch in batches:
        parts = [np.zeros(0)]
        for s in _words.slices(batch.column(column)):
            index, value, first = features(s, bits)
            parts.append(np.add.reduceat(w[index] * value, first[:-1]))
        score = 1 / (1 + np.exp(-np.clip(np.concatenate(parts), -35, 35)))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], [*batch.schema.names, "score"])


def score(docs: DataFrame, weights: np.ndarray, id_col="doc_id", text_col="text", bits=BITS) -> DataFrame:
    """doc_id and score of every row; null and empty texts get the bias alone. Other columns are ignored."""
    rows = picked(docs, doc_id=id_col, text=text_col)
    broadcast = docs.sparkSession.sparkContext.broadcast(weights)  # 2**bits floats, whatever the data
    kind = rows.schema["doc_id"].dataType.simpleString()

    def scored(batches):
        for batch in _scores(batches, broadcast, 1, bits):
            yield batch.select(["doc_id", "score"])

    return rows.mapInArrow(scored, f"doc_id {kind}, score double")


def keep_good(docs: DataFrame, marks: DataFrame, id_col="doc_id", text_col="text", threshold=THRESHOLD, **training) -> DataFrame:
    """The rows of docs that score at least threshold, columns unchanged (their names may be any, `score` too)."""
    weights = docs.sparkSession.sparkContext.broadcast(train(docs, marks, id_col, text_col, **training))
    names = docs.columns
    tidy = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at, bits = names.index(text_col), training.get("bits", BITS)

    def kept(batches):
        for batch in _scores(batches, weights, at, bits):
            good = pa.array(batch.column(len(names)).to_numpy() >= threshold)
            yield batch.filter(good).select(list(range(len(names))))

    return tidy.mapInArrow(kept, tidy.schema).toDF(*names)


def query(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = score(docs, train(docs, labels(spark, sf_dir)))
    return scored.select("doc_id", (~learnable(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
