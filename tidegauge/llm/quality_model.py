"""Quality classifier: logistic regression on hashed word n-grams, trained by FTRL-proximal.

A text's words are runs of letters and digits and runs of marks, lower-cased. Features are the hashed
single words and pairs of neighbours; a pair of equal words is one feature whatever the word. Their
values are counts over the square root of the number of words, so a score is a sparse dot product.

The model is fitted on at most ``MAX_TRAIN`` labelled rows, those of smallest id hash, in one task that
holds only their sparse features; everything is scored. Fold: rows whose crc32 of the id's text is a
multiple of five are held out.

Defined results: null and empty texts have no features and get the intercept's score; a null id counts
as the empty text for its fold and has no label; labels that are null are not used; without both
labels every score is 0.5; repeated rows get equal scores. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.bytewords import Words, byte_class, row_blocks, run_hashes, run_starts, text_bytes

BITS = 18
MAX_TRAIN = 8192
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.1
THRESHOLD = 0.3
_KINDS = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)).astype(np.uint8)
_KINDS[[b for b in range(0x21, 0x7F) if not _KINDS[b]]] = 2
_EQUAL_PAIR = 1


def ngram_buckets(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text and bucket of every n-gram, and the number of words of each text."""
    words = Words(data, offsets, _KINDS)
    hashes, rows = words.hashes(), words.rows()
    pairs = run_starts(words, 2)
    pair_bucket = (run_hashes(hashes, 2)[pairs] >> np.uint64(64 - bits)).astype(np.int64)
    pair_bucket[hashes[pairs] == hashes[pairs + 1]] = _EQUAL_PAIR
    single = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    return np.concatenate((rows, rows[pairs])), np.concatenate((single, pair_bucket)), words.counts


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def training_features(docs: DataFrame, labels: DataFrame, bits: int = BITS, max_train: int = MAX_TRAIN) -> DataFrame:
    """label, buckets and values of at most ``max_train`` labelled rows outside the held-out fold."""
    order = F.xxhash64("doc_id", F.lit("sample"))
    rows = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sample = rows.select("doc_id", F.col("quality").cast("int").alias("label"), order.alias("at")).orderBy("at", "doc_id", "label").limit(max_train)

    def extract(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            for low, high in row_blocks(offsets):
                at, bucket, counts = ngram_buckets(data[offsets[low] : offsets[high]], offsets[low : high + 1], bits)
                key, times = np.unique((at << bits) | bucket, return_counts=True)
                row = key >> bits
                cuts = np.searchsorted(row, np.arange(high - low + 1)).astype(np.int32)
                value = (times / np.sqrt(np.maximum(counts[row], 1))).astype(np.float32)
                part = batch.slice(low, high - low)
                lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(x)) for x in ((key & ((1 << bits) - 1)).astype(np.int32), value)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *lists], ["at", "label", "buckets", "values"])

    # At most max_train label rows, and one text of each id: that of the smallest hash.
    found = docs.select("doc_id", "text").join(F.broadcast(sample.select("doc_id").distinct()), "doc_id")
    texts = found.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    joined = texts.join(F.broadcast(sample), "doc_id").select("at", "label", "text")
    return joined.mapInArrow(extract, "at long, label int, buckets array<int>, values array<float>")


class Ftrl:
    """Follow-the-regularised-leader weights of a logistic regression with an intercept."""

    def __init__(self, bits: int):
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def update(self, buckets: np.ndarray, values: np.ndarray, label: int) -> None:
        w = self.weights(buckets)
        score = 1 / (1 + np.exp(-np.clip(w @ values, -30, 30)))
        gradient = (score - label) * values
        square = gradient * gradient
        self.z[buckets] += gradient - (np.sqrt(self.n[buckets] + square) - np.sqrt(self.n[buckets])) / ALPHA * w
        self.n[buckets] += square


def fit(features: DataFrame, bits: int = BITS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights of all buckets, and the intercept last; the sample's rows are seen in hash order."""

    def train(batches):
        rows = []
        for batch in batches:
            at, label, buckets, values = batch.columns
            for i in range(len(batch)):
                rows.append((at[i].as_py(), label[i].as_py(), buckets[i].values.to_numpy(), values[i].values.to_numpy()))
        rows.sort(key=lambda r: (r[0], r[1], len(r[2])))
        model = Ftrl(bits)
        if len({r[1] for r in rows}) > 1:
            for _ in range(epochs):
                for _, label, buckets, values in rows:
                    model.update(np.append(buckets, 1 << bits), np.append(values, np.float32(1)).astype(np.float64), label)
        weights = model.weights(slice(None))
        used = np.flatnonzero(weights)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(weights[used])], ["bucket", "weight"])

    out = np.zeros((1 << bits) + 1)
    for bucket, weight in features.repartition(1).mapInArrow(train, "bucket long, weight double").collect():
        out[bucket] += weight
    return out


def score_documents(docs: DataFrame, weights: np.ndarray, bits: int = BITS) -> DataFrame:
    """doc_id and score of every document's whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def score(batches):
        model = shared.value
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for low, high in row_blocks(offsets):
                at, bucket, counts = ngram_buckets(data[offsets[low] : offsets[high]], offsets[low : high + 1], bits)
                dot = np.bincount(at, weights=model[bucket], minlength=high - low) / np.sqrt(np.maximum(counts, 1)) + model[-1]
                scores = 1 / (1 + np.exp(-np.clip(dot, -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(scores)], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    weights = fit(training_features(docs, labels, max_train=max_train))
    scored = score_documents(docs, weights)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
