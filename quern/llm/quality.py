"""Quality classifier: logistic regression on hashed word n-grams, trained by follow the regularised leader."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import tokens
from ._shared import crc32_of_id, documents, lean, utf8

#: Buckets of the hashed features, and the longest n-gram.
BUCKETS, GRAMS = 1 << 18, 2
#: Most labelled documents that a model is fitted on (the documented bound of the sample).
TRAIN_DOCUMENTS = 6000
#: Score from which a document is kept.
THRESHOLD = 0.7


def _counts(code, upper, kind, width, doc, buckets: int, n: int, skip: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """``(doc * buckets + bucket, count)`` of the n-grams that end at token ``skip`` or later."""
    case = np.where(upper == 0, 0, np.where((upper == width) & (upper > 1), 2, 1))
    word = tokens.mix(code + case.astype(np.uint64))
    again = np.zeros(len(word), bool)
    again[1:] = (code[1:] == code[:-1]) & (doc[1:] == doc[:-1])
    shape = tokens.mix(np.uint64(1 << 20) + (kind * 6 + case * 2 + again).astype(np.uint64))
    keys = []
    for stream, longest in ((word, n), (shape, n + 1)):
        for k in range(1, longest + 1):
            gram, at = tokens.grams(stream, doc, k)
            if skip:
                gram, at = gram[at + k > skip], at[at + k > skip]
            keys.append(doc[at] * buckets + (tokens.mix(gram + np.uint64(k)) % np.uint64(buckets)).astype(np.int64))
    return np.unique(np.concatenate(keys), return_counts=True)


def features(texts: list[bytes], buckets: int = BUCKETS, n: int = GRAMS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows ``(doc, bucket, value)``, sorted by both: hashed 1- to ``n``-grams of words.

    A word is a run of letters, digits or marks; its hash has its case (lower, capital,
    upper) beside the lower-cased bytes.  The same n-grams are also taken of the words'
    shapes (class, case, and whether it repeats the word before), which rare words share.
    Values are 1 + log(count), scaled to length 1 a document.  Texts longer than a slice
    are counted slice by slice, with the last words of the one before.
    """
    short = [i for i, t in enumerate(texts) if len(t) <= tokens.SLICE]
    t = tokens.Tokens([texts[i] for i in short])
    found = [_counts(t.code, t.upper, t.kind, t.end - t.begin, np.array(short, np.int64)[t.doc], buckets, n)]
    for i in (i for i, t in enumerate(texts) if len(t) > tokens.SLICE):
        held, at, parts = None, 0, []
        while at < len(texts[i]):
            end = tokens.cut_at(texts[i], at + tokens.SLICE)
            t = tokens.Tokens([texts[i][at:end]])
            now = [t.code, t.upper, t.kind, t.end - t.begin]
            if held:
                now = [np.concatenate(x) for x in zip(held, now)]
            parts.append(_counts(*now, np.full(len(now[0]), i), buckets, n, len(held[0]) if held else 0))
            held, at = [x[-n - 1 :] for x in now], end
        found.append(_summed(parts))
    key, count = _summed(found) if len(found) > 1 else found[0]
    doc, bucket = key // buckets, key % buckets
    value = 1 + np.log(count)
    length = np.sqrt(np.bincount(doc, value * value, minlength=len(texts)))
    return doc, bucket, (value / length[doc]).astype(np.float32)


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return key, np.bincount(at, np.concatenate([c for _, c in parts]), minlength=len(key))


class FollowTheRegularisedLeader:
    """FTRL-proximal logistic regression with an adaptive rate for each weight, after McMahan et al. (2013)."""

    def __init__(self, buckets: int = BUCKETS, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(buckets + 1), np.zeros(buckets + 1)  # the last is the constant

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, bucket: np.ndarray, value: np.ndarray, label: int) -> None:
        at = np.append(bucket, len(self.z) - 1)
        x = np.append(value, 1.0)
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
        step = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - step * w
        self.n[at] += g * g


def fit(rows: list[tuple[list[int], list[float], int]], epochs: int = 3, seed: int = 0, buckets: int = BUCKETS) -> np.ndarray:
    """Weights (float32, the constant last) from ``(buckets, values, label)`` rows in shuffled order."""
    model = FollowTheRegularisedLeader(buckets)
    data = [(np.asarray(b, np.int64), np.asarray(v, np.float64), y) for b, v, y in rows]
    for epoch in range(epochs):
        for i in np.random.default_rng(seed + epoch).permutation(len(data)):
            model.learn(*data[i])
    return model.weights().astype(np.float32)


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = TRAIN_DOCUMENTS) -> list[tuple]:
    """Features of at most ``most`` labelled documents, those of the least hashed ids, in the order of that hash.

    Labels of ids whose crc32 modulo 4 is 2 are held out.  Of labels that contradict each
    other, the smallest counts; null labels and null ids don't.
    """
    sample = (
        labels.where(F.col(label_col).isin(0, 1) & (crc32_of_id(id_col) % 4 != 2))
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.min(label_col).cast("int").alias("label"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(most)
    )
    out = T.StructType([T.StructField("id", sample.schema["id"].dataType), T.StructField("label", T.IntegerType()), T.StructField("buckets", T.BinaryType()), T.StructField("values", T.BinaryType())])
    schema = to_arrow_schema(out)

    def run(batches):
        for b in batches:
            labels_of = b.column(1).to_pylist()
            done = 0
            for ids, texts in tokens.chunks(b.column(0).to_pylist(), utf8(b.column(2))):
                doc, bucket, value = features(texts)
                edges = np.searchsorted(doc, np.arange(len(ids) + 1)).tolist()
                cut = list(zip(edges, edges[1:]))
                yield pa.RecordBatch.from_arrays([pa.array(ids, schema.field(0).type), pa.array(labels_of[done : done + len(ids)], pa.int32()), pa.array([bucket[i:j].astype("<i4").tobytes() for i, j in cut], pa.binary()), pa.array([value[i:j].astype("<f4").tobytes() for i, j in cut], pa.binary())], schema=schema)
                done += len(ids)

    # At most ``most`` rows of two numbers.
    held = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), "id").select("id", "label", "text").mapInArrow(lean(run), out)
    found = [(r["id"], r["label"], bytes(r["buckets"]), bytes(r["values"])) for r in held.toLocalIterator(prefetchPartitions=True)]
    found.sort(key=lambda r: (zlib.crc32(str(r[0]).encode()), r))
    return [(np.frombuffer(b, "<i4"), np.frombuffer(v, "<f4"), y) for _, y, b, v in found]


def _probabilities(weights: np.ndarray, texts: list[bytes]) -> np.ndarray:
    doc, bucket, value = features(texts)
    return 1 / (1 + np.exp(-(np.bincount(doc, value * weights[bucket], minlength=len(texts)) + float(weights[-1]))))


def score(df: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, score`` for every row: the probability that the label is 1.

    Null and empty texts have no features: their score is that of the model's constant.
    Rows are independent and other columns are not read.
    """
    out = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("score", T.DoubleType())])
    schema = to_arrow_schema(out)
    shared = df.sparkSession.sparkContext.broadcast(weights)  # one float a bucket: 1 MB

    def run(batches):
        w = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                for ids, texts in tokens.chunks(part.column(0).to_pylist(), utf8(part.column(1))):
                    yield pa.RecordBatch.from_arrays([pa.array(ids, schema.field(0).type), pa.array(_probabilities(w, texts))], schema=schema)

    return df.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(run), out)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``id_col, held_out, score, predicted`` for every row of ``docs``, by a model fitted on ``labels``.

    Without any usable label every score is 0.5.  ``held_out`` is null for a null id.
    """
    weights = fit(training_rows(docs, labels, id_col, text_col))
    return score(docs, weights, id_col, text_col).select(id_col, (crc32_of_id(id_col) % 4 == 2).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all columns, whose score is ``threshold`` or more.

    Without any usable label nothing is known against a document, and every row stays.
    """
    rows = training_rows(docs, labels, id_col, text_col)
    if not rows:
        return docs
    shared, at = docs.sparkSession.sparkContext.broadcast(fit(rows)), docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            for start in range(0, b.num_rows, 512):
                part = b.slice(start, 512)
                good = [_probabilities(shared.value, texts) >= threshold for _, texts in tokens.chunks(range(part.num_rows), utf8(part.column(at)))]
                yield part.filter(pa.array(np.concatenate(good)))

    return docs.mapInArrow(lean(run), docs.schema)


def op4_quality(spark, sf_dir) -> DataFrame:
    return classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
