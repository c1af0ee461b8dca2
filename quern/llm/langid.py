"""Language identification by a byte convolutional network, trained and applied in numpy.

Bytes are embedded, filters of several widths slide over a window of fixed length,
each filter's greatest response goes through a rectifier to a softmax layer.  A
text's distribution is the mean over all its windows, weighted by their bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ._shared import crc32_of_id, documents, lean, utf8

#: Bytes in a window, size of a byte's embedding, filter widths, filters of each width.
WINDOW, EMBED, WIDTHS, FILTERS = 256, 8, (2, 3, 4, 5), 12
#: Bounds of the training sample: documents of each language, documents in all (of many languages each then has
#: fewer, but one at least), and windows of a document (its first and others at hashed places).
TRAIN_DOCUMENTS, TRAIN_TOTAL, TRAIN_WINDOWS = 800, 160_000, 2
UNDETERMINED = "und"


@dataclass
class ByteNetwork:
    """Parameters, in float32.  ``w`` has the filters as columns; narrower ones end in zeros."""

    classes: list[str]
    e: np.ndarray
    w: np.ndarray
    b: np.ndarray
    u: np.ndarray
    c: np.ndarray

    @classmethod
    def new(cls, classes: list[str], seed: int = 0) -> ByteNetwork:
        rng, k, f = np.random.default_rng(seed), max(WIDTHS) * EMBED, len(WIDTHS) * FILTERS
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        return cls(classes, draw(256, EMBED, scale=0.5), draw(k, f, scale=0.3) * cls.mask(), np.zeros(f, np.float32), draw(f, len(classes), scale=0.1), np.zeros(len(classes), np.float32))

    @staticmethod
    def mask() -> np.ndarray:
        width = np.repeat(WIDTHS, FILTERS)
        return (np.arange(max(WIDTHS) * EMBED)[:, None] < width[None, :] * EMBED).astype(np.float32)

    def _columns(self, windows: np.ndarray) -> np.ndarray:
        x = self.e[windows].reshape(len(windows), -1)
        n = windows.shape[1] - max(WIDTHS) + 1
        s, t = x.strides
        return np.ascontiguousarray(np.lib.stride_tricks.as_strided(x, (len(x), n, max(WIDTHS) * EMBED), (s, EMBED * t, t)))

    def _softmax(self, h: np.ndarray) -> np.ndarray:
        z = h @ self.u + self.c
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def predict(self, windows: np.ndarray, batch: int = 16) -> np.ndarray:
        """Probabilities of the classes for each window (rows of ``WINDOW`` bytes, zeros after the end)."""
        h = np.empty((len(windows), self.w.shape[1]), np.float32)
        for at in range(0, len(windows), batch):
            x = self._columns(windows[at : at + batch])
            h[at : at + batch] = (x.reshape(-1, x.shape[2]) @ self.w).reshape(len(x), x.shape[1], -1).max(axis=1)
        return self._softmax(np.maximum(h + self.b, 0))

    def gradients(self, windows: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross-entropy, in the order e, w, b, u, c."""
        x = self._columns(windows)
        r = (x.reshape(-1, x.shape[2]) @ self.w).reshape(len(x), x.shape[1], -1)
        at = r.argmax(axis=1)
        h = np.maximum(np.take_along_axis(r, at[:, None, :], axis=1)[:, 0] + self.b, 0)
        d = self._softmax(h)
        d[np.arange(len(d)), labels] -= 1
        d /= len(d)
        dh = (d @ self.u.T) * (h > 0)
        best = x[np.arange(len(x))[:, None], at]
        dw = np.einsum("nf,nfk->kf", dh, best) * self.mask()
        de = np.zeros_like(self.e)
        dx = (dh[:, :, None] * self.w.T[None]).reshape(-1, max(WIDTHS), EMBED)
        hit = windows[np.arange(len(x))[:, None, None], at[:, :, None] + np.arange(max(WIDTHS))]
        np.add.at(de, hit.reshape(-1, max(WIDTHS)), dx)
        return [de, dw, dh.sum(axis=0), h.T @ d, d.sum(axis=0)]


def windows_of(text: bytes) -> np.ndarray:
    """The windows of a whole text; the last is filled with zero bytes."""
    n = max(1, -(-len(text) // WINDOW))
    return np.frombuffer(text.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)


def train(windows: np.ndarray, labels: np.ndarray, classes: list[str], epochs: int = 6, batch: int = 64, rate: float = 0.004, seed: int = 0, least_steps: int = 600) -> ByteNetwork:
    """Adam on shuffled batches, in more epochs where so few windows would make less than ``least_steps``.  A third of the windows of each batch is cut short at random, as short texts are."""
    net, rng = ByteNetwork.new(classes, seed), np.random.default_rng(seed)
    names = ("e", "w", "b", "u", "c")
    m, v, t = [np.zeros_like(getattr(net, n)) for n in names], [np.zeros_like(getattr(net, n)) for n in names], 0
    epochs = max(epochs, -(-least_steps * batch // len(windows)))
    for epoch in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), batch):
            part = order[at : at + batch]
            x = windows[part].copy()
            keep = np.where(rng.random(len(x)) < 1 / 3, rng.integers(12, WINDOW, len(x)), WINDOW)
            x[np.arange(WINDOW)[None, :] >= keep[:, None]] = 0
            t += 1
            step = rate * (1 - epoch / epochs) * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
            for i, (n, g) in enumerate(zip(names, net.gradients(x, labels[part]))):
                m[i] += 0.1 * (g - m[i])
                v[i] += 0.001 * (g * g - v[i])
                setattr(net, n, (getattr(net, n) - step * m[i] / (np.sqrt(v[i]) + 1e-8)).astype(np.float32))
    return net


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = TRAIN_DOCUMENTS, total: int = TRAIN_TOTAL, windows: int = TRAIN_WINDOWS) -> ByteNetwork | None:
    """A network of every language, from at most ``most`` documents of each and about ``total`` in all.

    Only rows with a language and a text take part whose id's crc32 modulo 5 is not 0; of
    each the first window and ``windows - 1`` at hashed places.  None if there is no such row.
    """
    spark = df.sparkSession
    usable = df.where(F.col(lang_col).isNotNull() & (F.octet_length(F.col(text_col).cast("string")) > 0) & (crc32_of_id(id_col) % 5 != 0)).select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"))
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}  # a row a language: the classes
    if not counts:
        return None
    classes = sorted(counts)
    most = max(1, min(most, total // len(classes)))
    # By the counts, a share of each language's ids by hash that holds twice the rows wanted (or
    # 64 more): what is ranked doesn't grow with the table.
    shares = F.broadcast(spark.createDataFrame([(c, min(1.0, (2 * most + 64) / n)) for c, n in counts.items()], "lang string, share double"))
    likely = usable.join(shares, "lang").where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1_000_000_007)) < F.col("share") * 1_000_000_007)
    ranked = likely.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")))
    sample = ranked.where(F.col("rank") <= most).select("id", "lang")
    # At most ``total`` rows, or one a language, of an id and a language.
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text")).where(F.octet_length("text") > 0).join(F.broadcast(sample), "id")
    place = lambda k: f"1 + cast(pmod(xxhash64(id, {4 + k}), greatest(1, octet_length(text) - {WINDOW})) as int)" if k else "1"
    rows = texts.select("id", "lang", F.array(*[F.expr(f"substring(text, {place(k)}, {WINDOW})") for k in range(windows)]).alias("windows")).toLocalIterator(prefetchPartitions=True)
    held = sorted((str(r["id"]), r["lang"], *map(bytes, r["windows"])) for r in rows)
    if not held:
        return None
    number = {c: i for i, c in enumerate(classes)}
    return train(np.concatenate([windows_of(w) for r in held for w in r[2:]]), np.array([number[r[1]] for r in held for _ in r[2:]]), classes)


def predict(df: DataFrame, net: ByteNetwork | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, lang_pred, score`` for every row, from all windows of its text.

    Null texts and texts without a letter are ``und`` with score 0, and so is every text if
    there is no network.  Rows are independent; other columns are not read.  A task
    holds one Arrow batch and some windows of it.
    """
    out = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    schema = to_arrow_schema(out)
    shared = df.sparkSession.sparkContext.broadcast(net)  # some 20 KB, and 200 bytes a language

    def distributions(texts: list[bytes]) -> np.ndarray:
        """Windows of many texts go through the network together, about 2 MB at a time."""
        total = np.zeros((len(texts), len(shared.value.classes)))
        held, of, size = [], [], 0

        def flush():
            x = np.concatenate(held)
            p = shared.value.predict(x)
            weight = np.maximum(1, (x != 0).sum(axis=1))
            np.add.at(total, np.array(of), p * weight[:, None])

        for i, t in enumerate(texts):
            for at in range(0, max(1, len(t)), WINDOW << 13):
                x = windows_of(t[at : at + (WINDOW << 13)])
                held.append(x)
                of.extend([i] * len(x))
                size += x.size
                if size > 2 << 20:
                    flush()
                    held, of, size = [], [], 0
        if held:
            flush()
        return total / total.sum(axis=1, keepdims=True)

    def run(batches):
        classes = np.array([*(shared.value.classes if shared.value else ()), UNDETERMINED], object)
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                ids, texts, lettered = b.slice(at, 1024).columns
                data, sure = utf8(texts), np.array(lettered.to_pylist(), bool)
                best, score = np.full(len(ids), len(classes) - 1), np.zeros(len(ids))
                some = np.flatnonzero(sure)
                if shared.value and len(some):
                    p = distributions([data[i] for i in some.tolist()])
                    best[some], score[some] = p.argmax(axis=1), p.max(axis=1)
                yield pa.RecordBatch.from_arrays([ids.cast(schema.field(0).type), pa.array(classes[best], pa.string()), pa.array(score)], schema=schema)

    text = F.col(text_col).cast("string")
    return df.select(F.col(id_col), text.alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("lettered")).mapInArrow(lean(run), out)


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``id_col, held_out, lang_pred, score`` for every row, by a network fitted on the same table."""
    return predict(df, fit(df, id_col, text_col, lang_col), id_col, text_col).select(id_col, (crc32_of_id(id_col) % 5 == 0).alias("held_out"), "lang_pred", "score")


def op2_language_id(spark, sf_dir) -> DataFrame:
    return identify(documents(spark, sf_dir))
