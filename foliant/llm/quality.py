"""Operator 1: a quality classifier over random-indexing word vectors.

Words are runs of letters and digits and runs of other signs, case kept, each with a second word for its
shape (kind, case, length, whether it repeats the word before). Words fall into 16,384 buckets by hash,
shapes into 64 more; every bucket has a sparse random index vector. A bucket's word vector is the sum of
the index vectors around its occurrences in the whole corpus. A document is the mean of its words'
vectors beside the mean of its shapes'. A two-layer numpy network learns the labels from a bounded sample
of labelled rows, and one temperature, fitted on rows held back from it, calibrates its probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.arrays import mix, slices, text_bytes, words
from foliant.llm.frames import bounded, cut

BUCKETS, SHAPES, SIZE, REACH = 1 << 14, 64, 32, 2
ROWS = 256
_KIND = np.full(256, 2, dtype=np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_CODE = np.where(_KIND > 0, np.arange(256) % 255 + 1, 0).astype(np.uint8)
_UPPER = np.zeros(256, dtype=bool)
_UPPER[0x41:0x5B] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[0x30:0x3A] = True


def index_vectors(seed: int = 11) -> np.ndarray:
    """A sparse random vector of 1 and -1 for each bucket; the last row is for no word."""
    rng = np.random.default_rng(seed)
    out = np.zeros((BUCKETS + SHAPES + 1, SIZE), dtype=np.float32)
    for k in range(4):
        out[np.arange(BUCKETS + SHAPES), rng.integers(0, SIZE, BUCKETS + SHAPES)] += np.float32(1 if k % 2 else -1)
    return out


def _parsed(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For ranges of rows i..j: (i, j, row, word bucket, shape bucket) of the words."""
    data, offsets = text_bytes(column)
    for i, j in slices(offsets):
        part = data[offsets[i] : offsets[j]]
        starts, ends, row, value = words(part, offsets[i : j + 1] - offsets[i], _CODE, kinds=_KIND)
        if not len(row):
            yield i, j, row, row, row
            continue
        kind = _KIND[part[starts]] - 1
        high = _UPPER[part[starts]].astype(np.int64) + _UPPER[part[ends - 1]]
        digit = _DIGIT[part[starts]]
        again = np.concatenate([[False], (value[1:] == value[:-1]) & (row[1:] == row[:-1])])
        length = np.minimum((ends - starts - 1) // 3, 3)
        shape = np.where(kind == 1, 48 + length, np.where(digit, 52 + length, high * 4 + length)) + np.where(again & (kind == 0) & ~digit, 16, 0)
        yield i, j, row, (mix(value) % np.uint64(BUCKETS)).astype(np.int64), BUCKETS + shape


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """This task's sums of neighbours' index vectors, in packed rows of 256 buckets."""
    index = index_vectors()
    total, any_words = np.zeros((BUCKETS + SHAPES, SIZE)), False
    for batch in batches:
        for _, _, row, word, shape in _parsed(batch.column(0)):
            if not len(row):
                continue
            any_words = True
            for k in range(SIZE):
                own = index[:, k]
                here = own[word] + own[shape]
                near = own[shape] + 0
                for lag in range(1, REACH + 1):
                    same = row[lag:] == row[:-lag]
                    near[lag:] += np.where(same, here[:-lag], 0)
                    near[:-lag] += np.where(same, here[lag:], 0)
                total[:, k] += np.bincount(word, weights=near, minlength=BUCKETS + SHAPES)
                total[:, k] += np.bincount(shape, weights=near, minlength=BUCKETS + SHAPES)
    if any_words:
        parts = np.array_split(total, range(ROWS, BUCKETS + SHAPES, ROWS))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([p.astype(np.float32).tobytes() for p in parts], pa.binary())], names=["part", "sums"])


def _added(key, group):
    total = sum(np.frombuffer(x.as_py(), dtype=np.float32).astype(np.float64) for x in group.column("sums"))
    return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})


def word_vectors(docs: DataFrame, text_column: str = "text") -> np.ndarray:
    """Unit vectors of all buckets, learnt from every text. Their number doesn't grow with the corpus."""
    bounded(docs.sparkSession)
    sums = docs.select(F.col(text_column).cast("string")).mapInArrow(_contexts, "part int, sums binary").groupBy("part").applyInArrow(_added, "part int, sums binary")
    out = np.zeros((BUCKETS + SHAPES, SIZE))
    for part, packed in sums.collect():
        own = np.frombuffer(packed, dtype=np.float64).reshape(-1, SIZE)
        out[part * ROWS : part * ROWS + len(own)] = own
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(norm > 0, norm, 1)).astype(np.float32)


def _pooled(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = np.ascontiguousarray(shared.value.T)
        for batch in batches:
            for i, j, row, word, shape in _parsed(batch.column(1)):
                n = np.maximum(np.bincount(row, minlength=j - i), 1)
                mean = lambda at, k: np.bincount(row, weights=vectors[k][at], minlength=j - i) / n
                pooled = np.stack([mean(at, k) for at in (word, shape) for k in range(SIZE)], axis=1).astype(np.float32)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, pooled.size + 1, 2 * SIZE), pa.int32()), pa.array(pooled.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), flat], names=["id", "pooled"])

    return run


def pooled(docs: DataFrame, vectors: np.ndarray, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, pooled) for every row; a text without words pools to zeros."""
    shared = docs.sparkSession.sparkContext.broadcast(vectors)
    return docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string")).mapInArrow(_pooled(shared), "id long, pooled array<float>")


class Network:
    """Two layers, learnt by Adam; the output's temperature is fitted afterwards."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, seed: int = 5):
        self.temperature, self.rate = 1.0, None
        if len(y) < 4 or y.min() == y.max():
            self.rate = (y.sum() + 1) / (len(y) + 2)
            return
        rng = np.random.default_rng(seed)
        back = rng.random(len(y)) < 0.2
        if len(np.unique(y[back])) < 2 or len(np.unique(y[~back])) < 2:
            back[:] = False
        self.centre, self.scale = x[~back].mean(axis=0), x[~back].std(axis=0) + 1e-4
        z, t = (x[~back] - self.centre) / self.scale, y[~back]
        p = [rng.standard_normal((x.shape[1], hidden)) / np.sqrt(x.shape[1]), np.zeros(hidden), rng.standard_normal(hidden) / np.sqrt(hidden), np.zeros(1)]
        m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        for _ in range(epochs):
            order = rng.permutation(len(t))
            for at in range(0, len(t), 256):
                own, step = order[at : at + 256], step + 1
                h = np.tanh(z[own] @ p[0] + p[1])
                d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -40, 40))) - t[own]) / len(own)
                dh = d[:, None] * p[2] * (1 - h * h)
                for k, g in enumerate((z[own].T @ dh + 1e-4 * p[0], dh.sum(axis=0), h.T @ d + 1e-4 * p[2], d.sum(keepdims=True))):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    p[k] = p[k] - 0.005 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        self.p = p
        held, truth = (self.logit(x[back]), y[back]) if back.any() else (self.logit(x), y)
        grid = np.geomspace(0.25, 8, 121)
        loss = [np.mean(np.logaddexp(0, np.where(truth > 0, -1, 1) * held / k)) for k in grid]
        self.temperature = float(grid[int(np.argmin(loss))])

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.centre) / self.scale @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def probability(self, x: np.ndarray) -> np.ndarray:
        if self.rate is not None:
            return np.full(len(x), self.rate)
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -500, 500)))


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.probability(x))], names=["id", "score"])

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, held_out: Column, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", sample: int = 20_000) -> DataFrame:
    """(id, held_out, score, predicted) for every row of docs.

    held_out, an expression over the id, keeps rows from learning; null counts as held out. The network
    learns from about `sample` labelled rows at most, chosen by a hash of the id; word vectors come from
    all texts. Labels other than 0 and 1 are ignored, as is an id with both. A null or wordless text gets
    the score of an empty one; repeated rows get equal scores, and of texts that share a labelled id the one
    whose vector is least is learnt from. A score of exactly 0.5 predicts 1. Without labels of both kinds, the score is
    the smoothed share of label 1.
    """
    spark = docs.sparkSession
    bounded(spark)
    table = cut(pooled(docs, word_vectors(docs, text_column), id_column, text_column))
    known = labels.select(F.col(id_column).cast("long").alias(id_column), F.col(label_column).cast("int").alias("y")).where(f"{id_column} is not null and y in (0, 1)")
    known = known.where(~F.coalesce(held_out, F.lit(True))).groupBy(F.col(id_column).alias("id")).agg(F.min("y").alias("y"), F.max("y").alias("top")).where("y = top").select("id", "y")
    n = known.count()
    part = int(min(1.0, sample / max(n, 1)) * (1 << 20))
    rows = table.join(known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < part), "id").groupBy("id").agg(F.min("pooled").alias("pooled"), F.min("y").alias("y")).toPandas().sort_values("id")
    x = np.array(rows["pooled"].tolist(), dtype=np.float64).reshape(len(rows), 2 * SIZE)
    shared = spark.sparkContext.broadcast(Network(x, rows["y"].to_numpy(dtype=np.float64)))
    out = table.mapInArrow(_scored(shared), "id long, score double").withColumnRenamed("id", id_column)
    return out.select(id_column, F.coalesce(held_out, F.lit(True)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
