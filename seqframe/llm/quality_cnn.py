"""Quality classifier: a byte-level convolutional network in numpy, over the whole text.

A text is cut into chunks of CHUNK bytes that overlap by WIDTH - STEP, so that each window of WIDTH bytes (one each STEP
bytes) lies in a chunk and every byte lies in a window. FILTERS learned filters go over the windows; each has a weight for
each byte value at each place, so a filter's value is a sum of WIDTH table entries. In each chunk a filter keeps its
maximum (rectified); over the document, the largest and the mean of the chunks' maxima are combined by a logistic unit
into one probability.

Training is on the driver, by Adam on the log loss, on a bounded sample: at most SAMPLE rows of each label, those with the
least hash of doc_id, up to SAMPLE_BYTES of text, and of a long text TRAIN_CHUNKS chunks chosen at random in each pass. Labels are taken from rows with
crc32(doc_id as text) mod 5 <> 0 only; lang, source and doc_id are no inputs. Classes are weighted back to their share
among all labelled rows, so the output is a probability. Scoring reads every byte of every text.

Defined cases: a null or empty text is one chunk of zeros and gets the model's score for that. Without labelled rows, or
with one label only, the score is the share of label 1 (0.5 without any). Rows with a null doc_id are not held out, and
are not trained on. Repeated rows are scored alike; an empty table gives an empty result. Other columns are left out
unless in `keep`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import column, slices, trimmed

WIDTH, STEP, WINDOWS, FILTERS = 8, 4, 64, 16
CHUNK = WINDOWS * STEP + WIDTH - STEP
SAMPLE, SAMPLE_BYTES = 1500, 64 << 20  # of each label, and of all texts together: what a net is learned from
TRAIN_CHUNKS, BATCH, RATE = 24, 64, 0.01  # chunks of a longer text that are drawn anew in each pass
PASSES = 8, 60  # least and most; so many that about SHOWN texts are shown
SHOWN = 30_000
FOLDS, CUTOFF = 5, 0.3


def held_out(doc_id) -> object:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunk matrix (zeros after the text's end), windows in use in each, first chunk of each text (n + 1 entries)."""
    sizes = np.diff(offsets)
    step = WINDOWS * STEP
    windows = np.maximum(1, -(-(sizes - WIDTH + STEP) // STEP))
    count = -(-windows // WINDOWS)
    first = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(first[-1]) - np.repeat(first[:-1], count)
    begin = np.repeat(offsets[:-1], count) + at * step
    left = np.repeat(offsets[1:], count) - begin
    padded = np.concatenate([data, np.zeros(CHUNK, np.uint8)])
    made = np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[np.minimum(begin, len(data))]
    made = np.where(np.arange(CHUNK) < left[:, None], made, 0)
    return made, np.minimum(np.repeat(windows, count) - at * WINDOWS, WINDOWS), first


class QualityNet:
    def __init__(self, tables: np.ndarray, bias: np.ndarray, weights: np.ndarray, offset: float):
        self.tables, self.bias, self.weights, self.offset = tables, bias, weights, offset  # WIDTH x 256 x FILTERS; FILTERS; 2 FILTERS

    @classmethod
    def constant(cls, share: float) -> QualityNet:
        share = min(max(share, 1e-6), 1 - 1e-6)
        return cls(np.zeros((WIDTH, 256, FILTERS), np.float32), np.zeros(FILTERS, np.float32), np.zeros(2 * FILTERS, np.float32), float(np.log(share / (1 - share))))

    def convolve(self, made: np.ndarray, used: np.ndarray) -> np.ndarray:
        """chunks x WINDOWS x FILTERS; windows not in use are very small."""
        out = self.tables[0][made[:, 0 : WINDOWS * STEP : STEP]]
        for j in range(1, WIDTH):
            out += self.tables[j][made[:, j : j + WINDOWS * STEP : STEP]]
        out[np.arange(WINDOWS) >= used[:, None]] = -1e9
        return out

    def pool(self, most: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        top = np.maximum.reduceat(most, first[:-1], axis=0)
        mean = np.add.reduceat(most, first[:-1], axis=0) / np.diff(first)[:, None]
        return top, mean

    def score(self, data: np.ndarray, offsets: np.ndarray, most: int = 2048) -> np.ndarray:
        made, used, first = chunks(data, offsets)
        peaks = [self.convolve(made[i : i + most], used[i : i + most]).max(axis=1) for i in range(0, len(made), most)]
        top, mean = self.pool(np.maximum(np.concatenate(peaks) + self.bias, 0), first)
        return 1 / (1 + np.exp(-(np.concatenate([top, mean], axis=1).astype(np.float64) @ self.weights + self.offset)))

    @classmethod
    def train(cls, texts: list[bytes], labels: np.ndarray, share: float, seed: int = 7, train_chunks: int = TRAIN_CHUNKS) -> QualityNet:
        if not len(texts) or labels.min() == labels.max():
            return cls.constant(share)
        rng, passes = np.random.default_rng(seed), int(np.clip(SHOWN // len(texts), *PASSES))
        net = cls(rng.normal(0, 0.15, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.3, 2 * FILTERS).astype(np.float32), float(np.log(share / (1 - share))))
        weight = np.where(labels == 1, share / labels.mean(), (1 - share) / (1 - labels.mean()))
        parts = [chunks(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[:2] for t in texts]
        state = [net.tables, net.bias, net.weights, np.array([net.offset])]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in state]
        turn = 0
        for epoch in range(passes):
            rate = RATE * (1 - epoch / passes) + RATE / 20
            order = rng.permutation(len(texts))
            for at in range(0, len(order), BATCH):
                rows = order[at : at + BATCH]
                picked = [np.sort(rng.choice(len(parts[i][0]), train_chunks, replace=False)) if len(parts[i][0]) > train_chunks else np.arange(len(parts[i][0])) for i in rows]
                made, used = (np.concatenate([parts[i][k][p] for i, p in zip(rows, picked, strict=True)]) for k in (0, 1))
                first = np.concatenate([[0], np.cumsum([len(p) for p in picked])])
                values = net.convolve(made, used)
                best = values.argmax(axis=1)
                most = np.maximum(np.take_along_axis(values, best[:, None], 1)[:, 0] + net.bias, 0)
                top, mean = net.pool(most, first)
                both = np.concatenate([top, mean], axis=1)
                p = 1 / (1 + np.exp(-(both @ net.weights + net.offset)))
                d = ((p - labels[rows]) * weight[rows] / len(rows)).astype(np.float32)
                d_both = d[:, None] * net.weights
                own = np.repeat(np.arange(len(rows)), np.diff(first))
                d_most = d_both[own, FILTERS:] / np.diff(first)[own, None] + d_both[own, :FILTERS] * (most == top[own])
                d_most *= most > 0
                grads = [np.zeros_like(net.tables), d_most.sum(axis=0), both.T @ d, np.array([d.sum()])]
                c, f = np.nonzero(d_most)
                start = best[c, f] * STEP
                for j in range(WIDTH):
                    cell = made[c, start + j].astype(np.int64) * FILTERS + f
                    grads[0][j] = np.bincount(cell, d_most[c, f], 256 * FILTERS).reshape(256, FILTERS)
                turn += 1
                for param, grad, (m, v) in zip(state, grads, moments, strict=True):
                    m += 0.1 * (grad - m)
                    v += 0.001 * (grad * grad - v)
                    param -= rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.999**turn)) + 1e-8)
                net.offset = float(state[3][0])
        return net


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, **options) -> QualityNet:
    """A net for label_col (0 or 1), from a sample of the labelled rows that are not held out.

    The sample, in the order of a hash of the ids, ends at `sample` rows of each label, and with the text that brings it to
    `sample_bytes`: the driver holds no more.
    """
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label")).filter(F.col("__label").isin(0, 1) & F.col("__id").isNotNull() & ~held_out(F.col("__id")))
    shares = dict(known.groupBy("__label").count().collect())
    total = sum(shares.values())
    if len(shares) < 2:
        return QualityNet.constant(shares.get(1, 0) / total if total else 0.5)
    order = F.xxhash64("__id")
    few = known.filter("__label = 0").orderBy(order, "__id").limit(sample).union(known.filter("__label = 1").orderBy(order, "__id").limit(sample))
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text")).join(F.broadcast(few), "__id")
    turn = (F.xxhash64("__id"), F.col("__id"), F.xxhash64("__text"))
    size = F.octet_length("__text").cast("long")
    before = F.sum(size).over(Window.orderBy(*turn).rowsBetween(Window.unboundedPreceding, 0)) - size  # over the rows of the sample only
    rows = rows.orderBy(*turn).limit(2 * sample).withColumn("__before", before).filter(F.col("__before") < sample_bytes).collect()
    return QualityNet.train([r["__text"].encode() for r in rows], np.array([r["__label"] for r in rows]), shares[1] / total, **options)


def score(docs: DataFrame, net: QualityNet, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), cutoff: float = CUTOFF) -> DataFrame:
    """id_col, the columns in `keep`, held_out, score, predicted: a row for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # WIDTH x 256 x FILTERS numbers
    source = docs.select(id_col, *keep, held_out(F.col(id_col)).alias("__out"), F.col(text_col).cast("string").alias("__text"))
    out = T.StructType([*source.schema.fields[:-2], T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType())])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches, "__text"):
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in (id_col, *keep, "__out")), pa.array(shared.value.score(data, offsets))], schema=arrow)

    return source.mapInArrow(trimmed(run), out).withColumn("predicted", (F.col("score") >= cutoff).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    return score(docs, fit(docs, labels), **options)


def keep_good(docs: DataFrame, labels: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """The rows of docs that score at least the cutoff."""
    names = docs.columns
    others = tuple(c for c in names if c != "doc_id")
    hidden = docs.select("doc_id", F.col("text"), F.struct(*others).alias("__row"))
    scored = score(hidden, fit(docs, labels), keep=("__row",), cutoff=cutoff)
    return scored.filter("predicted = 1").select("doc_id", "__row.*").select(*names)
