"""Quality score by a byte-level convolutional network in numpy, max-pooled over the whole document."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytegrams import CHUNK, Texts, chunks
from .common import batched, unused

#: Bytes that a filter sees, bytes between two places of a filter, numbers of filters and of embedding dimensions.
WIDTH, STRIDE, FILTERS, DIMENSIONS = 8, 4, 16, 6
#: Largest number of labelled documents of each class to learn from; steps of learning and documents in each.
SAMPLE, STEPS, BATCH, RATE = 1200, 600, 64, 0.01


class ConvolutionalScorer:
    """Bytes are embedded, filters of WIDTH bytes run over the text at every STRIDE bytes, each filter's
    largest response over all places is kept, and a logistic unit combines those.

    Chunks overlap by WIDTH - STRIDE bytes and the last is padded, so every byte of a text counts. As
    a filter is linear in its bytes it is applied as WIDTH table look-ups.
    """

    def __init__(self, seed: int = 7):
        draw = np.random.default_rng(seed)
        self.parts = {
            "embedding": draw.normal(0, 0.5, (256, DIMENSIONS)),
            "filters": draw.normal(0, 1 / math.sqrt(WIDTH * DIMENSIONS), (WIDTH, DIMENSIONS, FILTERS)),
            "bias": np.zeros(FILTERS),
            "out": draw.normal(0, 0.3, FILTERS),
            "out_bias": np.zeros(1),
        }
        self._tables: np.ndarray | None = None

    def _held(self, texts: list[bytes]) -> tuple[Texts, np.ndarray, np.ndarray]:
        """The texts and each one's first and last place, a place being STRIDE bytes of the buffer."""
        held = Texts(texts, WIDTH, 0, STRIDE)
        first = held.start // STRIDE
        return held, first, np.maximum(-(-held.end // STRIDE), first + 1)

    def _responses(self, held: Texts, tables: np.ndarray) -> np.ndarray:
        places = (len(held.data) - WIDTH) // STRIDE + 1
        out = np.zeros((places, FILTERS), np.float32)
        for k in range(WIDTH):
            out += tables[k][held.data[k : k + places * STRIDE : STRIDE]]
        return out

    def tables(self) -> np.ndarray:
        return np.einsum("bd,kdf->kbf", self.parts["embedding"], self.parts["filters"]).astype(np.float32)

    def _pooled(self, best: np.ndarray) -> np.ndarray:
        return np.tanh(best + self.parts["bias"])

    def fit(self, texts: list[bytes], good: list[int]) -> ConvolutionalScorer:
        """Adam on the logistic loss; max-pooling sends each filter's gradient to its best place alone."""
        target, draw = np.asarray(good, float), np.random.default_rng(11)
        first, second, step = {k: np.zeros_like(v) for k, v in self.parts.items()}, {k: np.zeros_like(v) for k, v in self.parts.items()}, 0
        share = target.mean() if len(target) else 0.5
        self.parts["out_bias"][:] = math.log((share + 1e-3) / (1 - share + 1e-3))
        while step < STEPS and len(texts):
            order = draw.permutation(len(texts))
            for at in range(0, len(order), BATCH):
                rows = order[at : at + BATCH]
                held, begin, end = self._held([texts[i] for i in rows])
                response = self._responses(held, self.tables())
                place = np.stack([b + response[b:e].argmax(0) for b, e in zip(begin, end, strict=True)])
                hidden = self._pooled(np.take_along_axis(response, place, 0))
                score = 1 / (1 + np.exp(-(hidden @ self.parts["out"] + self.parts["out_bias"])))
                error = (score - target[rows]) / len(rows)
                inner = error[:, None] * self.parts["out"] * (1 - hidden**2)
                window = held.data[place[:, :, None] * STRIDE + np.arange(WIDTH)]  # text, filter, byte
                seen = self.parts["embedding"][window]
                grads = {
                    "out": hidden.T @ error + 1e-4 * self.parts["out"],
                    "out_bias": np.array([error.sum()]),
                    "bias": inner.sum(0),
                    "filters": np.einsum("tf,tfkd->kdf", inner, seen),
                    "embedding": np.zeros_like(self.parts["embedding"]),
                }
                np.add.at(grads["embedding"], window, np.einsum("tf,kdf->tfkd", inner, self.parts["filters"]))
                step += 1
                rate = RATE * max(1 - step / STEPS, 0.05)
                for name, grad in grads.items():
                    first[name] += 0.1 * (grad - first[name])
                    second[name] += 0.001 * (grad**2 - second[name])
                    self.parts[name] -= rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
        return self

    def _walked(self, text: bytes, piece: int = CHUNK) -> np.ndarray:
        """Largest response of each filter over a long text, in overlapping chunks of whole strides."""
        best, places = None, piece // STRIDE
        for at in range(0, len(text), places * STRIDE):
            held, begin, end = self._held([text[at : at + places * STRIDE + WIDTH - STRIDE]])
            own = self._responses(held, self._tables)[begin[0] : min(end[0], begin[0] + places)].max(0, keepdims=True)
            best = own if best is None else np.maximum(best, own)
        return best

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Probability of good quality; an empty text shows the filters padding alone."""
        if self._tables is None:
            self._tables = self.tables()
        out = np.zeros(len(texts))
        for i, j in chunks(texts):
            if j == i + 1 and len(texts[i]) > CHUNK:
                best = self._walked(texts[i])
            else:
                held, begin, end = self._held(texts[i:j])
                response = self._responses(held, self._tables)
                cuts = np.stack([begin, end], 1).ravel()
                best = np.maximum.reduceat(np.concatenate([response, response[-1:]]), np.minimum(cuts, len(response)))[::2]
            out[i:j] = 1 / (1 + np.exp(-(self._pooled(best) @ self.parts["out"] + self.parts["out_bias"])))
        return out


def learned(docs: DataFrame, labels: DataFrame, usable: Column, sample: int = SAMPLE) -> ConvolutionalScorer:
    """Fit on at most `sample` documents of each class, those of smallest id hash, whole texts.

    usable: which rows of docs may be learned from, by id. Labels that repeat an id count once (the
    larger); null labels and texts are left out. The ids of the sample, bounded, choose the texts.
    """
    known = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("quality")).where(usable & F.col("doc_id").isNotNull())
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    margin = sample + 5 * math.sqrt(sample) + 5
    share = F.pmod(F.xxhash64(F.lit(31), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    rows = known.withColumn("_h", share).where(F.col("_h") < F.when(F.col("quality") == 1, margin / counts.get(1, 1)).otherwise(margin / counts.get(0, 1))).collect()
    ids: dict = {}
    for row in sorted(rows, key=lambda r: (r["_h"], r["doc_id"])):
        if sum(x == row["quality"] for x in ids.values()) < sample:
            ids[row["doc_id"]] = row["quality"]
    if not ids:
        return ConvolutionalScorer()
    chosen = F.broadcast(docs.sparkSession.createDataFrame(list(ids.items()), "_id long, _quality int"))
    texts = docs.where(F.col("text").isNotNull()).join(chosen, F.col("doc_id") == F.col("_id")).select("doc_id", "text", "_quality").collect()
    texts.sort(key=lambda r: (r["doc_id"], r["text"]))
    return ConvolutionalScorer().fit([r["text"].encode() for r in texts], [r["_quality"] for r in texts])


def scored(docs: DataFrame, model: ConvolutionalScorer) -> DataFrame:
    """docs with quality_score (a column of that name is replaced); one row for each row, whole texts, by the text alone. Null: empty."""
    names = [c for c in docs.columns if c != "quality_score"]
    shared = batched(docs.sparkSession).sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shared.value.score([x or b"" for x in batch.column(len(names)).cast(pa.binary()).to_pylist()])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(found, pa.float64())], [*names, "quality_score"])

    return docs.select(*names, F.col("text").alias(unused(docs, "_text"))).mapInArrow(run, docs.select(*names).withColumn("quality_score", F.lit(0.0)).schema)
