"""Language identification by prediction by partial matching over bytes, under frozen statistics."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytegrams import CHUNK, Index, Texts, chunks, counted
from .common import batched, unused

#: Bytes of context, and the largest number of documents of a language that its statistics are learned from.
ORDER, SAMPLE = 3, 400
#: The score weighs a text's mean code length as if it had so many bytes, however long it is.
EVIDENCE = 8
UNKNOWN = "und"
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


class LanguageModel:
    """Code lengths of byte n-grams in every language.

    For n = 1..order + 1 a table of the n-grams seen in any language holds, for each language, the
    bits of the last byte after the others, and another, of their contexts, the bits of an escape. Escapes follow method C: in a context with n bytes and t distinct ones a byte
    seen c times has probability c / (n + t) and an escape t / (n + t); it leads to the context
    without its oldest byte, and from the empty one to 1 / 256. A context new to a language is free.
    """

    def __init__(self, samples: dict[str, list[bytes]], order: int = ORDER):
        samples = {name: texts for name, texts in samples.items() if any(texts)}
        self.languages, self.order = sorted(samples), order
        grams = {name: self._grams(texts) for name, texts in samples.items()}
        size = len(self.languages)
        below, below_cost = None, np.full((1, size), 8.0)
        costs, tables = [], []
        for n in range(1, order + 2):
            shift = np.uint64(2 ** (8 * n) - 1)
            each = [counted(keys & shift, weights) for keys, weights in (grams[name] for name in self.languages)]
            keys = np.unique(np.concatenate([k for k, _ in each])) if each else np.zeros(0, np.uint64)
            counts = np.zeros((len(keys), size))
            for i, (k, c) in enumerate(each):
                counts[np.searchsorted(keys, k), i] = c
            context, place = np.unique(keys >> np.uint64(8), return_inverse=True)
            total, distinct = np.zeros((len(context), size)), np.zeros((len(context), size))
            np.add.at(total, place, counts)
            np.add.at(distinct, place, (counts > 0).astype(float))
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, np.log2((total + distinct) / distinct), 0.0)
                own = np.log2((total + distinct)[place] / counts)
            lower = np.broadcast_to(below_cost, (len(keys), size)) if below is None else below_cost[np.searchsorted(below, keys & np.uint64(2 ** (8 * (n - 1)) - 1))]
            cost = np.where(counts > 0, own, escape[place] + lower)
            tables.append((keys, context, escape))
            costs.append(cost)
            below, below_cost = keys, cost
        self.levels = [(Index(keys), cost.astype(np.float32)) for (keys, _, _), cost in zip(tables, costs, strict=True)]
        self.contexts = [(Index(context), escape.astype(np.float32)) for _, context, escape in tables]
        self.none = (tables[0][2][0] if len(tables[0][2]) else np.zeros(size)).astype(np.float32) + np.float32(8.0)

    def _grams(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        parts = []
        for i, j in chunks(texts):
            held = Texts(texts[i:j], self.order)
            parts.append(counted(held.grams(self.order + 1)[held.mask()]))
        if not parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return counted(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))

    def bits(self, texts: list[bytes], piece: int = CHUNK) -> np.ndarray:
        """Code length of each text in each language; a text longer than piece is walked in pieces, each after the bytes before it."""
        if len(texts) == 1 and len(texts[0]) > piece > self.order:
            text = texts[0]
            out = self._bits([text[:piece]])
            for at in range(piece, len(text), piece):
                before = text[at - self.order : at]
                out = out + self._bits([text[at - self.order : at + piece]]) - self._bits([before])
            return out
        return self._bits(texts)

    def _bits(self, texts: list[bytes]) -> np.ndarray:
        held = Texts(texts, self.order)
        keys = held.grams(self.order + 1)
        index, cost = self.levels[self.order]
        found = index.find(keys)
        each = cost[found]
        rest = np.flatnonzero(found < 0)
        if len(rest):
            each[rest] = self._lower(keys[rest], self.order)
        return held.sums(each)

    def _lower(self, keys: np.ndarray, n: int) -> np.ndarray:
        """Bits of n-grams after an escape from their context of n bytes; keys hold n + 1 bytes."""
        if not n:
            return np.broadcast_to(self.none, (len(keys), len(self.languages)))
        (index, cost), (contexts, escape) = self.levels[n - 1], self.contexts[n]
        context = contexts.find((keys >> np.uint64(8)) & np.uint64(2 ** (8 * n) - 1))
        out = np.where((context >= 0)[:, None], escape[context], np.float32(0))
        tail = keys & np.uint64(2 ** (8 * n) - 1)
        found = index.find(tail)
        hit = found >= 0
        out[hit] += cost[found[hit]]
        if not hit.all():
            out[~hit] += self._lower(tail[~hit], n - 1)
        return out

    def predict(self, texts: list[bytes]) -> list[tuple[str, float]]:
        """Language and its share of the posterior that EVIDENCE bytes of the text's mean code lengths give under equal priors; no letter: `und`, 0."""
        if not self.languages:
            return [(UNKNOWN, 0.0)] * len(texts)
        out: list[tuple[str, float]] = []
        for i, j in chunks(texts):
            bits = self.bits(texts[i:j])
            for text, own in zip(texts[i:j], bits, strict=True):
                letters = _ASCII_LETTER.search(text) or (not text.isascii() and any(map(str.isalpha, text.decode("utf-8", "replace"))))
                if not letters:
                    out.append((UNKNOWN, 0.0))
                else:
                    best = int(own.argmin())
                    gap = (own[best] - own) * (min(EVIDENCE, len(text)) / len(text))
                    out.append((self.languages[best], float(1 / np.exp2(np.maximum(gap, -1000)).sum())))
        return out


def hash_share(column: Column) -> Column:
    """A number in [0, 1) that the id decides."""
    return F.pmod(F.xxhash64(F.lit(29), column), F.lit(1 << 30)) / float(1 << 30)


def learned(docs: DataFrame, usable: Column, sample: int = SAMPLE, order: int = ORDER) -> LanguageModel:
    """Learn from at most `sample` documents of each language (those of smallest id hash) that are usable, whole texts.

    A first pass counts each language's documents; a second brings those below the hash at which
    `sample` are expected, with a margin, to the driver. The bound holds for each language.
    """
    rows = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    margin = sample + 5 * math.sqrt(sample) + 5
    limit = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, margin / n)]) if counts else F.create_map(F.lit(""), F.lit(0.0))
    chosen = rows.select("lang", "text", hash_share(F.col("doc_id")).alias("_h"), F.xxhash64("text").alias("_t")).where(F.col("_h") < F.element_at(limit, F.col("lang")))
    samples: dict[str, list[bytes]] = {lang: [] for lang in counts}
    for row in sorted(chosen.collect(), key=lambda r: (r["_h"], r["_t"])):
        if len(samples[row["lang"]]) < sample:
            samples[row["lang"]].append(row["text"].encode())
    return LanguageModel(samples, order)


def identified(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """docs with lang_pred and lang_score (columns of those names are replaced); one row for each row, whole texts.

    Null or empty texts and texts without a letter: `und` with score 0.
    """
    spark = batched(docs.sparkSession)
    names = [c for c in docs.columns if c not in ("lang_pred", "lang_score")]
    shared = spark.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shared.value.predict([x or b"" for x in batch.column(len(names)).cast(pa.binary()).to_pylist()])
            arrays = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], [*names, "lang_pred", "lang_score"])

    schema = docs.select(*names).withColumns({"lang_pred": F.lit(""), "lang_score": F.lit(0.0)}).schema
    return docs.select(*names, F.col("text").alias(unused(docs, "_text"))).mapInArrow(run, schema)
