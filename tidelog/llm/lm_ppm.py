"""Language-model scoring: byte contexts with escapes and symbol exclusion, and a word unigram base beside it."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytegrams import Index, Texts, chunks, counted, mix
from .common import batched, reserved, stored

#: Bytes of context.
ORDER = 5
#: Most frequent words whose counts go to every task, and most frequent n-grams whose costs do; the others' are joined.
HEAD, GRAM_HEAD = 1 << 17, 1 << 20
#: Up to so many bytes a level of the trie (at most 256 ** bytes rows) is broadcast to the joins.
SMALL = 2
#: Key of the end of a text among word hashes.
END = int(mix(np.array([2**63 + 11], np.uint64)).view(np.int64)[0])
#: Keys that a task gathers before it folds them.
FOLD = 1 << 22
_WORDS, _GRAMS = 0, 1


def _mask(n: int) -> np.uint64:
    return np.uint64(2 ** (8 * n) - 1)


class PartialMatching:
    """Pretrained partial matching with method C and symbol exclusion, whole in memory; `Trie` gives the same costs by joins.

    From counts of n-grams for n = 1..order + 1. A byte seen c times in a context with n bytes, t
    distinct, has probability c / (n + t), an escape t / (n + t); what a context lacks of its own
    count (ends of texts) counts as escapes too. After an escape from a context all bytes seen in it are excluded in the
    shorter one. As these are among the shorter one's bytes, what is left there depends on the
    longer context alone and is kept with it. After the empty context the bytes never seen share
    evenly. All costs are -log10 of probabilities.
    """

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]], total: int):
        self.order = len(levels) - 1
        self.grams = [Index(keys) for keys, _ in levels]
        self.log_count = [np.log10(np.maximum(counts, 1)).astype(np.float32) for _, counts in levels]
        contexts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for m, (keys, counts) in enumerate(levels):
            context, place = np.unique(keys >> np.uint64(8), return_inverse=True)
            kept, distinct = np.bincount(place, counts, len(context)), np.bincount(place, minlength=len(context)).astype(float)
            seen = np.full(len(context), float(total))
            if m:
                at = self.grams[m - 1].find(context)
                seen = np.where(at >= 0, levels[m - 1][1][at] if len(levels[m - 1][1]) else 0, 0)
            contexts.append((context, place, kept, distinct, np.maximum(seen - kept, 0)))
        self.contexts, self.own, self.escape, self.after, self.after_escape = [], [], [], [], []
        for m, (context, place, kept, distinct, lost) in enumerate(contexts):
            self.contexts.append(Index(context))
            with np.errstate(divide="ignore", invalid="ignore"):
                own = np.log10(kept + distinct + lost)
                self.own.append(own.astype(np.float32))
                self.escape.append((own - np.log10(distinct + lost)).astype(np.float32))
                if not m:
                    self.after.append(np.zeros(0, np.float32))
                    self.after_escape.append(np.zeros(0, np.float32))
                    continue
                # In the context without its oldest byte, less the bytes seen here.
                lower = self.contexts[m - 1].find(context & _mask(m - 1))
                _, _, kept2, distinct2, lost2 = contexts[m - 1]
                tail = self.grams[m - 1].find(levels[m][0] & _mask(m))
                excluded = np.bincount(place, levels[m - 1][1][tail], len(context)) if len(tail) else np.zeros(len(context))
                escapes = np.maximum(distinct2[lower] - distinct, 0) + lost2[lower]
                all_left = np.maximum(kept2[lower] - excluded, 0) + escapes
                self.after.append(np.where(all_left > 0, np.log10(all_left), 0).astype(np.float32))
                self.after_escape.append(np.where(escapes > 0, np.log10(all_left) - np.log10(escapes), 0).astype(np.float32))
        self.unseen = np.float32(math.log10(max(256 - len(levels[0][0]), 1)))
        top_keys, place = levels[-1][0], contexts[-1][1]
        self.top = (self.own[-1][place] - self.log_count[-1]).astype(np.float32) if len(top_keys) else np.zeros(0, np.float32)

    def _missed(self, keys: np.ndarray) -> np.ndarray:
        """Costs of the last byte of keys that are in no context of full length."""
        cost = np.zeros(len(keys), np.float32)
        if not len(self.own[0]):
            return cost + np.float32(math.log10(256))
        rest = np.arange(len(keys))
        longer = self.contexts[self.order].find(keys >> np.uint64(8))
        cost += np.where(longer >= 0, self.escape[self.order][longer] if len(self.escape[self.order]) else 0, 0)
        for n in range(self.order, 0, -1):
            tail = keys[rest] & _mask(n)
            context = self.contexts[n - 1].find(tail >> np.uint64(8))
            whole, after = longer < 0, (self.after[n], self.after_escape[n])
            known = context >= 0
            room = np.where(whole, self.own[n - 1][context], after[0][longer] if len(after[0]) else 0)
            escape = np.where(whole, np.where(known, self.escape[n - 1][context], 0), after[1][longer] if len(after[1]) else 0)
            found = self.grams[n - 1].find(tail)
            hit = found >= 0
            cost[rest[hit]] += room[hit] - self.log_count[n - 1][found[hit]]
            cost[rest[~hit]] += escape[~hit]
            rest, longer = rest[~hit], context[~hit]
            if not len(rest):
                return cost
        cost[rest] += self.unseen
        return cost

    def log10(self, texts: list[bytes]) -> np.ndarray:
        """log10 of the probability of each text and its end."""
        held = Texts([t + b"\0" for t in texts], self.order)
        keys = held.grams(self.order + 1)
        found = self.grams[self.order].find(keys)
        cost = self.top[found] if len(self.top) else np.zeros(len(keys), np.float32)
        missed = np.flatnonzero(found < 0)
        if len(missed):
            cost[missed] = self._missed(keys[missed])
        return -held.sums(cost)


class _Tally:
    """Counts of keys, folded now and then."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray) -> None:
        self.parts.append(counted(keys))
        self.size += len(self.parts[-1][0])
        if self.size > FOLD and len(self.parts) > 1:
            self.fold()

    def fold(self) -> tuple[np.ndarray, np.ndarray]:
        if self.parts:
            self.parts = [counted(np.concatenate([k for k, _ in self.parts]), np.concatenate([c for _, c in self.parts]))]
            self.size = len(self.parts[0][0])
        return self.parts[0] if self.parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _texts(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _counter(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, grams, ends = _Tally(), _Tally(), 0
        for batch in batches:
            texts = _texts(batch.column(0))
            ends += len(texts)
            for i, j in chunks(texts):
                held = Texts([t + b"\0" for t in texts[i:j]], order)
                grams.add(held.grams(order + 1)[held.mask()])
                words.add(Texts(texts[i:j], 1).words()[0])
        for kind, (keys, counts) in ((_WORDS, words.fold()), (_GRAMS, grams.fold()), (_WORDS, (np.array([END], np.int64).view(np.uint64), np.array([ends])))):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))], ["kind", "key", "n"])

    return run


class Trie:
    """All n-grams of the training texts as stored tables: the costs of PartialMatching by joins, without a bound on n-grams.

    grams[m]: key of m bytes, n. contexts[m]: key of m bytes, own, escape, and what is left in the
    context without its oldest byte after an escape from this one: after, after_escape. costs: key
    of order + 1 bytes, n, cost. head: the most frequent of these, keys in order and their costs.
    """

    def __init__(self, grams: DataFrame, order: int):
        self.order = order
        self.grams = {order + 1: grams}
        for m in range(order, 0, -1):
            part = self.grams[m + 1].groupBy(_tail(m).alias("key")).agg(F.sum("n").alias("n"))
            self.grams[m] = stored(part, "lm-grams")
        first = self.grams[1].agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
        self.unseen = math.log10(max(256 - first[1], 1))
        self.contexts: dict[int, DataFrame] = {}
        for m in range(order + 1):
            self.contexts[m] = stored(self._context(m, first[0]), "lm-contexts")
        own = self.contexts[order].select(F.col("key").alias("_context"), "own")
        costs = grams.withColumn("_context", F.shiftright("key", 8)).join(own, "_context")
        self.costs = stored(costs.select("key", "n", (F.col("own") - F.log10("n")).alias("cost")), "lm-costs")
        self.head = self._frequent()

    def _context(self, m: int, total: int) -> DataFrame:
        longer = self.grams[m + 1].select("key", "n", F.shiftright("key", 8).alias("_context"))
        excluded = F.lit(0)
        if m:  # counts of the same bytes in the shorter context
            longer = longer.withColumn("_tail", _tail(m)).join(self.grams[m].select(F.col("key").alias("_tail"), F.col("n").alias("_short")), "_tail")
            excluded = F.sum("_short")
        found = longer.groupBy("_context").agg(F.sum("n").alias("kept"), F.count(F.lit(1)).alias("distinct"), excluded.alias("excluded")).withColumnRenamed("_context", "key")
        seen = found.join(self.grams[m].withColumnRenamed("n", "_seen"), "key", "left") if m else found.withColumn("_seen", F.lit(total))
        out = seen.withColumn("lost", F.greatest(F.coalesce("_seen", F.lit(0)) - F.col("kept"), F.lit(0)))
        own = F.log10(F.col("kept") + F.col("distinct") + F.col("lost"))
        stats = ["key", "kept", "distinct", "lost", own.alias("own"), (own - F.log10(F.col("distinct") + F.col("lost"))).alias("escape")]
        if not m:
            return out.select(*stats, F.lit(0.0).alias("after"), F.lit(0.0).alias("after_escape"))
        lower = self.contexts[m - 1].select(F.col("key").alias("_lower"), F.col("kept").alias("_kept"), F.col("distinct").alias("_distinct"), F.col("lost").alias("_lost"))
        out = out.withColumn("_lower", _tail(m - 1)).join(lower, "_lower")
        escapes = F.greatest(F.col("_distinct") - F.col("distinct"), F.lit(0)) + F.col("_lost")
        left = F.greatest(F.col("_kept") - F.col("excluded"), F.lit(0)) + escapes
        after = F.when(left > 0, F.log10(left)).otherwise(0.0)
        return out.select(*stats, after.alias("after"), F.when(escapes > 0, F.log10(left) - F.log10(escapes)).otherwise(0.0).alias("after_escape"))

    def _frequent(self) -> tuple[np.ndarray, np.ndarray]:
        """At most GRAM_HEAD n-grams: those from the least step of counts (a 16th of a doubling) on of which all have room."""
        step, room, least = F.floor(F.log2("n") * 16), GRAM_HEAD, math.inf
        for r in sorted(self.costs.groupBy(step.alias("step")).count().collect(), reverse=True):
            room -= r["count"]
            if room < 0:
                break
            least = r.step
        if least == math.inf:
            return np.zeros(0, np.uint64), np.zeros(0, np.float32)
        top = self.costs.where(step >= least).select("key", F.col("cost").cast("float").alias("cost")).toArrow()
        keys = top.column("key").to_numpy().astype(np.uint64)
        at = np.argsort(keys)
        return keys[at], top.column("cost").to_numpy()[at]

    def _level(self, m: int, table: dict[int, DataFrame], *columns: Column) -> DataFrame:
        out = table[m].select(*columns)
        return F.broadcast(out) if m <= SMALL else out

    def missed(self, keys: DataFrame) -> DataFrame:
        """key, cost of the last byte for keys (distinct) of order + 1 bytes that are not among the n-grams."""
        carried = ["key", "cost", "after", "after_escape"]
        longest = self._level(self.order, self.contexts, F.col("key").alias("_context"), "escape", "after", "after_escape")
        rest = keys.withColumn("_context", F.shiftright("key", 8)).join(longest, "_context", "left")
        rest = rest.select("key", F.coalesce("escape", F.lit(0.0)).alias("cost"), "after", "after_escape")
        done = []
        for m in range(self.order, 0, -1):
            grams = self._level(m, self.grams, F.col("key").alias("_tail"), "n")
            context = self._level(m - 1, self.contexts, F.col("key").alias("_context"), "own", "escape", F.col("after").alias("_after"), F.col("after_escape").alias("_after_escape"))
            rows = rest.withColumn("_tail", _tail(m)).join(grams, "_tail", "left").withColumn("_context", F.shiftright("_tail", 8)).join(context, "_context", "left")
            hit = F.coalesce("after", "own") - F.log10("n")
            rows = rows.withColumn("_hit", F.col("n").isNotNull()).withColumn("cost", F.col("cost") + F.when(F.col("_hit"), hit).otherwise(F.coalesce("after_escape", "escape", F.lit(0.0))))
            rows = stored(rows.select("_hit", "key", "cost", F.col("_after").alias("after"), F.col("_after_escape").alias("after_escape")), "lm-missed")
            done.append(rows.where("_hit").select("key", "cost"))
            rest = rows.where("not _hit").select(*carried)
        out = rest.select("key", F.col("cost") + self.unseen)
        for part in done:
            out = out.unionAll(part)
        return out.toDF("key", "cost")


def _tail(n: int) -> Column:
    """The last n bytes of key."""
    return F.col("key").bitwiseAND(F.lit(2 ** (8 * n) - 1).cast("long"))


class Corpus:
    """What the training texts give: `words` (key, n) as a stored table, their total and number, the most frequent ones, the byte n-grams."""

    def __init__(self, words: DataFrame, tokens: int, types: int, head: tuple[np.ndarray, np.ndarray], trie: Trie):
        self.words, self.tokens, self.types, self.head, self.trie = words, tokens, types, head, trie


def learned(docs: DataFrame, usable: Column, order: int = ORDER) -> Corpus:
    """Count words and byte n-grams of all usable texts (null: empty), whole.

    Each task folds its own counts; the sums and all that follows from them are distributed. Only
    the HEAD most frequent words and the GRAM_HEAD most frequent n-grams come to the driver, to be
    looked up instead of joined; none is dropped. Words are told apart by 64-bit hashes.
    """
    batched(docs.sparkSession)
    rows = docs.where(usable).select("text").mapInArrow(_counter(order), "kind int, key long, n long")
    counts = stored(rows.groupBy("kind", "key").agg(F.sum("n").alias("n")).where("n > 0"), "lm-counts")
    words = counts.where(F.col("kind") == _WORDS).select("key", "n")
    tokens, types = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    top = words.orderBy(F.desc("n"), "key").limit(HEAD).toArrow()
    keys, n = top.column("key").to_numpy().view(np.uint64), top.column("n").to_numpy()
    by_key = np.argsort(keys)
    trie = Trie(counts.where(F.col("kind") == _GRAMS).select("key", "n"), order)
    return Corpus(words, tokens, types, (keys[by_key], n[by_key]), trie)


def scored(docs: DataFrame, corpus: Corpus) -> DataFrame:
    """docs with n_tokens, n_known, train_tokens, base_score and score; one row for each row, whole texts.

    score: log10 probability of the text's bytes and its end under the byte model. Base: words
    (lower-cased A-Z) and one end, each log10((c + 1) / (N + 1 * (V + 1))). Null text: empty, so its
    end alone. Columns with these names are replaced; those named _text, _row, _known, _log, _score, _rare or _grams are refused. Frequent words and n-grams are looked up; the
    others are joined with all counts and costs by key, as rows of no key that is frequent. N-grams
    that no training text has get their costs once each, through the shorter contexts.
    """
    spark = batched(docs.sparkSession)
    added = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    names = [c for c in docs.columns if c not in added]
    reserved(docs, "_text", "_row", "_known", "_log", "_score", "_rare", "_grams")
    keys, n = corpus.head
    shared = spark.sparkContext.broadcast((keys, n, *corpus.trie.head))  # bounded by HEAD and GRAM_HEAD
    order = corpus.trie.order

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head_keys, head_n, gram_keys, gram_costs = shared.value
        index, grams = Index(head_keys), Index(gram_keys)
        logs = np.log10(head_n + 1.0)
        end = index.find(np.array([END], np.int64).view(np.uint64))[0]
        for batch in batches:
            texts = _texts(batch.column("_text"))
            tokens, known, log, score = (np.zeros(len(texts), t) for t in (np.int64, np.int64, float, float))
            rare, sizes = [np.zeros(0, np.int64)], [0]
            rare_grams: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int32))]
            gram_sizes = np.zeros(len(texts) + 1, np.int64)
            for i, j in chunks(texts):
                held = Texts([t + b"\0" for t in texts[i:j]], order)
                at = grams.find(own := held.grams(order + 1))
                score[i:j] = -held.sums(np.where(at >= 0, gram_costs[at], np.float32(0)) if len(gram_costs) else np.zeros(len(own), np.float32))
                missed = np.flatnonzero((at < 0) & held.mask())
                row, own = np.searchsorted(held.end, missed, "right"), own[missed]
                by_row = np.lexsort((own, row))
                row, own = row[by_row], own[by_row]
                first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (own[1:] != own[:-1])][: len(row)])
                rare_grams.append((own[first].view(np.int64), np.diff(np.r_[first, len(row)]).astype(np.int32)))
                gram_sizes[i + 1 : j + 1] = np.bincount(row[first], minlength=j - i)
                hashes, ends = Texts(texts[i:j], 1).words()
                cuts = np.r_[0, ends]
                found = index.find(hashes)
                hit = found >= 0
                before = lambda values: np.diff(np.r_[0.0, np.cumsum(values)][cuts])  # noqa: B023, E731
                tokens[i:j] = np.diff(cuts) + 1
                known[i:j] = before(hit).round() + (end >= 0)
                log[i:j] = before(np.where(hit, logs[found] if len(logs) else 0, 0)) + (logs[end] if end >= 0 else 0)
                rare.append(hashes[~hit].view(np.int64))
                sizes += before(~hit).round().astype(np.int64).tolist()
            offsets = pa.array(np.cumsum(sizes).astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(rare)))
            structs = pa.StructArray.from_arrays([pa.array(np.concatenate(x)) for x in zip(*rare_grams, strict=True)], ["key", "times"])
            gram_lists = pa.ListArray.from_arrays(pa.array(np.cumsum(gram_sizes).astype(np.int32)), structs)
            arrays = [*(batch.column(c) for c in names), *(pa.array(x) for x in (tokens, known, log, score)), lists, gram_lists]
            yield pa.RecordBatch.from_arrays(arrays, [*names, "n_tokens", "_known", "_log", "_score", "_rare", "_grams"])

    empty = {"n_tokens": F.lit(0).cast("long"), "_known": F.lit(0).cast("long"), "_log": F.lit(0.0), "_score": F.lit(0.0), "_rare": F.array().cast("array<long>"), "_grams": F.array().cast("array<struct<key:long,times:int>>")}
    rows = docs.select(*names, F.col("text").alias("_text")).mapInArrow(run, docs.select(*names).withColumns(empty).schema)
    rows = stored(rows.withColumn("_row", F.monotonically_increasing_id()), "lm-rows")
    rare = rows.select("_row", F.explode("_rare").alias("key"))
    more = rare.join(corpus.words.hint("shuffle_hash"), "key").select("_row", F.lit(1).alias("_more"), F.log10(F.col("n") + 1.0).alias("_more_log"), F.lit(0.0).alias("_cost"))
    grams = rows.select("_row", F.inline("_grams")).join(corpus.trie.costs.select("key", "cost"), "key", "left")
    grams = stored(grams.select("_row", F.when(F.col("cost").isNull(), F.col("key")).alias("key"), "times", "cost"), "lm-rare")  # key: only of n-grams without a cost
    new = grams.where("key is not null").select("_row", "key", "times")
    new = new.join(corpus.trie.missed(new.select("key").distinct()), "key")
    cost = (F.col("times") * F.col("cost")).alias("_cost")
    for part in (grams.where("key is null"), new):
        more = more.unionAll(part.select("_row", F.lit(0), F.lit(0.0), cost))
    sums = more.groupBy("_row").agg(F.sum("_more").alias("_more"), F.sum("_more_log").alias("_more_log"), F.sum("_cost").alias("_cost"))
    out = rows.drop("_rare", "_grams").join(sums, "_row", "left")
    smoothed = math.log10(corpus.tokens + (corpus.types + 1))
    return out.select(
        *names,
        "n_tokens",
        (F.col("_known") + F.coalesce("_more", F.lit(0))).alias("n_known"),
        F.lit(corpus.tokens).cast("long").alias("train_tokens"),
        (F.col("_log") + F.coalesce("_more_log", F.lit(0.0)) - F.col("n_tokens") * smoothed).alias("base_score"),
        (F.col("_score") - F.coalesce("_cost", F.lit(0.0))).alias("score"),
    )
