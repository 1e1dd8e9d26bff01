"""Near-duplicate groups by an n-gram Jaccard join over vertical partitions of the global n-gram order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.components import components
from .bytegrams import Index, Texts, chunks, mix
from .common import batched, release, stored

#: Fragments of the global order; the last holds the frequent n-grams.
FRAGMENTS = 4
#: Most n-grams known as frequent, and how many of them, of at least so many documents, a task names.
FREQUENT, NAMED, LEAST = 1 << 16, 4096, 4
#: Bits of the parity sketch of a set in buckets, members for each bit of the wider sketch of large sets, and most bits of the filter of sets worth a second look.
SKETCH, LOAD, FILTER = 512, 1.5, 1 << 27
#: How many times the members needed for one shared are looked at to tell whether a set can be near another.
EXTENT = 2
#: Rounds in which buckets compare their members with one leader before other pairs are taken up; all but the first round leave out buckets of so few components.
ROUNDS, FEW = 2, 16
FOLD = 1 << 21
_MULTIPLIER = np.uint64(0x9FB21C651E98DF25)


class NgramSets:
    """Sets of word n-grams, as sorted 64-bit hashes, of many texts.

    Words are what stands between white space, A-Z in lower case. A text with fewer words than n
    gives its whole sequence as one n-gram; one without words an empty set.
    """

    def __init__(self, n: int):
        self.n = n

    def of(self, texts: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
        for i, j in chunks(texts):
            words, ends = Texts(texts[i:j], 1).words()
            with np.errstate(over="ignore"):
                whole = np.full(max(len(words) - self.n + 1, 0), self.n, np.uint64)
                for k in range(self.n):
                    whole = whole * _MULTIPLIER + words[k : k + len(whole)]
                whole = mix(whole)
                begin = 0
                for k, end in enumerate(ends.tolist()):
                    if end - begin >= self.n:
                        found = np.sort(whole[begin : end - self.n + 1])
                        yield i + k, found[np.r_[True, found[1:] != found[:-1]]]
                    elif end > begin:
                        one = np.full(1, end - begin, np.uint64)
                        for word in words[begin:end]:
                            one = one * _MULTIPLIER + word
                        yield i + k, mix(one)
                    else:
                        yield i + k, words[:0]
                    begin = end


def node_of(found: np.ndarray) -> int:
    """Content hash of a set."""
    with np.errstate(over="ignore"):
        total = np.array([mix(found ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64) + np.uint64(len(found))], np.uint64)
    return int(mix(total).view(np.int64)[0])


def _texts(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _describe(n: int):
    """For each document its node and set size; at a task's end its most frequent n-grams as rows of no document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, parts, size = NgramSets(n), [], 0
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def fold(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            every = np.concatenate([keys, *parts])
            order = np.argsort(every, kind="stable")
            weight = np.concatenate([counts, np.ones(len(every) - len(keys), np.int64)])[order]
            every = every[order]
            first = np.flatnonzero(np.r_[True, every[1:] != every[:-1]])
            every, total = every[first], np.add.reduceat(weight, first)
            often = total >= LEAST
            if often.sum() > NAMED:
                often = total >= np.partition(total, -NAMED)[-NAMED]
            return every[often][: 2 * NAMED], total[often][: 2 * NAMED]

        for batch in batches:
            nodes, sizes, seen = [], [], set()
            for _, found in sets.of(_texts(batch.column(1))):
                nodes.append(node_of(found))
                sizes.append(len(found))
                if nodes[-1] not in seen:  # a copy says nothing about how many texts share an n-gram
                    seen.add(nodes[-1])
                    parts.append(found)
                    size += len(found)
                if size > FOLD:
                    keys, counts = fold(keys, counts)
                    parts, size = [], 0
            none = pa.nulls(len(nodes), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), none, none], ["doc_id", "node", "n_shingles", "gram", "docs"])
        if size:
            keys, counts = fold(keys, counts)
        none = pa.nulls(len(keys), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, pa.array(keys.view(np.int64)), pa.array(counts)], ["doc_id", "node", "n_shingles", "gram", "docs"])

    return run


class Order:
    """The global order: n-grams that are not frequent by hash, then the frequent ones by how many texts hold them."""

    def __init__(self, frequent: np.ndarray):
        """frequent: from the rarest to the most frequent."""
        by_key = np.argsort(frequent)
        self.index, self.rank = Index(frequent[by_key]), by_key.astype(np.uint64)

    def sort(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A set in this order, and the fragment of each member."""
        at = self.index.find(found)
        key = np.where(at < 0, found >> np.uint64(1), np.uint64(1 << 63) + (self.rank[at] if len(self.rank) else np.uint64(0)))
        by = np.argsort(key, kind="stable")
        key = key[by]
        fragment = np.minimum((key >> np.uint64(32)) * np.uint64(FRAGMENTS - 1) >> np.uint64(31), FRAGMENTS - 1)
        return found[by], fragment.astype(np.int64)


def _prefix(n: int, num: int, den: int) -> int:
    """A set of n shares one of so many first members with any set of Jaccard similarity num / den to it."""
    return n - -(-num * n // den) + 1


def _prefixes(n: int, num: int, den: int, order):
    """The first n-grams of each set, EXTENT times as many as a shared one needs, with its node; copies within a task once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, held, done = NgramSets(n), order.value, set()
        for batch in batches:
            grams, nodes, sizes = [], [], []
            for _, found in sets.of(_texts(batch.column(0))):
                if not len(found) or (node := node_of(found)) in done:
                    continue
                if len(done) < FOLD:
                    done.add(node)
                first = held.sort(found)[0][: _extended(len(found), num, den)]
                grams.append(first)
                nodes.append(node)
                sizes.append(len(first))
            every = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(every.view(np.int64)), pa.array(np.repeat(np.array(nodes, np.int64), sizes))], ["gram", "node"])

    return run


def _live(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by n-gram and node: for each node how many of its n-grams other nodes have too. A run may span batches."""
    gram, node, shared = None, None, False  # the last row, and whether its run holds two nodes

    for batch in batches:
        g, m = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(g):
            continue
        fresh = np.r_[gram is None or g[0] != gram or m[0] != node, (g[1:] != g[:-1]) | (m[1:] != m[:-1])]
        g, m = g[fresh], m[fresh]
        if not len(g):
            continue
        out = []
        goes_on = gram is not None and g[0] == gram
        if goes_on and not shared:
            out.append(np.array([node]))  # its run has just got a second node
        first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        length = np.diff(np.r_[first, len(g)])
        several = length > 1
        several[0] |= goes_on
        out.append(m[np.repeat(several, length)])
        gram, node, shared = g[-1], m[-1], bool(several[-1])
        keys, counts = np.unique(np.concatenate(out), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["node", "live"])


def _extended(n: int, num: int, den: int) -> int:
    return min(n, EXTENT * (_prefix(n, num, den) - 1) + 1)


def _needed(n: Column, num: int, den: int) -> Column:
    """How many of the extended first members of a set of n any similar set shares.

    With prefixes of p members for one shared, EXTENT * (p - 1) + 1 members hold (EXTENT - 1) * (p - 1) + 1
    shared ones, p being that of the smaller of the two sets, which has at least num / den of n.
    """
    ceil = lambda x: F.floor((x * num + (den - 1)) / den)
    least = ceil(n)
    return (EXTENT - 1) * (least - ceil(least)) + 1


class NodeFilter:
    """Says of nodes whether they may be among those given; never denies one that is. At most FILTER bits: above its size it lets more through."""

    def __init__(self, nodes: DataFrame):
        count = nodes.count()
        self.bits = min(FILTER, 1 << max(10, (12 * count).bit_length()))
        mask = F.lit(self.bits - 1)
        low, high = F.col("node").bitwiseAND(mask), F.shiftrightunsigned("node", 32).bitwiseOR(F.lit(1)).bitwiseAND(mask)
        spot = F.explode(F.array(*[(low + high * k).bitwiseAND(mask) for k in range(6)]))
        words = nodes.select(spot.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
        self.words = np.zeros(self.bits // 64, np.int64)
        self.words[words.column("word").to_numpy()] = words.column("bits").to_numpy()
        self.words = self.words.view(np.uint64)

    def has(self, node: int) -> bool:
        node &= (1 << 64) - 1
        mask = self.bits - 1
        low, high = node & mask, ((node >> 32) | 1) & mask
        return all(int(self.words[(at := (low + high * k) & mask) >> 6]) >> (at & 63) & 1 for k in range(6))


_SET = "node long, n int, sketch array<long>, wide array<long>, grams array<long>, fragments array<array<long>>"


def parity_sketch(found: np.ndarray) -> np.ndarray:
    """Parities of how many members have each value of their last bits: SKETCH of them, doubled while there are more than LOAD members to each.

    The parts of a sketch, joined by exclusive or, are the sketch of half its width.
    """
    width = SKETCH
    while len(found) > LOAD * width:
        width *= 2
    parity = np.bincount((found & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(parity.astype(np.uint8)).view(np.int64)


def _folded(sketch: np.ndarray) -> np.ndarray:
    return np.bitwise_xor.reduce(sketch.reshape(-1, SKETCH // 64), axis=0)


def _candidates(n: int, num: int, den: int, order, shared):
    """The sets that the filter lets through: their first n-grams in order, a parity sketch, and the set by fragments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, held, may, done = NgramSets(n), order.value, shared.value, set()
        for batch in batches:
            rows = []
            for _, found in sets.of(_texts(batch.column(0))):
                if not len(found):
                    continue
                node = node_of(found)
                if node in done or not may.has(node):
                    continue
                if len(done) < FOLD:
                    done.add(node)
                ordered, fragment = held.sort(found)
                first = ordered[: _prefix(len(found), num, den)]
                wide = parity_sketch(found)
                cuts = np.searchsorted(fragment, np.arange(1, FRAGMENTS))
                parts = [x.view(np.int64) for x in np.split(ordered, cuts)]
                rows.append((node, len(found), _folded(wide), wide, first.view(np.int64), parts))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            longs = pa.list_(pa.int64())
            types = (pa.int64(), pa.int32(), longs, longs, longs, pa.list_(longs))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], ["node", "n", "sketch", "wide", "grams", "fragments"])

    return run


def _enough(common: Column, total: Column, num: int, den: int) -> Column:
    """common / (total - common) >= num / den, total being the sum of both sizes."""
    return common * (num + den) >= total * num


def _possible(a: str, b: str, num: int, den: int, sketched: bool = False) -> Column:
    """What any similar pair satisfies in the bucket of its first common n-gram: enough members from there on, and near sketches."""
    col = lambda side, name: F.col(f"{side}.{name}")
    total = (col(a, "n") + col(b, "n")).cast("long")
    rest = F.least(col(a, "n") - col(a, "place"), col(b, "n") - col(b, "place")).cast("long")
    if not sketched:
        return _enough(rest, total, num, den)
    apart = sum((F.bit_count(col(a, "sketch")[k].bitwiseXOR(col(b, "sketch")[k])) for k in range(1, SKETCH // 64)), F.bit_count(col(a, "sketch")[0].bitwiseXOR(col(b, "sketch")[0])))
    # |A - B| + |B - A| = total - 2 * common is at least the distance of the parity sketches.
    return _enough(rest, total, num, den) & ((total - apart) * (num + den) >= 2 * num * total)


def _near(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (u, v) whose wide sketches are near enough for them to be similar; the wider one is folded to the other's width."""
    side = lambda name, n, wide: sets.select(F.col("node").alias(name), F.col("n").cast("long").alias(n), F.col("wide").alias(wide))
    rows = pairs.join(side("u", "_nu", "_wu"), "u").join(side("v", "_nv", "_wv"), "v")
    width = F.least(F.size("_wu"), F.size("_wv"))

    def narrowed(name: str) -> Column:
        half = F.transform(F.slice(name, F.lit(1), width), lambda x, i: x.bitwiseXOR(F.get(F.col(name), i + width)))
        return F.when(F.size(name) == width, F.col(name)).when(F.size(name) == 2 * width, half)  # null beyond: lengths rule such pairs out

    apart = F.aggregate(F.zip_with(narrowed("_wu"), narrowed("_wv"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, x: a + x)
    total = F.col("_nu") + F.col("_nv")
    long_enough = F.least("_nu", "_nv") * den >= F.greatest("_nu", "_nv") * num
    return rows.where(long_enough & F.coalesce((total - apart) * (num + den) >= 2 * num * total, F.lit(True))).select("u", "v")


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (u, v) that are similar: overlaps are counted in each fragment by itself and summed for each pair."""
    parts = sets.select("node", "n", F.posexplode("fragments").alias("fragment", "members"))
    left = parts.select(F.col("node").alias("u"), F.col("n").alias("nu"), "fragment", F.col("members").alias("mu"))
    right = parts.select(F.col("node").alias("v"), F.col("n").alias("nv"), "fragment", F.col("members").alias("mv"))
    partial = pairs.join(left, "u").join(right, ["v", "fragment"]).select("u", "v", "nu", "nv", F.size(F.array_intersect("mu", "mv")).cast("long").alias("common"))
    total = partial.groupBy("u", "v", "nu", "nv").agg(F.sum("common").alias("common"))
    return total.where(_enough(F.col("common"), (F.col("nu") + F.col("nv")).cast("long"), num, den)).select("u", "v")


def _links(sets: DataFrame, buckets: DataFrame, num: int, den: int) -> DataFrame:
    """Component roots (node, root) of the links between sets; links are verified, those within a component need not all be found.

    First each bucket compares one leader (the member with most members from there on) with the
    others, which links a cluster of near copies by a star instead of by all its pairs. Buckets in
    which more than FEW components are left apart do so again, with a leader of the smaller
    components, up to ROUNDS times. Then all possible pairs of different components are verified. A
    pair comes from a bucket only if the two sets have not come from the same bucket before, in the
    global order: so from its first common bucket and seldom from others.
    """
    roots = None
    for turn in range(ROUNDS + 1):
        rows = buckets.withColumn("root", F.col("node")) if roots is None else buckets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        if turn:  # the first round takes all buckets, as each has several nodes
            if turn < ROUNDS:
                several = rows.groupBy("gram", "root").agg(F.lit(1).alias("_")).groupBy("gram").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > FEW)
            else:
                several = rows.groupBy("gram").agg(F.min("root").alias("_a"), F.max("root").alias("_b")).where("_a != _b")
            rows = rows.join(several.select("gram"), "gram", "left_semi")
            if turn == ROUNDS:
                rows = rows.withColumn("before", F.lag("gram").over(Window.partitionBy("node").orderBy("place"))).join(sets.select("node", "sketch"), "node")
            rows = stored(rows, "bucket-rows")
            if rows.isEmpty():
                continue
        if turn < ROUNDS:
            best = rows.groupBy("gram", "root").agg(F.min(F.struct("place", "n", "node")).alias("best"), F.count(F.lit(1)).alias("size"))
            # The first leader comes from the whole bucket, the next from the smaller components.
            rank = F.struct(F.lit(0) if not turn else F.col("size"), "best")
            lead = best.groupBy("gram").agg(F.min(F.struct(rank.alias("rank"), F.col("root"))).alias("l"))
            lead = lead.select("gram", F.col("l.root").alias("root"), F.col("l.rank.best.place").alias("place"), F.col("l.rank.best.n").alias("n"), F.col("l.rank.best.node").alias("node"))
            joined = rows.alias("a").join(lead.alias("b"), "gram").where((F.col("a.root") != F.col("b.root")) & _possible("a", "b", num, den))
        else:
            fresh = F.col("a.before").isNull() | F.col("b.before").isNull() | (F.col("a.before") != F.col("b.before"))
            joined = rows.alias("a").join(rows.alias("b"), (F.col("a.gram") == F.col("b.gram")) & (F.col("a.root") < F.col("b.root")) & fresh & _possible("a", "b", num, den, True))
        pairs = joined.select(F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v")).distinct()
        found = _verified(_near(pairs, sets, num, den), sets, num, den)
        links = stored(found, "links")
        done = [links, rows] if turn else [links]
        if roots is None:
            roots = stored(components(links), "roots")
        elif not links.isEmpty():
            done.append(roots)
            roots = stored(components(links.unionAll(roots.select(F.col("node").alias("u"), F.col("root").alias("v")))), "roots")
        release(*done)
    return roots


def near_duplicates(docs: DataFrame, words: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles (size of its set), component_id.

    Two documents link when their sets of distinct word n-grams have Jaccard similarity num / den or
    more; component_id is the smallest doc_id that links lead to. Null or empty text, or one without
    words: size 0, linked with nothing. Null ids take part but name a component only where there is
    no other. Repeated rows are copies of one another. N-grams and sets are told apart by 64-bit
    hashes. Copies of one set are one node of the join, so groups of copies cost nothing.

    Similar sets share one of their first n-grams in the global order (those that are rarest, as far
    as the frequent ones are known), and a good part of EXTENT times as many; a set of which other
    sets hold too few of those never leaves the first passes. Of the rest, n-grams that several sets
    hold among their first make buckets.
    """
    spark = batched(docs.sparkSession)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, node long, n_shingles long, gram long, docs long"
    described = stored(text.mapInArrow(_describe(words), schema), "ngram-docs")
    rows = described.where("node is not null").select("doc_id", "node", "n_shingles")
    named = described.where("gram is not null").groupBy("gram").agg(F.sum("docs").alias("docs"))
    frequent = named.orderBy(F.desc("docs"), "gram").limit(FREQUENT).toArrow().column("gram").to_numpy().view(np.uint64)[::-1]
    order = spark.sparkContext.broadcast(Order(np.ascontiguousarray(frequent)))  # at most FREQUENT n-grams
    only = text.select("text")
    first = only.mapInArrow(_prefixes(words, num, den, order), "gram long, node long")
    live = first.repartition("gram").sortWithinPartitions("gram", "node").mapInArrow(_live, "node long, live long")
    sizes = rows.where("n_shingles > 0").groupBy("node").agg(F.max("n_shingles").alias("n"))
    live = live.groupBy("node").agg(F.sum("live").alias("live")).join(sizes, "node")
    chosen = stored(live.where(F.col("live") >= _needed(F.col("n"), num, den)).select("node"), "ngram-nodes")
    may = spark.sparkContext.broadcast(NodeFilter(chosen))  # at most FILTER bits
    sets = only.mapInArrow(_candidates(words, num, den, order, may), _SET).join(chosen, "node", "left_semi")
    sets = stored(sets.dropDuplicates(["node"]), "ngram-sets")
    release(chosen)
    buckets = sets.select("node", "n", F.posexplode("grams").alias("place", "gram"))
    several = buckets.groupBy("gram").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select("gram")
    buckets = stored(buckets.join(several, "gram", "left_semi"), "buckets")
    roots = _links(sets, buckets, num, den)
    release(sets, buckets)
    nodes = rows.groupBy("node").agg(F.min("doc_id").alias("_least"))
    linked = nodes.join(roots, "node")
    named_roots = linked.groupBy("root").agg(F.min("_least").alias("_component"))
    component = linked.join(named_roots, "root").select("node", "_component")
    nodes = nodes.join(component, "node", "left").select(F.col("node").alias("_node"), F.coalesce("_component", "_least").alias("component_id"))
    out = rows.where("n_shingles > 0").join(nodes, F.col("node") == F.col("_node")).select("doc_id", "n_shingles", "component_id")
    return out.unionAll(rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
