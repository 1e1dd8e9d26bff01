"""Operators against brute force on small, awkward tables: nulls, empty and long texts, ties, repeats, clashing column names."""

import base64
import gzip
import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.llm import exact_dedup, langid, lm_ppm, mixing, ngram_join, packing, quality_cnn, quality_rules, sharding, warc
from tidelog.llm.bytegrams import Index, Texts, counted

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = re.compile(r"[\x20\x09-\x0D]")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard int, size long, score double, _h1 long, node long"


def words(n, seed=1, vocab=400):
    draw = random.Random(seed)
    return [f"w{draw.randrange(vocab)}" for _ in range(n)]


def corpus():
    """(doc_id, text): copies, near copies, a shared passage, odd white space, nulls, empties, one long text."""
    base = words(200, 7)
    passage = words(60, 9)
    rows = [(1, " ".join(base)), (2, "\n".join(base)), (3, " ".join(base) + " "), (4, " ".join([*base[:-1], "other"])), (5, " ".join(["first", *base]))]
    rows += [(10 + i, " ".join([*words(80, 100 + i), *passage, *words(80, 200 + i)])) for i in range(6)]
    rows += [(30 + i, " ".join(base[: 120 + i])) for i in range(4)]
    rows += [(40, None), (41, ""), (42, " \t\n "), (43, "one"), (44, "one"), (45, "One two"), (46, "one two"), (47, "éà ÜÖ ßx"), (48, "\x0b"), (49, "a b")]
    rows += [(60, " ".join(words(6000, 5, 4000))), (61, "x" * 30000), (None, "no id"), (None, None), (70, "repeat me"), (70, "repeat me")]
    return rows


def table(spark, rows):
    out = [(i, t, ["en", "fr", None][k % 3], ["b", "a", None, "c"][k % 4], len(t or ""), 9, 9, 9.0, 9, 9) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(out, DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, corpus())


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_exact_groups(docs, none):
    found = sorted((r.doc_id is None, r.doc_id or 0, r.group_size, r.kept, r.text_sha256, r.keep_id or 0) for r in exact_dedup.exact_groups(docs).collect())
    groups = {}
    for i, t in corpus():
        groups.setdefault(SPACE.sub("", t or ""), []).append((i, t or ""))
    want = []
    for norm, members in groups.items():
        ids = [(-len(t), i) for i, t in members if i is not None]
        keep = min(ids)[1] if ids else None
        want += [(i is None, i or 0, len(members), i == keep, hashlib.sha256(norm.encode()).hexdigest(), keep or 0) for i, _ in members]
    assert found == sorted(want)
    assert exact_dedup.exact_groups(none).count() == 0
    left = exact_dedup.deduplicated(docs)
    assert left.columns == docs.columns and sorted(r.doc_id or 0 for r in left.collect()) == sorted({w[1] for w in want if w[3]})


def test_exact_groups_by_text_id(spark):
    rows = spark.createDataFrame([("b", "x y"), ("a", "xy"), ("c", "x  y"), (None, "z")], "doc_id string, text string")
    assert {r.doc_id: r.keep_id for r in exact_dedup.exact_groups(rows).collect()} == {"a": "c", "b": "c", "c": "c", None: None}


def _grams(text, n):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def _components(rows, n, num, den):
    sets, root = [_grams(t, n) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and both * (num + den) >= num * (len(sets[i]) + len(sets[j])):
                root[max(find(i), find(j))] = min(find(i), find(j))
    names = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            names[find(i)] = min(names.get(find(i), d), d)
    return sorted((d is None, d or 0, len(sets[i]), names.get(find(i), 0) if sets[i] else d or 0) for i, (d, _) in enumerate(rows))


def _near(df, *args):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in ngram_join.near_duplicates(df, *args).collect())


@pytest.mark.parametrize("how", [(3, 9, 10), (5, 8, 10)])
def test_near_duplicates(docs, how):
    assert _near(docs, *how) == _components(corpus(), *how)


def test_near_duplicates_of_none(none):
    assert ngram_join.near_duplicates(none).count() == 0


def test_near_duplicates_of_a_cluster_of_random_edits(spark):
    draw, base, rows = random.Random(3), words(120, 11, 10**6), []
    for i in range(90):
        text = list(base)
        for _ in range(draw.randrange(4)):
            text[draw.randrange(len(text))] = f"edit{draw.randrange(40)}"
        rows.append((i, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert _near(df, 3, 9, 10) == _components(rows, 3, 9, 10)


def test_streamed_runs_span_batches():
    import pyarrow as pa

    rows = [(1, 5), (1, 5), (1, 6), (2, 5), (3, 7), (3, 7), (3, 8), (3, 9), (4, 9)]
    for cut in range(len(rows) + 1):
        batches = [pa.RecordBatch.from_arrays([pa.array([g for g, _ in part], pa.int64()), pa.array([m for _, m in part], pa.int64())], ["gram", "node"]) for part in (rows[:cut], rows[cut:])]
        got = {}
        for b in ngram_join._live(iter(batches)):
            for node, live in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got[node] = got.get(node, 0) + live
        assert got == {5: 1, 6: 1, 7: 1, 8: 1, 9: 1}, cut


def brute_targets(sizes, weights, share=1.5, epochs=2):
    """Water filling: a target above epochs times its size stops there, until none is."""
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), share * sum(sizes)
    while free:
        unit = left / sum(weights[i] for i in free)
        full = {i for i in free if unit * weights[i] >= epochs * sizes[i]}
        for i in full or free:
            out[i] = epochs * sizes[i] if full else unit * weights[i]
        left -= sum(out[i] for i in full)
        free = free - full if full else set()
    return out


@pytest.mark.parametrize("sizes", [[10, 10, 10], [0, 0], [100, 7, 3, 50], [5], [1, 10**6, 3, 4, 900, 0, 77, 10**5, 2]])
def test_targets_share_what_capped_sources_leave(spark, sizes):
    names = [chr(97 + i) for i in range(len(sizes))]
    table = spark.createDataFrame(list(zip(names, sizes, strict=True)), "_source string, source_size long")
    got = {r["_source"]: r.target for r in mixing.targets(table).collect()}
    assert [got[x] for x in names] == pytest.approx(brute_targets(sizes, [[5, 2, 1][i % 3] for i in range(len(sizes))]), abs=1e-5)
    assert mixing.targets(table.where("false")).count() == 0


def test_mixing(docs, none):
    rows = mixing.mixed(docs).collect()
    size = lambda t: len(WORD.findall(t or ""))
    total = sum(size(t) for _, t in corpus())
    sources = {}
    for r in rows:
        sources.setdefault(r.source, []).append(r)
        assert 0 <= r.taken <= 2 * r["size"] and r["size"] <= r.source_size
    assert sum(r["size"] for r in rows) == total and len(rows) == len(corpus())
    for own in sources.values():
        assert sum(r.taken for r in own) == math.floor(own[0].target + 0.5)
    assert sum(own[0].target for own in sources.values()) == pytest.approx(1.5 * total, abs=0.01)
    assert sorted(map(str, mixing.mixed(docs).collect())) == sorted(map(str, rows))
    assert mixing.mixed(none).count() == 0
    mix = mixing.mixed_documents(docs)
    assert mix.columns == docs.columns and mixing.mixed_documents(none).count() == 0


def test_mixing_keeps_large_ids_beside_null_ones(spark):
    big = 2**53 + 1
    rows = [(big, "a b", "s"), (None, "c", "s"), (big + 2, "d e f", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert sorted((r.doc_id or 0, r["size"]) for r in mixing.mixed(docs).collect()) == [(0, 1), (big, 2), (big + 2, 3)]
    names = docs.withColumns({c: F.lit(3) for c in ("_row", "_size", "_taken", "_cut", "size", "taken", "_source", "before", "target", "_pid")})
    mix = mixing.mixed_documents(names)
    assert mix.columns == names.columns and {r["_row"] for r in mix.collect()} == {3} and mix.count() == mixing.mixed_documents(docs).count()


def test_mix_takes_each_row_as_planned(spark):
    """Rows without an id, or with one that others have, are taken by their own plan."""
    sizes = {"a": (100, 10, 31), "b": (20, 8, 40), "c": (12, 90, 7)}
    rows = [(i, "  ".join(words(n, n)) + "\n", s) for s, own in sizes.items() for i, n in zip((None, 7, 7), own, strict=True)] + [(None, " ".join(words(9, 3)), "c")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    text = {(s, i, len(t.split())): t for i, t, s in rows}
    want = Counter()
    for r in mixing.mixed(docs).collect():
        own, (whole, rest) = text[r.source, r.doc_id, r["size"]], divmod(r.taken, r["size"])
        want[r.source, r.doc_id, own] += whole
        want[r.source, r.doc_id, re.match(r"(\s*\S+){%d}" % rest, own).group()] += rest > 0
    assert Counter((r.source, r.doc_id, r.text) for r in mixing.mixed_documents(docs).collect()) == +want


def test_reshard_moves_the_fewest_bytes():
    old, capacity = {0: 100, 1: 10, 2: 50}, [40, 40, 40, 40]
    moves = sharding.plan_transfers(old, capacity)
    assert sum(m.size for m in moves if m.src != m.dst) == 60 + 10  # what stands above capacity has to go
    for j, c in enumerate(capacity):
        assert sum(m.size for m in moves if m.dst == j) == c
    for i, s in old.items():
        assert sum(m.size for m in moves if m.src == i) == s
    with pytest.raises(ValueError):
        sharding.plan_transfers({0: 1}, [2])
    assert sharding.affected([sharding.Transfer(0, 0, 5), sharding.Transfer(1, 2, 5)]) == {1, 2}


@pytest.mark.parametrize("seed", range(6))
def test_reshard_moves_no_more_than_what_stands_above_capacity(seed):
    """Whatever the plan, what a shard holds above its capacity has to go, and all of a shard that ends; a cheapest plan moves just that."""
    draw = random.Random(seed)
    old = {i: draw.randrange(0, 1000) for i in range(draw.randrange(1, 9))}
    capacity = sharding.capacities(sum(old.values()), draw.randrange(1, 9))
    assert sum(capacity) == sum(old.values()) and max(capacity) - min(capacity) <= 1
    moves = sharding.plan_transfers(old, capacity)
    assert sum(m.size for m in moves if m.src != m.dst) == sum(max(0, s - (capacity[i] if i < len(capacity) else 0)) for i, s in old.items())
    assert all(sum(m.size for m in moves if m.dst == j) == c for j, c in enumerate(capacity)) and all(sum(m.size for m in moves if m.src == i) == s for i, s in old.items())


def test_shards_that_neither_gain_nor_lose_keep_their_files(spark, tmp_path):
    rows = [(i, "x" * (92 if i < 40 else 40 if i < 60 else 150), i // 20) for i in range(80)]  # shards 0 and 1 have the mean size
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    docs.repartition("shard").write.partitionBy("shard").parquet(f"{tmp_path}/old")
    before = {f for s in (0, 1) for f in os.listdir(f"{tmp_path}/old/shard={s}")}
    old = spark.read.parquet(f"{tmp_path}/old").select("doc_id", "text", "shard")
    out = sharding.resharded(old.select("doc_id", "text", F.col("shard").alias("was")), F.col("was"), 4, slack=0.05, old_path=f"{tmp_path}/old")
    found = out.collect()
    assert sorted(r.doc_id for r in found) == list(range(80)) and all(r.shard == r.doc_id // 20 for r in found if r.doc_id < 40)
    for s in range(4):
        assert sorted(r.slot for r in found if r.shard == s) == list(range(sum(r.shard == s for r in found)))
    sizes = [sum(len(r.text) + 8 for r in found if r.shard == s) for s in range(4)]
    assert max(sizes) - min(sizes) <= 160 and before == {f for s in (0, 1) for f in os.listdir(f"{tmp_path}/old/shard={s}")}


def test_reserved_and_clashing_names(spark, docs):
    with pytest.raises(ValueError):
        sharding.resharded(docs.withColumn("_minus", F.lit(1)), F.col("doc_id") % 5, 6)
    with pytest.raises(ValueError):
        lm_ppm.scored(docs.withColumn("_rare", F.lit(1)), lm_ppm.learned(docs, F.lit(True)))
    extra = docs.withColumns({c: F.lit(4) for c in ("_text", "_sha", "_kept_id", "_kept_sha", "lang_pred", "quality_score")})
    model = langid.learned(docs, F.lit(True), sample=5)
    assert {r._text for r in langid.identified(extra, model).collect()} == {4} == {r._text for r in quality_cnn.scored(extra, quality_cnn.ConvolutionalScorer()).collect()}
    assert exact_dedup.deduplicated(extra).columns == extra.columns and exact_dedup.deduplicated(extra).count() == exact_dedup.deduplicated(docs).count()


def test_resharding(docs, none):
    rows = sharding.resharded(docs, F.col("doc_id") % 5, 6).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text is None, r.text or "")
    assert sorted(map(key, rows)) == sorted((i is None, i or 0, t is None, t or "") for i, t in corpus())
    for s in range(6):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert sharding.resharded(none, F.col("doc_id") % 5, 6).count() == 0


def test_warc_round_trip(spark, tmp_path):
    rows = [(3, "http://a/\n", "<p>é</p>"), (1, None, "<p>é</p>"), (7, "u", None), (2, "u2", ""), (9, "x", "z" * 100000), (None, "n", "z" * 100000), (9, "x", "z" * 100000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("_sha", F.lit("mine"))
    root, index = warc.write_archives(pages, f"file://{tmp_path}/w")
    found = warc.read_records(root, index).collect()
    want = []
    for i, _, html in rows:
        payload = (html or "").encode()
        first = min(j for j, _, h in rows if (h or "") == (html or "") and j is not None)
        sha = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        want.append((i or 0, len(payload), sha, "response" if i == first else "revisit", 0 if i == first else first, payload if i == first else b""))
    assert sorted((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or 0, bytes(r.payload or b"")) for r in found) == sorted(want)
    some = warc.read_records(root, index.where("page_id = 7 or page_id = 1"))
    assert sorted((r.page_id, r.url) for r in some.collect()) == [(1, None), (7, "u")]
    root, index = warc.write_archives(pages.where("false"), f"file://{tmp_path}/e")
    assert warc.read_records(root, index).count() == 0


def test_warc_keeps_large_ids_and_any_url(spark, tmp_path):
    big = 2**53 + 1
    rows = [(big, "http://a/é ü\r\nX: 1", "<p>"), (big + 2, "http://b/%20", "<p>"), (None, None, "<p>"), (5, None, "q")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    root, index = warc.write_archives(pages, f"file://{tmp_path}/w")
    found = {(r.page_id, r.url, r.refers_to) for r in warc.read_records(root, index).collect()}
    assert found == {(big, rows[0][1], None), (big + 2, rows[1][1], big), (None, None, big), (5, None, None)}
    heads, blocks = zip(*[warc.parse(gzip.decompress(open(f"{tmp_path}/w/archives/{r.file}", "rb").read()[r.offset : r.offset + r.length])) for r in index.collect()], strict=True)
    assert len({h["WARC-Record-ID"] for h in heads}) == 4 and all(h["Content-Type"].startswith("application/http") for h in heads)
    assert {h["WARC-Refers-To-Target-URI"] for h in heads if h["WARC-Type"] == "revisit"} == {"http://a/%C3%A9%20%C3%BC%0D%0AX:%201"} and sorted(blocks) == [b"", b"", b"<p>", b"q"]


def test_ranges_join_what_lies_near():
    assert warc.ranges([0, 10, 500, 510], [10, 10, 10, 10], gap=100, most=1000) == [(0, 2), (2, 4)]
    assert warc.ranges([0, 10, 20], [10, 10, 10], gap=0, most=20) == [(0, 2), (2, 3)] and warc.ranges([], []) == []


def test_language(docs, none, spark):
    de, en = "der und nicht ist das schöne haus zu müssen über ", "the and of that house with nothing really into "
    rows = [(i, (de if i % 2 else en) * (1 + i % 3), "de" if i % 2 else "en") for i in range(60)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learned(train, F.lit(True), sample=20)
    assert [x for x, _ in model.predict([b"der und das haus", b"the house with", b"", b"12 34 !?", "é".encode()])][:4] == ["de", "en", "und", "und"]
    out = langid.identified(docs, model)
    assert out.count() == len(corpus()) and out.where("lang_pred = 'und'").count() == out.where("lang_score = 0").count()
    assert langid.identified(none, model).count() == 0
    assert langid.learned(none, F.lit(True)).predict([b"abc"]) == [("und", 0.0)]


def test_language_costs_are_those_of_a_plain_recursion():
    samples = {"x": [b"abracadabra abra", b"cab"], "y": [b"banana bandana"]}
    order, model = 3, langid.LanguageModel({k: v for k, v in samples.items()}, 3)
    for text in (b"abracab", b"banana", b"zq", b"an ana"):
        for column, name in enumerate(model.languages):
            counts = {}
            for t in samples[name]:
                padded = b"\n" * order + t
                for e in range(order, len(padded)):
                    for n in range(order + 1):
                        at = counts.setdefault(padded[e - n : e], {})
                        at[padded[e]] = at.get(padded[e], 0) + 1

            def bits(context, byte, counts=counts):
                own = counts.get(context)
                if own is None:
                    return bits(context[1:], byte) if context else 8.0
                n, t = sum(own.values()), len(own)
                if byte in own:
                    return math.log2((n + t) / own[byte])
                return math.log2((n + t) / t) + (bits(context[1:], byte) if context else 8.0)

            padded = b"\n" * order + text
            want = sum(bits(padded[e - order : e], padded[e]) for e in range(order, len(padded)))
            assert model.bits([text])[0][column] == pytest.approx(want, rel=1e-5)


def test_partial_matching_is_that_of_a_plain_recursion():
    texts, order = [b"abracadabra", b"abrasive cab", b"a"], 3
    keys = np.concatenate([(h := Texts([t + b"\0"], order)).grams(order + 1)[h.mask()] for t in texts])
    levels = [tuple(x.astype(float) if i else x for i, x in enumerate(counted(keys & np.uint64(2 ** (8 * n) - 1)))) for n in range(1, order + 2)]
    model = lm_ppm.PartialMatching(levels, len(keys))
    counts, seen = {}, {}
    for t in texts:
        padded = b"\n" * order + t + b"\0"
        for e in range(order, len(padded)):
            for n in range(order + 1):
                at = counts.setdefault(padded[e - n : e], {})
                at[padded[e]] = at.get(padded[e], 0) + 1
                seen[padded[e - n + 1 : e + 1]] = seen.get(padded[e - n + 1 : e + 1], 0) + 1
    seen[b""] = len(keys)

    def cost(context, byte, excluded):
        own = counts.get(context)
        if own is None:
            return cost(context[1:], byte, excluded)
        lost = max(seen.get(context, 0) - sum(own.values()), 0)
        left = {b: c for b, c in own.items() if b not in excluded}
        whole = sum(left.values()) + len(left) + lost
        if byte in left:
            return math.log10(whole / left[byte])
        escape = math.log10(whole / (len(left) + lost)) if len(left) + lost else 0.0
        return escape + (cost(context[1:], byte, set(own)) if context else math.log10(256 - len(own)))

    for text in (b"abracadabra", b"abzab", b"", b"sive", b"\n\nq"):
        padded = b"\n" * order + text + b"\0"
        want = -sum(cost(padded[e - order : e], padded[e], set()) for e in range(order, len(padded)))
        assert model.log10([text])[0] == pytest.approx(want, rel=1e-4)


def test_language_model_base(docs, none):
    usable = F.coalesce(F.col("doc_id"), F.lit(0)) % 3 != 1
    rows = lm_ppm.scored(docs, lm_ppm.learned(docs, usable)).collect()
    tokens = lambda t: [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]
    counts = {}
    for i, t in corpus():
        if (i or 0) % 3 != 1:
            for w in tokens(t):
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    want = sorted((i or 0, len(tokens(t)), sum(w in counts for w in tokens(t)), round(sum(math.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in tokens(t)), 4)) for i, t in corpus())
    assert sorted((r.doc_id or 0, r.n_tokens, r.n_known, round(r.base_score, 4)) for r in rows) == want
    assert {r.train_tokens for r in rows} == {n} and all(r.score < 0 for r in rows)
    assert lm_ppm.scored(none, lm_ppm.learned(none, F.lit(True))).count() == 0
    empty = lm_ppm.scored(docs, lm_ppm.learned(none, F.lit(True))).collect()
    assert len(empty) == len(corpus()) and {r.n_known for r in empty} == {0}


def _whole_scores(train, texts):
    """Scores under the n-grams of all training texts, in memory."""
    keys = np.concatenate([(h := Texts([t + b"\0"], lm_ppm.ORDER)).grams(lm_ppm.ORDER + 1)[h.mask()] for t in train])
    levels = [tuple(x.astype(float) if i else x for i, x in enumerate(counted(keys & np.uint64(2 ** (8 * n) - 1)))) for n in range(1, lm_ppm.ORDER + 2)]
    return lm_ppm.PartialMatching(levels, len(keys)).log10(texts)


@pytest.mark.parametrize("head", [0, 300, 1 << 20])
def test_language_model_costs_by_joins(docs, none, head, monkeypatch):
    monkeypatch.setattr(lm_ppm, "GRAM_HEAD", head)
    train = [(t or "").encode() for i, t in corpus() if (i or 0) % 3 != 1]
    texts = [(t or "").encode() for _, t in corpus()]
    rows = lm_ppm.scored(docs, lm_ppm.learned(docs, F.coalesce(F.col("doc_id"), F.lit(0)) % 3 != 1)).collect()
    want = sorted(zip((t.decode() for t in texts), _whole_scores(train, texts).tolist(), strict=True))
    found = sorted((r.text or "", r.score) for r in rows)
    assert [t for t, _ in found] == [t for t, _ in want]
    assert [s for _, s in found] == pytest.approx([s for _, s in want], rel=1e-4)
    if not head:
        assert {round(r.score, 4) for r in lm_ppm.scored(docs.where("text = 'one'"), lm_ppm.learned(none, F.lit(True))).collect()} == {round(-4 * math.log10(256), 4)}


def test_language_model_keeps_rare_ngrams_of_a_large_corpus(spark):
    """Beside 18 MB of other text, n-grams of one training text are known."""
    rare, filler = "quixotic zephyr jumps", "the same line again\n" * 50_000
    rows = spark.createDataFrame([(1, rare), *((2 + i, filler) for i in range(18))], "doc_id long, text string")
    found = lm_ppm.scored(rows.where("doc_id = 1"), lm_ppm.learned(rows, F.lit(True))).first().score
    assert found == pytest.approx(_whole_scores([rare.encode()] + [filler.encode()] * 18, [rare.encode()])[0], rel=1e-4)


def test_packing(spark, docs, none):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    rows = packing.packed(packing.pieces(docs, path)).collect()
    tokenizer, want = packing.WordTokenizer(path), []
    for i, t in corpus():
        ids = [*tokenizer.whole.encode(t or "", add_special_tokens=False).ids, 0]
        for piece, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want.append((i or 0, piece, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 2048
    assert packing.packed(packing.pieces(none, path)).count() == 0


def test_plain_and_odd_texts_tokenize_as_the_library_does():
    import public_tokenizers

    tokenizer = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    assert tokenizer.pieces_agree
    draw = random.Random(5)
    letters = "aAbzZ09'\"-_.,!? \t\n\r\x0b\x0céÉßÿÀ×÷§²ªµ€İΣσς中<|>re've"
    for text in ["<|endoftext|> a", "don't we'll RE're", "x" * 5000, "ΑΣ Σ", *("".join(draw.choice(letters) for _ in range(40)) for _ in range(300))]:
        assert tokenizer(text) == tokenizer._whole(text), text


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_each_piece_once_and_fills_well(seed):
    draw = random.Random(seed)
    histogram = {draw.randrange(1, 2049): draw.randrange(1, 50) for _ in range(200)}
    used, placed = {}, {}
    for length, lo, hi, each, first, offset in packing.plan(histogram):
        placed[length] = placed.get(length, 0) + hi - lo
        for k in range(hi - lo):
            used.setdefault(first + k // each, []).append((offset + k % each * length, length))
    assert placed == histogram
    for own in used.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 2048
    total = sum(k * v for k, v in histogram.items())
    assert len(used) <= 11 / 9 * -(-total // 2048) + 1


def _counts(text):
    w = WORD.findall(text or "")
    windows = {}
    for i in range(len(w) - 7):
        windows.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_features(spark, none):
    rows = [*corpus(), (80, "a b c d e f g h\n" * 3 + "tail"), (81, "x " * 40), (82, "#a $b %%\n\n|<>&*\n#a $b %%"), (83, " ".join(words(30, 2) * 2))]
    out = quality_rules.features(table(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out) == sorted((i or 0, *_counts(t)) for i, t in rows)
    assert quality_rules.features(none).count() == 0


def test_binomial_tail(spark):
    cases = [(0, 5, 0.01), (3, 500, 0.01), (0, 20, 0.2), (700, 100000, 0.01), (15, 2000, 0.01), (1, 17, 0.3)]
    for k, n, p in cases:
        got = spark.range(1).select(quality_rules.binomial_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), p)).first()[0]
        want = math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p)) for j in range(k + 1))
        assert got == pytest.approx(want, rel=1e-8)


def test_cutoffs_keep_good_documents(spark, none):
    draw = random.Random(2)
    rows, labels = [], []
    for i in range(3000):
        bad = i % 5 == 0
        w = words(draw.randrange(150, 250), i, 5000)
        rows.append((i, " ".join(x + "###" if bad else x for x in w)))
        labels.append((i, 0 if bad else 1))
    df = table(spark, rows)
    found = spark.createDataFrame(labels, "doc_id long, quality int")
    out = {r.doc_id: r for r in quality_rules.judged(df, found).collect()}
    good = [out[i].kept for i, q in labels if q]
    assert sum(good) >= 0.95 * len(good) and not any(out[i].kept for i, q in labels if not q)
    assert all(r.kept == (not r.base_failed) for r in quality_rules.judged(df, found.where("false")).collect())
    few = quality_rules.cutoffs(quality_rules.with_rules(quality_rules.features(df)), found.where("doc_id < 150")).collect()
    assert [(r.stratum, r.n_good, r.n_rejected) for r in few] == [(1, 120, 0)]  # 120 good documents without a false rejection suffice
    assert not quality_rules.cutoffs(quality_rules.with_rules(quality_rules.features(df)), found.where("doc_id < 100")).collect()
    assert quality_rules.judged(none, found).count() == 0


def test_classifier_learns_and_scores_everything(spark, docs, none):
    rows = [(i, " ".join(x + ("%%%" if i % 2 else "") for x in words(40, i))) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(200)] + [(None, 1), (3, None)], "doc_id long, quality int")
    model = quality_cnn.learned(df, labels, F.col("doc_id") % 3 != 1)
    held = [(i, s) for i, s in ((r.doc_id, r.quality_score) for r in quality_cnn.scored(df, model).collect()) if i % 3 == 1]
    assert sum((s >= 0.5) == (i % 2 == 0) for i, s in held) >= 0.97 * len(held)
    scores = [r.quality_score for r in quality_cnn.scored(docs, model).collect()]
    assert len(scores) == len(corpus()) and all(0 <= s <= 1 for s in scores)
    assert quality_cnn.scored(none, model).count() == 0 and 0 <= quality_cnn.learned(none, labels.where("false"), F.lit(True)).score([b"", b"x"])[0] <= 1
    alone = [model.score([t])[0] for t in (b"", b"abc", b"x" * 70)]
    assert list(model.score([b"", b"abc", b"x" * 70])) == pytest.approx(alone)


def test_classifier_agrees_with_a_plain_convolution_and_its_gradient():
    model, texts = quality_cnn.ConvolutionalScorer(3), [b"", b"abc", b"some words here and there", b"%%%%" * 9]
    width, stride, p = quality_cnn.WIDTH, quality_cnn.STRIDE, model.parts

    def plain(text):
        padded = text + b"\0" * (width + stride)
        places = range(0, max(len(text), 1), stride)
        seen = [sum(p["embedding"][padded[at + k]] @ p["filters"][k] for k in range(width)) for at in places]
        return 1 / (1 + math.exp(-(np.tanh(np.max(seen, 0) + p["bias"]) @ p["out"] + p["out_bias"][0])))

    assert model.score(texts) == pytest.approx([plain(t) for t in texts], abs=1e-5)
    # One step of learning lowers the loss of the texts it was shown.
    loss = lambda m: -sum(math.log(s if y else 1 - s) for s, y in zip(m.score(texts[1:]), (1, 1, 0), strict=True))
    first = loss(model)
    again = quality_cnn.ConvolutionalScorer(3).fit(texts[1:], [1, 1, 0])
    assert loss(again) < first / 4


def test_long_texts_are_walked_in_chunks_without_a_seam():
    draw = random.Random(3)
    text = " ".join(words(3000, 8, 900)).encode() + bytes(draw.randrange(256) for _ in range(999))
    model = langid.LanguageModel({"x": [text[:4000]], "y": [text[9000:12000]]})
    for piece in (7, 100, 4096):
        assert model.bits([text], piece)[0] == pytest.approx(model.bits([text])[0], rel=1e-5)
    scorer = quality_cnn.ConvolutionalScorer()
    whole = scorer.score([text])[0]
    held, begin, end = scorer._held([text])
    best = scorer._responses(held, scorer._tables)[begin[0] : end[0]].max(0)
    for piece in (8, 100, 4096):
        assert scorer._walked(text, piece)[0] == pytest.approx(best)
    long = text * (1 + (1 << 21) // len(text))
    assert 0 <= scorer.score([long])[0] <= 1 and whole >= 0 and model.predict([long])[0][0] in ("x", "y")


def test_index_finds_all_and_no_others():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64))
    index = Index(keys[::2])
    assert (index.find(keys[::2]) == np.arange(len(keys[::2]))).all() and (index.find(keys[1::2]) == -1).all()
    assert (Index(keys[:0]).find(keys[:3]) == -1).all()
