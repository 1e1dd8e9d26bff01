"""The pipeline's stages on a small corpus, each against brute force on what its predecessor kept."""

import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_operators import SPACE, WORD, _components, brute_targets, words
from tokenizers import Tokenizer

import corpus_pipeline
from tidelog.llm import langid
from tidelog.llm.common import hashed_part

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rows, base = [], words(90, 1)
    for i in range(24):
        rows.append((i, " ".join(words(40 + i, 50 + i)), "en", f"src{i % 3}"))
    rows += [(30, " ".join(base), "en", "src0"), (31, "\n".join(base), "en", "src1"), (32, " ".join([*base[:-2], "x", "y"]), "en", "src1"), (33, "12 34 !!", "en", "src0"), (34, None, None, None), (35, "", "en", "src2")]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(path / "documents.parquet"))
    return str(path)


def test_stages_and_run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = []
    for _, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, sf_dir)
        kept.append((before.collect(), docs.collect()))
    for before, after in kept[:4]:
        assert list(after[0].asDict()) == COLUMNS and len(before) >= 1
    # language: what has letters stays
    assert {r.doc_id for r in kept[0][1]} == {r.doc_id for r in kept[0][0] if re.search("[a-z]", r.text or "")}
    model = langid.learned(spark.read.parquet(f"{sf_dir}/documents.parquet"), hashed_part(F.col("doc_id"), 5) != 0)
    assert model.languages == ["en"]
    # copies: the longest, then the smallest id
    groups = {}
    for r in kept[1][0]:
        groups.setdefault(SPACE.sub("", r.text), []).append((-len(r.text), r.doc_id))
    assert {r.doc_id for r in kept[1][1]} == {min(g)[1] for g in groups.values()}
    # near copies: the smallest id of each component
    near = _components([(r.doc_id, r.text) for r in kept[2][0]], 5, 8, 10)
    assert {r.doc_id for r in kept[2][1]} == {i for _, i, _, c in near if i == c} and 32 not in {r.doc_id for r in kept[2][1]}
    # the mix: each source at its target in words
    size = lambda t: len(WORD.findall(t or ""))
    sources = sorted({r.source for r in kept[3][0]})
    sizes = [sum(size(r.text) for r in kept[3][0] if r.source == s) for s in sources]
    for source, target in zip(sources, brute_targets(sizes, [5, 2, 1][: len(sources)]), strict=True):
        assert sum(size(r.text) for r in kept[3][1] if r.source == source) == int(target + 0.5)
    assert all(r.n_chars == len(r.text) for r in kept[3][1])
    # sequences: all tokens of the mix, each placed once
    tokenizer = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    want = sorted((r.doc_id, len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1) for r in kept[4][0])
    assert sorted((r.doc_id, r.length) for r in kept[4][1]) == want
    used = {}
    for r in corpus_pipeline.run(spark, sf_dir).collect():
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in used.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 2048
    assert sum(n for own in used.values() for _, n in own) == sum(n for _, n in want)
