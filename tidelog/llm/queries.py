"""Registered queries of the operators and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, langid, lm_ppm, mixing, ngram_join, packing, quality_cnn, quality_rules, sharding, warc
from .common import hashed_part


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    old = F.pmod(F.xxhash64("source"), F.lit(16))  # the old layout keeps a source together, so its shards are uneven
    text = F.coalesce("text", F.lit(""))
    size = (F.octet_length(text) + sharding.ROW_BYTES).cast("long").alias("size")
    out = sharding.resharded(docs, old, 24, [F.col("doc_id"), size, F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law")])
    return out.withColumn("grown_shard", F.lit(None).cast("int"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = hashed_part(F.col("doc_id"), 3)
    model = quality_cnn.learned(docs, _table(spark, sf_dir, "labels"), fold != 1)
    out = quality_cnn.scored(docs.withColumn("held_out", fold == 1), model)
    score = F.col("quality_score").alias("score")
    return out.select("doc_id", "held_out", score, F.when(F.col("quality_score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, index = warc.write_archives(_table(spark, sf_dir, "pages"))
    return warc.read_records(root, index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    fold = hashed_part(F.col("doc_id"), 5)
    model = langid.learned(docs, fold != 0)
    rows = docs.select("doc_id", "text", (fold == 0).alias("held_out"))
    return langid.identified(rows, model).select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents"), words=3, num=9, den=10)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.packed(packing.pieces(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = hashed_part(F.col("doc_id"), 7)
    corpus = lm_ppm.learned(docs, fold != 2)
    return lm_ppm.scored(docs.withColumn("held_out", fold == 2), corpus).drop("text")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judged(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.drop("rejected_by")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_sharding, op2_quality_classifier, op3_exact_dedup, op4_warc, op5_language_id, op6_ngram_jaccard, op7_best_fit_packing, op8_lm_scoring, op9_quality_rules, op10_mixing)}

OP3_SQL = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS len, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT norm, count(*) AS group_size, arg_min(doc_id, (-len, doc_id)) AS keep_id FROM n GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM n JOIN g USING (norm)
"""

OP4_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, html, min(page_id) OVER (PARTITION BY html) AS first_id, sha1(html) AS hex FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((CAST('0x' || substr(hex, CAST(5 * (i // 4) + 1 AS INT), 5) AS BIGINT) >> CAST(5 * (3 - i % 4) AS INT)) & 31 AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM d
"""

OP6_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i + 2], ' ')) END) AS grams FROM w),
n AS (SELECT doc_id, CAST(len(grams) AS BIGINT) AS n_shingles FROM s),
e AS (SELECT doc_id, unnest(grams) AS gram FROM s),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS common FROM e a JOIN e b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM p JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * common >= 90 * (a.n_shingles + b.n_shingles - common)),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM n UNION SELECT l.v, r.root FROM r JOIN l ON l.u = r.doc_id WHERE r.root < l.v)
SELECT n.doc_id, n_shingles, least(n.doc_id, min(root)) AS component_id FROM n JOIN r ON n.doc_id = r.doc_id GROUP BY n.doc_id, n_shingles
"""

OP10_SQL = r"""
WITH s AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5('mix-1:' || CAST(doc_id AS VARCHAR)) AS k FROM documents),
w AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight FROM s GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY 2.0 * source_size / weight, source NULLS LAST) AS pos FROM w),
f AS (SELECT *, 1.5 * (sum(source_size) OVER ()) - coalesce(sum(2.0 * source_size) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining,
    sum(weight) OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight FROM r),
cut AS (SELECT pos, remaining / open_weight AS unit FROM f WHERE remaining / open_weight * weight < 2.0 * source_size ORDER BY pos LIMIT 1),
t AS (SELECT f.source, source_size, round(CASE WHEN cut.pos IS NULL OR f.pos < cut.pos THEN 2.0 * source_size ELSE cut.unit * weight END, 6) AS target
    FROM f LEFT JOIN cut ON true),
d AS (SELECT s.doc_id, s.size, t.source_size, t.target, floor(t.target + 0.5) AS budget,
    sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) - s.size AS before
    FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target,
  CAST(CASE WHEN source_size = 0 THEN 0 ELSE floor(budget / source_size) * size
    + least(greatest(budget - floor(budget / source_size) * source_size - before, 0), size) END AS BIGINT) AS taken FROM d
"""

_R = quality_rules
_LEVELS = ", ".join(f"({level}, {', '.join(str(c) for c in cutoffs)})" for level, cutoffs in enumerate(zip(*_R.RULES.values(), strict=True)))
_LIMITS = ", ".join(f"c_{rule}" for rule in _R.RULES)
_BROKEN = " OR ".join(f"{rule} > c_{rule}" for rule in _R.RULES)
_SHARE, _LEAST = _R.FALSE_REJECTION, _R.FAILURE / (len(_R.STRATA) + 1)
OP9_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
windows AS (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM windows) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id),
lines AS (SELECT doc_id, len(l) AS n, len(list_distinct(l)) AS u FROM (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d)),
f AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, CAST(lines.n - u AS BIGINT) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, lines.n AS n_lines
    FROM w JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
m AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    CASE WHEN n_words < {_R.STRATA[0]} THEN 0 WHEN n_words < {_R.STRATA[1]} THEN 1 WHEN n_words < {_R.STRATA[2]} THEN 2 ELSE 3 END AS stratum,
    n_symbols / greatest(n_words, 1) AS symbol_ratio, n_dup_lines / greatest(n_lines, 1) AS dup_line_ratio, n_repeat_words / greatest(n_words, 1) AS repeat_ratio, word_chars / greatest(n_words, 1) AS mean_word_chars FROM f),
good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING max(quality) = 1),
levels(level, {_LIMITS}) AS (VALUES {_LEVELS}),
k AS (SELECT stratum, level, count(*) AS n, count(*) FILTER ({_BROKEN}) AS k FROM m JOIN good USING (doc_id) CROSS JOIN levels WHERE NOT base_failed GROUP BY ALL),
passes AS (SELECT stratum, level, k < n * {_SHARE} AND
    list_sum(list_transform(range(k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({_SHARE}) + (n - j) * ln(1 - {_SHARE})))) <= {_LEAST} AS ok FROM k),
best AS (SELECT stratum, min(level) AS level FROM passes p WHERE NOT EXISTS (SELECT 1 FROM passes q WHERE q.stratum = p.stratum AND q.level >= p.level AND NOT q.ok) GROUP BY stratum),
cut AS (SELECT stratum, {_LIMITS} FROM best JOIN levels USING (level))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT EXISTS (SELECT 1 FROM cut WHERE cut.stratum = m.stratum AND ({_BROKEN})) AS kept FROM m
"""

ORACLE_SQL = {"op3_exact_dedup": OP3_SQL, "op4_warc": OP4_SQL, "op6_ngram_jaccard": OP6_SQL, "op9_quality_rules": OP9_SQL, "op10_mixing": OP10_SQL}
