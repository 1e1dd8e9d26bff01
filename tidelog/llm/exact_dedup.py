"""Exact deduplication by 128-bit content hash with byte comparison inside hash groups; DataFrame functions only."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, text_or_empty, unused

#: Salts of the two 64-bit halves of the content hash.
SALTS = (17, 5003)
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def normalised(column: str = "text") -> Column:
    """The text without white space; null counts as empty."""
    return F.regexp_replace(text_or_empty(column), f"{SPACE}++", "")


def _with_keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    norm = normalised(text_col)
    rows = docs.select(F.col(id_col).alias("_id"), F.length(text_or_empty(text_col)).alias("_len"), norm.alias("_norm"))
    return rows.select("*", F.xxhash64(F.lit(SALTS[0]), "_norm").alias("_h1"), F.xxhash64(F.lit(SALTS[1]), "_norm").alias("_h2"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without white space. The row with the most code points in the
    original text stays, then that with the smallest id. Null text: empty. A null id is taken only
    when its whole group has none. Rows that repeat the kept id and text are all marked kept
    (`deduplicated` returns one of them). Empty table: empty result. Other columns are not read.

    The aggregation groups by hash and normalised bytes, so a hash collision yields two groups; the
    partial aggregation folds a hot text to one row for each task before the shuffle. The 128 bits
    and SHA-256 then attach each row to its group in a join that adaptive execution can split.
    """
    integral = isinstance(docs.schema[id_col].dataType, _INTEGRAL)
    keyed = _with_keys(docs, id_col, text_col)
    if integral:
        # One decimal orders by length, then by smaller id, and lets the hash aggregate keep it in place.
        wide = T.DecimalType(38, 0)
        low = F.lit(2**63 - 1).cast(T.DecimalType(20, 0)) - F.col("_id").cast(T.DecimalType(20, 0))
        rank = (F.col("_len").cast(T.DecimalType(11, 0)) * F.lit(Decimal(10**20)) + low).cast(wide)
        agg = F.max(rank).alias("_best")
        best = (F.lit(2**63 - 1).cast(T.DecimalType(20, 0)) - F.pmod(F.col("_best"), F.lit(Decimal(10**20)))).cast(docs.schema[id_col].dataType)
    else:
        agg = F.min(F.when(F.col("_id").isNotNull(), F.struct((-F.col("_len")).alias("l"), F.col("_id").alias("i")))).alias("_best")
        best = F.col("_best.i")
    groups = (
        keyed.groupBy("_h1", "_h2", "_norm")
        .agg(agg, F.count(F.lit(1)).alias("group_size"))
        .select("_h1", "_h2", F.sha2("_norm", 256).alias("_sha"), best.alias("keep_id"), "group_size")
    )
    rows = keyed.select("_id", "_h1", "_h2", F.sha2("_norm", 256).alias("text_sha256"))
    same = (rows["_h1"] == groups["_h1"]) & (rows["_h2"] == groups["_h2"]) & (rows["text_sha256"] == groups["_sha"])
    return rows.join(groups, same).select(
        F.col("_id").alias(id_col), "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that repeat another's text, all its columns, whatever their names; of repeated rows one stays."""
    sha, kept_id, kept_sha = (unused(docs, name) for name in ("_sha", "_kept_id", "_kept_sha"))
    kept = exact_groups(docs, id_col, text_col).where("kept").select(F.col(id_col).alias(kept_id), F.col("text_sha256").alias(kept_sha)).distinct()
    rows = docs.withColumn(sha, F.sha2(normalised(text_col), 256))
    out = rows.join(kept, F.col(id_col).eqNullSafe(F.col(kept_id)) & (F.col(sha) == F.col(kept_sha)), "left_semi")
    return out.dropDuplicates([id_col, sha]).select(*[out[c] for c in docs.columns])
