"""Helpers of the training-data operators: text patterns, folds, distributed ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranks import ranged  # noqa: F401
from ..sources.shared import new_path, release, stored  # noqa: F401

#: One white-space character; everything else belongs to a word.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


#: Most bytes of rows that go to a Python worker at once; a single longer row stands alone.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def batched(spark: SparkSession) -> SparkSession:
    """spark with Arrow batches of at most BATCH_BYTES, so that workers hold little whatever the texts' lengths; a smaller setting stays."""
    given = spark.conf.get(_BATCH).rstrip("bB")
    if not given.isdigit() or not 0 < int(given) <= BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    return spark


def unused(df: DataFrame, name: str) -> str:
    """name, or name with underscores after it, so that no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def reserved(df: DataFrame, *names: str) -> None:
    """Refuse columns whose names an operator uses for itself."""
    clash = sorted({n.lower() for n in names} & {c.lower() for c in df.columns})
    if clash:
        raise ValueError(f"columns named {', '.join(clash)} are reserved: rename them")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def hashed_part(column: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus; null ids count as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


def let(value: Column, body) -> Column:
    """body(value) with value computed once for each row, inside whatever expression needs it."""
    return F.transform(F.array(value), body)[0]
