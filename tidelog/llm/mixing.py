"""Mixing sources to target weights: hash-random order in each source, prefix sums of sizes, exact cuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, WORD, ranged, stored, text_or_empty, unused

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_EPOCHS = 2
SEED = "mix-1"


def _weighed(sizes: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """sizes (_source, source_size) with `weight`: weights in turn by the order of _source."""
    placed = stored(ranged(sizes, [F.col("_source")]), "mix-sources")
    parts = placed.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))  # one row for each partition
    parts = parts.select("_pid", (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_first"))
    turn = ((F.col("_first") + F.col("_idx")) % len(weights)).cast("int") + 1
    return placed.join(F.broadcast(parts), "_pid").select("_source", "source_size", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn).alias("weight"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: float = MOST_EPOCHS) -> DataFrame:
    """sizes (_source, source_size) with `target`: share of all sizes by weight; a target stops at epochs times its size.

    The excess is shared anew by weight until none is above. Only the words for a weight of one, a
    number, comes to the driver; it rises from round to round, so sources that are full stay so.
    """
    rows = stored(_weighed(sizes, weights), "mix-weights")
    total, unit = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0], 0.0
    while True:
        full = unit * F.col("weight") >= F.col("source_size") * epochs
        free, filled = rows.agg(F.sum(F.when(~full, F.col("weight"))), F.coalesce(F.sum(F.when(full, F.col("source_size"))), F.lit(0))).first()
        now = (share * total - epochs * filled) / free if free else unit
        if now <= unit:
            break
        unit = now
    return rows.select("_source", "source_size", F.round(F.when(full, F.col("source_size") * float(epochs)).otherwise(F.lit(unit) * F.col("weight")), 6).alias("target"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: int = MOST_EPOCHS, seed: str = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of docs: doc_id, source, size, source_size, target, taken, before, and its columns keep.

    size: words of the text (null: 0). Sources stand by code point, null last, and weigh `weights`
    in turn. Documents of a source are taken in the order of md5(seed:doc_id); whole epochs first,
    then up to the exact remaining budget, so that the last document is taken in part. `before`:
    words of the source that precede the document in that order. Equal ids tie by size, then by
    keep; ids are kept exactly, null or beyond 2**53. A source of size 0 has target 0. Other columns
    are not read. Empty table: empty result. Nothing that grows with rows or sources comes to the driver.
    """
    rows = docs.select(
        "doc_id",
        "source",
        *keep,
        F.coalesce(F.concat(F.lit("0"), "source"), F.lit("1")).alias("_source"),
        F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")).alias("_key"),
    )
    rows = stored(rows, "mix-sizes")  # the range partitioner samples its input, which would count words twice
    placed = ranged(rows, [F.col("_source"), F.col("_key"), F.col("doc_id"), F.col("size"), *map(F.col, keep)])
    placed = stored(placed.drop("_key"), "mix")
    parts = placed.groupBy("_source", "_pid").agg(F.sum("size").alias("_sum"))
    parts = stored(parts.withColumn("_offset", F.sum("_sum").over(Window.partitionBy("_source").orderBy("_pid")) - F.col("_sum")), "mix-parts")
    plan = targets(parts.groupBy("_source").agg(F.sum("_sum").alias("source_size")), weights, share, epochs)
    parts = parts.join(plan, "_source").select("_source", "_pid", "_offset", "source_size", "target")
    within = F.sum("size").over(Window.partitionBy("_source", "_pid").orderBy("_idx")) - F.col("size")
    budget = F.floor(F.col("target") + 0.5)
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    before = F.col("_within") + F.col("_offset")
    rest = F.least(F.greatest(budget - whole * F.col("source_size") - before, F.lit(0)), F.col("size"))
    return placed.withColumn("_within", within).join(parts, ["_source", "_pid"]).select(
        "doc_id", "source", "size", "source_size", "target", (whole * F.col("size") + rest).cast("long").alias("taken"), before.alias("before"), *keep
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself with the columns of docs: whole copies and, for a document cut at its source's budget, its first words.

    Each row is taken as the mix plans for it, whatever rows have the same id or none; documents
    with nothing taken are absent. A cut text is the text as it stands up to its last word taken;
    n_chars, where there is one, is its length then. The rows are stored with a key of their own;
    columns of docs may have any names.
    """
    row, size, taken, cut = (unused(docs, name) for name in ("_row", "_size", "_taken", "_cut"))
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "mix-rows")
    plan = mixed(rows.select("doc_id", "source", "text", row), **options, keep=(row,))
    rows = rows.join(plan.where("taken > 0").select(row, F.col("size").alias(size), F.col("taken").alias(taken)), row)
    whole, rest = F.floor(F.col(taken) / F.col(size)).cast("int"), F.col(taken) % F.col(size)
    none = F.array().cast("array<long>")
    copies = F.concat(F.when(whole > 0, F.array_repeat(F.lit(-1).cast("long"), whole)).otherwise(none), F.when(rest > 0, F.array(rest)).otherwise(none))
    words = F.regexp_extract_all("text", F.lit(f"{SPACE}*{WORD}"), F.lit(0))  # with the white space before each
    text = F.when(F.col(cut) < 0, F.col("text")).otherwise(F.array_join(F.slice(words, F.lit(1), F.greatest(F.col(cut), F.lit(1)).cast("int")), ""))
    out = rows.withColumn(cut, F.explode(copies)).withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(cut) < 0, F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)
