"""Documents are JSON objects; a patch overwrites whole top-level keys and keeps explicit nulls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = "map<string,variant>"


def fields(text: Column) -> Column:
    """Top-level fields of a JSON object; null text: none."""
    return F.coalesce(F.parse_json(text).cast(FIELDS), F.create_map().cast(FIELDS))


def merged(stored: Column, patch: Column) -> Column:
    """stored + patch as JSON text with keys in alphabetical order. Null stored (absent, tombstone): the patch alone."""
    new = fields(patch)
    kept = F.map_filter(fields(stored), lambda k, _: ~F.array_contains(F.map_keys(new), k))
    return canonical_fields(F.map_concat(kept, new))


def canonical_fields(doc: Column) -> Column:
    """JSON text of fields, keys in order, so that equal documents have equal text."""
    ordered = F.array_sort(F.map_keys(doc))
    parts = F.transform(ordered, lambda k: F.concat(F.to_json(F.struct(k.alias("k"))).substr(F.lit(6), F.length(F.to_json(F.struct(k.alias("k")))) - 6), F.lit(":"), F.coalesce(F.to_json(F.element_at(doc, k)), F.lit("null"))))
    return F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))


def document_bytes(text: Column) -> Column:
    """UTF-8 bytes of a document as written; null: 0."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def folded(patches: DataFrame, keys: list[str], order: list[str], op: str = "op", data: str = "data") -> DataFrame:
    """State of each entity after all its changes: keys, version order columns of the last change, is_deleted, data.

    A delete empties the document; later patches start from nothing. Set-based: each field takes its
    last value after the last delete, so a long history needs no row-by-row fold.
    """
    at = F.struct(*order)
    ends = patches.groupBy(*keys).agg(F.max(at).alias("_last"), F.max(F.when(F.col(op) == "delete", at)).alias("_gone"))
    live = patches.join(ends.select(*keys, "_gone"), keys).where((F.col(op) != "delete") & (F.col("_gone").isNull() | (at > F.col("_gone"))))
    each = live.select(*keys, at.alias("_at"), F.explode(fields(F.col(data))).alias("_k", "_v"))
    last = each.groupBy(*keys, "_k").agg(F.max_by("_v", "_at").alias("_v"))
    docs = last.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_k", "_v"))).alias("_doc"))
    alive = live.select(*keys).distinct().withColumn("_alive", F.lit(True))
    out = ends.join(alive, keys, "left").join(docs, keys, "left")
    text = F.when(F.col("_alive"), F.coalesce(canonical_fields(F.col("_doc")), F.lit("{}")))
    return out.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in order], F.col("_alive").isNull().alias("is_deleted"), text.alias(data))
