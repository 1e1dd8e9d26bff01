"""Retention, erasure and their reports, over all collections at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import BLOB, COLLECTION, LOG_TABLES, shaped

#: Tables of a collection, children first.
ERASED = ("changes", "batches", "entities", "push_results", "blob_refs", "blobs", "collections")


def floors(collections: DataFrame, batches: DataFrame, cutoff: Column) -> DataFrame:
    """COLLECTION, floor: the first batch committed at or after cutoff, or next_seq; never below the present floor."""
    first = batches.groupBy(*COLLECTION).agg(F.min(F.when(F.col("committed_at") >= cutoff, F.col("seq"))).alias("_first"))
    rows = collections.join(first, COLLECTION, "left")
    return rows.select(*COLLECTION, F.greatest(F.coalesce("_first", "next_seq"), "retention_floor_seq").alias("floor"), "next_seq")


def trimmed(state: dict[str, DataFrame], found: DataFrame) -> dict[str, DataFrame]:
    """collections, batches, changes and entities after raising the floors: older batches go with their changes, older tombstones too."""
    floor = found.select(*COLLECTION, "floor")
    low = lambda df, seq: df.join(floor, COLLECTION, "left").where(F.col(seq) >= F.coalesce("floor", F.lit(0))).drop("floor")
    entities = state["entities"].join(floor, COLLECTION, "left").where(~(F.col("is_deleted") & (F.col("last_seq") < F.coalesce("floor", F.lit(0))))).drop("floor")
    collections = state["collections"].join(floor, COLLECTION, "left").withColumn("retention_floor_seq", F.coalesce("floor", "retention_floor_seq"))
    return {
        "collections": shaped(collections, LOG_TABLES["collections"]),
        "batches": shaped(low(state["batches"], "seq"), LOG_TABLES["batches"]),
        "changes": shaped(low(state["changes"], "seq"), LOG_TABLES["changes"]),
        "entities": shaped(entities, LOG_TABLES["entities"]),
    }


def trim_report(batches: DataFrame, entities: DataFrame, found: DataFrame) -> DataFrame:
    """COLLECTION, removed batches, swept tombstones, retained span."""
    floor = found.select(*COLLECTION, "floor", "next_seq")
    gone = batches.join(floor, COLLECTION).where("seq < floor").groupBy(*COLLECTION).agg(F.count(F.lit(1)).alias("removed"))
    swept = entities.join(floor, COLLECTION).where("is_deleted and last_seq < floor").groupBy(*COLLECTION).agg(F.count(F.lit(1)).alias("swept"))
    out = floor.join(gone, COLLECTION, "left").join(swept, COLLECTION, "left")
    return out.select(*COLLECTION, F.coalesce("removed", F.lit(0)).alias("removed"), F.coalesce("swept", F.lit(0)).alias("swept"), (F.col("next_seq") - F.col("floor")).alias("retained"))


def in_target(scope: str, collection: str | None = None) -> Column:
    own = F.col("scope_id") == scope
    return own & (F.col("collection_id") == collection) if collection is not None else own


def purge_report(state: dict[str, DataFrame], target: Column) -> DataFrame:
    """COLLECTION and how many rows of each table an erasure takes."""
    rows = None
    for name in ERASED:
        one = state[name].where(target).groupBy(*COLLECTION).agg(F.count(F.lit(1)).alias("n")).withColumn("table", F.lit(name))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy(*COLLECTION).pivot("table", list(ERASED)).agg(F.sum("n")).na.fill(0)


def purged(state: dict[str, DataFrame], target: Column) -> dict[str, DataFrame]:
    return {name: state[name].where(~F.coalesce(target, F.lit(False))) for name in ERASED}


def added(reports: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sum of reports, and whether they are empty."""
    numbers = [c for c, t in reports.dtypes if t in ("bigint", "int")]
    total = reports.groupBy(*(by or [])).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in numbers])
    empty = F.lit(True)
    for c in numbers:
        empty = empty & (F.col(c) == 0)
    return total.withColumn("is_empty", empty)


def without_blobs(state: dict[str, DataFrame], collected: DataFrame) -> dict[str, DataFrame]:
    """blobs and blob_refs after collected ones are gone."""
    ids = collected.select(*BLOB).distinct()
    return {"blobs": state["blobs"].join(ids, BLOB, "left_anti"), "blob_refs": state["blob_refs"].join(ids, BLOB, "left_anti")}


def targets(collections: DataFrame) -> DataFrame:
    """All collections, registered or not."""
    return collections.select(*COLLECTION).distinct().orderBy(*COLLECTION)
