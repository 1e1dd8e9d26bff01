"""What a host is told: state of each collection, its queue and files, counters and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import BLOB, COLLECTION, MOVING
from .replica import dirty

#: So many open conflicts of a live collection call for attention.
ATTENTION = 20


def published_phase(phase: Column, conflicts: Column, threshold: int = ATTENTION) -> Column:
    return F.when((phase == "LIVE") & (conflicts >= threshold), "NEEDS_ATTENTION").otherwise(phase)


def pending(records: DataFrame) -> DataFrame:
    return records.groupBy(*COLLECTION).agg(F.count_if(dirty()).alias("pending"))


def pending_of_scopes(records: DataFrame) -> DataFrame:
    """Changes never confirmed in each scope; signing out with any is refused."""
    return records.groupBy("scope_id").agg(F.count_if(dirty()).alias("pending"))


def states(replicas: DataFrame, records: DataFrame, conflicts: DataFrame, files: DataFrame, refs: DataFrame, threshold: int = ATTENTION) -> DataFrame:
    """One row for each collection: phase as published, pending, conflicts, files to upload and to download, last error."""
    open_conflicts = conflicts.groupBy(*COLLECTION).agg(F.count(F.lit(1)).alias("conflicts"))
    moving = files.where(F.col("wanted") & F.col("state").isin(*MOVING)).join(refs.select(*BLOB).distinct(), BLOB, "left_semi")
    up = F.col("state").isin("LOCAL", "UPLOADING")
    moves = moving.groupBy(*COLLECTION).agg(F.count_if(up).alias("uploads"), F.count_if(~up).alias("downloads"))
    out = replicas
    for part in (pending(records), open_conflicts, moves):
        out = out.join(part, COLLECTION, "left")
    out = out.na.fill(0, ["pending", "conflicts", "uploads", "downloads"])
    return out.select(*COLLECTION, published_phase(F.col("phase"), F.col("conflicts"), threshold).alias("phase"), "pending", "conflicts", "uploads", "downloads", "last_error", "failure_count")


def queue(groups: DataFrame, records: DataFrame) -> DataFrame:
    """Groups in order with the dirty operations of each."""
    ops = records.where(dirty()).groupBy("group_id").agg(F.count(F.lit(1)).alias("operations"))
    return groups.join(ops, "group_id", "left").na.fill(0, ["operations"]).orderBy(*COLLECTION, "ord")


def queue_status(groups: DataFrame, files: DataFrame) -> DataFrame:
    """COLLECTION, groups, head state, is_blocked (head waits for a decision), is_waiting_on_files (not blocked, uploads outstanding)."""
    head = groups.groupBy(*COLLECTION).agg(F.count(F.lit(1)).alias("groups"), F.min_by("state", "ord").alias("head_state"))
    up = files.where(F.col("state").isin("LOCAL", "UPLOADING")).select(*COLLECTION).distinct().withColumn("_up", F.lit(True))
    blocked = F.col("head_state").isin("CONFLICTED", "FAILED")
    return head.join(up, COLLECTION, "left").select(*COLLECTION, "groups", "head_state", blocked.alias("is_blocked"), (~blocked & F.coalesce("_up", F.lit(False))).alias("is_waiting_on_files"))


def newly_blocked(before: DataFrame, now: DataFrame) -> DataFrame:
    """Collections whose queue became blocked between two statuses: each edge is reported once."""
    was = before.where("is_blocked").select(*COLLECTION)
    return now.where("is_blocked").join(was, COLLECTION, "left_anti")


def refusals(groups: DataFrame) -> DataFrame:
    return groups.where("state = 'FAILED'").select(*COLLECTION, "group_id", "ord", "reject_code", "reject_entity_type", "reject_entity_id", "last_error").orderBy(*COLLECTION, "ord")


def latest(events: DataFrame, at: str = "at", most: int = 500) -> DataFrame:
    """The last events, as a ring buffer would hold them."""
    return events.orderBy(F.desc(at)).limit(most)


def push_outcomes(verdicts: DataFrame) -> DataFrame:
    """Groups and operations answered, by outcome."""
    return verdicts.groupBy(*COLLECTION, "status").agg(F.count(F.lit(1)).alias("groups"))
