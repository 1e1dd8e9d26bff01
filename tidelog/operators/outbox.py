"""The outbox: queueing edits in groups, choosing what to send, and what an answer does to the queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.documents import document_bytes
from ..functions.tokens import backoff_limit
from ..schema import COLLECTION, ENTITY, REPLICA_TABLES, shaped
from .components import components
from .replica import dirty

#: A group merged so often after a dependency refusal fails.
MOST_DEPENDENCY_MERGES = 8
#: States of a file in which a record that requires it may be sent, and in which a reference to it is not declared.
SENDABLE = ("UPLOADED", "READY", "REMOTE", "DOWNLOADING")
UNDECLARED = ("LOCAL", "UNAVAILABLE", "REFUSED")
#: Fields of an operation as it is sent.
WIRE = ("op", "entity_type", "entity_id", "base_version", "data", "blobs")


def _new_groups(rows: DataFrame) -> DataFrame:
    """rows (group_id, COLLECTION, ord, ...) as fresh pending groups."""
    filled = {c: F.lit(v) for c, v in {"state": "PENDING", "attempts": 0}.items()}
    if "dependency_merges" not in rows.columns:
        filled["dependency_merges"] = F.lit(0)
    return shaped(rows.withColumns(filled), REPLICA_TABLES["groups"])


def assignments(marks: DataFrame, records: DataFrame, groups: DataFrame) -> DataFrame:
    """marks with `pinned` (the group on the wire that keeps an entity), `pending` (the queued group that holds it)."""
    held = records.select(*ENTITY, F.col("group_id").alias("_g"))
    states = groups.select(F.col("group_id").alias("_g"), F.col("state").alias("_state"))
    rows = marks.join(held, ENTITY, "left").join(states, "_g", "left")
    return rows.select(*marks.columns, F.when(F.col("_state") == "IN_FLIGHT", F.col("_g")).alias("pinned"), F.when(F.col("_state") == "PENDING", F.col("_g")).alias("pending"))


def group_components(assigned: DataFrame) -> DataFrame:
    """Transactions and pending groups that belong together: kind ('tx' or 'group'), id, component.

    A transaction is linked with the pending groups of its entities and with other transactions that
    mark the same entity; entities on the wire link nothing. Labels are 64-bit hashes of the ids.
    """
    free = assigned.where("pinned is null")
    tx = F.xxhash64(F.lit("tx"), *COLLECTION, F.col("tx"))
    group = F.xxhash64(F.lit("group"), F.col("pending"))
    entity = F.xxhash64(F.lit("entity"), *ENTITY)
    links = free.where("pending is not null").select(tx.alias("u"), group.alias("v")).unionAll(free.select(tx.alias("u"), entity.alias("v")))
    roots = components(links)
    nodes = free.select(F.lit("tx").alias("kind"), F.col("tx").cast("string").alias("id"), *COLLECTION, tx.alias("node"))
    nodes = nodes.unionAll(free.where("pending is not null").select(F.lit("group"), F.col("pending"), *COLLECTION, group.alias("node"))).distinct()
    return nodes.join(roots, "node").select("kind", "id", *COLLECTION, F.col("root").alias("component"))


def queued(marks: DataFrame, records: DataFrame, groups: DataFrame, generations: DataFrame, new_id: Column) -> tuple[DataFrame, DataFrame]:
    """records and groups after edits.

    marks: COLLECTION, tx (a number, in order), ENTITY, intent. Pending groups that share an edited
    entity, directly or through other transactions, become one: the one of smallest ord. An entity
    on the wire keeps its group; one in a conflicted or failed group moves to the transaction's.
    Nothing pending: a new group at the end of the queue, in the order of transactions. new_id: an
    expression over COLLECTION and component. generations: COLLECTION, generation.
    """
    assigned = assignments(marks, records, groups)
    parts = group_components(assigned)
    merged = parts.where("kind = 'group'").select(F.col("id").alias("group_id"), "component").join(groups.select("group_id", "ord"), "group_id")
    survivors = merged.groupBy("component").agg(F.min_by("group_id", "ord").alias("target"))
    lone = parts.where("kind = 'tx'").join(survivors, "component", "left_anti").groupBy(*COLLECTION, "component").agg(F.min(F.col("id").cast("long")).alias("_first"))
    last = groups.groupBy(*COLLECTION).agg(F.max("ord").alias("_last"))
    place = F.row_number().over(Window.partitionBy(*COLLECTION).orderBy("_first")).cast("long")
    fresh = lone.join(last, COLLECTION, "left").select(*COLLECTION, "component", new_id.alias("group_id"), (F.coalesce("_last", F.lit(0)) + place).alias("ord"))
    targets = survivors.unionByName(fresh.select("component", F.col("group_id").alias("target")))
    moves = merged.join(survivors, "component").where("group_id != target").select("group_id", "target")
    kept = groups.join(moves, "group_id", "left_anti").unionByName(_new_groups(fresh))
    of_tx = parts.where("kind = 'tx'").select(F.col("id").cast("long").alias("tx"), *COLLECTION, "component").join(targets, "component").select("tx", *COLLECTION, "target")
    edits = assigned.join(of_tx, ["tx", *COLLECTION], "left").withColumn("_group", F.coalesce("pinned", "target"))
    last_edit = edits.groupBy(*ENTITY).agg(F.max_by("intent", "tx").alias("_intent"), F.max_by("_group", "tx").alias("_group"), F.countDistinct("tx").alias("_times"))
    base = records.join(moves, "group_id", "left").withColumn("group_id", F.coalesce("target", "group_id"))
    both = base.withColumn("_old", F.lit(True)).join(last_edit, ENTITY, "full_outer").join(generations, COLLECTION, "left")
    hit = F.col("_times").isNotNull()
    out = both.withColumns(
        {
            "local_rev": F.coalesce("local_rev", F.lit(0)) + F.coalesce("_times", F.lit(0)),
            "pushing_rev": F.coalesce("pushing_rev", F.lit(0)),
            "acked_rev": F.coalesce("acked_rev", F.lit(0)),
            "intent": F.when(hit, F.col("_intent")).otherwise(F.col("intent")),
            "group_id": F.when(hit, F.col("_group")).otherwise(F.col("group_id")),
            "seen_gen": F.coalesce("seen_gen", "generation", F.lit(0)),
        }
    )
    return shaped(out, REPLICA_TABLES["records"]), shaped(kept, REPLICA_TABLES["groups"])


def adopted(existing: DataFrame, records: DataFrame, limit: int) -> DataFrame:
    """Untracked ones of the entities existing before the replica (ENTITY, position), with `chunk`: consecutive runs of at most limit.

    Entities named twice count once; tracked ones are left alone, so a repeat adopts nothing.
    """
    once = existing.groupBy(*ENTITY).agg(F.min("position").alias("position")).join(records.select(*ENTITY), ENTITY, "left_anti")
    rank = F.row_number().over(Window.partitionBy(*COLLECTION).orderBy("position"))
    return once.withColumn("chunk", F.floor((rank - 1) / limit).cast("long"))


def heads(groups: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each collection's first group that has a dirty record, and the groups before it that have none and are discarded."""
    busy = records.where(dirty()).select("group_id").distinct().withColumn("_busy", F.lit(True))
    rows = groups.join(busy, "group_id", "left")
    first = rows.where("_busy").groupBy(*COLLECTION).agg(F.min("ord").alias("_head"))
    rows = rows.join(first, COLLECTION, "left")
    head = rows.where("ord = _head").select(*groups.columns)
    return head, rows.where(F.col("_busy").isNull() & (F.col("_head").isNull() | (F.col("ord") < F.col("_head")))).select(*groups.columns)


def readiness(head: DataFrame, now: int) -> DataFrame:
    """head with `waits_for`: null if it may go, else retry or decision."""
    waits = F.when((F.col("state") == "PENDING") & (F.col("next_retry_at") > now), "retry").when(F.col("state").isin("CONFLICTED", "FAILED"), "decision")
    return head.withColumn("waits_for", waits)


def rebuilt(groups: DataFrame, records: DataFrame, new_id: Column) -> tuple[DataFrame, DataFrame]:
    """groups and records with those sent before and edited since under a new id, in the same place with the same merges."""
    edited = records.groupBy("group_id").agg(F.max(F.col("local_rev") > F.col("pushing_rev")).alias("_edited"))
    sent = (F.col("attempts") > 0) | (F.col("state") == "IN_FLIGHT")
    again = groups.where(sent).join(edited.where("_edited"), "group_id", "left_semi").withColumn("_new", new_id)
    fresh = _new_groups(again.select(F.col("_new").alias("group_id"), *COLLECTION, "ord", "dependency_merges"))
    names = again.select("group_id", "_new")
    moved = records.join(names, "group_id", "left").withColumn("group_id", F.coalesce("_new", "group_id"))
    return groups.join(names, "group_id", "left_anti").unionByName(fresh), shaped(moved, REPLICA_TABLES["records"])


def blocked_on_files(records: DataFrame, refs: DataFrame, files: DataFrame) -> DataFrame:
    """group_id and the first file for which a group must wait: a required one not on its way to the log, or a deferred one still only here."""
    rows = records.where(dirty() & (F.coalesce("intent", F.lit("UPSERT")) != "DELETE")).select("group_id", *ENTITY)
    rows = rows.join(refs.select(*ENTITY, "blob_id", "binding"), ENTITY)
    rows = rows.join(files.select(*COLLECTION, "blob_id", F.col("state").alias("_s")), [*COLLECTION, "blob_id"], "left")
    required = (F.col("binding") == "REQUIRED") & ~F.coalesce(F.col("_s").isin(*SENDABLE), F.lit(False))
    deferred = (F.col("binding") == "DEFERRED") & (F.col("_s").isNull() | (F.col("_s") == "LOCAL"))
    return rows.where(required | deferred).groupBy("group_id").agg(F.min("blob_id").alias("blob_id"))


def declared_files(refs: DataFrame, files: DataFrame) -> DataFrame:
    """ENTITY and the files to declare with its document."""
    known = files.where(~F.col("state").isin(*UNDECLARED)).select(*COLLECTION, "blob_id")
    return refs.join(known, [*COLLECTION, "blob_id"], "left_semi").groupBy(*ENTITY).agg(F.array_sort(F.collect_set("blob_id")).alias("blobs"))


def operations(head: DataFrame, records: DataFrame, documents: DataFrame, refs: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """COLLECTION, group_id, op, entity_type, entity_id, base_version, data, blobs, bytes: a row for each operation of groups, as its entity is now (documents: ENTITY, data).

    Missing documents and deletions are deletes. Without files a document declares none and says so by null.
    Only `data` needs the documents themselves: who asks for the rest joins their sizes.
    """
    sized = documents.select(*ENTITY, "data", F.when(F.col("data").isNotNull(), document_bytes(F.col("data"))).alias("bytes"))
    rows = records.where(dirty()).join(head.select("group_id"), "group_id", "left_semi").join(sized, ENTITY, "left")
    gone = (F.coalesce("intent", F.lit("UPSERT")) == "DELETE") | F.col("bytes").isNull()
    if refs is not None:
        rows = rows.join(declared_files(refs, files), ENTITY, "left").withColumn("blobs", F.coalesce("blobs", F.array().cast("array<string>")))
    else:
        rows = rows.withColumn("blobs", F.lit(None).cast("array<string>"))
    return rows.select(
        *COLLECTION, "group_id", F.when(gone, "delete").otherwise("upsert").alias("op"), "entity_type", "entity_id", F.col("server_version").alias("base_version"),
        F.when(~gone, F.col("data")).alias("data"), F.when(~gone, F.col("blobs")).alias("blobs"), F.when(gone, 0).otherwise(F.col("bytes")).alias("bytes"),
    )


def envelopes(ops: DataFrame, fields: tuple[str, ...] = WIRE) -> DataFrame:
    """COLLECTION, group_id, ops: operations as one row for each group, in order, with these fields.

    The row holds all that it is given: whole documents only of groups that `oversized` doesn't name.
    """
    op = F.struct(*fields)
    listed = F.array_sort(F.collect_list(F.struct(F.col("entity_type").alias("t"), F.col("entity_id").alias("i"), op.alias("o"))))
    return ops.groupBy(*COLLECTION, "group_id").agg(F.transform(listed, lambda x: x["o"]).alias("ops"))


def oversized(ops: DataFrame, most_operations: int, most_bytes: int) -> DataFrame:
    """Groups of operations that the log would refuse for their size, with the reason; no group is brought together for it."""
    sizes = ops.groupBy(*COLLECTION, "group_id").agg(F.count(F.lit(1)).alias("_n"), F.max("bytes").alias("_largest"))
    reason = F.when(F.col("_n") > most_operations, "operations").when(F.col("_largest") > most_bytes, "document")
    return sizes.withColumn("reason", reason).where("reason is not null").select(*COLLECTION, "group_id", "reason")


def sent(groups: DataFrame, records: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """groups and records once the named groups are on the wire: what is sent is the present revision of each record."""
    mark = ids.select("group_id").distinct().withColumn("_sent", F.lit(True))
    out = groups.join(mark, "group_id", "left").withColumn("state", F.when(F.col("_sent"), "IN_FLIGHT").otherwise(F.col("state")))
    rows = records.join(mark, "group_id", "left").withColumn("pushing_rev", F.when(F.col("_sent"), F.col("local_rev")).otherwise(F.col("pushing_rev")))
    return shaped(out, REPLICA_TABLES["groups"]), shaped(rows, REPLICA_TABLES["records"])


def acknowledged(groups: DataFrame, records: DataFrame, versions: DataFrame, retired: DataFrame, new_id: Column) -> tuple[DataFrame, DataFrame]:
    """groups and records after groups were applied.

    versions: ENTITY, server_version; retired: group_id. An answer covers the revision that was sent,
    no later edit: clean records leave the group, those edited meanwhile move to a new one at the end.
    """
    rows = records.join(versions.select(*ENTITY, F.col("server_version").alias("_v")), ENTITY, "left")
    rows = rows.withColumns({"acked_rev": F.when(F.col("_v").isNotNull(), F.col("pushing_rev")).otherwise(F.col("acked_rev")), "server_version": F.coalesce("_v", "server_version")})
    done = retired.select("group_id").distinct().withColumn("_done", F.lit(True))
    rows = rows.join(done, "group_id", "left")
    free = F.coalesce(F.col("_done"), F.lit(False)) & (F.col("local_rev") <= F.col("acked_rev"))
    rows = rows.withColumns({"intent": F.when(~free, F.col("intent")), "group_id": F.when(~free, F.col("group_id"))})
    left_over = rows.where("_done and group_id is not null").select("group_id").distinct()
    last = groups.groupBy(*COLLECTION).agg(F.max("ord").alias("_last"))
    place = F.row_number().over(Window.partitionBy(*COLLECTION).orderBy("ord")).cast("long")
    next_groups = groups.join(left_over, "group_id", "left_semi").join(last, COLLECTION).withColumns({"_new": new_id, "_ord": F.col("_last") + place})
    fresh = _new_groups(next_groups.select(F.col("_new").alias("group_id"), *COLLECTION, F.col("_ord").alias("ord")))
    rows = rows.join(next_groups.select("group_id", "_new"), "group_id", "left").withColumn("group_id", F.coalesce("_new", "group_id"))
    return groups.join(done, "group_id", "left_anti").unionByName(fresh), shaped(rows, REPLICA_TABLES["records"])


def merged_after_dependency(groups: DataFrame, records: DataFrame, refused: DataFrame, now: int, new_id: Column, most: int = MOST_DEPENDENCY_MERGES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """groups, records and `outcome` by group (merged, waits, failed) after refusals for a dependency.

    refused: group_id, message; one group a collection, its head. A group joins the next pending one
    of its collection under a new id in its own place; with none to join it waits, also under a new
    id, as the log would repeat the stored refusal; after `most` merges it fails.
    """
    rows = groups.join(refused.select("group_id", "message"), "group_id")
    later = groups.where("state = 'PENDING'").select(*COLLECTION, F.col("ord").alias("_ord"), F.col("group_id").alias("_next"))
    found = rows.join(later, COLLECTION, "left").where(F.col("_ord").isNull() | (F.col("_ord") > F.col("ord")))
    nearest = found.groupBy("group_id").agg(F.min_by("_next", "_ord").alias("_next"))
    rows = rows.join(nearest, "group_id", "left").withColumn("_new", new_id)
    outcome = F.when(F.col("dependency_merges") >= most, "failed").when(F.col("_next").isNotNull(), "merged").otherwise("waits")
    rows = rows.withColumn("outcome", outcome)
    joins, waits, fails = (rows.where(F.col("outcome") == x) for x in ("merged", "waits", "failed"))
    renamed = joins.select("group_id", "_new").unionByName(joins.select(F.col("_next").alias("group_id"), "_new")).unionByName(waits.select("group_id", "_new"))
    fresh = _new_groups(joins.select(F.col("_new").alias("group_id"), *COLLECTION, "ord", (F.col("dependency_merges") + 1).alias("dependency_merges")))
    attempts = F.col("attempts") + 1
    wait = waits.withColumns({"group_id": F.col("_new"), "state": F.lit("PENDING"), "last_error": F.col("message"), "next_retry_at": now + backoff_limit(attempts)}).withColumn("attempts", attempts)
    fail = fails.withColumns({"state": F.lit("FAILED"), "last_error": F.col("message"), "reject_code": F.lit("DEPENDENCY"), "next_retry_at": F.lit(None), "attempts": attempts})
    touched = renamed.select("group_id").unionByName(fails.select("group_id"))
    out = groups.join(touched, "group_id", "left_anti").unionByName(fresh)
    for part in (wait, fail):
        out = out.unionByName(shaped(part, REPLICA_TABLES["groups"]))
    moved = records.join(renamed, "group_id", "left").withColumn("group_id", F.coalesce("_new", "group_id"))
    return out, shaped(moved, REPLICA_TABLES["records"]), rows.select("group_id", *COLLECTION, "outcome")


def reuploading(groups: DataFrame, records: DataFrame, refs: DataFrame, files: DataFrame, refused: DataFrame, now: int, new_id: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """groups, records and files after refusals for a missing file: every file the group names is sent again, and the group waits under a new id."""
    ids = refused.select("group_id", "message")
    named = records.join(ids.select("group_id"), "group_id", "left_semi").select(*ENTITY).join(refs, ENTITY).select(*COLLECTION, "blob_id").distinct()
    out = files.join(named.withColumn("_again", F.lit(True)), [*COLLECTION, "blob_id"], "left")
    fresh = {"state": F.lit("LOCAL"), "wanted": F.lit(True), "last_error": F.lit(None), "attempts": F.lit(0), "next_retry_at": F.lit(None), "transferred": F.lit(0)}
    for c, v in fresh.items():
        out = out.withColumn(c, F.when(F.col("_again"), v).otherwise(F.col(c)))
    rows = groups.join(ids, "group_id", "left").withColumn("_new", F.when(F.col("message").isNotNull(), new_id))
    hit, attempts = F.col("_new").isNotNull(), F.col("attempts") + 1
    waiting = rows.withColumns(
        {
            "state": F.when(hit, "PENDING").otherwise(F.col("state")),
            "next_retry_at": F.when(hit, now + backoff_limit(attempts)).otherwise(F.col("next_retry_at")),
            "last_error": F.when(hit, F.col("message")).otherwise(F.col("last_error")),
            "attempts": F.when(hit, attempts).otherwise(F.col("attempts")),
        }
    )
    moved = records.join(rows.where(hit).select("group_id", "_new"), "group_id", "left").withColumn("group_id", F.coalesce("_new", "group_id"))
    named_groups = waiting.withColumn("group_id", F.coalesce("_new", "group_id"))
    return shaped(named_groups, REPLICA_TABLES["groups"]), shaped(moved, REPLICA_TABLES["records"]), shaped(out, REPLICA_TABLES["files"])


def refused(groups: DataFrame, answers: DataFrame) -> DataFrame:
    """groups after final refusals (group_id, code, message, entity_type, entity_id): failed, with the reason."""
    rows = groups.join(answers.select("group_id", F.struct("code", "message", "entity_type", "entity_id").alias("_a")), "group_id", "left")
    hit = F.col("_a").isNotNull()
    new = {"state": F.lit("FAILED"), "attempts": F.col("attempts") + 1, "next_retry_at": F.lit(None), "last_error": F.col("_a.message"), "reject_code": F.col("_a.code"), "reject_entity_type": F.col("_a.entity_type"), "reject_entity_id": F.col("_a.entity_id")}
    return shaped(rows.select(*[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in groups.columns]), REPLICA_TABLES["groups"])


def failed_push(groups: DataFrame, failures: DataFrame, now: int) -> DataFrame:
    """groups after the transport failed (group_id, message, retry_after_ms): back to pending; a wait the log asked for wins over the backoff.

    For reproducible results the wait is the backoff's upper limit; add jitter through retry_after_ms.
    """
    rows = groups.join(failures.select("group_id", "message", "retry_after_ms").withColumn("_hit", F.lit(True)), "group_id", "left")
    hit, attempts = F.col("_hit"), F.col("attempts") + 1
    new = {"state": F.lit("PENDING"), "attempts": attempts, "last_error": F.col("message"), "next_retry_at": now + F.coalesce("retry_after_ms", backoff_limit(attempts))}
    return shaped(rows.select(*[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in groups.columns]), REPLICA_TABLES["groups"])
