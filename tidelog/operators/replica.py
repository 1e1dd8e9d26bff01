"""Reconciling a replica with the log: classify, apply, conflicts, snapshots, sweeps and resolutions, many entities at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import COLLECTION, ENTITY, REPLICA_TABLES, shaped

#: What becomes of an incoming change.
SKIP, APPLY, VERSION_ONLY, CONFLICT = "skip", "apply", "version_only", "conflict"
#: Operations that a replica understands.
KNOWN = ("upsert", "delete")


def dirty() -> Column:
    """Whether a record has an edit that no acknowledgement covers; null where there is no record."""
    return F.col("local_rev") > F.col("acked_rev")


def inbox_rows(batches: DataFrame, received_after: DataFrame) -> DataFrame:
    """batches (COLLECTION, seq, cursor, origin_client_id) with arrival numbers after those received already (COLLECTION, n)."""
    rank = F.row_number().over(Window.partitionBy(*COLLECTION).orderBy(F.col("seq").cast("long"))).cast("long")
    rows = batches.join(received_after, COLLECTION, "left").withColumn("received_ord", rank + F.coalesce("n", F.lit(0)))
    return shaped(rows.withColumn("state", F.lit("PENDING")), REPLICA_TABLES["inbox_batches"])


def unknown_operations(ops: DataFrame) -> DataFrame:
    """Collections that received an operation the replica doesn't understand: they have to be fetched anew."""
    return ops.where(~F.coalesce(F.col("op").isin(*KNOWN), F.lit(False))).select(*COLLECTION).distinct()


def decoded(raw: Column) -> Column:
    """An operation from its wire JSON: tag, type, id, version, data; unknown tags keep their raw text."""
    doc = F.parse_json(raw)
    text = lambda path: F.try_variant_get(doc, path, "string")
    tag = text("$.op")
    data = F.when(tag == "upsert", F.to_json(F.try_variant_get(doc, "$.data", "variant")))
    return F.struct(
        F.when(tag.isin(*KNOWN), tag).otherwise("unknown").alias("op"),
        text("$.entity").alias("entity_type"),
        text("$.id").alias("entity_id"),
        text("$.version").alias("version"),
        F.when(tag.isin(*KNOWN), data).otherwise(raw).alias("payload"),
    )


def classified(ops: DataFrame, records: DataFrame, client_id: Column | str) -> DataFrame:
    """ops (ENTITY, version, op, payload, origin_client_id) with `action`.

    A version known already is skipped; a clean or untracked entity takes the change; a dirty one
    that this client changed itself only takes the version; any other is a conflict.
    """
    client = F.lit(client_id) if isinstance(client_id, str) else client_id
    own = records.select(*ENTITY, "server_version", "local_rev", "acked_rev", F.lit(True).alias("_tracked"))
    rows = ops.join(own, ENTITY, "left")
    action = (
        F.when(F.col("_tracked") & F.col("server_version").eqNullSafe(F.col("version")), SKIP)
        .when(F.col("_tracked").isNull() | ~dirty(), APPLY)
        .when(F.col("origin_client_id").eqNullSafe(client) & F.col("origin_client_id").isNotNull(), VERSION_ONLY)
        .otherwise(CONFLICT)
    )
    return rows.withColumn("action", action).drop("_tracked", "local_rev", "acked_rev", "server_version")


def classified_snapshot(items: DataFrame, records: DataFrame) -> DataFrame:
    """Snapshot items (ENTITY, version, payload) with `action`: clean takes it, dirty on this very version keeps its edit, else conflict."""
    own = records.select(*ENTITY, "server_version", "local_rev", "acked_rev", F.lit(True).alias("_tracked"))
    rows = items.join(own, ENTITY, "left")
    action = F.when(F.col("_tracked").isNull() | ~dirty(), APPLY).when(F.col("server_version").eqNullSafe(F.col("version")), VERSION_ONLY).otherwise(CONFLICT)
    return rows.withColumn("action", action).drop("_tracked", "local_rev", "acked_rev", "server_version")


def last_actions(actions: DataFrame, order: list[str], of: list[str] = []) -> DataFrame:  # noqa: B006
    """Of several changes of an entity (and of one kind, given columns for it) in a run of batches the last; what matters to a record is where it ends."""
    key = [*ENTITY, *of]
    rest = [c for c in actions.columns if c not in key]
    return actions.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_a")).select(*key, "_a.*")


def with_versions(records: DataFrame, actions: DataFrame, generation: Column) -> DataFrame:
    """records after actions that apply or move the version; entities without a record get a clean one."""
    moved = actions.where(F.col("action").isin(APPLY, VERSION_ONLY)).select(*ENTITY, F.col("version").alias("_version"))
    both = records.withColumn("_old", F.lit(True)).join(moved.withColumn("_new", F.lit(True)), ENTITY, "full_outer")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    out = both.select(
        *ENTITY,
        F.when(F.col("_new"), F.col("_version")).otherwise(F.col("server_version")).alias("server_version"),
        zero("local_rev"), zero("pushing_rev"), zero("acked_rev"),
        "intent", "group_id", "conflict_id",
        F.when(F.col("_new"), generation).otherwise(F.col("seen_gen")).alias("seen_gen"),
    )
    return shaped(out, REPLICA_TABLES["records"])


def opened(conflicts: DataFrame, records: DataFrame, found: DataFrame, origin: str, detected_at: int, new_id: Column) -> tuple[DataFrame, DataFrame]:
    """conflicts and records after disagreements: an entity's open conflict is refreshed, otherwise one is opened.

    found: ENTITY, local_payload, server_payload, server_version, one row for each entity. The record
    keeps the version it was based on. new_id: an expression over ENTITY columns for new conflicts.
    """
    rows = found.join(records.select(*ENTITY, "conflict_id"), ENTITY, "left")
    rows = rows.withColumn("_fresh", F.col("conflict_id").isNull()).withColumn("conflict_id", F.coalesce("conflict_id", new_id))
    news = F.struct("local_payload", "server_payload", "server_version")
    kept = conflicts.join(rows.select("conflict_id", news.alias("_n")), "conflict_id", "left")
    for c in ("local_payload", "server_payload", "server_version"):
        kept = kept.withColumn(c, F.when(F.col("_n").isNotNull(), F.col(f"_n.{c}")).otherwise(F.col(c)))
    fresh = rows.join(conflicts.select("conflict_id"), "conflict_id", "left_anti").withColumns({"origin": F.lit(origin), "detected_at": F.lit(detected_at)})
    marked = records.join(rows.select(*ENTITY, F.col("conflict_id").alias("_c")), ENTITY, "left").withColumn("conflict_id", F.coalesce("_c", "conflict_id"))
    after = shaped(kept, REPLICA_TABLES["conflicts"]).unionByName(shaped(fresh, REPLICA_TABLES["conflicts"]))
    return after, shaped(marked, REPLICA_TABLES["records"])


def resolved(conflicts: DataFrame, records: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """conflicts, records, and the operations for the application after decisions (conflict_id, resolution, data).

    keep_local: the edit goes out again on the conflict's version. take_server: the server's document
    (or its absence) is applied and the edit forgotten. merged: data is applied and goes out again.
    """
    known = decisions.join(conflicts, "conflict_id")
    keeps = F.col("resolution").isin("keep_local", "merged")
    intent = F.when(F.col("resolution") == "merged", "UPSERT").when(F.col("local_payload").isNull(), "DELETE").otherwise("UPSERT")
    change = known.select(*ENTITY, F.struct("resolution", F.col("server_version").alias("v"), intent.alias("intent")).alias("_d"))
    rows = records.join(change, ENTITY, "left")
    again, took = F.col("_d.resolution").isin("keep_local", "merged"), F.col("_d.resolution") == "take_server"
    out = rows.withColumns(
        {
            "server_version": F.when(again | took, F.col("_d.v")).otherwise(F.col("server_version")),
            "acked_rev": F.when(took, F.col("local_rev")).otherwise(F.col("acked_rev")),
            "local_rev": F.when(again, F.col("local_rev") + 1).otherwise(F.col("local_rev")),
            "intent": F.when(again, F.col("_d.intent")).when(took, F.lit(None)).otherwise(F.col("intent")),
            "group_id": F.when(took, F.lit(None)).otherwise(F.col("group_id")),
            "conflict_id": F.when(again | took, F.lit(None)).otherwise(F.col("conflict_id")),
        }
    )
    data = F.when(F.col("resolution") == "merged", F.col("data")).otherwise(F.col("server_payload"))
    ops = known.where(~(keeps & (F.col("resolution") != "merged"))).select(*ENTITY, F.when(data.isNull(), "delete").otherwise("upsert").alias("op"), data.alias("payload"))
    return conflicts.join(known.select("conflict_id"), "conflict_id", "left_anti"), shaped(out, REPLICA_TABLES["records"]), ops


def revived(groups: DataFrame, records: DataFrame, new_id: Column) -> tuple[DataFrame, DataFrame]:
    """groups and records once conflicted groups without an open conflict are settled: sent again under a new id in their place, or dropped when nothing is dirty."""
    state = records.where("group_id is not null").groupBy("group_id").agg(F.count_if(F.col("conflict_id").isNotNull()).alias("_open"), F.count_if(dirty()).alias("_dirty"))
    rows = groups.join(state, "group_id", "left").withColumn("_settled", (F.col("state") == "CONFLICTED") & (F.coalesce("_open", F.lit(0)) == 0))
    live = ~F.col("_settled") | (F.coalesce("_dirty", F.lit(0)) > 0)
    fresh = F.when(F.col("_settled"), new_id)
    turned = rows.where(live).withColumn("_new", fresh)
    reset = {"state": "PENDING", "attempts": 0, "dependency_merges": 0}
    out = turned
    for c in [c for c in groups.columns if c not in ("group_id", "scope_id", "collection_id", "ord")]:
        out = out.withColumn(c, F.when(F.col("_new").isNotNull(), F.lit(reset.get(c))).otherwise(F.col(c)))
    names = turned.where("_new is not null").select("group_id", "_new")
    moved = records.join(names, "group_id", "left").withColumn("group_id", F.coalesce("_new", "group_id"))
    return shaped(out.withColumn("group_id", F.coalesce("_new", "group_id")), REPLICA_TABLES["groups"]), shaped(moved, REPLICA_TABLES["records"])


def stale(records: DataFrame, generation: Column) -> DataFrame:
    """Clean records that the present snapshot didn't mention: to be deleted here too."""
    return records.where((F.col("seen_gen") < generation) & ~dirty())


def needs_bootstrap(replicas: DataFrame) -> DataFrame:
    return replicas.withColumn("needs_bootstrap", F.col("phase").isin("NEW", "BOOTSTRAPPING", "RESYNC_REQUIRED") | F.col("cursor").isNull())


def schema_reconciled(replicas: DataFrame, fingerprint: Column) -> DataFrame:
    """replicas with the application's schema fingerprint; one that changed sends the collection back to a snapshot."""
    changed = F.col("schema_fingerprint").isNotNull() & ~F.col("schema_fingerprint").eqNullSafe(fingerprint)
    return replicas.withColumns({"phase": F.when(changed, "RESYNC_REQUIRED").otherwise(F.col("phase")), "schema_fingerprint": fingerprint})


def failed_pull(replicas: DataFrame, failures: DataFrame) -> DataFrame:
    """replicas after failures (COLLECTION, kind, message): lost history asks for a snapshot, a reset forgets the incarnation, others are counted."""
    rows = replicas.join(failures.select(*COLLECTION, "kind", "message"), COLLECTION, "left")
    old, reset, other = F.col("kind") == "CursorTooOld", F.col("kind") == "CollectionReset", F.col("kind").isNotNull()
    out = rows.withColumns(
        {
            "phase": F.when(old, "RESYNC_REQUIRED").when(reset, "NEW").otherwise(F.col("phase")),
            "cursor": F.when(reset, F.lit(None)).otherwise(F.col("cursor")),
            "epoch": F.when(reset, F.lit(None)).otherwise(F.col("epoch")),
            "bootstrap_page": F.when(reset, F.lit(None)).otherwise(F.col("bootstrap_page")),
            "last_error": F.when(reset, F.lit(None)).when(other, F.col("message")).otherwise(F.col("last_error")),
            "failure_count": F.when(reset, 0).when(other & ~old, F.col("failure_count") + 1).otherwise(F.col("failure_count")),
        }
    )
    return shaped(out, REPLICA_TABLES["replicas"])
