"""Registered queries of the log's and the replica's operators, each with SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tokens
from ..functions.documents import folded
from ..operators import blobs, diagnostics, files, log_read, log_write, outbox, replica, retention, statements
from ..schema import BLOB, COLLECTION, ENTITY
from .synthetic import view, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = with_views(sql)
        return f

    return register


def _collections(log: DataFrame) -> DataFrame:
    """The collections row of each collection of a log, with a floor at a tenth of it."""
    out = log.groupBy(*COLLECTION).agg((F.max("seq") + 1).alias("next_seq"))
    return out.withColumns({"retention_floor_seq": F.floor((F.col("next_seq") - 1) / 10) + 1, "epoch": F.lit("0199fd1a-0000-7000-8000-00000000000e")})


_C = "c AS (SELECT scope_id, collection_id, max(seq) + 1 AS next_seq, max(seq) // 10 + 1 AS retention_floor_seq FROM v_log GROUP BY ALL)"
_LAST = "SELECT *, row_number() OVER (PARTITION BY scope_id, collection_id, entity_type, entity_id ORDER BY seq DESC, ordinal DESC) AS rn FROM v_log"


@query(f"SELECT scope_id, entity_type, entity_id, seq AS version, op, value FROM ({_LAST}) x WHERE rn = 1")
def entities_latest(spark, sf):
    return log_read.current_state(view(spark, sf, "v_log")).select("scope_id", "entity_type", "entity_id", F.col("seq").alias("version"), "op", "value")


@query(f"SELECT scope_id, entity_type, entity_id, seq AS version, value FROM ({_LAST}) x WHERE rn = 1 AND op <> 'delete'")
def entities_live(spark, sf):
    return log_read.live(log_read.current_state(view(spark, sf, "v_log"))).select("scope_id", "entity_type", "entity_id", F.col("seq").alias("version"), "value")


@query("SELECT entity_id, seq AS version, ordinal, quantity FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY seq DESC, ordinal DESC) AS rn FROM v_changes) x WHERE rn = 1 AND op <> 'delete'")
def parts_live(spark, sf):
    return log_read.live(log_read.current_state(view(spark, sf, "v_changes"))).select("entity_id", F.col("seq").alias("version"), "ordinal", "quantity")


@query("WITH p AS (SELECT DISTINCT seq FROM v_changes WHERE seq > 9 ORDER BY seq LIMIT 21) SELECT p.seq, list(v.entity_id ORDER BY v.ordinal) AS entities, list(v.op ORDER BY v.ordinal) AS kinds FROM p JOIN v_changes v ON v.seq = p.seq GROUP BY p.seq")
def changes_page(spark, sf):
    """A page and one batch more, which tells whether there is another page; operations in their order."""
    changes = view(spark, sf, "v_changes")
    page = log_read.after(changes.select(*COLLECTION, "seq").distinct(), 9, 20)
    rows = log_read.with_operations(page, changes)
    return rows.select("seq", F.transform("ops", lambda o: o["entity_id"]).alias("entities"), F.transform("ops", lambda o: o["op"]).alias("kinds"))


@query("SELECT seq, list(entity_id ORDER BY ordinal) AS entities FROM v_changes GROUP BY seq")
def changes_in_order(spark, sf):
    """The operations of every batch in their order."""
    changes = view(spark, sf, "v_changes")
    rows = log_read.with_operations(changes.select(*COLLECTION, "seq").distinct(), changes)
    return rows.select("seq", F.transform("ops", lambda o: o["entity_id"]).alias("entities"))


@query("SELECT scope_id, max(seq) AS head FROM v_log GROUP BY scope_id")
def head_per_collection(spark, sf):
    return log_read.heads(_collections(view(spark, sf, "v_log"))).select("scope_id", "head")


@query(
    f"WITH {_C}, r AS (SELECT DISTINCT scope_id, collection_id, client_id, CAST(substr(client_id, 2) AS BIGINT) * 4000 AS seq FROM v_log)"
    " SELECT r.scope_id, client_id, seq, CASE WHEN seq > next_seq - 1 THEN 'reset' WHEN seq < retention_floor_seq - 1 THEN 'too_old' ELSE 'ok' END AS status,"
    " CASE WHEN seq <= next_seq - 1 AND seq >= retention_floor_seq - 1 THEN next_seq - 1 - seq END AS lag,"
    " CASE WHEN seq <= next_seq - 1 AND seq < retention_floor_seq - 1 THEN retention_floor_seq - 1 - seq END AS behind FROM r JOIN c ON r.scope_id = c.scope_id"
)
def cursor_lag(spark, sf):
    log = view(spark, sf, "v_log")
    readers = log.select(*COLLECTION, "client_id").distinct().withColumn("seq", F.substring("client_id", 2, 9).cast("long") * 4000)
    readers = readers.withColumn("epoch", F.lit("0199fd1a-0000-7000-8000-00000000000e"))
    return log_read.cursor_status(readers, _collections(log)).select("scope_id", "client_id", "seq", "status", "lag", "behind")


def _entities(spark, sf) -> DataFrame:
    state = log_read.current_state(view(spark, sf, "v_log"))
    return state.select(*ENTITY, F.col("seq").alias("version"), F.col("seq").alias("last_seq"), (F.col("op") == "delete").alias("is_deleted"), "value")


@query(f"SELECT entity_type, entity_id, version FROM (SELECT entity_type, entity_id, seq AS version FROM ({_LAST}) x WHERE rn = 1 AND op <> 'delete' AND scope_id = 's1' AND (entity_type > 'error' OR (entity_type = 'error' AND entity_id > '13')) ORDER BY entity_type, entity_id LIMIT 21) y")
def snapshot_page(spark, sf):
    own = log_read.of_collection(_entities(spark, sf), "s1", "ledger")
    return log_read.snapshot_rows(own, 20, ("error", "13")).select("entity_type", "entity_id", "version")


@query("SELECT entity_id, list_sort(list(DISTINCT blob_id)) AS blobs FROM v_ref WHERE scope_id = 's4' AND entity_type = 'src2' GROUP BY entity_id ORDER BY entity_id LIMIT 11")
def documents_page(spark, sf):
    refs = view(spark, sf, "v_ref").where("scope_id = 's4'").select(*ENTITY, "blob_id")
    entities = refs.select(*ENTITY).distinct().withColumn("is_deleted", F.lit(False))
    return log_read.documents_page(entities, refs, "src2", 10).select("entity_id", "blobs")


@query("SELECT blob_id, state, size FROM v_blob WHERE scope_id = 's2' AND blob_id > '2' ORDER BY blob_id LIMIT 11")
def blobs_page(spark, sf):
    return log_read.blobs_page(view(spark, sf, "v_blob").where("scope_id = 's2'"), 10, "2").select("blob_id", "state", "size")


@query(
    "WITH g AS (SELECT scope_id, entity_type, entity_id, max(CASE WHEN op = 'delete' THEN seq ELSE 0 END) AS gone, max(seq) AS version FROM v_log GROUP BY ALL)"
    " SELECT g.scope_id, g.entity_type, g.entity_id, g.version, arg_max(l.value, l.seq) AS value, arg_max(l.k, l.seq) AS k, count(*) FILTER (l.entity_type IN ('error', 'signup')) > 0 AS has_flag"
    " FROM g JOIN v_log l ON g.scope_id = l.scope_id AND g.entity_type = l.entity_type AND g.entity_id = l.entity_id AND l.seq > g.gone GROUP BY g.scope_id, g.entity_type, g.entity_id, g.version"
)
def patch_fold(spark, sf):
    flag = F.when(F.col("entity_type").isin("error", "signup"), F.lit(',"flag":null')).otherwise(F.lit(""))
    data = F.concat(F.lit('{"value":'), F.col("value").cast("string"), F.lit(',"k":'), F.col("k").cast("string"), flag, F.lit("}"))
    state = folded(view(spark, sf, "v_log").withColumn("data", F.when(F.col("op") != "delete", data)), ENTITY, ["seq", "ordinal"]).where(~F.col("is_deleted"))
    doc = F.parse_json("data")
    has = F.array_contains(F.map_keys(doc.cast("map<string,variant>")), "flag")
    return state.select("scope_id", "entity_type", "entity_id", F.col("seq").alias("version"), F.variant_get(doc, "$.value", "double").alias("value"), F.variant_get(doc, "$.k", "bigint").alias("k"), has.alias("has_flag"))


_STALE = "stored_version IS NOT NULL AND base_version IS DISTINCT FROM stored_version"


def _push(spark, sf) -> DataFrame:
    return view(spark, sf, "v_push").withColumns({"ordinal": (F.col("event_id") % 3).cast("int"), "data": F.lit(None).cast("string")})


@query(f"SELECT group_id, count(*) AS conflicts, min(stored_version) AS first_version FROM v_push WHERE {_STALE} GROUP BY group_id")
def conflicts_detect(spark, sf):
    rows = _push(spark, sf)
    stale = rows.where(F.col("stored_version").isNotNull() & log_write.stale(F.col("base_version").cast("string"), F.col("stored_version")))
    return stale.groupBy("group_id").agg(F.count(F.lit(1)).alias("conflicts"), F.min("stored_version").alias("first_version"))


@query(
    f"WITH e AS (SELECT * FROM ({_LAST}) x WHERE rn = 1), o AS (SELECT p.*, e.seq AS v FROM v_push p LEFT JOIN e ON p.scope_id = e.scope_id AND p.entity_type = e.entity_type AND p.entity_id = e.entity_id)"
    " SELECT group_id, CASE WHEN max(CASE WHEN base_version IS DISTINCT FROM v THEN 1 ELSE 0 END) = 1 THEN 'conflict' ELSE 'applied' END AS status, count(DISTINCT entity_type) AS entities FROM o GROUP BY group_id"
)
def group_verdict(spark, sf):
    ops = _push(spark, sf).withColumn("base_version", F.col("base_version").cast("string"))
    entities = _entities(spark, sf).withColumn("data", F.lit(None).cast("string"))
    clash = log_write.conflicts(ops, entities).select(*log_write.GROUP, F.lit("conflict").alias("status"))
    groups = ops.groupBy(*log_write.GROUP).agg(F.countDistinct("entity_type").alias("entities"))
    return groups.join(clash, log_write.GROUP, "left").select("group_id", F.coalesce("status", F.lit("applied")).alias("status"), "entities")


@query("SELECT client_id, group_id, event_id AS arrival FROM (SELECT *, row_number() OVER (PARTITION BY client_id, group_id ORDER BY event_id) AS rn FROM v_push) x WHERE rn = 1 AND event_id % 2 = 1")
def push_dedupe(spark, sf):
    groups = view(spark, sf, "v_push").select("client_id", "group_id", F.col("event_id").alias("arrival"))
    first, _ = log_write.first_of_each(groups)
    answered = first.where("arrival % 2 = 0").select("client_id", "group_id", F.lit("applied").alias("status"))
    new, _ = log_write.split_replays(first, answered)
    return new.select("client_id", "group_id", "arrival")


@query(
    f"WITH {_C}, g AS (SELECT scope_id, collection_id, group_id, min(event_id) AS arrival, max(CASE WHEN {_STALE} THEN 1 ELSE 0 END) AS bad FROM v_push GROUP BY ALL)"
    " SELECT g.scope_id, group_id, next_seq - 1 + row_number() OVER (PARTITION BY g.scope_id ORDER BY arrival) AS seq FROM g JOIN c ON g.scope_id = c.scope_id WHERE bad = 0"
)
def seq_assign(spark, sf):
    bad = F.col("stored_version").isNotNull() & ~F.col("base_version").eqNullSafe(F.col("stored_version"))
    groups = view(spark, sf, "v_push").groupBy(*COLLECTION, "group_id").agg(F.min("event_id").alias("arrival"), F.max(bad).alias("bad"))
    return log_write.sequenced(groups.where(~F.col("bad")), _collections(view(spark, sf, "v_log"))).select("scope_id", "group_id", "seq")


def _groups(spark, sf) -> DataFrame:
    op = F.struct("op", "entity_type", "entity_id", F.col("base_version").cast("string").alias("base_version"), F.repeat(F.lit("x"), F.col("k").cast("int")).alias("data"), F.when(F.col("event_id") % 5 == 0, F.array((F.col("event_id") % 400).cast("string"))).alias("blobs"))
    rows = view(spark, sf, "v_push").withColumn("scope_id", F.concat(F.lit("s"), (F.col("event_id") % 5).cast("string"))).withColumn("collection_id", F.lit("files"))
    ops = rows.groupBy(*COLLECTION, "client_id", "event_id").agg(F.collect_list(op).alias("ops"))
    return ops.select(*COLLECTION, "client_id", F.col("event_id").cast("string").alias("group_id"), F.col("event_id").alias("arrival"), "ops")


@query(
    "SELECT CAST(event_id AS STRING) AS group_id, CASE WHEN entity_type = 'signup' THEN 'UNKNOWN_ENTITY_TYPE' WHEN op = 'upsert' AND k > 80 THEN 'TOO_LARGE' ELSE 'BLOB_MISSING' END AS code, entity_type"
    " FROM v_push WHERE entity_type = 'signup' OR (op = 'upsert' AND k > 80) OR (op = 'upsert' AND event_id % 5 = 0 AND NOT EXISTS (SELECT 1 FROM v_blob b WHERE b.blob_id = CAST(event_id % 400 AS STRING) AND b.scope_id = concat('s', CAST(event_id % 5 AS STRING))))"
)
def reject_codes(spark, sf):
    allowed = spark.createDataFrame([("files", t) for t in ("click", "error", "purchase", "view")], "collection_id string, entity_type string")
    refs = view(spark, sf, "v_ref").select(*ENTITY, "blob_id")
    return log_write.rejections(_groups(spark, sf), allowed, view(spark, sf, "v_blob"), refs, log_write.Limits(document_bytes=80)).select("group_id", "code", "entity_type")


def _batches(spark, sf) -> DataFrame:
    return view(spark, sf, "v_log").select(*COLLECTION, "seq", "committed_at")


_FLOOR = f"{_C}, f AS (SELECT c.scope_id, c.collection_id, greatest(coalesce(min(seq) FILTER (committed_at >= (SELECT min(committed_at) + INTERVAL 20 DAY FROM v_log)), c.next_seq), c.retention_floor_seq) AS floor, c.next_seq FROM c JOIN v_log l ON c.scope_id = l.scope_id GROUP BY c.scope_id, c.collection_id, c.next_seq, c.retention_floor_seq)"


def _floors(spark, sf) -> DataFrame:
    batches = _batches(spark, sf)
    first = batches.agg(F.min("committed_at").alias("_first"))
    dated = batches.crossJoin(F.broadcast(first))  # one row
    return retention.floors(_collections(view(spark, sf, "v_log")), dated, F.col("_first") + F.expr("INTERVAL 20 DAYS"))


@query(f"WITH {_FLOOR} SELECT scope_id, floor FROM f")
def retention_floor(spark, sf):
    return _floors(spark, sf).select("scope_id", "floor")


@query(
    f"WITH {_FLOOR}, e AS (SELECT * FROM ({_LAST}) x WHERE rn = 1 AND op = 'delete') SELECT f.scope_id, (SELECT count(*) FROM v_log l WHERE l.scope_id = f.scope_id AND l.seq < f.floor) AS removed,"
    " (SELECT count(*) FROM e WHERE e.scope_id = f.scope_id AND e.seq < f.floor) AS swept, next_seq - floor AS retained FROM f"
)
def trim_report(spark, sf):
    return retention.trim_report(_batches(spark, sf), _entities(spark, sf), _floors(spark, sf)).select("scope_id", "removed", "swept", "retained")


@query(
    "SELECT scope_id, count(*) AS changes, count(*) AS batches, count(DISTINCT (entity_type, entity_id)) AS entities, CAST(0 AS BIGINT) AS push_results, CAST(0 AS BIGINT) AS blob_refs, CAST(0 AS BIGINT) AS blobs, CAST(1 AS BIGINT) AS collections FROM v_log WHERE scope_id = 's2' GROUP BY scope_id"
)
def purge_report(spark, sf):
    log = view(spark, sf, "v_log")
    none = log.where("false")
    state = {"changes": log, "batches": log, "entities": _entities(spark, sf), "push_results": none, "blob_refs": none, "blobs": none, "collections": _collections(log)}
    return retention.purge_report(state, retention.in_target("s2")).drop("collection_id")


@query("SELECT DISTINCT r.scope_id, r.blob_id FROM v_ref r WHERE NOT EXISTS (SELECT 1 FROM v_blob b WHERE b.scope_id = r.scope_id AND b.blob_id = r.blob_id)")
def blob_missing(spark, sf):
    return blobs.missing(view(spark, sf, "v_ref"), view(spark, sf, "v_blob")).select("scope_id", "blob_id")


_UNUSED = "NOT EXISTS (SELECT 1 FROM v_ref r WHERE b.scope_id = r.scope_id AND b.blob_id = r.blob_id)"


def _settled(spark, sf) -> DataFrame:
    rows = view(spark, sf, "v_blob")
    rows = rows.withColumns({c: F.lit(None).cast(t) for c, t in {"storage_key": "string", "content_type": "string", "checksum": "string", "created_at": "timestamp", "ready_at": "timestamp", "unreferenced_since": "timestamp"}.items()})
    return blobs.settled(rows, view(spark, sf, "v_ref"), rows, F.to_timestamp(F.lit("2024-01-01")))


@query(f"SELECT scope_id, blob_id, state FROM v_blob b WHERE {_UNUSED}")
def blob_unreferenced(spark, sf):
    return _settled(spark, sf).where("unreferenced_since is not null").select("scope_id", "blob_id", "state")


@query(f"SELECT scope_id, count(*) AS released, CAST(sum(size) AS BIGINT) AS bytes FROM v_blob b WHERE {_UNUSED} GROUP BY scope_id")
def blob_collect_bytes(spark, sf):
    return blobs.sweep_report(blobs.collectable(_settled(spark, sf), F.to_timestamp(F.lit("2024-02-01")))).select("scope_id", "released", "bytes")


@query("SELECT scope_id, entity_type, entity_id, list_sort(list(DISTINCT blob_id)) AS blobs FROM v_ref GROUP BY ALL")
def refs_per_document(spark, sf):
    return blobs.references_of(view(spark, sf, "v_ref")).select("scope_id", "entity_type", "entity_id", "blobs")


@query("SELECT scope_id, blob_id, CASE WHEN size > 5000 THEN 'BLOB_TOO_LARGE' WHEN state = 'READY' THEN CASE WHEN CAST(blob_id AS BIGINT) % 2 = 0 THEN 'ready' ELSE 'BLOB_DECLARATION_CONFLICT' END ELSE 'redeclared' END AS outcome FROM v_blob")
def blob_register(spark, sf):
    rows = view(spark, sf, "v_blob").withColumns({c: F.lit(None).cast("timestamp") for c in ("created_at", "ready_at", "unreferenced_since")})
    rows = rows.withColumns({"storage_key": F.lit("k"), "content_type": F.lit("text/html"), "checksum": F.lit(None).cast("string")})
    declared = rows.select(*BLOB, F.when(F.col("blob_id").cast("long") % 2 == 0, "text/html").otherwise("text/plain").alias("content_type"), "size", "checksum")
    return blobs.registrations(declared, rows, 5000, F.lit(True), F.lit("k"), F.lit(None).cast("timestamp"))[0].select("scope_id", "blob_id", "outcome")


def _incoming(spark, sf) -> DataFrame:
    log = view(spark, sf, "v_log")
    return log_read.current_state(log).select(*ENTITY, (F.col("seq") + F.col("k") % 2).cast("string").alias("version"), "op", F.col("client_id").alias("origin_client_id"))


@query(
    f"SELECT l.scope_id, l.entity_type, l.entity_id, CASE WHEN l.k % 2 = 0 THEN 'skip' WHEN r.local_rev <= r.acked_rev THEN 'apply' WHEN l.client_id = 'c1' THEN 'version_only' ELSE 'conflict' END AS action"
    f" FROM ({_LAST}) l JOIN v_record r ON l.scope_id = r.scope_id AND l.entity_type = r.entity_type AND l.entity_id = r.entity_id WHERE rn = 1"
)
def pull_classify(spark, sf):
    return replica.classified(_incoming(spark, sf), view(spark, sf, "v_record"), "c1").select("scope_id", "entity_type", "entity_id", "action")


@query(
    f"SELECT l.scope_id, l.entity_type, l.entity_id, CASE WHEN r.local_rev <= r.acked_rev THEN 'apply' WHEN l.k % 2 = 0 THEN 'version_only' ELSE 'conflict' END AS action"
    f" FROM ({_LAST}) l JOIN v_record r ON l.scope_id = r.scope_id AND l.entity_type = r.entity_type AND l.entity_id = r.entity_id WHERE rn = 1"
)
def bootstrap_classify(spark, sf):
    return replica.classified_snapshot(_incoming(spark, sf), view(spark, sf, "v_record")).select("scope_id", "entity_type", "entity_id", "action")


@query("SELECT scope_id, entity_type, entity_id FROM v_record WHERE seen_gen < 1 AND local_rev <= acked_rev")
def bootstrap_sweep(spark, sf):
    return replica.stale(view(spark, sf, "v_record"), F.lit(1)).select("scope_id", "entity_type", "entity_id")


@query(
    f"SELECT l.scope_id, l.entity_type, l.entity_id, coalesce(r.conflict_id, concat('n', l.entity_id)) AS conflict_id, r.conflict_id IS NULL AS is_new"
    f" FROM ({_LAST}) l JOIN v_record r ON l.scope_id = r.scope_id AND l.entity_type = r.entity_type AND l.entity_id = r.entity_id WHERE rn = 1 AND l.k % 2 = 1 AND r.local_rev > r.acked_rev AND l.client_id <> 'c1'"
)
def conflict_open_refresh(spark, sf):
    records = view(spark, sf, "v_record")
    found = replica.classified(_incoming(spark, sf), records, "c1").where("action = 'conflict'")
    found = found.select(*ENTITY, F.lit(None).cast("string").alias("local_payload"), F.lit("{}").alias("server_payload"), F.col("version").alias("server_version"))
    kept = records.where("conflict_id is not null").select("conflict_id", *ENTITY, *[F.lit(None).cast(t).alias(c) for c, t in (("origin", "string"), ("local_payload", "string"), ("server_payload", "string"), ("server_version", "string"), ("detected_at", "long"))])
    conflicts, marked = replica.opened(kept, records, found, "PULL", 1, F.concat(F.lit("n"), F.col("entity_id")))
    now = conflicts.where("server_payload = '{}'").select("conflict_id", *ENTITY, (F.col("origin") == "PULL").alias("_new"))
    return now.select("scope_id", "entity_type", "entity_id", "conflict_id", F.coalesce("_new", F.lit(False)).alias("is_new"))


@query("SELECT scope_id, count(*) FILTER (local_rev > acked_rev) AS pending FROM v_record GROUP BY scope_id")
def pending_count(spark, sf):
    return diagnostics.pending(view(spark, sf, "v_record")).select("scope_id", "pending")


@query(
    "WITH b AS (SELECT g.* FROM v_group g WHERE EXISTS (SELECT 1 FROM v_record r WHERE r.group_id = g.group_id AND r.local_rev > r.acked_rev)) SELECT scope_id, arg_min(group_id, ord) AS group_id, arg_min(state, ord) AS state FROM b GROUP BY scope_id"
)
def queue_head(spark, sf):
    return outbox.heads(view(spark, sf, "v_group"), view(spark, sf, "v_record"))[0].select("scope_id", "group_id", "state")


@query(
    "SELECT g.scope_id, count(*) AS groups, arg_min(g.state, ord) AS head_state, arg_min(g.state, ord) IN ('CONFLICTED', 'FAILED') AS is_blocked,"
    " arg_min(g.state, ord) NOT IN ('CONFLICTED', 'FAILED') AND EXISTS (SELECT 1 FROM v_file f WHERE f.scope_id = g.scope_id AND f.state IN ('LOCAL', 'UPLOADING')) AS is_waiting_on_files FROM v_group g GROUP BY g.scope_id"
)
def queue_blocked(spark, sf):
    own = view(spark, sf, "v_file").withColumn("collection_id", F.lit("ledger"))
    return diagnostics.queue_status(view(spark, sf, "v_group"), own).drop("collection_id")


_REFERENCED = "EXISTS (SELECT 1 FROM v_ref r WHERE r.scope_id = f.scope_id AND r.blob_id = f.blob_id)"


@query(
    "SELECT scope_id, blob_id, direction FROM (SELECT *, row_number() OVER (PARTITION BY scope_id, direction ORDER BY attempts, insert_ord) AS rn FROM (SELECT *, CASE WHEN state IN ('LOCAL', 'UPLOADING') THEN 'upload' ELSE 'download' END AS direction FROM v_file f"
    f" WHERE state IN ('LOCAL', 'UPLOADING', 'REMOTE', 'DOWNLOADING') AND wanted AND (next_retry_at IS NULL OR next_retry_at <= 900) AND {_REFERENCED}) x) y WHERE rn <= 2"
)
def waiting_blobs(spark, sf):
    return files.next_transfers(view(spark, sf, "v_file"), view(spark, sf, "v_ref"), 900).select("scope_id", "blob_id", "direction")


@query(f"SELECT scope_id, min(next_retry_at) AS at FROM v_file f WHERE wanted AND next_retry_at > 90 AND state IN ('LOCAL', 'UPLOADING', 'REMOTE', 'DOWNLOADING') AND {_REFERENCED} GROUP BY scope_id")
def next_retry(spark, sf):
    return files.next_wake(view(spark, sf, "v_file"), view(spark, sf, "v_ref"), 90).select("scope_id", "at")


@query("SELECT DISTINCT scope_id, blob_id FROM v_ref r WHERE scope_id = 's3' AND NOT EXISTS (SELECT 1 FROM v_file f WHERE f.scope_id = r.scope_id AND f.blob_id = r.blob_id)")
def unknown_refs(spark, sf):
    tables = {"file_refs": view(spark, sf, "v_ref"), "files": view(spark, sf, "v_file")}
    return statements.run("file_refs.unknown", tables, scope_id="s3", collection_id="files").select("scope_id", "blob_id")


@query(
    "SELECT r.group_id, min(r2.blob_id) AS blob_id FROM v_record r JOIN (SELECT q.*, f.state FROM v_ref q LEFT JOIN v_file f ON f.scope_id = q.scope_id AND f.blob_id = q.blob_id) r2 ON r2.scope_id = r.scope_id AND r2.entity_id = r.entity_id"
    " WHERE r.local_rev > r.acked_rev AND ((binding = 'REQUIRED' AND coalesce(state, '') NOT IN ('UPLOADED', 'READY', 'REMOTE', 'DOWNLOADING')) OR (binding = 'DEFERRED' AND coalesce(state, 'LOCAL') = 'LOCAL')) GROUP BY r.group_id"
)
def waiting_on_files(spark, sf):
    records = view(spark, sf, "v_record").withColumns({"intent": F.lit("UPSERT"), "entity_type": F.lit("x"), "collection_id": F.lit("files")})
    return outbox.blocked_on_files(records, view(spark, sf, "v_ref").withColumn("entity_type", F.lit("x")), view(spark, sf, "v_file"))


@query("SELECT scope_id, entity_type, entity_id, list_sort(list(DISTINCT r.blob_id)) AS blobs FROM v_ref r WHERE EXISTS (SELECT 1 FROM v_file f WHERE f.scope_id = r.scope_id AND f.blob_id = r.blob_id AND f.state NOT IN ('LOCAL', 'UNAVAILABLE', 'REFUSED')) GROUP BY ALL")
def declared_blobs(spark, sf):
    return outbox.declared_files(view(spark, sf, "v_ref"), view(spark, sf, "v_file")).select("scope_id", "entity_type", "entity_id", "blobs")


@query("SELECT scope_id, entity_type, entity_id, (row_number() OVER (PARTITION BY scope_id ORDER BY entity_type, entity_id) - 1) // 50 AS chunk FROM (SELECT DISTINCT scope_id, entity_type, entity_id FROM v_log) l WHERE NOT EXISTS (SELECT 1 FROM v_record r WHERE r.scope_id = l.scope_id AND r.entity_type = l.entity_type AND r.entity_id = l.entity_id AND r.seen_gen = 0)")
def adopt_chunks(spark, sf):
    existing = view(spark, sf, "v_log").select(*ENTITY, F.struct("entity_type", "entity_id").alias("position"))
    return outbox.adopted(existing, view(spark, sf, "v_record").where("seen_gen = 0"), 50).select("scope_id", "entity_type", "entity_id", "chunk")


@query(
    "WITH m AS (SELECT l.scope_id, l.collection_id, l.seq AS tx, CASE WHEN g.state = 'PENDING' THEN g.group_id END AS pending, concat(l.scope_id, '/', l.entity_type, '/', l.entity_id) AS entity"
    " FROM v_log l LEFT JOIN v_record r ON l.scope_id = r.scope_id AND l.entity_type = r.entity_type AND l.entity_id = r.entity_id LEFT JOIN v_group g ON g.group_id = r.group_id WHERE g.state IS NULL OR g.state <> 'IN_FLIGHT'),"
    # A transaction of this log changes one entity and an entity has at most one group, so no longer chains exist.
    " k AS (SELECT *, min(tx) OVER (PARTITION BY coalesce(pending, entity)) AS first_tx FROM m)"
    " SELECT DISTINCT 'tx' AS kind, CAST(tx AS VARCHAR) AS id, scope_id, first_tx FROM k UNION SELECT DISTINCT 'group', pending, scope_id, first_tx FROM k WHERE pending IS NOT NULL"
)
def group_components(spark, sf):
    """Transactions and groups that belong together, named by the first transaction of each component."""
    log = view(spark, sf, "v_log")
    marks = log.select(*ENTITY, F.col("seq").alias("tx"), F.lit("UPSERT").alias("intent"))
    found = outbox.group_components(outbox.assignments(marks, view(spark, sf, "v_record"), view(spark, sf, "v_group")))
    first = found.where("kind = 'tx'").groupBy("component").agg(F.min(F.col("id").cast("long")).alias("first_tx"))
    return found.join(first, "component").select("kind", "id", "scope_id", "first_tx")


@query("SELECT scope_id, entity_type, entity_id, local_rev, acked_rev FROM v_record WHERE local_rev > acked_rev")
def dirty_records(spark, sf):
    return view(spark, sf, "v_record").where(replica.dirty()).select("scope_id", "entity_type", "entity_id", "local_rev", "acked_rev")


@query("SELECT scope_id, entity_type, entity_id, CASE WHEN local_rev > acked_rev THEN NULL ELSE server_version END AS server_version, acked_rev AS local_rev FROM v_record WHERE scope_id = 's1'")
def abandon_local(spark, sf):
    records = view(spark, sf, "v_record").withColumn("intent", F.lit("UPSERT"))
    out = statements.run("records.abandon_local", {"records": records}, scope_id="s1", collection_id="ledger")
    return out.where("scope_id = 's1'").select("scope_id", "entity_type", "entity_id", "server_version", "local_rev")


@query("SELECT attempt, CAST(least(1000 * power(2.0, least(attempt - 1, 20)), 300000) AS BIGINT) AS wait FROM (SELECT DISTINCT k + 1 AS attempt FROM v_log) x")
def backoff_limits(spark, sf):
    attempts = view(spark, sf, "v_log").select((F.col("k") + 1).alias("attempt")).distinct()
    return attempts.select("attempt", tokens.backoff_limit(F.col("attempt")).alias("wait"))


@query("SELECT seq, concat('0199fd1a-0000-7000-8000-00000000000e.', CAST(seq AS STRING)) AS cursor, seq AS back FROM (SELECT DISTINCT seq FROM v_log) x")
def cursor_round_trip(spark, sf):
    rows = view(spark, sf, "v_log").select("seq").distinct()
    text = tokens.cursor(F.lit("0199fd1a-0000-7000-8000-00000000000e"), F.col("seq"))
    return rows.select("seq", text.alias("cursor"), tokens.position_of(text)["seq"].alias("back"))


@query("SELECT DISTINCT entity_type, entity_id, replace(replace(rtrim(to_base64(CAST(concat('e', chr(31), '7', chr(31), entity_type, chr(31), entity_id) AS BLOB)), '='), '+', '-'), '/', '_') AS token, entity_id AS back FROM v_log")
def page_token_round_trip(spark, sf):
    rows = view(spark, sf, "v_log").select("entity_type", "entity_id").distinct()
    token = tokens.page_token(F.lit("e"), F.lit("7"), F.col("entity_type"), F.col("entity_id"))
    return rows.select("entity_type", "entity_id", token.alias("token"), F.get(tokens.page_fields(token, 4), F.lit(3)).alias("back"))
