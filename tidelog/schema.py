"""Tables of the engine. A collection is (scope_id, collection_id); an entity adds (entity_type, entity_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COLLECTION = ["scope_id", "collection_id"]
ENTITY = [*COLLECTION, "entity_type", "entity_id"]
BLOB = [*COLLECTION, "blob_id"]

OPERATION = "op string, entity_type string, entity_id string, base_version string, data string, blobs array<string>"

#: Log side.
LOG_TABLES = {
    "collections": "scope_id string, collection_id string, epoch string, next_seq long, retention_floor_seq long, created_at timestamp",
    "batches": "scope_id string, collection_id string, seq long, client_id string, group_id string, committed_at timestamp",
    "changes": "scope_id string, collection_id string, seq long, ordinal int, entity_type string, entity_id string, op string, version long, data string",
    "entities": "scope_id string, collection_id string, entity_type string, entity_id string, version long, data string, is_deleted boolean, last_seq long, created_at timestamp, updated_at timestamp",
    "push_results": "scope_id string, collection_id string, client_id string, group_id string, status string, response string, created_at timestamp",
    "blobs": "scope_id string, collection_id string, blob_id string, state string, storage_key string, content_type string, size long, checksum string, created_at timestamp, ready_at timestamp, unreferenced_since timestamp",
    "blob_refs": "scope_id string, collection_id string, entity_type string, entity_id string, blob_id string",
}

#: Replica side.
REPLICA_TABLES = {
    "replicas": "scope_id string, collection_id string, cursor string, epoch string, phase string, generation long, bootstrap_page string, last_pull_at long, last_push_at long, schema_fingerprint string, last_error string, failure_count int",
    "records": "scope_id string, collection_id string, entity_type string, entity_id string, server_version string, local_rev long, pushing_rev long, acked_rev long, intent string, group_id string, conflict_id string, seen_gen long",
    "groups": "group_id string, scope_id string, collection_id string, ord long, state string, attempts int, next_retry_at long, dependency_merges int, last_error string, reject_code string, reject_entity_type string, reject_entity_id string",
    "conflicts": "conflict_id string, scope_id string, collection_id string, entity_type string, entity_id string, origin string, local_payload string, server_payload string, server_version string, detected_at long",
    "inbox_batches": "scope_id string, collection_id string, seq string, cursor string, received_ord long, origin_client_id string, state string",
    "inbox_ops": "scope_id string, collection_id string, seq string, ordinal int, entity_type string, entity_id string, op string, version string, payload string",
    "identity": "scope_id string, client_id string, created_at long",
    "files": "scope_id string, collection_id string, blob_id string, state string, wanted boolean, content_type string, size long, checksum string, attempts int, next_retry_at long, last_error string, transferred long, insert_ord long",
    "file_refs": "scope_id string, collection_id string, entity_type string, entity_id string, blob_id string, binding string, fetch string, seen_gen long",
}

#: Allowed values.
GROUP_STATES = ("PENDING", "IN_FLIGHT", "CONFLICTED", "FAILED")
FILE_STATES = ("LOCAL", "UPLOADING", "UPLOADED", "REMOTE", "DOWNLOADING", "READY", "UNAVAILABLE", "REFUSED")
PHASES = ("NEW", "BOOTSTRAPPING", "LIVE", "RESYNC_REQUIRED", "BLOCKED")
#: File states in which bytes are still to be moved.
MOVING = ("LOCAL", "UPLOADING", "REMOTE", "DOWNLOADING")


def structure(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def empty(spark: SparkSession, ddl: str) -> DataFrame:
    return spark.createDataFrame([], structure(ddl))


def shaped(df: DataFrame, ddl: str) -> DataFrame:
    """df with exactly the columns of ddl, in order; absent ones are null."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in structure(ddl)])


def check_values(df: DataFrame, column: str, allowed: tuple[str, ...]) -> DataFrame:
    """df whose evaluation fails on a value that is not allowed."""
    ok = F.col(column).isin(*allowed)
    return df.withColumn(column, F.when(ok, F.col(column)).otherwise(F.raise_error(F.concat(F.lit(f"{column} can't be "), F.coalesce(F.col(column), F.lit("null"))))))
