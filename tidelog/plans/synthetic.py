"""Views of the driver's tables as the engine's tables. Each is one text that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Log of single-operation batches: one collection for every fourth user. The event's number is the sequence, so it needs
#: no window; a collection's sequences have gaps, as those of a trimmed log have at its start.
LOG = """
SELECT concat('s', CAST(user_id % 4 AS STRING)) AS scope_id, 'ledger' AS collection_id,
  event_id + 1 AS seq, 0 AS ordinal, event_type AS entity_type,
  CAST(user_id AS STRING) AS entity_id, CASE WHEN k % 10 = 0 THEN 'delete' ELSE 'upsert' END AS op, value, k, event_id, user_id,
  ts AS committed_at, concat('c', CAST(user_id % 5 AS STRING)) AS client_id
FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events) e
"""

#: Changes of batches of several operations: an order is a batch, its number the sequence, its lines are changes of parts.
CHANGES = """
SELECT 's' AS scope_id, 'orders' AS collection_id, l_orderkey + 1 AS seq,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) - 1 AS BIGINT) AS ordinal,
  'part' AS entity_type, CAST(l_partkey AS STRING) AS entity_id, CASE WHEN l_returnflag = 'R' THEN 'delete' ELSE 'upsert' END AS op, l_quantity AS quantity
FROM lineitem
"""

#: Pushed operations: groups of three events of a user, every seventh with a stale base.
PUSH = """
SELECT scope_id, collection_id, client_id, concat('g', CAST(user_id AS STRING), '-', CAST(event_id // 3 AS STRING)) AS group_id,
  event_id, seq, entity_type, entity_id, op, k,
  lag(seq) OVER (PARTITION BY scope_id, collection_id, entity_type, entity_id ORDER BY seq) AS stored_version,
  CASE WHEN event_id % 7 = 0 THEN CAST(-1 AS BIGINT) ELSE lag(seq) OVER (PARTITION BY scope_id, collection_id, entity_type, entity_id ORDER BY seq) END AS base_version
FROM v_log
"""

#: Pages as registered files of every fifth scope, and documents that refer to them and to some that don't exist.
BLOB = """
SELECT concat('s', CAST(page_id % 5 AS STRING)) AS scope_id, 'files' AS collection_id, CAST(page_id AS STRING) AS blob_id,
  CASE WHEN page_id % 3 = 0 THEN 'PENDING' ELSE 'READY' END AS state, CAST(strlen(coalesce(html, '')) AS BIGINT) AS size FROM pages
"""
REF = """
SELECT concat('s', CAST(p % 5 AS STRING)) AS scope_id, 'files' AS collection_id, source AS entity_type, CAST(doc_id AS STRING) AS entity_id, CAST(p AS STRING) AS blob_id,
  CASE WHEN doc_id % 2 = 0 THEN 'REQUIRED' ELSE 'DEFERRED' END AS binding, CASE WHEN doc_id % 4 = 0 THEN 'EAGER' ELSE 'ON_DEMAND' END AS fetch, doc_id % 2 AS seen_gen
FROM (SELECT doc_id, source, doc_id * 7 // 25 * 3 // 2 AS p FROM documents) d
"""

#: Replica records: the last change of each entity with revisions made up from its payload.
RECORD = """
SELECT scope_id, collection_id, entity_type, entity_id, CAST(seq AS STRING) AS server_version, k % 4 AS local_rev, k % 3 AS pushing_rev, k % 3 AS acked_rev,
  concat('g', CAST(user_id % 7 AS STRING)) AS group_id, user_id % 2 AS seen_gen, CASE WHEN k % 5 = 0 THEN concat('x', scope_id, '-', CAST(seq AS STRING)) END AS conflict_id
FROM (SELECT *, row_number() OVER (PARTITION BY scope_id, collection_id, entity_type, entity_id ORDER BY seq DESC) AS rn FROM v_log) l WHERE rn = 1
"""

#: Outbox groups: conversations in order.
GROUP = """
SELECT concat('g', CAST(conv_id AS STRING)) AS group_id, concat('s', CAST(conv_id % 4 AS STRING)) AS scope_id, 'ledger' AS collection_id, conv_id AS ord,
  CASE conv_id % 5 WHEN 0 THEN 'CONFLICTED' WHEN 1 THEN 'FAILED' WHEN 2 THEN 'IN_FLIGHT' ELSE 'PENDING' END AS state, turns AS attempts,
  CASE WHEN conv_id % 3 = 0 THEN conv_id * 100 END AS next_retry_at
FROM (SELECT conv_id, count(*) AS turns FROM conversations GROUP BY conv_id) c
"""

#: Replica files with retries.
FILE = """
SELECT scope_id, collection_id, blob_id,
  CASE CAST(blob_id AS BIGINT) % 6 WHEN 0 THEN 'LOCAL' WHEN 1 THEN 'UPLOADING' WHEN 2 THEN 'REMOTE' WHEN 3 THEN 'DOWNLOADING' WHEN 4 THEN 'READY' ELSE 'UNAVAILABLE' END AS state,
  CAST(blob_id AS BIGINT) % 4 <> 0 AS wanted, CAST(blob_id AS BIGINT) % 5 AS attempts, CASE WHEN CAST(blob_id AS BIGINT) % 3 = 0 THEN CAST(blob_id AS BIGINT) * 10 END AS next_retry_at,
  CAST(blob_id AS BIGINT) AS insert_ord, size FROM v_blob
"""

#: The replica's tables in full, for its statements.
RECORDS = """
SELECT scope_id, collection_id, entity_type, entity_id, CASE WHEN local_rev = 3 THEN NULL ELSE server_version END AS server_version, local_rev, pushing_rev, acked_rev,
  CASE WHEN local_rev > acked_rev THEN 'UPSERT' END AS intent, group_id, conflict_id, seen_gen FROM v_record
"""
GROUPS = """
SELECT group_id, scope_id, collection_id, ord, state, attempts, next_retry_at, ord % 4 AS dependency_merges, CASE WHEN state = 'FAILED' THEN 'offline' END AS last_error,
  CAST(NULL AS STRING) AS reject_code, CAST(NULL AS STRING) AS reject_entity_type, CAST(NULL AS STRING) AS reject_entity_id FROM v_group
"""
REPLICAS = """
SELECT concat('s', CAST(n_nationkey % 4 AS STRING)) AS scope_id, n_name AS collection_id, concat('e.', CAST(n_nationkey AS STRING)) AS cursor, CASE WHEN n_nationkey % 3 > 0 THEN concat('e', CAST(n_nationkey % 3 AS STRING)) END AS epoch,
  CASE WHEN n_nationkey % 2 = 0 THEN 'LIVE' ELSE 'NEW' END AS phase, n_regionkey AS generation, concat('p', CAST(n_nationkey AS STRING)) AS bootstrap_page, n_nationkey * 10 AS last_pull_at, n_nationkey * 20 AS last_push_at,
  'f1' AS schema_fingerprint, CASE WHEN n_regionkey = 1 THEN 'offline' END AS last_error, n_regionkey AS failure_count FROM nation
"""
CONFLICTS = """
SELECT concat('x', entity_type, '-', entity_id) AS conflict_id, scope_id, collection_id, entity_type, entity_id, 'PULL' AS origin, server_version AS local_payload, entity_id AS server_payload,
  server_version, local_rev * 7 % 5 AS detected_at FROM v_record
"""
INBOX_BATCHES = """
SELECT scope_id, collection_id, CAST(ord AS STRING) AS seq, concat('e.', CAST(ord AS STRING)) AS cursor, ord AS received_ord, concat('c', CAST(ord % 5 AS STRING)) AS origin_client_id,
  CASE WHEN ord % 3 = 0 THEN 'APPLIED' ELSE 'PENDING' END AS state FROM v_group
"""
INBOX_OPS = """
SELECT concat('s', CAST(conv_id % 4 AS STRING)) AS scope_id, 'ledger' AS collection_id, CAST(conv_id AS STRING) AS seq, turn AS ordinal, role AS entity_type, CAST(conv_id * 100 + turn AS STRING) AS entity_id,
  CASE WHEN turn % 2 = 0 THEN 'upsert' ELSE 'delete' END AS op, CAST(conv_id AS STRING) AS version, text AS payload FROM conversations
"""
IDENTITY = "SELECT concat('s', CAST(c_custkey AS STRING)) AS scope_id, concat('c', CAST(c_nationkey AS STRING)) AS client_id, c_custkey * 1000 AS created_at FROM customer"
FILES = """
SELECT scope_id, collection_id, blob_id, state, wanted, 'text/html' AS content_type, size, CAST(NULL AS STRING) AS checksum, attempts, next_retry_at,
  CASE WHEN attempts > 2 THEN 'offline' END AS last_error, attempts * 100 AS transferred, insert_ord FROM v_file
"""
FILE_REFS = "SELECT scope_id, collection_id, entity_type, entity_id, blob_id, binding, r.fetch AS fetch, seen_gen FROM v_ref r"
WALLET = "SELECT CAST(c_custkey AS STRING) AS id, c_mktsegment AS title FROM customer"
TRANSACTION = "SELECT CAST(s_suppkey AS STRING) AS id, CAST(s_nationkey AS STRING) AS wallet_id, s_suppkey * 100 AS amount FROM supplier"

VIEWS = {"v_log": LOG, "v_changes": CHANGES, "v_push": PUSH, "v_blob": BLOB, "v_ref": REF, "v_record": RECORD, "v_group": GROUP, "v_file": FILE}
VIEWS |= {"t_records": RECORDS, "t_groups": GROUPS, "t_replicas": REPLICAS, "t_conflicts": CONFLICTS, "t_inbox_batches": INBOX_BATCHES, "t_inbox_ops": INBOX_OPS, "t_identity": IDENTITY}
VIEWS |= {"t_files": FILES, "t_file_refs": FILE_REFS, "t_wallet": WALLET, "t_ledger_transaction": TRANSACTION}
_TABLES = ("events", "lineitem", "pages", "documents", "conversations", "nation", "customer", "supplier")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One view over the Parquet tables of sf_dir, without touching the session's catalog."""
    text = VIEWS[name].replace("//", " DIV ").replace("strlen(", "octet_length(")
    frames = {}
    for other in (*VIEWS, *_TABLES):
        if f"FROM {other}" in text:
            text = text.replace(f"FROM {other}", f"FROM {{{other}}}")
            frames[other] = view(spark, sf_dir, other) if other in VIEWS else spark.read.parquet(f"{sf_dir}/{other}.parquet")
    return spark.sql(text, **frames)


def with_views(sql: str) -> str:
    """sql for DuckDB with the views it names before it."""
    needed: list[str] = []

    def need(text: str) -> None:
        for name, body in VIEWS.items():
            if name in text and name not in needed:
                need(body)
                if name not in needed:
                    needed.append(name)

    need(sql)
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in needed) + ("," + sql.strip()[4:] if sql.strip().startswith("WITH") else " " + sql)
