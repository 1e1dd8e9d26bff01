"""Queries of the replica's statements: each family runs all its statements over whole synthetic tables.

A row of the result is a row that the statement reads, or one of its table after it, as text, under
the statement's name; a statement that reads one number gives it as `n`. Beside each statement stands
what it must do in SQL: a condition to read or delete by, or a condition and new values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import statements
from ..schema import REPLICA_TABLES
from ..sources.shared import stored
from .synthetic import view, with_views

_COLUMNS = {t: [x.split()[0] for x in ddl.split(", ")] for t, ddl in REPLICA_TABLES.items()} | {"wallet": ["id", "title"], "ledger_transaction": ["id", "wallet_id", "amount"]}

#: Parameters of each family's statements, the same for Spark and SQL.
GIVEN: dict[str, dict] = {
    "records": {"scope_id": "s1", "collection_id": "ledger", "entity_type": "view", "entity_id": "13", "group_id": "g3", "target": "g5", "intent": "DELETE", "server_version": "v9", "generation": 2, "conflict_id": "x9"},
    "groups": {"scope_id": "s1", "collection_id": "ledger", "group_id": "g6", "state": "PENDING", "ord": 9, "next_retry_at": 777, "error": "late", "code": "VALIDATION", "entity_type": "view", "entity_id": "13", "count": 5},
    "replicas": {"scope_id": "s1", "collection_id": "NATION_9", "cursor": "e.99", "at": 1234, "phase": "RESYNC_REQUIRED", "fingerprint": "f2", "page": "p99", "epoch": "e2", "error": "late"},
    "conflicts": {"scope_id": "s1", "collection_id": "ledger", "conflict_id": "xview-13", "local": "mine", "server": "theirs", "server_version": "v9"},
    "inbox": {"scope_id": "s1", "collection_id": "ledger", "seq": "9", "state": "PENDING"},
    "identity": {"scope_id": "s7"},
    "files": {"scope_id": "s1", "collection_id": "files", "blob_id": "21", "state": "UPLOADING", "error": "late", "next_retry_at": 777, "wanted": False, "transferred": 55, "content_type": "image/png", "size": 66, "checksum": "abc", "now": 900, "limit": 3},
    "file_refs": {"scope_id": "s1", "collection_id": "files", "entity_type": "src4", "entity_id": "4", "blob_id": "1", "generation": 1},
    "application": {"id": "17"},
}

K = "scope_id = :scope_id AND collection_id = :collection_id"
E = f"{K} AND entity_type = :entity_type AND entity_id = :entity_id"
B = f"{K} AND blob_id = :blob_id"
S = "scope_id = :scope_id"
G = "group_id = :group_id"
C = "conflict_id = :conflict_id"
Q = f"{K} AND seq = :seq"
_DIRTY, _CLEAN = "local_rev > acked_rev", "local_rev <= acked_rev"
_LINKED = "EXISTS (SELECT 1 FROM t_file_refs r WHERE r.scope_id = b.scope_id AND r.collection_id = b.collection_id AND r.blob_id = b.blob_id{})"
_OPEN = "state IN ('LOCAL', 'UPLOADING', 'REMOTE', 'DOWNLOADING')"
_DUE = "(next_retry_at IS NULL OR next_retry_at <= :now)"
_CLEAR = {"last_error": "NULL", "attempts": "0", "next_retry_at": "NULL"}
_WELL = {"last_error": "NULL", "failure_count": "0"}
_COUNT = "count(*)"


def read(where: str, columns: str = "", tail: str = "", n: str = "", distinct: bool = False) -> tuple:
    return ("read", where, columns, tail, n, distinct)


def update(where: str, **sets: str) -> tuple:
    return ("update", where, sets)


def delete(where: str) -> tuple:
    return ("delete", where)


def insert(**new: str) -> tuple:
    """Rows made from those that stand, with other values."""
    return ("insert", new)


def upsert(where: str, key: str, **new: str) -> tuple:
    """Rows that hold `where`, with other values; key: whether b and a are the same row."""
    return ("upsert", where, key, new)


EXPECTED: dict[str, dict[str, tuple]] = {
    "records": {
        "find": read(E), "group_of": read(E, "group_id"), "of_group": read(G), "open_conflicts_of_group": read(f"{G} AND conflict_id IS NOT NULL", n=_COUNT),
        "pending_count": read(f"{K} AND {_DIRTY}", n=_COUNT), "observe_pending_count": read(f"{K} AND {_DIRTY}", n=_COUNT),
        "stale": read(f"{K} AND seen_gen < :generation AND {_CLEAN}"), "unconfirmed": read(f"{K} AND {_DIRTY} AND server_version IS NULL"),
        "upsert": upsert("entity_type <> 'view'", "a.entity_type = b.entity_type AND a.entity_id = b.entity_id AND a.scope_id = b.scope_id AND a.collection_id = b.collection_id", collection_id="CASE WHEN entity_type = 'click' THEN 'other' ELSE collection_id END", local_rev="local_rev + 7"),
        "mark_mutated": update(E, local_rev="local_rev + 1", intent=":intent", group_id=":group_id"), "reassign_group": update(G, group_id=":target"), "capture_pushing": update(G, pushing_rev="local_rev"),
        "acknowledge": update(E, server_version=":server_version", acked_rev="pushing_rev"), "release_clean": update(f"{G} AND {_CLEAN}", group_id="NULL", intent="NULL"),
        "update_server_version": update(E, server_version=":server_version", seen_gen=":generation"), "set_conflict": update(E, conflict_id=":conflict_id"),
        "keep_local": update(E, server_version=":server_version", local_rev="local_rev + 1", intent=":intent", conflict_id="NULL"),
        "take_server": update(E, server_version=":server_version", acked_rev="local_rev", intent="NULL", group_id="NULL", conflict_id="NULL"),
        "discard_local": update(K, local_rev="acked_rev", pushing_rev="acked_rev", server_version="NULL", intent="NULL", group_id="NULL", conflict_id="NULL"),
        "abandon_local": update(K, server_version=f"CASE WHEN {_DIRTY} THEN NULL ELSE server_version END", local_rev="acked_rev", pushing_rev="acked_rev", intent="NULL", group_id="NULL", conflict_id="NULL"),
        "delete_stale": delete(f"{K} AND seen_gen < :generation AND {_CLEAN}"), "delete": delete(E), "delete_unconfirmed": delete(f"{K} AND {_DIRTY} AND server_version IS NULL"), "delete_scope": delete(S),
    },
    "groups": {
        "find": read(G), "next_ordinal": read(K, n="coalesce(max(ord), 0) + 1"), "of_collection": read(K), "head": read(K, tail="ORDER BY ord LIMIT 1"),
        "next_pending_after": read(f"{K} AND state = :state AND ord > :ord", tail="ORDER BY ord LIMIT 1"), "observe_in_state": read(f"{K} AND state = :state"),
        "insert": insert(group_id="concat('n', group_id)", ord="ord + 1000000"), "update_state": update(G, state=":state"),
        "record_attempt": update(G, state=":state", attempts="attempts + 1", next_retry_at=":next_retry_at", last_error=":error"), "clear_retry_waits": update(f"{S} AND state = :state", next_retry_at="NULL"),
        "record_refusal": update(G, state=":state", attempts="attempts + 1", next_retry_at="NULL", last_error=":error", reject_code=":code", reject_entity_type=":entity_type", reject_entity_id=":entity_id"),
        "update_ordinal": update(G, ord=":ord"), "set_dependency_merges": update(G, dependency_merges=":count"), "delete": delete(G), "delete_collection": delete(K), "delete_scope": delete(S),
    },
    "replicas": {
        "find": read(K), "observe": read(K), "upsert": upsert("generation < 3", "a.scope_id = b.scope_id AND a.collection_id = b.collection_id", scope_id="CASE WHEN generation = 1 THEN 's9' ELSE scope_id END", phase="'BLOCKED'"),
        "advance_cursor": update(K, cursor=":cursor", last_pull_at=":at", **_WELL), "record_pull": update(K, last_pull_at=":at"), "update_cursor": update(K, cursor=":cursor"), "update_phase": update(K, phase=":phase"),
        "update_schema_fingerprint": update(K, schema_fingerprint=":fingerprint"), "begin_bootstrap": update(K, generation="generation + 1", phase="'BOOTSTRAPPING'", bootstrap_page="NULL"), "update_bootstrap_page": update(K, bootstrap_page=":page"),
        "finish_bootstrap": update(K, cursor=":cursor", phase="'LIVE'", bootstrap_page="NULL", last_pull_at=":at", **_WELL), "set_epoch": update(f"{K} AND (epoch IS NULL OR epoch <> :epoch)", epoch=":epoch"),
        "forget_incarnation": update(K, cursor="NULL", epoch="NULL", bootstrap_page="NULL", phase=":phase", **_WELL), "record_failure": update(K, last_error=":error", failure_count="failure_count + 1"),
        "record_push": update(K, last_push_at=":at", **_WELL), "delete_scope": delete(S),
    },
    "conflicts": {
        "find": read(C), "open_ids": read(K, "conflict_id, detected_at"), "observe": read(K), "observe_count": read(K, n=_COUNT), "insert": insert(conflict_id="concat('n', conflict_id)"),
        "refresh": update(C, local_payload=":local", server_payload=":server", server_version=":server_version"), "delete": delete(C), "delete_collection": delete(K), "delete_scope": delete(S),
    },
    "inbox": {
        "insert_batches": insert(seq="concat('n', seq)"), "insert_ops": insert(seq="concat('n', seq)"), "next_received": read(K, n="coalesce(max(received_ord), 0) + 1"),
        "oldest_pending": read(f"{K} AND state = :state", tail="ORDER BY received_ord LIMIT 1"), "ops_of": read(Q), "delete_batch": delete(Q), "delete_ops": delete(Q), "delete_batches": delete(K), "delete_all_ops": delete(K),
    },
    "identity": {"find": read(S), "insert": insert(scope_id="concat('n', scope_id)"), "delete": delete(S)},
    "files": {
        "find": read(B), "observe": read(B), "all": read(K), "all_of_scope": read(S), "observe_referenced": read(f"{K} AND {_LINKED.format('')}"), "unreferenced": read(f"{K} AND NOT {_LINKED.format('')}"),
        "waiting": read(f"{K} AND state = :state AND wanted AND {_DUE} AND {_LINKED.format('')}", tail="ORDER BY attempts, insert_ord LIMIT 3"),
        "next_retry_at": read(f"{K} AND wanted AND next_retry_at > :now AND {_OPEN} AND {_LINKED.format('')}", n="min(next_retry_at)"), "observe_count": read(f"{K} AND state = :state AND wanted AND {_LINKED.format('')}", n=_COUNT),
        "upsert": upsert("attempts > 1", "a.scope_id = b.scope_id AND a.collection_id = b.collection_id AND a.blob_id = b.blob_id", blob_id="CASE WHEN attempts = 2 THEN concat('n', blob_id) ELSE blob_id END", transferred="1"),
        "set_state": update(B, state=":state", **_CLEAR, transferred="0"), "record_failure": update(B, attempts="attempts + 1", last_error=":error", next_retry_at=":next_retry_at", transferred="0"),
        "record_wait": update(B, last_error=":error", next_retry_at=":next_retry_at", transferred="0"), "reset_attempts": update(B, **_CLEAR), "clear_retry_waits": update(f"{S} AND {_OPEN}", next_retry_at="NULL"),
        "set_wanted": update(B, wanted=":wanted"), "want_eager": update(f"{K} AND NOT wanted AND {_LINKED.format(chr(32) + 'AND r.fetch = ' + chr(39) + 'EAGER' + chr(39))}", wanted="TRUE"), "set_transferred": update(B, transferred=":transferred"),
        "set_declaration": update(B, content_type=":content_type", size=":size", checksum=":checksum"), "delete": delete(B), "delete_scope": delete(S), "delete_all": delete(K),
    },
    "file_refs": {
        "of": read(E), "required": read(f"{E} AND binding = 'REQUIRED'"), "reference_count": read(B, n=_COUNT),
        "unknown": read(f"{K} AND NOT EXISTS (SELECT 1 FROM t_files f WHERE f.scope_id = b.scope_id AND f.collection_id = b.collection_id AND f.blob_id = b.blob_id)", "scope_id, collection_id, blob_id", distinct=True),
        "upsert": upsert("seen_gen = 1", "a.scope_id = b.scope_id AND a.collection_id = b.collection_id AND a.entity_type = b.entity_type AND a.entity_id = b.entity_id AND a.blob_id = b.blob_id", blob_id="CASE WHEN b.fetch = 'EAGER' THEN blob_id ELSE concat('n', blob_id) END", seen_gen="9"),
        "clear": delete(E), "sweep": delete(f"{K} AND seen_gen < :generation"), "delete_scope": delete(S), "delete_all": delete(K),
    },
    "application": {
        "wallet": read("id = :id"), "wallets": read("TRUE"), "upsert_wallet": upsert("title <> 'BUILDING'", "a.id = b.id", id="CASE WHEN title = 'MACHINERY' THEN concat('n', id) ELSE id END", title="'new'"), "delete_wallet": delete("id = :id"),
        "transaction": read("id = :id"), "upsert_transaction": upsert("amount > 500", "a.id = b.id", id="CASE WHEN amount > 5000 THEN concat('n', id) ELSE id END", amount="amount + 1"), "delete_transaction": delete("id = :id"),
    },
}


def _rows(table: str, new: dict[str, str], where: str = "TRUE", source: str = "{t}") -> str:
    """SQL, for both engines, of the rows of a table with other values."""
    return "SELECT " + ", ".join(f"{new.get(c, 'b.' + c)} AS {c}" for c in _COLUMNS[table]) + f" FROM {source} b WHERE {where}"


def _all(columns: list[str], alias: str) -> str:
    return ", ".join(f"{alias}.{c} AS {c}" for c in columns)


def _spark(family: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        found, tables, parts = EXPECTED[family], {}, []
        needed = {statements.STATEMENTS[f"{family}.{name}"].table for name in found} | ({"file_refs", "files"} if family in ("files", "file_refs") else set())
        for name in sorted(needed):
            tables[name] = stored(view(spark, sf, f"t_{name}"), f"table-{name}")
        columns = list(dict.fromkeys(c for name in tables for c in _COLUMNS[name]))
        for name, (kind, *rest) in found.items():
            table = statements.STATEMENTS[f"{family}.{name}"].table
            given = dict(GIVEN[family])
            if kind in ("insert", "upsert"):
                given["rows"] = spark.sql(_rows(table, rest[-1], rest[0] if kind == "upsert" else "TRUE"), t=tables[table])
            out = statements.run(f"{family}.{name}", tables, **given)
            parts.append(out.select(F.lit(name).alias("statement"), *[(F.col(c) if c in out.columns else F.lit(None)).cast("string").alias(c) for c in [*columns, "n"]]))
        return reduce(DataFrame.unionAll, parts)

    run.__name__ = f"stmt_{family}"
    run.__doc__ = f"All statements of the family {family} over whole tables."
    return run


def _sql(family: str) -> str:
    found, parts = EXPECTED[family], []
    table_of = {name: statements.STATEMENTS[f"{family}.{name}"].table for name in found}
    tables = sorted(set(table_of.values()) | ({"file_refs", "files"} if family in ("files", "file_refs") else set()))
    columns = list(dict.fromkeys(c for name in tables for c in _COLUMNS[name]))
    for name, (kind, *rest) in found.items():
        table, own = table_of[name], _COLUMNS[table_of[name]]
        n = "NULL"
        if kind == "read":
            where, shown, tail, n, distinct = rest
            own = [x.strip() for x in shown.split(",")] if shown else own
            body = f"SELECT {n} AS n FROM t_{table} b WHERE {where}" if n else f"SELECT {'DISTINCT ' if distinct else ''}{_all(own, 'b')} FROM t_{table} b WHERE {where} {tail}"
            own, n = ([], "n") if n else (own, "NULL")
        elif kind == "update":
            hit = f"coalesce({rest[0]}, FALSE)"
            body = "SELECT " + ", ".join(f"CASE WHEN {hit} THEN {rest[1][c]} ELSE b.{c} END AS {c}" if c in rest[1] else f"b.{c} AS {c}" for c in own) + f" FROM t_{table} b"
        elif kind == "delete":
            body = f"SELECT * FROM t_{table} b WHERE NOT coalesce({rest[0]}, FALSE)"
        elif kind == "insert":
            body = f"SELECT {_all(own, 'a')} FROM t_{table} a UNION ALL {_rows(table, rest[0], source='t_' + table)}"
        else:
            new = _rows(table, rest[2], rest[0], "t_" + table)
            body = f"SELECT {_all(own, 'a')} FROM t_{table} a WHERE NOT EXISTS (SELECT 1 FROM ({new}) b WHERE {rest[1]}) UNION ALL {new}"
        for key, value in sorted(GIVEN[family].items(), key=lambda x: -len(x[0])):
            body = body.replace(f":{key}", "TRUE" if value is True else "FALSE" if value is False else str(value) if isinstance(value, int) else f"'{value}'")
        shown = ", ".join(f"CAST({'x.' + c if c in own else 'NULL'} AS VARCHAR) AS {c}" for c in columns)
        parts.append(f"SELECT '{name}' AS statement, {shown}, CAST({n} AS VARCHAR) AS n FROM ({body}) x")
    return with_views(" UNION ALL ".join(parts))


QUERIES = {f"stmt_{family}": _spark(family) for family in EXPECTED}
ORACLE_SQL = {f"stmt_{family}": _sql(family) for family in EXPECTED}
