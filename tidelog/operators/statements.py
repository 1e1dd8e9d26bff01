"""Keyed reads and rewrites of the replica's tables.

Parquet has no update in place, so a write is a function from a table to the table after it. Every
statement is declared below as a `Read`, `Rewrite`, `Removal`, `Append` or `Upsert` under the table it
belongs to and run with `run(name, tables, **parameters)`. Predicates are plain columns, so Catalyst
prunes and pushes them down; EXISTS is a semi join and NOT EXISTS an anti join.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import BLOB, COLLECTION, ENTITY, MOVING, REPLICA_TABLES, shaped

Params = dict
Rule = Callable[[Params], Column]
Tables = dict[str, DataFrame]


def given(name: str) -> Rule:
    return lambda p: F.lit(p.get(name))


def const(value: object) -> Rule:
    return lambda _: F.lit(value)


def old(name: str, plus: int = 0) -> Rule:
    return lambda _: F.col(name) + plus if plus else F.col(name)


def same(*names: str) -> Rule:
    """Each named column equals the parameter of its name; a null parameter matches nothing."""

    def rule(p: Params) -> Column:
        out = F.lit(True)
        for name in names:
            out = out & (F.col(name) == F.lit(p[name]))
        return out

    return rule


def also(*rules: Rule) -> Rule:
    def rule(p: Params) -> Column:
        out = rules[0](p)
        for r in rules[1:]:
            out = out & r(p)
        return out

    return rule


SCOPE, PLACE, THING, FILE = same("scope_id"), same(*COLLECTION), same(*ENTITY), same(*BLOB)
GROUP, CONFLICT, BATCH = same("group_id"), same("conflict_id"), same(*COLLECTION, "seq")


def dirty(_: Params) -> Column:
    """Edited since the last acknowledged revision."""
    return F.col("local_rev") > F.col("acked_rev")


def clean(_: Params) -> Column:
    return F.col("local_rev") <= F.col("acked_rev")


def never_confirmed(_: Params) -> Column:
    return F.col("server_version").isNull()


def older(p: Params) -> Column:
    return F.col("seen_gen") < p["generation"]


def moving(_: Params) -> Column:
    return F.col("state").isin(*MOVING)


def wanted(_: Params) -> Column:
    return F.col("wanted")


@dataclass(frozen=True)
class Read:
    table: str
    where: Rule
    order: tuple[str, ...] = ()
    limit: int | str | None = None
    columns: tuple[str, ...] = ()
    #: Aggregate instead of rows.
    total: Callable[[], Column] | None = None
    #: (table, key columns, keep those that match): EXISTS or NOT EXISTS in another table.
    exists: tuple[str, tuple[str, ...], bool] | None = None
    distinct: bool = False

    def run(self, tables: Tables, p: Params) -> DataFrame:
        out = tables[self.table].where(self.where(p))
        if self.exists:
            other, key, match = self.exists
            out = out.join(tables[other].select(*key).distinct(), list(key), "left_semi" if match else "left_anti")
        out = out.select(*self.columns) if self.columns else out
        out = out.distinct() if self.distinct else out
        if self.total:
            return out.agg(self.total())
        out = out.orderBy(*self.order) if self.order else out
        limit = p[self.limit] if isinstance(self.limit, str) else self.limit
        return out.limit(limit) if limit is not None else out


@dataclass(frozen=True)
class Rewrite:
    table: str
    where: Rule
    sets: dict[str, Rule] = field(default_factory=dict)
    exists: tuple[str, tuple[str, ...], Rule] | None = None

    def hit(self, tables: Tables, p: Params) -> Column:
        return F.coalesce(self.where(p), F.lit(False))

    def run(self, tables: Tables, p: Params) -> DataFrame:
        """All right-hand sides see the row as it was."""
        rows, hit = tables[self.table], self.hit(tables, p)
        names = rows.columns
        if self.exists:
            other, key, rule = self.exists
            rows = rows.join(tables[other].where(rule(p)).select(*key).distinct().withColumn("_there", F.lit(True)), list(key), "left")
            hit = hit & F.coalesce("_there", F.lit(False))
        types = dict(tables[self.table].dtypes)
        return rows.select(*[F.when(hit, self.sets[c](p).cast(types[c])).otherwise(F.col(c)).alias(c) if c in self.sets else F.col(c) for c in names])

    def count(self, tables: Tables, p: Params) -> int:
        """How many rows it changes."""
        return tables[self.table].where(self.hit(tables, p)).count()


@dataclass(frozen=True)
class Removal:
    table: str
    where: Rule

    def run(self, tables: Tables, p: Params) -> DataFrame:
        return tables[self.table].where(~F.coalesce(self.where(p), F.lit(False)))


@dataclass(frozen=True)
class Append:
    table: str

    def run(self, tables: Tables, p: Params) -> DataFrame:
        return tables[self.table].unionByName(shaped(p["rows"], REPLICA_TABLES[self.table]))


@dataclass(frozen=True)
class Upsert:
    table: str
    key: tuple[str, ...]

    def run(self, tables: Tables, p: Params) -> DataFrame:
        new = shaped(p["rows"], REPLICA_TABLES[self.table]) if self.table in REPLICA_TABLES else p["rows"]
        return tables[self.table].join(new.select(*self.key), list(self.key), "left_anti").unionByName(new)


def _count() -> Column:
    return F.count(F.lit(1)).alias("n")


def _next(column: str) -> Callable[[], Column]:
    return lambda: (F.coalesce(F.max(column), F.lit(0)) + 1).cast("long").alias("n")


_no = const(None)
_rest = {"last_error": _no, "failure_count": const(0)}
_refs = ("file_refs", tuple(BLOB))

RECORDS = {
    "find": Read("records", THING),
    "upsert": Upsert("records", tuple(ENTITY)),
    "mark_mutated": Rewrite("records", THING, {"local_rev": old("local_rev", 1), "intent": given("intent"), "group_id": given("group_id")}),
    "group_of": Read("records", THING, columns=("group_id",)),
    "reassign_group": Rewrite("records", same("group_id"), {"group_id": given("target")}),
    "of_group": Read("records", GROUP, order=("entity_type", "entity_id")),
    "capture_pushing": Rewrite("records", GROUP, {"pushing_rev": old("local_rev")}),
    "acknowledge": Rewrite("records", THING, {"server_version": given("server_version"), "acked_rev": old("pushing_rev")}),
    "release_clean": Rewrite("records", also(GROUP, clean), {"group_id": _no, "intent": _no}),
    "update_server_version": Rewrite("records", THING, {"server_version": given("server_version"), "seen_gen": given("generation")}),
    "set_conflict": Rewrite("records", THING, {"conflict_id": given("conflict_id")}),
    "keep_local": Rewrite("records", THING, {"server_version": given("server_version"), "local_rev": old("local_rev", 1), "intent": given("intent"), "conflict_id": _no}),
    "take_server": Rewrite("records", THING, {"server_version": given("server_version"), "acked_rev": old("local_rev"), "intent": _no, "group_id": _no, "conflict_id": _no}),
    "open_conflicts_of_group": Read("records", also(GROUP, lambda _: F.col("conflict_id").isNotNull()), total=_count),
    "pending_count": Read("records", also(PLACE, dirty), total=_count),
    "observe_pending_count": Read("records", also(PLACE, dirty), total=_count),
    "stale": Read("records", also(PLACE, older, clean)),
    "delete_stale": Removal("records", also(PLACE, older, clean)),
    "delete": Removal("records", THING),
    "discard_local": Rewrite("records", PLACE, {"local_rev": old("acked_rev"), "pushing_rev": old("acked_rev"), "server_version": _no, "intent": _no, "group_id": _no, "conflict_id": _no}),
    "unconfirmed": Read("records", also(PLACE, dirty, never_confirmed)),
    "delete_unconfirmed": Removal("records", also(PLACE, dirty, never_confirmed)),
    "abandon_local": Rewrite(
        "records", PLACE,
        {"server_version": lambda p: F.when(~dirty(p), F.col("server_version")), "local_rev": old("acked_rev"), "pushing_rev": old("acked_rev"), "intent": _no, "group_id": _no, "conflict_id": _no},
    ),
    "delete_scope": Removal("records", SCOPE),
}

GROUPS = {
    "insert": Append("groups"),
    "find": Read("groups", GROUP),
    "next_ordinal": Read("groups", PLACE, total=_next("ord")),
    "of_collection": Read("groups", PLACE, order=("ord",)),
    "head": Read("groups", PLACE, order=("ord",), limit=1),
    "next_pending_after": Read("groups", also(PLACE, same("state"), lambda p: F.col("ord") > p["ord"]), order=("ord",), limit=1),
    "update_state": Rewrite("groups", GROUP, {"state": given("state")}),
    "record_attempt": Rewrite("groups", GROUP, {"state": given("state"), "attempts": old("attempts", 1), "next_retry_at": given("next_retry_at"), "last_error": given("error")}),
    "clear_retry_waits": Rewrite("groups", also(SCOPE, same("state")), {"next_retry_at": _no}),
    "record_refusal": Rewrite(
        "groups", GROUP,
        {"state": given("state"), "attempts": old("attempts", 1), "next_retry_at": _no, "last_error": given("error"), "reject_code": given("code"), "reject_entity_type": given("entity_type"), "reject_entity_id": given("entity_id")},
    ),
    "observe_in_state": Read("groups", also(PLACE, same("state")), order=("ord",)),
    "update_ordinal": Rewrite("groups", GROUP, {"ord": given("ord")}),
    "set_dependency_merges": Rewrite("groups", GROUP, {"dependency_merges": given("count")}),
    "delete": Removal("groups", GROUP),
    "delete_collection": Removal("groups", PLACE),
    "delete_scope": Removal("groups", SCOPE),
}

REPLICAS = {
    "find": Read("replicas", PLACE),
    "observe": Read("replicas", PLACE),
    "upsert": Upsert("replicas", tuple(COLLECTION)),
    "advance_cursor": Rewrite("replicas", PLACE, {"cursor": given("cursor"), "last_pull_at": given("at"), **_rest}),
    "record_pull": Rewrite("replicas", PLACE, {"last_pull_at": given("at")}),
    "update_cursor": Rewrite("replicas", PLACE, {"cursor": given("cursor")}),
    "update_phase": Rewrite("replicas", PLACE, {"phase": given("phase")}),
    "update_schema_fingerprint": Rewrite("replicas", PLACE, {"schema_fingerprint": given("fingerprint")}),
    "begin_bootstrap": Rewrite("replicas", PLACE, {"generation": old("generation", 1), "phase": const("BOOTSTRAPPING"), "bootstrap_page": _no}),
    "update_bootstrap_page": Rewrite("replicas", PLACE, {"bootstrap_page": given("page")}),
    "finish_bootstrap": Rewrite("replicas", PLACE, {"cursor": given("cursor"), "phase": const("LIVE"), "bootstrap_page": _no, "last_pull_at": given("at"), **_rest}),
    "set_epoch": Rewrite("replicas", also(PLACE, lambda p: ~F.col("epoch").eqNullSafe(p["epoch"])), {"epoch": given("epoch")}),
    "forget_incarnation": Rewrite("replicas", PLACE, {"cursor": _no, "epoch": _no, "bootstrap_page": _no, "phase": given("phase"), **_rest}),
    "record_failure": Rewrite("replicas", PLACE, {"last_error": given("error"), "failure_count": old("failure_count", 1)}),
    "record_push": Rewrite("replicas", PLACE, {"last_push_at": given("at"), **_rest}),
    "delete_scope": Removal("replicas", SCOPE),
}

CONFLICTS = {
    "insert": Append("conflicts"),
    "refresh": Rewrite("conflicts", CONFLICT, {"local_payload": given("local"), "server_payload": given("server"), "server_version": given("server_version")}),
    "find": Read("conflicts", CONFLICT),
    "open_ids": Read("conflicts", PLACE, order=("detected_at", "conflict_id"), columns=("conflict_id", "detected_at")),
    "observe": Read("conflicts", PLACE, order=("detected_at", "conflict_id")),
    "observe_count": Read("conflicts", PLACE, total=_count),
    "delete": Removal("conflicts", CONFLICT),
    "delete_collection": Removal("conflicts", PLACE),
    "delete_scope": Removal("conflicts", SCOPE),
}

INBOX = {
    "insert_batches": Append("inbox_batches"),
    "insert_ops": Append("inbox_ops"),
    "next_received": Read("inbox_batches", PLACE, total=_next("received_ord")),
    "oldest_pending": Read("inbox_batches", also(PLACE, same("state")), order=("received_ord",), limit=1),
    "ops_of": Read("inbox_ops", BATCH, order=("ordinal",)),
    "delete_batch": Removal("inbox_batches", BATCH),
    "delete_ops": Removal("inbox_ops", BATCH),
    "delete_batches": Removal("inbox_batches", PLACE),
    "delete_all_ops": Removal("inbox_ops", PLACE),
}

IDENTITY = {"find": Read("identity", SCOPE), "insert": Append("identity"), "delete": Removal("identity", SCOPE)}

_due = lambda p: F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= p["now"])
_fresh = {"last_error": _no, "attempts": const(0), "next_retry_at": _no}

FILES = {
    "find": Read("files", FILE),
    "observe": Read("files", FILE),
    "upsert": Upsert("files", tuple(BLOB)),
    "set_state": Rewrite("files", FILE, {"state": given("state"), **_fresh, "transferred": const(0)}),
    "record_failure": Rewrite("files", FILE, {"attempts": old("attempts", 1), "last_error": given("error"), "next_retry_at": given("next_retry_at"), "transferred": const(0)}),
    "record_wait": Rewrite("files", FILE, {"last_error": given("error"), "next_retry_at": given("next_retry_at"), "transferred": const(0)}),
    "reset_attempts": Rewrite("files", FILE, _fresh),
    "clear_retry_waits": Rewrite("files", also(SCOPE, moving), {"next_retry_at": _no}),
    "set_wanted": Rewrite("files", FILE, {"wanted": given("wanted")}),
    "want_eager": Rewrite("files", also(PLACE, lambda _: ~F.col("wanted")), {"wanted": const(True)}, (*_refs, lambda _: F.col("fetch") == "EAGER")),
    "set_transferred": Rewrite("files", FILE, {"transferred": given("transferred")}),
    "set_declaration": Rewrite("files", FILE, {"content_type": given("content_type"), "size": given("size"), "checksum": given("checksum")}),
    "waiting": Read("files", also(PLACE, same("state"), wanted, _due), order=("attempts", "insert_ord"), limit="limit", exists=(*_refs, True)),
    "next_retry_at": Read("files", also(PLACE, wanted, moving, lambda p: F.col("next_retry_at") > p["now"]), total=lambda: F.min("next_retry_at").alias("n"), exists=(*_refs, True)),
    "observe_count": Read("files", also(PLACE, same("state"), wanted), total=_count, exists=(*_refs, True)),
    "observe_referenced": Read("files", PLACE, order=("insert_ord",), exists=(*_refs, True)),
    "unreferenced": Read("files", PLACE, exists=(*_refs, False)),
    "all": Read("files", PLACE),
    "delete": Removal("files", FILE),
    "all_of_scope": Read("files", SCOPE),
    "delete_scope": Removal("files", SCOPE),
    "delete_all": Removal("files", PLACE),
}

FILE_REFS = {
    "upsert": Upsert("file_refs", (*ENTITY, "blob_id")),
    "of": Read("file_refs", THING),
    "required": Read("file_refs", also(THING, lambda _: F.col("binding") == "REQUIRED")),
    "reference_count": Read("file_refs", FILE, total=_count),
    "unknown": Read("file_refs", PLACE, columns=tuple(BLOB), distinct=True, exists=("files", tuple(BLOB), False)),
    "clear": Removal("file_refs", THING),
    "sweep": Removal("file_refs", also(PLACE, older)),
    "delete_scope": Removal("file_refs", SCOPE),
    "delete_all": Removal("file_refs", PLACE),
}

#: An application's own tables, as an example: wallets and their transactions.
APPLICATION = {
    "wallet": Read("wallet", same("id")),
    "wallets": Read("wallet", const(True), order=("title", "id")),
    "upsert_wallet": Upsert("wallet", ("id",)),
    "delete_wallet": Removal("wallet", same("id")),
    "transaction": Read("ledger_transaction", same("id")),
    "upsert_transaction": Upsert("ledger_transaction", ("id",)),
    "delete_transaction": Removal("ledger_transaction", same("id")),
}

STATEMENTS = {
    f"{family}.{name}": statement
    for family, statements in {
        "records": RECORDS, "groups": GROUPS, "replicas": REPLICAS, "conflicts": CONFLICTS, "inbox": INBOX, "identity": IDENTITY, "files": FILES, "file_refs": FILE_REFS, "application": APPLICATION,
    }.items()
    for name, statement in statements.items()
}


def run(name: str, tables: Tables, **parameters: object) -> DataFrame:
    """The rows a statement reads, or its table after it."""
    return STATEMENTS[name].run(tables, parameters)


def applied(name: str, tables: Tables, **parameters: object) -> Tables:
    """tables after a writing statement."""
    statement = STATEMENTS[name]
    return tables | {statement.table: statement.run(tables, parameters)}
