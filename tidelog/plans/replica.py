"""A replica of collections: local edits out, the log's changes in, over a versioned store of its own."""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..errors import CollectionReset, LogError, PendingChanges
from ..operators import diagnostics, outbox, statements
from ..operators import files as file_ops
from ..operators import replica as reconcile
from ..schema import BLOB, COLLECTION, ENTITY, REPLICA_TABLES, shaped
from ..sources.shared import stored
from ..sources.store import VersionedStore
from .engine import LogEngine

DOCUMENTS = "scope_id string, collection_id string, entity_type string, entity_id string, data string"


@dataclass(frozen=True)
class Adapter:
    """What the application tells a replica. The application's rows are the replica's table `documents`.

    files: from documents (ENTITY, data) to ENTITY, files (array of struct(blob_id, binding)); without
    it documents name no files. fetch: how files that are new here are fetched. apply_remote: called
    with the operations about to be applied (ENTITY, op, payload); an error stops the step and leaves
    it to be repeated. resolve: from an open conflict to (resolution, data), or None to leave it open.
    on_rejected: called with a refused group. held: which of some files (BLOB) have bytes here. taken:
    which files that nothing refers to any more the application takes back.
    """

    files: Callable[[DataFrame], DataFrame] | None = None
    fetch: str = "EAGER"
    apply_remote: Callable[[DataFrame], None] | None = None
    resolve: Callable[[Row], tuple[str, str | None] | None] | None = None
    on_rejected: Callable[[Row], None] | None = None
    held: Callable[[DataFrame], DataFrame] = lambda rows: rows.where("false")
    taken: Callable[[DataFrame], DataFrame] = lambda rows: rows.where("false")


class Replica:
    """One client's copy of some collections.

    Every step reads one version of the store and commits one, so a crash repeats a step whole. What
    the log sends is staged in the inbox first; the cursor moves only with what has been applied.
    move: sends and fetches the bytes of some files (next_transfers) and returns BLOB, outcome, message.
    """

    def __init__(
        self,
        store: VersionedStore,
        log: LogEngine,
        client_id: str | None,
        clock: Callable[[], datetime.datetime],
        schema: str = "1",
        new_token: Callable[[], str] = lambda: uuid.uuid4().hex,
        adapter: Adapter = Adapter(),
        move: Callable[[DataFrame], DataFrame] | None = None,
    ):
        self.store, self.log, self.given_id, self.clock, self.schema, self.new_token = store, log, client_id, clock, schema, new_token
        self.adapter, self.move = adapter, move
        self.paused: set[str] = set()
        self._offered: dict[tuple[str, str], frozenset[str]] = {}
        store.migrate()

    @property
    def spark(self):
        return self.store.spark

    def _ms(self) -> int:
        return int(self.clock().timestamp() * 1000)

    def _commit(self, base: int, before: dict[str, DataFrame], after: dict[str, DataFrame]) -> None:
        self.store.commit(base, replace={k: v for k, v in after.items() if before.get(k) is not v})

    def _open(self, scope: str, collection: str) -> tuple[int, dict[str, DataFrame], dict]:
        """Version, tables and the collection's state, created if new; a changed application schema asks for a snapshot."""
        base = self.store.version()
        state = self.store.read(base)
        row = statements.run("replicas.find", state, scope_id=scope, collection_id=collection).first()
        if row is None:
            new = self.spark.createDataFrame([(scope, collection, "NEW", 0, self.schema, 0)], "scope_id string, collection_id string, phase string, generation long, schema_fingerprint string, failure_count int")
            self._commit(base, state, statements.applied("replicas.upsert", state, rows=new))
            return self._open(scope, collection)
        if row["schema_fingerprint"] != self.schema:
            self._commit(base, state, state | {"replicas": reconcile.schema_reconciled(state["replicas"], F.lit(self.schema))})
            return self._open(scope, collection)
        return base, state, row.asDict()

    def client_id(self, scope: str) -> str:
        """The id given, or one made once for the scope and kept in the store."""
        if self.given_id is not None:
            return self.given_id
        base = self.store.version()
        state = self.store.read(base)
        row = statements.run("identity.find", state, scope_id=scope).first()
        if row is None:
            new = self.spark.createDataFrame([(scope, str(uuid.uuid4()), self._ms())], REPLICA_TABLES["identity"])
            self._commit(base, state, statements.applied("identity.insert", state, rows=new))
            return self.client_id(scope)
        return row["client_id"]

    def _new_id(self, *parts: str):
        """Ids of the groups or conflicts that one step makes: one token for the step, so that recomputed rows keep theirs."""
        return F.sha1(F.concat_ws("/", F.lit(self.new_token()), *[F.col(p).cast("string") for p in parts]))

    def _with_references(self, refs: DataFrame, ops: DataFrame, generation) -> DataFrame:
        """file_refs after operations (ENTITY, op, payload) were written here."""
        if self.adapter.files is None:
            return refs
        named = self.adapter.files(ops.where("op = 'upsert'").select(*ENTITY, F.col("payload").alias("data")))
        return stored(file_ops.declared(refs, ops.select(*ENTITY).join(named, ENTITY, "left"), generation, F.lit(self.adapter.fetch)), "refs")

    def _with_documents(self, documents: DataFrame, ops: DataFrame) -> DataFrame:
        kept = documents.join(ops.select(*ENTITY), ENTITY, "left_anti")
        return kept.unionByName(shaped(ops.where("op = 'upsert'").withColumn("data", F.col("payload")), DOCUMENTS))

    # -- edits

    def mutate(self, scope: str, collection: str, writes: list[tuple[str, str, str | None]]) -> None:
        """Write documents (type, id, JSON text; None deletes) and queue them as one atomic change. No writes: nothing."""
        if not writes:
            return
        base, state, row = self._open(scope, collection)
        last = {(t, i): d for t, i, d in writes}
        rows = [(scope, collection, 1, t, i, "DELETE" if d is None else "UPSERT", "delete" if d is None else "upsert", d) for (t, i), d in last.items()]
        edits = self.spark.createDataFrame(rows, "scope_id string, collection_id string, tx long, entity_type string, entity_id string, intent string, op string, payload string")
        generations = state["replicas"].select(*COLLECTION, "generation")
        records, groups = outbox.queued(edits.drop("op", "payload"), state["records"], state["groups"], generations, self._new_id("component"))
        documents = self._with_documents(state["documents"], edits)
        refs = self._with_references(state["file_refs"], edits, F.lit(row["generation"]))
        self._commit(base, state, state | {"records": stored(records, "r"), "groups": stored(groups, "g"), "documents": documents, "file_refs": refs})

    def adopt(self, scope: str, collection: str, limit: int = 500) -> int:
        """Queue documents that stood here before the replica; returns how many."""
        base, state, row = self._open(scope, collection)
        own = state["documents"].where((F.col("scope_id") == scope) & (F.col("collection_id") == collection))
        rows = own.withColumn("position", F.struct("entity_type", "entity_id"))
        chunks = stored(outbox.adopted(rows, state["records"], limit), "adopted")
        found = chunks.count()
        if found:
            marks = chunks.select(*ENTITY, F.col("chunk").alias("tx"), F.lit("UPSERT").alias("intent"))
            records, groups = outbox.queued(marks, state["records"], state["groups"], state["replicas"].select(*COLLECTION, "generation"), self._new_id("component"))
            self._commit(base, state, state | {"records": stored(records, "r"), "groups": stored(groups, "g")})
        return found

    def push_once(self, scope: str, collection: str) -> str:
        """Send the head of the queue; returns empty, waiting, waiting_on_files, applied, conflict, rejected, reset or failed.

        A group waits for the files that its documents require. If the log can't be reached the group
        goes back to the queue and waits; a group whose answer was lost in a crash is sent again under
        its id and gets its first answer.
        """
        base, state, row = self._open(scope, collection)
        mine = lambda df: df.where((F.col("scope_id") == scope) & (F.col("collection_id") == collection))
        head, idle = outbox.heads(mine(state["groups"]), state["records"])
        head = outbox.readiness(head, self._ms()).first()
        dropped = state["groups"].join(idle.select("group_id"), "group_id", "left_anti")
        if head is None:
            self._commit(base, state, state | {"groups": stored(dropped, "g")})
            return "empty"
        if head["waits_for"]:
            return "waiting"
        own = state["records"].where(F.col("group_id") == head["group_id"])
        if self.adapter.files is not None and not outbox.blocked_on_files(own, state["file_refs"], state["files"]).isEmpty():
            return "waiting_on_files"
        client = self.client_id(scope)
        base, state, row = self._open(scope, collection)
        dropped = state["groups"].join(idle.select("group_id"), "group_id", "left_anti")
        groups, records = outbox.rebuilt(dropped, state["records"], self._new_id("group_id", "ord"))
        groups, records = stored(groups, "g"), stored(records, "r")
        at = groups.where((F.col("ord") == head["ord"]) & (F.col("scope_id") == scope) & (F.col("collection_id") == collection))
        named = (state["file_refs"], state["files"]) if self.adapter.files is not None else ()
        edits = stored(outbox.operations(at, records, state["documents"], *named), "operations")
        groups, records = outbox.sent(groups, records, at)
        base = self.store.commit(base, replace={"groups": groups, "records": records})
        state = self.store.read(base)
        if not (large := outbox.oversized(edits, self.log.limits.operations, self.log.published_limits()["document_bytes"])).isEmpty():
            answers = large.select("group_id", F.lit("TOO_LARGE").alias("code"), F.col("reason").alias("message"), F.lit(None).cast("string").alias("entity_type"), F.lit(None).cast("string").alias("entity_id"))
            self._refuse(base, state, answers)
            return "rejected"
        envelope = stored(outbox.envelopes(edits), "envelope")
        request = envelope.withColumns({"client_id": F.lit(client), "arrival": F.lit(1).cast("long")})
        try:
            answer = stored(self.log.push(request, {(scope, collection): row["epoch"]}), "answer")
        except CollectionReset:
            self._commit(base, state, statements.applied("replicas.forget_incarnation", state, scope_id=scope, collection_id=collection, phase="NEW"))
            return "reset"
        except Exception as lost:  # whatever keeps the log from answering, the edits stay queued
            failure = envelope.select("group_id", F.lit(str(lost)[:200]).alias("message"), F.lit(getattr(lost, "retry_after_ms", None)).cast("long").alias("retry_after_ms"))
            after = state | {"groups": stored(outbox.failed_push(state["groups"], failure, self._ms()), "g")}
            self._commit(base, state, statements.applied("replicas.record_failure", after, scope_id=scope, collection_id=collection, error=str(lost)[:200]))
            return "failed"
        found = answer.first()
        if found["status"] == "applied":
            ops = envelope.select(*COLLECTION, F.explode("ops").alias("o")).select(*COLLECTION, "o.entity_type", "o.entity_id").withColumn("server_version", F.lit(str(found["seq"])))
            groups, records = outbox.acknowledged(state["groups"], state["records"], ops, envelope.select("group_id"), self._new_id("group_id", "ord"))
            after = state | {"groups": stored(groups, "g"), "records": stored(records, "r")}
            self._commit(base, state, statements.applied("replicas.record_push", after, scope_id=scope, collection_id=collection, at=self._ms()))
        elif found["status"] == "conflict":
            kind = "array<struct<entity_type:string,entity_id:string,version:string,data:string>>"
            listed = answer.select(*COLLECTION, F.inline(F.from_json(F.get_json_object("response", "$.conflicts"), kind)))
            found_rows = listed.join(state["documents"].select(*ENTITY, F.col("data").alias("local_payload")), ENTITY, "left").withColumnsRenamed({"data": "server_payload", "version": "server_version"})
            conflicts, records = reconcile.opened(state["conflicts"], state["records"], found_rows, "PUSH", self._ms(), self._new_id(*ENTITY))
            after = state | {"conflicts": stored(conflicts, "c"), "records": stored(records, "r")}
            self._commit(base, state, statements.applied("groups.update_state", after, group_id=found["group_id"], state="CONFLICTED"))
        else:
            reason = answer.select("group_id", F.get_json_object("response", "$.code").alias("code"), F.get_json_object("response", "$.code").alias("message"), F.get_json_object("response", "$.entity_type").alias("entity_type"), F.get_json_object("response", "$.entity_id").alias("entity_id"))
            code = reason.first()["code"]
            if code == "DEPENDENCY":
                groups, records, _ = outbox.merged_after_dependency(state["groups"], state["records"], reason, self._ms(), self._new_id("group_id", "ord"))
                self._commit(base, state, state | {"groups": stored(groups, "g"), "records": stored(records, "r")})
            elif code == "BLOB_MISSING":
                groups, records, files = outbox.reuploading(state["groups"], state["records"], state["file_refs"], state["files"], reason, self._ms(), self._new_id("group_id", "ord"))
                self._commit(base, state, state | {"groups": stored(groups, "g"), "records": stored(records, "r"), "files": stored(files, "f")})
            else:
                self._refuse(base, state, reason)
        return found["status"]

    def _refuse(self, base: int, state: dict[str, DataFrame], answers: DataFrame) -> None:
        """Fail groups for good and tell the application."""
        groups = stored(outbox.refused(state["groups"], answers), "g")
        self._commit(base, state, state | {"groups": groups})
        if self.adapter.on_rejected:
            for row in groups.join(answers.select("group_id"), "group_id", "left_semi").collect():
                self.adapter.on_rejected(row)

    # -- the log's changes

    def bootstrap(self, scope: str, collection: str, limit: int = 500) -> None:
        """Fetch a snapshot page by page, resumable, then delete what it didn't mention."""
        base, state, row = self._open(scope, collection)
        here = {"scope_id": scope, "collection_id": collection}
        token = row["bootstrap_page"] if row["phase"] == "BOOTSTRAPPING" else None
        if token is None:
            after = statements.applied("replicas.begin_bootstrap", state, **here)
            for name in ("inbox.delete_batches", "inbox.delete_all_ops"):
                after = statements.applied(name, after, **here)
            self._commit(base, state, {k: stored(v, k) if state[k] is not v else v for k, v in after.items()})
        while True:
            base, state, row = self._open(scope, collection)
            page = self._asked(scope, collection, lambda token=token: self.log.snapshot(scope, collection, token, limit))
            generation = F.lit(row["generation"])
            items = [(scope, collection, r["entity_type"], r["entity_id"], str(r["version"]), r["data"]) for r in page.rows]
            actions = reconcile.classified_snapshot(self.spark.createDataFrame(items, "scope_id string, collection_id string, entity_type string, entity_id string, version string, payload string"), state["records"])
            after = self._take(state, stored(actions.withColumn("op", F.lit("upsert")), "actions"), generation)
            if page.has_more:
                token = page.next_cursor
                after = statements.applied("replicas.update_bootstrap_page", after, **here, page=token)
                self._commit(base, state, after)
                continue
            gone = stored(reconcile.stale(after["records"].where((F.col("scope_id") == scope) & (F.col("collection_id") == collection)), generation), "stale")
            after = after | {"documents": stored(after["documents"].join(gone.select(*ENTITY), ENTITY, "left_anti"), "d"), "records": stored(after["records"].join(gone.select(*ENTITY), ENTITY, "left_anti"), "r")}
            after = statements.applied("file_refs.sweep", after, **here, generation=row["generation"])
            after = statements.applied("replicas.finish_bootstrap", after, **here, cursor=page.next_cursor, at=self._ms())
            after = statements.applied("replicas.set_epoch", after, **here, epoch=page.epoch)
            self._commit(base, state, after)
            return

    def _take(self, state: dict[str, DataFrame], actions: DataFrame, generation) -> dict[str, DataFrame]:
        """State after classified operations (ENTITY, version, op, payload, action)."""
        taken = actions.where("action = 'apply'")
        if self.adapter.apply_remote:
            self.adapter.apply_remote(taken.select(*ENTITY, "op", "payload"))
        records = stored(reconcile.with_versions(state["records"], actions, generation), "r")
        documents = self._with_documents(state["documents"], taken)
        refs = self._with_references(state["file_refs"], taken, generation)
        clash = actions.where("action = 'conflict'").select(*ENTITY, F.col("payload").alias("server_payload"), F.col("version").alias("server_version"))
        clash = clash.join(state["documents"].select(*ENTITY, F.col("data").alias("local_payload")), ENTITY, "left")
        conflicts, records = reconcile.opened(state["conflicts"], records, clash, "PULL", self._ms(), self._new_id(*ENTITY))
        return state | {"records": stored(records, "r"), "documents": stored(documents, "d"), "conflicts": stored(conflicts, "c"), "file_refs": refs}

    def _asked(self, scope: str, collection: str, ask: Callable):
        """What the log answers; a failure is recorded with the collection and raised."""
        try:
            return ask()
        except Exception as lost:
            base, state, _ = self._open(scope, collection)
            failure = self.spark.createDataFrame([(scope, collection, type(lost).__name__, str(lost)[:200])], "scope_id string, collection_id string, kind string, message string")
            self._commit(base, state, state | {"replicas": stored(reconcile.failed_pull(state["replicas"], failure), "replicas")})
            raise

    def pull(self, scope: str, collection: str, limit: int | None = None) -> int:
        """Apply what the log has after the cursor; returns the number of batches. Lost history asks for a snapshot.

        Each page is staged in the inbox by one commit and applied by another, which moves the cursor:
        a page that came survives a crash and is applied without the log.
        """
        done = self._drain(scope, collection)
        while True:
            base, state, row = self._open(scope, collection)
            if row["phase"] == "RESYNC_REQUIRED":
                return done
            page = self._asked(scope, collection, lambda cursor=row["cursor"]: self.log.changes(scope, collection, cursor, limit))
            if page.rows:
                self._stage(base, state, scope, collection, page)
                done += self._drain(scope, collection)
            if not page.has_more:
                base, state, _ = self._open(scope, collection)
                self._commit(base, state, statements.applied("replicas.record_pull", state, scope_id=scope, collection_id=collection, at=self._ms()))
                return done

    def _stage(self, base: int, state: dict[str, DataFrame], scope: str, collection: str, page) -> None:
        """Append a page to the inbox."""
        here = (scope, collection)
        batches = [(*here, str(b["seq"]), b["cursor"], b["client_id"]) for b in page.rows]
        ops = [(*here, str(b["seq"]), n, o["entity_type"], o["entity_id"], o["op"], str(o["version"]), o["data"]) for b in page.rows for n, o in enumerate(b["ops"] or [])]
        rows = self.spark.createDataFrame(batches, "scope_id string, collection_id string, seq string, cursor string, origin_client_id string")
        have = statements.run("inbox.next_received", state, scope_id=scope, collection_id=collection).select(F.lit(scope).alias("scope_id"), F.lit(collection).alias("collection_id"), (F.col("n") - 1).alias("n"))
        after = statements.applied("inbox.insert_batches", state, rows=reconcile.inbox_rows(rows, have))
        after = statements.applied("inbox.insert_ops", after, rows=self.spark.createDataFrame(ops, REPLICA_TABLES["inbox_ops"]))
        replicas = statements.applied("replicas.set_epoch", after, scope_id=scope, collection_id=collection, epoch=page.epoch)
        self._commit(base, state, replicas)

    def _drain(self, scope: str, collection: str) -> int:
        """Apply what stands in the inbox, in one commit; returns the number of batches.

        Batches from the first one on with an operation that the replica doesn't know are dropped
        and the collection is fetched anew. A clean entity ends where its last change leaves it; an
        edited one takes the version of its last own change and a conflict with the last foreign one.
        """
        base, state, row = self._open(scope, collection)
        here = {"scope_id": scope, "collection_id": collection}
        mine = lambda df: df.where((F.col("scope_id") == scope) & (F.col("collection_id") == collection))
        batches = mine(state["inbox_batches"])
        bounds = batches.agg(F.count(F.lit(1)).alias("n"), F.max(F.col("seq").cast("long")).alias("last")).first()
        if not bounds["n"]:
            return 0
        known = F.coalesce(F.col("op").isin(*reconcile.KNOWN), F.lit(False))
        odd = mine(state["inbox_ops"]).where(~known).agg(F.min(F.col("seq").cast("long"))).first()[0]
        usable = batches.where(F.col("seq").cast("long") < odd) if odd is not None else batches
        ops = mine(state["inbox_ops"]).withColumn("_at", F.struct(F.col("seq").cast("long"), "ordinal")).join(usable.select("seq", "origin_client_id"), "seq")
        found = reconcile.classified(ops.select(*ENTITY, "version", "op", "payload", "origin_client_id", "_at"), state["records"], self.client_id(scope))
        actions = stored(reconcile.last_actions(found.where("action != 'skip'"), ["_at"], ["action"]), "actions")
        after = self._take(state, actions, F.lit(row["generation"]))
        last = usable.orderBy(F.col("seq").cast("long").desc()).first()
        if last is not None:
            after = statements.applied("replicas.advance_cursor", after, **here, cursor=last["cursor"], at=self._ms())
        if odd is not None:
            after = statements.applied("replicas.update_phase", after, **here, phase="RESYNC_REQUIRED")
        for name in ("inbox.delete_batches", "inbox.delete_all_ops"):
            after = statements.applied(name, after, **here)
        count = usable.count()
        self._commit(self.store.version() if self.given_id is None else base, state, after)
        return count

    def resolve(self, decisions: list[tuple[str, str, str | None]]) -> None:
        """Settle conflicts (id, keep_local | take_server | merged, data); groups without an open one go out again."""
        base = self.store.version()
        state = self.store.read(base)
        rows = self.spark.createDataFrame(decisions, "conflict_id string, resolution string, data string")
        if rows.join(state["conflicts"], "conflict_id", "left_anti").count():
            raise LogError("a conflict is unknown or has been resolved")
        conflicts, records, ops = reconcile.resolved(state["conflicts"], state["records"], rows)
        conflicts, records, ops = stored(conflicts, "c"), stored(records, "r"), stored(ops, "o")
        groups, records = reconcile.revived(state["groups"], records, self._new_id("group_id", "ord"))
        self._commit(base, state, state | {"conflicts": conflicts, "records": stored(records, "r"), "groups": stored(groups, "g"), "documents": self._with_documents(state["documents"], ops)})

    def offer_conflicts(self, scope: str, collection: str) -> int:
        """Offer open conflicts to the application, once unless the set of open ones has changed; returns how many it settled."""
        if self.adapter.resolve is None:
            return 0
        rows = statements.run("conflicts.observe", self.store.read(), scope_id=scope, collection_id=collection).collect()
        ids = frozenset(r["conflict_id"] for r in rows)
        if ids == self._offered.get((scope, collection), frozenset()):
            return 0
        decided = [(r["conflict_id"], *answer) for r in rows if (answer := self.adapter.resolve(r)) is not None]
        self._offered[scope, collection] = ids - {d[0] for d in decided}
        if decided:
            self.resolve(decided)
        return len(decided)

    def cycle(self, scope: str, collection: str) -> None:
        """A snapshot if needed, files, conflicts, the queue, the log's changes, files again. Nothing while the scope is paused."""
        if scope in self.paused:
            return
        _, _, row = self._open(scope, collection)
        if row["phase"] in ("NEW", "BOOTSTRAPPING", "RESYNC_REQUIRED") or row["cursor"] is None:
            self.bootstrap(scope, collection)
        self.reconcile_files()
        self.move_files()
        self.offer_conflicts(scope, collection)
        while self.push_once(scope, collection) == "applied":
            pass
        self.pull(scope, collection)
        self.reconcile_files()

    # -- files

    def _change_files(self, change: Callable[[dict[str, DataFrame]], DataFrame]) -> None:
        base = self.store.version()
        state = self.store.read(base)
        self._commit(base, state, state | {"files": stored(change(state), "f")})

    def reconcile_files(self) -> None:
        """Track what documents name, want what is eager, let go what the application takes back."""
        if self.adapter.files is None:
            return
        held, taken = self.adapter.held, self.adapter.taken
        self._change_files(lambda s: file_ops.reconciled(s["files"], s["file_refs"], held(s["file_refs"].select(*BLOB).distinct()), taken(s["files"].select(*BLOB))))

    def move_files(self) -> int:
        """Move files while some are due, a few of each collection at a time; returns how many moves ended, well or not.

        Each is marked UPLOADING or DOWNLOADING by a commit of its own before its bytes move.
        """
        done = 0
        while self.move is not None:
            base = self.store.version()
            state = self.store.read(base)
            due = stored(file_ops.next_transfers(state["files"], state["file_refs"], self._ms()), "due")
            if due.isEmpty():
                return done
            base = self.store.commit(base, replace={"files": stored(file_ops.started(state["files"], due), "f")})
            events = stored(self.move(due), "moved")
            self._change_files(lambda s, events=events: file_ops.transferred(s["files"], events, self._ms()))
            done += events.count()
        return done

    def next_wake(self) -> int | None:
        """When the earliest file that waits is due, in milliseconds."""
        state = self.store.read()
        return file_ops.next_wake(state["files"], state["file_refs"], self._ms()).agg(F.min("at")).first()[0]

    def retry_files(self, asked: DataFrame) -> None:
        """Try files (BLOB, held) again that were given up or wait."""
        self._change_files(lambda s: file_ops.retried(s["files"], asked))

    def request_files(self, asked: DataFrame) -> None:
        """Fetch files (BLOB, held) that documents name."""
        self._change_files(lambda s: file_ops.requested(s["files"], s["file_refs"], asked))

    def evict_files(self, asked: DataFrame) -> None:
        """The application gave up the bytes of files (BLOB)."""
        self._change_files(lambda s: file_ops.evicted(s["files"], asked))

    def remove_files(self, scope: str) -> None:
        """Forget a scope's files and references."""
        base = self.store.version()
        state = self.store.read(base)
        kept, refs = file_ops.erased(state["files"], state["file_refs"], F.col("scope_id") == scope)
        self._commit(base, state, state | {"files": stored(kept, "f"), "file_refs": stored(refs, "refs")})

    # -- what the host asks

    def discard(self, scope: str, collection: str) -> None:
        """Give up local changes: creations never confirmed go, the rest is fetched anew."""
        base, state, _ = self._open(scope, collection)
        here = {"scope_id": scope, "collection_id": collection}
        born = stored(statements.run("records.unconfirmed", state, **here), "born")
        after = state | {"documents": stored(state["documents"].join(born.select(*ENTITY), ENTITY, "left_anti"), "d")}
        for name in ("records.delete_unconfirmed", "records.abandon_local", "groups.delete_collection", "conflicts.delete_collection"):
            after = statements.applied(name, after, **here)
        self._commit(base, state, statements.applied("replicas.update_phase", after, **here, phase="RESYNC_REQUIRED"))

    def reset_to_log(self, scope: str, collection: str) -> None:
        """Follow a collection that was erased: outbox, conflicts, inbox and local changes go, then a snapshot."""
        base, state, _ = self._open(scope, collection)
        here = {"scope_id": scope, "collection_id": collection}
        after = state
        for name in ("groups.delete_collection", "conflicts.delete_collection", "inbox.delete_batches", "inbox.delete_all_ops", "records.discard_local", "files.delete_all", "file_refs.delete_all"):
            after = statements.applied(name, after, **here)
        self._commit(base, state, statements.applied("replicas.forget_incarnation", after, **here, phase="RESYNC_REQUIRED"))
        self.bootstrap(scope, collection)

    def pause(self, scope: str) -> None:
        self.paused.add(scope)

    def resume(self, scope: str) -> None:
        self.paused.discard(scope)

    def sign_out(self, scope: str) -> None:
        """End with a scope: refused while changes wait."""
        self.pause(scope)
        try:
            self.wipe(scope)
        except PendingChanges:
            self.resume(scope)
            raise

    def wipe(self, scope: str, force: bool = False) -> None:
        """Forget a scope; refused while changes wait, unless forced."""
        base = self.store.version()
        state = self.store.read(base)
        if not force and state["records"].where((F.col("scope_id") == scope) & reconcile.dirty()).count():
            raise PendingChanges(scope)
        after = state
        for family in ("records", "groups", "replicas", "conflicts", "files", "file_refs"):
            after = statements.applied(f"{family}.delete_scope", after, scope_id=scope)
        for table in ("inbox_batches", "inbox_ops", "identity", "documents"):
            after = after | {table: state[table].where(F.col("scope_id") != scope)}
        self._commit(base, state, after)

    def status(self) -> DataFrame:
        state = self.store.read()
        return diagnostics.states(state["replicas"], state["records"], state["conflicts"], state["files"], state["file_refs"])


def replica_store(spark, root: str) -> VersionedStore:
    return VersionedStore(spark, root, REPLICA_TABLES | {"documents": DOCUMENTS})



