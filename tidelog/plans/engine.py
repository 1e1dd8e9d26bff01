"""The log as a whole: pushes, reads, files and maintenance over a versioned store."""

from __future__ import annotations

import datetime
import time
import uuid
from collections import deque
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..errors import BlobRefused, CollectionReset, CommitConflict, CursorTooOld, UnknownBlob, UnknownCollection
from ..functions.tokens import make_page_token
from ..operators import blobs as file_ops
from ..operators import diagnostics, log_read, log_write, retention
from ..operators.log_write import Limits
from ..schema import BLOB, COLLECTION, LOG_TABLES
from ..sources.shared import stored
from ..sources.store import VersionedStore


@dataclass(frozen=True)
class CollectionSpec:
    """A registered collection: the entity types it takes and its document limit."""

    collection_id: str
    entity_types: tuple[str, ...]
    max_document_bytes: int = 256 << 10

    def __post_init__(self):
        if not self.entity_types or self.max_document_bytes <= 0:
            raise ValueError("a collection takes at least one entity type and documents of some size")


#: A push that takes longer is reported.
SLOW_MS = 500
#: Of a table of more parts the newest are merged.
MOST_PARTS = 64


@dataclass(frozen=True)
class Page:
    rows: list[Row]
    next_cursor: str | None
    has_more: bool
    epoch: str | None


@dataclass
class BlobRules:
    max_bytes: int = 25 << 20
    ticket_minutes: int = 15
    type_allowed: Callable[[Column], Column] = field(default=lambda content_type: F.lit(True))


class LogEngine:
    """One writer at a time commits; a lost race reads anew and repeats, as a push stands on the state it read.

    projections: called with the written changes before the commit; an error in one stops it.
    listeners: called after it with (scope, collection, head); an error in one is only recorded.
    sinks: called with each event (a dict); an error in one is ignored. The last 500 are in `metrics`.
    storage: what is known of uploaded bytes, a function from blobs to (BLOB, found, rejected, found_size, found_checksum).
    """

    def __init__(
        self,
        store: VersionedStore,
        specs: Iterable[CollectionSpec],
        limits: Limits = Limits(),
        blob_rules: BlobRules = BlobRules(),
        clock: Callable[[], datetime.datetime] = lambda: datetime.datetime.now(datetime.timezone.utc),
        new_id: Callable[[], str] = lambda: str(uuid.uuid4()),
        projections: Iterable[Callable[[DataFrame], None]] = (),
        listeners: Iterable[Callable[[str, str, int], None]] = (),
        storage: Callable[[DataFrame], DataFrame] | None = None,
        on_released: Callable[[DataFrame], None] | None = None,
        sinks: Iterable[Callable[[dict], None]] = (),
    ):
        if limits.operations < 1 or limits.page < 1 or limits.retention_days < 1:
            raise ValueError("limits start at 1")
        self.store, self.specs, self.limits, self.blob_rules = store, {s.collection_id: s for s in specs}, limits, blob_rules
        self.clock, self.new_id, self.projections, self.listeners = clock, new_id, list(projections), list(listeners)
        self.storage, self.on_released = storage, on_released
        self.metrics: deque[dict] = deque(maxlen=500)
        self.sinks = list(sinks)
        store.migrate()

    # -- helpers

    @property
    def spark(self):
        return self.store.spark

    def _now(self) -> Column:
        return F.lit(self.clock()).cast("timestamp")

    def _record(self, kind: str, **values: object) -> None:
        event = {"kind": kind, "at": self.clock(), **values}
        self.metrics.append(event)
        for sink in self.sinks:
            try:
                sink(event)
            except Exception:  # what a sink does with an event is no concern of the log
                continue

    def _check(self, collection: str) -> CollectionSpec:
        if collection not in self.specs:
            raise UnknownCollection(collection)
        return self.specs[collection]

    def _retry(self, attempt: Callable[[int, dict[str, DataFrame]], object], names: Iterable[str] | None = None, times: int = 20):
        for turn in range(times):
            base = self.store.version()
            try:
                return attempt(base, self.store.read(base, names))
            except CommitConflict:
                if turn + 1 == times:
                    raise

    def _own(self, scope: str, collection: str, *names: str, version: int | None = None, **within: tuple[object, object]) -> dict[str, DataFrame]:
        """The named tables, from the parts that may hold rows of the collection."""
        return self.store.read(version, names, scope_id=(scope, scope), collection_id=(collection, collection), **within)

    def _collection(self, state: dict[str, DataFrame], scope: str, collection: str) -> Row | None:
        return log_read.of_collection(state["collections"], scope, collection).first()

    # -- writing

    def push(self, groups: DataFrame, epochs: dict[tuple[str, str], str] | None = None, fold: bool | None = None) -> DataFrame:
        """Answer groups (COLLECTION, client_id, group_id, arrival, ops); one row for each, in no order.

        epochs: what the sender believes each collection's epoch to be; another one refuses the whole
        request before anything is created. Repeats get the stored answer, with status `repeated` in
        `outcome`.
        """
        keys = (*COLLECTION, "client_id")
        ends = groups.agg(F.collect_set("collection_id").alias("named"), *[f(c).alias(f"{side}_{c}") for c in keys for side, f in (("least", F.min), ("most", F.max))]).first()
        named, within = ends["named"], {c: (ends[f"least_{c}"], ends[f"most_{c}"]) for c in keys}
        for name in named:
            self._check(name)
        allowed = self.spark.createDataFrame([(s.collection_id, t) for s in self.specs.values() for t in s.entity_types], "collection_id string, entity_type string")
        by_limit: dict[int, list[str]] = {}
        for name in named:
            by_limit.setdefault(self.specs[name].max_document_bytes, []).append(name)

        def attempt(base: int, whole: dict[str, DataFrame]) -> DataFrame:
            for (scope, collection), epoch in (epochs or {}).items():
                row = self._collection(self._own(scope, collection, "collections", version=base), scope, collection)
                if epoch is not None and (row is None or row["epoch"] != epoch):
                    self._record("reset", scope=scope, collection=collection)
                    raise CollectionReset(row["epoch"] if row else None)
            now = self._now()
            state = self.store.read(base, **within)
            new, repeats = log_write.split_replays(groups, state["push_results"])
            new, again = log_write.first_of_each(new)
            parts = []
            for most, names in by_limit.items():
                own = new.where(F.col("collection_id").isin(names))
                limits = Limits(self.limits.operations, most, self.limits.blobs_per_entity, self.limits.page, self.limits.retention_days)
                parts.append(log_write.applied(own, state, allowed, limits, fold))
            verdicts, written = parts[0]
            for v, w in parts[1:]:
                verdicts, written = verdicts.unionByName(v), written.unionByName(w)
            verdicts, written = stored(verdicts, "verdicts"), stored(written, "written")  # each is read several times, by the caller too
            for projection in self.projections:
                projection(written)
            refs, touched = file_ops.replaced(whole["blob_refs"], written)
            touched, replace = stored(touched, "touched"), {}
            if not touched.isEmpty():  # most pushes name no file and leave these tables alone
                replace = {"blob_refs": refs, "blobs": file_ops.settled(whole["blobs"], refs, touched, now)}
            touched_collections = state["collections"].join(groups.select(*COLLECTION).distinct(), COLLECTION, "left_semi")
            answers = verdicts.withColumns({"response": log_write.response(), "created_at": now})
            batches = verdicts.where("status = 'applied'").withColumn("committed_at", now)
            touched_entities = state["entities"].join(written.select(*log_write.ENTITY).distinct(), log_write.ENTITY, "left_semi")
            self.store.commit(
                base,
                append={
                    "collections": log_write.with_collections(touched_collections, groups, verdicts, now, F.expr("uuid()")),
                    "batches": batches,
                    "changes": written.withColumn("version", F.col("seq")),
                    "push_results": answers,
                    "entities": log_write.with_entities(touched_entities, written, now),
                },
                replace=replace,
            )
            key = ["client_id", "group_id"]
            fresh = answers.select(*COLLECTION, *key, "arrival", "status", "seq", "response", F.col("status").alias("outcome"))
            later = again.select(*key, F.col("arrival").alias("_a")).join(fresh, key).withColumn("arrival", F.col("_a")).drop("_a").withColumn("outcome", F.lit("repeated"))
            seq = F.get_json_object("response", "$.seq").cast("long")
            old = repeats.select(*COLLECTION, *key, "arrival", "status", seq.alias("seq"), "response", F.lit("repeated").alias("outcome"))
            return fresh.unionByName(later).unionByName(old)

        began = time.monotonic()
        answers = self._retry(attempt, ("blobs", "blob_refs"))
        if (took := round((time.monotonic() - began) * 1000)) > SLOW_MS:
            self._record("slow_push", ms=took)
        self._compact()
        for row in diagnostics.push_outcomes(answers.withColumn("status", F.col("outcome"))).collect():
            self._record("push", scope=row["scope_id"], collection=row["collection_id"], outcome=row["status"], groups=row["groups"])
        applied = answers.where("outcome = 'applied'").groupBy(*COLLECTION).agg(F.max("seq").alias("head"))
        for row in applied.collect():
            for listener in self.listeners:
                try:
                    listener(row["scope_id"], row["collection_id"], row["head"])
                except Exception as failure:  # the commit stands whatever a listener does
                    self._record("listener_failed", error=str(failure))
        return answers

    def _compact(self) -> None:
        """Now and then, after a commit; another writer's commit meanwhile leaves it for later."""
        if self.store.fragments() > MOST_PARTS:
            try:
                self.store.compact(MOST_PARTS)
            except CommitConflict:
                self._record("compaction_lost")

    # -- reading

    def _bounds(self, state: dict[str, DataFrame], scope: str, collection: str) -> log_read.Bounds | None:
        row = self._collection(state, scope, collection)
        return row and log_read.Bounds(row["epoch"], row["retention_floor_seq"], row["next_seq"])

    def changes(self, scope: str, collection: str, cursor: str | None = None, limit: int | None = None) -> Page:
        """Batches after the cursor with their operations; at most a page of batches."""
        self._check(collection)
        version = self.store.version()
        bounds = self._bounds(self._own(scope, collection, "collections", version=version), scope, collection)
        if bounds is None:
            if cursor is not None:
                raise CollectionReset(None)
            return Page([], None, False, None)
        try:
            start = log_read.start_of(cursor, bounds)
        except CursorTooOld as old:
            self._record("cursor_too_old", scope=scope, collection=collection, behind=old.behind)
            raise
        most = max(1, min(limit or self.limits.page, self.limits.page))
        self._record("changes", scope=scope, collection=collection, lag=bounds.head - start)
        later = self._own(scope, collection, "batches", version=version, seq=(start + 1, None))["batches"]
        found = log_read.after(log_read.of_collection(later, scope, collection), start, most).collect()
        page, more = found[:most], len(found) > most
        if not page:
            return Page([], None, False, bounds.epoch)
        last = page[-1]["seq"]
        state = self._own(scope, collection, "batches", "changes", version=version, seq=(start + 1, last))
        batches, changes = (log_read.of_collection(state[t], scope, collection) for t in ("batches", "changes"))
        rows = log_read.with_operations(batches, changes).withColumn("cursor", F.concat_ws(".", F.lit(bounds.epoch), F.col("seq").cast("string")))
        return Page(rows.orderBy("seq").collect(), f"{bounds.epoch}.{last}", more, bounds.epoch)

    def snapshot(self, scope: str, collection: str, token: str | None = None, limit: int | None = None) -> Page:
        """Live entities by type and id. The cursor is fixed by the first page and carried by the token; next_cursor is it on the last page, the token before."""
        self._check(collection)
        state = self._own(scope, collection, "collections", "entities")
        bounds = self._bounds(state, scope, collection)
        if bounds is None:
            if token is not None:
                raise CollectionReset(None)
            return Page([], None, False, None)
        seq, at = bounds.head, None
        if token is not None:
            epoch, seq, *key = log_read.snapshot_position(token)
            if epoch != bounds.epoch:
                raise CollectionReset(bounds.epoch)
            at = tuple(key)
        most = max(1, min(limit or self.limits.page, self.limits.page))
        found = log_read.snapshot_rows(log_read.of_collection(state["entities"], scope, collection), most, at).collect()
        page, more = found[:most], len(found) > most
        self._record("snapshot", scope=scope, collection=collection, items=len(page))
        after = log_read.snapshot_token(bounds.epoch, seq, page[-1]["entity_type"], page[-1]["entity_id"]) if more else f"{bounds.epoch}.{seq}"
        return Page(page, after, more, bounds.epoch)

    def head(self, scope: str, collection: str) -> str | None:
        bounds = self._bounds(self._own(scope, collection, "collections"), scope, collection)
        return bounds and f"{bounds.epoch}.{bounds.head}"

    def published_limits(self) -> dict[str, int | None]:
        """The document limit is the smallest of all collections."""
        return {
            "operations": self.limits.operations, "document_bytes": min((s.max_document_bytes for s in self.specs.values()), default=self.limits.document_bytes),
            "page": self.limits.page, "retention_days": self.limits.retention_days, "blob_bytes": self.blob_rules.max_bytes, "blobs_per_entity": self.limits.blobs_per_entity,
        }

    def document(self, scope: str, collection: str, kind: str, ident: str) -> Row | None:
        state = self._own(scope, collection, "entities", "blob_refs")
        own = lambda t: log_read.of_collection(state[t], scope, collection)
        return log_read.document(own("entities"), own("blob_refs"), kind, ident).first()

    def documents(self, scope: str, collection: str, kind: str, token: str | None = None, limit: int = 100) -> Page:
        state = self._own(scope, collection, "entities", "blob_refs")
        own = lambda t: log_read.of_collection(state[t], scope, collection)
        most = max(1, min(limit, self.limits.page))
        found = log_read.documents_page(own("entities"), own("blob_refs"), kind, most, self._plain(token)).collect()
        more = len(found) > most
        return Page(found[:most], make_page_token(found[most - 1]["entity_id"]) if more else None, more, None)

    @staticmethod
    def _plain(token: str | None) -> str | None:
        from ..functions.tokens import parse_page_token

        return parse_page_token(token, 1)[0] if token else None

    # -- files

    def blob(self, scope: str, collection: str, blob_id: str) -> Row:
        row = log_read.of_collection(self._own(scope, collection, "blobs")["blobs"], scope, collection).where(F.col("blob_id") == blob_id).first()
        if row is None:
            raise UnknownBlob(blob_id)
        return row

    def blobs(self, scope: str, collection: str, token: str | None = None, limit: int = 100) -> Page:
        """The token is the bare id of the last one."""
        most = max(1, min(limit, self.limits.page))
        found = log_read.blobs_page(log_read.of_collection(self._own(scope, collection, "blobs")["blobs"], scope, collection), most, token).collect()
        more = len(found) > most
        return Page(found[:most], found[most - 1]["blob_id"] if more else None, more, None)

    def register(self, declared: DataFrame) -> DataFrame:
        """BLOB, outcome, needs_upload for declarations (BLOB, content_type, size, checksum)."""

        def attempt(base: int, state: dict[str, DataFrame]) -> DataFrame:
            key = F.concat_ws("/", *[F.col(f"{c}") for c in BLOB])
            outcome, after = file_ops.registrations(declared, state["blobs"], self.blob_rules.max_bytes, self.blob_rules.type_allowed(F.col("d.content_type")), key, self._now())
            outcome = stored(outcome, "registered")
            self.store.commit(base, replace={"blobs": after})
            return outcome

        outcome = self._retry(attempt)
        for row in outcome.groupBy("outcome").count().collect():
            self._record("blobs_refused" if row["outcome"] in file_ops.REFUSALS else "blobs_registered", outcome=row["outcome"], count=row["count"])
        return outcome

    def _verified(self, rows: DataFrame) -> DataFrame:
        if self.storage is None:
            raise BlobRefused("BLOB_NOT_UPLOADED", "no storage is configured")
        found = rows.join(self.storage(rows), BLOB, "left").na.fill(False, ["found", "rejected"])
        return stored(file_ops.verification(found), "verified")

    def mark_uploaded(self, ids: DataFrame) -> DataFrame:
        """Verify uploads (BLOB); returns them with refusal. Those as declared become ready, once."""

        def attempt(base: int, state: dict[str, DataFrame]) -> DataFrame:
            checked = self._verified(state["blobs"].join(ids.select(*BLOB), BLOB, "left_semi"))
            after, turned = file_ops.promoted(state["blobs"], checked, self._now())
            ready = stored(turned, "turned")
            self.store.commit(base, replace={"blobs": after})
            self._record("blobs_ready", count=ready.count())
            return checked.select(*BLOB, "refusal")

        return self._retry(attempt)

    def download(self, scope: str, collection: str, blob_id: str) -> Row:
        self.blob(scope, collection, blob_id)
        rows = log_read.of_collection(self._own(scope, collection, "blobs")["blobs"], scope, collection).where(F.col("blob_id") == blob_id)
        return file_ops.downloads(rows).first()

    # -- maintenance

    def trim(self) -> list[Row]:
        """Forget history older than the retention, on disk too; returns a report for each collection."""
        cutoff = F.lit(self.clock() - datetime.timedelta(days=self.limits.retention_days)).cast("timestamp")

        def attempt(base: int, state: dict[str, DataFrame]) -> list[Row]:
            found = stored(retention.floors(state["collections"], state["batches"], cutoff), "floors")
            report = retention.trim_report(state["batches"], state["entities"], found).collect()
            self.store.commit(base, replace=retention.trimmed(state, found), laid_out=True)
            return report

        report = self._retry(attempt)
        self.store.vacuum()
        for row in report:
            self._record("trim", scope=row["scope_id"], collection=row["collection_id"], removed=row["removed"], retained=row["retained"])
        return report

    def collect_blobs(self, dry_run: bool = False) -> list[Row]:
        """Remove what nothing has referred to for the retention; the host is handed the objects after the commit."""
        before = F.lit(self.clock() - datetime.timedelta(days=self.limits.retention_days)).cast("timestamp")

        def attempt(base: int, state: dict[str, DataFrame]) -> tuple[list[Row], DataFrame]:
            found = stored(file_ops.collectable(state["blobs"], before), "collected")
            if not dry_run:
                self.store.commit(base, replace=retention.without_blobs(state, found))
            return file_ops.sweep_report(found).collect(), found

        report, found = self._retry(attempt)
        if not dry_run and self.on_released:
            self.on_released(found)
        for row in report:
            self._record("blobs_collected", dry_run=dry_run, **row.asDict())
        return report

    def confirm_pending_uploads(self) -> int:
        """Promote uploads whose ticket ran out and whose bytes are as declared."""
        before = F.lit(self.clock() - datetime.timedelta(minutes=self.blob_rules.ticket_minutes)).cast("timestamp")
        late = file_ops.overdue_uploads(self.store.read()["blobs"], before)
        if late.isEmpty():
            return 0
        return self.mark_uploaded(late.select(*BLOB)).where("refusal is null").count()

    def collections(self) -> list[Row]:
        return retention.targets(self.store.read()["collections"]).collect()

    def purge(self, scope: str, collection: str | None = None) -> list[Row]:
        """Erase a collection, or all of a scope, in one commit and on disk; returns what went from each table."""
        target = retention.in_target(scope, collection)

        def attempt(base: int, state: dict[str, DataFrame]) -> tuple[list[Row], DataFrame]:
            report = retention.purge_report(state, target).collect()
            held = stored(state["blobs"].where(target), "purged-blobs")
            self.store.commit(base, replace=retention.purged(state, target), laid_out=True)
            return report, held

        report, held = self._retry(attempt)
        self.store.vacuum()
        if self.on_released and not held.isEmpty():
            self.on_released(held)
        for row in report:
            self._record("purge", **row.asDict())
        return report


def log_store(spark, root: str) -> VersionedStore:
    return VersionedStore(spark, root, LOG_TABLES)



