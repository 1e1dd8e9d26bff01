"""Reading the log: pages of changes after a cursor, snapshots of current state, heads and limits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import CollectionReset, CursorTooOld
from ..functions.tokens import make_page_token, parse_cursor, parse_page_token
from ..schema import COLLECTION, ENTITY


def of_collection(df: DataFrame, scope: str, collection: str) -> DataFrame:
    return df.where((F.col("scope_id") == scope) & (F.col("collection_id") == collection))


def current_state(changes: DataFrame) -> DataFrame:
    """The last change of each entity with all its columns: the entities that materialising it would hold."""
    payload = F.struct(*[c for c in changes.columns if c not in ENTITY])
    last = changes.groupBy(*ENTITY).agg(F.max_by(payload, F.struct("seq", "ordinal")).alias("_c"))
    return last.select(*ENTITY, "_c.*")


def live(state: DataFrame) -> DataFrame:
    return state.where(F.col("op") != "delete") if "op" in state.columns else state.where(~F.col("is_deleted"))


def after(batches: DataFrame, seq: int, limit: int) -> DataFrame:
    """The next limit + 1 batches in order; one more than a page says whether there is more."""
    return batches.where(F.col("seq") > seq).orderBy("seq").limit(limit + 1)


def with_operations(batches: DataFrame, changes: DataFrame) -> DataFrame:
    """batches with `ops`, each one's changes in order."""
    fields = [c for c in changes.columns if c not in (*COLLECTION, "seq")]
    ops = changes.join(batches.select(*COLLECTION, "seq"), [*COLLECTION, "seq"], "left_semi")
    listed = ops.groupBy(*COLLECTION, "seq").agg(F.array_sort(F.collect_list(F.struct("ordinal", *[c for c in fields if c != "ordinal"]))).alias("ops"))
    return batches.join(listed, [*COLLECTION, "seq"], "left")


@dataclass(frozen=True)
class Bounds:
    """What a cursor is checked against. head = next_seq - 1; changes below floor are gone."""

    epoch: str
    floor: int
    next_seq: int

    @property
    def head(self) -> int:
        return self.next_seq - 1


def start_of(cursor: str | None, bounds: Bounds) -> int:
    """The sequence after which to read. None starts before the oldest change kept."""
    if cursor is None:
        return bounds.floor - 1
    epoch, seq = parse_cursor(cursor)
    if epoch != bounds.epoch or seq > bounds.head:
        raise CollectionReset(bounds.epoch)
    if seq < bounds.floor - 1:
        raise CursorTooOld(bounds.floor - 1 - seq)
    return seq


def cursor_status(cursors: DataFrame, collections: DataFrame) -> DataFrame:
    """cursors (COLLECTION, epoch, seq) with `status` (ok, reset, too_old), `lag` and `behind`, for many readers at once."""
    rows = cursors.join(collections.select(*COLLECTION, F.col("epoch").alias("_epoch"), "next_seq", "retention_floor_seq"), COLLECTION, "left")
    head, least = F.col("next_seq") - 1, F.col("retention_floor_seq") - 1
    reset = F.col("_epoch").isNull() | (F.col("epoch") != F.col("_epoch")) | (F.col("seq") > head)
    status = F.when(reset, "reset").when(F.col("seq") < least, "too_old").otherwise("ok")
    out = rows.withColumn("status", status)
    return out.select(*cursors.columns, "status", F.when(F.col("status") == "ok", head - F.col("seq")).alias("lag"), F.when(F.col("status") == "too_old", least - F.col("seq")).alias("behind"))


def heads(collections: DataFrame) -> DataFrame:
    return collections.select(*COLLECTION, (F.col("next_seq") - 1).alias("head"))


def beyond(kind: Column, ident: Column, after_type: str, after_id: str) -> Column:
    """Keyset predicate: (kind, ident) comes after the given pair, in byte order."""
    return (kind > after_type) | ((kind == after_type) & (ident > after_id))


def snapshot_rows(entities: DataFrame, limit: int, after_key: tuple[str, str] | None = None) -> DataFrame:
    """The next limit + 1 live entities of one collection by type and id."""
    rows = entities.where(~F.col("is_deleted"))
    if after_key:
        rows = rows.where(beyond(F.col("entity_type"), F.col("entity_id"), *after_key))
    return rows.orderBy("entity_type", "entity_id").limit(limit + 1)


def snapshot_token(epoch: str, seq: int, kind: str, ident: str) -> str:
    return make_page_token(epoch, str(seq), kind, ident)


def snapshot_position(token: str) -> tuple[str, int, str, str]:
    epoch, seq, kind, ident = parse_page_token(token, 4)
    return epoch, int(seq), kind, ident


def document(entities: DataFrame, refs: DataFrame, kind: str, ident: str) -> DataFrame:
    """One live document of a collection with its blobs in order."""
    row = entities.where((F.col("entity_type") == kind) & (F.col("entity_id") == ident) & ~F.col("is_deleted"))
    return with_blobs(row, refs)


def with_blobs(rows: DataFrame, refs: DataFrame) -> DataFrame:
    own = refs.join(rows.select(*ENTITY), ENTITY, "left_semi").groupBy(*ENTITY).agg(F.array_sort(F.collect_set("blob_id")).alias("blobs"))
    return rows.join(own, ENTITY, "left").withColumn("blobs", F.coalesce("blobs", F.array().cast("array<string>")))


def documents_page(entities: DataFrame, refs: DataFrame, kind: str, limit: int, after_id: str | None = None) -> DataFrame:
    """The next limit + 1 live documents of a type by id, with blobs, in one join however long the page."""
    rows = entities.where((F.col("entity_type") == kind) & ~F.col("is_deleted"))
    rows = rows.where(F.col("entity_id") > after_id) if after_id else rows
    return with_blobs(rows.orderBy("entity_id").limit(limit + 1), refs).orderBy("entity_id")


def blobs_page(blobs: DataFrame, limit: int, after_id: str | None = None) -> DataFrame:
    rows = blobs.where(F.col("blob_id") > after_id) if after_id else blobs
    return rows.orderBy("blob_id").limit(limit + 1)
