"""Pushing groups of changes onto the log: replay, validation, conflicts, sequence numbers, merging, references."""

from __future__ import annotations

import json
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.documents import document_bytes, merged
from ..schema import BLOB, COLLECTION, ENTITY, shaped
from ..sources.shared import stored
from .ranks import ranked

GROUP = [*COLLECTION, "client_id", "group_id"]

#: Reject codes, fixed values of the wire format.
TOO_LARGE, UNKNOWN_ENTITY_TYPE, BLOB_MISSING, VALIDATION = "TOO_LARGE", "UNKNOWN_ENTITY_TYPE", "BLOB_MISSING", "VALIDATION"


@dataclass(frozen=True)
class Limits:
    """What one push may hold. Document bytes are those of the patch, not of the merged document."""

    operations: int = 500
    document_bytes: int = 256 << 10
    blobs_per_entity: int | None = 16
    page: int = 500
    retention_days: int = 30


#: One row for each group: what to answer.
VERDICT = (
    "scope_id string, collection_id string, client_id string, group_id string, arrival long, status string, seq long,"
    " code string, entity_type string, entity_id string, conflicts array<struct<entity_type:string,entity_id:string,version:string,data:string>>"
)
#: One row for each change of an applied group.
WRITTEN = (
    "scope_id string, collection_id string, client_id string, group_id string, arrival long, seq long, ordinal int, entity_type string, entity_id string,"
    " op string, data string, blobs array<string>, existed boolean"
)


def operations(groups: DataFrame) -> DataFrame:
    """One row for each operation, with its ordinal."""
    return groups.select(*GROUP, "arrival", F.posexplode("ops").alias("ordinal", "o")).select(*GROUP, "arrival", "ordinal", "o.*")


def split_replays(groups: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups never answered, and the stored answers of the others, of any kind. A group is known by client and group id."""
    key = ["client_id", "group_id"]
    known = results.select(*key).distinct()
    new = groups.join(known, key, "left_anti")
    stored = groups.select(*key, "arrival").join(results, key)
    return new, stored


def first_of_each(groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of groups sent twice in one request the first, and the repeats."""
    rank = F.row_number().over(Window.partitionBy("client_id", "group_id").orderBy("arrival"))
    ranked = groups.withColumn("_r", rank)
    return ranked.where("_r = 1").drop("_r"), ranked.where("_r > 1").drop("_r")


def rejections(groups: DataFrame, allowed: DataFrame, blobs: DataFrame, refs: DataFrame, limits: Limits) -> DataFrame:
    """GROUP, code, entity_type, entity_id of groups that can't be applied; the first reason wins.

    Order: too many operations; an entity named twice; then each operation in turn with an unknown
    type, a document that is too large, or more blobs than the limit unless not more than it already
    had; last a blob that isn't registered. allowed: collection_id, entity_type.
    """
    ops = operations(groups)
    sizes = groups.select(*GROUP, F.size("ops").alias("_n"))
    twice = ops.groupBy(*GROUP, "entity_type", "entity_id").agg(F.count(F.lit(1)).alias("_c"), F.max("ordinal").alias("_o")).where("_c > 1")
    twice = twice.groupBy(*GROUP).agg(F.min_by(F.struct("entity_type", "entity_id"), "_o").alias("_e"))
    known = allowed.select("collection_id", "entity_type").distinct().withColumn("_known", F.lit(True))
    held = refs.groupBy(*ENTITY).agg(F.count(F.lit(1)).alias("_held"))
    checked = ops.join(known, ["collection_id", "entity_type"], "left")
    large = F.when(F.col("op") == "upsert", document_bytes(F.col("data"))).otherwise(F.lit(0)) > limits.document_bytes
    code = F.when(F.col("_known").isNull(), UNKNOWN_ENTITY_TYPE).when(large, TOO_LARGE)
    if limits.blobs_per_entity is not None:
        checked = checked.join(held, ENTITY, "left")
        declared = F.when(F.col("op") == "upsert", F.size(F.array_distinct(F.col("blobs"))))
        code = code.when((declared > limits.blobs_per_entity) & (declared > F.coalesce("_held", F.lit(0))), TOO_LARGE)
    bad = checked.withColumn("_code", code).where("_code is not null")
    bad = bad.groupBy(*GROUP).agg(F.min_by(F.struct(F.col("_code").alias("code"), "entity_type", "entity_id"), "ordinal").alias("_op"))
    wanted = ops.where((F.col("op") == "upsert") & F.col("blobs").isNotNull()).select(*GROUP, "ordinal", "entity_type", "entity_id", F.explode("blobs").alias("blob_id"))
    missing = wanted.join(blobs.select(*BLOB).distinct(), BLOB, "left_anti")
    missing = missing.groupBy(*GROUP).agg(F.min_by(F.struct(F.lit(BLOB_MISSING).alias("code"), "entity_type", "entity_id"), "ordinal").alias("_blob"))
    nowhere = lambda code: F.struct(F.lit(code).alias("code"), F.lit(None).cast("string").alias("entity_type"), F.lit(None).cast("string").alias("entity_id"))
    found = sizes.join(twice, GROUP, "left").join(bad, GROUP, "left").join(missing, GROUP, "left")
    reason = F.coalesce(
        F.when(F.col("_n") > limits.operations, nowhere(TOO_LARGE)),
        F.when(F.col("_e").isNotNull(), F.struct(F.lit(VALIDATION).alias("code"), F.col("_e.entity_type"), F.col("_e.entity_id"))),
        F.col("_op"),
        F.col("_blob"),
    )
    return found.select(*GROUP, reason.alias("_reason")).where("_reason is not null").select(*GROUP, "_reason.*")


def stale(base: Column, version: Column) -> Column:
    """Whether a base version doesn't name a stored version; what isn't a number names none."""
    return ~base.try_cast("long").eqNullSafe(version)


def conflicts(ops: DataFrame, entities: DataFrame) -> DataFrame:
    """GROUP and the list of conflicts of groups with a stale operation. An entity that isn't stored never conflicts; a tombstone does."""
    rows = ops.join(entities.select(*ENTITY, F.col("version").alias("_version"), F.col("data").alias("_data")), ENTITY)
    rows = rows.where(stale(F.col("base_version"), F.col("_version")))
    entry = F.struct(F.col("entity_type"), F.col("entity_id"), F.col("_version").cast("string").alias("version"), F.col("_data").alias("data"))
    listed = F.array_sort(F.collect_list(F.struct("ordinal", entry.alias("e"))))
    return rows.groupBy(*GROUP).agg(F.transform(listed, lambda x: x["e"]).alias("conflicts"))


def sequenced(applied: DataFrame, collections: DataFrame) -> DataFrame:
    """applied groups with seq: dense from next_seq in arrival order in each collection (from 1 in a new one).

    Light rows, one for each group, are ranked by a distributed sort: a hot collection is split.
    """
    first = F.coalesce(F.col("next_seq"), F.lit(1))
    light = ranked(applied, COLLECTION, ["arrival"]).join(collections.select(*COLLECTION, "next_seq"), COLLECTION, "left")
    return light.withColumn("seq", F.col("_rank") - 1 + first).drop("next_seq", "_rank")


def _set_based(groups: DataFrame, state: dict[str, DataFrame], allowed: DataFrame, limits: Limits) -> tuple[DataFrame, DataFrame]:
    """Verdicts and written changes of groups no two of which touch the same entity of a collection."""
    refused = rejections(groups, allowed, state["blobs"], state["blob_refs"], limits)
    sound = groups.join(refused, GROUP, "left_anti")
    clashing = conflicts(operations(sound), state["entities"])
    found = groups.select(*GROUP, "arrival").join(refused, GROUP, "left").join(clashing, GROUP, "left")
    status = F.when(F.col("code").isNotNull(), "rejected").when(F.col("conflicts").isNotNull(), "conflict").otherwise("applied")
    found = stored(shaped(found.withColumn("status", status), VERDICT), "verdicts")
    numbered = sequenced(found.where("status = 'applied'").drop("seq"), state["collections"])
    verdicts = stored(found.where("status != 'applied'").unionByName(shaped(numbered, VERDICT)), "verdicts")
    entities = state["entities"].select(*ENTITY, F.col("data").alias("_data"), F.col("is_deleted").alias("_deleted"))
    done = verdicts.where("status = 'applied'").select(*GROUP, "seq")
    rows = operations(groups).join(done, GROUP).join(entities, ENTITY, "left")
    data = F.when(F.col("op") == "upsert", merged(F.when(~F.col("_deleted"), F.col("_data")), F.col("data")))
    written = rows.withColumn("data", data).withColumn("existed", F.col("_deleted").isNotNull())
    return verdicts, shaped(written, WRITTEN)


def _merge(stored: str | None, patch: str | None) -> str:
    """The rule of functions.documents.merged for one document."""
    both = {**(json.loads(stored) if stored else {}), **(json.loads(patch) if patch else {})}
    return json.dumps(_sorted(both), ensure_ascii=False, separators=(",", ":"))


def _sorted(value):
    if isinstance(value, dict):
        return {k: _sorted(value[k]) for k in sorted(value)}
    return [_sorted(x) for x in value] if isinstance(value, list) else value


_FOLDED = "verdict string, change string"


def _fold(limits: Limits):
    """Apply one collection's groups in arrival order; facts: what the log holds of the things they name."""

    def run(key: tuple, groups: pd.DataFrame, facts: pd.DataFrame) -> pd.DataFrame:
        entities, blobs, held, allowed, next_seq = {}, set(), {}, set(), 1
        for kind, a, b, version, data, deleted in zip(facts["kind"], facts["a"], facts["b"], facts["n"], facts["data"], facts["flag"], strict=True):
            if kind == "entity":
                entities[a, b] = (int(version), None if deleted else data)
            elif kind == "blob":
                blobs.add(a)
            elif kind == "held":
                held[a, b] = int(version)
            elif kind == "type":
                allowed.add(a)
            elif kind == "next":
                next_seq = int(version)
        verdicts, changes = [], []
        for _, g in groups.sort_values("arrival").iterrows():
            ops = [dict(o) if isinstance(o, dict) else o.asDict() for o in g["ops"]]
            own = {"scope_id": g["scope_id"], "collection_id": g["collection_id"], "client_id": g["client_id"], "group_id": g["group_id"], "arrival": int(g["arrival"])}
            reason = _reason(ops, allowed, blobs, held, limits)
            if reason:
                verdicts.append(own | {"status": "rejected", "code": reason[0], "entity_type": reason[1], "entity_id": reason[2]})
                continue
            clash = []
            for o in ops:
                stored = entities.get((o["entity_type"], o["entity_id"]))
                if stored and _number(o["base_version"]) != stored[0]:
                    clash.append({"entity_type": o["entity_type"], "entity_id": o["entity_id"], "version": str(stored[0]), "data": stored[1]})
            if clash:
                verdicts.append(own | {"status": "conflict", "conflicts": clash})
                continue
            for ordinal, o in enumerate(ops):
                at = (o["entity_type"], o["entity_id"])
                data = _merge(entities.get(at, (0, None))[1], o["data"]) if o["op"] == "upsert" else None
                listed = None if o["blobs"] is None else list(o["blobs"])
                changes.append(own | {"seq": next_seq, "ordinal": ordinal, "entity_type": at[0], "entity_id": at[1], "op": o["op"], "data": data, "blobs": listed, "existed": at in entities})
                entities[at] = (next_seq, data)
                if o["op"] == "delete":
                    held[at] = 0
                elif listed is not None:
                    held[at] = len(set(listed))
            verdicts.append(own | {"status": "applied", "seq": next_seq})
            next_seq += 1
        lines = [(json.dumps(v), None) for v in verdicts] + [(None, json.dumps(c)) for c in changes]
        return pd.DataFrame(lines, columns=["verdict", "change"], dtype=object)

    return run


def _number(text: str | None) -> int | None:
    try:
        return int(text) if text is not None and text.strip() == text else None
    except ValueError:
        return None


def _reason(ops: list[dict], allowed: set, blobs: set, held: dict, limits: Limits) -> tuple | None:
    """The rule of `rejections` for one group."""
    if len(ops) > limits.operations:
        return TOO_LARGE, None, None
    seen = set()
    for o in ops:
        at = (o["entity_type"], o["entity_id"])
        if at in seen:
            return VALIDATION, *at
        seen.add(at)
    for o in ops:
        at, upsert = (o["entity_type"], o["entity_id"]), o["op"] == "upsert"
        if o["entity_type"] not in allowed:
            return UNKNOWN_ENTITY_TYPE, *at
        if upsert and len((o["data"] or "").encode()) > limits.document_bytes:
            return TOO_LARGE, *at
        declared = len(set(o["blobs"])) if upsert and o["blobs"] is not None else 0
        if limits.blobs_per_entity is not None and declared > limits.blobs_per_entity and declared > held.get(at, 0):
            return TOO_LARGE, *at
    for o in ops:
        if o["op"] == "upsert" and o["blobs"] is not None and any(b not in blobs for b in o["blobs"]):
            return BLOB_MISSING, o["entity_type"], o["entity_id"]
    return None


def _folded(groups: DataFrame, state: dict[str, DataFrame], allowed: DataFrame, limits: Limits) -> tuple[DataFrame, DataFrame]:
    """As _set_based, for groups that build on one another: a fold in arrival order within each collection.

    Only what the groups name is brought to the fold, so its size follows the request, not the log.
    """
    ops, none = operations(groups), F.lit(None)
    named = ops.select(*ENTITY).distinct()

    def fact(rows: DataFrame, kind: str, a: Column, b: Column, n: Column, data: Column = none, flag: Column = none) -> DataFrame:
        return rows.select(*COLLECTION, F.lit(kind).alias("kind"), a.cast("string").alias("a"), b.cast("string").alias("b"), n.cast("long").alias("n"), data.cast("string").alias("data"), flag.cast("boolean").alias("flag"))

    wanted = ops.where("blobs is not null").select(*COLLECTION, F.explode("blobs").alias("blob_id")).distinct()
    places = groups.select(*COLLECTION).distinct()
    e_type, e_id = F.col("entity_type"), F.col("entity_id")
    facts = (
        fact(state["entities"].join(named, ENTITY, "left_semi"), "entity", e_type, e_id, F.col("version"), F.col("data"), F.col("is_deleted"))
        .unionAll(fact(state["blobs"].join(wanted, BLOB, "left_semi"), "blob", F.col("blob_id"), none, none))
        .unionAll(fact(state["blob_refs"].join(named, ENTITY, "left_semi").groupBy(*ENTITY).count(), "held", e_type, e_id, F.col("count")))
        .unionAll(fact(places.join(allowed, "collection_id"), "type", e_type, none, none))
        .unionAll(fact(state["collections"].join(places, COLLECTION, "left_semi"), "next", none, none, F.col("next_seq")))
    )
    out = stored(groups.groupBy(*COLLECTION).cogroup(facts.groupBy(*COLLECTION)).applyInPandas(_fold(limits), _FOLDED), "folded")
    verdicts = out.where("verdict is not null").select(F.from_json("verdict", VERDICT).alias("v")).select("v.*")
    changes = out.where("change is not null").select(F.from_json("change", WRITTEN).alias("c")).select("c.*")
    return shaped(verdicts, VERDICT), shaped(changes, WRITTEN)


def dependent_collections(groups: DataFrame) -> DataFrame:
    """Collections of which two groups touch one entity."""
    named = operations(groups).select(*ENTITY, *GROUP[2:]).distinct()
    return named.groupBy(*ENTITY).agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select(*COLLECTION).distinct()


def applied(groups: DataFrame, state: dict[str, DataFrame], allowed: DataFrame, limits: Limits = Limits(), fold: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """Verdicts (VERDICT) and written changes (WRITTEN) of new groups. fold: force one of the two ways, else the data decide.

    groups: GROUP, arrival, ops. Collections whose groups are independent of one another, the usual
    case, go set-based; only the others are folded, each by itself as its order demands.
    """
    if fold is not None:
        return (_folded if fold else _set_based)(groups, state, allowed, limits)
    knotted = stored(dependent_collections(groups), "knotted")
    if knotted.isEmpty():
        return _set_based(groups, state, allowed, limits)
    free = _set_based(groups.join(knotted, COLLECTION, "left_anti"), state, allowed, limits)
    tied = _folded(groups.join(knotted, COLLECTION, "left_semi"), state, allowed, limits)
    return free[0].unionByName(tied[0]), free[1].unionByName(tied[1])


def with_entities(entities: DataFrame, written: DataFrame, now: Column) -> DataFrame:
    """entities after the written changes: the last change of each entity replaces its row; a delete leaves a tombstone."""
    last = written.groupBy(*ENTITY).agg(F.max_by(F.struct("seq", "op", "data"), F.struct("seq", "ordinal")).alias("_w"))
    both = entities.withColumn("_stored", F.lit(True)).join(last, ENTITY, "full_outer")
    new = F.col("_w").isNotNull()
    pick = lambda fresh, old: F.when(new, fresh).otherwise(F.col(old)).alias(old)
    return both.select(
        *ENTITY,
        pick(F.col("_w.seq"), "version"),
        pick(F.col("_w.data"), "data"),
        pick(F.col("_w.op") == "delete", "is_deleted"),
        pick(F.col("_w.seq"), "last_seq"),
        F.coalesce("created_at", now).alias("created_at"),
        pick(now, "updated_at"),
    )


def with_collections(collections: DataFrame, groups: DataFrame, verdicts: DataFrame, now: Column, new_epoch: Column) -> DataFrame:
    """collections after a push: rows for new ones (sequence 1, floor 1), next_seq up by the applied groups."""
    more = verdicts.where("status = 'applied'").groupBy(*COLLECTION).agg(F.count(F.lit(1)).alias("_more"))
    named = groups.select(*COLLECTION).distinct().join(more, COLLECTION, "left")
    both = collections.join(named, COLLECTION, "full_outer")
    return both.select(
        *COLLECTION,
        F.coalesce("epoch", new_epoch).alias("epoch"),
        (F.coalesce("next_seq", F.lit(1)) + F.coalesce("_more", F.lit(0))).cast("long").alias("next_seq"),
        F.coalesce("retention_floor_seq", F.lit(1)).cast("long").alias("retention_floor_seq"),
        F.coalesce("created_at", now).alias("created_at"),
    )


def response() -> Column:
    """The answer of a group as JSON text, to be stored and repeated."""
    return F.to_json(F.struct("status", F.col("seq").alias("seq"), "code", "entity_type", "entity_id", "conflicts"))
