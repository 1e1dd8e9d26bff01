"""File metadata of the log: registration, promotion, references, and what nothing refers to any more."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import BLOB, ENTITY, LOG_TABLES, shaped

PENDING, READY = "PENDING", "READY"
#: Refusal codes of a declaration or an upload, fixed values.
REFUSALS = ("BLOB_TOO_LARGE", "BLOB_TYPE_NOT_ALLOWED", "BLOB_DECLARATION_CONFLICT", "BLOB_NOT_UPLOADED", "BLOB_REJECTED", "BLOB_MISMATCH", "BLOB_NOT_READY", "UNKNOWN_BLOB")


def missing(declared: DataFrame, blobs: DataFrame) -> DataFrame:
    """Declared blobs that aren't registered."""
    return declared.select(*BLOB).distinct().join(blobs.select(*BLOB), BLOB, "left_anti")


def references_of(refs: DataFrame) -> DataFrame:
    """Each entity's blobs in order."""
    return refs.groupBy(*ENTITY).agg(F.array_sort(F.collect_set("blob_id")).alias("blobs"))


def replaced(refs: DataFrame, written: DataFrame) -> tuple[DataFrame, DataFrame]:
    """References after the written changes, and the blobs touched.

    The last change of an entity that says anything counts: a delete and an empty list clear, a list
    replaces, an absent list leaves alone.
    """
    says = written.where((F.col("op") == "delete") | F.col("blobs").isNotNull())
    last = says.groupBy(*ENTITY).agg(F.max_by(F.when(F.col("op") == "upsert", F.col("blobs")), F.struct("seq", "ordinal")).alias("_blobs"))
    every = says.where(F.col("op") == "upsert").select(*ENTITY, F.explode("blobs").alias("blob_id"))
    declared = last.select(*ENTITY, F.explode("_blobs").alias("blob_id")).distinct()
    released = refs.join(last.select(*ENTITY), ENTITY, "left_semi")
    kept = refs.join(last.select(*ENTITY), ENTITY, "left_anti")
    touched = released.select(*BLOB).unionByName(declared.select(*BLOB)).unionByName(every.select(*BLOB)).distinct()
    return shaped(kept.unionByName(declared), LOG_TABLES["blob_refs"]), touched


def settled(blobs: DataFrame, refs: DataFrame, touched: DataFrame, now: Column) -> DataFrame:
    """blobs with unreferenced_since right for the touched ones: cleared where referenced, stamped once where not."""
    used = refs.select(*BLOB).distinct().withColumn("_used", F.lit(True))
    rows = blobs.join(touched.select(*BLOB).distinct().withColumn("_touched", F.lit(True)), BLOB, "left").join(used, BLOB, "left")
    since = F.when(F.col("_touched") & F.col("_used"), F.lit(None)).when(F.col("_touched"), F.coalesce("unreferenced_since", now)).otherwise(F.col("unreferenced_since"))
    return shaped(rows.withColumn("unreferenced_since", since), LOG_TABLES["blobs"])


def declares_same(a: str, b: str) -> Column:
    """Whether two declarations agree in type, size and checksum."""
    same = lambda c: F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return same("content_type") & same("size") & same("checksum")


def registrations(declared: DataFrame, blobs: DataFrame, most_bytes: int, type_allowed: Column, storage_key: Column, now: Column) -> tuple[DataFrame, DataFrame]:
    """Outcome for each declaration (BLOB, outcome, needs_upload), and blobs after them.

    declared: BLOB, content_type, size, checksum. Refused: too large, type not allowed, a different
    declaration of a ready blob. Else inserted, or declared anew while pending (its key stays), or
    reused when ready. An inserted blob is unreferenced from now on.
    """
    both = declared.alias("d").join(blobs.alias("b"), [F.col(f"d.{c}").eqNullSafe(F.col(f"b.{c}")) for c in BLOB], "left")
    outcome = (
        F.when(F.col("d.size") > most_bytes, "BLOB_TOO_LARGE")
        .when(~type_allowed, "BLOB_TYPE_NOT_ALLOWED")
        .when(F.col("b.blob_id").isNull(), "inserted")
        .when((F.col("b.state") == READY) & ~declares_same("b", "d"), "BLOB_DECLARATION_CONFLICT")
        .when(F.col("b.state") == READY, "ready")
        .otherwise("redeclared")
    )
    rows = both.select(*[F.col(f"d.{c}").alias(c) for c in (*BLOB, "content_type", "size", "checksum")], outcome.alias("outcome"))
    rows = rows.withColumn("needs_upload", F.col("outcome").isin("inserted", "redeclared"))
    fresh = rows.where("outcome = 'inserted'").withColumns({"state": F.lit(PENDING), "storage_key": storage_key, "created_at": now, "unreferenced_since": now})
    again = rows.where("outcome = 'redeclared'").select(*BLOB, F.struct("content_type", "size", "checksum").alias("_d"))
    kept = blobs.join(again, BLOB, "left")
    for c in ("content_type", "size", "checksum"):
        kept = kept.withColumn(c, F.when(F.col("_d").isNotNull(), F.col(f"_d.{c}")).otherwise(F.col(c)))
    return rows.select(*BLOB, "outcome", "needs_upload"), shaped(kept, LOG_TABLES["blobs"]).unionByName(shaped(fresh, LOG_TABLES["blobs"]))


def verification(found: DataFrame) -> DataFrame:
    """found with `refusal`, null where the upload is as declared.

    found: size, checksum as declared; found (boolean), rejected (boolean), found_size, found_checksum.
    Checksums are compared only when both sides have one.
    """
    wrong = (F.col("found_size") != F.col("size")) | F.coalesce(F.col("found_checksum") != F.col("checksum"), F.lit(False))
    return found.withColumn("refusal", F.when(~F.col("found"), "BLOB_NOT_UPLOADED").when(F.col("rejected"), "BLOB_REJECTED").when(wrong, "BLOB_MISMATCH"))


def promoted(blobs: DataFrame, verified: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """blobs with the pending ones among verified made ready, and those that became so by this."""
    ok = verified.where("refusal is null").select(*BLOB).distinct()
    turned = blobs.where(F.col("state") == PENDING).join(ok, BLOB, "left_semi")
    rows = blobs.join(turned.select(*BLOB).withColumn("_turn", F.lit(True)), BLOB, "left")
    state = F.when(F.col("_turn"), READY).otherwise(F.col("state"))
    out = rows.withColumns({"state": state, "ready_at": F.when(F.col("_turn"), now).otherwise(F.col("ready_at"))})
    return shaped(out, LOG_TABLES["blobs"]), turned.select(*BLOB)


def downloads(blobs: DataFrame) -> DataFrame:
    """Each blob with the key to read it, null until it is ready."""
    return blobs.select(*BLOB, "state", "content_type", "size", "checksum", F.when(F.col("state") == READY, F.col("storage_key")).alias("ticket"))


def overdue_uploads(blobs: DataFrame, before: Column) -> DataFrame:
    """Pending blobs whose ticket has run out: to be verified without the client."""
    return blobs.where((F.col("state") == PENDING) & (F.col("created_at") < before))


def collectable(blobs: DataFrame, before: Column) -> DataFrame:
    """Blobs that nothing has referred to since before, in whatever state."""
    return blobs.where(F.col("unreferenced_since") < before)


def sweep_report(collected: DataFrame) -> DataFrame:
    """Blobs and bytes released in each collection."""
    return collected.groupBy("scope_id", "collection_id").agg(F.count(F.lit(1)).alias("released"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
