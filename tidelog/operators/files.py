"""Files of a replica: which are tracked, wanted, moved next, given up or offered back. Bytes are the host's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.tokens import backoff_limit
from ..schema import BLOB, COLLECTION, ENTITY, MOVING, REPLICA_TABLES, shaped

#: Transfers at once, attempts before a file is given up, and the wait for one that isn't ready yet.
AT_ONCE, MOST_ATTEMPTS, NOT_READY_MS = 2, 5, 60_000


def adopted(files: DataFrame, refs: DataFrame, held: DataFrame, first_ord: int = 0) -> DataFrame:
    """files with a row for each referenced one not tracked yet: LOCAL if its bytes are held (held: BLOB), else REMOTE."""
    new = refs.select(*BLOB).distinct().join(files.select(*BLOB), BLOB, "left_anti")
    new = new.join(held.select(*BLOB).distinct().withColumn("_held", F.lit(True)), BLOB, "left")
    rank = F.row_number().over(Window.partitionBy(*COLLECTION).orderBy("blob_id")).cast("long")
    last = files.groupBy(*COLLECTION).agg(F.max("insert_ord").alias("_last"))
    rows = new.join(last, COLLECTION, "left").withColumns(
        {"state": F.when(F.col("_held"), "LOCAL").otherwise("REMOTE"), "wanted": F.coalesce("_held", F.lit(False)), "attempts": F.lit(0), "transferred": F.lit(0), "insert_ord": F.coalesce("_last", F.lit(first_ord)) + rank}
    )
    return files.unionByName(shaped(rows, REPLICA_TABLES["files"]))


def promoted(files: DataFrame, refs: DataFrame) -> DataFrame:
    """files that an eager reference names are wanted."""
    eager = refs.where("fetch = 'EAGER'").select(*BLOB).distinct().withColumn("_eager", F.lit(True))
    return shaped(files.join(eager, BLOB, "left").withColumn("wanted", F.col("wanted") | F.coalesce("_eager", F.lit(False))), REPLICA_TABLES["files"])


def with_references(files: DataFrame, refs: DataFrame) -> DataFrame:
    """files with `referenced`."""
    return files.join(refs.select(*BLOB).distinct().withColumn("_r", F.lit(True)), BLOB, "left").withColumn("referenced", F.coalesce("_r", F.lit(False))).drop("_r")


def released(files: DataFrame, refs: DataFrame, accepted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """files without the unreferenced ones that the application took back (accepted: BLOB), and all that are offered."""
    offered = files.join(refs.select(*BLOB).distinct(), BLOB, "left_anti")
    gone = offered.join(accepted.select(*BLOB), BLOB, "left_semi").select(*BLOB)
    return files.join(gone, BLOB, "left_anti"), offered


def reconciled(files: DataFrame, refs: DataFrame, held: DataFrame, accepted: DataFrame) -> DataFrame:
    """Adopt, promote, release."""
    return released(promoted(adopted(files, refs, held), refs), refs, accepted)[0]


def next_transfers(files: DataFrame, refs: DataFrame, now: int, at_once: int = AT_ONCE) -> DataFrame:
    """Each collection's next files to move: uploads before downloads, wanted, due, referenced, fewest attempts first."""
    due = F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= now)
    rows = files.where(F.col("state").isin(*MOVING) & F.col("wanted") & due).join(refs.select(*BLOB).distinct(), BLOB, "left_semi")
    rows = rows.withColumn("direction", F.when(F.col("state").isin("LOCAL", "UPLOADING"), "upload").otherwise("download"))
    rank = F.row_number().over(Window.partitionBy(*COLLECTION, "direction").orderBy("attempts", "insert_ord"))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= at_once).drop("_rank")


def next_wake(files: DataFrame, refs: DataFrame, now: int) -> DataFrame:
    """COLLECTION, at: the earliest retry still to come."""
    rows = files.where(F.col("wanted") & (F.col("next_retry_at") > now) & F.col("state").isin(*MOVING)).join(refs.select(*BLOB).distinct(), BLOB, "left_semi")
    return rows.groupBy(*COLLECTION).agg(F.min("next_retry_at").alias("at"))


def _rewritten(files: DataFrame, events: DataFrame, new: dict[str, Column]) -> DataFrame:
    rest = [c for c in events.columns if c not in BLOB]
    rows = files.join(events.select(*BLOB, F.struct(F.lit(1).alias("_"), *rest).alias("_e")), BLOB, "left")
    hit = F.col("_e").isNotNull()
    return shaped(rows.select(*[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in files.columns]), REPLICA_TABLES["files"])


def started(files: DataFrame, moves: DataFrame) -> DataFrame:
    """files with those about to move (next_transfers) marked so."""
    state = F.when(F.col("_e.direction") == "upload", "UPLOADING").otherwise("DOWNLOADING")
    return _rewritten(files, moves.select(*BLOB, "direction"), {"state": state, "transferred": F.lit(0)})


def transferred(files: DataFrame, events: DataFrame, now: int, most: int = MOST_ATTEMPTS) -> DataFrame:
    """files after transfers (BLOB, outcome, message).

    uploaded and downloaded end in UPLOADED and READY; refused in REFUSED; lost (no bytes anywhere) in
    UNAVAILABLE; not_ready waits a minute without counting; error waits with backoff and gives up
    after `most` attempts, when the file is UNAVAILABLE.
    """
    outcome, attempts = F.col("_e.outcome"), F.col("attempts") + 1
    final = F.when(outcome == "uploaded", "UPLOADED").when(outcome == "downloaded", "READY").when(outcome == "refused", "REFUSED").when(outcome == "lost", "UNAVAILABLE")
    gives_up = (outcome == "error") & (attempts >= most)
    good = outcome.isin("uploaded", "downloaded")
    return _rewritten(
        files, events,
        {
            "state": F.when(gives_up, "UNAVAILABLE").otherwise(F.coalesce(final, F.col("state"))),
            "attempts": F.when(good, 0).when(outcome == "error", attempts).otherwise(F.col("attempts")),
            "next_retry_at": F.when(outcome == "not_ready", F.lit(now + NOT_READY_MS)).when((outcome == "error") & ~gives_up, now + backoff_limit(attempts)),
            "last_error": F.when(~good, F.col("_e.message")),
            "transferred": F.lit(0),
        },
    )


def retried(files: DataFrame, asked: DataFrame) -> DataFrame:
    """files asked to be tried again (BLOB, held): given up or refused ones start over, moving ones lose their waits, done ones stay."""
    stopped = F.col("state").isin("UNAVAILABLE", "REFUSED")
    again = stopped | F.col("state").isin(*MOVING)
    return _rewritten(
        files, asked,
        {
            "state": F.when(stopped, F.when(F.col("_e.held"), "LOCAL").otherwise("REMOTE")).otherwise(F.col("state")),
            "wanted": F.col("wanted") | stopped,
            "attempts": F.when(again, 0).otherwise(F.col("attempts")),
            "next_retry_at": F.when(~again, F.col("next_retry_at")),
            "last_error": F.when(~again, F.col("last_error")),
        },
    )


def requested(files: DataFrame, refs: DataFrame, asked: DataFrame) -> DataFrame:
    """files after requests for their bytes (BLOB, held); those that no document names are ignored, untracked ones adopted."""
    named = asked.join(refs.select(*BLOB).distinct(), BLOB, "left_semi")
    restart = (F.col("state") == "UNAVAILABLE") & ~F.col("_e.held")
    out = adopted(files, named.select(*BLOB), named.where("held").select(*BLOB))
    return _rewritten(out, named, {"state": F.when(restart, "REMOTE").otherwise(F.col("state")), "wanted": F.lit(True), "attempts": F.when(restart, 0).otherwise(F.col("attempts")), "last_error": F.when(~restart, F.col("last_error"))})


def evicted(files: DataFrame, asked: DataFrame) -> DataFrame:
    """files whose bytes were given up (BLOB): those the log has are remote again and not wanted; others keep theirs."""
    safe = F.col("state").isin("READY", "UPLOADED")
    return _rewritten(files, asked, {"state": F.when(safe, "REMOTE").otherwise(F.col("state")), "wanted": F.col("wanted") & ~safe})


def erased(files: DataFrame, refs: DataFrame, target: Column) -> tuple[DataFrame, DataFrame]:
    return files.where(~target), refs.where(~target)


def declared(refs: DataFrame, documents: DataFrame, generation: Column, fetch: Column) -> DataFrame:
    """refs after documents (ENTITY, files: array of struct(blob_id, binding)) were written: each one's references are replaced.

    A null list (a deletion) clears. New references take `fetch`; kept ones keep theirs.
    """
    old = refs.select(*ENTITY, "blob_id", F.col("fetch").alias("_fetch"))
    new = documents.select(*ENTITY, F.inline("files")).join(old, [*ENTITY, "blob_id"], "left")
    new = new.withColumns({"fetch": F.coalesce("_fetch", fetch), "seen_gen": generation})
    rest = refs.join(documents.select(*ENTITY), ENTITY, "left_anti")
    return rest.unionByName(shaped(new, REPLICA_TABLES["file_refs"]))


def swept(refs: DataFrame, generations: DataFrame) -> DataFrame:
    """refs without those that the present generation (COLLECTION, generation) didn't see."""
    rows = refs.join(generations, COLLECTION, "left")
    return shaped(rows.where(F.coalesce(F.col("seen_gen") >= F.col("generation"), F.lit(True))), REPLICA_TABLES["file_refs"])
