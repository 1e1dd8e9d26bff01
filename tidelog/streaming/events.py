"""Notices that a log gives to its followers: as rows, as JSON text, and what a replica does about them.

A notice only says that there is something to do; what it is comes from the log. So notices may be lost,
repeated and merged: each batch of a stream becomes at most one action for each followed collection.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import statements
from ..plans.replica import Replica
from ..schema import BLOB, COLLECTION

#: Types of notices, fixed values of the wire format.
INVALIDATE, RESYNC, REVOKED, BLOB_READY = "invalidate", "resync", "revoked", "blobReady"
#: What a follower may be asked to do. A bootstrap includes a cycle, a cycle the transfers.
TRANSFER, CYCLE, BOOTSTRAP, REVOKE = "transfer", "cycle", "bootstrap", "revoke"
#: Notices: collection and seq or blob are null where the type has none; raw is the text as it came.
NOTICE = "scope_id string, type string, collection_id string, seq string, blob_id string, raw string"


def invalidations(changes: DataFrame) -> DataFrame:
    """NOTICE: one for each collection that changes touch, with the highest sequence."""
    heads = changes.groupBy(*COLLECTION).agg(F.max("seq").cast("string").alias("seq"))
    return encoded(heads.select("scope_id", F.lit(INVALIDATE).alias("type"), "collection_id", "seq", F.lit(None).cast("string").alias("blob_id")))


def files_ready(blobs: DataFrame) -> DataFrame:
    """NOTICE: one for each file (BLOB) that has become ready."""
    rows = blobs.select(*BLOB).distinct()
    return encoded(rows.select("scope_id", F.lit(BLOB_READY).alias("type"), "collection_id", F.lit(None).cast("string").alias("seq"), "blob_id"))


def encoded(notices: DataFrame) -> DataFrame:
    """notices with their JSON text as `raw`; absent fields are left out."""
    fields = F.struct("type", F.col("collection_id").alias("collection"), F.col("seq").alias("latestSeq"), F.col("blob_id").alias("blobId"))
    return notices.withColumn("raw", F.to_json(fields))


def decoded(rows: DataFrame) -> DataFrame:
    """NOTICE from (scope_id, raw). Text of an unknown type keeps that type; what isn't a JSON object is dropped, as it says nothing."""
    field = lambda name: F.get_json_object("raw", f"$.{name}")
    out = rows.select("scope_id", field("type").alias("type"), field("collection").alias("collection_id"), field("latestSeq").alias("seq"), field("blobId").alias("blob_id"), "raw")
    return out.where(F.get_json_object("raw", "$").startswith("{"))


def of_scope(notices: DataFrame, scope: str) -> DataFrame:
    return notices.where(F.col("scope_id") == scope)


def _urgency() -> Column:
    kind = F.col("type")
    return F.when(kind == REVOKED, 3).when(kind == RESYNC, 2).when(kind == BLOB_READY, 0).otherwise(1)


def asked(notices: DataFrame, followed: DataFrame) -> DataFrame:
    """COLLECTION, action: the strongest that the notices ask of each followed collection (COLLECTION).

    invalidate: a cycle. resync: a bootstrap. blobReady: transfers alone, as the log hasn't changed.
    revoked: the whole scope stops. Any other type, or none, may be a newer way to say that there is
    something to read: a cycle of all collections of the scope.
    """
    known = F.col("type").isin(INVALIDATE, RESYNC, BLOB_READY)
    whole = notices.where(~F.coalesce(known, F.lit(False))).groupBy("scope_id").agg(F.max(_urgency()).alias("u"))
    own = notices.where(known).groupBy(*COLLECTION).agg(F.max(_urgency()).alias("u"))
    rows = followed.select(*COLLECTION).distinct()
    both = rows.join(own, COLLECTION).select(*COLLECTION, "u").unionByName(rows.join(whole, "scope_id").select(*COLLECTION, "u"))
    names = F.array(*map(F.lit, (TRANSFER, CYCLE, BOOTSTRAP, REVOKE)))
    return both.groupBy(*COLLECTION).agg(F.max("u").alias("u")).select(*COLLECTION, F.element_at(names, F.col("u") + 1).alias("action"))


class Follower:
    """Keeps collections (scope, collection) of a replica in step with notices; collections followed are bounded by what the host names.

    `revoked` holds the scopes whose access has ended: they stay paused until the host resumes them.
    """

    def __init__(self, replica: Replica, collections: Iterable[tuple[str, str]]):
        self.replica, self.collections, self.revoked = replica, list(collections), set()

    def connected(self) -> None:
        """A channel was opened: notices may have been missed, so everything is read."""
        for scope, collection in self.collections:
            self.act(scope, collection, CYCLE)

    def act(self, scope: str, collection: str, action: str) -> None:
        if action == REVOKE:
            self.revoked.add(scope)
            self.replica.pause(scope)
        elif scope in self.replica.paused:
            return
        elif action == TRANSFER:
            self.replica.move_files()
        else:
            if action == BOOTSTRAP:
                base, state, _ = self.replica._open(scope, collection)
                self.replica._commit(base, state, statements.applied("replicas.update_phase", state, scope_id=scope, collection_id=collection, phase="RESYNC_REQUIRED"))
            self.replica.cycle(scope, collection)

    def handle(self, notices: DataFrame, _batch: int = 0) -> None:
        """Act on NOTICE rows; fits `foreachBatch`. Repeats do no harm."""
        followed = notices.sparkSession.createDataFrame(self.collections, "scope_id string, collection_id string")
        for row in asked(notices, followed).orderBy(*COLLECTION).collect():
            self.act(*row)


def every(spark: SparkSession, act: Callable[[], None], interval: str = "15 minutes") -> StreamingQuery:
    """Call act at once and then at each interval, never twice at a time; stop the query to end it."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(lambda _rows, _batch: act()).trigger(processingTime=interval).start()
