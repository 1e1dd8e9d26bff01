"""A streaming sink that keeps an entity table in step with the changelog."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.log_read import current_state
from ..schema import ENTITY
from ..sources.changelog import ChangelogSource
from ..sources.store import VersionedStore

STATE = {"state": "scope_id string, collection_id string, entity_type string, entity_id string, version long, data string, is_deleted boolean", "applied": "batch_id long"}


def apply_batch(store: VersionedStore, on_applied: Callable[[DataFrame], None] | None = None) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: newer versions replace older ones. A batch that was committed before a crash is recognised and left out."""

    def run(changes: DataFrame, batch_id: int) -> None:
        base = store.version()
        state = store.read(base)
        if state["applied"].where(F.col("batch_id") == batch_id).count():
            return
        new = current_state(changes).select(*ENTITY, "version", "data", (F.col("op") == "delete").alias("is_deleted"))
        rest = [c for c in new.columns if c not in ENTITY]
        both = state["state"].unionByName(new).groupBy(*ENTITY).agg(F.max_by(F.struct(*rest), "version").alias("_r"))
        done = store.spark.createDataFrame([(batch_id,)], STATE["applied"])
        store.commit(base, append={"applied": done}, replace={"state": both.select(*ENTITY, "_r.*")})
        if on_applied:
            on_applied(new)

    return run


def follow(spark: SparkSession, log_root: str, store: VersionedStore, checkpoint: str, **options: str) -> StreamingQuery:
    """Apply all that the log at log_root has committed and stop; call again, or on a timer, for more."""
    spark.dataSource.register(ChangelogSource)
    store.migrate()
    changes = spark.readStream.format("changelog").options(path=log_root, **options).load()
    return changes.writeStream.foreachBatch(apply_batch(store)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


