"""Tables of a store from and to a relational database, over JDBC."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from ..schema import shaped
from .store import VersionedStore

#: Tables with many rows and the numeric column by which tasks share them out.
SPLIT = {"changes": "seq", "batches": "seq", "entities": "last_seq"}


def table(spark: SparkSession, url: str, name: str, ddl: str, tasks: int = 1, prefix: str = "", **properties: str) -> DataFrame:
    """A table with the columns of ddl; large ones by `tasks` connections, each a range of its sequences (rows without one go to the first)."""
    reader = lambda what: spark.read.format("jdbc").options(url=url, fetchsize="10000", **properties).option("dbtable", what)
    rows, by = reader(prefix + name), SPLIT.get(name)
    if tasks > 1 and by:
        least, most = reader(f'(SELECT min("{by}") AS "a", max("{by}") AS "b" FROM {prefix}{name}) q').load().first()
        if least is not None and most > least:
            rows = rows.options(partitionColumn=by, lowerBound=str(least), upperBound=str(most + 1), numPartitions=str(tasks))
    return shaped(rows.load(), ddl)


def imported(store: VersionedStore, url: str, names: Iterable[str] | None = None, tasks: int = 8, prefix: str = "", **properties: str) -> int:
    """Replace tables of the store (all by default) by those of the database, in one commit; returns the version.

    The database should be at rest, as each connection reads by itself.
    """
    store.migrate()
    chosen = list(names or store.schemas)
    base = store.version()
    return store.commit(base, replace={n: table(store.spark, url, n, store.schemas[n], tasks, prefix, **properties) for n in chosen}, laid_out=True)


def exported(store: VersionedStore, url: str, names: Iterable[str] | None = None, connections: int = 8, prefix: str = "", **properties: str) -> int:
    """Write tables of the store's last version to the database, replacing what is there; returns the version.

    At most `connections` tasks write at a time. A table that stands is emptied, not dropped, so that its
    types and indexes stay. A task that is repeated after a lost executor rolls back its rows first;
    readers of the database see tables grow meanwhile.
    """
    version = store.version()
    for name, rows in store.read(version, names).items():
        target = rows.write.format("jdbc").options(url=url, truncate="true", batchsize="5000", numPartitions=str(connections), **properties)
        target.option("dbtable", prefix + name).mode("overwrite").save()
    return version
