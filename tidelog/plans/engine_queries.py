"""Queries of the log as a whole: each makes a log in the shared folder, pushes to it, and returns what is there then."""

from __future__ import annotations

import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.documents import merged
from ..schema import COLLECTION, ENTITY, LOG_TABLES
from ..sources.shared import new_path
from .engine import CollectionSpec, LogEngine, log_store
from .synthetic import view, with_views

TYPES = ("click", "error", "purchase", "signup", "view")
START = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


class _Days:
    """A clock set by hand."""

    def __init__(self):
        self.day = 0

    def __call__(self) -> datetime.datetime:
        return START + datetime.timedelta(days=self.day)


def _log(spark: SparkSession) -> tuple[LogEngine, _Days]:
    clock = _Days()
    return LogEngine(log_store(spark, new_path(spark, "log")), [CollectionSpec("ledger", TYPES)], clock=clock), clock


def _groups(ops: DataFrame) -> DataFrame:
    """Groups of operations (COLLECTION, client_id, group_id, arrival, op, ENTITY, base_version, data)."""
    op = F.struct("op", "entity_type", "entity_id", F.col("base_version").cast("string").alias("base_version"), "data", F.lit(None).cast("array<string>").alias("blobs"))
    return ops.groupBy(*COLLECTION, "client_id", "group_id", "arrival").agg(F.sort_array(F.collect_list(F.struct("entity_type", op.alias("o")))).alias("s")).withColumn("ops", F.col("s.o")).drop("s")


def _records(spark: SparkSession, sf: str) -> DataFrame:
    user = F.col("entity_id").cast("long")
    return view(spark, sf, "v_record").select(*ENTITY, "local_rev", user.alias("user"), F.concat(F.lit("c"), (user % 5).cast("string")).alias("client_id"), user.alias("arrival"))


def _first(spark: SparkSession, sf: str) -> DataFrame:
    """A group for each user, which creates all its entities."""
    rows = _records(spark, sf)
    data = F.concat(F.lit('{"n":'), F.col("local_rev").cast("string"), F.lit(',"keep":null}'))
    return _groups(rows.withColumns({"group_id": F.concat(F.lit("a"), "entity_id"), "op": F.lit("upsert"), "base_version": F.lit(None), "data": data}))


def _second(spark: SparkSession, sf: str, log: LogEngine) -> DataFrame:
    """A group for each user that patches its entities, or deletes those of type error; a third is stale, a seventh names an unknown type."""
    rows = _records(spark, sf).join(log.store.read()["entities"].select(*ENTITY, "version"), ENTITY)
    rows = rows.withColumns({"group_id": F.concat(F.lit("b"), "entity_id"), "base_version": F.when(F.col("user") % 3 == 0, F.lit(0)).otherwise(F.col("version")), "op": F.when(F.col("entity_type") == "error", "delete").otherwise("upsert")})
    rows = rows.withColumn("data", F.when(F.col("op") == "upsert", F.lit('{"n":9,"more":[1,{"b":1,"a":2}]}')))
    odd = rows.where("user % 7 = 0").withColumn("entity_type", F.lit("nothing")).dropDuplicates(["group_id"])
    return _groups(rows.unionByName(odd))


def _third(spark: SparkSession, sf: str) -> DataFrame:
    rows = _records(spark, sf).where("entity_type = 'view'").withColumns({"group_id": F.concat(F.lit("c"), "entity_id"), "entity_id": F.concat(F.lit("x"), "entity_id"), "op": F.lit("upsert"), "base_version": F.lit(None), "data": F.lit("{}")})
    return _groups(rows)


def _contents(log: LogEngine, answers: list[DataFrame]) -> DataFrame:
    """Answers, changes and entities in one shape."""
    state, name = log.store.read(), F.concat_ws("/", "entity_type", "entity_id")
    parts = [a.select(F.lit("answer").alias("what"), "scope_id", F.col("group_id").alias("name"), F.col("seq").alias("seq"), F.concat_ws("/", "status", F.get_json_object("response", "$.code")).alias("says"), F.lit(None).cast("string").alias("data")) for a in answers]
    parts.append(state["changes"].select(F.lit("change"), "scope_id", F.concat_ws("/", F.col("ordinal").cast("string"), name), "seq", "op", "data"))
    parts.append(state["entities"].select(F.lit("entity"), "scope_id", name, "version", F.when(F.col("is_deleted"), "gone").otherwise("live"), "data"))
    return reduce(DataFrame.unionAll, [p.toDF("what", "scope_id", "name", "seq", "says", "data") for p in parts])


#: SQL of what the pushes must leave: r the entities, a and b the answers to the first and second push, d the changes.
_SQL = """
WITH r AS (SELECT scope_id, entity_type, entity_id, CAST(entity_id AS BIGINT) AS u, local_rev, row_number() OVER (PARTITION BY scope_id, entity_id ORDER BY entity_type) - 1 AS ordinal FROM v_record),
users AS (SELECT DISTINCT scope_id, u FROM r),
a AS (SELECT scope_id, u, row_number() OVER (PARTITION BY scope_id ORDER BY u) AS seq FROM users),
heads AS (SELECT scope_id, max(seq) AS head FROM a GROUP BY scope_id),
s AS (SELECT scope_id, u, CASE WHEN u % 7 = 0 THEN 'rejected/UNKNOWN_ENTITY_TYPE' WHEN u % 3 = 0 THEN 'conflict' ELSE 'applied' END AS says FROM users),
b AS (SELECT s.scope_id, u, says, CASE WHEN says = 'applied' THEN head + row_number() OVER (PARTITION BY s.scope_id, says ORDER BY u) END AS seq FROM s JOIN heads ON s.scope_id = heads.scope_id),
d AS (SELECT r.scope_id, a.seq, ordinal, entity_type, entity_id, 'upsert' AS op, concat('{"keep":null,"n":', CAST(local_rev AS STRING), '}') AS data FROM r JOIN a ON r.scope_id = a.scope_id AND r.u = a.u
  UNION ALL SELECT r.scope_id, b.seq, ordinal, entity_type, entity_id, CASE WHEN entity_type = 'error' THEN 'delete' ELSE 'upsert' END, CASE WHEN entity_type <> 'error' THEN '{"keep":null,"more":[1,{"a":2,"b":1}],"n":9}' END
  FROM r JOIN b ON r.scope_id = b.scope_id AND r.u = b.u WHERE b.seq IS NOT NULL),
e AS (SELECT scope_id, concat(entity_type, '/', entity_id) AS name, max(seq) AS seq, CASE WHEN arg_max(op, seq) = 'delete' THEN 'gone' ELSE 'live' END AS says, arg_max(coalesce(data, '-'), seq) AS data FROM d GROUP BY ALL)
"""
_CHANGES = "SELECT 'change' AS what, scope_id, concat(CAST(ordinal AS STRING), '/', entity_type, '/', entity_id) AS name, seq, op AS says, data FROM d"
_ENTITIES = "SELECT 'entity' AS what, scope_id, name, seq, says, nullif(data, '-') AS data FROM e"


def push_end_to_end(spark: SparkSession, sf: str) -> DataFrame:
    """Two requests over all users, the second with conflicts and refusals: answers, changes and entities."""
    log, _ = _log(spark)
    answers = [log.push(_first(spark, sf))]
    answers.append(log.push(_second(spark, sf, log)))
    return _contents(log, answers)


def push_repeated(spark: SparkSession, sf: str) -> DataFrame:
    """The same request twice: the second gets the answers of the first and changes nothing."""
    log, _ = _log(spark)
    log.push(_first(spark, sf))
    answers = log.push(_first(spark, sf))
    again = answers.select(F.lit("answer").alias("what"), "scope_id", F.col("group_id").alias("name"), "seq", F.concat_ws("/", "outcome", "status").alias("says"))
    return again.unionAll(log.store.read()["batches"].select(F.lit("batch"), "scope_id", "group_id", "seq", F.lit("once")))


def push_dependent(spark: SparkSession, sf: str) -> DataFrame:
    """One request of single changes that build on one another: each entity's first, one based on it, and one that is stale."""
    log, _ = _log(spark)
    answers = log.push(_groups(_dependent(spark, sf)))
    version = F.get_json_object("response", "$.conflicts[0].version").cast("long")
    return answers.select("scope_id", "group_id", "status", "seq", version.alias("stored_version"))


def _dependent(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "v_log").select(*ENTITY, "client_id", F.col("event_id").alias("arrival"))
    rows = rows.withColumn("turn", F.row_number().over(Window.partitionBy(*ENTITY).orderBy("arrival"))).where("turn <= 3")
    sound = rows.where("turn <= 2").withColumn("seq", F.row_number().over(Window.partitionBy(*COLLECTION).orderBy("arrival")))
    first = sound.where("turn = 1").select(*ENTITY, F.col("seq").alias("_base"))
    rows = rows.join(first, ENTITY).withColumns({"base_version": F.when(F.col("turn") == 2, F.col("_base")), "group_id": F.concat(F.lit("d"), F.col("arrival").cast("string"))})
    return rows.withColumns({"op": F.lit("upsert"), "data": F.concat(F.lit('{"t'), F.col("turn").cast("string"), F.lit('":1}'))})


def trim_after(spark: SparkSession, sf: str) -> DataFrame:
    """Changes and entities after a trim that forgets the first two of three requests and their tombstones."""
    log, clock = _log(spark)
    log.push(_first(spark, sf))
    clock.day = 1
    log.push(_second(spark, sf, log))
    clock.day = 40
    log.push(_third(spark, sf))
    clock.day = 45
    report = log.trim()
    rows = _contents(log, [])
    counts = spark.createDataFrame([(r["scope_id"], r["removed"], r["swept"], r["retained"]) for r in report], "scope_id string, removed long, swept long, retained long")
    return rows.select("what", "scope_id", "name", "seq").unionAll(counts.select(F.lit("removed"), "scope_id", F.concat_ws("/", F.col("swept").cast("string"), F.col("retained").cast("string")), "removed"))


def purge_after(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of each table and scope in all files under the log's root after scope s2 was erased: none of s2."""
    log, _ = _log(spark)
    log.push(_first(spark, sf))
    log.push(_second(spark, sf, log))
    log.purge("s2")
    parts = []
    for name in ("changes", "batches", "entities", "push_results", "collections"):
        files = spark.read.option("recursiveFileLookup", "true").schema(LOG_TABLES[name]).parquet(f"{log.store.root}/{name}")
        parts.append(files.groupBy("scope_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "scope_id", "n"))
    return reduce(DataFrame.unionAll, parts)


def merge_patch(spark: SparkSession, sf: str) -> DataFrame:
    """Two documents of each line merged key by key: explicit nulls stay, nested values are replaced whole."""
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag").distinct()
    key, line = F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")
    old = F.when(F.col("l_returnflag") != "R", F.concat(F.lit('{"z":{"a":1,"b":2},"line":'), line, F.lit(',"key":'), key, F.lit("}")))
    new = F.concat(F.lit('{"key":null,"z":{"c":'), F.col("l_partkey").cast("string"), F.lit("}}"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", merged(old, new).alias("doc")).distinct()


QUERIES = {f.__name__: f for f in (push_end_to_end, push_repeated, push_dependent, trim_after, purge_after, merge_patch)}
ORACLE_SQL = {
    "push_end_to_end": with_views(
        _SQL + f"SELECT 'answer' AS what, scope_id, concat('a', CAST(u AS STRING)) AS name, seq, 'applied' AS says, NULL AS data FROM a UNION ALL SELECT 'answer', scope_id, concat('b', CAST(u AS STRING)), seq, says, NULL FROM b UNION ALL {_CHANGES} UNION ALL {_ENTITIES}"
    ),
    "push_repeated": with_views(
        _SQL + "SELECT 'answer' AS what, scope_id, concat('a', CAST(u AS STRING)) AS name, seq, 'repeated/applied' AS says FROM a UNION ALL SELECT 'batch', scope_id, concat('a', CAST(u AS STRING)), seq, 'once' FROM a"
    ),
    "push_dependent": with_views(
        "WITH t AS (SELECT *, row_number() OVER (PARTITION BY scope_id, entity_type, entity_id ORDER BY event_id) AS turn FROM v_log),"
        " q AS (SELECT scope_id, event_id, row_number() OVER (PARTITION BY scope_id ORDER BY event_id) AS n FROM t WHERE turn <= 2),"
        " w AS (SELECT t.scope_id, entity_type, entity_id, max(n) AS v FROM t JOIN q ON t.scope_id = q.scope_id AND t.event_id = q.event_id GROUP BY ALL)"
        " SELECT t.scope_id, concat('d', CAST(t.event_id AS STRING)) AS group_id, CASE WHEN turn = 3 THEN 'conflict' ELSE 'applied' END AS status, q.n AS seq, CASE WHEN turn = 3 THEN w.v END AS stored_version"
        " FROM t LEFT JOIN q ON t.scope_id = q.scope_id AND t.event_id = q.event_id JOIN w ON t.scope_id = w.scope_id AND t.entity_type = w.entity_type AND t.entity_id = w.entity_id WHERE turn <= 3"
    ),
    "trim_after": with_views(
        _SQL + ", n AS (SELECT scope_id, greatest(coalesce(max(b.seq), 0), (SELECT head FROM heads h WHERE h.scope_id = b.scope_id)) AS before FROM b GROUP BY scope_id),"
        " c AS (SELECT r.scope_id, r.entity_id, before + row_number() OVER (PARTITION BY r.scope_id ORDER BY r.u) AS seq FROM r JOIN n ON r.scope_id = n.scope_id WHERE entity_type = 'view')"
        " SELECT 'change' AS what, scope_id, concat('0/view/x', entity_id) AS name, seq FROM c UNION ALL SELECT 'entity', scope_id, concat('view/x', entity_id), seq FROM c UNION ALL SELECT 'entity', scope_id, name, seq FROM e WHERE says = 'live'"
        " UNION ALL SELECT 'removed', n.scope_id, concat(CAST((SELECT count(*) FROM e WHERE says = 'gone' AND e.scope_id = n.scope_id) AS STRING), '/', CAST((SELECT count(*) FROM c WHERE c.scope_id = n.scope_id) AS STRING)), before FROM n"
    ),
    "purge_after": with_views(
        _SQL + "SELECT 'changes' AS table_name, scope_id, count(*) AS n FROM d WHERE scope_id <> 's2' GROUP BY scope_id UNION ALL SELECT 'batches', scope_id, count(DISTINCT seq) FROM d WHERE scope_id <> 's2' GROUP BY scope_id"
        " UNION ALL SELECT 'entities', scope_id, count(*) FROM e WHERE scope_id <> 's2' GROUP BY scope_id UNION ALL SELECT 'push_results', scope_id, 2 * count(*) FROM users WHERE scope_id <> 's2' GROUP BY scope_id"
        " UNION ALL SELECT 'collections', scope_id, 1 FROM heads WHERE scope_id <> 's2'"
    ),
    "merge_patch": """SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'R' THEN concat('{"key":null,"z":{"c":', CAST(l_partkey AS STRING), '}}')
        ELSE concat('{"key":null,"line":', CAST(l_linenumber AS STRING), ',"z":{"c":', CAST(l_partkey AS STRING), '}}') END AS doc FROM lineitem""",
}
