"""Queries of single operators over whole synthetic tables, in one shape: what, name, value."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tokens
from ..operators import blobs, diagnostics, files, log_read, log_write, outbox, replica, retention
from ..schema import BLOB, COLLECTION, ENTITY, LOG_TABLES, REPLICA_TABLES, shaped
from ..streaming import events
from .synthetic import view, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def flat(df: DataFrame, what: str, name: list[str], value: list[str]) -> DataFrame:
    """Rows as text: names and values joined by slashes, null as a dash."""
    joined = lambda columns: F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns])
    return df.select(F.lit(what).alias("what"), joined(name).alias("name"), joined(value).alias("value"))


def sql(what: str, name: list[str], value: list[str], source: str) -> str:
    joined = lambda columns: "concat_ws('/', " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '-')" for c in columns) + ")"
    return f"SELECT '{what}' AS what, {joined(name)} AS name, {joined(value)} AS value FROM {source}"


def query(*parts: str, before: str = "") -> Callable[[Query], Query]:
    """Register a query with the SQL of its parts; before: common tables that they use."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = with_views((f"WITH {before} " if before else "") + " UNION ALL ".join(parts))
        return f

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    own = view(spark, sf, f"t_{name}")
    return shaped(own, REPLICA_TABLES[name]) if name in REPLICA_TABLES else own


def union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionAll, parts)


_E = ["scope_id", "entity_type", "entity_id"]

# -- scalars


@query(sql("v", ["seq"], ["seq", "CASE WHEN seq % 2 = 0 THEN seq END", "least(greatest(seq - 3, 1), 500)"], "(SELECT DISTINCT seq FROM v_log) l"))
def version_texts(spark, sf):
    """Versions as text and back (null where the text is none), and a number clamped to a page."""
    rows = view(spark, sf, "v_log").select("seq").distinct()
    odd = F.when(F.col("seq") % 2 == 0, tokens.version(F.col("seq"))).otherwise(F.concat(tokens.version(F.col("seq")), F.lit("x")))
    return flat(rows.withColumns({"text": tokens.version(F.col("seq")), "back": tokens.sequence_of(odd), "clamped": tokens.clamp(F.col("seq") - 3, 500)}), "v", ["seq"], ["text", "back", "clamped"])


_UUID = "concat(lpad(lower(hex(seq)), 8, '0'), '-0000-7000-8000-', lpad(lower(hex(seq * 7)), 12, '0'))"


@query(sql("u", [_UUID], [_UUID, "16"], "(SELECT DISTINCT seq FROM v_log) l"))
def uuid_round_trip(spark, sf):
    part = lambda x, n: F.lpad(F.lower(F.hex(x)), n, "0")
    text = F.concat(part(F.col("seq"), 8), F.lit("-0000-7000-8000-"), part(F.col("seq") * 7, 12))
    rows = view(spark, sf, "v_log").select("seq").distinct().withColumn("text", text).withColumn("raw", tokens.uuid_bytes(F.col("text")))
    return flat(rows.withColumns({"back": tokens.uuid_text(F.col("raw")), "n": F.octet_length("raw")}), "u", ["text"], ["back", "n"])


@query(sql("n", ["scope_id"], ["max(ord) + 1"], "t_groups GROUP BY scope_id"))
def next_ordinals(spark, sf):
    return flat(table(spark, sf, "groups").groupBy("scope_id").agg(tokens.next_after(F.col("ord")).alias("n")), "n", ["scope_id"], ["n"])


@query(
    sql("reject", ["code"], ["CASE code WHEN 'VALIDATION' THEN 'Validation' WHEN 'UNKNOWN_ENTITY_TYPE' THEN 'UnknownEntityType' WHEN 'TOO_LARGE' THEN 'TooLarge' ELSE 'Unknown' END"], "(SELECT DISTINCT code FROM k) c"),
    sql("http", ["status"], ["CASE status WHEN 401 THEN 'Unauthorized' WHEN 403 THEN 'Forbidden' WHEN 409 THEN 'CollectionReset' WHEN 410 THEN 'CursorTooOld' WHEN 429 THEN 'RateLimited' ELSE 'ServerError' END"], "(SELECT DISTINCT status FROM k) c"),
    before="k AS (SELECT CASE seq % 4 WHEN 0 THEN 'VALIDATION' WHEN 1 THEN 'UNKNOWN_ENTITY_TYPE' WHEN 2 THEN 'TOO_LARGE' ELSE 'OTHER' END AS code, 400 + seq % 110 AS status FROM v_log)",
)
def failure_kinds(spark, sf):
    """What a replica makes of reject codes and of HTTP statuses."""
    seq = F.col("seq")
    rows = view(spark, sf, "v_log").select(F.element_at(F.array(*map(F.lit, ("VALIDATION", "UNKNOWN_ENTITY_TYPE", "TOO_LARGE", "OTHER"))), (seq % 4).cast("int") + 1).alias("code"), (400 + seq % 110).alias("status"))
    codes = rows.select("code").distinct().withColumn("kind", tokens.rejection_of(F.col("code")))
    return union(flat(codes, "reject", ["code"], ["kind"]), flat(rows.select("status").distinct().withColumn("kind", tokens.failure_of(F.col("status"))), "http", ["status"], ["kind"]))


@query(sql("b", ["attempt"], ["CAST(floor(CAST(least(1000 * power(2.0, least(attempt - 1, 20)), 300000) AS BIGINT) * 0.25) AS BIGINT)"], "(SELECT DISTINCT k + 1 AS attempt FROM v_log) a"))
def backoff_jitter(spark, sf):
    """The wait that a share of a quarter gives."""
    rows = view(spark, sf, "v_log").select((F.col("k") + 1).alias("attempt")).distinct()
    return flat(rows.withColumn("wait", tokens.backoff(F.col("attempt"), F.lit(0.25))), "b", ["attempt"], ["wait"])


# -- files of the log

_BLOBS = "b AS (SELECT *, CAST(blob_id AS BIGINT) AS n FROM v_blob)"


def _blobs(spark, sf) -> DataFrame:
    """Registered files with what the views leave out: keys, types, dates that follow the id."""
    rows = view(spark, sf, "v_blob").withColumn("_n", F.col("blob_id").cast("long"))
    day = lambda n: F.timestamp_seconds(n * 86400)
    rows = rows.withColumns({"storage_key": F.concat(F.lit("k"), "blob_id"), "content_type": F.lit("text/html"), "checksum": F.when(F.col("_n") % 2 == 0, F.lit("sum")), "created_at": day(F.col("_n")), "unreferenced_since": F.when(F.col("_n") % 4 == 0, day(F.col("_n")))})
    return shaped(rows, LOG_TABLES["blobs"])


def _written(spark, sf) -> DataFrame:
    """Changes that say something of files: documents of even number name another file, every sixth is deleted, every tenth says nothing."""
    doc = F.col("entity_id").cast("long")
    refs = view(spark, sf, "v_ref")
    said = F.when((doc % 10 != 0) & (doc % 6 != 0), F.array(F.concat((F.col("blob_id").cast("long") + 5).cast("string"))))
    rows = refs.where(doc % 2 == 0).select(*ENTITY, F.lit(1).alias("seq"), F.lit(0).alias("ordinal"), F.when(doc % 6 == 0, "delete").otherwise("upsert").alias("op"), said.alias("blobs"))
    return rows


_WRITTEN = "w AS (SELECT *, CAST(entity_id AS BIGINT) % 6 = 0 AS gone FROM v_ref WHERE CAST(entity_id AS BIGINT) % 2 = 0 AND (CAST(entity_id AS BIGINT) % 10 <> 0 OR CAST(entity_id AS BIGINT) % 6 = 0))"
_AFTER = "a AS (SELECT scope_id, entity_type, entity_id, blob_id FROM v_ref r WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.entity_id = r.entity_id) UNION ALL SELECT scope_id, entity_type, entity_id, CAST(CAST(blob_id AS BIGINT) + 5 AS VARCHAR) FROM w WHERE NOT gone)"
_TOUCHED = "x AS (SELECT scope_id, blob_id FROM w UNION SELECT scope_id, CAST(CAST(blob_id AS BIGINT) + 5 AS VARCHAR) FROM w WHERE NOT gone)"


@query(sql("ref", [*_E, "blob_id"], ["1"], "a"), sql("touched", ["scope_id", "blob_id"], ["1"], "x"), before=f"{_WRITTEN}, {_AFTER}, {_TOUCHED}")
def refs_replaced(spark, sf):
    """References after changes replace, clear or leave them, and the files touched."""
    after, touched = blobs.replaced(view(spark, sf, "v_ref").select(*ENTITY, "blob_id"), _written(spark, sf))
    return union(flat(after.withColumn("one", F.lit(1)), "ref", [*_E, "blob_id"], ["one"]), flat(touched.withColumn("one", F.lit(1)), "touched", ["scope_id", "blob_id"], ["one"]))


@query(
    sql("since", ["scope_id", "blob_id"], ["CASE WHEN touched AND used THEN NULL WHEN touched AND n % 4 <> 0 THEN 999 WHEN n % 4 = 0 THEN n END"], "s"),
    before=f"{_BLOBS}, {_WRITTEN}, {_AFTER}, {_TOUCHED}, s AS (SELECT *, EXISTS (SELECT 1 FROM x WHERE x.scope_id = b.scope_id AND x.blob_id = b.blob_id) AS touched, EXISTS (SELECT 1 FROM a WHERE a.scope_id = b.scope_id AND a.blob_id = b.blob_id) AS used FROM b)",
)
def unreferenced_since(spark, sf):
    """The day since which nothing refers to a file: cleared, stamped once or left, for touched files alone."""
    after, touched = blobs.replaced(view(spark, sf, "v_ref").select(*ENTITY, "blob_id"), _written(spark, sf))
    out = blobs.settled(_blobs(spark, sf), after, touched, F.timestamp_seconds(F.lit(999 * 86400)))
    return flat(out.withColumn("day", (F.unix_seconds("unreferenced_since") / 86400).cast("long")), "since", ["scope_id", "blob_id"], ["day"])


_SEEN = "v AS (SELECT *, CASE WHEN n % 7 = 0 THEN 'BLOB_NOT_UPLOADED' WHEN n % 11 = 0 THEN 'BLOB_REJECTED' WHEN n % 13 = 0 THEN 'BLOB_MISMATCH' WHEN n % 2 = 0 AND n % 5 = 0 THEN 'BLOB_MISMATCH' END AS refusal FROM b)"


def _verified(spark, sf) -> DataFrame:
    n = F.col("blob_id").cast("long")
    found = {"found": n % 7 != 0, "rejected": n % 11 == 0, "found_size": F.when(n % 13 == 0, F.col("size") + 1).otherwise(F.col("size")), "found_checksum": F.when(n % 5 == 0, "other").otherwise(F.lit("sum"))}
    return blobs.verification(_blobs(spark, sf).withColumns(found))


@query(sql("verified", ["scope_id", "blob_id"], ["refusal"], "v"), before=f"{_BLOBS}, {_SEEN}")
def upload_verification(spark, sf):
    return flat(_verified(spark, sf), "verified", ["scope_id", "blob_id"], ["refusal"])


@query(
    sql("blob", ["scope_id", "blob_id"], ["CASE WHEN refusal IS NULL THEN 'READY' ELSE state END", "refusal IS NULL AND state = 'PENDING'"], "v"),
    sql("turned", ["scope_id", "blob_id"], ["1"], "v WHERE refusal IS NULL AND state = 'PENDING'"), before=f"{_BLOBS}, {_SEEN}",
)
def uploads_promoted(spark, sf):
    """Pending files whose upload is as declared become ready, once."""
    out, turned = blobs.promoted(_blobs(spark, sf), _verified(spark, sf), F.timestamp_seconds(F.lit(1)))
    return union(flat(out.withColumn("now", F.col("ready_at").isNotNull()), "blob", ["scope_id", "blob_id"], ["state", "now"]), flat(turned.withColumn("one", F.lit(1)), "turned", ["scope_id", "blob_id"], ["one"]))


@query(sql("ticket", ["scope_id", "blob_id"], ["state", "size", "CASE WHEN state = 'READY' THEN concat('k', blob_id) END"], "b"), sql("late", ["scope_id", "blob_id"], ["state"], "b WHERE state = 'PENDING' AND n < 100"), before=_BLOBS)
def downloads_and_overdue(spark, sf):
    """What may be downloaded with which key, and pending uploads whose ticket has run out."""
    own = _blobs(spark, sf)
    late = blobs.overdue_uploads(own, F.timestamp_seconds(F.lit(100 * 86400)))
    return union(flat(blobs.downloads(own), "ticket", ["scope_id", "blob_id"], ["state", "size", "ticket"]), flat(late, "late", ["scope_id", "blob_id"], ["state"]))


_DECLARED = "d AS (SELECT *, n % 9 = 8 AS new, n % 6 = 5 AS image, CASE WHEN n % 9 = 8 THEN concat('n', blob_id) ELSE blob_id END AS id FROM b), o AS (SELECT *, CASE WHEN size > 5000 THEN 'BLOB_TOO_LARGE' WHEN image AND n % 4 = 3 THEN 'BLOB_TYPE_NOT_ALLOWED' WHEN new THEN 'inserted' WHEN state = 'READY' AND image THEN 'BLOB_DECLARATION_CONFLICT' WHEN state = 'READY' THEN 'ready' ELSE 'redeclared' END AS outcome FROM d)"


@query(
    sql("outcome", ["scope_id", "id"], ["outcome", "outcome IN ('inserted', 'redeclared')"], "o"),
    sql("blob", ["b.scope_id", "b.blob_id"], ["b.state", "CASE WHEN o.outcome = 'redeclared' AND image THEN 'image/png' ELSE 'text/html' END", "concat('k', b.blob_id)"], "b LEFT JOIN o ON o.scope_id = b.scope_id AND o.id = b.blob_id"),
    sql("blob", ["scope_id", "id"], ["'PENDING'", "CASE WHEN image THEN 'image/png' ELSE 'text/html' END", "'fresh'"], "o WHERE outcome = 'inserted'"), before=f"{_BLOBS}, {_DECLARED}",
)
def blob_declarations(spark, sf):
    """Declarations inserted, made anew, reused or refused for size, type or another declaration, and the files after them."""
    own = _blobs(spark, sf)
    n = F.col("blob_id").cast("long")
    kind = F.when(n % 6 == 5, F.when(n % 4 == 3, "image/bad").otherwise("image/png")).otherwise("text/html")
    declared = own.select("scope_id", "collection_id", F.when(n % 9 == 8, F.concat(F.lit("n"), "blob_id")).otherwise(F.col("blob_id")).alias("blob_id"), kind.alias("content_type"), "size", "checksum")
    outcome, after = blobs.registrations(declared, own, 5000, F.col("d.content_type") != "image/bad", F.lit("fresh"), F.timestamp_seconds(F.lit(1)))
    return union(flat(outcome, "outcome", ["scope_id", "blob_id"], ["outcome", "needs_upload"]), flat(after, "blob", ["scope_id", "blob_id"], ["state", "content_type", "storage_key"]))


@query(sql("sum", ["scope_id"], ["count(*)", "CAST(sum(size) AS BIGINT)", "count(*) = 0 AND sum(size) = 0"], "b GROUP BY scope_id"), sql("target", ["scope_id", "collection_id"], ["1"], "(SELECT DISTINCT scope_id, collection_id FROM t_replicas) t"), before=_BLOBS)
def report_sums(spark, sf):
    """Reports of single files added up, and the list of collections."""
    each = _blobs(spark, sf).select("scope_id", F.lit(1).alias("released"), F.col("size").alias("bytes"))
    listed = retention.targets(table(spark, sf, "replicas")).withColumn("one", F.lit(1))
    return union(flat(retention.added(each, ["scope_id"]), "sum", ["scope_id"], ["released", "bytes", "is_empty"]), flat(listed, "target", COLLECTION, ["one"]))


@query(sql("doc", _E, ["version", "is_deleted", "array_to_string(blobs, ',')"], "(SELECT l.scope_id, l.entity_type, l.entity_id, l.version, l.is_deleted, list_sort(list(DISTINCT r.blob_id) FILTER (r.blob_id IS NOT NULL)) AS blobs FROM (SELECT scope_id, entity_type, entity_id, seq AS version, op = 'delete' AS is_deleted FROM (SELECT *, row_number() OVER (PARTITION BY scope_id, entity_type, entity_id ORDER BY seq DESC) AS rn FROM v_log) y WHERE rn = 1) l LEFT JOIN v_ref r ON r.scope_id = l.scope_id WHERE l.scope_id = 's1' AND l.entity_type = 'view' AND l.entity_id = '13' AND NOT l.is_deleted GROUP BY ALL) z"))
def one_document(spark, sf):
    """One live document with its files in order."""
    state = log_read.current_state(view(spark, sf, "v_log")).where("scope_id = 's1'")
    entities = state.select(*ENTITY, F.col("seq").alias("version"), (F.col("op") == "delete").alias("is_deleted"))
    refs = view(spark, sf, "v_ref").withColumns({"entity_type": F.lit("view"), "entity_id": F.lit("13"), "collection_id": F.lit("ledger")})
    return flat(log_read.document(entities, refs, "view", "13").withColumn("files", F.concat_ws(",", "blobs")), "doc", _E, ["version", "is_deleted", "files"])


# -- the outbox

_GV = ["ord", "state", "attempts", "next_retry_at", "dependency_merges", "last_error", "reject_code", "reject_entity_type", "reject_entity_id"]
_RV = ["server_version", "local_rev", "pushing_rev", "acked_rev", "intent", "group_id", "conflict_id", "seen_gen"]


def _state(groups: DataFrame | None = None, records: DataFrame | None = None) -> DataFrame:
    parts = [flat(groups, "group", ["scope_id", "group_id"], _GV)] if groups is not None else []
    return union(*parts, *([flat(records, "record", _E, _RV)] if records is not None else []))


def _own(alias: str, columns: list[str], **other: str) -> list[str]:
    """Column expressions: those of alias but for the given ones."""
    return [other.get(c, f"{alias}.{c}") for c in columns]


@query(
    sql("group", ["scope_id", "CASE WHEN again THEN concat('n', group_id) ELSE group_id END"], ["ord", *[f"CASE WHEN again THEN {v} ELSE {c} END" for c, v in (("state", "'PENDING'"), ("attempts", "0"), ("next_retry_at", "NULL"), ("dependency_merges", "dependency_merges"), ("last_error", "NULL"), ("reject_code", "NULL"), ("reject_entity_type", "NULL"), ("reject_entity_id", "NULL"))]], "g"),
    sql("record", _own("r", _E), _own("r", _RV, group_id="CASE WHEN g.again THEN concat('n', r.group_id) ELSE r.group_id END"), "t_records r LEFT JOIN g ON g.group_id = r.group_id"),
    before="g AS (SELECT *, (attempts > 0 OR state = 'IN_FLIGHT') AND EXISTS (SELECT 1 FROM t_records r WHERE r.group_id = t_groups.group_id AND r.local_rev > r.pushing_rev) AS again FROM t_groups)",
)
def groups_rebuilt(spark, sf):
    """Groups sent before and edited since get a new id in their place."""
    groups, records = outbox.rebuilt(table(spark, sf, "groups"), table(spark, sf, "records"), F.concat(F.lit("n"), "group_id"))
    return _state(groups, records)


@query(
    sql("record", _own("r", _E), _own("r", _RV, server_version="coalesce(v, r.server_version)", acked_rev="acked", intent="CASE WHEN NOT free THEN r.intent END", group_id="CASE WHEN free THEN NULL WHEN v IS NOT NULL THEN concat('n', r.group_id) ELSE r.group_id END"), "r"),
    sql("group", ["scope_id", "group_id"], _GV, "t_groups WHERE state <> 'IN_FLIGHT'"),
    sql("group", ["scope_id", "concat('n', group_id)"], ["last + row_number() OVER (PARTITION BY scope_id ORDER BY ord)", "'PENDING'", "0", "NULL", "0", "NULL", "NULL", "NULL", "NULL"], "g WHERE state = 'IN_FLIGHT' AND EXISTS (SELECT 1 FROM r WHERE r.group_id = g.group_id AND NOT free)"),
    before="g AS (SELECT *, max(ord) OVER (PARTITION BY scope_id) AS last FROM t_groups), q AS (SELECT x.*, CASE WHEN g.state = 'IN_FLIGHT' THEN 'v7' END AS v, CASE WHEN g.state = 'IN_FLIGHT' THEN x.pushing_rev ELSE x.acked_rev + 0 END AS acked FROM (SELECT * FROM t_records) x LEFT JOIN g ON g.group_id = x.group_id), r AS (SELECT *, v IS NOT NULL AND local_rev <= acked AS free FROM q)",
)
def groups_retired(spark, sf):
    """Answers cover the revision sent: clean records leave their group, those edited since go to a new one at the end."""
    groups, records = table(spark, sf, "groups"), table(spark, sf, "records")
    done = groups.where("state = 'IN_FLIGHT'").select("group_id")
    versions = records.join(done, "group_id", "left_semi").select(*ENTITY, F.lit("v7").alias("server_version"))
    return _state(*outbox.acknowledged(groups, records, versions, done, F.concat(F.lit("n"), "group_id")))


_NOW = 5000
_WAIT = "CAST(least(1000 * power(2.0, least(attempts, 20)), 300000) AS BIGINT)"


@query(
    sql("outcome", ["scope_id", "group_id"], ["outcome"], "k"),
    sql("group", ["scope_id", "group_id"], _GV, "t_groups g WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.group_id = g.group_id OR (k.next = g.group_id AND outcome = 'merged'))"),
    sql("group", ["scope_id", "concat('m', group_id)"], ["ord", "'PENDING'", "0", "NULL", "dependency_merges + 1", "NULL", "NULL", "NULL", "NULL"], "k WHERE outcome = 'merged'"),
    sql("group", ["scope_id", "group_id"], ["ord", "'FAILED'", "attempts + 1", "NULL", "dependency_merges", "'why'", "'DEPENDENCY'", "NULL", "NULL"], "k WHERE outcome = 'failed'"),
    sql("group", ["scope_id", "concat('m', group_id)"], ["ord", "'PENDING'", "attempts + 1", f"{_NOW} + {_WAIT}", "dependency_merges", "'why'", "NULL", "NULL", "NULL"], "k WHERE outcome = 'waits'"),
    sql("record", _own("r", _E), _own("r", _RV, group_id="coalesce((SELECT 'm' || min(k.group_id) FROM k WHERE outcome <> 'failed' AND (k.group_id = r.group_id OR (outcome = 'merged' AND k.next = r.group_id))), r.group_id)"), "t_records r"),
    before="k AS (SELECT *, CASE WHEN dependency_merges >= 3 THEN 'failed' WHEN next IS NOT NULL THEN 'merged' ELSE 'waits' END AS outcome FROM (SELECT g.*, (SELECT arg_min(n.group_id, n.ord) FROM t_groups n WHERE n.scope_id = g.scope_id AND n.state = 'PENDING' AND n.ord > g.ord) AS next FROM t_groups g WHERE g.ord IN (2, 3, 8, 9)) y)",
)
def dependency_refusals(spark, sf):
    """A group refused for a dependency joins the next pending one, waits where there is none, or fails after three merges."""
    groups, records = table(spark, sf, "groups"), table(spark, sf, "records")
    no = groups.where(F.col("ord").isin(2, 3, 8, 9)).select("group_id", F.lit("why").alias("message"))
    after, moved, outcome = outbox.merged_after_dependency(groups, records, no, _NOW, F.concat(F.lit("m"), "group_id"), 3)
    return union(flat(outcome, "outcome", ["scope_id", "group_id"], ["outcome"]), _state(after, moved))


@query(
    sql("group", ["scope_id", "CASE WHEN hit THEN concat('n', group_id) ELSE group_id END"], ["ord", *[f"CASE WHEN hit THEN {v} ELSE {c} END" for c, v in (("state", "'PENDING'"), ("attempts", "attempts + 1"), ("next_retry_at", f"{_NOW} + {_WAIT}"))], "dependency_merges", "CASE WHEN hit THEN 'lost' ELSE last_error END", "reject_code", "reject_entity_type", "reject_entity_id"], "g"),
    sql("record", _own("r", _E), _own("r", _RV, group_id="CASE WHEN g.hit THEN concat('n', r.group_id) ELSE r.group_id END"), "t_records r LEFT JOIN g ON g.group_id = r.group_id"),
    sql("file", ["scope_id", "blob_id"], [f"CASE WHEN again THEN {v} ELSE {c} END" for c, v in (("state", "'LOCAL'"), ("wanted", "TRUE"), ("attempts", "0"), ("next_retry_at", "NULL"), ("last_error", "NULL"), ("transferred", "0"))], "(SELECT f.*, EXISTS (SELECT 1 FROM t_file_refs q JOIN t_records r ON r.scope_id = q.scope_id AND r.entity_id = q.entity_id JOIN g ON g.group_id = r.group_id WHERE hit AND q.scope_id = f.scope_id AND q.blob_id = f.blob_id) AS again FROM t_files f) z"),
    before="g AS (SELECT *, state = 'IN_FLIGHT' AS hit FROM t_groups)",
)
def files_sent_again(spark, sf):
    """A refusal for a missing file: every file of the group is sent again and the group waits under a new id."""
    place = {"collection_id": F.lit("x"), "entity_type": F.lit("x")}
    groups, records = table(spark, sf, "groups"), table(spark, sf, "records")
    refs, own = table(spark, sf, "file_refs").withColumns(place), table(spark, sf, "files").withColumn("collection_id", F.lit("x"))
    no = groups.where("state = 'IN_FLIGHT'").select("group_id", F.lit("lost").alias("message"))
    after, moved, sent = outbox.reuploading(groups, records.withColumns(place | {"conflict_id": F.concat_ws("|", "entity_type", "conflict_id")}), refs, own, no, _NOW, F.concat(F.lit("n"), "group_id"))
    kind = F.split("conflict_id", r"\|")  # the records' types travel in a column that the operator leaves alone
    moved = moved.withColumns({"entity_type": F.get(kind, F.lit(0)), "conflict_id": F.get(kind, F.lit(1))})
    return union(_state(after, moved), flat(sent, "file", ["scope_id", "blob_id"], ["state", "wanted", "attempts", "next_retry_at", "last_error", "transferred"]))


@query(
    sql("failed", ["scope_id", "group_id"], ["ord", *[f"CASE WHEN state = 'IN_FLIGHT' THEN {v} ELSE {c} END" for c, v in (("state", "'PENDING'"), ("attempts", "attempts + 1"), ("next_retry_at", f"{_NOW} + CASE WHEN ord % 2 = 0 THEN 77 ELSE {_WAIT} END"))], "dependency_merges", "CASE WHEN state = 'IN_FLIGHT' THEN 'offline' ELSE last_error END", "reject_code", "reject_entity_type", "reject_entity_id"], "t_groups"),
    sql("refused", ["scope_id", "group_id"], ["ord", *[f"CASE WHEN state = 'IN_FLIGHT' THEN {v} ELSE {c} END" for c, v in (("state", "'FAILED'"), ("attempts", "attempts + 1"), ("next_retry_at", "NULL"), ("dependency_merges", "dependency_merges"), ("last_error", "'no'"), ("reject_code", "'VALIDATION'"), ("reject_entity_type", "'view'"), ("reject_entity_id", "CAST(ord AS VARCHAR)"))]], "t_groups"),
)
def push_failures(spark, sf):
    """Groups after the transport failed (the log's own wait wins) and after final refusals."""
    groups = table(spark, sf, "groups")
    lost = groups.where("state = 'IN_FLIGHT'").select("group_id", F.lit("offline").alias("message"), F.when(F.col("ord") % 2 == 0, F.lit(77)).cast("long").alias("retry_after_ms"))
    no = groups.where("state = 'IN_FLIGHT'").select("group_id", F.lit("VALIDATION").alias("code"), F.lit("no").alias("message"), F.lit("view").alias("entity_type"), F.col("ord").cast("string").alias("entity_id"))
    return union(flat(outbox.failed_push(groups, lost, _NOW), "failed", ["scope_id", "group_id"], _GV), flat(outbox.refused(groups, no), "refused", ["scope_id", "group_id"], _GV))


@query(
    sql("head", ["scope_id", "group_id"], ["CASE WHEN state = 'PENDING' AND next_retry_at > 500 THEN 'retry' WHEN state IN ('CONFLICTED', 'FAILED') THEN 'decision' END"], "t_groups"),
    sql("sent", ["scope_id", "group_id"], ["CASE WHEN ord % 3 = 0 THEN 'IN_FLIGHT' ELSE state END"], "t_groups"),
    sql("rev", _own("r", _E), ["CASE WHEN g.group_id IS NOT NULL THEN r.local_rev ELSE r.pushing_rev END"], "t_records r LEFT JOIN (SELECT * FROM t_groups WHERE ord % 3 = 0) g ON g.group_id = r.group_id"),
)
def groups_sent(spark, sf):
    """What each group waits for, and groups and records once every third group is on the wire."""
    groups, records = table(spark, sf, "groups"), table(spark, sf, "records")
    after, moved = outbox.sent(groups, records, groups.where("ord % 3 = 0"))
    return union(flat(outbox.readiness(groups, 500), "head", ["scope_id", "group_id"], ["waits_for"]), flat(after, "sent", ["scope_id", "group_id"], ["state"]), flat(moved, "rev", _E, ["pushing_rev"]))


@query(
    sql("ops", ["scope_id", "group_id"], ["count(*)", "count(*) FILTER (k % 2 = 0)", "string_agg(concat(entity_type, '.', entity_id), ',' ORDER BY entity_type, entity_id)"], "e GROUP BY scope_id, group_id"),
    sql("large", ["scope_id", "group_id"], ["CASE WHEN count(*) > 3 THEN 'operations' ELSE 'document' END"], "e GROUP BY scope_id, group_id HAVING count(*) > 3 OR max(CASE WHEN k % 2 <> 0 THEN k + 2 ELSE 0 END) > 20"),
    before="e AS (SELECT *, CAST(entity_id AS BIGINT) AS k FROM t_records WHERE local_rev > acked_rev AND group_id IS NOT NULL)",
)
def group_envelopes(spark, sf):
    """Operations of each group as its documents are now (every other one is gone), and those too large to send."""
    records = table(spark, sf, "records")
    k = F.col("entity_id").cast("long")
    documents = records.where(k % 2 != 0).select(*ENTITY, F.concat(F.lit('"'), F.repeat(F.lit("x"), k.cast("int")), F.lit('"')).alias("data"))
    ops = outbox.operations(records.select("group_id").distinct(), records, documents)
    out, large = outbox.envelopes(ops, ("op", "entity_type", "entity_id")), outbox.oversized(ops, 3, 20)
    names = F.array_join(F.transform("ops", lambda o: F.concat_ws(".", o["entity_type"], o["entity_id"])), ",")
    gone = F.size(F.filter("ops", lambda o: o["op"] == "delete"))
    return union(flat(out.withColumns({"n": F.size("ops"), "gone": gone, "names": names}), "ops", ["scope_id", "group_id"], ["n", "gone", "names"]), flat(large, "large", ["scope_id", "group_id"], ["reason"]))


@query(
    sql("record", _own("r", _E), ["r.local_rev + 1", "'DELETE'", "CASE WHEN g.state IN ('PENDING', 'IN_FLIGHT') THEN r.group_id ELSE concat('new', r.entity_id) END"], "t_records r LEFT JOIN t_groups g ON g.group_id = r.group_id"),
    sql("group", ["scope_id", "group_id"], ["ord", "state"], "t_groups"),
    sql("group", ["f.scope_id", "concat('new', f.entity_id)"], ["last + row_number() OVER (PARTITION BY f.scope_id ORDER BY f.tx)", "'PENDING'"], "f JOIN (SELECT scope_id, max(ord) AS last FROM t_groups GROUP BY scope_id) m ON m.scope_id = f.scope_id"),
    before="f AS (SELECT r.scope_id, r.entity_id, min(CAST(r.entity_id AS BIGINT) * 10 + length(r.entity_type)) AS tx FROM t_records r LEFT JOIN t_groups g ON g.group_id = r.group_id WHERE coalesce(g.state, '-') NOT IN ('PENDING', 'IN_FLIGHT') GROUP BY r.scope_id, r.entity_id)",
)
def edits_queued(spark, sf):
    """Every entity edited: on the wire or pending it keeps its group, else the edits of a user's transaction get a new group at the end."""
    records, groups = table(spark, sf, "records"), table(spark, sf, "groups")
    user = F.col("entity_id").cast("long")
    states = groups.select("group_id", F.col("state").alias("_s"))
    loose = records.join(states, "group_id", "left").withColumn("_free", ~F.coalesce(F.col("_s"), F.lit("-")).isin("PENDING", "IN_FLIGHT"))
    marks = loose.select(*ENTITY, F.when(F.col("_free"), user * 2 + 1000000).otherwise(F.xxhash64(*ENTITY).bitwiseAND(F.lit((1 << 40) - 1)) * 2 + 1).alias("tx"), F.lit("DELETE").alias("intent"))
    generations = records.select(*COLLECTION).distinct().withColumn("generation", F.lit(1).cast("long"))
    after, queue = outbox.queued(marks, records, groups, generations, F.concat(F.lit("new"), F.col("component").cast("string")))
    # The new groups' ids follow hashes of components; the result names them by the user whose edits they hold.
    fresh = after.join(queue.join(groups.select("group_id"), "group_id", "left_anti").select("group_id"), "group_id", "left_semi").groupBy("group_id").agg(F.min("entity_id").alias("_e"))
    named = lambda df: df.join(fresh, "group_id", "left").withColumn("group_id", F.when(F.col("_e").isNotNull(), F.concat(F.lit("new"), "_e")).otherwise(F.col("group_id")))
    return union(flat(named(after), "record", _E, ["local_rev", "intent", "group_id"]), flat(named(queue), "group", ["scope_id", "group_id"], ["ord", "state"]))


# -- reconciling


@query(
    sql("replica", ["scope_id", "collection_id"], ["CASE kind WHEN 'CursorTooOld' THEN 'RESYNC_REQUIRED' WHEN 'CollectionReset' THEN 'NEW' ELSE phase END", "CASE WHEN kind = 'CollectionReset' THEN NULL ELSE cursor END", "CASE WHEN kind = 'CollectionReset' THEN NULL ELSE epoch END", "CASE WHEN kind = 'CollectionReset' THEN NULL WHEN kind IS NOT NULL THEN 'm' ELSE last_error END", "CASE WHEN kind = 'CollectionReset' THEN 0 WHEN kind = 'Offline' THEN failure_count + 1 ELSE failure_count END"], "k"),
    sql("schema", ["scope_id", "collection_id"], ["CASE WHEN generation = 2 THEN phase ELSE 'RESYNC_REQUIRED' END", "'f9'"], "t_replicas"),
    sql("needs", ["scope_id", "collection_id"], ["phase IN ('NEW', 'BOOTSTRAPPING', 'RESYNC_REQUIRED') OR cursor IS NULL"], "t_replicas"),
    before="k AS (SELECT *, CASE generation WHEN 0 THEN 'CursorTooOld' WHEN 1 THEN 'CollectionReset' WHEN 2 THEN 'Offline' END AS kind FROM t_replicas)",
)
def pull_failures(spark, sf):
    """Collections after failures of a pull, after the application's schema changed, and whether they need a snapshot."""
    own = table(spark, sf, "replicas")
    kind = F.element_at(F.array(F.lit("CursorTooOld"), F.lit("CollectionReset"), F.lit("Offline")), F.col("generation").cast("int") + 1)
    lost = own.where("generation < 3").select(*COLLECTION, kind.alias("kind"), F.lit("m").alias("message"))
    schema = replica.schema_reconciled(own.withColumn("schema_fingerprint", F.when(F.col("generation") == 2, F.lit("f9")).otherwise(F.col("schema_fingerprint"))), F.lit("f9"))
    after = replica.failed_pull(own, lost)
    return union(flat(after, "replica", COLLECTION, ["phase", "cursor", "epoch", "last_error", "failure_count"]), flat(schema, "schema", COLLECTION, ["phase", "schema_fingerprint"]), flat(replica.needs_bootstrap(own), "needs", COLLECTION, ["needs_bootstrap"]))


@query(sql("op", ["event_id"], ["CASE WHEN event_id % 5 = 0 THEN 'unknown' ELSE op END", "entity_type", "entity_id", "seq", "CASE WHEN event_id % 5 = 0 THEN concat('{\"op\":\"move\",\"entity\":\"', entity_type, '\",\"id\":\"', entity_id, '\",\"version\":\"', CAST(seq AS VARCHAR), '\",\"data\":{\"k\":', CAST(k AS VARCHAR), '}}') WHEN op = 'upsert' THEN concat('{\"k\":', CAST(k AS VARCHAR), '}') END"], "v_log"))
def operations_decoded(spark, sf):
    """Operations from their wire JSON; unknown tags keep their raw text."""
    tag = F.when(F.col("event_id") % 5 == 0, "move").otherwise(F.col("op"))
    raw = F.concat(F.lit('{"op":"'), tag, F.lit('","entity":"'), "entity_type", F.lit('","id":"'), "entity_id", F.lit('","version":"'), F.col("seq").cast("string"), F.lit('","data":{"k":'), F.col("k").cast("string"), F.lit("}}"))
    rows = view(spark, sf, "v_log").select("event_id", replica.decoded(raw).alias("o")).select("event_id", "o.*")
    return flat(rows, "op", ["event_id"], ["op", "entity_type", "entity_id", "version", "payload"])


@query(
    sql("batch", ["scope_id", "seq"], ["cursor", "n + row_number() OVER (PARTITION BY scope_id ORDER BY CAST(seq AS BIGINT))", "'PENDING'"], "(SELECT t.*, m.n FROM t_inbox_batches t JOIN (SELECT scope_id, max(received_ord) AS n FROM t_inbox_batches GROUP BY scope_id) m ON m.scope_id = t.scope_id) b"),
    sql("unknown", ["scope_id"], ["1"], "(SELECT DISTINCT scope_id FROM t_inbox_ops WHERE ordinal = 3) u"),
)
def inbox_received(spark, sf):
    """Batches received after those that stand in the inbox, and collections with an operation that a replica doesn't know."""
    own = table(spark, sf, "inbox_batches")
    have = own.groupBy(*COLLECTION).agg(F.max("received_ord").alias("n"))
    ops = table(spark, sf, "inbox_ops").withColumn("op", F.when(F.col("ordinal") == 3, "move").otherwise(F.col("op")))
    return union(flat(replica.inbox_rows(own.drop("received_ord", "state"), have), "batch", ["scope_id", "seq"], ["cursor", "received_ord", "state"]), flat(replica.unknown_operations(ops).withColumn("one", F.lit(1)), "unknown", ["scope_id"], ["one"]))


@query(
    sql("record", _own("r", _E), _own("r", _RV, server_version="CASE WHEN a THEN 'v8' ELSE r.server_version END", seen_gen="CASE WHEN a THEN 4 ELSE r.seen_gen END"), "(SELECT *, NOT (local_rev > acked_rev) OR CAST(entity_id AS BIGINT) % 5 = 1 AS a FROM t_records) r"),
    sql("record", ["scope_id", "'fresh'", "scope_id"], ["'v8'", "0", "0", "0", "NULL", "NULL", "NULL", "4"], "(SELECT DISTINCT scope_id FROM t_records) f"),
)
def versions_taken(spark, sf):
    """Records after classified changes: clean, untracked and own ones take the version, conflicting ones keep theirs."""
    records = table(spark, sf, "records")
    fresh = records.select(*COLLECTION).distinct().select(*COLLECTION, F.lit("fresh").alias("entity_type"), F.col("scope_id").alias("entity_id"), F.lit("other").alias("origin_client_id"))
    client = F.when(F.col("entity_id").cast("long") % 5 == 1, "me").otherwise("other")
    ops = records.select(*ENTITY, client.alias("origin_client_id")).unionByName(fresh).withColumns({"version": F.lit("v8"), "op": F.lit("upsert"), "payload": F.lit("{}")})
    return flat(replica.with_versions(records, replica.classified(ops, records, "me"), F.lit(4)), "record", _E, _RV)


_K = "CASE CAST(r.entity_id AS BIGINT) % 4 WHEN 0 THEN 'keep_local' WHEN 1 THEN 'take_server' WHEN 2 THEN 'merged' END"


@query(
    sql("record", _own("r", _E), _own("r", _RV, server_version="CASE WHEN d IS NOT NULL THEN concat('v', r.entity_id) ELSE r.server_version END", acked_rev="CASE WHEN d = 'take_server' THEN r.local_rev ELSE r.acked_rev END", local_rev="CASE WHEN d IN ('keep_local', 'merged') THEN r.local_rev + 1 ELSE r.local_rev END", intent="CASE WHEN d = 'merged' THEN 'UPSERT' WHEN d = 'keep_local' THEN CASE WHEN r.seen_gen = 0 THEN 'DELETE' ELSE 'UPSERT' END WHEN d = 'take_server' THEN NULL ELSE r.intent END", group_id="CASE WHEN d = 'take_server' THEN NULL ELSE r.group_id END", conflict_id="CASE WHEN d IS NULL THEN r.conflict_id END"), "r"),
    sql("open", ["scope_id", "conflict_id"], ["1"], "r WHERE conflict_id IS NOT NULL AND d IS NULL"),
    sql("op", _E, ["CASE WHEN d = 'take_server' AND local_rev = 2 THEN 'delete' ELSE 'upsert' END", "CASE WHEN d = 'merged' THEN 'both' WHEN local_rev <> 2 THEN 'theirs' END"], "r WHERE d IN ('take_server', 'merged')"),
    before=f"r AS (SELECT r.*, CASE WHEN conflict_id IS NOT NULL THEN {_K} END AS d FROM t_records r)",
)
def conflicts_resolved(spark, sf):
    """Conflicts kept, taken from the server, merged or left open: records, open conflicts, operations for the application."""
    records = table(spark, sf, "records")
    open_ = records.where("conflict_id is not null")
    conflicts = shaped(open_.select("conflict_id", *ENTITY, F.when(F.col("seen_gen") == 1, "mine").alias("local_payload"), F.when(F.col("local_rev") != 2, "theirs").alias("server_payload"), F.concat(F.lit("v"), "entity_id").alias("server_version")), REPLICA_TABLES["conflicts"])
    k = F.col("entity_id").cast("long") % 4
    decisions = open_.where(k < 3).select("conflict_id", F.element_at(F.array(F.lit("keep_local"), F.lit("take_server"), F.lit("merged")), k.cast("int") + 1).alias("resolution"), F.lit("both").alias("data"))
    left, after, ops = replica.resolved(conflicts, records, decisions)
    return union(flat(after, "record", _E, _RV), flat(left.withColumn("one", F.lit(1)), "open", ["scope_id", "conflict_id"], ["one"]), flat(ops, "op", _E, ["op", "payload"]))


@query(
    sql("group", ["scope_id", "CASE WHEN settled THEN concat('n', group_id) ELSE group_id END"], ["ord", *[f"CASE WHEN settled THEN {v} ELSE {c} END" for c, v in (("state", "'PENDING'"), ("attempts", "0"), ("next_retry_at", "NULL"), ("dependency_merges", "0"), ("last_error", "NULL"), ("reject_code", "NULL"), ("reject_entity_type", "NULL"), ("reject_entity_id", "NULL"))]], "g WHERE NOT settled OR edited"),
    sql("record", _own("r", _E), _own("r", _RV, conflict_id="NULL", group_id="CASE WHEN g.settled AND g.edited THEN concat('n', r.group_id) ELSE r.group_id END"), "t_records r LEFT JOIN g ON g.group_id = r.group_id"),
    before="g AS (SELECT *, state = 'CONFLICTED' AS settled, EXISTS (SELECT 1 FROM t_records r WHERE r.group_id = t_groups.group_id AND r.local_rev > r.acked_rev) AS edited FROM t_groups)",
)
def groups_revived(spark, sf):
    """Once no conflict is open, conflicted groups go out again under a new id, or end when nothing is edited."""
    records = table(spark, sf, "records").withColumn("conflict_id", F.lit(None).cast("string"))
    return _state(*replica.revived(table(spark, sf, "groups"), records, F.concat(F.lit("n"), "group_id")))


# -- files of the replica

_FV = ["state", "wanted", "attempts", "next_retry_at", "last_error", "transferred"]


@query(
    sql("file", ["scope_id", "blob_id"], ["state", "wanted OR EXISTS (SELECT 1 FROM t_file_refs r WHERE r.scope_id = f.scope_id AND r.blob_id = f.blob_id AND r.fetch = 'EAGER')"], "t_files f WHERE EXISTS (SELECT 1 FROM t_file_refs r WHERE r.scope_id = f.scope_id AND r.blob_id = f.blob_id) OR CAST(blob_id AS BIGINT) % 2 = 1"),
    sql("file", ["scope_id", "blob_id"], ["CASE WHEN CAST(blob_id AS BIGINT) % 2 = 0 THEN 'LOCAL' ELSE 'REMOTE' END", "CAST(blob_id AS BIGINT) % 2 = 0 OR eager"], "(SELECT scope_id, blob_id, max(CASE WHEN r.fetch = 'EAGER' THEN 1 ELSE 0 END) = 1 AS eager FROM t_file_refs r WHERE NOT EXISTS (SELECT 1 FROM t_files f WHERE f.scope_id = r.scope_id AND f.blob_id = r.blob_id) GROUP BY scope_id, blob_id) n"),
)
def files_reconciled(spark, sf):
    """Referenced files are adopted, eager ones wanted, unreferenced ones that the application takes back let go."""
    own, refs = table(spark, sf, "files"), table(spark, sf, "file_refs")
    even = F.col("blob_id").cast("long") % 2 == 0
    return flat(files.reconciled(own, refs, refs.where(even), own.where(even)), "file", ["scope_id", "blob_id"], ["state", "wanted"])


@query(
    sql("file", ["scope_id", "blob_id"], ["CASE o WHEN 'uploaded' THEN 'UPLOADED' WHEN 'downloaded' THEN 'READY' WHEN 'refused' THEN 'REFUSED' WHEN 'lost' THEN 'UNAVAILABLE' WHEN 'error' THEN CASE WHEN attempts + 1 >= 3 THEN 'UNAVAILABLE' ELSE state END ELSE state END", "wanted", "CASE WHEN o IN ('uploaded', 'downloaded') THEN 0 WHEN o = 'error' THEN attempts + 1 ELSE attempts END", f"CASE WHEN o = 'not_ready' THEN {_NOW} + 60000 WHEN o = 'error' AND attempts + 1 < 3 THEN {_NOW} + {_WAIT} WHEN o IS NULL THEN next_retry_at END", "CASE WHEN o IN ('uploaded', 'downloaded') THEN NULL WHEN o IS NOT NULL THEN 'm' ELSE last_error END", "CASE WHEN o IS NULL THEN transferred ELSE 0 END"], "f"),
    before="f AS (SELECT *, CASE CAST(blob_id AS BIGINT) % 7 WHEN 0 THEN 'uploaded' WHEN 1 THEN 'downloaded' WHEN 2 THEN 'refused' WHEN 3 THEN 'lost' WHEN 4 THEN 'not_ready' WHEN 5 THEN 'error' END AS o FROM t_files)",
)
def file_transfers(spark, sf):
    """Files after transfers of every outcome; the third error gives up."""
    own = table(spark, sf, "files")
    kinds = F.array(*map(F.lit, ("uploaded", "downloaded", "refused", "lost", "not_ready", "error")))
    events = own.where(F.col("blob_id").cast("long") % 7 < 6).select(*BLOB, F.element_at(kinds, (F.col("blob_id").cast("long") % 7).cast("int") + 1).alias("outcome"), F.lit("m").alias("message"))
    return flat(files.transferred(own, events, _NOW, 3), "file", ["scope_id", "blob_id"], _FV)


_ASKED = "CAST(blob_id AS BIGINT) % 3 = 0"
_MOVES = "state IN ('LOCAL', 'UPLOADING', 'REMOTE', 'DOWNLOADING')"


@query(sql("file", ["scope_id", "blob_id"], [f"CASE WHEN {_ASKED} AND state IN ('UNAVAILABLE', 'REFUSED') THEN CASE WHEN CAST(blob_id AS BIGINT) % 2 = 0 THEN 'LOCAL' ELSE 'REMOTE' END ELSE state END", f"wanted OR ({_ASKED} AND state IN ('UNAVAILABLE', 'REFUSED'))", *[f"CASE WHEN {_ASKED} AND ({_MOVES} OR state IN ('UNAVAILABLE', 'REFUSED')) THEN {v} ELSE {c} END" for c, v in (("attempts", "0"), ("next_retry_at", "NULL"), ("last_error", "NULL"))], "transferred"], "t_files"))
def file_retry(spark, sf):
    """Files asked to be tried again: given up ones start over, moving ones lose their waits, done ones stay."""
    own = table(spark, sf, "files").withColumn("state", F.col("state"))
    n = F.col("blob_id").cast("long")
    return flat(files.retried(own, own.where(n % 3 == 0).select(*BLOB, (n % 2 == 0).alias("held"))), "file", ["scope_id", "blob_id"], _FV)


@query(
    sql("evicted", ["scope_id", "blob_id"], [f"CASE WHEN {_ASKED} AND state IN ('READY', 'UPLOADED') THEN 'REMOTE' ELSE state END", f"wanted AND NOT ({_ASKED} AND state IN ('READY', 'UPLOADED'))"], "t_files"),
    sql("erased", ["scope_id", "blob_id"], ["1"], "t_files WHERE scope_id <> 's3'"), sql("erased_ref", ["scope_id", "entity_id", "blob_id"], ["1"], "t_file_refs WHERE scope_id <> 's3'"),
)
def file_evict(spark, sf):
    """Files whose bytes were given up, and what stands after a scope's files are erased."""
    own, refs, one = table(spark, sf, "files"), table(spark, sf, "file_refs"), F.lit(1)
    kept, left = files.erased(own, refs, F.col("scope_id") == "s3")
    return union(flat(files.evicted(own, own.where(F.col("blob_id").cast("long") % 3 == 0).select(*BLOB)), "evicted", ["scope_id", "blob_id"], ["state", "wanted"]), flat(kept.withColumn("one", one), "erased", ["scope_id", "blob_id"], ["one"]), flat(left.withColumn("one", one), "erased_ref", ["scope_id", "entity_id", "blob_id"], ["one"]))


@query(
    sql("file", ["scope_id", "blob_id"], ["CASE WHEN r AND state = 'UNAVAILABLE' THEN 'REMOTE' ELSE state END", "wanted OR r", "CASE WHEN r AND state = 'UNAVAILABLE' THEN 0 ELSE attempts END"], "(SELECT f.*, EXISTS (SELECT 1 FROM t_file_refs r WHERE r.scope_id = f.scope_id AND r.blob_id = f.blob_id) AS r FROM t_files f) f"),
    sql("file", ["scope_id", "blob_id"], ["'REMOTE'", "TRUE", "0"], "(SELECT DISTINCT scope_id, blob_id FROM t_file_refs r WHERE NOT EXISTS (SELECT 1 FROM t_files f WHERE f.scope_id = r.scope_id AND f.blob_id = r.blob_id)) n"),
    sql("named", ["scope_id", "blob_id"], ["EXISTS (SELECT 1 FROM t_file_refs r WHERE r.scope_id = f.scope_id AND r.blob_id = f.blob_id)"], "t_files f"),
)
def file_request(spark, sf):
    """Requests for the bytes of all files: those that no document names are ignored, untracked ones adopted; and which files are referenced."""
    own, refs = table(spark, sf, "files"), table(spark, sf, "file_refs")
    asked = own.select(*BLOB).union(refs.select(*BLOB)).distinct().withColumn("held", F.lit(False))
    return union(flat(files.requested(own, refs, asked), "file", ["scope_id", "blob_id"], ["state", "wanted", "attempts"]), flat(files.with_references(own, refs), "named", ["scope_id", "blob_id"], ["referenced"]))


@query(
    sql("ref", ["scope_id", "entity_id", "blob_id"], ["binding", "r.fetch", "seen_gen"], "t_file_refs r WHERE CAST(entity_id AS BIGINT) % 3 <> 0"),
    sql("ref", ["scope_id", "entity_id", "blob_id"], ["'DEFERRED'", "r.fetch", "7"], "t_file_refs r WHERE CAST(entity_id AS BIGINT) % 6 = 0"),
    sql("ref", ["scope_id", "entity_id", "'new'"], ["'REQUIRED'", "'EAGER'", "7"], "t_file_refs r WHERE CAST(entity_id AS BIGINT) % 6 = 0"),
    sql("swept", ["scope_id", "entity_id", "blob_id"], ["seen_gen"], "t_file_refs WHERE seen_gen >= 1"),
)
def refs_declared(spark, sf):
    """References after documents were written (kept ones keep how they are fetched, deletions clear), and after a sweep."""
    refs = table(spark, sf, "file_refs")
    n = F.col("entity_id").cast("long")
    listed = F.array(F.struct(F.col("blob_id"), F.lit("DEFERRED").alias("binding")), F.struct(F.lit("new").alias("blob_id"), F.lit("REQUIRED").alias("binding")))
    documents = refs.where(n % 3 == 0).select(*ENTITY, F.when(n % 6 == 0, listed).alias("files"))
    after = files.declared(refs, documents, F.lit(7), F.lit("EAGER"))
    generations = refs.select(*COLLECTION).distinct().withColumn("generation", F.lit(1).cast("long"))
    key = ["scope_id", "entity_id", "blob_id"]
    return union(flat(after, "ref", key, ["binding", "fetch", "seen_gen"]), flat(files.swept(refs, generations), "swept", key, ["seen_gen"]))


# -- what a host is told


@query(
    sql("state", ["c.scope_id"], ["CASE WHEN c.phase = 'LIVE' AND coalesce(n, 0) >= 100 THEN 'NEEDS_ATTENTION' ELSE c.phase END", "coalesce(p, 0)", "coalesce(n, 0)", "coalesce(up, 0)", "coalesce(down, 0)", "last_error"], "(SELECT scope_id, arg_min(phase, collection_id) AS phase, arg_min(coalesce(last_error, '-'), collection_id) AS last_error FROM t_replicas GROUP BY scope_id) c LEFT JOIN (SELECT scope_id, count(*) FILTER (local_rev > acked_rev) AS p FROM t_records GROUP BY scope_id) r ON r.scope_id = c.scope_id LEFT JOIN (SELECT scope_id, count(*) AS n FROM t_conflicts GROUP BY scope_id) x ON x.scope_id = c.scope_id LEFT JOIN (SELECT scope_id, count(*) FILTER (state IN ('LOCAL', 'UPLOADING')) AS up, count(*) FILTER (state IN ('REMOTE', 'DOWNLOADING')) AS down FROM t_files f WHERE wanted AND EXISTS (SELECT 1 FROM t_file_refs q WHERE q.scope_id = f.scope_id AND q.blob_id = f.blob_id) GROUP BY scope_id) f ON f.scope_id = c.scope_id"),
    sql("scope", ["scope_id"], ["count(*) FILTER (local_rev > acked_rev)"], "t_records GROUP BY scope_id"),
)
def collection_states(spark, sf):
    """Phase as published, pending edits, conflicts, transfers and last error of each collection; pending edits of each scope."""
    own = table(spark, sf, "replicas").groupBy("scope_id").agg(F.min_by("phase", "collection_id").alias("phase"), F.min_by(F.coalesce("last_error", F.lit("-")), "collection_id").alias("last_error"), F.min("failure_count").alias("failure_count")).withColumn("collection_id", F.lit("ledger"))
    place = lambda name: table(spark, sf, name).withColumn("collection_id", F.lit("ledger"))
    out = diagnostics.states(own, table(spark, sf, "records"), table(spark, sf, "conflicts"), place("files"), place("file_refs"), 100)
    return union(flat(out, "state", ["scope_id"], ["phase", "pending", "conflicts", "uploads", "downloads", "last_error"]), flat(diagnostics.pending_of_scopes(table(spark, sf, "records")), "scope", ["scope_id"], ["pending"]))


@query(
    sql("queue", ["g.scope_id", "g.group_id"], ["ord", "coalesce(n, 0)"], "t_groups g LEFT JOIN (SELECT group_id, count(*) AS n FROM t_records WHERE local_rev > acked_rev GROUP BY group_id) r ON r.group_id = g.group_id"),
    sql("refused", ["scope_id", "group_id"], ["ord", "last_error"], "t_groups WHERE state = 'FAILED'"),
    sql("blocked", ["scope_id"], ["arg_min(state, ord)"], "t_groups GROUP BY scope_id HAVING arg_min(state, ord) IN ('CONFLICTED', 'FAILED') AND scope_id <> 's0'"),
    sql("answers", ["scope_id", "state"], ["count(*)"], "t_groups GROUP BY scope_id, state"),
)
def queue_report(spark, sf):
    """The queue with its operations, refused groups, queues newly blocked since scope s0 was, and answers by kind."""
    groups = table(spark, sf, "groups")
    status = diagnostics.queue_status(groups, table(spark, sf, "files"))
    edges = diagnostics.newly_blocked(status.where("scope_id = 's0'"), status)
    outcomes = diagnostics.push_outcomes(groups.withColumnRenamed("state", "status"))
    return union(flat(diagnostics.queue(groups, table(spark, sf, "records")), "queue", ["scope_id", "group_id"], ["ord", "operations"]), flat(diagnostics.refusals(groups), "refused", ["scope_id", "group_id"], ["ord", "last_error"]), flat(edges, "blocked", ["scope_id"], ["head_state"]), flat(outcomes, "answers", ["scope_id", "status"], ["groups"]))


@query(sql("event", ["event_id"], ["entity_type"], "(SELECT * FROM v_log ORDER BY event_id DESC LIMIT 500) l"))
def last_events(spark, sf):
    """The last 500 events, as a ring buffer holds them."""
    return flat(diagnostics.latest(view(spark, sf, "v_log"), "event_id", 500), "event", ["event_id"], ["entity_type"])


@query(
    sql("rejected", ["scope_id", "group_id"], ["CASE WHEN n > 3 THEN 'TOO_LARGE' WHEN d < n THEN 'VALIDATION' ELSE 'TOO_LARGE' END"], "(SELECT scope_id, user_id, concat('u', CAST(user_id AS VARCHAR), '-', CAST(b AS VARCHAR)) AS group_id, count(*) AS n, count(DISTINCT entity_type) AS d, max(k) AS k FROM (SELECT *, event_id // 100 AS b FROM v_log) l GROUP BY ALL) g WHERE n > 3 OR d < n OR k > 90"),
)
def group_refusals(spark, sf):
    """Groups refused for too many operations, an entity named twice, or a document that is too large, in this order."""
    op = F.struct(F.lit("upsert").alias("op"), "entity_type", "entity_id", F.lit(None).cast("string").alias("base_version"), F.repeat(F.lit("x"), F.col("k").cast("int")).alias("data"), F.lit(None).cast("array<string>").alias("blobs"))
    rows = view(spark, sf, "v_log").withColumn("group_id", F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("-"), F.floor(F.col("event_id") / 100).cast("string")))
    groups = rows.groupBy(*COLLECTION, "client_id", "group_id").agg(F.collect_list(op).alias("ops"), F.min("event_id").alias("arrival"))
    allowed = rows.select("collection_id", "entity_type").distinct()
    none = view(spark, sf, "v_ref").where("false")
    return flat(log_write.rejections(groups, allowed, none, none, log_write.Limits(operations=3, document_bytes=90)), "rejected", ["scope_id", "group_id"], ["code"])


@query(
    sql("head", ["scope_id"], ["""concat('{"type":"invalidate","collection":"', collection_id, '","latestSeq":"', CAST(max(seq) AS VARCHAR), '"}')"""], "v_log GROUP BY scope_id, collection_id"),
    sql("ready", ["scope_id", "blob_id"], ["""concat('{"type":"blobReady","collection":"', collection_id, '","blobId":"', blob_id, '"}')"""], "v_blob WHERE state = 'READY'"),
    sql("asked", ["scope_id", "entity_id"], ["CASE max(CASE WHEN event_id % 11 = 0 THEN 2 WHEN event_id % 11 < 6 THEN 0 ELSE 1 END) WHEN 2 THEN 'bootstrap' WHEN 1 THEN 'cycle' ELSE 'transfer' END"], "v_log GROUP BY scope_id, entity_id"),
)
def notices(spark, sf):
    """Notices of heads and of ready files as texts, and the strongest action that texts about each user's collection ask for."""
    log = view(spark, sf, "v_log")
    heads, ready = events.invalidations(log), events.files_ready(view(spark, sf, "v_blob").where("state = 'READY'"))
    kind = F.when(F.col("event_id") % 11 == 0, events.RESYNC).when(F.col("event_id") % 11 < 6, events.BLOB_READY).otherwise(events.INVALIDATE)
    text = F.to_json(F.struct(kind.alias("type"), F.col("entity_id").alias("collection")))
    asked = events.asked(events.decoded(log.select("scope_id", text.alias("raw"))), log.select("scope_id", F.col("entity_id").alias("collection_id")))
    return union(flat(heads, "head", ["scope_id"], ["raw"]), flat(ready, "ready", ["scope_id", "blob_id"], ["raw"]), flat(asked, "asked", COLLECTION, ["action"]))
