"""Replicas: statements, queueing by components, convergence of two clients, files."""

import json

import pytest
from pyspark.sql import functions as F

from test_engine import Clock
from tidelog.errors import PendingChanges
from tidelog.operators import files, outbox, replica, statements
from tidelog.plans import operator_queries, queries
from tidelog.plans.engine import CollectionSpec, LogEngine, log_store
from tidelog.plans.replica import Adapter, Replica, replica_store
from tidelog.plans.synthetic import view
from tidelog.schema import ENTITY, REPLICA_TABLES, shaped

K = {"scope_id": "u", "collection_id": "l"}


def record(spark, *rows):
    names = ["entity_id", "server_version", "local_rev", "pushing_rev", "acked_rev", "intent", "group_id", "conflict_id", "seen_gen"]
    ddl = "entity_id string, server_version string, local_rev long, pushing_rev long, acked_rev long, intent string, group_id string, conflict_id string, seen_gen long"
    full = [tuple({**dict.fromkeys(names), "local_rev": 0, "pushing_rev": 0, "acked_rev": 0, "seen_gen": 1, **r}.values()) for r in rows]
    return shaped(spark.createDataFrame(full, ddl).withColumns({"scope_id": F.lit("u"), "collection_id": F.lit("l"), "entity_type": F.lit("w")}), REPLICA_TABLES["records"])


def group(spark, *rows):
    full = [(g, o, s, a) for g, o, s, a in rows]
    df = spark.createDataFrame(full, "group_id string, ord long, state string, attempts int").withColumns({"scope_id": F.lit("u"), "collection_id": F.lit("l"), "dependency_merges": F.lit(0)})
    return shaped(df, REPLICA_TABLES["groups"])


def test_every_statement_runs_and_keeps_its_table(spark):
    ddl = REPLICA_TABLES | {"wallet": "id string, title string", "ledger_transaction": "id string, amount long"}
    tables = {name: spark.createDataFrame([], d) for name, d in ddl.items()}
    given = {"scope_id": "u", "collection_id": "l", "entity_type": "w", "entity_id": "a", "blob_id": "b", "group_id": "g", "conflict_id": "x", "seq": "1", "id": "a", "state": "PENDING", "ord": 1, "now": 5, "limit": 2, "generation": 2, "epoch": "e"}
    assert len(statements.STATEMENTS) == 115
    for name, statement in statements.STATEMENTS.items():
        out = statements.run(name, tables, rows=tables[statement.table], **given)
        if not isinstance(statement, statements.Read):
            assert out.dtypes == tables[statement.table].dtypes, name


def test_an_acknowledgement_covers_the_sent_revision_alone(spark):
    tables = {"records": record(spark, {"entity_id": "a", "local_rev": 3, "pushing_rev": 2, "acked_rev": 1, "group_id": "g"}, {"entity_id": "b", "local_rev": 2, "pushing_rev": 2, "acked_rev": 1, "group_id": "g", "intent": "UPSERT"})}
    for e in "ab":
        tables = statements.applied("records.acknowledge", tables, **K, entity_type="w", entity_id=e, server_version="9")
    rows = {r.entity_id: r for r in statements.applied("records.release_clean", tables, group_id="g")["records"].collect()}
    assert (rows["a"].acked_rev, rows["a"].group_id) == (2, "g") and (rows["b"].group_id, rows["b"].intent) == (None, None)
    rows = {r.entity_id: r for r in statements.run("records.abandon_local", tables, **K).collect()}
    assert rows["a"].server_version is None and rows["b"].server_version == "9" and rows["a"].local_rev == rows["a"].acked_rev == 2


def test_edits_join_the_groups_they_touch(spark):
    records = record(spark, {"entity_id": "a", "group_id": "g2"}, {"entity_id": "b", "group_id": "g1"}, {"entity_id": "c", "group_id": "g3"}, {"entity_id": "d", "group_id": "g4"})
    groups = group(spark, ("g1", 1, "PENDING", 0), ("g2", 2, "PENDING", 0), ("g3", 3, "IN_FLIGHT", 0), ("g4", 4, "FAILED", 0), ("g5", 5, "PENDING", 0))
    edits = [(1, "a"), (1, "b"), (1, "c"), (2, "d"), (2, "e"), (3, "e"), (4, "z")]
    marks = spark.createDataFrame([("u", "l", t, "w", e, "UPSERT") for t, e in edits], "scope_id string, collection_id string, tx long, entity_type string, entity_id string, intent string")
    generations = spark.createDataFrame([("u", "l", 7)], "scope_id string, collection_id string, generation long")
    after, queue = outbox.queued(marks, records, groups, generations, F.concat(F.lit("new"), F.col("component").cast("string")))
    of = {r.entity_id: r for r in after.collect()}
    order = {r.group_id: r.ord for r in queue.collect()}
    assert of["a"].group_id == of["b"].group_id == "g1" and "g2" not in order and of["c"].group_id == "g3"
    assert of["d"].group_id == of["e"].group_id and order[of["d"].group_id] == 6 and order[of["z"].group_id] == 7 and of["z"].seen_gen == 7
    assert of["e"].local_rev == 2 and of["a"].local_rev == 1


def test_group_components_link_every_change(spark, tmp_path):
    """The registered query over all rows of a log, against union-find."""
    events = [(i, (i * i + i // 3) % 23, ["view", "buy"][i % 2], f'{{"k": {i * 7 % 40}}}', float(i), 1000 + i) for i in range(90)]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string, props string, value double, ts long").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(c, t, "user", "x") for c in range(7) for t in range(2)], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    log, records, groups = (view(spark, str(tmp_path), v).collect() for v in ("v_log", "v_record", "v_group"))
    entity = lambda r: (r.scope_id, r.collection_id, r.entity_type, r.entity_id)
    group_of, state = {entity(r): r.group_id for r in records}, {g.group_id: g.state for g in groups}
    root, nodes = {}, set()

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for r in log:
        held = group_of.get(entity(r))
        if state.get(held) == "IN_FLIGHT":
            continue
        tx = ("tx", str(r.seq), r.scope_id)
        nodes.add(tx)
        root[find(tx)] = find(("entity", *entity(r)))
        if state.get(held) == "PENDING":
            nodes.add(("group", held, r.scope_id))
            root[find(tx)] = find(("group", held))
    want, found = {}, {}
    for kind, i, scope in nodes:
        want.setdefault(find(("group", i) if kind == "group" else (kind, i, scope)), set()).add((kind, i, scope))
    rows = queries.QUERIES["group_components"](spark, str(tmp_path)).collect()
    for r in rows:
        found.setdefault(r.first_tx, set()).add((r.kind, r.id, r.scope_id))
    assert len(rows) == sum(map(len, want.values())) and sorted(map(sorted, found.values())) == sorted(map(sorted, want.values()))
    assert any(kind == "group" for kind, *_ in nodes) and max(map(len, want.values())) > 2


def test_snapshot_and_conflicts(spark):
    records = record(spark, {"entity_id": "clean", "server_version": "1"}, {"entity_id": "edited", "server_version": "1", "local_rev": 1, "conflict_id": "x1"}, {"entity_id": "based", "server_version": "2", "local_rev": 1})
    items = spark.createDataFrame([("u", "l", "w", e, "2", "{}") for e in ("clean", "edited", "based", "new")], "scope_id string, collection_id string, entity_type string, entity_id string, version string, payload string")
    actions = replica.classified_snapshot(items, records)
    assert {r.entity_id: r.action for r in actions.collect()} == {"clean": "apply", "edited": "conflict", "based": "version_only", "new": "apply"}
    after = {r.entity_id: r for r in replica.with_versions(records, actions, F.lit(5)).collect()}
    assert after["new"].seen_gen == 5 and after["clean"].server_version == "2" and after["edited"].server_version == "1"
    held = shaped(spark.createDataFrame([("x1", "u", "l", "w", "edited")], "conflict_id string, scope_id string, collection_id string, entity_type string, entity_id string"), REPLICA_TABLES["conflicts"])
    found = actions.where("action = 'conflict'").select(*ENTITY, F.lit('{"mine":1}').alias("local_payload"), F.col("payload").alias("server_payload"), F.col("version").alias("server_version"))
    conflicts, marked = replica.opened(held, records, found, "PULL", 1, F.lit("fresh"))
    assert [(r.conflict_id, r.server_version) for r in conflicts.collect()] == [("x1", "2")]
    take = spark.createDataFrame([("x1", "take_server", None)], "conflict_id string, resolution string, data string")
    left, rows, ops = replica.resolved(conflicts, marked, take)
    assert left.count() == 0 and [(o.op, o.payload) for o in ops.collect()] == [("upsert", "{}")]
    assert {r.entity_id: (r.server_version, r.acked_rev) for r in rows.collect()}["edited"] == ("2", 1)


def test_groups_larger_than_any_row_are_listed_and_sized(spark, tmp_path):
    """54 documents of 40 MB in one group, more than a row can hold; a document's length is its user's number."""
    users = [28 * (1_430_000 + n) + 1 for n in range(54)] + [8, 9, 41]
    rows = [(n, u, "view", '{"k": 6}') for n, u in enumerate(users)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, props string").withColumns({"ts": F.timestamp_seconds(F.lit(0)), "value": F.lit(1.0)}).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    out = {(r.what, r.name): r.value for r in operator_queries.QUERIES["group_envelopes"](spark, str(tmp_path)).collect()}
    assert out.pop(("ops", "s1/g1")) == "54/0/" + ",".join(f"view.{u}" for u in users[:54])
    assert out == {("ops", "s0/g1"): "1/1/view.8", ("ops", "s1/g2"): "1/0/view.9", ("ops", "s1/g6"): "1/0/view.41", ("large", "s1/g1"): "operations", ("large", "s1/g6"): "document"}


def test_dependency_refusals_merge_wait_and_fail(spark):
    groups = group(spark, ("g1", 1, "IN_FLIGHT", 0), ("g2", 2, "PENDING", 0))
    records = record(spark, {"entity_id": "a", "group_id": "g1", "local_rev": 1}, {"entity_id": "b", "group_id": "g2", "local_rev": 1})
    no = spark.createDataFrame([("g1", "needs another")], "group_id string, message string")
    out, moved, outcome = outbox.merged_after_dependency(groups, records, no, 1000, F.lit("m"))
    assert [(r.group_id, r.ord, r.dependency_merges) for r in out.collect()] == [("m", 1, 1)] and {r.group_id for r in moved.collect()} == {"m"}
    out, _, outcome = outbox.merged_after_dependency(groups.where("ord = 1"), records, no, 1000, F.lit("m"))
    assert [(r.group_id, r.state, r.attempts, r.next_retry_at) for r in out.collect()] == [("m", "PENDING", 1, 2000)]
    out, _, outcome = outbox.merged_after_dependency(groups.withColumn("dependency_merges", F.lit(8)), records, no, 1000, F.lit("m"))
    assert {r.group_id: r.state for r in out.collect()}["g1"] == "FAILED" and outcome.first().outcome == "failed"


def test_files_are_adopted_moved_and_given_up(spark):
    refs = shaped(spark.createDataFrame([("u", "l", "w", "a", b, "REQUIRED", "EAGER") for b in ("b1", "b2")], "scope_id string, collection_id string, entity_type string, entity_id string, blob_id string, binding string, fetch string"), REPLICA_TABLES["file_refs"])
    held = spark.createDataFrame([("u", "l", "b1")], "scope_id string, collection_id string, blob_id string")
    rows = files.promoted(files.adopted(spark.createDataFrame([], REPLICA_TABLES["files"]), refs, held), refs)
    assert {r.blob_id: (r.state, r.wanted) for r in rows.collect()} == {"b1": ("LOCAL", True), "b2": ("REMOTE", True)}
    assert {r.blob_id: r.direction for r in files.next_transfers(rows, refs, 0).collect()} == {"b1": "upload", "b2": "download"}
    event = lambda b, o: spark.createDataFrame([("u", "l", b, o, "why")], "scope_id string, collection_id string, blob_id string, outcome string, message string")
    tired = files.transferred(rows.withColumn("attempts", F.lit(4)), event("b2", "error"), 100)
    assert {r.blob_id: r.state for r in tired.collect()}["b2"] == "UNAVAILABLE"
    waits = {r.blob_id: r for r in files.transferred(rows, event("b2", "error"), 100).collect()}["b2"]
    assert (waits.attempts, waits.next_retry_at) == (1, 1100)
    done = {r.blob_id: r for r in files.transferred(rows, event("b1", "uploaded"), 100).collect()}["b1"]
    assert (done.state, done.last_error) == ("UPLOADED", None)


def test_two_clients_converge(spark, tmp_path):
    clock = Clock()
    log = LogEngine(log_store(spark, str(tmp_path / "log")), [CollectionSpec("l", ("w",))], clock=clock)
    a, b = (Replica(replica_store(spark, str(tmp_path / c)), log, c, clock) for c in "ab")
    a.mutate("u", "l", [("w", "1", '{"n":1}')])
    a.cycle("u", "l")
    b.cycle("u", "l")
    b.mutate("u", "l", [("w", "1", '{"n":2}')])
    a.mutate("u", "l", [("w", "1", '{"n":3}')])
    assert b.push_once("u", "l") == "applied" and a.push_once("u", "l") == "conflict" and a.push_once("u", "l") == "waiting"
    conflict = a.store.read()["conflicts"].first()
    assert json.loads(conflict["server_payload"]) == {"n": 2} and json.loads(conflict["local_payload"]) == {"n": 3}
    a.resolve([(conflict["conflict_id"], "keep_local", None)])
    assert a.push_once("u", "l") == "applied"
    b.pull("u", "l")
    rows = [[json.loads(r["data"]) for r in x.store.read()["documents"].collect()] for x in (a, b)]
    assert rows == [[{"n": 3}], [{"n": 3}]] and b.status().first()["pending"] == 0


def _pair(spark, tmp_path, **options):
    clock = Clock()
    log = LogEngine(log_store(spark, str(tmp_path / "log")), [CollectionSpec("l", ("w",))], clock=clock)
    return clock, log, Replica(replica_store(spark, str(tmp_path / "a")), log, "a", clock, **options)


def test_a_staged_page_survives_a_crash_and_needs_no_log(spark, tmp_path):
    clock, log, a = _pair(spark, tmp_path)
    b = Replica(replica_store(spark, str(tmp_path / "b")), log, None, clock)
    a.cycle("u", "l")
    b.cycle("u", "l")
    for n in (1, 2):
        a.mutate("u", "l", [("w", "1", f'{{"n":{n}}}'), ("w", str(n + 5), "{}")])
        assert a.push_once("u", "l") == "applied"

    def stop(ops):
        raise RuntimeError("killed")

    before = b.store.read()["replicas"].first()["cursor"]
    b.adapter = Adapter(apply_remote=stop)
    with pytest.raises(RuntimeError):
        b.pull("u", "l")
    state = b.store.read()
    assert state["replicas"].first()["cursor"] == before and state["inbox_batches"].count() == 2 and state["documents"].count() == 0
    b.adapter, b.log = Adapter(), None  # the log can't be reached
    with pytest.raises(AttributeError):
        b.pull("u", "l")
    state = b.store.read()
    assert {r.entity_id: r.data for r in state["documents"].collect()} == {"1": '{"n":2}', "6": "{}", "7": "{}"} and state["inbox_batches"].count() == state["inbox_ops"].count() == 0
    row = state["replicas"].first()
    assert row["cursor"].endswith(".2") and row["failure_count"] == 1 and b.client_id("u") == b.client_id("u") != "a"


def test_edited_entities_meet_foreign_and_own_changes_of_one_page(spark, tmp_path):
    clock, log, a = _pair(spark, tmp_path)
    b = Replica(replica_store(spark, str(tmp_path / "b")), log, "b", clock)
    a.mutate("u", "l", [("w", "1", '{"n":1}')])
    a.cycle("u", "l")
    b.cycle("u", "l")
    b.mutate("u", "l", [("w", "1", '{"n":9}')])
    a.mutate("u", "l", [("w", "1", '{"n":2}')])
    a.push_once("u", "l")
    offered = []
    b.adapter = Adapter(resolve=lambda row: offered.append(row) or (None if len(offered) < 2 else ("take_server", None)))
    b.pull("u", "l")
    assert b.offer_conflicts("u", "l") == 0 and b.offer_conflicts("u", "l") == 0 and len(offered) == 1
    b._offered.clear()  # as after a restart
    assert b.offer_conflicts("u", "l") == 1 and b.store.read()["documents"].first()["data"] == '{"n":2}'


def test_a_log_out_of_reach_leaves_the_edits_queued(spark, tmp_path):
    clock, log, a = _pair(spark, tmp_path)
    a.cycle("u", "l")
    a.mutate("u", "l", [("w", "1", "{}")])

    class Away:
        def __getattr__(self, name):
            if name in ("push", "changes", "snapshot"):
                raise ConnectionError("offline")
            return getattr(log, name)

    a.log = Away()
    assert a.push_once("u", "l") == "failed" and a.push_once("u", "l") == "waiting"
    head = a.store.read()["groups"].first()
    assert (head["state"], head["attempts"], head["last_error"]) == ("PENDING", 1, "offline")
    with pytest.raises(ConnectionError):
        a.bootstrap("u", "l")
    a.pause("u")
    a.cycle("u", "l")
    a.resume("u")
    with pytest.raises(PendingChanges):
        a.sign_out("u")
    clock.pass_days(1)
    a.log = log
    assert a.push_once("u", "l") == "applied" and a.push_once("u", "l") == "empty"
    a.sign_out("u")
    assert a.store.read()["records"].count() == 0


def test_a_group_too_large_is_refused_before_it_is_put_together(spark, tmp_path, monkeypatch):
    refused, together = [], []
    whole = outbox.envelopes
    monkeypatch.setattr(outbox, "envelopes", lambda *a: together.append(a) or whole(*a))
    clock, log, a = _pair(spark, tmp_path, adapter=Adapter(on_rejected=refused.append))
    a.cycle("u", "l")
    a.mutate("u", "l", [("w", "1", '{"n":"' + "x" * log.published_limits()["document_bytes"] + '"}')])
    assert a.push_once("u", "l") == "rejected" and [r.reject_code for r in refused] == ["TOO_LARGE"] and together == []


def test_a_group_waits_for_its_files_and_declares_them(spark, tmp_path):
    named = lambda docs: docs.select(*ENTITY, F.array(F.struct(F.get_json_object("data", "$.photo").alias("blob_id"), F.lit("REQUIRED").alias("binding"))).alias("files"))
    outcomes = iter(["error", "uploaded"])
    moved = []

    def move(due):
        moved.append([r.direction for r in due.collect()])
        return due.select("scope_id", "collection_id", "blob_id", F.lit(next(outcomes)).alias("outcome"), F.lit("why").alias("message"))

    refused = []
    clock, log, a = _pair(spark, tmp_path, adapter=Adapter(files=named, held=lambda rows: rows, on_rejected=refused.append), move=move)
    a.cycle("u", "l")
    a.mutate("u", "l", [("w", "1", '{"photo":"p1"}')])
    a.reconcile_files()
    assert a.push_once("u", "l") == "waiting_on_files" and a.move_files() == 1 and a.push_once("u", "l") == "waiting_on_files"
    assert a.next_wake() == a._ms() + 1000 and a.store.read()["files"].first()["state"] == "UPLOADING"
    clock.pass_days(1)
    assert a.move_files() == 1 and moved == [["upload"], ["upload"]]
    log.register(spark.createDataFrame([("u", "l", "p1", "image/png", 5, None)], "scope_id string, collection_id string, blob_id string, content_type string, size long, checksum string"))
    assert a.push_once("u", "l") == "applied" and log.document("u", "l", "w", "1")["blobs"] == ["p1"]
    ids = spark.createDataFrame([("u", "l", "p1", False)], "scope_id string, collection_id string, blob_id string, held boolean")
    a.evict_files(ids)
    assert a.store.read()["files"].first()["state"] == "REMOTE"
    a.request_files(ids)
    assert a.store.read()["files"].first()["wanted"]
    b = Replica(replica_store(spark, str(tmp_path / "b")), log, "b", clock, adapter=Adapter(files=named))
    b.cycle("u", "l")
    assert [(r.blob_id, r.state, r.wanted) for r in b.store.read()["files"].collect()] == [("p1", "REMOTE", True)]
    a.mutate("u", "l", [("x", "1", "{}")])
    a.adapter = Adapter(on_rejected=refused.append)
    assert a.push_once("u", "l") == "rejected" and [r.reject_code for r in refused] == ["UNKNOWN_ENTITY_TYPE"]
    a.remove_files("u")
    assert a.store.read()["files"].count() == 0
