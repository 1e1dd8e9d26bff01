"""The changelog as a stream, its sink, and the stateful sequencer, each stopped and started again."""

import pandas as pd

from test_engine import Log, drop, put
from tidelog.plans.engine import log_store
from tidelog.plans.replica import Replica, replica_store
from tidelog.sources import jdbc
from tidelog.sources.store import VersionedStore
from tidelog.streaming import events
from tidelog.streaming.replica_sink import STATE, follow
from tidelog.streaming.sequencer import sequenced


def test_stream_follows_the_log_and_resumes(spark, tmp_path):
    root = str(tmp_path / "log")
    log, store = Log(spark, root), VersionedStore(spark, str(tmp_path / "copy"), STATE)
    log.push(("g1", [put("a", {"n": 1}), put("b", {})]))
    go = lambda: follow(spark, root, store, str(tmp_path / "check")).awaitTermination()
    go()
    log.push(("g2", [put("a", {"m": 2}, base="1"), drop("b", base="1")]))
    go()
    go()
    rows = {r["entity_id"]: r for r in store.read()["state"].collect()}
    assert rows["a"]["version"] == 2 and '"n":1' in rows["a"]["data"] and rows["b"]["is_deleted"]


def test_sequencer_numbers_densely_and_answers_repeats(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "scope_id string, collection_id string, client_id string, group_id string, arrival long"
    got = {}

    def keep(df, _):
        for r in df.collect():
            got.setdefault((r.scope_id, r.group_id), []).append((r.seq, r.repeated))

    for turn, rows in enumerate([[("s", "g1", 1), ("s", "g2", 2), ("t", "g1", 3)], [("s", "g1", 4), ("s", "g3", 5)]]):
        spark.createDataFrame(pd.DataFrame([(s, "c", "x" + s, g, a) for s, g, a in rows], columns=[c.split()[0] for c in schema.split(", ")]), schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        sequenced(stream).writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
        assert turn in (0, 1)
    assert got == {("s", "g1"): [(1, False), (1, True)], ("s", "g2"): [(2, False)], ("t", "g1"): [(1, False)], ("s", "g3"): [(3, False)]}


def test_notices_become_one_action_a_collection(spark):
    text = [
        ("u", '{"type":"invalidate","collection":"a","latestSeq":"3"}'), ("u", '{"type":"invalidate","collection":"a","latestSeq":"4"}'),
        ("u", '{"type":"blobReady","collection":"a","blobId":"b1"}'), ("u", '{"type":"blobReady","collection":"b","blobId":"b2"}'),
        ("u", '{"type":"resync","collection":"c"}'), ("v", '{"type":"newer","x":1}'), ("w", '{"type":"revoked"}'), ("w", '{"type":"resync","collection":"a"}'),
        ("x", "no json"), ("x", None), ("y", '{"type":"invalidate","collection":"not followed"}'), ("z", "{}"),
    ]
    notices = events.decoded(spark.createDataFrame(text, "scope_id string, raw string"))
    assert notices.schema.simpleString() == spark.createDataFrame([], events.NOTICE).schema.simpleString() and notices.count() == 10
    followed = spark.createDataFrame([("u", c) for c in "abcd"] + [(s, "a") for s in "vwxyz"], "scope_id string, collection_id string")
    got = {(r["scope_id"], r["collection_id"]): r["action"] for r in events.asked(notices, followed).collect()}
    assert got == {("u", "a"): "cycle", ("u", "b"): "transfer", ("u", "c"): "bootstrap", ("v", "a"): "cycle", ("w", "a"): "revoke", ("z", "a"): "cycle"}
    assert events.asked(notices.limit(0), followed).count() == 0 and events.of_scope(notices, "w").count() == 2


def test_a_follower_acts_on_the_notices_of_a_log(spark, tmp_path):
    log = Log(spark, str(tmp_path / "log"))
    log.push(("g1", [put("a", {"n": 1})]))
    replica = Replica(replica_store(spark, str(tmp_path / "copy")), log.engine, "me", log.clock)
    follower = events.Follower(replica, [("u1", "ledger")])
    notices = events.invalidations(log.engine.store.read()["changes"])
    assert [r["raw"] for r in notices.collect()] == ['{"type":"invalidate","collection":"ledger","latestSeq":"1"}']
    follower.handle(notices)
    assert [r["data"] for r in replica.store.read()["documents"].collect()] == ['{"n":1}']
    follower.handle(events.decoded(spark.createDataFrame([("u1", '{"type":"revoked"}')], "scope_id string, raw string")))
    version = replica.store.version()
    follower.handle(notices)
    assert follower.revoked == {"u1"} and replica.store.version() == version


def test_tables_go_to_a_database_and_back(spark, tmp_path):
    log = Log(spark, str(tmp_path / "log"))
    log.push(*[(f"g{n}", [put(f"e{n}", {"n": n})]) for n in range(6)])
    url, driver = f"jdbc:derby:{tmp_path}/db;create=true", "org.apache.derby.jdbc.EmbeddedDriver"
    for _ in range(2):  # the second replaces what the first wrote
        jdbc.exported(log.engine.store, url, prefix="t_", driver=driver)
    back = log_store(spark, str(tmp_path / "back"))
    jdbc.imported(back, url, tasks=3, prefix="t_", driver=driver)
    assert jdbc.table(spark, url, "changes", back.schemas["changes"], 3, "t_", driver=driver).rdd.getNumPartitions() == 3
    for name, rows in log.engine.store.read().items():
        assert sorted(map(str, back.read()[name].collect())) == sorted(map(str, rows.collect())), name
