import pytest
from pyspark.sql import functions as F

from rowstream.config import StreamConfig
from rowstream.operators import catalog, filters, heartbeat, messages, metrics, normalize, positioning, recovery
from rowstream.operators.state import SchemaDump, StateStore
from rowstream.schema import RAW_EVENT, StructType  # noqa: F401

CONFIG = StreamConfig()
FLAT = "kind string, db string, tbl string, log_file string, log_pos long, row_idx int, gtid string, query string, hb_serial long, hb_timestamp long, ts_epoch long, after_image string, before_image string"


def flat(spark, rows):
    names = [c.split()[0] for c in FLAT.split(", ")]
    return spark.createDataFrame([tuple(r.get(n, 0 if n == "row_idx" else None) for n in names) for r in rows], FLAT)


def beat(file, pos, serial=None, time=None, kind="update"):
    return {"kind": kind, "db": "heartbeat", "tbl": "beat", "log_file": file, "log_pos": pos, "hb_serial": serial, "hb_timestamp": time}


def row(file, pos, idx=0, db="shop", tbl="t", kind="write", image='{"id":1}'):
    return {"kind": kind, "db": db, "tbl": tbl, "log_file": file, "log_pos": pos, "row_idx": idx, "ts_epoch": 1, "after_image": image}


def ddl(file, pos, query, db="shop"):
    return {"kind": "query", "db": db, "log_file": file, "log_pos": pos, "query": query}


def test_flatten(spark):
    events = spark.createDataFrame(
        [("update", "c", "d", "t_data_pipeline_refresh", "f", 1, None, 5, None, [(None, "1", "2"), (None, "3", "4")]), ("query", "c", "d", None, "f", 2, None, 5, "BEGIN", None),
         ("write", "c", "d", "t", "f", 3, None, 5, None, []), (None, "c", "d", "t", "f", 4, None, 5, None, None), ("other", "c", "d", "t", "f", 5, None, 5, None, None)],
        RAW_EVENT,
    )
    got = normalize.normalize(events, CONFIG).orderBy("log_pos", "row_idx").collect()
    assert [(r.kind, r.tbl, r.log_pos, r.row_idx, r.message_type) for r in got] == [("update", "t", 1, 0, "refresh"), ("update", "t", 1, 1, "refresh"), ("query", None, 2, 0, None)]
    assert [r.row.after_values for r in got[:2]] == ["2", "4"]


def test_positions_across_files(spark):
    events = flat(spark, [ddl("a", 1, "BEGIN"), beat("a", 2, 1, 10), row("a", 3), row("a", 3, 1), row("b", 1), ddl("c", 1, "BEGIN"), row("c", 2), beat("c", 3, 2, 20), row("c", 4), row("d", 1)])
    got = positioning.assign_positions(events, CONFIG).orderBy("log_file", "log_pos", "row_idx").collect()
    assert [(r.log_file, r.log_pos, r.row_idx, r.position.log_pos, r.position.hb_serial, r.position.offset) for r in got] == [
        ("a", 1, 0, None, None, 0), ("a", 3, 0, 2, 1, 0), ("a", 3, 1, 2, 1, 1), ("b", 1, 0, 2, 1, 2), ("c", 1, 0, 2, 1, 3), ("c", 2, 0, 2, 1, 4), ("c", 4, 0, 3, 2, 0), ("d", 1, 0, 3, 2, 1),
    ]


def test_no_marker_and_empty(spark):
    events = flat(spark, [row("a", 1), row("b", 1), row("b", 2)])
    got = positioning.assign_positions(events, CONFIG).orderBy("log_file", "log_pos").collect()
    assert [(r.position.log_file, r.position.offset) for r in got] == [(None, 0), (None, 1), (None, 2)]
    assert positioning.assign_positions(flat(spark, []), CONFIG).count() == 0


def test_gtid_events_only_count_in_gtid_mode(spark):
    events = flat(spark, [{"kind": "gtid", "gtid": "sid:11", "log_file": "a", "log_pos": 1}, ddl("a", 2, "BEGIN"), row("a", 3), row("a", 3, 1), row("a", 3, 2)])
    got = positioning.assign_positions(events, CONFIG.with_(gtid_enabled=True)).orderBy("log_pos", "row_idx").collect()
    assert [(r.position.gtid, r.position.offset) for r in got] == [("sid:11", i) for i in range(4)]
    assert positioning.assign_positions(events, CONFIG).count() == 4


def test_late_blacklist(spark):
    events = flat(spark, [ddl("a", 1, "ALTER TABLE mysql.x ADD c int", ""), ddl("a", 2, "CREATE TABLE mysql.x (id int)", ""), ddl("a", 3, "CREATE TABLE shop.x (id int)", None), row("a", 4, db="mysql")])
    assert [r.log_pos for r in filters.drop_blacklisted(events, CONFIG).collect()] == [3]
    assert sorted(r.log_pos for r in filters.drop_blacklisted(events, CONFIG.with_(strict_parity=True)).collect()) == [2, 3]
    with pytest.raises(Exception, match="reserved"):
        spark.range(1).select(filters.assert_not_reserved(F.lit("MySQL"))).collect()


def test_versions_never_go_stale(spark):
    events = flat(spark, [ddl("a", 1, "CREATE TABLE t (id int)"), row("a", 2), ddl("a", 3, "ALTER TABLE t ADD x int"), row("a", 4), row("b", 1), ddl("c", 2, "DROP TABLE t"), row("c", 1), row("c", 3), row("d", 9), row("d", 1, tbl="u")])
    versions = catalog.schema_versions(events, CONFIG)
    rows = events.where("kind = 'write'")
    got = {(r.log_file, r.log_pos, r.tbl): r.schema_id for r in catalog.with_schema_version(rows, versions).collect()}
    assert got == {("a", 2, "t"): 1, ("a", 4, "t"): 2, ("b", 1, "t"): 2, ("c", 1, "t"): 2, ("c", 3, "t"): 3, ("d", 9, "t"): 3, ("d", 1, "u"): None}


def test_messages(spark):
    events = positioning.assign_positions(flat(spark, [beat("a", 1, 1, 10), {**row("a", 2, kind="update"), "before_image": '{"id":9}'}, row("a", 3, db="mysql")]), CONFIG)
    m = messages.data_messages(normalize.with_message_type(events), CONFIG).collect()
    assert len(m) == 1 and m[0].previous_payload_data == '{"id":9}' and m[0].topic == "main.source.shop.t"
    assert m[0].meta[0].asDict() == {"cluster_name": "source", "log_file": "a", "log_pos": 1}
    short = messages.data_messages(normalize.with_message_type(events), CONFIG.with_(changelog_mode=True)).first()
    assert short.payload_data == '{"table_schema":"shop","table_name":"t","id":1}'
    bad = positioning.assign_positions(flat(spark, [row("a", 2, image='{"name":1}')]), CONFIG)
    with pytest.raises(Exception, match="needs a column id"):
        messages.data_messages(normalize.with_message_type(bad), CONFIG.with_(changelog_mode=True)).collect()
    secret = messages.encrypt_payload(spark.createDataFrame([("x", True), ("y", False)], "payload_data string, has_pii boolean"), F.lit("0" * 16)).collect()
    assert secret[0].payload_data != "x" and secret[1].payload_data == "y"


def simulated_heartbeats(spark):
    base = 1420099200
    day = 86400
    files = {
        "binlog1": [(0, base), (1, base + day), None],
        "binlog2": [None] * 4,
        "binlog3": [(2, base + 2 * day), None, None, (3, base + 3 * day), (4, base + 4 * day), (5, base + 5 * day), None, (6, base + 5 * day)],
        "binlog4": [None, (7, base + 5 * day), None, (8, base + 5 * day)],
    }
    rows = [beat(f, i, *e) if e else row(f, i) for f, events in files.items() for i, e in enumerate(events)]
    return flat(spark, rows), {(t, s): (f, i) for f, events in files.items() for i, e in enumerate(events) if e for s, t in [e]}


def test_heartbeat_search(spark):
    events, places = simulated_heartbeats(spark)
    for (t, s), place in places.items():
        got = heartbeat.search(events, CONFIG, t, s).collect()
        assert [(r.log_file, r.log_pos) for r in got] == [place]
    for t, s in ((-1, 1420099200), (0, 1420099199), (8, 1420531201), (9, 1420531200)):
        assert heartbeat.search(events, CONFIG, t, s).count() == 0


def test_recovery(spark):
    many = [beat("a", 1, 1, 10), *[row("a", i) for i in range(2, 8)]]
    place = lambda rows: positioning.assign_positions(flat(spark, rows), CONFIG)
    never = F.lit(False)
    window = lambda rows, config=CONFIG, stop=never: [r.log_pos for r in recovery.recovery_window(place(rows), config, stop).orderBy("log_pos").collect()]
    assert window(many) == [2, 3, 4, 5, 6, 7]
    assert window(many, CONFIG.with_(recovery_queue_size=3, producer_buffer_size=3)) == [2, 3, 4]
    assert window([*many, ddl("a", 5, "ALTER TABLE t ADD x int")]) == [2, 3, 4] or window([*many[:4], ddl("a", 5, "ALTER TABLE t ADD x int"), *many[5:]]) == [2, 3, 4]
    assert window([*many[:4], ddl("a", 5, "BEGIN"), *many[5:]]) == [2, 3, 4, 6, 7]
    two = [*many, beat("a", 8, 2, 20), row("a", 9), row("a", 10)]
    assert window(two, stop=recovery.caught_up("a", 8)) == [2, 3, 4, 5, 6, 7, 9]


def test_state(spark, tmp_path):
    store = StateStore(spark, f"file://{tmp_path}/state")
    assert store.state("c") is None and not recovery.need_recovery(store, "c")
    store.save_position("c", None, {}, 1)
    assert store.state("c") is None
    store.save_position("c", '{"gtid":"sid:1"}', {"t1": 100, "t2": 200}, 10, db="d", tbl="t")
    store.save_position("other", "{}", {"t1": 1}, 10)
    store.save_position("c", '{"gtid":"sid:2"}', {"t1": 150, "t2": 200, "t3": 300}, 20, clean=True)
    rows = {r.topic: (r.topic_offset, r.time_created, r.time_updated) for r in store.read("checkpoints").where("cluster_name = 'c'").collect()}
    assert rows == {"t1": (150, 10, 20), "t2": (200, 10, 10), "t3": (300, 20, 20)}
    assert store.offsets("c") == {"t1": 150, "t2": 200, "t3": 300} and store.offsets("other") == {"t1": 1}
    assert store.state("c")["is_clean_shutdown"] and not recovery.need_recovery(store, "c")
    assert recovery.resume_position(store, StreamConfig(cluster="c")) == '{"gtid":"sid:2"}'
    assert recovery.resume_position(store, StreamConfig(cluster="c", resume_stream=False)) is None
    with pytest.raises(LookupError):
        store.latest_dump("c")
    dump = SchemaDump(store, "c")
    with pytest.raises(ValueError):
        dump.persist()
    tables = spark.createDataFrame([("d", "t", "CREATE TABLE t (id int)")], "db string, tbl string, query string")
    dump.create(tables)
    with pytest.raises(ValueError):
        dump.create(tables)
    dump.persist()
    assert recovery.need_recovery(store, "c") and not recovery.replay_wanted(store, "c")
    assert dump.restore(tables.schema).collect() == tables.collect()
    store.delete_dump("c")
    assert not store.dump_exists("c")


def test_metrics(spark):
    events = flat(spark, [row("a", 1), row("a", 2, tbl="u"), row("a", 3), ddl("a", 4, "DROP TABLE x"), ddl("a", 5, "BEGIN")])
    assert {r.tbl: r.events for r in metrics.table_counts(events).collect()} == {"t": 2, "u": 1}
    assert [r.query for r in metrics.statement_counts(events).collect()] == ["DROP TABLE x"]


def test_catalog_lookups(spark):
    cols = spark.createDataFrame([("d", "t", "b", 2, "time"), ("d", "t", "a", 1, "int")], "db string, tbl string, column_name string, ordinal_position int, column_type string")
    keys = spark.createDataFrame([("d", "t", "PRIMARY", "a", 1)], "db string, tbl string, constraint_name string, column_name string, ordinal_position int")
    assert [r.column_name for r in catalog.table_columns(cols, "d", "t").collect()] == ["a", "b"]
    meta = catalog.table_metadata(cols, keys).first()
    assert [c.column_name for c in meta.columns] == ["a", "b"] and meta.primary_keys[0].column_name == "a"
    assert catalog.table_exists(cols, "d", "t") and not catalog.table_exists(cols, "d", "x")
    assert [r.column_name for r in catalog.transformed_list(cols).collect()] == ["b"]
