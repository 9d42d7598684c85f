import json

import pytest
from pyspark.sql import functions as F

from rowstream.config import StreamConfig
from rowstream.operators import positioning
from rowstream.operators.state import SchemaDump, StateStore
from rowstream.schema import BASE_TABLE, ORDER, RAW_EVENT
from rowstream.sources.binlog import BinlogSource, captured
from rowstream.streaming.pipeline import ChangeStream, prepared

CONFIG = StreamConfig()


def event(kind, file, pos, db="shop", tbl="t", query=None, rows=None):
    return {"kind": kind, "cluster": "source", "db": db, "tbl": tbl, "log_file": file, "log_pos": pos, "gtid": None, "ts_epoch": 100 + pos, "query": query, "rows": rows}


def capture(path, file, events):
    with open(f"{path}/{file}.jsonl", "a") as f:
        f.writelines(json.dumps(e) + "\n" for e in events)


def some(file, n, start=0):
    out = []
    for i in range(start, start + n):
        if i % 4 == 0:
            out.append(event("update", file, i, "heartbeat", "beat", rows=[{"before_values": None, "after_values": json.dumps({"serial": i + 1, "timestamp": "2020-01-01 00:00:00"})}]))
        elif i % 4 == 1:
            out.append(event("query", file, i, query="BEGIN", tbl=None))
        else:
            out.append(event("write", file, i, rows=[{"values": json.dumps({"id": i})}, {"values": json.dumps({"id": i + 1000})}]))
    return out


@pytest.fixture
def log(tmp_path):
    path = tmp_path / "log"
    path.mkdir()
    return str(path)


def test_source_in_batch(spark, log):
    spark.dataSource.register(BinlogSource)
    capture(log, "bin.000001", some("bin.000001", 8))
    capture(log, "bin.000002", [*some("bin.000002", 4), {**event("rotate", "bin.000002", 9)}])
    read = lambda **o: spark.read.format("binlog").options(path=log, **o).load()
    assert read().schema == RAW_EVENT and read().count() == 12
    assert read(log_file="bin.000002", log_pos="2").count() == 2
    assert read(log_file="bin.000002", log_pos="2", resume="false").count() == 12
    assert read(tables="x").where("kind = 'write'").count() == 0 and read(tables="x").count() == 6
    assert captured(spark, log).count() == 12
    assert {r.log_file for r in positioning.log_files(read()).collect()} == {"bin.000001", "bin.000002"}


def published(spark, path):
    return spark.read.parquet(path)


def test_stream_equals_batch_and_restarts_without_repeats(spark, log, tmp_path):
    spark.dataSource.register(BinlogSource)
    store = StateStore(spark, f"file://{tmp_path}/state")
    topics, checkpoint = str(tmp_path / "topics"), str(tmp_path / "checkpoint")

    def run():
        stream = ChangeStream(spark, CONFIG, store, topics)
        raw = spark.readStream.format("binlog").options(path=log, span_bytes="700").load()
        query = stream.start(raw, checkpoint, seconds=0.2)
        stream.stop(query)

    capture(log, "bin.000001", some("bin.000001", 13))
    run()
    first = published(spark, topics).count()
    assert first == 12 and store.state("source")["is_clean_shutdown"]
    capture(log, "bin.000001", some("bin.000001", 3, 13))
    capture(log, "bin.000002", some("bin.000002", 6, 2))
    run()
    got = published(spark, topics)
    whole = positioning.assign_positions(prepared(captured(spark, log), CONFIG), CONFIG).where("kind = 'write'")
    flat = lambda df, p: sorted((r.log_file, r.log_pos, r.row_idx, r.p.log_file, r.p.log_pos, r.p.offset, r.p.hb_serial) for r in df.select(*ORDER, F.col(p).alias("p")).collect())
    assert flat(got, "upstream_position_info.position") == flat(whole, "position")
    assert store.offsets("source")["main.source.shop.t"] == got.count()


def test_repeated_batch_changes_nothing(spark, tmp_path):
    events = spark.createDataFrame([("write", "source", "shop", "t", "f", 1, None, 5, None, [('{"id":1}', None, None)])], RAW_EVENT)
    placed = positioning.assign_positions(prepared(events, CONFIG), CONFIG)
    store = StateStore(spark, f"file://{tmp_path}/state")
    stream = ChangeStream(spark, CONFIG, store, str(tmp_path / "topics"))
    stream.publish(placed, 0)
    before = store.offsets("source")
    stream.publish(placed, 0)
    assert store.offsets("source") == before and published(spark, str(tmp_path / "topics")).count() == 1


def ddl(file, pos, query):
    return event("query", file, pos, query=query, tbl=None)


def image(i, **more):
    return [{"values": json.dumps({"id": i, **more})}]


def ids(spark, path):
    rows = published(spark, path).select("topic", "payload_data").collect()
    return sorted(json.loads(r.payload_data)["id"] for r in rows)


class Killed(Exception):
    pass


@pytest.mark.parametrize("same_checkpoint", [True, False])
@pytest.mark.parametrize("queue", [1500, 5])
def test_killed_between_publishing_and_saving(spark, log, tmp_path, same_checkpoint, queue):
    spark.dataSource.register(BinlogSource)
    store = StateStore(spark, f"file://{tmp_path}/state")
    topics = str(tmp_path / "topics")
    config = CONFIG.with_(recovery_queue_size=queue, producer_buffer_size=min(queue, 500))

    def stream():
        return ChangeStream(spark, config, store, topics)

    def go(change, checkpoint):
        raw = spark.readStream.format("binlog").options(path=log).load()
        query = change.start(raw, str(tmp_path / checkpoint), seconds=0.2, log=captured(spark, log))
        change.stop(query)

    capture(log, "bin.000001", some("bin.000001", 9))
    go(stream(), "one")
    capture(log, "bin.000001", some("bin.000001", 20, 9))
    broken = stream()
    broken._save = lambda *_: (_ for _ in ()).throw(Killed("between"))
    with pytest.raises(Exception, match="between"):
        go(broken, "one")
    assert not store.state("source")["is_clean_shutdown"]
    capture(log, "bin.000002", some("bin.000002", 6, 2))
    go(stream(), "one" if same_checkpoint else "two")
    whole = prepared(captured(spark, log), CONFIG).where("kind = 'write'")
    assert ids(spark, topics) == sorted(json.loads(r.after_image)["id"] for r in whole.collect())
    assert store.state("source")["is_clean_shutdown"]


def test_stream_follows_schema_statements(spark, log, tmp_path):
    spark.dataSource.register(BinlogSource)
    store = StateStore(spark, f"file://{tmp_path}/state")
    topics, checkpoint = str(tmp_path / "topics"), str(tmp_path / "checkpoint")
    base = spark.createDataFrame([("shop", "old", {"id": "int", "d": "time"}, ["id"])], BASE_TABLE)
    dump = SchemaDump(store, "source")
    dump.create(base)
    dump.persist()

    def run():
        change = ChangeStream(spark, CONFIG, store, topics, pii=spark.createDataFrame([("shop", "new")], "db string, tbl string"))
        change.stop(change.start(spark.readStream.format("binlog").options(path=log).load(), checkpoint, seconds=0.2))

    data = lambda pos, tbl, i, **more: event("write", "bin.000001", pos, tbl=tbl, rows=image(i, **more))
    beat = event("update", "bin.000001", 0, "heartbeat", "beat", rows=[{"after_values": json.dumps({"serial": 1, "timestamp": "2020-01-01 00:00:00"})}])
    capture(log, "bin.000001", [beat, data(1, "old", 1, d="01:00:00"), ddl("bin.000001", 2, "CREATE TABLE t (id int, s set('a','b'))"), data(3, "t", 2, s="b,a")])
    run()
    capture(log, "bin.000001", [data(4, "t", 3, s="b"), ddl("bin.000001", 5, "RENAME TABLE old TO new"), data(6, "new", 4, d="00:00:01"), ddl("bin.000001", 7, "ALTER TABLE t DROP s, ADD s text"), data(8, "t", 5, s="b,a")])
    run()
    got = {json.loads(r.payload_data)["id"]: r for r in published(spark, topics).collect()}
    assert {i: r.schema_id for i, r in got.items()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 2}
    assert {i: json.loads(r.payload_data) for i, r in got.items()} == {1: {"id": 1, "d": 3_600_000_000}, 2: {"id": 2, "s": ["a", "b"]}, 3: {"id": 3, "s": ["b"]}, 4: {"id": 4, "d": 1_000_000}, 5: {"id": 5, "s": "b,a"}}
    assert got[4]["keys"] == '{"id":4}' and got[2]["keys"] is None and [i for i, r in got.items() if r.contains_pii] == [4]


def test_offsets_never_go_back_and_half_lines_wait(log):
    from rowstream.sources.binlog import _StreamReader

    capture(log, "bin.000001", some("bin.000001", 6))
    reader = lambda: _StreamReader({"path": log, "span_bytes": "300"})
    first = reader().latestOffset()
    with open(f"{log}/bin.000001.jsonl", "a") as f:
        f.write(json.dumps(event("write", "bin.000001", 6, rows=[{"values": "{}"}]))[:40])
    assert reader().latestOffset() == first
    with open(f"{log}/bin.000001.jsonl", "a") as f:
        f.write(json.dumps(event("write", "bin.000001", 6, rows=[{"values": "{}"}]))[40:] + "\n")
    last = reader().latestOffset()
    read = lambda a, b: [row[5] for span in reader().partitions(a, b) for row in reader().read(span)]
    assert len(reader().partitions({"bytes": {}}, last)) > 3
    assert read({"bytes": {}}, first) + read(first, last) == list(range(7)) and read(last, last) == []


def test_one_writer(spark, tmp_path):
    store = StateStore(spark, f"file://{tmp_path}/state")
    with store.writing("c"):
        with pytest.raises(RuntimeError):
            with store.writing("c"):
                pass
        with store.writing("other"):
            pass
    with store.writing("c"):
        pass


def test_a_failed_save_leaves_the_state(spark, tmp_path, monkeypatch):
    store = StateStore(spark, f"file://{tmp_path}/state")
    store.save_position("c", '{"gtid":"sid:1"}', {"t": 1}, 1)
    pointers = store._pointers()
    monkeypatch.setattr(store, "_pointers", lambda: pointers[:-1])  # a writer that did not see the last save
    with pytest.raises(OSError):
        store.save_position("c", '{"gtid":"sid:2"}', {"t": 2}, 2)
    monkeypatch.undo()
    assert store.state("c")["position"] == '{"gtid":"sid:1"}' and store.latest_checkpoint("c")["topic_offset"] == 1
    for i in range(5):
        store.save_position("c", f'{{"gtid":"sid:{i}"}}', {"t": i}, i)
    assert len(store._pointers()) <= store.KEPT + 1 and store.state("c")["position"] == '{"gtid":"sid:4"}'
