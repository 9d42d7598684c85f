import json

import pytest
from pyspark.sql import functions as F

from rowstream.__main__ import main
from rowstream.config import is_set, server_id
from rowstream.functions import avro
from rowstream.operators import messages, recovery
from tests.test_streaming import capture, some


def col(name, kind, nullable="YES", default=None):
    return {"column_name": name, "column_type": kind, "is_nullable": nullable, "column_default": default}


def test_records():
    got = avro.record("main.source.shop", "biz", [col("id", "int(11)", "NO"), col("name", "varchar(64)"), col("on", "tinyint(1)", "NO", 1), col("pay", "float(10,2)"), col("tags", "set('a')")], ["id"])
    assert got["pkey"] == ["id"] and got["fields"] == [
        {"name": "id", "type": "int", "pkey": 1},
        {"name": "name", "type": ["null", "string"], "default": None, "maxlen": 64},
        {"name": "on", "type": "int", "default": 1},
        {"name": "pay", "type": ["null", "float"], "default": None, "precision": 10, "scale": 2},
        {"name": "tags", "type": ["null", {"type": "array", "items": "string"}], "default": None},
    ]
    assert [f["name"] for f in avro.transaction_record(True)["fields"]] == ["cluster_name", "gtid"]
    assert [f["name"] for f in avro.transaction_record(False)["fields"]] == ["cluster_name", "log_file", "log_pos"]
    json.dumps(avro.changelog_record())


def test_load(tmp_path):
    (tmp_path / "a.avsc").write_text(json.dumps(avro.changelog_record()))
    (tmp_path / "a.yaml").write_text("type: record\nname: changelog\nfields:\n- {name: id, type: int}\n")
    (tmp_path / "b.yaml").write_text("- 1")
    assert avro.load(str(tmp_path / "a.avsc")) == avro.changelog_record()
    assert avro.load(str(tmp_path / "a.yaml"))["fields"] == [{"name": "id", "type": "int"}]
    with pytest.raises(ValueError):
        avro.load(str(tmp_path / "b.yaml"))


def test_small_helpers():
    assert is_set("A", {"A": ""}) and not is_set("A", {})
    assert all(1 <= server_id() < 1 << 32 for _ in range(100)) and server_id() != server_id()
    with pytest.raises(TypeError):
        messages.log_transaction(5, None, None)


def test_heartbeat_command(spark, tmp_path, capsys):
    capture(str(tmp_path), "bin.000001", some("bin.000001", 9))
    assert main(["heartbeat", str(tmp_path), "1577836800", "5"]) == 0
    assert "log position: 4" in capsys.readouterr().out
    assert main(["heartbeat", str(tmp_path), "1577836800", "6"]) == 1


def test_caught_up_by_gtid(spark):
    rows = spark.createDataFrame([("s:4",), ("s:5",), ("t:9",), (None,)], "g string").select(F.struct(F.col("g").alias("gtid")).alias("position"))
    assert [r[0] for r in rows.select(recovery.caught_up_gtid("s:5")).collect()] == [False, True, False, False]
