import datetime

import pytest
from pyspark.sql import functions as F

from rowstream.config import StreamConfig, cluster_entry, only_tables, unlist
from rowstream.functions import dates, position, types


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_position_forms(spark):
    p = position.struct_of
    saved = one(
        spark,
        gtid=position.to_saved(p(gtid=F.lit("sid:10"), offset=F.lit(10))),
        gtid0=position.to_saved(p(gtid=F.lit("sid:10"), offset=F.lit(0))),
        log0=position.to_saved(p(log_file=F.lit("bin.1"), log_pos=F.lit(100), offset=F.lit(0))),
        beat=position.to_saved(p(log_file=F.lit("bin.1"), log_pos=F.lit(100), offset=F.lit(3), hb_serial=F.lit(7), hb_timestamp=F.lit(9))),
        half=position.to_saved(p(log_file=F.lit("bin.1"))),
    )
    assert saved["gtid"] == '{"gtid":"sid:10","offset":10}'
    assert saved["gtid0"] == '{"gtid":"sid:10"}'
    assert saved["log0"] == '{"log_file":"bin.1","log_pos":100,"offset":0}'
    assert saved["beat"] == '{"log_file":"bin.1","log_pos":100,"offset":3,"hb_serial":7,"hb_timestamp":9}'
    assert saved["half"] == "{}"
    again = one(spark, p=position.from_saved(F.lit(saved["beat"])))["p"]
    assert (again.log_file, again.log_pos, again.offset, again.hb_serial) == ("bin.1", 100, 3, 7)
    with pytest.raises(Exception, match="not a position"):
        one(spark, p=position.from_saved(F.lit('{"offset":1}')))
    opened = one(spark, a=position.to_replication(p(gtid=F.lit("sid:10"), offset=F.lit(10))), b=position.to_replication(p(gtid=F.lit("sid:10"))))
    assert (opened["a"].auto_position, opened["b"].auto_position) == ("sid:1-10", "sid:1-11")


def test_values(spark):
    r = one(
        spark,
        negative=types.time_to_micros(F.expr("interval '-34 22:59:59.000004' day to second")),
        iso=types.datetime_to_iso(F.lit("2015-12-31 00:59:59.999999").cast("timestamp_ntz")),
        whole=types.datetime_to_iso(F.lit("2015-12-31 00:59:59").cast("timestamp_ntz")),
        none=types.datetime_to_iso(F.lit(None).cast("timestamp_ntz")),
        members=types.set_to_list(F.lit("b,a")),
        empty=types.set_to_list(F.lit("")),
        utc=F.unix_timestamp(types.timestamp_to_utc(F.lit("1970-01-02 00:00:00").cast("timestamp_ntz"))),
        day=dates.date_to_epoch(F.lit("9999-12-31").cast("date")),
    )
    assert r["negative"] == -((34 * 86400 + 22 * 3600 + 59 * 60 + 59) * 10**6 + 4)
    assert (r["iso"], r["whole"], r["none"]) == ("2015-12-31T00:59:59.999999", "2015-12-31T00:59:59", None)
    assert (r["members"], r["empty"], r["utc"], r["day"]) == (["a", "b"], [], 86400, dates.FOREVER)


@pytest.mark.parametrize(
    "source,spark_type",
    [("TINYINT(1)", "smallint"), ("int(10) unsigned", "bigint"), ("bigint unsigned", "decimal(20,0)"), ("decimal(10,2)", "decimal(10,2)"), ("dec", "decimal(10,0)"), ("float(30)", "double"),
     ("float(10,2)", "float"), ("double precision", "double"), ("datetime(6)", "timestamp_ntz"), ("time", "interval day to second"), ("year(4)", "int"), ("mediumblob", "binary"),
     ("longtext", "string"), ("enum('a')", "string"), ("set('a','b')", "array<string>"), ("varchar(64)", "string")],
)
def test_type_map(source, spark_type):
    assert types.spark_type(source) == spark_type


def test_projection_by_types(spark):
    row = F.struct(F.lit(100).alias("n"), F.lit("TWO,ONE").alias("s"), F.lit("2015-12-31 00:59:59").cast("timestamp_ntz").alias("d"))
    r = one(spark, p=types.project(row, {"n": "int(11)", "s": "set('ONE','TWO')", "d": "datetime"}))["p"]
    assert (r.n, r.s, r.d) == (100, ["ONE", "TWO"], "2015-12-31T00:59:59")


def test_settings(tmp_path):
    assert only_tables(["a", "b_data_pipeline_refresh"]) == ["a", "a_data_pipeline_refresh"]
    assert only_tables([]) is None
    assert unlist([]) is None and unlist([1]) == 1
    with pytest.raises(ValueError):
        unlist([1, 2])
    with pytest.raises(ValueError):
        StreamConfig(producer_buffer_size=2000)
    f = tmp_path / "c.yaml"
    f.write_text("cluster: a\ntable_whitelist: [x, y]\n")
    assert StreamConfig.from_yaml(str(f)).table_whitelist == ("x", "y")
    layered = StreamConfig.layered({"cluster": "a"}, {"cluster": "b"}, env={"ROWSTREAM_GTID_ENABLED": "yes", "ROWSTREAM_MAX_DELAY_SECONDS": "5"})
    assert (layered.cluster, layered.gtid_enabled, layered.max_delay_seconds) == ("b", True, 5)
    with pytest.raises(ValueError):
        StreamConfig.layered({"unknown": 1}, env={})
    topology = [{"cluster": "a", "replica": "m", "entries": [{"host": "h"}]}]
    assert cluster_entry(topology, "a") == {"host": "h"} and cluster_entry(topology, "a", "x") is None
    with pytest.raises(ValueError):
        cluster_entry(topology, "b")
    assert StreamConfig(topology_name="logical").logical_cluster == "logical"


def test_dates(spark):
    r = one(spark, e=dates.to_epoch(F.lit("2020-01-01 00:00:00").cast("timestamp_ntz"), "America/Los_Angeles"), d=dates.epoch_to_date(F.lit(86400)), delay=dates.delay_seconds(F.lit(5), F.lit(9)))
    assert (r["e"], r["d"], r["delay"]) == (1577836800 + 8 * 3600, datetime.date(1970, 1, 2), 4)
