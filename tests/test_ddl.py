import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rowstream.functions import ddl

CASES = [
    ("CREATE TABLE foo (id int)", "create_table", None, "foo"),
    ("create temporary table if not exists `db`.`t``x` (id int)", "create_table", "db", "t`x"),
    ('CREATE TABLE "a"."b" (id int) ENGINE=InnoDB', "create_table", "a", "b"),
    ("/* note */ CREATE TABLE db1 . t1 (id int)", "create_table", "db1", "t1"),
    ("ALTER ONLINE IGNORE TABLE db.t ADD COLUMN x int", "alter_table", "db", "t"),
    ("alter table t rename to y", "alter_table", None, "t"),
    ("DROP TEMPORARY TABLE IF EXISTS `db`.t", "drop_table", "db", "t"),
    ("CREATE DATABASE x", "create_database", None, None),
    ("ALTER SCHEMA x CHARACTER SET utf8", "alter_database", None, None),
    ("DROP SCHEMA x", "drop_database", None, None),
    ("CREATE ONLINE UNIQUE INDEX i ON t (x)", "create_index", None, None),
    ("DROP OFFLINE INDEX i ON t", "drop_index", None, None),
    ("RENAME TABLE a TO b", "rename_table", None, None),
    ("BEGIN", "unsupported", None, None),
    ("USE shop", "unsupported", None, None),
    ("DROP TRIGGER x", "unsupported", None, None),
]


@pytest.mark.parametrize("query,kind,db,table", CASES)
def test_parse(query, kind, db, table):
    s = ddl.parse(query)
    assert (s.kind, s.database, s.table) == (kind, db, table)
    assert s.supported == (kind != "unsupported")


def test_columns_agree_with_the_parser(spark):
    df = spark.createDataFrame([(c[0],) for c in CASES] + [(None,)], "q string")
    t = ddl.ddl_target(F.col("q"))
    got = df.select("q", ddl.ddl_kind(F.col("q")), t["db"], t["tbl"], ddl.ddl_renames(F.col("q"))).collect()
    for query, kind, db, tbl, renames in got:
        if query is None:
            assert kind is None
            continue
        s = ddl.parse(query)
        assert (kind, db, tbl, renames) == (s.kind, s.database, s.table, s.renames)


def test_rename_inside_quotes_is_none():
    assert not ddl.parse("ALTER TABLE t ADD `rename` int").renames
    assert ddl.parse("ALTER TABLE t RENAME INDEX a TO b").renames


def test_lists_and_errors():
    assert ddl.parse("DROP TABLE a, db.b;").tables == ((None, "a"), ("db", "b"))
    for text in ("CREATE TABLE `open (id int)", "CREATE TABLE a.b.c (id int)", "BEGIN; COMMIT"):
        with pytest.raises(ddl.ParseError):
            ddl.parse(text)
    with pytest.raises(ddl.UnparseableTableName):
        ddl.parse("DROP TABLE a.b.c")
    assert ddl.statement_database(ddl.parse("CREATE DATABASE x"), "y") is None
    assert ddl.statement_database(ddl.parse("DROP TABLE x"), "y") == "y"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(min_size=1, max_size=12), min_size=1, max_size=2), st.sampled_from("`\""))
def test_quoting_round_trip(parts, quote):
    text = ".".join(quote + p.replace(quote, quote * 2) + quote for p in parts)
    assert ddl.parse_identifier(text) == parts


REPLAY = [
    ("CREATE TABLE IF NOT EXISTS `a` (id int(11) unsigned NOT NULL AUTO_INCREMENT, name varchar(64), s set('x','y,z') DEFAULT 'x', PRIMARY KEY (`id`), KEY k (name)) ENGINE=InnoDB", [("shop", "a")], ["id int(11) unsigned", "name varchar(64)", "s set('x','y,z')"]),
    ("ALTER TABLE a ADD COLUMN b datetime(6) AFTER id, DROP COLUMN name, MODIFY s time FIRST, ADD INDEX i (b)", [("shop", "a")], ["s time", "id int(11) unsigned", "b datetime(6)"]),
    ("RENAME TABLE a TO c, shop.zz TO q", [("shop", "c"), ("shop", "q")], ["s time", "id int(11) unsigned", "b datetime(6)"]),
    ("alter table c change b bb timestamp, rename to other.d, add (x int, y decimal(10,2))", [("other", "d")], ["s time", "id int(11) unsigned", "bb timestamp", "x int", "y decimal(10,2)"]),
    ("CREATE TABLE e LIKE other.d", [("shop", "e")], ["s time", "id int(11) unsigned", "bb timestamp", "x int", "y decimal(10,2)"]),
    ("ALTER TABLE e RENAME COLUMN id TO key_id, DROP y", [("shop", "e")], ["s time", "key_id int(11) unsigned", "bb timestamp", "x int"]),
    ("ALTER TABLE e DROP PRIMARY KEY, ADD PRIMARY KEY (x, bb)", [("shop", "e")], ["s time", "key_id int(11) unsigned", "bb timestamp", "x int"]),
    ("CREATE TABLE bad 'x", [], None),
    ("CREATE INDEX i ON e (x)", [], None),
    ("DROP TABLE IF EXISTS e, other.d", [("shop", "e"), ("other", "d")], None),
]


def test_replay():
    from rowstream.functions.replay import apply

    tables: dict = {}
    keys = []
    for query, changed, columns in REPLAY:
        assert apply(tables, "shop", query) == changed, query
        if columns is not None:
            assert [f"{c} {t}" for c, t in tables[changed[0]].columns.items()] == columns, query
            keys.append(tables[changed[0]].key)
    assert keys == [["id"]] * 5 + [["key_id"], ["x", "bb"]] and set(tables) == {("shop", "q")}
    assert apply(tables, None, "DROP DATABASE shop") == [] and not tables
