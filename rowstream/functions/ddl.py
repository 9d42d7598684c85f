"""Schema statements: a tokenizer and parser for single statements, and the same classification as columns."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

TABLE_KINDS = ("create_table", "alter_table", "drop_table")


class ParseError(ValueError):
    """The statement can't be read."""


class UnparseableTableName(ParseError):
    """The name has more parts than database and table."""


@dataclass(frozen=True)
class Statement:
    """``tables``: (database or None, table) pairs, for statements on tables."""

    kind: str
    tables: tuple[tuple[str | None, str], ...] = ()
    renames: bool = False

    @property
    def supported(self) -> bool:
        return self.kind != "unsupported"

    @property
    def database(self) -> str | None:
        return self.tables[0][0] if self.tables else None

    @property
    def table(self) -> str | None:
        return self.tables[0][1] if self.tables else None


_TOKEN = re.compile(
    r"""(?P<skip>\s+|/\*.*?\*/|--[^\n]*|\#[^\n]*)
      |(?P<name>`(?:[^`]|``)*`|"(?:[^"]|"")*")
      |(?P<text>'(?:[^'\\]|''|\\.)*')
      |(?P<word>[0-9a-zA-Z$_\u0080-￿]+)
      |(?P<open>[`"'])
      |(?P<other>.)""",
    re.VERBOSE | re.DOTALL,
)


def tokens(query: str) -> list[tuple[str, str]]:
    """(class, text) of everything but blanks and comments."""
    out = [(m.lastgroup or "other", m.group()) for m in _TOKEN.finditer(query) if m.lastgroup != "skip"]
    if any(kind == "open" for kind, _ in out):
        raise ParseError(f"a quote is left open: {query!r}")
    return out


class _Cursor:
    def __init__(self, items: list[tuple[str, str]]) -> None:
        self.items, self.at = items, 0

    def word(self, *options: str) -> bool:
        """Take the next token if it is one of the words."""
        if self.at < len(self.items) and self.items[self.at][0] == "word" and self.items[self.at][1].lower() in options:
            self.at += 1
            return True
        return False

    def words(self, *options: str) -> bool:
        """Take all words in this order, or none."""
        start = self.at
        if all(self.word(o) for o in options):
            return True
        self.at = start
        return False

    def sign(self, text: str) -> bool:
        if self.at < len(self.items) and self.items[self.at] == ("other", text):
            self.at += 1
            return True
        return False

    def rest(self) -> list[tuple[str, str]]:
        return self.items[self.at :]


def unquote(name: str) -> str:
    """A name without its quotes; doubled quotes inside stand for one."""
    if len(name) >= 2 and name[0] == name[-1] and name[0] in "`\"":
        return name[1:-1].replace(name[0] * 2, name[0])
    return name


def _identifier(cursor: _Cursor) -> list[str]:
    parts = []
    while True:
        if cursor.at >= len(cursor.items) or cursor.items[cursor.at][0] not in ("name", "word"):
            raise ParseError("a name is missing")
        parts.append(unquote(cursor.items[cursor.at][1]))
        cursor.at += 1
        if not cursor.sign("."):
            return parts


def parse_identifier(text: str) -> list[str]:
    """Parts of a name such as db.`t`; nothing may follow it."""
    cursor = _Cursor(tokens(text))
    parts = _identifier(cursor)
    if cursor.rest():
        raise ParseError(f"after the name: {cursor.rest()[0][1]!r}")
    return parts


def database_and_table(parts: list[str]) -> tuple[str | None, str]:
    if len(parts) > 2:
        raise UnparseableTableName(".".join(parts))
    return (parts[0], parts[1]) if len(parts) == 2 else (None, parts[0])


def parse(query: str) -> Statement:
    """Classify one statement; the first form that fits holds, and what fits none is unsupported."""
    items = tokens(query)
    while items and items[-1] == ("other", ";"):
        items.pop()
    if ("other", ";") in items:
        raise ParseError("one statement expected")

    c = _Cursor(items)
    if c.word("create"):
        c.word("temporary")
        if c.word("table"):
            c.words("if", "not", "exists")
            return Statement("create_table", (database_and_table(_identifier(c)),))
    c = _Cursor(items)
    if c.word("alter"):
        c.word("online", "offline")
        c.word("ignore")
        if c.word("table"):
            table = database_and_table(_identifier(c))
            renames = any(kind == "word" and text.lower() == "rename" for kind, text in c.rest())
            return Statement("alter_table", (table,), renames)
    c = _Cursor(items)
    if c.word("drop"):
        c.word("temporary")
        if c.word("table"):
            c.words("if", "exists")
            tables = [database_and_table(_identifier(c))]
            while c.sign(","):
                tables.append(database_and_table(_identifier(c)))
            return Statement("drop_table", tuple(tables))
    for verb in ("create", "alter", "drop"):
        c = _Cursor(items)
        if c.word(verb) and c.word("database", "schema"):
            return Statement(f"{verb}_database")
    c = _Cursor(items)
    if c.word("create"):
        c.word("online", "offline")
        c.word("unique", "fulltext", "spatial")
        if c.word("index"):
            return Statement("create_index")
    c = _Cursor(items)
    if c.word("drop"):
        c.word("online", "offline")
        if c.word("index"):
            return Statement("drop_index")
    c = _Cursor(items)
    if c.words("rename", "table"):
        return Statement("rename_table", (), True)
    return Statement("unsupported")


def statement_database(statement: Statement, event_db: str | None) -> str | None:
    """The database a statement runs in: none for CREATE DATABASE, else the event's."""
    return None if statement.kind == "create_database" else event_db


# --- the same as columns -------------------------------------------------------------------------------------------

_GAP = r"(?:\s|/\*[\s\S]*?\*/|--[^\n]*\n|#[^\n]*\n)"
_NAME = r"(?:`(?:[^`]|``)*`|\"(?:[^\"]|\"\")*\"|[0-9a-zA-Z$_\u0080-￿]+)"
_FORMS = (
    ("create_table", rf"create{_GAP}+(?:temporary{_GAP}+)?table\b"),
    ("alter_table", rf"alter{_GAP}+(?:(?:online|offline){_GAP}+)?(?:ignore{_GAP}+)?table\b"),
    ("drop_table", rf"drop{_GAP}+(?:temporary{_GAP}+)?table\b"),
    ("create_database", rf"create{_GAP}+(?:database|schema)\b"),
    ("alter_database", rf"alter{_GAP}+(?:database|schema)\b"),
    ("drop_database", rf"drop{_GAP}+(?:database|schema)\b"),
    ("create_index", rf"create{_GAP}+(?:(?:online|offline){_GAP}+)?(?:(?:unique|fulltext|spatial){_GAP}+)?index\b"),
    ("drop_index", rf"drop{_GAP}+(?:(?:online|offline){_GAP}+)?index\b"),
    ("rename_table", rf"rename{_GAP}+table\b"),
)
_OPTION = rf"(?:if{_GAP}+not{_GAP}+exists{_GAP}+|if{_GAP}+exists{_GAP}+)?"
_TABLE = "|".join(form[: -len(r"\b")] for kind, form in _FORMS if kind in TABLE_KINDS)
_TARGET = rf"(?i)^{_GAP}*(?:{_TABLE})(?:{_GAP}+{_OPTION}|(?=[`\"]))({_NAME})(?:{_GAP}*\.{_GAP}*({_NAME}))?"


def ddl_kind(query: Column) -> Column:
    """The kind of a statement; null queries have none."""
    kind = F.lit("unsupported")
    for name, form in reversed(_FORMS):
        kind = F.when(query.rlike(f"(?i)^{_GAP}*{form}"), F.lit(name)).otherwise(kind)
    return F.when(query.isNotNull(), kind)


def _unquoted(name: Column) -> Column:
    inner = F.substring(name, F.lit(2), F.length(name) - 2)
    return F.when(name.startswith("`"), F.replace(inner, F.lit("``"), F.lit("`"))).when(name.startswith('"'), F.replace(inner, F.lit('""'), F.lit('"'))).otherwise(name)


def ddl_target(query: Column) -> Column:
    """struct<db, tbl> of a statement on a table; of a list of tables, the first."""
    first, second = F.regexp_extract(query, _TARGET, 1), F.regexp_extract(query, _TARGET, 2)
    two = second != ""
    return F.struct(F.when(two, _unquoted(first)).alias("db"), F.when(first != "", F.when(two, _unquoted(second)).otherwise(_unquoted(first))).alias("tbl"))


def ddl_renames(query: Column) -> Column:
    """RENAME TABLE, or ALTER TABLE with the word rename outside of quotes."""
    bare = F.regexp_replace(query, r"`(?:[^`]|``)*`|\"(?:[^\"]|\"\")*\"|'(?:[^'\\]|''|\\.)*'", "x")
    kind = ddl_kind(query)
    return (kind == "rename_table") | ((kind == "alter_table") & bare.rlike(r"(?i)(?<![0-9a-zA-Z$_])rename(?![0-9a-zA-Z$_])"))
