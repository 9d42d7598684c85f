"""Format-preserving pseudonyms for personal data, in built-in expressions only.

One pattern finds candidates; each is validated (card numbers by their check digit, addresses by their octets, social
security numbers by their ranges, dates by the calendar) and then permuted within its own format by a keyed Feistel
network. A network over Z_a x Z_b, with a * b the exact number of valid values, permutes the valid values, so no value
needs a second try and equal values get equal pseudonyms in every document. The round function is SHA-256 of the key,
the kind, the round and the other half.

Kinds: payment cards (13 to 19 digits, the check digit is computed anew), phone numbers (ten digits in groups; the
country code stays; written without a country code's plus sign or brackets, area and exchange must begin with 2 to 9),
IPv4 addresses (each octet keeps its number of digits), US social security numbers, dates from 1900 to 2099 in three
forms, e-mail addresses (letters and digits of the local part, each within its class) and hexadecimal secrets of 32 to
64 digits in one case. Numbers that fail validation stay as they are, and so does all other text.

The key has no default: whoever holds it can undo the pseudonyms. :func:`session_key` takes it from the session's
setting ``spark.rowstream.pii.secret`` or the environment's ``ROWSTREAM_PII_SECRET``; without either, it draws one that
lives as long as the session, so that values are linked within the session only. The key stands as a literal in the
plan, so plans of a shared cluster should be redacted (``spark.sql.redaction.string.regex``).

Defined results: a null text stays null, an empty one empty; texts may be of any length, as every repetition in the
pattern is bounded. Rows are judged each by itself, so repeated rows are rewritten alike. Other columns stay, but with
``counts`` a column ``pii_found`` is replaced: it counts the validated values, also one that is its own pseudonym.
"""

from __future__ import annotations

import os
import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY_SETTING, KEY_VARIABLE = "spark.rowstream.pii.secret", "ROWSTREAM_PII_SECRET"
ROUNDS = 8

EMAIL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9_%+][A-Za-z0-9._%+\-]{0,63}@[A-Za-z0-9](?:[A-Za-z0-9\-.]{0,252}[A-Za-z0-9])?\.[A-Za-z]{2,24}(?![A-Za-z0-9])"
HEX = r"(?:[a-f0-9]{32,64}|[A-F0-9]{32,64})"
SECRET = rf"(?<![A-Za-z0-9])(?=[A-Fa-f0-9]{{0,63}}[0-9]){HEX}(?![A-Za-z0-9])"
DATE = r"(?<![0-9./\-])(?:(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./](?:19|20)[0-9]{2})(?![0-9]|[./\-][0-9])"
ADDRESS = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
SSN = r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])"
#: Groups with blanks only must not go on in further groups, which would be another kind of number.
PHONE = (
    r"(?<![0-9A-Za-z+])(?:\+?1[ .\-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[.\-])[0-9]{3}[ .\-][0-9]{4}(?![0-9A-Za-z])"
    r"|(?<![0-9A-Za-z+]|[0-9] )(?:\+?1 )?[0-9]{3} [0-9]{3} [0-9]{4}(?![0-9A-Za-z]|[ \-][0-9])"
)
CARD = r"(?<![0-9])[0-9](?:[ \-]?[0-9]){12,18}(?![0-9]|[ \-][0-9])"
#: Cards written side by side are told apart: a full run of 13 to 19 digits without separators comes before one with.
PLAIN_CARD = r"(?<![0-9])[0-9]{13,19}(?![0-9])"
PATTERN = "|".join((EMAIL, SECRET, DATE, ADDRESS, SSN, PHONE, PLAIN_CARD, CARD))
#: Days from 1900-01-01 to 2099-12-31: 319 * 229.
DAYS = (319, 229)
#: Year first with hyphens; month first with slashes; day first with dots.
DATE_FORMS = ("yyyy-MM-dd", "MM/dd/yyyy", "dd.MM.yyyy")


def _noise(key: str, kind: str, n: Column, other: Column) -> Column:
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), n.cast("string"), other.cast("string")).cast("binary"), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def feistel(left: Column, right: Column, a: Column | int, b: Column | int, key: str, kind: str) -> Column:
    """Permute the pair (left in Z_a, right in Z_b); the halves take turns, so that any a and b will do."""
    a, b = (x if isinstance(x, Column) else F.lit(x).cast("long") for x in (a, b))

    def step(s: Column, n: Column) -> Column:
        even = n % 2 == 0
        return F.struct(
            F.when(even, F.pmod(s["l"] + F.pmod(_noise(key, kind, n, s["r"]), a), a)).otherwise(s["l"]).alias("l"),
            F.when(even, s["r"]).otherwise(F.pmod(s["r"] + F.pmod(_noise(key, kind, n, s["l"]), b), b)).alias("r"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), step)


def _unfeistel(left: Column, right: Column, a: Column | int, b: Column | int, key: str, kind: str) -> Column:
    a, b = (x if isinstance(x, Column) else F.lit(x).cast("long") for x in (a, b))

    def step(s: Column, n: Column) -> Column:
        even = n % 2 == 0
        return F.struct(
            F.when(even, F.pmod(s["l"] - F.pmod(_noise(key, kind, n, s["r"]), a), a)).otherwise(s["l"]).alias("l"),
            F.when(even, s["r"]).otherwise(F.pmod(s["r"] - F.pmod(_noise(key, kind, n, s["l"]), b), b)).alias("r"),
        )

    return F.aggregate(F.reverse(F.sequence(F.lit(0), F.lit(ROUNDS - 1))), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), step)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _ten_to(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("long")


def _permute_digits(digits: Column, key: str, kind: str, undo: bool = False) -> Column:
    """Permute a string of 2 to 36 digits among the strings of its length."""
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    rest = n - half
    walk = _unfeistel if undo else feistel
    pair = walk(F.substring(digits, F.lit(1), half).cast("long"), F.substring(digits, half + 1, rest).cast("long"), _ten_to(half), _ten_to(rest), key, kind)
    return F.transform(F.array(pair), lambda p: F.concat(F.lpad(p["l"].cast("string"), half, "0"), F.lpad(p["r"].cast("string"), rest, "0")))[0]


def _with_digits(form: Column, digits: Column) -> Column:
    """``form`` with its digits replaced, one after the other."""
    return F.array_join(
        F.transform(
            F.sequence(F.lit(1), F.length(form)),
            lambda i: F.when(F.substring(form, i, F.lit(1)).rlike("[0-9]"), F.substring(digits, F.length(_digits(F.substring(form, F.lit(1), i))), F.lit(1))).otherwise(F.substring(form, i, F.lit(1))),
        ),
        "",
    )


def _luhn_sum(digits: Column, doubled_last: bool) -> Column:
    """Sum of the digits with every second one doubled, counted from the right."""
    back = F.reverse(digits)
    odd = 0 if doubled_last else 1

    def term(total: Column, i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when((i - 1) % 2 == odd, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), term)


def _card(m: Column, key: str, undo: bool) -> Column:
    """A valid number's digits but the last are permuted, and the check digit follows from them."""
    d = _digits(m)
    body = F.substring(d, F.lit(1), F.length(d) - 1)
    made = F.transform(F.array(_permute_digits(body, key, "card", undo)), lambda p: F.concat(p, F.pmod(10 - _luhn_sum(p, True) % 10, F.lit(10)).cast("string")))[0]
    return _with_digits(m, made)


def _phone_parts(m: Column) -> tuple[Column, Column, Column]:
    d = _digits(m)
    part = lambda at, n: F.substring(d, F.length(d) - at, F.lit(n)).cast("long")
    return part(9, 3), part(6, 3), part(3, 4)


def _phone(m: Column, key: str, undo: bool) -> Column:
    """Area and exchange stay among the codes that begin with 2 to 9, or among the others."""
    area, exchange, line = _phone_parts(m)
    low = lambda x: F.when(x >= 200, F.lit(200)).otherwise(F.lit(0))
    many = lambda x: F.when(x >= 200, F.lit(800)).otherwise(F.lit(200)).cast("long")
    walk = _unfeistel if undo else feistel
    pair = walk((area - low(area)) * many(exchange) + exchange - low(exchange), line, many(area) * many(exchange), F.lit(10_000).cast("long"), key, "phone")

    def back(p: Column) -> Column:
        a, e = F.floor(p["l"] / many(exchange)) + low(area), p["l"] % many(exchange) + low(exchange)
        return F.concat(*[F.lpad(x.cast("string"), n, "0") for x, n in ((a, 3), (e, 3), (p["r"], 4))])

    d = _digits(m)
    return _with_digits(m, F.concat(F.substring(d, F.lit(1), F.length(d) - 10), F.transform(F.array(pair), back)[0]))


def _address(m: Column, key: str, undo: bool) -> Column:
    """Each octet stays among those with its number of digits."""
    o = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    low = lambda x: F.when(x >= 100, F.lit(100)).when(x >= 10, F.lit(10)).otherwise(F.lit(0))
    many = lambda x: F.when(x >= 100, F.lit(156)).when(x >= 10, F.lit(90)).otherwise(F.lit(10)).cast("long")
    half = lambda i: (o[i] - low(o[i])) * many(o[i + 1]) + o[i + 1] - low(o[i + 1])
    walk = _unfeistel if undo else feistel
    pair = walk(half(0), half(2), many(o[0]) * many(o[1]), many(o[2]) * many(o[3]), key, "address")

    def back(p: Column) -> Column:
        parts = [x for i, v in ((0, p["l"]), (2, p["r"])) for x in (F.floor(v / many(o[i + 1])) + low(o[i]), v % many(o[i + 1]) + low(o[i + 1]))]
        return F.concat_ws(".", *[x.cast("string") for x in parts])

    return F.transform(F.array(pair), back)[0]


def _ssn(m: Column, key: str, undo: bool) -> Column:
    area, group, serial = (F.split(m, "-")[i].cast("long") for i in range(3))
    walk = _unfeistel if undo else feistel
    pair = walk((area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1, serial - 1, 898 * 99, 9999, key, "ssn")

    def back(p: Column) -> Column:
        place = F.floor(p["l"] / 99) + 1
        return F.concat_ws("-", F.lpad((place + F.when(place > 665, 1).otherwise(0)).cast("string"), 3, "0"), F.lpad((p["l"] % 99 + 1).cast("string"), 2, "0"), F.lpad((p["r"] + 1).cast("string"), 4, "0"))

    return F.transform(F.array(pair), back)[0]


def _day(m: Column) -> tuple[Column, Column]:
    """The form of a date and its day, null if the calendar has none such."""
    form = F.when(m.contains("-"), F.lit(DATE_FORMS[0])).when(m.contains("/"), F.lit(DATE_FORMS[1])).otherwise(F.lit(DATE_FORMS[2]))
    return form, F.coalesce(*[F.when(form == f, F.try_to_timestamp(m, F.lit(f)).cast("date")) for f in DATE_FORMS])


def _date(m: Column, key: str, undo: bool) -> Column:
    form, day = _day(m)
    n = F.datediff(day, F.lit("1900-01-01").cast("date"))
    walk = _unfeistel if undo else feistel
    pair = walk(F.floor(n / DAYS[1]), n % DAYS[1], *DAYS, key, "date")

    def back(p: Column) -> Column:
        d = F.date_add(F.lit("1900-01-01").cast("date"), (p["l"] * DAYS[1] + p["r"]).cast("int"))
        return F.coalesce(*[F.when(form == f, F.date_format(d, f)) for f in DATE_FORMS])

    return F.transform(F.array(pair), back)[0]


def _shift(text: Column, noise_of: Column, key: str, kind: str, n: Column, hexadecimal: bool, undo: bool) -> Column:
    """Move each character within its class by a step that depends on the key and on ``noise_of``."""
    sign = -1 if undo else 1

    def one(i: Column) -> Column:
        c = F.substring(text, i, F.lit(1))
        step = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), n.cast("string"), i.cast("string"), noise_of).cast("binary"), 256), 1, 12), 16, 10).cast("long") * sign

        def within(alphabet: str) -> Column:
            at = F.instr(F.lit(alphabet), c) - 1
            return F.substring(F.lit(alphabet), (F.pmod(at + step, F.lit(len(alphabet))) + 1).cast("int"), F.lit(1))

        if hexadecimal:
            return within("0123456789abcdef")
        return (
            F.when(c.rlike("[0-9]"), within("0123456789")).when(c.rlike("[a-z]"), within("abcdefghijklmnopqrstuvwxyz")).when(c.rlike("[A-Z]"), within("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).otherwise(c)
        )

    return F.when(F.length(text) > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.length(text)), one), "")).otherwise(text)


def _permute_text(text: Column, key: str, kind: str, hexadecimal: bool, undo: bool) -> Column:
    """A Feistel network whose halves are strings; characters keep their class and place."""
    half = F.floor(F.length(text) / 2).cast("int")
    halves = F.struct(F.substring(text, F.lit(1), half).alias("l"), F.substring(text, half + 1, F.length(text)).alias("r"))

    def step(s: Column, n: Column) -> Column:
        even = n % 2 == 0
        return F.struct(
            F.when(even, _shift(s["l"], s["r"], key, kind, n, hexadecimal, undo)).otherwise(s["l"]).alias("l"),
            F.when(even, s["r"]).otherwise(_shift(s["r"], s["l"], key, kind, n, hexadecimal, undo)).alias("r"),
        )

    rounds = F.sequence(F.lit(0), F.lit(3))
    return F.aggregate(F.reverse(rounds) if undo else rounds, halves, step, lambda s: F.concat(s["l"], s["r"]))


def kind_of(m: Column) -> Column:
    """What a match of the pattern is, before validation."""
    return (
        F.when(m.contains("@"), F.lit("email"))
        .when(m.rlike(f"^{HEX}$"), F.lit("secret"))
        .when(m.rlike(f"^(?:{DATE})$"), F.lit("date"))
        .when(m.rlike(f"^(?:{ADDRESS})$"), F.lit("address"))
        .when(m.rlike(f"^(?:{SSN})$"), F.lit("ssn"))
        .when(m.rlike(f"^(?:{PHONE})$"), F.lit("phone"))
        .otherwise(F.lit("card"))
    )


def is_valid(m: Column) -> Column:
    """Whether a match of the pattern is a value of its kind."""
    kind, digits = kind_of(m), _digits(m)
    octets = F.split(m, r"\.")
    area, group, serial = (F.split(m, "-")[i].cast("long") for i in range(3))
    code, exchange, _ = _phone_parts(m)
    return (
        F.when(kind.isin("email", "secret"), F.lit(True))
        .when(kind == "date", _day(m)[1].isNotNull())
        .when(kind == "address", F.forall(octets, lambda x: (x.cast("long") < 256) & (x == x.cast("long").cast("string"))))
        .when(kind == "ssn", (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0))
        .when(kind == "phone", m.rlike("[+(]") | ((code >= 200) & (exchange >= 200)))
        .otherwise(_luhn_sum(digits, False) % 10 == 0)
    )


def pseudonym(m: Column, key: str, undo: bool = False) -> Column:
    """The pseudonym of one match, which is the match itself if that is not valid; ``undo`` gives the value back."""
    local, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    kind = kind_of(m)
    secret = _permute_text(F.lower(m), key, "secret", True, undo)
    return (
        F.when(~is_valid(m), m)
        .when(kind == "email", F.concat(_permute_text(local, key, "email", False, undo), F.lit("@"), domain))
        .when(kind == "secret", F.when(m.rlike("[A-F]"), F.upper(secret)).otherwise(secret))
        .when(kind == "date", _date(m, key, undo))
        .when(kind == "address", _address(m, key, undo))
        .when(kind == "ssn", _ssn(m, key, undo))
        .when(kind == "phone", _phone(m, key, undo))
        .otherwise(_card(m, key, undo))
    )


def session_key(spark: SparkSession) -> str:
    """The configured key, else one drawn for this session."""
    key = spark.conf.get(KEY_SETTING, None) or os.environ.get(KEY_VARIABLE)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, key)
    return key


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", counts: bool = False, undo: bool = False) -> DataFrame:
    """Replace personal data in ``text_col``; all other columns stay. ``counts`` adds ``pii_found``, the number of valid values."""
    if not key:
        raise ValueError("pseudonyms need a key")
    t = F.col(text_col)
    found, made = "__pii_found", "__pii_made"
    any_at_all = t.rlike("[0-9@]")
    df = docs.withColumn(found, F.when(any_at_all, F.regexp_extract_all(t, F.lit(f"(?:{PATTERN})"), F.lit(0))))
    df = df.withColumn(made, F.transform(F.col(found), lambda m: pseudonym(m, key, undo)))
    joined = F.array_join(F.zip_with(F.split(t, PATTERN, -1), F.col(made), lambda between, value: F.concat(between, F.coalesce(value, F.lit("")))), "")
    df = df.withColumn(text_col, F.when(F.size(F.col(found)) > 0, joined).otherwise(t))
    if counts:
        df = df.withColumn("pii_found", F.coalesce(F.size(F.filter(F.col(found), is_valid)), F.lit(0)).cast("long"))
    return df.drop(found, made)
