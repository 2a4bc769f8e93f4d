"""Personal data: format-preserving pseudonyms by a keyed Feistel network.

Validated values are permuted within their format, by a key: card numbers (13 to 19 digits, or four
groups of four, with a right check digit), phone numbers, social security numbers, IPv4 addresses and
dates (ISO, or day/month/year, of 1600 to 2399).  The network works on a pair of numbers (a modulo A,
b modulo B) whose combinations are exactly the valid values of the format, so every pseudonym is
valid, different values stay different, and equal values stay linked across documents.  E-mail names
and 40-digit hexadecimal tokens are replaced by keyed digests in their format.  What looks like a
number but fails its check is left alone.

Nothing is shuffled and no state is kept: a value's pseudonym depends on the value and the key.  Only
DataFrame functions run on the executors.  Defined results: a null text stays null with no findings;
an empty text stays empty; all other columns are untouched.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

ROUNDS = 10
OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
FIRST_DAY, DAYS_A, DAYS_B = "1600-01-01", 378, 773  # 378 x 773 days are the 800 years up to 2399


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    pseudonym: Callable[[Column, Column], Column]  # of a match and a key; null if it is not valid


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _draw(key: Column, name: str, turn: Column, value: Column, modulus: Column) -> Column:
    """Pseudo-random number below the modulus from 60 bits of a keyed digest."""
    digest = F.sha2(F.concat_ws(":", key, F.lit(name), turn.cast("string"), value.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % modulus


def feistel(key: Column, name: str, a: Column, b: Column, size_a: Column, size_b: Column) -> Column:
    """Struct (a, b): a permutation of all pairs, each half shifted in turn by a draw from the other."""
    def turn(state: Column, number: Column) -> Column:
        new_a = (state["a"] + _draw(key, name, number, state["b"], size_a)) % size_a
        new_b = (state["b"] + _draw(key, name, number, state["a"], size_b)) % size_b
        even = number % 2 == 0
        return F.struct(F.when(even, new_a).otherwise(state["a"]).alias("a"),
                        F.when(even, state["b"]).otherwise(new_b).alias("b"))

    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("long")


def _digits(key: Column, name: str, digits: Column) -> Column:
    """Permutation of the digit strings of one length, 2 to 18."""
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    sizes = F.struct(half.alias("a"), (n - half).alias("b"),
                     _power(half).alias("size_a"), _power(n - half).alias("size_b"))

    def permuted(s: Column) -> Column:
        at = F.call_function("left", digits, s["a"]).cast("long")
        rest = F.call_function("right", digits, s["b"]).cast("long")
        pad = lambda value, width: F.call_function("lpad", value.cast("string"), width, F.lit("0"))
        return _let(feistel(key, name, at, rest, s["size_a"], s["size_b"]),
                    lambda out: F.concat(pad(out["a"], s["a"]), pad(out["b"], s["b"])))

    return _let(sizes, permuted)


def luhn_sum(digits: Column, last_doubled: bool) -> Column:
    """Sum of the digits, every second one doubled, counted from the end."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2)
        return total + F.when((n - i) % 2 == (0 if last_doubled else 1), twice).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def _format(match: Column, digits: Column) -> Column:
    """The digits in the places that the match has digits in."""
    chars = F.split(match, "", -1)
    placed = F.aggregate(
        chars, F.struct(F.lit("").alias("out"), F.lit(1).alias("next")),
        lambda s, c: F.when(c.rlike("^[0-9]$"), F.struct(
            F.concat(s["out"], F.substring(digits, s["next"], F.lit(1))).alias("out"),
            (s["next"] + 1).alias("next"))).otherwise(
            F.struct(F.concat(s["out"], c).alias("out"), s["next"].alias("next"))))
    return placed["out"]


def _only_digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _card(match: Column, key: Column) -> Column:
    def checked(new: Column) -> Column:
        check = ((10 - luhn_sum(new, True) % 10) % 10).cast("string")
        return _let(F.concat(new, check), lambda whole: _format(match, whole))

    def permuted(digits: Column) -> Column:
        body = F.call_function("left", digits, F.length(digits) - 1)
        new = _let(body, lambda b: _digits(key, "card", b))
        return F.when(luhn_sum(digits, False) % 10 == 0, _let(new, checked))

    return _let(_only_digits(match), permuted)


def _phone(match: Column, key: Column) -> Column:
    new = _let(F.substring(_only_digits(match), 2, 10), lambda digits: _digits(key, "phone", digits))
    return _let(F.concat(F.lit("1"), new), lambda whole: _format(match, whole))


def _ssn(match: Column, key: Column) -> Column:
    """Areas 001 to 899 but 666, groups from 01, serials from 0001."""
    area, group, serial = (F.substring(match, a, n).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    a = area - 1 - F.when(area > 666, 1).otherwise(0)

    def written(out: Column) -> Column:
        new_area = out["a"] + 1 + F.when(out["a"] + 1 >= 666, 1).otherwise(0)
        parts = ((new_area, 3), (F.floor(out["b"] / 9999) + 1, 2), (out["b"] % 9999 + 1, 4))
        return F.concat_ws("-", *[F.lpad(v.cast("string"), n, "0") for v, n in parts])

    b = (group - 1) * 9999 + serial - 1
    return F.when(valid, _let(feistel(key, "ssn", a, b, F.lit(898), F.lit(99 * 9999)), written))


def _ip(match: Column, key: Column) -> Column:
    octet = lambda i: F.split_part(match, F.lit("."), F.lit(i)).cast("int")
    out = feistel(key, "ip", octet(1) * 256 + octet(2), octet(3) * 256 + octet(4),
                  F.lit(65536), F.lit(65536))
    high, low = (lambda v: F.floor(v / 256)), (lambda v: v % 256)
    return _let(out, lambda o: F.concat_ws(".", *[v.cast("long").cast("string") for v in (
        high(o["a"]), low(o["a"]), high(o["b"]), low(o["b"]))]))


def _day(key: Column, day: Column) -> Column:
    first = F.lit(FIRST_DAY).cast("date")
    number = F.datediff(day, first)
    out = feistel(key, "date", F.floor(number / DAYS_B), number % DAYS_B, F.lit(DAYS_A), F.lit(DAYS_B))
    valid = (number >= 0) & (number < DAYS_A * DAYS_B)
    new = _let(out, lambda o: F.date_add(first, (o["a"] * DAYS_B + o["b"]).cast("int")))
    return F.when(valid, new)


def _iso_date(match: Column, key: Column) -> Column:
    return F.date_format(_let(match.try_cast("date"), lambda day: _day(key, day)), "yyyy-MM-dd")


def _slash_date(match: Column, key: Column) -> Column:
    part = lambda i: F.split_part(match, F.lit("/"), F.lit(i))
    given = F.concat_ws("-", part(3), part(2), part(1)).try_cast("date")
    return F.date_format(_let(given, lambda day: _day(key, day)), "dd/MM/yyyy")


def _keyed(key: Column, name: str, value: Column) -> Column:
    return F.sha2(F.concat_ws(":", key, F.lit(name), value), 256)


def _email(match: Column, key: Column) -> Column:
    name, host = F.split_part(match, F.lit("@"), F.lit(1)), F.split_part(match, F.lit("@"), F.lit(2))
    return F.concat(F.lit("u"), F.substring(_keyed(key, "email", F.lower(name)), 1, 16), F.lit("@"), host)


def _token(match: Column, key: Column) -> Column:
    new = F.substring(_keyed(key, "token", F.lower(match)), 1, 40)
    return F.when(match.rlike("[A-F]"), F.upper(new)).otherwise(new)


#: In order: where two could start at one place, the first is tried first.
KINDS = (
    Kind("email", r"(?<![\p{L}0-9._%+-])[\p{L}0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", _email),
    Kind("token", r"(?<![0-9A-Za-z])[0-9a-fA-F]{40}(?![0-9A-Za-z])", _token),
    Kind("phone", r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}(?![0-9])", _phone),
    Kind("ip", rf"(?<![0-9.]){OCTET}(?:\.{OCTET}){{3}}(?![0-9]|\.[0-9])", _ip),
    Kind("iso_date", r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])", _iso_date),
    Kind("slash_date", r"(?<![0-9/])[0-9]{2}/[0-9]{2}/[0-9]{4}(?![0-9/])", _slash_date),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", _ssn),
    Kind("grouped_card", r"(?<![0-9-])[0-9]{4}(?:[ -][0-9]{4}){3}(?![0-9-])", _card),
    Kind("card", r"(?<![0-9])[0-9]{13,19}(?![0-9])", _card),
)
PATTERN = "|".join(kind.pattern for kind in KINDS)
#: What every match contains; texts without it need no further search.
SIGN = "[0-9@]|[a-fA-F]{40}"


def pseudonym(match: Column, key: Column) -> Column:
    """Pseudonym of one match; null if it is not a valid value of its format."""
    out = None
    for kind in KINDS:
        test = match.rlike(f"^(?:{kind.pattern})$")
        out = F.when(test, kind.pseudonym(match, key)) if out is None else out.when(
            test, kind.pseudonym(match, key))
    return out


def pseudonymized(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` as a struct ``row``, with (new_text, found, replaced): the text with its personal data
    replaced, the values that look like some, and how many of them were valid and replaced."""
    secret = F.lit(key)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       F.col("text").alias("old_text"))
    rows = rows.withColumn("found", F.when(
        F.col("old_text").rlike(SIGN), F.regexp_extract_all("old_text", F.lit(PATTERN), F.lit(0))
    ).otherwise(F.array().cast("array<string>")))
    new = F.transform("found", lambda m: pseudonym(m, secret))
    rows = rows.withColumn("new", F.when(F.size("found") > 0, new).otherwise(F.array().cast("array<string>")))
    put = F.zip_with("found", "new", lambda m, p: F.coalesce(p, m))
    whole = F.array_join(F.zip_with(
        F.split("old_text", PATTERN, -1), put, lambda gap, value: F.concat(gap, F.coalesce(value, F.lit("")))), "")
    return rows.select(
        "row", F.when(F.size("found") > 0, whole).otherwise(F.col("old_text")).alias("new_text"), "found",
        F.size(F.filter("new", lambda p: p.isNotNull())).cast("long").alias("replaced"))
