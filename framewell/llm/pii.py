"""Pseudonyms for personal data that keep each value's format, as DataFrame expressions only.

Card numbers, phone numbers, IPv4 addresses, social security numbers, dates and e-mail addresses are found with
one pattern, validated (Luhn sum, number ranges, calendar), and permuted by a keyed Feistel network over the
value's own digits: each position has its radix, the positions are cut into two halves, and every round adds a
keyed digest of one half to the other, position by position. That is a bijection of the format's domain, so equal
values get equal pseudonyms in all documents and different values stay different. Separators, lengths and the
leading card digit stay; the card check digit is computed anew, so a pseudonym is valid again.

Defined results: a null text stays null with counts of 0; a text without findings is returned unchanged;
candidates that fail validation are left as they are. Every input row gives one output row, repeated rows and null ids
included; an empty table gives an empty one; clashing input column names are ignored, as only the id and the text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns, by kind. An address is tried only where a word begins and a number only at a digit, bracket or
#: plus sign, so matching stays linear in the text.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}",
    "card": r"(?<![\d.])[3-6](?:\d{12,18}|\d{3}(?:[ -]\d{4}){3})(?![\d])",
    "phone": r"(?<![\d.])(?:\+1[ .-]?)?\(?[2-9]\d{2}\)?[ .-]?[2-9]\d{2}[ .-]\d{4}(?!\d)",
    "ssn": r"(?<![\d.-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "date": r"(?<![\d./-])\d{4}([-/.])\d{2}\1\d{2}(?![\d])",
    "ip": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d])",
}
KINDS = tuple(PATTERNS)
_MARK, _KEPT, _FROM, _TO = "\u0001", "\u0001\u0002", "\u0001\u0003", "\u0001\u0004"
#: Days from 1900-01-01 to 2099-12-31 are 17 * 4297, which gives two radices.
_DAY_RADIX = (17, 4297)


def let(value: Column, body) -> Column:
    """body(value), with value worked out once: an expression that a lambda names is otherwise run for each use."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def feistel(digits: Column, radices: Column, key: str, tweak: Column, rounds: int = 8) -> Column:
    """Keyed permutation of digits (each below its radix). A single digit is shifted by the key alone."""
    n = F.size(radices)
    half = F.floor(n / 2).cast("int")

    def step(state: Column, i: Column) -> Column:
        even = i % 2 == 0
        rest = F.array_join(F.when(even, F.slice(state, half + 1, n - half)).otherwise(F.slice(state, 1, half)).cast("array<string>"), ",")

        def moved(x: Column, j: Column, other: Column) -> Column:
            digest = F.sha2(F.concat_ws("|", F.lit(key), tweak, i.cast("string"), j.cast("string"), other), 256)
            add = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
            return F.when((j < half) == even, (x + add) % F.get(radices, j)).otherwise(x)

        return let(rest, lambda other: F.transform(state, lambda x, j: moved(x, j, other)))

    return F.reduce(F.sequence(F.lit(0), F.lit(rounds - 1)), digits, step)


def _chars(x: Column) -> Column:
    return F.split(x, "(?!^)(?=.)")


def _numbers(x: Column) -> Column:
    return F.transform(_chars(x), lambda c: c.try_cast("long"))


def _fill(shape: Column, digits: Column) -> Column:
    """Put digits in the place of the digits of shape, in order."""

    def put(d: Column) -> Column:
        return F.reduce(
            _chars(shape),
            F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
            lambda s, c: F.when(c.rlike(r"\d"), F.struct(F.concat(s["out"], F.substr(d, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at"))),
        )["out"]

    return let(F.array_join(digits.cast("array<string>"), ""), put)


def _luhn(body: Column) -> Column:
    """Check digit for an array of digits."""
    n = F.size(body)
    total = F.reduce(F.transform(body, lambda d, i: F.when((n - i) % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)), F.lit(0).cast("long"), lambda a, d: a + d)
    return (10 - total % 10) % 10


def _card(v: Column, key: str) -> Column:

    def renamed(d: Column) -> Column:
        n = F.size(d)
        inner = F.slice(d, F.lit(2), n - 2)
        new = F.concat(F.slice(d, 1, 1), feistel(inner, F.transform(inner, lambda _: F.lit(10).cast("long")), key, F.lit("card")))
        return F.when(let(F.slice(d, F.lit(1), n - 1), _luhn) == F.element_at(d, -1), let(new, lambda x: _fill(v, F.concat(x, F.array(_luhn(x))))))

    return let(_numbers(F.regexp_replace(v, r"\D", "")), renamed)


def _phone(v: Column, key: str) -> Column:
    lead = F.regexp_extract(v, r"^\+1[ .-]?", 0)
    rest = F.regexp_replace(v, r"^\+1[ .-]?", "")
    d = _numbers(F.regexp_replace(rest, r"\D", ""))
    shift = F.array(*[F.lit(2 if i in (0, 3) else 0).cast("long") for i in range(10)])
    radix = F.array(*[F.lit(8 if i in (0, 3) else 10).cast("long") for i in range(10)])
    new = F.zip_with(feistel(F.zip_with(d, shift, lambda a, b: a - b), radix, key, F.lit("phone")), shift, lambda a, b: a + b)
    return F.when(F.size(d) == 10, F.concat(lead, _fill(rest, new)))


def _ip(v: Column, key: str) -> Column:
    d = F.transform(F.split(v, r"\."), lambda x: x.try_cast("long"))
    new = feistel(d, F.transform(d, lambda _: F.lit(256).cast("long")), key, F.lit("ip"))
    return F.when(F.forall(d, lambda x: x < 256) & (v.rlike(r"^(0|[1-9]\d*)(\.(0|[1-9]\d*)){3}$")), F.array_join(new.cast("array<string>"), "."))


def _ssn(v: Column, key: str) -> Column:
    p = F.transform(F.split(v, "-"), lambda x: x.try_cast("long"))
    area, group, serial = (F.get(p, F.lit(i)) for i in range(3))
    ok = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    d = F.array(area - 1 - (area > 666).cast("long"), group - 1, serial - 1)
    new = feistel(d, F.array(*[F.lit(x).cast("long") for x in (898, 99, 9999)]), key, F.lit("ssn"))

    def shown(x: Column) -> Column:
        at = F.get(x, F.lit(0)) + 1
        return F.concat_ws("-", F.lpad((at + (at >= 666).cast("long")).cast("string"), 3, "0"), F.lpad((F.get(x, F.lit(1)) + 1).cast("string"), 2, "0"), F.lpad((F.get(x, F.lit(2)) + 1).cast("string"), 4, "0"))

    return F.when(ok, let(new, shown))


def _date(v: Column, key: str) -> Column:
    sep = F.substring(v, 5, 1)
    day = F.try_to_date(F.translate(v, "/.", "--"), "yyyy-MM-dd")
    first = F.lit("1900-01-01").cast("date")
    a, b = _DAY_RADIX

    def moved(n: Column) -> Column:
        new = feistel(F.array(F.floor(n / b).cast("long"), n % b), F.array(F.lit(a).cast("long"), F.lit(b).cast("long")), key, F.lit("date"))
        at = let(new, lambda x: F.date_add(first, (F.get(x, F.lit(0)) * b + F.get(x, F.lit(1))).cast("int")))
        return F.when((n >= 0) & (n < a * b), let(at, lambda x: F.concat_ws("", F.date_format(x, "yyyy"), sep, F.date_format(x, "MM"), sep, F.date_format(x, "dd"))))

    return let(F.datediff(day, first).cast("long"), moved)


def _email(v: Column, key: str) -> Column:
    """The local part's letters and digits move within their kind; the domain is part of the key, so it stays."""
    local, domain = F.substring_index(v, "@", 1), F.lower(F.substring_index(v, "@", -1))
    alphabet = lambda c: F.when(c.rlike("[0-9]"), F.lit("0123456789")).when(c.rlike("[a-z]"), F.lit("abcdefghijklmnopqrstuvwxyz")).when(c.rlike("[A-Z]"), F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).otherwise(c)
    sets = F.transform(_chars(local), alphabet)
    d = F.transform(_chars(local), lambda c: F.position(c, alphabet(c)).cast("long") - 1)
    new = feistel(d, F.transform(sets, lambda s: F.length(s).cast("long")), key, F.concat(F.lit("email"), domain))
    return F.concat(F.array_join(F.zip_with(sets, new, lambda s, i: F.substr(s, (i + 1).cast("int"), F.lit(1))), ""), F.substring(v, F.length(local) + 1, F.length(v)))


_RULES = {"email": _email, "card": _card, "phone": _phone, "ssn": _ssn, "date": _date, "ip": _ip}


def pseudonymize(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text with pseudonyms, found (kind and pseudonym of each value, in order) and n_<kind> for each kind.

    key: a secret; who has it can undo the pseudonyms.
    """
    if not key:
        raise ValueError("a key is needed")
    text = F.col(text_col).cast("string")
    numbers = "|".join(PATTERNS[k] for k in KINDS if k != "email")
    pattern = f"(?<![A-Za-z0-9._%+-]){PATTERNS['email']}|(?=[+(0-9])(?:{numbers})"
    marked = F.regexp_replace(F.replace(text, F.lit(_MARK), F.lit(_KEPT)), f"(?:{pattern})", f"{_FROM}$0{_TO}")
    parts = F.split(marked, f"{_MARK}[\u0003\u0004]")

    def piece(v: Column, i: Column) -> Column:
        kind = F.lit(None).cast("string")
        for k in reversed(KINDS):
            kind = F.when(v.rlike(f"^(?:{PATTERNS[k]})$"), F.lit(k)).otherwise(kind)
        kind = F.when(i % 2 == 1, kind)
        return F.struct(kind.alias("kind"), v.alias("text"))

    def renamed(p: Column) -> Column:
        new = F.lit(None).cast("string")
        for k in KINDS:
            new = F.when(p["kind"] == k, _RULES[k](p["text"], key)).otherwise(new)
        return F.struct(p["kind"].alias("kind"), p["text"].alias("text"), new.alias("new"))

    touched = text.rlike("[0-9@]")
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.when(touched, F.transform(F.transform(parts, piece), renamed)).alias("parts"))
    joined = F.replace(F.array_join(F.transform("parts", lambda p: F.coalesce(p["new"], p["text"])), ""), F.lit(_KEPT), F.lit(_MARK))
    found = F.coalesce(F.transform(F.filter("parts", lambda p: p["new"].isNotNull()), lambda p: F.struct(p["kind"].alias("kind"), p["new"].alias("value"))), F.array().cast("array<struct<kind:string,value:string>>"))
    out = rows.select("id", F.coalesce(joined, F.col("text")).alias("text"), found.alias("found"))
    count = lambda k: F.size(F.filter("found", lambda f: f["kind"] == k)).cast("long")
    counts = [count(k).alias(f"n_{k}") for k in KINDS]
    return out.select(F.col("id").alias(id_col), "text", "found", *counts)
