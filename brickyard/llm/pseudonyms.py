"""Format-preserving pseudonyms: a keyed Feistel permutation of validated numbers and dates.

Column expressions only. Each found value is checked (Luhn for cards, octets for addresses,
area and group for social security numbers, digits for phone numbers, the calendar for dates),
mapped to a number of its own domain, permuted there by a Feistel network over two mixed-radix
halves whose round function is SHA-256 of key, kind, round and half, and written back with the
signs of the original. Equal values get equal pseudonyms in every document; the same key undoes
it. What fails its check stays as it is.

- card: the first digit stays, the others are permuted, the check digit is made anew;
- phone: the country calling code stays, the other digits are permuted; (ddd) ddd-dddd and
  ddd-ddd-dddd are numbers without a code;
- address: the 32 bits are permuted; - social security: valid numbers among themselves;
- date (y-m-d, d.m.y, d/m/y): days among the days of the same century.

Defined results: null stays null with counts of 0, empty stays empty. Rows are independent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
KINDS = ("card", "phone", "address", "ssn", "date")

_EDGE = r"(?<![0-9A-Za-z._+-])"
_STOP = r"(?![0-9A-Za-z]|[.-][0-9])"
PATTERNS = {
    "date": r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}([./])[0-9]{1,2}\1[0-9]{4}",
    "address": r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "phone": r"\+[0-9]{1,3}[ -]?\(?[0-9]{1,4}\)?(?:[ -]?\(?[0-9]{2,4}\)?){1,3}|\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}",
    "card": r"[0-9](?:[ -]?[0-9]){12,18}",
}
ANY = _EDGE + "(?:" + "|".join(p.replace(r"([./])", "[./]").replace(r"\1", "[./]")
                               for p in PATTERNS.values()) + ")" + _STOP


def _long(c: Column) -> Column:
    return c.cast("bigint")


def _feistel(value: Column, left: Column, right: Column, key: str, kind: str, undo: bool) -> Column:
    """Permute 0 <= value < left * right."""
    def f(step: Column, half: Column) -> Column:
        seed = F.concat_ws("|", F.lit(key), F.lit(kind), left.cast("string"), right.cast("string"),
                           step.cast("string"), half.cast("string"))
        return _long(F.conv(F.substring(F.sha2(seed, 256), 1, 15), 16, 10))

    start = F.struct(_long((value - F.pmod(value, right)) / right).alias("a"),
                     F.pmod(value, right).alias("b"))
    rounds = F.sequence(F.lit(1), F.lit(ROUNDS)) if not undo else F.sequence(
        F.lit(ROUNDS), F.lit(1), F.lit(-1))
    sign = F.lit(-1 if undo else 1)

    def step(acc: Column, r: Column) -> Column:
        odd = r % 2 == 1
        a = F.when(odd, F.pmod(acc["a"] + sign * F.pmod(f(r, acc["b"]), left), left)).otherwise(acc["a"])
        b = F.when(~odd, F.pmod(acc["b"] + sign * F.pmod(f(r, acc["a"]), right), right)).otherwise(acc["b"])
        return F.struct(a.alias("a"), b.alias("b"))

    return F.aggregate(rounds, start, step, lambda acc: acc["a"] * right + acc["b"])


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column, shift: int) -> Column:
    """Luhn sum; ``shift`` 0 if the last digit is the check digit, 1 if it is still missing."""
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = (n - i + shift) % 2 == 1
        return acc + F.when(twice, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def _refill(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced, one after the other."""
    def add(acc: Column, i: Column) -> Column:
        c = F.substring(shape, i, F.lit(1))
        is_digit = c.between("0", "9")
        return F.struct(F.concat(acc["s"], F.when(is_digit, F.substring(digits, acc["n"], F.lit(1)))
                                 .otherwise(c)).alias("s"),
                        (acc["n"] + F.when(is_digit, 1).otherwise(0)).alias("n"))

    return F.aggregate(F.sequence(F.lit(1), F.length(shape)),
                       F.struct(F.lit("").alias("s"), F.lit(1).alias("n")), add, lambda a: a["s"])


def _permuted_digits(digits: Column, key: str, kind: str, undo: bool) -> Column:
    """Digits of up to 18 places among all of the same length."""
    n = F.length(digits)
    right = _long(F.pow(F.lit(10.0), F.floor((n + 1) / 2)))
    left = _long(F.pow(F.lit(10.0), F.floor(n / 2)))
    return F.lpad(_feistel(_long(digits), left, right, key, kind, undo).cast("string"), n, "0")


def _card(m: Column, key: str, undo: bool) -> tuple[Column, Column]:
    d = _digits(m)
    body = F.concat(F.substring(d, 1, 1), _permuted_digits(
        F.substring(d, F.lit(2), F.length(d) - 2), key, "card", undo))
    check = F.pmod(-_luhn(body, 1), F.lit(10)).cast("string")
    return _luhn(d, 0) % 10 == 0, _refill(m, F.concat(body, check))


# Country calling codes of one and of two digits; all others have three.
_CODE_1, _CODE_2 = r"^\+[17]", r"^\+(?:2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"


def _phone(m: Column, key: str, undo: bool) -> tuple[Column, Column]:
    """The code is told by its digits alone, so a number's spellings share their national digits.

    A number without a code is the national number of its ten digits.
    """
    code = F.when(~m.startswith("+"), 0).when(m.rlike(_CODE_1), 2).when(m.rlike(_CODE_2), 3).otherwise(4)
    head = F.substring(m, F.lit(1), code)
    rest = F.substring(m, code + 1, F.length(m))
    d = _digits(rest)
    return (F.length(d).between(6, 14),
            F.concat(head, _refill(rest, _permuted_digits(d, key, "phone", undo))))


def _address(m: Column, key: str, undo: bool) -> tuple[Column, Column]:
    octets = F.transform(F.split(m, r"\."), _long)
    value = F.aggregate(octets, _long(F.lit(0)), lambda a, x: a * 256 + x)
    new = _feistel(value, _long(F.lit(65536)), _long(F.lit(65536)), key, "address", undo)
    parts = [F.pmod(F.shiftright(new, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0)]
    return F.forall(octets, lambda x: x < 256), F.concat_ws(".", *parts)


def _ssn(m: Column, key: str, undo: bool) -> tuple[Column, Column]:
    area, group, serial = (_long(x) for x in (F.substring(m, 1, 3), F.substring(m, 5, 2),
                                              F.substring(m, 8, 4)))
    slot = area - 1 - F.when(area > 666, 1).otherwise(0)
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    new = _feistel((slot * 99 + group - 1) * 9999 + serial - 1, _long(F.lit(898 * 99)),
                   _long(F.lit(9999)), key, "ssn", undo)
    s = F.pmod(new, F.lit(9999)) + 1
    high = _long((new - F.pmod(new, F.lit(9999))) / 9999)
    g = F.pmod(high, F.lit(99)) + 1
    a = _long((high - F.pmod(high, F.lit(99))) / 99) + 1
    a = a + F.when(a >= 666, 1).otherwise(0)
    pad = [F.lpad(x.cast("string"), n, "0") for x, n in ((a, 3), (g, 2), (s, 4))]
    return valid, F.concat_ws("-", *pad)


def _date(m: Column, key: str, undo: bool) -> tuple[Column, Column]:
    sign = F.regexp_extract(m, r"[./-]", 0)
    part = F.split(m, r"[./-]")
    iso = sign == "-"
    y = F.when(iso, part[0]).otherwise(part[2]).cast("int")
    d = F.when(iso, part[2]).otherwise(part[0]).cast("int")
    month = part[1].cast("int")
    padded = F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"),
                         F.lpad(d.cast("string"), 2, "0"))
    day = F.try_to_timestamp(padded, F.lit("yyyy-MM-dd")).cast("date")
    first = F.make_date((y - y % 100).cast("int"), F.lit(1), F.lit(1))
    days = F.datediff(F.make_date((y - y % 100 + 100).cast("int"), F.lit(1), F.lit(1)), first)
    leap = days == 36525
    new = _feistel(_long(F.datediff(day, first)), _long(F.when(leap, 75).otherwise(92)),
                   _long(F.when(leap, 487).otherwise(397)), key, "date", undo)
    moved = F.date_add(first, new.cast("int"))
    wide = iso | (F.length(m) == 10)
    out = F.when(iso, F.date_format(moved, "yyyy-MM-dd")).when(
        wide, F.concat(F.date_format(moved, "dd"), sign, F.date_format(moved, "MM"), sign,
                       F.date_format(moved, "yyyy"))).otherwise(
        F.concat(F.day(moved).cast("string"), sign, F.month(moved).cast("string"), sign,
                 F.date_format(moved, "yyyy")))
    return day.isNotNull() & y.between(1600, 9899), out


def _found(m: Column, key: str, undo: bool) -> Column:
    """(kind or null, pseudonym or the value itself) of one match."""
    out = None
    for kind, rule in (("date", _date), ("address", _address), ("ssn", _ssn), ("phone", _phone),
                       ("card", _card)):
        valid, new = rule(m, key, undo)
        hit = F.struct(F.when(valid, kind).alias("kind"), F.when(valid, new).otherwise(m).alias("value"))
        test = m.rlike("^(?:" + PATTERNS[kind] + ")$")
        out = F.when(test, hit) if out is None else out.when(test, hit)
    return out.otherwise(F.struct(F.lit(None).cast("string").alias("kind"), m.alias("value")))


def pseudonymised(docs: DataFrame, key: str, text_col: str = "text", undo: bool = False) -> DataFrame:
    """``docs`` with the text's values replaced, and n_<kind> counts of replaced values.

    Counts that have the name of a column of ``docs`` replace it.
    """
    names = [f"n_{k}" for k in KINDS]
    rest = [c for c in docs.columns if c not in names]
    text = F.col(text_col)
    found = F.when(text.rlike("[0-9]"), F.transform(
        F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), lambda m: _found(m, key, undo)))
    with_found = docs.select(*rest, found.alias("_found"))
    between = F.split(text, ANY, -1)
    joined = F.concat_ws("", F.flatten(F.zip_with(
        between, F.transform("_found", lambda x: x["value"]),
        lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))))
    has = F.coalesce(F.size("_found"), F.lit(0)) > 0

    def count(kind: str) -> Column:
        hits = F.filter("_found", lambda x: x["kind"] == kind)
        return F.coalesce(F.size(hits), F.lit(0)).cast("bigint").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    out = [F.when(has, joined).otherwise(text).alias(c) if c == text_col else F.col(c) for c in rest]
    return with_found.select(*out, *counts)


def pseudonyms(docs: DataFrame, key: str) -> DataFrame:
    """One row per document: doc_id, text with pseudonyms, counts by kind."""
    return pseudonymised(docs.select("doc_id", "text"), key)
