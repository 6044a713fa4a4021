"""Pseudonyms for personal data that keep the format, with DataFrame functions only.

Numbers and dates that pass validation (card numbers and IBANs by their check digits, social security
numbers and addresses by their ranges, dates by the calendar, phone numbers by their form alone, as
numbers in texts often have areas that don't exist) are permuted by a keyed
Feistel network within the set of valid values of their format. Equal values get equal pseudonyms in all
documents, different values different ones, and the key's holder can undo it. Mail addresses, which have
no fixed format, get a keyed hash in the form of an address.

The network alternates over two halves of any two sizes: l = (l + f(r)) mod a, then r = (r + f(l)) mod b,
with f taken from SHA-256 of key, kind, round and half.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8

#: Characters of an IBAN by country, from the registry.
IBAN_COUNTRIES = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST",
    26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD", 28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban_of(length: int, countries: str) -> str:
    groups, left = divmod(length - 4, 4)
    return f"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{groups}}}" + (f" ?[A-Z0-9]{{{left}}}" if left else "")


#: Patterns of what may be personal data; each match is then validated. Runs are entered at their start only.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9](?:[A-Za-z0-9.\-]*[A-Za-z0-9])?\.[A-Za-z]{2,}",
    # At its country's length, so that a word or number after it isn't taken for a part; else at any.
    "iban": r"(?<![A-Za-z0-9])(?=[A-Z]{2}[0-9]{2})(?:" + "|".join(_iban_of(n, c) + "(?![A-Za-z0-9])" for n, c in IBAN_COUNTRIES.items()) + r"|[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))",
    "phone": r"(?<![A-Za-z0-9+])\+1[ .\-]?(?:\([0-9]{3}\)|[0-9]{3})[ .\-]?[0-9]{3}[ .\-]?[0-9]{4}(?![A-Za-z0-9])|(?<![A-Za-z0-9])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![A-Za-z0-9])",
    "date": r"(?<![A-Za-z0-9./\-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![A-Za-z0-9/\-]|\.[0-9])",
    "ip": r"(?<![A-Za-z0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![A-Za-z0-9]|\.[0-9])",
    "ssn": r"(?<![A-Za-z0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9]|-[0-9])",
    "card": r"(?<![A-Za-z0-9.\-])(?:[0-9]{13,19}|[0-9]{4}(?: [0-9]{4}){3}|[0-9]{4}(?:-[0-9]{4}){3}|[0-9]{4} [0-9]{6} [0-9]{5}|[0-9]{4}-[0-9]{6}-[0-9]{5})(?![A-Za-z0-9]|[.\-][0-9])",
}
KINDS = tuple(PATTERNS)
ANY = "|".join(PATTERNS.values())

#: Dates from 1900-01-01 on that are permuted among each other: 340 x 215 days.
FIRST_DAY, DAYS = "1900-01-01", (340, 215)

#: Turns within which a date with its month first must come to a day after the twelfth; 4 in 10 need another turn.
WALK = 40


def _div(a: Column, b: Column) -> Column:
    """Whole quotient of numbers that aren't negative."""
    return ((a - F.pmod(a, b)) / b).cast("long")


def feistel(value: Column, a: int, b: int, key: str, kind: str, undo: bool = False) -> Column:
    """Permute whole numbers 0 .. a * b - 1, or undo it."""

    def f(half: Column, turn: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), turn, half).cast("binary"), 256)
        return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")

    sign = -1 if undo else 1
    left, right = F.lit(a).cast("long"), F.lit(b).cast("long")

    def step(s: Column, turn: Column) -> Column:
        on_left = F.struct(F.pmod(s["l"] + f(s["r"], turn) % left * sign, left).alias("l"), s["r"].alias("r"))
        on_right = F.struct(s["l"].alias("l"), F.pmod(s["r"] + f(s["l"], turn) % right * sign, right).alias("r"))
        return F.when(turn % 2 == 1, on_left).otherwise(on_right)

    start = F.struct(_div(value, right).alias("l"), F.pmod(value, right).alias("r"))
    turns = F.sequence(F.lit(ROUNDS), F.lit(1)) if undo else F.sequence(F.lit(1), F.lit(ROUNDS))
    return F.aggregate(turns, start, step, lambda s: s["l"] * right + s["r"])


def _bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _refill(form: Column, digits: Column) -> Column:
    """``form`` with its digits replaced, from left to right, by ``digits``."""
    letters = F.split(form, "")
    steps = F.aggregate(
        letters,
        F.struct(F.lit("").alias("out"), F.lit(0).alias("n")),
        lambda s, c: F.when(c.between("0", "9") & (F.length(c) == 1), F.struct(F.concat(s["out"], F.substr(digits, s["n"] + 1, F.lit(1))).alias("out"), (s["n"] + 1).alias("n"))).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["n"].alias("n"))),
    )
    return steps["out"]


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a digit string; a valid number's is divisible by ten."""
    each = F.transform(F.reverse(F.filter(F.split(digits, ""), lambda c: c != "")), lambda c, k: F.when(k % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda s, x: s + x)


def _card(match: Column, key: str, undo: bool) -> Column:
    def permuted(d: Column) -> Column:
        # All but the check digit: halves of digits, each below 10^9.
        out = None
        for n in range(13, 20):
            low = (n - 1) // 2
            body = F.substring(d, 1, n - 1).cast("long")
            moved = F.lpad(feistel(body, 10 ** (n - 1 - low), 10**low, key, f"card{n}", undo).cast("string"), n - 1, "0")
            whole = _bind(moved, lambda m: F.concat(m, F.pmod(F.lit(10) - luhn_sum(F.concat(m, F.lit("0"))) % 10, F.lit(10)).cast("string")))
            out = F.when(F.length(d) == n, whole) if out is None else out.when(F.length(d) == n, whole)
        return out

    return _bind(_digits(match), lambda d: F.when(luhn_sum(d) % 10 == 0, _refill(match, permuted(d))))


def _phone(match: Column, key: str, undo: bool) -> Column:
    """The last ten digits change, a leading country code stays."""

    def permuted(d: Column) -> Column:
        ten = F.right(d, F.lit(10)).cast("long")
        moved = F.lpad(feistel(ten, 100_000, 100_000, key, "phone", undo).cast("string"), 10, "0")
        return F.concat(F.substr(d, F.lit(1), F.length(d) - 10), moved)

    return _bind(_digits(match), lambda d: _refill(match, permuted(d)))


def _ssn(match: Column, key: str, undo: bool) -> Column:
    """Areas 001-899 without 666, groups and serials other than zero."""
    part = lambda i: F.element_at(F.split(match, "-"), i).cast("long")
    area, group, serial = part(1), part(2), part(3)
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    index = ((area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1) * 9999 + serial - 1
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")

    def write(v: Column) -> Column:
        place = _div(v, F.lit(99 * 9999))
        back = place + F.when(place >= 665, 2).otherwise(1)
        return F.concat_ws("-", pad(back, 3), pad(_div(v, F.lit(9999)) % 99 + 1, 2), pad(v % 9999 + 1, 4))

    return F.when(valid, _bind(feistel(index, 898 * 99, 9999, key, "ssn", undo), write))


def _ip(match: Column, key: str, undo: bool) -> Column:
    part = lambda i: F.element_at(F.split(match, r"\."), i).cast("long")
    valid = F.greatest(*map(part, range(1, 5))) <= 255
    index = part(1) * 2**24 + part(2) * 2**16 + part(3) * 2**8 + part(4)
    write = lambda v: F.concat_ws(".", *(F.shiftright(v, 8 * k).bitwiseAND(F.lit(255)) for k in (3, 2, 1, 0)))
    return F.when(valid, _bind(feistel(index, 2**16, 2**16, key, "ip", undo), write))


def _date(match: Column, key: str, undo: bool) -> Column:
    """Day before month where both read as a date; values outside the permuted days stay.

    Dates that read with the month first only are permuted among each other, so they read so afterwards too.
    """
    first = F.to_date(F.lit(FIRST_DAY))
    moved = lambda index: feistel(index, *DAYS, key, "date", undo)
    day_of = lambda index: F.date_add(first, index.cast("int"))

    def walked(index: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(2), F.lit(WALK)), moved(index), lambda s, _: F.when(F.dayofmonth(day_of(s)) <= 12, moved(s)).otherwise(s))

    def case_of(form: str, move) -> tuple[Column, Column]:
        day = F.try_to_timestamp(match, F.lit(form)).cast("date")
        index = F.datediff(day, first).cast("long")
        return F.when(index.between(0, DAYS[0] * DAYS[1] - 1), F.date_format(day_of(move(index)), form)), day

    out = None
    for form, shape in (("yyyy-MM-dd", "-"), ("dd/MM/yyyy", "/"), ("dd.MM.yyyy", ".")):
        value, day = case_of(form, moved)
        if shape == "/":
            value = F.when(day.isNotNull(), value).otherwise(case_of("MM/dd/yyyy", walked)[0])
        case = F.contains(match, F.lit(shape))
        out = F.when(case, value) if out is None else out.when(case, value)
    return out


def _iban_remainder(text: Column) -> Column:
    """A rearranged IBAN as a number, modulo 97; letters count from 10."""
    one = lambda s, c: F.pmod(s * F.when(F.call_function("rlike", c, F.lit("[A-Z]")), 100).otherwise(10) + F.call_function("locate", c, F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ")) - 1, F.lit(97))
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), one)


def _iban(match: Column, key: str, undo: bool) -> Column:
    """The last up to sixteen digits of the account part change, and the check digits follow."""
    plain = F.regexp_replace(match, " ", "")

    def moved(p: Column) -> Column:
        body = F.substr(p, F.lit(5), F.length(p) - 4)
        digits = _digits(body)
        n = F.least(F.length(digits), F.lit(16))
        tail = F.right(digits, n)
        out = None
        for k in range(2, 17):
            low = k // 2
            new = F.lpad(feistel(tail.cast("long"), 10 ** (k - low), 10**low, key, f"iban{k}", undo).cast("string"), k, "0")
            out = F.when(n == k, new) if out is None else out.when(n == k, new)
        account = _refill(body, F.concat(F.substr(digits, F.lit(1), F.length(digits) - n), out))
        country = F.substring(p, 1, 2)
        return _bind(account, lambda a: F.concat(country, F.lpad((F.lit(98) - _iban_remainder(F.concat(a, country, F.lit("00")))).cast("string"), 2, "0"), a))

    valid = lambda p: (_iban_remainder(F.concat(F.substr(p, F.lit(5), F.length(p) - 4), F.substring(p, 1, 4))) == 1) & (F.length(_digits(F.substr(p, F.lit(5), F.length(p) - 4))) >= 2)
    spread = lambda new: F.aggregate(F.split(match, ""), F.struct(F.lit("").alias("out"), F.lit(0).alias("n")), lambda s, c: F.when(c.isin(" ", ""), F.struct(F.concat(s["out"], c).alias("out"), s["n"].alias("n"))).otherwise(F.struct(F.concat(s["out"], F.substr(new, s["n"] + 1, F.lit(1))).alias("out"), (s["n"] + 1).alias("n"))))["out"]
    return _bind(plain, lambda p: F.when(valid(p), _bind(moved(p), spread)))


def _email(match: Column, key: str, undo: bool) -> Column:
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(match)).cast("binary"), 256)
    return F.concat(F.lit("u"), F.substring(digest, 1, 12), F.lit("@"), F.substring(digest, 13, 8), F.lit(".invalid"))


MAKERS = {"email": _email, "iban": _iban, "phone": _phone, "date": _date, "ip": _ip, "ssn": _ssn, "card": _card}


def _kind(match: Column) -> Column:
    """Which pattern a match came from; the patterns exclude each other but for IBAN, whose letters tell."""
    tests = {
        "email": F.contains(match, F.lit("@")),
        "iban": F.call_function("rlike", match, F.lit("^[A-Z]{2}")),
        "phone": F.call_function("rlike", match, F.lit(r"^[+(]")),
        "date": F.call_function("rlike", match, F.lit(r"^(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})$")),
        "ip": F.contains(match, F.lit(".")),
        "ssn": F.call_function("rlike", match, F.lit("^[0-9]{3}-[0-9]{2}-[0-9]{4}$")),
    }
    out = None
    for kind, test in tests.items():
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out.otherwise("card")


def pseudonyms(docs: DataFrame, key: str, undo: bool = False) -> DataFrame:
    """``doc_id, n_email, n_iban, n_phone, n_date, n_ip, n_ssn, n_card, text``: texts with pseudonyms, and how many of each kind.

    A null text stays null with zero counts; empty texts and texts without valid personal data come out
    as they went in; matches that fail validation stay; whole texts are read, however long; repeated rows
    stay; other columns are not read; an empty table gives no rows. ``undo`` turns pseudonyms of numbers
    and dates back.
    """
    text = F.col("text").cast("string")
    df = docs.select("doc_id", text.alias("text"))
    may = F.call_function("rlike", F.col("text"), F.lit("[0-9@]"))
    found = F.when(may, F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))

    def change(m: Column) -> Column:
        kind = _kind(m)
        new = None
        for name, make in MAKERS.items():
            made = make(m, key, undo)
            new = F.when(kind == name, made) if new is None else new.when(kind == name, made)
        return F.struct(kind.alias("kind"), new.alias("new"), m.alias("old"))

    df = df.withColumn("found", F.transform(found, change))
    parts = F.split("text", ANY, -1)
    between = F.zip_with(parts, "found", lambda p, x: F.concat(p, F.coalesce(x["new"], x["old"], F.lit(""))))
    out = F.when(F.size("found") > 0, F.array_join(between, "")).otherwise(F.col("text"))
    count = lambda kind: F.coalesce(F.size(F.filter("found", lambda x: (x["kind"] == kind) & x["new"].isNotNull())), F.lit(0)).cast("long").alias(f"n_{kind}")
    return df.select("doc_id", *map(count, KINDS), out.alias("text"))
