import datetime
import hashlib
import random
import re

import pytest

from tidemark.llm import pii


def permuted(value, a, b, key, kind):
    f = lambda half, turn: int(hashlib.sha256(f"{key}|{kind}|{turn}|{half}".encode()).hexdigest()[:13], 16)
    left, right = divmod(value, b)
    for turn in range(1, 9):
        if turn % 2:
            left = (left + f(right, turn)) % a
        else:
            right = (right + f(left, turn)) % b
    return left * b + right


def luhn(digits):
    return sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(map(int, reversed(digits))))


def refill(form, digits):
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in form)


def plain(text, key="tidemark"):
    """Cards, phones, addresses and ISO dates only."""

    def card(m):
        d = re.sub(r"\D", "", m.group())
        if luhn(d) % 10:
            return m.group()
        n, low = len(d), (len(d) - 1) // 2
        body = f"{permuted(int(d[:-1]), 10 ** (n - 1 - low), 10**low, key, f'card{n}'):0{n - 1}}"
        return refill(m.group(), body + str(-luhn(body + "0") % 10))

    def phone(m):
        d = re.sub(r"\D", "", m.group())
        return refill(m.group(), d[:-10] + f"{permuted(int(d[-10:]), 10**5, 10**5, key, 'phone'):010}")

    def ip(m):
        p = list(map(int, m.group().split(".")))
        if max(p) > 255:
            return m.group()
        return ".".join(map(str, permuted(int.from_bytes(bytes(p)), 2**16, 2**16, key, "ip").to_bytes(4)))

    def date(m):
        try:
            k = (datetime.date.fromisoformat(m.group()) - datetime.date(1900, 1, 1)).days
        except ValueError:
            return m.group()
        return str(datetime.date(1900, 1, 1) + datetime.timedelta(permuted(k, 340, 215, key, "date"))) if 0 <= k < 73100 else m.group()

    for pattern, make in ((r"(?<!\S)\d{4}-\d\d-\d\d(?!\S)", date), (r"(?<!\S)\d+\.\d+\.\d+\.\d+(?!\S)", ip), (r"(?<!\S)\+1 \(\d{3}\) \d{3}-\d{4}(?!\S)", phone), (r"(?<!\S)(\d{13,19}|\d{4}-\d{4}-\d{4}-\d{4})(?!\S)", card)):
        text = re.sub(pattern, make, text)
    return text


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    number = lambda n: "".join(rng.choices("0123456789", k=n))

    def valid(n):
        d = number(n - 1)
        return d + str(-luhn(d + "0") % 10)

    make = [lambda: valid(rng.randint(13, 19)), lambda: "-".join(re.findall("....", valid(16))), lambda: number(16), lambda: f"+1 ({number(3)}) {number(3)}-{number(4)}", lambda: ".".join(str(rng.randint(0, 300)) for _ in range(4)), lambda: f"{rng.randint(1880, 2120)}-{rng.randint(0, 13):02}-{rng.randint(0, 32):02}", lambda: "word", lambda: "é7", lambda: number(3)]
    return [(k, " ".join(rng.choice(make)() if rng.random() < 0.5 else "and" for _ in range(rng.randint(1, 30)))) for k in range(150)]


def test_against_brute_force(spark, rows):
    docs = spark.createDataFrame(rows + [(3, None), (3, rows[3][1]), (None, ""), (7, "x " * 20000 + "196.3.67.149")], "doc_id long, text string").selectExpr("*", "1 AS found", "'x' AS kind")
    got = [(r.doc_id, r.text) for r in pii.pseudonyms(docs, "tidemark").collect()]
    want = [(d, plain(t)) for d, t in rows] + [(3, None), (3, plain(rows[3][1])), (None, ""), (7, plain("x " * 20000 + "196.3.67.149"))]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert pii.pseudonyms(docs.limit(0), "k").count() == 0


def test_undo_and_other_kinds(spark):
    text = "ssn 123-45-6789 and 666-45-6789, iban DE89 3704 0044 0532 0130 00 or GB82WEST12345698765432; GB00WEST12345698765432. on 31/12/1999, 05.06.2010 and 2023-02-29"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    once = pii.pseudonyms(docs, "k")
    row = once.first()
    assert (row.n_ssn, row.n_iban, row.n_date, row.n_card) == (1, 2, 2, 0)
    assert "666-45-6789" in row.text and "GB00WEST12345698765432" in row.text and "2023-02-29" in row.text
    for gone in ("123-45-6789", "3704 0044", "12345698765432;", "31/12/1999", "05.06.2010"):
        assert gone not in row.text
    for iban in re.findall(r"DE\d\d(?: \d{4}){4} \d\d|GB\d\dWEST\d{14}(?=;)", row.text):
        p = iban.replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in p[4:] + p[:4])) % 97 == 1
    assert pii.pseudonyms(once.select("doc_id", "text"), "k", undo=True).first().text == text
    assert pii.pseudonyms(docs, "other").first().text != row.text


def test_equal_addresses_stay_linked(spark):
    got = {r.doc_id: r.text for r in pii.pseudonyms(spark.createDataFrame([(1, "to a.b@x.example.com."), (2, "A.B@x.example.com"), (3, "c@x.example.com")], "doc_id long, text string"), "k").collect()}
    assert got[1][3:-1] == got[2] != got[3] and "example" not in "".join(got.values())


def test_month_first_dates_and_ibans_before_words(spark):
    ibans = ["ES9121000418450200051332", "BE68539007547034", "AT611904300234573201", "GB82WEST12345698765432"]
    text = "born 12/25/1990, 02/29/2000 or 02/30/2000; pay ES9121000418450200051332 EUR, BE68539007547034 BIC, AT611904300234573201 2021 or BE68539007547034 GB82WEST12345698765432 x, AT611904300234573201 2021-05-06"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    once = pii.pseudonyms(docs, "k")
    row = once.first()
    assert (row.n_iban, row.n_date) == (6, 3)
    for gone in (*ibans, "12/25/1990", "02/29/2000", "2021-05-06"):
        assert gone not in row.text
    for kept in (" EUR,", " BIC,", " 2021 or", "02/30/2000"):
        assert kept in row.text
    assert pii.pseudonyms(once.select("doc_id", "text"), "k", undo=True).first().text == text
    many = spark.createDataFrame([(d, f"{m:02}/{d:02}/{y}") for y in range(1990, 1996) for m in (1, 7) for d in range(13, 32)], "doc_id long, text string")
    new = pii.pseudonyms(many, "k")
    assert new.select("text").distinct().count() == many.count() and all(int(r.text[3:5]) > 12 for r in new.collect())
