from __future__ import annotations

import datetime
import hashlib
import re

from lexsnap.llm import pii as P

KEY = "k1"
SCHEMA = "doc_id long, text string, names string"
FIRST = datetime.date(1700, 1, 1)


def keyed(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:13], 16)


def feistel(a, b, m, n, kind):
    for turn in range(1, P.ROUNDS + 1):
        if turn % 2:
            a = (a + keyed(KEY, kind, m, n, turn, b)) % m
        else:
            b = (b + keyed(KEY, kind, m, n, turn, a)) % n
    return a, b


def digits(text, kind):
    left = len(text) // 2
    right = len(text) - left
    a, b = feistel(int(text[:left]), int(text[left:]), 10**left, 10**right, kind)
    return f"{a:0{left}d}{b:0{right}d}"


def luhn(text):
    total = 0
    for k, c in enumerate(reversed(text)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def refill(token, new):
    it = iter(new)
    return "".join(next(it) if c.isascii() and c.isdigit() else c for c in token)


def expected(token):
    plain = re.sub("[^0-9]", "", token)
    if "@" in token:
        name = hashlib.md5(f"{KEY}:email:{token.lower()}".encode()).hexdigest()[:12]
        return f"user-{name}@{token.rpartition('@')[2]}"
    if token.startswith("+"):
        country = re.match(r"\+([0-9]{1,3})", token)[1]
        return refill(token, country + digits(plain[len(country):], "phone"))
    if token.count(".") == 3:
        o = list(map(int, token.split(".")))
        if max(o) > 255:
            return token
        a, b = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, "ip")
        return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"
    if len(token) == 10:
        form = {"-": "%Y-%m-%d", "/": "%Y/%m/%d"}[token[4]] if token[:4].isdigit() else f"%d{token[2]}%m{token[2]}%Y"
        try:
            day = (datetime.datetime.strptime(token, form).date() - FIRST).days
        except ValueError:
            return token
        a, b = feistel(day // 773, day % 773, 189, 773, "date")
        return (FIRST + datetime.timedelta(a * 773 + b)).strftime(form)
    if not luhn(plain):
        return token
    body = digits(plain[:-1], "card")
    return refill(token, body + next(c for c in "0123456789" if luhn(body + c)))


TOKENS = [
    "4929348385146306", "4929 3483 8514 6306", "4929-3483-8514-6306", "4952935900253052", "9807915762804490",
    "+1 (017) 555-7713", "+49 30 1234567", "97.51.17.173", "300.1.1.1", "0.0.0.0", "2024-02-29", "2023-02-29",
    "31.12.1999", "31/11/1999", "1999/12/31", "28-02-2001", "und.34@mail7.example.com", "A.B@Example.org",
]


def test_pseudonyms_equal_plain_python_and_keep_the_format(spark):
    rows = [(i, f"before {t} after\n{t}.", "x") for i, t in enumerate(TOKENS)]
    got = P.pseudonymised(spark.createDataFrame(rows, SCHEMA), KEY).orderBy("doc_id").collect()
    for (_, text, _), row, token in zip(rows, got, TOKENS):
        new = expected(token)
        assert row["text"] == f"before {new} after\n{new}.", token
        shape = re.sub("[0-9]", "0", token)
        if "@" not in token and token.count(".") != 3:
            assert re.sub("[0-9]", "0", new) == shape
        if "." not in token and len(re.sub("[^0-9]", "", token)) == 16 and new != token:
            assert luhn(re.sub("[^0-9]", "", new))


def test_a_permutation_of_its_domain(spark):
    from pyspark.sql import functions as F

    all_days = spark.range(P.DAYS).select(
        P.feistel(F.floor(F.col("id") / 773), F.col("id") % 773, F.lit(189).cast("long"), F.lit(773).cast("long"), KEY, "date").alias("x")
    )
    assert all_days.select("x.a", "x.b").distinct().count() == P.DAYS


def test_clean_text_stays_and_edges_have_results(spark):
    texts = [None, "", "no data here", "version 2.0 of 12 items, 3.5 %", "@ alone", "12345", "é" * 50000, "1" * 40]
    rows = [(i, t, None) for i, t in enumerate(texts)] + [(1, "", None)]
    frame = P.pseudonymised(spark.createDataFrame(rows, SCHEMA), KEY)
    assert sorted(((r.doc_id, r.text) for r in frame.collect()), key=str) == sorted(((i, t) for i, t, _ in rows), key=str)
    assert frame.columns == ["doc_id", "text", "names", *(f"n_{k}" for k in P.KINDS)]
    assert "Python" not in frame._jdf.queryExecution().executedPlan().toString()
    assert P.pseudonymised(spark.createDataFrame([], SCHEMA), KEY).count() == 0


def test_counts(spark):
    text = "a@b.org 4929348385146306 4952935900253050 2024-02-29 10.0.0.1 +1 (017) 555-7713"
    row = P.pseudonymised(spark.createDataFrame([(1, text, None)], SCHEMA), KEY).first()
    assert (row.n_email, row.n_card, row.n_date, row.n_ip, row.n_phone) == (1, 1, 1, 1, 1)


PHONE10 = "+1 (555) 123-4567"


def test_numbers_beside_personal_data(spark):
    # Braces mark what is personal; everything else must stay.
    marked = [
        "{4111111111111111} 12/26", "{4111111111111111} 123", "2 {4111 1111 1111 1111}", "7-{4111-1111-1111-1111} 88 9",
        "{4111111111111111} {4929 3483 8514 6306}", "{4111111111111111} {2024-02-29} 5", "{4111111111111111} {10.0.0.1}",
        "{4111111111111111} {12ab@x.org}", "{+1 (555) 123-4567} 2024 1999", "{+1 (826) 555-4081} 190", "{+1 (826) 555-4081}",
        "{+49 30 1234567} 123456", "12 {2024-02-29} 7", "1" * 40, "4111111111111112 12/26", "5 12 7",
    ]
    texts = [t.replace("{", "").replace("}", "") for t in marked]
    rows = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r for r in P.pseudonymised(rows, KEY).collect()}
    for i, text in enumerate(marked):
        assert got[i].text == re.sub(r"\{(.*?)\}", lambda m: expected(m[1]), text), text
        assert sum(got[i][f"n_{k}"] for k in P.KINDS) == text.count("{"), text


def test_month_first_dates_and_national_phones(spark):
    texts = ["12/25/2020 25/12/2020", "on 12-25-2020 7", "31/11/1999", "(555) 123-4567 190", "555-123-4567", "+1 (555) 123-4567", "7 (555) 123-4567 2024", "12 555-123-4567 1999"]
    rows = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r for r in P.pseudonymised(rows, KEY).collect()}
    assert got[0].text == f"{expected('25/12/2020')} {expected('25/12/2020')}" and got[0].n_date == 2
    assert got[1].text == f"on {expected('25-12-2020')} 7"
    assert got[2].text == texts[2] and got[2].n_date == 0
    assert got[3].text == expected(PHONE10)[3:] + " 190" and got[5].text == expected(PHONE10)
    assert re.sub("[^0-9]", "", got[4].text) == re.sub("[^0-9]", "", expected(PHONE10))[1:]
    assert [got[i].n_phone for i in range(3, 8)] == [1, 1, 1, 1, 1]
    assert got[6].text == f"7{expected(PHONE10)[2:]} 2024" and got[7].text == f"12 {got[4].text} 1999"
