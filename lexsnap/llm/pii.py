"""Format-preserving pseudonyms for personal data, in native functions only.

Validated numbers are permuted within their format by a keyed Feistel network, so equal
values get equal pseudonyms in every document and different ones never meet. What does
not validate (a card number with a wrong check digit, 31 February) stays as it is.

| kind | valid if | permuted |
| card | 13 to 19 digits, blanks or hyphens between, right check digit | all but the check digit, which is set anew |
| phone | + and country code, 8 to 15 digits in all; or (NNN) NNN-NNNN, NNN-NNN-NNNN | the digits after the country code |
| date | of the years 1700 to 2099, day first or else month first | the day within these 400 years, day first |
| ip | four numbers up to 255 | the 32 bits |
| email | local part and domain | the local part becomes a keyed name |

Other numbers may stand beside them. In a run of digit groups every part of whole groups is
tried as a card; from the left, 16 digits before other lengths, longer before shorter ones.
A phone of country code 1 has 10 digits more; others end with the last group that fits
into 15 digits, as the lengths of their countries are not held here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
DATE = r"(?<![0-9./-])(?:[0-9]{4}(?:-[0-9]{2}-|/[0-9]{2}/)[0-9]{2}|[0-9]{2}(?:\.[0-9]{2}\.|/[0-9]{2}/|-[0-9]{2}-)[0-9]{4})(?![0-9]|[./-][0-9])"
IP = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
NATIONAL = r"(?<![0-9+(./-])(?:\([0-9]{3}\) ?|[0-9]{3}-)[0-9]{3}-[0-9]{4}(?![0-9]|-[0-9])"
PHONE = (
    r"\+1[ -]?\(?[0-9]{3}\)?[ -]?[0-9]{3}[ -]?[0-9]{4}(?![0-9])"
    r"|\+[0-9]{1,3}[ -]?\(?[0-9]{2,4}\)?(?:[ -]?[0-9]{2,4}){1,4}(?![0-9])"
    # 8 to 15 digits; written out, as a repeated group has no length for a lookbehind
    rf"(?<=\+{'[0-9][ ()-]{0,2}' * 7}{'(?:[0-9][ ()-]{0,2})?' * 7}[0-9])"
    rf"|{NATIONAL}"
)
# A run of digit groups, up to where something else starts; cards are looked for inside.
CARD = rf"(?<![0-9+])(?=(?:[0-9][ -]?){{13}})[0-9]++(?:[ -](?!{EMAIL}|{DATE}|{IP}|{NATIONAL})[0-9]++)*+"
CANDIDATE = "|".join((EMAIL, DATE, IP, PHONE, CARD))

# 400 years have 146097 days, always; 146097 = 189 * 773.
FIRST_DAY, DAYS, DAY_PARTS = "1700-01-01", 146097, (189, 773)
DATE_FORMATS = {
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$": "yyyy-MM-dd",
    r"^[0-9]{4}/[0-9]{2}/[0-9]{2}$": "yyyy/MM/dd",
    r"^[0-9]{2}\.[0-9]{2}\.[0-9]{4}$": "dd.MM.yyyy",
    r"^[0-9]{2}/[0-9]{2}/[0-9]{4}$": "dd/MM/yyyy",
    r"^[0-9]{2}-[0-9]{2}-[0-9]{4}$": "dd-MM-yyyy",
}
# Where no day-first date stands. Only the day counts: 03/25/2020 and 25/03/2020 are equal.
MONTH_FIRST = {"dd/MM/yyyy": "MM/dd/yyyy", "dd-MM-yyyy": "MM-dd-yyyy"}
KINDS = ("card", "phone", "date", "ip", "email")


def _keyed(*parts: Column) -> Column:
    """52 bits of a keyed hash."""
    text = F.concat_ws(":", *(p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def feistel(a: Column, b: Column, a_size: Column, b_size: Column, key: str, kind: str) -> Column:
    """Permute pairs ``(a, b)`` with a below a_size and b below b_size.

    Odd rounds add a hash of b to a, even ones a hash of a to b, each within its size:
    every round can be undone, so the whole is a permutation.
    """
    def step(s: Column, turn: Column) -> Column:
        odd = turn % 2 == 1
        tag = [F.lit(key), F.lit(kind), s.m, s.n]
        return F.struct(
            F.when(odd, (s.a + _keyed(*tag, turn, s.b)) % s.m).otherwise(s.a).alias("a"),
            F.when(odd, s.b).otherwise((s.b + _keyed(*tag, turn, s.a)) % s.n).alias("b"),
            s.m.alias("m"),
            s.n.alias("n"),
        )

    # The sizes stand in the state, so that they are worked out once.
    parts = {"a": a, "b": b, "m": a_size, "n": b_size}
    start = F.struct(*(value.cast("long").alias(name) for name, value in parts.items()))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)


def _ten_to(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("long")


def permute_digits(digits: Column, key: str, kind: str) -> Column:
    """Another string of as many digits (two at least, 36 at most)."""
    size = F.length(digits)
    left = F.floor(size / 2).cast("int")
    halves = F.left(digits, left).cast("long"), F.right(digits, size - left).cast("long")
    return _let(
        feistel(*halves, _ten_to(left), _ten_to(size - left), key, kind),
        lambda out: F.concat(
            F.lpad(out.a.cast("string"), left, "0"), F.lpad(out.b.cast("string"), size - left, "0")
        ),
    )


def _luhn_sum(digits: Column, doubled: int) -> Column:
    """Sum of the digits, from the right, every second one doubled; ``doubled`` is the first such place."""
    places = F.sequence(F.lit(0), F.length(digits) - 1)

    def value(k: Column) -> Column:
        d = F.substr(digits, F.length(digits) - k, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when(k % 2 == doubled, twice).otherwise(d)

    return F.aggregate(F.transform(places, value), F.lit(0), lambda a, b: a + b)


def valid_card(digits: Column) -> Column:
    return F.length(digits).between(13, 19) & (_luhn_sum(digits, 1) % 10 == 0)


def _refill(token: Column, digits: Column) -> Column:
    """``token`` with its digits replaced in order; everything else stays in place."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def put(s: Column, c: Column) -> Column:
        digit = c.between("0", "9")
        piece = F.when(digit, F.substr(digits, s["at"], F.lit(1))).otherwise(c)
        return F.struct(F.concat(s.out, piece).alias("out"), (s["at"] + digit.cast("int")).alias("at"))

    return F.aggregate(F.split(token, ""), start, put, lambda s: s.out)


def _digits(token: Column) -> Column:
    return F.regexp_replace(token, "[^0-9]", "")


def _card(token: Column, key: str) -> Column:
    def moved(digits: Column) -> Column:
        check = lambda body: (10 - _luhn_sum(body, 0) % 10) % 10
        body = permute_digits(F.left(digits, F.length(digits) - 1), key, "card")
        whole = _let(body, lambda x: F.concat(x, check(x).cast("string")))
        return F.when(valid_card(digits), _let(whole, lambda x: _refill(token, x)))

    return _let(_digits(token), moved)


def _cards(token: Column, key: str) -> Column:
    """``(text, n)``: a run of digit groups with its ``n`` cards replaced."""
    groups, gaps = F.split(token, "[ -]"), F.regexp_extract_all(token, F.lit("([ -])"), F.lit(1))

    def walk(run: Column) -> Column:
        last = F.size(run.groups) - 1

        def part(first: Column, end: Column) -> Column:
            return F.array_join(F.slice(run.groups, first + 1, end - first + 1), "")

        def tried(first: Column, end: Column) -> Column:
            digits = part(first, end)
            size = F.length(digits)
            order = F.when(size == 16, 0).otherwise(40 - size)
            return F.when(valid_card(digits), F.struct(order.alias("order"), end.alias("end"), digits.alias("digits")))

        def step(s: Column, k: Column) -> Column:
            ends = F.sequence(k, F.least(k + 18, last))
            found = F.array_min(F.transform(ends, lambda end: tried(k, end)))

            def take(best: Column) -> Column:
                # As many gaps as groups but one, put back where they stood.
                shape = F.array_join(
                    F.zip_with(F.slice(run.groups, k + 1, best.end - k + 1), F.slice(run.gaps, k + 1, best.end - k), lambda g, x: F.concat(g, F.coalesce(x, F.lit("")))), ""
                )
                gap = F.coalesce(F.get(run.gaps, best.end), F.lit(""))
                return F.struct(F.concat(s.text, _card(shape, key), gap).alias("text"), (s.n + 1).alias("n"), (best.end + 1).alias("at"))

            plain = F.struct(
                F.concat(s.text, F.get(run.groups, k), F.coalesce(F.get(run.gaps, k), F.lit(""))).alias("text"), s.n.alias("n"), (k + 1).alias("at")
            )
            return F.when(k < s["at"], s).otherwise(_let(found, lambda best: F.when(best.isNotNull(), take(best)).otherwise(plain)))

        start = F.struct(F.lit("").alias("text"), F.lit(0).alias("n"), F.lit(0).alias("at"))
        return F.aggregate(F.sequence(F.lit(0), last), start, step)

    return _let(F.struct(groups.alias("groups"), gaps.alias("gaps")), walk)


def _phone(token: Column, key: str) -> Column:
    country = F.regexp_extract(token, r"^\+([0-9]{1,3})", 1)

    def moved(x: Column) -> Column:
        rest = F.substr(x.digits, F.length(x.country) + 1, F.length(x.digits))
        valid = F.length(x.digits).between(8, 15) & (F.length(rest) >= 4)
        whole = F.concat(x.country, _let(rest, lambda r: permute_digits(r, key, "phone")))
        return F.when(valid, _let(whole, lambda w: _refill(token, w)))

    return _let(F.struct(_digits(token).alias("digits"), country.alias("country")), moved)


def _moved_day(form: str, key: str):
    """Text of the day that a day number moves to."""
    first = F.lit(FIRST_DAY).cast("date")

    def moved(day: Column) -> Column:
        parts = [F.lit(n).cast("long") for n in DAY_PARTS]
        out = feistel(F.floor(day / DAY_PARTS[1]), day % DAY_PARTS[1], *parts, key, "date")
        other = _let(out, lambda x: F.date_add(first, (x.a * DAY_PARTS[1] + x.b).cast("int")))
        return F.when(day.between(0, DAYS - 1), F.date_format(other, form))

    return moved


def _date(token: Column, key: str) -> Column:
    first = F.lit(FIRST_DAY).cast("date")
    result = F.lit(None).cast("string")
    for pattern, form in DATE_FORMATS.items():
        forms = [form, *([MONTH_FIRST[form]] if form in MONTH_FIRST else [])]
        day = F.datediff(F.coalesce(*(F.try_to_timestamp(token, F.lit(f)).cast("date") for f in forms)), first)
        result = F.when(token.rlike(pattern), _let(day, _moved_day(form, key))).otherwise(result)
    return result


def _ip(token: Column, key: str) -> Column:
    half = F.lit(65536).cast("long")

    def moved(part: Column) -> Column:
        o = [part[k].cast("long") for k in range(4)]
        out = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], half, half, key, "ip")
        octets = lambda x: (F.floor(x.a / 256), x.a % 256, F.floor(x.b / 256), x.b % 256)
        text = _let(out, lambda x: F.concat_ws(".", *(o.cast("string") for o in octets(x))))
        return F.when(F.greatest(*o) <= 255, text)

    return _let(F.split(token, r"\."), moved)


def _email(token: Column, key: str) -> Column:
    name = F.substring(F.md5(F.concat(F.lit(f"{key}:email:"), F.lower(token)).cast("binary")), 1, 12)
    return F.concat(F.lit("user-"), name, F.lit("@"), F.substring_index(token, "@", -1))


def _kind(token: Column) -> Column:
    return (
        F.when(token.contains("@"), "email")
        .when(token.startswith("+") | token.startswith("(") | token.rlike("^[0-9]{3}-[0-9]{3}-[0-9]{4}$"), "phone")
        .when(token.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), "ip")
        .when(F.length(token) == 10, "date")
        .otherwise("card")
    )


def pseudonym(token: Column, key: str) -> Column:
    """``(kind, text, n)`` of a candidate: how many it holds; text is null where it does not validate."""
    kind = _kind(token)
    text = (
        F.when(kind == "email", _email(token, key))
        .when(kind == "phone", _phone(token, key))
        .when(kind == "ip", _ip(token, key))
        .when(kind == "date", _date(token, key))
    )
    one = _let(text, lambda t: F.struct(t.alias("text"), t.isNotNull().cast("int").alias("n")))
    named = F.when(kind == "card", F.transform(F.array(_cards(token, key)), lambda c: F.struct(c.text.alias("text"), c.n.alias("n")))[0]).otherwise(one)
    return _let(named, lambda x: F.struct(kind.alias("kind"), x.text.alias("text"), x.n.alias("n")))


def pseudonymised(docs: DataFrame, key: str) -> DataFrame:
    """All columns of ``(text, …)``, the text with pseudonyms, and how many of each kind.

    Adds ``n_card, n_phone, n_date, n_ip, n_email`` (columns of these names in the input
    are replaced). Every row stands for itself: nothing is joined or shuffled. A null
    text stays null with counts of zero; text without personal data stays as it is, byte
    for byte. ``key`` is the secret of the permutation.
    """
    counts = [f"n_{kind}" for kind in KINDS]
    docs = docs.drop(*counts)
    columns = docs.columns
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("doc"))
    some = F.col("doc.text").rlike("[0-9@]")
    none = F.array().cast("array<string>")
    rows = rows.withColumn("tokens", F.when(some, F.regexp_extract_all("doc.text", F.lit(CANDIDATE), F.lit(0))).otherwise(none))
    rows = rows.withColumn("names", F.transform("tokens", lambda t: pseudonym(t, key)))
    gaps = F.split("doc.text", CANDIDATE, -1)
    named = F.zip_with("tokens", "names", lambda t, n: F.coalesce(n.text, t))
    merged = F.array_join(F.zip_with(gaps, named, lambda g, n: F.concat(g, F.coalesce(n, F.lit("")))), "")
    text = F.when(F.size("tokens") > 0, merged).otherwise(F.col("doc.text"))

    def count(kind: str) -> Column:
        mine = F.filter("names", lambda n: n.kind == kind)
        return F.aggregate(mine, F.lit(0).cast("long"), lambda total, n: total + n.n).alias(f"n_{kind}")

    kept = [text.alias(c) if c == "text" else F.col("doc").getField(c).alias(c) for c in columns]
    return rows.select(*kept, *(count(kind) for kind in KINDS))
