"""Column functions on hand-written rows, and against plain Python."""

from __future__ import annotations

import datetime
import html as html_module
import random
import re
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from lexsnap.functions import dates, markup, nested, render, text

TESTDATA = "/root/testdata/sf0.001"


def apply(spark, function, values, kind="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    return [row[0] for row in df.select(function(F.col("x"))).collect()]


def test_clean_body_deletes_breaks_and_swaps_quotes(spark):
    values = ["a\r\nb\tc", 'say "hi"', "", None, "plain"]
    assert apply(spark, text.clean_body, values) == ["abc", "say 'hi'", "", None, "plain"]


def test_normalize_unicode_whitespace(spark):
    values = ["\t\u00a0a \u2003\x0b\x85 b \n", "\u3000x", "", None, "\u00a0", "a b", "a\u200bb"]
    expected = ["a b", "x", "", None, "", "a b", "a\u200bb"]
    assert apply(spark, text.normalize_whitespace, values) == expected


def test_normalize_is_idempotent(spark):
    def twice(c):
        return text.normalize_whitespace(text.normalize_whitespace(c))

    docs = spark.read.parquet(f"{TESTDATA}/documents.parquet")
    c = F.col("text")
    assert docs.filter(twice(c) != text.normalize_whitespace(c)).isEmpty()


def python_chunks(value, size, overlap):
    starts = range(0, len(value), size - overlap)
    return [(value[i : i + size], f"{size}-{n}") for n, i in enumerate(starts, 1)]


@pytest.mark.parametrize("size,overlap", [(5, 2), (4, 0), (7, 6), (1, 0)])
def test_chunks_equal_slicing(spark, size, overlap):
    values = ["", "abc", "abcde", "a" * 8, "line\nbreak\r\ntext", "x😀y😀z" * 3]
    got = apply(spark, lambda c: text.chunks(c, size, overlap), values)
    for value, pieces in zip(values, got):
        assert [tuple(p) for p in pieces] == python_chunks(value, size, overlap)


def test_chunks_without_overlap_join_to_the_text(spark):
    docs = spark.read.parquet(f"{TESTDATA}/documents.parquet")
    pieces = F.array_join(F.transform(text.chunks(F.col("text"), 997), lambda p: p.chunk), "")
    assert docs.filter(~pieces.eqNullSafe(F.col("text"))).isEmpty()


def test_chunks_null_and_bad_arguments(spark):
    assert apply(spark, lambda c: text.chunks(c, 5, 1), [None]) == [None]
    for size, overlap in ((5, 5), (0, 0), (5, -1)):
        with pytest.raises(ValueError):
            text.chunks(F.col("x"), size, overlap)


class _Content(HTMLParser):
    """Text content by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts = []

    def handle_data(self, data):
        self.parts.append(data)


def parsed_text(source):
    parser = _Content()
    parser.feed(source.replace(">", "> "))
    parser.close()
    return "".join(parser.parts)


def test_html_equals_a_parser_on_all_pages(spark):
    pages = spark.read.parquet(f"{TESTDATA}/pages.parquet")
    rows = pages.select("html", markup.html_to_text(F.col("html")).alias("t")).collect()
    assert len(rows) == 50
    for row in rows:
        assert row["t"] == parsed_text(row["html"])


HTML_CASES = [
    ("<p>a</p><p>b</p>", " a  b "),
    ('<a title="x > y" href=\'>\'>t</a>', " t "),
    ("<a href=foo's>t</a> <b class='x'>u</b>", " t   u "),
    ("a < b and 1 <2", "a < b and 1 <2"),
    ("<!-- <p>gone</p> -->kept", " kept"),
    ('<script>var t="</p>"; a && b &amp; c</script>&amp;d', ' var t="</p> "; a && b &amp; c &d'),
    ("<STYLE>p{margin:0}</STYLE >x", " p{margin:0} x"),
    ("<script>open", " open"),
    ("&amp;lt; &lt;b&gt; &eacute;&#233;&#xE9;&nbsp;&apos;", "&lt; <b> ééé\u00a0'"),
    ("&unknown; &amp &; & &#0; &#1114112; &#xD800;", None),
    ("", ""),
    ("<br/>one<br>two", " one two"),
]


def test_html_cases(spark):
    sources = [source for source, _ in HTML_CASES]
    got = apply(spark, markup.html_to_text, [*sources, None])
    for (source, expected), value in zip(HTML_CASES, got):
        # Unknown or impossible references stay as they are.
        assert value == (source if expected is None else expected)
    assert got[-1] is None


def test_html_cases_do_not_depend_on_company(spark):
    """Frequent and rare entities in one text decode as in one pass."""
    random.seed(7)
    names = ["amp", "lt", "gt", "quot", "nbsp", "copy", "eacute", "#65", "#x42", "euro"]
    values = [
        "".join(random.choice([f"&{random.choice(names)};", "amp;", "x", "&"]) for _ in range(12))
        for _ in range(200)
    ]
    expected = [
        re.sub(r"&(?:#\d+|#x[0-9A-F]+|[a-z]+);", lambda m: html_module.unescape(m[0]), v)
        for v in values
    ]
    assert apply(spark, markup.decode_entities, values) == expected


def test_long_tags_and_scripts_do_not_overflow(spark):
    long_tag = "<p " + 'a="b>" ' * 20000 + ">x" + "<!--" + "c" * 200000 + "-->"
    long_script = "<script>" + "y<z; " * 50000 + "&&</script>"
    tag, script = apply(spark, markup.html_to_text, [long_tag, long_script])
    assert tag == " x "
    assert script.count("y<z") == 50000 and script.rstrip().endswith("&&")


def test_list_join_nulls(spark):
    values = [None, [], ["b", None, "a"], ["10", "2", "3"]]
    got = apply(spark, nested.sorted_join, values, "array<string>")
    assert got == [None, "", "a b", "10 2 3"]


def test_flatten_codes_sorts_as_text(spark):
    values = [None, [], [(10, "x"), (2, "y"), (None, "z")]]
    kind = "array<struct<uuid:int,keterangan:string>>"
    assert apply(spark, nested.flatten_codes, values, kind) == [None, "", "10 2"]


def test_relation_default(spark):
    kind = "array<struct<permalink:string>>"
    values = [None, [], [("b",), ("a",)]]
    for default in (True, False):
        got = apply(spark, lambda c: nested.flatten_links(c, default), values, kind)
        assert got == [None, "", "a b"]
    kept = apply(spark, nested.default_if_empty, [None, [], ["x"]], "array<string>")
    assert kept == [None, [""], ["x"]]


def test_dates(spark):
    assert apply(spark, dates.parse_listing_date, ["31-01-2024", None]) == [
        datetime.date(2024, 1, 31),
        None,
    ]
    for bad in ("1-1-2024", "2024-01-31", "31-02-2024"):
        with pytest.raises(Exception, match="CANNOT_PARSE|INVALID"):
            apply(spark, dates.parse_listing_date, [bad])
        assert apply(spark, lambda c: dates.parse_listing_date(c, strict=False), [bad]) == [None]
    assert apply(spark, dates.parse_iso_date, ["2024-01-31"]) == [datetime.date(2024, 1, 31)]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Tokyo"])
def test_jakarta_stamp_ignores_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.sql("SELECT timestamp_ntz'2024-03-10 18:30:05.9' AS x")
        assert df.select(dates.jakarta_stamp(F.col("x"))).first()[0] == "20240311013005"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_context_line_shows_none(spark):
    df = spark.createDataFrame([("q", None, "PMK", "1/2")], "q string, a string, k string, n string")
    line = df.select(render.context_line(*map(F.col, "qakn"))).first()[0]
    assert line == "- q None [Sumber: PMK Nomor: 1/2] "


def test_zeros_in_references_and_characters_that_stay(spark):
    cases = {
        "&#0000000039;": "'",
        "&#x000000041;b": "Ab",
        "a\0b &amp; c": "a\0b & c",
        "<script>a && b \ufdd0</script>&lt;": "a && b \ufdd0 <",
    }
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, html string")
    got = df.select("i", markup.html_to_text(F.col("html")).alias("t")).orderBy("i").collect()
    assert [r["t"].strip() for r in got] == list(cases.values())
