"""Question/answer lists."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lexsnap.operators import qa as Q
from lexsnap.schemas import QA

PAIR = {"question": "q", "answer": "a"}

RESPONSES = [
    (json.dumps({"qa_list": [PAIR]}), None),
    (json.dumps({"qa_list": [{**PAIR, "extra": 1}], "other": 2}), None),
    ('{"qa_list": []}', None),
    (' {"qa_list": []} \n', None),
    (None, None),
    ("", "invalid_json"),
    ("In prose.", "invalid_json"),
    ('{"qa_list": [{"question": "q', "invalid_json"),
    ('{"qa_list": []} and more', "invalid_json"),
    ('{"qa_list": []}, {"qa_list": []}', "invalid_json"),
    ('{"qa_list": []}} x', "invalid_json"),
    ('{"qa_list": []}] x', "invalid_json"),
    ("{'qa_list': []}", "invalid_json"),
    ('{"k": 1}', "missing_list"),
    ('{"qa_list": null}', "missing_list"),
    ('{"qa_list": "text"}', "missing_list"),
    ("[1]", "missing_list"),
    ('{"qa_list": [3]}', "invalid_item"),
    ('{"qa_list": [null]}', "invalid_item"),
    ('{"qa_list": [{"question": "q"}]}', "invalid_item"),
    ('{"qa_list": [{"question": 1, "answer": "a"}]}', "invalid_item"),
    ('{"qa_list": [{"question": null, "answer": "a"}]}', "invalid_item"),
    ('{"qa_list": [{"question": "q", "answer": {"x": 1}}]}', "invalid_item"),
]


def test_parse_responses(spark):
    df = spark.createDataFrame([(i, b) for i, (b, _) in enumerate(RESPONSES)], "i int, body string")
    parsed = Q.parse_responses(df)
    got = {r["i"]: r for r in parsed.collect()}
    for i, (body, problem) in enumerate(RESPONSES):
        assert got[i]["problem"] == problem, body
        assert (got[i]["qa_list"] is None) == (problem is not None or body is None), body
    assert [tuple(p) for p in got[0]["qa_list"]] == [("q", "a")]
    assert Q.quarantine(parsed).count() == sum(p is not None for _, p in RESPONSES)


def test_python_check_agrees(spark):
    for body, problem in RESPONSES:
        if body is None:
            continue
        if problem is None:
            Q.valid_response(body)
        else:
            with pytest.raises(ValueError):
                Q.valid_response(body)


DOCS = "permalink string, qa_list array<struct<question:string,answer:string>>"


def test_explode_keeps_empty_lists(spark):
    rows = [("a", [("q1", "x"), ("q2", None)]), ("b", []), ("c", None), (None, [("q", "x")])]
    got = Q.explode_qa(spark.createDataFrame(rows, DOCS))
    assert got.columns == QA.names
    assert sorted(map(tuple, got.collect()), key=str) == [
        (0, None, "q", "x"),
        (1, "a", "q1", "x"),
        (1, "b", None, None),
        (1, "c", None, None),
        (2, "a", "q2", None),
    ]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


@pytest.mark.parametrize("partitions", [1, 4, 17])
def test_explode_parts_run_on(spark, partitions):
    # Parts far apart, so that they fall into different slices.
    parts = [0, 1, 8191, 8192, 20000]
    rows = [("a", p, [(f"{p}-{i}", "x") for i in range(3)]) for p in parts]
    rows.append(("b", 0, []))
    df = spark.createDataFrame(
        rows, "permalink string, part long, qa_list array<struct<question:string,answer:string>>"
    ).repartition(partitions)
    got = {(r["permalink"], r["id"]): r["question"] for r in Q.explode_qa_parts(df, parts_per_slice=8192).collect()}
    expected = [f"{p}-{i}" for p in parts for i in range(3)]
    assert got == {**{("a", i): q for i, q in enumerate(expected, 1)}, ("b", 1): None}


def test_generate_retries_and_marks_failures(spark):
    rows = [("ok", "fine"), ("bad", "broken"), ("raise", "boom"), ("none", None)]
    docs = spark.createDataFrame(rows, "permalink string, body_final string")

    def generator(text):
        if text == "boom":
            raise RuntimeError("no service")
        return "prose" if text == "broken" else json.dumps({"qa_list": [PAIR]})

    generated = Q.generate_qa(docs, generator, max_attempts=3, wait_seconds=0.0)
    got = {r["permalink"]: r for r in generated.collect()}
    assert [tuple(p) for p in got["ok"]["qa_list"]] == [("q", "a")]
    assert (got["ok"]["attempts"], got["bad"]["attempts"], got["none"]["attempts"]) == (1, 3, 0)
    assert "no service" in got["raise"]["error"] and got["none"]["error"] is None
    marked = Q.explode_qa(Q.mark_failed(generated))
    assert {r["permalink"]: r["question"] for r in marked.collect()} == {
        "ok": "q",
        "bad": Q.FAILED_QUESTION,
        "raise": Q.FAILED_QUESTION,
        "none": None,
    }


def test_generate_succeeds_on_a_later_attempt(spark):
    docs = spark.createDataFrame([("a", "x")], "permalink string, body_final string").coalesce(1)
    calls = []

    def flaky(text):
        calls.append(text)
        if len(calls) < 3:
            raise RuntimeError("busy")
        return json.dumps({"qa_list": [PAIR]})

    row = Q.generate_qa(docs, flaky, max_attempts=5, wait_seconds=0.0).first()
    assert (row["attempts"], row["error"]) == (3, None)


def test_generate_runs_python_once(spark):
    docs = spark.createDataFrame([("a", "x")], "permalink string, body_final string")
    generated = Q.generate_qa(docs, lambda text: "{}", 1)
    filtered = Q.mark_failed(generated).filter(F.size("qa_list") > 0)
    plan = filtered._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1


FAILED = Q.FAILED_QUESTION


def regenerated(spark, rows, **options):
    qa = spark.createDataFrame(rows, QA)
    regulations = spark.createDataFrame(
        [("a", "<p>x &amp; y</p>"), ("b", "<p>z</p>"), ("c", "<p>w</p>")],
        "permalink string, body_final string",
    )
    seen = []

    def generate(documents):
        seen.append(sorted(map(tuple, documents.collect())))
        pair = F.struct(F.col("body_final").alias("question"), F.lit("new").alias("answer"))
        return documents.select("permalink", F.array(pair, pair).alias("qa_list"))

    result = Q.regenerate_failed(qa, regulations, generate, **options)
    return sorted(map(tuple, result.collect()), key=str), seen


def test_regenerate_failed(spark):
    rows = [
        (1, "a", "q", "x"), (2, "a", FAILED, None), (3, "a", FAILED, None),
        (1, "b", FAILED, None), (1, "c", "q", "x"), (1, "gone", FAILED, None),
        (2, "c", None, None),
    ]
    got, seen = regenerated(spark, rows)
    assert seen == [[("a", "x & y"), ("b", "z")]]
    assert got == [
        (1, "a", "q", "x"), (1, "b", "z", "new"), (1, "c", "q", "x"),
        (2, "a", "x & y", "new"), (2, "b", "z", "new"), (3, "a", "x & y", "new"),
    ]


def test_regenerate_with_restarted_ids(spark):
    rows = [(1, "a", "q", "x"), (2, "a", FAILED, None), (3, "a", FAILED, None)]
    got, _ = regenerated(spark, rows, restart_ids=True)
    expected = [(1, "a", "q", "x"), *((i, "a", "x & y", "new") for i in (1, 2, 3, 4))]
    assert got == sorted(expected, key=str)


def test_nothing_to_regenerate(spark):
    rows = [(1, "a", "q", "x"), (2, "a", None, None)]
    got, seen = regenerated(spark, rows)
    assert got == rows and seen == []


def test_bodies_reach_the_generator_in_small_batches(spark):
    """30 MB in one partition: no batch of them holds more than some megabytes."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    docs = spark.range(0, 300, 1, 1).selectExpr(
        "'d' || id AS permalink", "repeat(cast(id % 10 AS string), 100000) AS body_final"
    )

    def generator(text):
        middle = len(text) // 2
        return json.dumps({"qa_list": [{"question": text[:middle], "answer": text[middle:]}]})

    spark.conf.set(key, str(64 << 20))
    try:
        generated = Q.generate_qa(docs, generator, 1, 0.0)
        assert int(spark.conf.get(key)) <= 8 << 20
        rows = generated.selectExpr("permalink", "qa_list[0].question AS q", "attempts").collect()
    finally:
        spark.conf.set(key, before)
    assert {(r["permalink"], r["q"], r["attempts"]) for r in rows} == {
        (f"d{n}", str(n % 10) * 50000, 1) for n in range(300)
    }
