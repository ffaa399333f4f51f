"""Topic labels, prompts and cards."""

from __future__ import annotations

import pytest

from lexsnap.operators import context as X

TOPICS = [(2, "PPh"), (3, "PPN"), (4, None), (None, "nothing")]


def topics(spark):
    return spark.createDataFrame(TOPICS, "uuid int, keterangan string")


def test_topic_labels(spark):
    cases = {
        "2 3": "PPh, PPN",
        "3 2 3": "PPN, PPh, PPN",
        "12 2": "PPh",
        "": "",
        "x 3": "PPN",
        "4 3": "PPN",
        None: None,
    }
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, topik string")
    got = X.topic_labels(df, topics(spark))
    assert [r["topik_labels"] for r in got.orderBy("i").collect()] == list(cases.values())


@pytest.mark.parametrize("codes", ["12", "x", ""])
def test_strict_labels_refuse_unknown_codes(spark, codes):
    good = spark.createDataFrame([("2 3",)], "topik string")
    kwargs = {"strict": True}
    assert X.topic_labels(good, topics(spark), **kwargs).first()["topik_labels"] == "PPh, PPN"
    bad = spark.createDataFrame([(codes,)], "topik string")
    with pytest.raises(Exception, match="unknown topic code"):
        X.topic_labels(bad, topics(spark), **kwargs).collect()


def test_one_label_per_code(spark):
    twice = spark.createDataFrame([(2, "PPh"), (2, "Pajak"), (3, "PPN")], "uuid int, keterangan string")
    df = spark.createDataFrame([("2 3",)], "topik string")
    assert X.topic_labels(df, twice).first()["topik_labels"] == "PPh, PPN"


def test_no_topics_at_all(spark):
    df = spark.createDataFrame([("2 3",)], "topik string")
    assert X.topic_labels(df, topics(spark).limit(0)).first()["topik_labels"] == ""


RESULTS = (
    "query_id long, rank long, document string, metadata struct<answer:string,"
    "permalink:string,status_dokumen:string,topik:string,jenis_peraturan:string,"
    "nomor_peraturan:string>"
)


def results(spark):
    rows = [
        (1, 10, "q10", ("a10", "p", "A", "2", "UU", "2")),
        (1, 2, "q2", (None, "p", "A", "2 3", "PMK", "1/2024")),
        (1, 1, "q1", ("a1", "p", "A", "9", None, "1")),
    ]
    return spark.createDataFrame(rows, RESULTS)


def test_prompt_lines_follow_the_rank(spark):
    queries = spark.createDataFrame(
        [(1, "why {}?"), (2, "nothing found")], "query_id long, prompt string"
    )
    got = {r["query_id"]: r["prompt"] for r in X.rag_prompts(queries, results(spark)).collect()}
    assert got[1] == (
        "Konteks yang Tersedia:\n"
        "- q1 a1 [Sumber: None Nomor: 1] \n"
        "- q2 None [Sumber: PMK Nomor: 1/2024] \n"
        "- q10 a10 [Sumber: UU Nomor: 2] \n"
        "\n"
        "Pertanyaan Pengguna:\n"
        "why {}?"
    )
    assert got[2] == "Konteks yang Tersedia:\n\n\nPertanyaan Pengguna:\nnothing found"


def test_cards(spark):
    cards = X.citation_cards(results(spark), topics(spark)).orderBy("rank").collect()
    assert [c["topik_labels"] for c in cards] == ["", "PPh, PPN", "PPh"]
    assert cards[1]["heading"] == "**PMK Nomor: 1/2024**\n\n**ID**: `p`\n\n**Topik**: PPh, PPN"
    assert cards[1]["body"] == ":blue-badge[Tanya:] q2\n\n:green-badge[Jawab:] None"


def test_retrieved_keeps_rank(spark):
    vectors = spark.createDataFrame(
        [("x", "q", ("a", "p", "A", "2", "K", "1")), ("y", "r", ("b", "p", "A", "2", "K", "1"))],
        "id string, document string, metadata struct<answer:string,permalink:string,"
        "status_dokumen:string,topik:string,jenis_peraturan:string,nomor_peraturan:string>",
    )
    hits = spark.createDataFrame([(1, 1, "y"), (1, 2, "x"), (2, 1, "y")], "query_id long, rank long, id string")
    got = sorted((r[0], r[1], r[2]) for r in X.retrieved(hits, vectors).collect())
    assert got == [(1, 1, "r"), (1, 2, "q"), (2, 1, "r")]
