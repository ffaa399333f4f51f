from __future__ import annotations

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexsnap.llm.words import size_in_bytes
from lexsnap.llm import exact_dedup as E

SCHEMA = "doc_id long, text string, lang string, kept string"


def brute(rows):
    """(doc_id, keep_id, size, kept, digest) by plain comparison, kept once per repeated row."""
    lower = str.maketrans(E.UPPER, E.LOWER)
    groups = {}
    for doc_id, text, *_ in rows:
        groups.setdefault((text or "").translate(lower), []).append(doc_id)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        digest = hashlib.sha256(text.encode()).hexdigest()
        left = [1]
        for i in sorted(ids, key=str):
            kept = i == keep and bool(left) and bool(left.pop())
            out.append((i, keep, len(ids), kept, digest))
    return sorted(out, key=str)


@given(st.binary(max_size=5000), st.lists(st.integers(0, 5000), max_size=4))
@settings(max_examples=40, deadline=None)
def test_fingerprints_compose_over_any_chunks(data, cuts):
    edges = [0, *sorted(min(c, len(data)) for c in cuts), len(data)]
    parts = [data[a:b] for a, b in zip(edges, edges[1:])]
    residues = E.fingerprints(parts)
    import numpy as np

    shifted = E.shift(residues, np.array([len(data) - b for b in edges[1:]]))
    whole = E.fingerprints([data])[0]
    assert [sum(int(x) for x in column) % p for column, p in zip(shifted.T, E.MODULI)] == whole.tolist()
    direct = [0] * len(E.MODULI)
    for byte in data:
        direct = [(h * E.BASE + byte) % p for h, p in zip(direct, E.MODULI)]
    assert direct == whole.tolist()


ROWS = [
    (1, "Same Text", "en", "x"),
    (2, "same text", "en", None),
    (3, "sAME tEXT", None, "y"),
    (4, None, "en", "x"),
    (5, "", "en", "x"),
    (6, "ÄB", "de", "x"),
    (7, "äB", "de", "x"),
    (8, "long " * 700 + "a", "en", "x"),
    (9, "LONG " * 700 + "A", "en", "x"),
    (10, "long " * 700 + "b", "en", "x"),
    (3, "same text", "en", "again"),
    (None, "same text", "en", "no id"),
    (None, "only without id", "en", "no id"),
]


@pytest.mark.parametrize("moduli", [E.MODULI, (2,)])
def test_groups_equal_brute_force_even_when_fingerprints_collide(spark, moduli):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    got = [tuple(r) for r in E.exact_groups(docs, chunk_bytes=64, moduli=moduli).collect()]
    assert sorted(got, key=str) == brute(ROWS)


def test_deduplicated_keeps_one_row_with_all_columns(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    rest = E.deduplicated(docs)
    assert rest.columns == docs.columns
    ids = sorted((r.doc_id for r in rest.collect()), key=str)
    assert ids == sorted([3, 5, 6, 7, 9, 10, None], key=str)


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert E.exact_groups(docs).count() == 0
    assert E.deduplicated(docs).count() == 0


def test_sizes_of_batches_as_spark_writes_them():
    sizes = {"1024": 1024, "64m": 64 << 20, "1g": 1 << 30, "8MB": 8 << 20, "100b": 100, "2k": 2048, "-1": -1}
    assert {text: size_in_bytes(text) for text in sizes} == sizes
