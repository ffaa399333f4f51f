from __future__ import annotations

import hashlib
import math

import pytest

from lexsnap.llm import mixing as M

SCHEMA = "doc_id long, text string, source string, sums string, copy int"


def draw(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:13], 16) / 2.0**52


def poisson(rate, seed, key):
    count = 0
    parts = max(1, math.ceil(rate / M.PART_RATE))
    r = rate / parts
    for part in range(1, parts + 1):
        p = total = math.exp(-r)
        sums = [total]
        for k in range(1, M.LAST_COUNT + 1):
            p = p * r / k
            total += p
            sums.append(total)
        u = draw(seed, key, part)
        count += sum(s <= u for s in sums)
    return count


@pytest.mark.parametrize("epochs", [1, 150])
def test_copies_follow_the_inverse_distribution(spark, epochs):
    rows = [(i, "t" * (i % 17), ["a", "b", None][i % 3], "x", 9) for i in range(300)]
    rows += [(None, "no id", "a", "x", 9), (None, None, "b", None, None), (7, "t" * 7, "b", "x", 9)]
    docs = spark.createDataFrame(rows, SCHEMA)
    weights = {"a": 3}
    got = M.mixed(docs, weights, epochs=epochs).collect()
    size = {}
    for _, text, source, *_ in rows:
        size[source] = size.get(source, 0) + len(text or "") + 1
    weight = {s: weights.get(s, 1) for s in size}
    rate = {s: weight[s] * sum(size.values()) * epochs / (size[s] * sum(weight.values())) for s in size}
    want = []
    for doc_id, text, source, sums, _ in rows:
        key = doc_id if doc_id is not None else hashlib.md5((text or "").encode()).hexdigest()
        n = poisson(rate[source], 17, key)
        want += [(doc_id, text, source, sums, copy, n) for copy in range(1, n + 1)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_shares_come_out_as_asked(spark):
    rows = [(i, "word " * 5, "big" if i % 10 else "small", None, None) for i in range(20000)]
    got = M.mixed(spark.createDataFrame(rows, SCHEMA), {"small": 3, "big": 1}).groupBy("source").count().collect()
    count = {r["source"]: r["count"] for r in got}
    assert abs(count["small"] / sum(count.values()) - 0.75) < 0.03
    assert abs(sum(count.values()) / 20000 - 1) < 0.05


def test_empty_table_and_plan_without_python(spark):
    mixed = M.mixed(spark.createDataFrame([], SCHEMA), {"a": 2})
    assert mixed.count() == 0 and mixed.columns == ["doc_id", "text", "source", "sums", "copy", "n_copies"]
    assert "Python" not in mixed._jdf.queryExecution().executedPlan().toString()
