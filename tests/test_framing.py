"""Files whose records span lines, read by many tasks."""

from __future__ import annotations

import json
import random

import pytest

from lexsnap.sources import framing as G
from lexsnap.sources import tables as S

SCHEMA = "id long, text string, v double"
NESTED = SCHEMA + ", n struct<a: array<struct<b: string>>>"
BITS = ["a", "b,", '"', "\n", "\r\n", "\r", " ", "é", "}", "{", "[", "]", "\\", '\\"', "long " * 40, ""]


@pytest.fixture(scope="module")
def small_splits(spark):
    """A session whose files are dealt out in splits of some hundred bytes."""
    session = spark.newSession()
    settings = {
        "spark.sql.files.maxPartitionBytes": "600",
        "spark.sql.files.openCostInBytes": "0",
        "spark.sql.files.minPartitionNum": "1",
        "spark.sql.shuffle.partitions": "4",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    }
    for key, value in settings.items():
        session.conf.set(key, value)
    return session


def rows(seed):
    rng = random.Random(seed)
    out = []
    for k in range(120):
        text = "".join(rng.choice(BITS) for _ in range(rng.randrange(0, 10))) if rng.random() < 0.9 else None
        out.append((k, text, rng.choice([1.5, None])))
    out[30] = (30, 'spans "splits\n"}{[' * 120, None)
    out[31] = (31, "}\n" * 500, 0.5)
    return out


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_csv_of_many_splits_equals_the_read_by_one_task(small_splits, tmp_path):
    path = str(tmp_path / "c")
    data = rows(1)
    S.write_csv(small_splits.createDataFrame(data, SCHEMA).coalesce(2), path)
    lines = small_splits.read.text(path)
    assert lines.rdd.getNumPartitions() > 15
    got = plain(S.read_csv(small_splits, path, SCHEMA, splittable=True))
    assert got == sorted(data, key=str) == plain(S.read_csv(small_splits, path, SCHEMA))


@pytest.mark.parametrize("indent", [None, 2])
def test_arrays_of_many_splits_equal_the_read_by_one_task(small_splits, tmp_path, indent):
    data = rows(2)
    records = [{"id": k, "text": t, "v": v, "n": {"a": [{"b": t}, {}]}} for k, t, v in data]
    (tmp_path / "x.json").write_text(json.dumps(records, indent=indent))
    (tmp_path / "empty.json").write_text(" [\n] \n")
    (tmp_path / "one.json").write_text('[{"id": 7, "text": "]}"}]')
    path = str(tmp_path / "*.json")
    many = S.read_json(small_splits, path, NESTED, array_of_rows=True, splittable=True)
    assert small_splits.read.option("lineSep", "}").text(path).rdd.getNumPartitions() > 10
    assert len(plain(many)) == len(data) + 1
    assert plain(many) == plain(S.read_json(small_splits, path, NESTED, array_of_rows=True))


def test_written_arrays_are_arrays(spark, small_splits, tmp_path):
    path = str(tmp_path / "a")
    data = rows(3)
    S.write_json(spark.createDataFrame(data, SCHEMA).repartition(3), path, array_of_rows=True)
    files = [json.loads(p.read_text()) for p in tmp_path.rglob("part-*")]
    assert sorted(((r["id"], r["text"], r["v"]) for f in files for r in f), key=str) == sorted(data, key=str)
    got = S.read_json(small_splits, path, SCHEMA, array_of_rows=True, splittable=True)
    assert plain(got) == sorted(data, key=str)
    none = str(tmp_path / "none")
    S.write_json(spark.createDataFrame([], SCHEMA), none, array_of_rows=True)
    assert plain(S.read_json(small_splits, none, SCHEMA, array_of_rows=True, splittable=True)) == []


@pytest.mark.parametrize("text", ['[{"id": 1}, 5, {"id": 2}]', '[{"id": 1}, {"id": ', '[{"id": 1}] junk'])
def test_bad_arrays_are_errors(small_splits, tmp_path, text):
    (tmp_path / "x.json").write_text(text)
    with pytest.raises(Exception, match="MALFORMED_RECORD|Malformed"):
        S.read_json(small_splits, str(tmp_path), SCHEMA, array_of_rows=True, splittable=True).collect()


def test_a_record_without_its_end_is_kept_as_the_one_task_read_keeps_it(small_splits, tmp_path):
    (tmp_path / "x.csv").write_text('id,text,v\n1,"a\nb",1.5\n2,c,')
    for splittable in (False, True):
        got = S.read_csv(small_splits, str(tmp_path), SCHEMA, splittable=splittable)
        assert plain(got) == [(1, "a\nb", 1.5), (2, "c", None)]


def test_json_effects_add_up_for_either_state():
    text = json.dumps([{"a": '}"{\\', "b": [1, {"c": "]"}]}, {"d": "\\\""}])
    for cut in range(len(text)):
        if text[cut] != "}":
            continue
        inside = depth = 0
        for part in text[: cut + 1].split("}")[:-1]:
            quotes, closed, open_ = G.JsonArrayFraming.effect(part)
            depth += open_ if inside else closed
            inside ^= quotes & 1
        # By hand: characters one after the other.
        want_inside = want_depth = 0
        escaped = False
        for c in text[: cut + 1]:
            if escaped:
                escaped = False
            elif want_inside and c == "\\":
                escaped = True
            elif c == '"':
                want_inside ^= 1
            elif not want_inside:
                want_depth += (c in "{[") - (c in "}]")
        assert (inside, depth) == (want_inside, want_depth)
