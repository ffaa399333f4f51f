from __future__ import annotations

import random
import re
from itertools import permutations

import pytest

from lexsnap.llm import filter_audit as A

DOCS = "doc_id long, text string, source string, mask string, part string, least long"
LABELS = "doc_id long, quality int, toxic int, part string"


def brute(docs, labels):
    good = {i for i, q, *_ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t, *_ in labels if t == 1 and i is not None}
    rows = []
    for i, text, source, *_ in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = set()
        if len(words) < 200:
            fails.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text):
            fails.add("C")
        if re.search(r"[#$%&*|]", text):
            fails.add("D")
        if i is not None and any(j is not None and j < i and (t or "") == text for j, t, *_ in docs):
            fails.add("E")
        rows.append((source or "", fails, i in good, i in toxic))
    out = []
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        steps, shapley = [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, letter in enumerate(order, 1):
                removed = [r for r in left if letter in r[1]]
                left = [r for r in left if letter not in r[1]]
                earlier = set(order[: step - 1])
                shapley[letter] += len(removed)
                steps.append((letter, (part, "".join(order), step, len(left), len(removed),
                              sum(letter in r[1] and bool(r[1] & earlier) for r in mine),
                              sum(r[1] == {letter} for r in mine), sum(r[2] for r in removed), sum(r[3] for r in removed))))
        out += [(*row, shapley[letter]) for letter, row in steps]
    return sorted(out)


def corpus():
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefgé") for _ in range(n))
    texts = [None, "", " \t\n", "A", "é" * 30, "x y x y", "#", "Same Beginning", "Same Beginning and more", "Same"]
    texts += [" ".join(word(4) for _ in range(n)) for n in (5, 199, 200, 201, 400, 3000)]
    texts += [" ".join(["go", "on", word(3)] * 90), " ".join(word(3) for _ in range(250)) + " a|b", "ABC " + " ".join(word(5) for _ in range(210))]
    texts += [texts[11][:400] + word(9) for _ in range(12)]  # the same beginning, other ends
    rows = [(k, rng.choice(texts), rng.choice(["s0", "s1", None, ""]), "m", "p", 7) for k in range(300)]
    rows += [(None, texts[12], "s0", "", "", 0), (None, "only without id", "s2", "", "", 0), (5, texts[12], "s0", "", "", 0), (5, texts[12], "s0", "", "", 0)]
    rows += [(1000 + k, texts[13], "s1", "", "", 0) for k in range(80)]
    rng.shuffle(rows)
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None]), "x") for k in range(0, 1200, 2)]
    labels += [(4, 1, 0, "x"), (4, 0, 1, "x"), (None, 1, 1, "x")]
    return rows, labels


@pytest.mark.parametrize("small", [False, True])
def test_audit_equals_brute_force(spark, monkeypatch, small):
    if small:  # many groups, prefixes that are lengthened, many tries
        monkeypatch.setattr(A, "GROUP_BYTES", 2000)
        monkeypatch.setattr(A, "RANGE_BYTES", 500)
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    got = A.audit_filters(docs, spark.createDataFrame(labels, LABELS))
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, labels)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_prefixes_grow_where_many_texts_share_them(spark):
    texts = ["common beginning of many " * 30 + str(k) for k in range(20)] + ["other %d" % k for k in range(20)]
    rows = A.with_prefixes(spark.createDataFrame([(t.encode(),) for t in texts], "text binary"), 3000).collect()
    lengths = {len(r.prefix) for r in rows if r.text.startswith(b"common")}
    assert min(lengths) > 700
    assert {len(r.prefix) for r in rows if r.text.startswith(b"other")} == {7, 8}


def test_trie_holds_the_smallest_id_of_each_whole_text():
    rng = random.Random(1)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 9))) for _ in range(500)]
    texts += [b"x" * 100_000 + t for t in texts[:50]]
    trie = A.Trie()
    for k, text in enumerate(texts):
        trie.insert(text, 1000 - k, k)
    least = {t: min(1000 - k for k, u in enumerate(texts) if u == t) for t in set(texts)}
    assert sorted(trie.repeated()) == [k for k, t in enumerate(texts) if least[t] < 1000 - k]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    assert A.audit_filters(docs, spark.createDataFrame([], LABELS)).count() == 0
