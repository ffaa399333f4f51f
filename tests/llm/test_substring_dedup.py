from __future__ import annotations

import hashlib
import random

from lexsnap.llm import substring_dedup as S

SCHEMA = "doc_id long, text string, rank string"


def brute(rows):
    """n_words, n_removed, sha of kept words, by looking every window up."""
    split = [(i, (t or "").encode().split()) for i, t, *_ in rows]
    least = -(1 << 63)
    first = {}
    for i, w in split:
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            first[key] = min(first.get(key, 1 << 63), least if i is None else i)
    out = []
    for i, w in split:
        gone, seen = set(), set()
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            if first[key] < (least if i is None else i) or key in seen:
                gone.update(range(k, k + 20))
            seen.add(key)
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(5)
    word = lambda: "w%d" % rng.randrange(3000)
    passage = [word() for _ in range(60)]
    rows = [(0, None), (1, ""), (2, "short text"), (None, " ".join(passage[:30]))]
    for k in range(40):
        text = [word() for _ in range(rng.randrange(0, 200))]
        for _ in range(rng.randrange(0, 3)):
            a = rng.randrange(0, 45)
            at = rng.randrange(0, len(text) + 1)
            text[at:at] = passage[a : a + rng.randrange(5, 60)]
        rows.append((10 + k, " ".join(text)))
    rows.append((60, "a a\ta\n" * 40))
    rows.append((61, "a " * 25))
    rows.append((62, " ".join(passage + passage)))
    rows += [(63, rows[20][1]), (63, rows[20][1]), (63, rows[21][1]), (5, " ".join(word() for _ in range(50)))]
    rows.append((64, "A b " * 30))
    return [(i, t, "x") for i, t in rows]


def test_every_window_against_brute_force(spark):
    rows = corpus()
    got = S.factor_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == brute(rows)
    for r in got:
        assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256
        assert all(f.length >= 20 for f in r.factors)
        covered = {k for f in r.factors for k in range(f.start, f.start + f.length)}
        assert len(covered) == r.n_removed


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    rows = corpus()
    monkeypatch.setattr(S, "_MOST_FILTER_BITS", 1 << 15)
    monkeypatch.setattr(S, "_bit_filter", lambda blocks: bytearray(b"\xff" * (1 << 12)))
    got = S.factor_duplicates(spark.createDataFrame(rows, SCHEMA), with_text=False).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == brute(rows)


def test_empty_table(spark):
    assert S.factor_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
