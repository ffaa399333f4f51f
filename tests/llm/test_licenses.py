from __future__ import annotations

import re

from lexsnap.llm import licenses as L

SCHEMA = "doc_id long, text string, words string, found int"

TEXTS = [
    None,
    "",
    "...",
    "Released under the MIT License.",
    "under the MIT license under the mit license",
    "under the, MIT: License!",
    "under themit license",
    "Licensed under the Apache License, Version 2.0. Licensed under CC BY-NC 4.0.",
    "This work is licensed under the GNU General Public License, either version",
    "ccé by nc; cc by nc",
    "x " * 5000 + "Permission is hereby granted, free of charge, to any person obtaining a copy of this software " + "y " * 5000,
    "permission is hereby granted to any person",
    "gnu lesser words general",
    "the and of to",
]


def words(text):
    low = (text or "").translate(str.maketrans(L.UPPER, L.LOWER))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def base(text):
    w, hits = words(text), []
    for label, phrase in L.BASE_PHRASES.items():
        p = phrase.split()
        hits += [(k, label) for k in range(len(w)) if w[k : k + len(p)] == p]
    return w, hits


def method(w, idf):
    """Labels and best share by trying every template of rare words at every place."""
    ranked = sorted((x for x in L.INDEXED if x in w), key=lambda x: (-idf[x], x))[: L.RARE_WORDS]
    out = []
    for label, text, key in L.TEMPLATES:
        t, k = text.split(), key.split()
        shift = next(i for i in range(len(t)) if t[i : i + len(k)] == k)
        for start in range(-len(t), len(w)):
            at = lambda q: w[start + q] if 0 <= start + q < len(w) else None
            if not any(at(q) == x and x in ranked for q, x in enumerate(t)):
                continue
            if any(at(shift + q) != x for q, x in enumerate(k)):
                continue
            weights = [idf.get(x, 0.25) for x in t]
            share = round(sum(v for q, (x, v) in enumerate(zip(t, weights)) if at(q) == x) / sum(weights), 9)
            if share >= L.LEAST_SHARE:
                out.append((label, share))
    return out


def test_scan_equals_brute_force(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "x", 2), (None, TEXTS[7], None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    idf = L.inverse_frequencies(L.licence_words(docs))
    got = sorted(L.scan_licenses(docs).drop("matches").collect(), key=str)
    want = []
    for doc_id, text, *_ in rows:
        w, hits = base(text)
        more = method(w, idf)
        starts = [k for k, _ in hits]
        labels = {x for _, x in hits}
        want.append(
            (
                doc_id, len(w), len(hits), min(starts, default=None), max(starts, default=None),
                ",".join(sorted(labels)), ",".join(sorted(labels | {x for x, _ in more})),
                1.0 if hits else max((s for _, s in more), default=0.0),
            )
        )
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)



def test_templates_hold_their_keys_and_an_indexed_word():
    for _, text, key in L.TEMPLATES:
        assert f" {key} " in f" {text} "
        assert set(text.split()) & set(L.INDEXED)
    for phrase in L.BASE_PHRASES.values():
        assert set(phrase.split()) & set(L.INDEXED)


def test_empty_table_and_plan_without_python(spark):
    scanned = L.scan_licenses(spark.createDataFrame([], SCHEMA))
    assert scanned.count() == 0
    plan = scanned._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def everywhere(w, idf):
    """Labels and best share by trying every template at every place, however it is found."""
    out = []
    for label, text, key in L.TEMPLATES:
        t, k = text.split(), key.split()
        shift = next(i for i in range(len(t)) if t[i : i + len(k)] == k)
        weights = [idf.get(x, 0.25) for x in t]
        for at in range(len(w)):
            if w[at : at + len(k)] == k:
                there = [0 <= at - shift + q < len(w) and w[at - shift + q] == x for q, x in enumerate(t)]
                share = round(sum(v for v, held in zip(weights, there) if held) / sum(weights), 9)
                out += [(label, share)] * (share >= L.LEAST_SHARE)
    return out


def test_every_licence_beside_every_other(spark):
    texts = [f"{a}. {b}" for _, a, _ in L.TEMPLATES for _, b, _ in L.TEMPLATES]
    texts += [" ".join(x for _, x, _ in L.TEMPLATES), " ".join(L.INDEXED) + " " + L.TEMPLATES[7][1]]
    docs = spark.createDataFrame([(i, t, None, 1) for i, t in enumerate(texts)], SCHEMA)
    idf = L.inverse_frequencies(L.licence_words(docs))
    for row in L.scan_licenses(docs).collect():
        w, hits = base(texts[row.doc_id])
        assert row.labels == ",".join(sorted({x for _, x in hits} | {x for x, _ in everywhere(w, idf)})), texts[row.doc_id]
    both = f"{L.TEMPLATES[1][1]} {L.TEMPLATES[7][1]}"
    assert L.scan_licenses(spark.createDataFrame([(1, both, None, 1)], SCHEMA)).first().labels == "gpl,mit"
