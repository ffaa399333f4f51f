from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lexsnap.llm import packing as K

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, ids string"


def padding(length, limit):
    return 0 if length & (length - 1) == 0 else limit - length


def cheapest(places, penalties, limit):
    cost = [0] + [None] * (len(places) - 1)
    for j in range(1, len(places)):
        options = [cost[i] + padding(places[j] - places[i], limit) for i in range(j) if places[j] - places[i] <= limit]
        cost[j] = min(options) + penalties[j]
    return cost[-1]


@pytest.mark.parametrize("seed", range(30))
def test_cuts_are_the_cheapest(seed):
    rng = random.Random(seed)
    places = [0]
    for _ in range(rng.randrange(1, 60)):
        places.append(places[-1] + rng.randrange(1, 13))
    penalties = [0] + [rng.choice([0, 4, 24]) for _ in places[1:]]
    cuts = K.best_cuts(np.array(places), np.array(penalties), 32)
    total, before = 0, 0
    for j in cuts:
        length = places[j] - places[before]
        assert length <= 32
        total, before = total + padding(length, 32) + penalties[j], j
    assert before == len(places) - 1
    assert total == cheapest(places, penalties, 32)


TEXTS = [
    "Hello world. This is a test! And another one?\nNew line.", "a  b   c \n d", "  lead", "trail  ", "", None,
    "it's we'll 12 3.5% x-y_z", "\x1c a \x1c b", "line.\n\nnext  .\n z", "word.\nNext,\nlast;   nbsp", "äöü ñ 漢字 🙂 é",
    "x" * 5000, "long sentence without any stop " * 3000, "One. " * 4000, "<|endoftext|>", "A.\nb.\n.c\n", "tab\tin\tword",
]


@pytest.mark.parametrize("size", [None, 1, 7])
def test_ids_are_those_of_the_tokenizer(size):
    tokenizer = Tokenizer.from_file(PATH)
    ids = K.Ids(tokenizer, size=size)
    for text in TEXTS:
        for _ in range(2):
            assert ids.of(text or "").tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids, text


def test_known_words_are_bounded_and_met_ones_stay():
    ids = K.Ids(Tokenizer.from_file(PATH), size=50)
    encoded = []
    fresh = ids.new
    ids.new = lambda word: encoded.append(word) or fresh(word)
    for k in range(1000):
        ids.of(f"a often w{k} {'y' * 100} {'!' * 50}")
        assert len(ids) <= 50 and len(ids.old) <= 50 and len(ids.stops) < 5
    assert encoded.count("often") == 1 and encoded.count("w500") == 1
    assert encoded.count("y" * 100) == 1000  # long words are not kept


@pytest.mark.parametrize("stream", [1 << 21, 1000])
def test_every_token_lies_in_one_piece(spark, monkeypatch, stream):
    monkeypatch.setattr(K, "STREAM_TOKENS", stream)
    tokenizer = Tokenizer.from_file(PATH)
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(3, "again", None), (None, "no id", None)]
    pieces = K.pack(spark.createDataFrame(rows, SCHEMA).coalesce(1), PATH).collect()
    sequences, documents = {}, []
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
        if p.start == 0:
            documents.append((p.doc_id, p.doc_tokens, []))
        ids = np.frombuffer(p.ids, "<u4").tolist()
        assert len(ids) == p.length and len(documents[-1][2]) == p.start and documents[-1][0] == p.doc_id
        documents[-1][2].extend(ids)
    want = [(i, tokenizer.encode(t or "", add_special_tokens=False).ids + [0]) for i, t, _ in rows]
    assert [(i, ids) for i, _, ids in documents] == want
    assert all(n == len(ids) for _, n, ids in documents)
    for parts in sequences.values():
        offsets = [0]
        for offset, length in sorted(parts):
            assert offset == offsets[-1]
            offsets.append(offset + length)
        assert offsets[-1] <= K.SEQUENCE_TOKENS
    assert K.pack(spark.createDataFrame([], SCHEMA), PATH).count() == 0


def test_little_padding_and_crc(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    pieces = K.pack(docs, PATH).withColumn("crc", F.crc32("ids")).collect()
    assert all(p.crc == zlib.crc32(p.ids) for p in pieces)
    lengths = {}
    for p in pieces:
        lengths[p.sequence_id] = lengths.get(p.sequence_id, 0) + p.length
    lost = sum(padding(n, K.SEQUENCE_TOKENS) for n in lengths.values())
    assert lost < 0.03 * sum(lengths.values())


def test_pieces_do_not_depend_on_the_known_words(spark):
    texts = [" ".join(f"w{n * k % 97}x" for k in range(400)) + "." for n in range(20)] + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    few, many = (sorted(map(tuple, K.pack(docs, PATH, *size).collect())) for size in ([8], []))
    assert few == many and len({row[0] for row in few}) == 22
