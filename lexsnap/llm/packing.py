"""Order-preserving packing: dynamic programming over cuts of a token stream.

A task reads its documents in order and lines their tokens up. Cuts are allowed at
document ends (free), sentence ends and, where a sentence runs long, every GRID_TOKENS
(both at a penalty). With p the place of a cut, the cheapest packing up to it is

    cost(j) = penalty(j) + min over i with p(j) - p(i) <= SEQUENCE_TOKENS of
              cost(i) + padding(p(j) - p(i))

The padding SEQUENCE_TOKENS - (p(j) - p(i)) splits into a part of i and a part of j, so
the minimum over the sliding window comes from a monotone queue. A sequence whose
length is a power of two needs no padding; those few transitions are looked up apart.
"""

from __future__ import annotations

import re
import sys
import types
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexsnap.llm.words import in_small_batches, row_slices

SEQUENCE_TOKENS = 1024
GRID_TOKENS = 64
# Penalties in tokens of padding.
SENTENCE_CUT, HARD_CUT = 4, 24
END_TOKEN = 0
# Tokens packed at a time; the cut after them is forced, which costs one padding.
STREAM_TOKENS = 1 << 20
# Words that a worker keeps: two generations of so many, none longer than KNOWN_LETTERS.
# That is some 250 MB per worker at most, and a quarter more for words without a blank.
GENERATION_WORDS = 1 << 19
KNOWN_LETTERS = 64
# Of texts that are Python strings at a time, one text at least.
SLICE_BYTES = 1 << 20

# Starts with the blank, which the search then skips to.
_SPACE_NEXT_TO_SPACE = re.compile(r" (?:\s|(?<=\s ))")
_BEFORE_WORD = re.compile(r"(?= \S)")
_STOPS = ".,;:!?"
MOST_STOPS = 4  # in a run of them that is kept: a few thousand runs
# Single line ends between other characters than white space, and no other white space.
_LINE_END = re.compile(r"\A\S+(?:\n\S+)+\Z")


def _byte_letters() -> dict[int, int]:
    """The letters that byte-level BPE writes bytes as: printable ones stay, others follow 255."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(printable)]
    return {b: b for b in printable} | {b: 256 + k for k, b in enumerate(other)}


class Ids(dict):
    """Token ids (little-endian bytes) of words, with a blank before or bare.

    Byte-level BPE splits a text into words before it merges, and a blank before a word
    belongs to that word. So a text cut before such blanks gives the same ids, and a
    word met before needs no new encoding. The same holds for letters, the stops behind
    them and a line end between words, which is put together each time; a run of letters
    goes straight to the tokenizer's merges. A full table becomes the old generation; a word of that one is
    taken over when it is met again, and the rest goes when the next table is full.
    """

    def __init__(self, tokenizer, blank: str = " ", size: int | None = None):
        super().__init__()
        self.size = size or GENERATION_WORDS
        self.old: dict[str, bytes] = {}
        self.encode, self.merge = tokenizer.encode, tokenizer.model.tokenize
        self.letters = _byte_letters()
        self.blank, self.written = blank, blank.translate(self.letters)
        self.bare = Ids(tokenizer, "", max(1, self.size // 4)) if blank else self
        self.stops: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        value = self.old.get(word)
        if value is None:
            value = self.new(word)
        if len(word) <= KNOWN_LETTERS and "\n" not in word:
            if len(self) >= self.size:
                self.old = dict(self)
                self.clear()
            self[word] = value
        return value

    def new(self, word: str) -> bytes:
        letters = word.rstrip(_STOPS)
        if letters.isalpha():
            if len(letters) < len(word):
                return self[letters] + self.stop(word[len(letters) :])
            if word.isascii():
                raw = self.written + word
            else:
                raw = self.written + word.encode().decode("latin-1").translate(self.letters)
            return array("I", [token.id for token in self.merge(raw)]).tobytes()
        if _LINE_END.search(word):
            first, *lines = word.split("\n")
            return self[first] + b"".join(self.stop("\n") + self.bare[line] for line in lines)
        return self.plain(self.blank + word)

    def stop(self, text: str) -> bytes:
        if len(text) > MOST_STOPS:
            return self.plain(text)
        if text not in self.stops:
            self.stops[text] = self.plain(text)
        return self.stops[text]

    def plain(self, text: str) -> bytes:
        return array("I", self.encode(text, add_special_tokens=False).ids).tobytes()

    def of(self, text: str) -> np.ndarray:
        if _SPACE_NEXT_TO_SPACE.search(text):
            first, *rest = _BEFORE_WORD.split(text)
            rest = [word[1:] for word in rest]
        else:
            first, *rest = text.split(" ")
        return np.frombuffer(self.plain(first) + b"".join(map(self.__getitem__, rest)), "<u4")


def sentence_ends(tokenizer) -> np.ndarray:
    """Which ids end a sentence: their text ends in a full stop or the like, or a line end."""
    size = tokenizer.get_vocab_size()
    ends = np.zeros(size, bool)
    for token, number in tokenizer.get_vocab().items():
        text = tokenizer.decode([number], skip_special_tokens=False)
        ends[number] = bool(text) and text.rstrip(" ")[-1:] in {".", "!", "?", "\n", "。", "！", "？"}
    return ends


def candidates(ids: np.ndarray, ends: np.ndarray, doc_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where a cut may lie (0 and the end included), and each one's penalty."""
    penalty = np.full(len(ids) + 1, -1, np.int32)
    penalty[1:][ends[ids]] = SENTENCE_CUT
    penalty[0] = 0
    penalty[doc_ends] = 0
    places = np.flatnonzero(penalty >= 0)
    long = np.flatnonzero(np.diff(places) > GRID_TOKENS)
    if len(long):
        grid = np.concatenate([np.arange(places[k] + GRID_TOKENS, places[k + 1], GRID_TOKENS) for k in long])
        penalty[grid] = HARD_CUT
        places = np.flatnonzero(penalty >= 0)
    return places, penalty[places]


def best_cuts(places: np.ndarray, penalties: np.ndarray, limit: int = SEQUENCE_TOKENS) -> list[int]:
    """Indices into ``places`` of the cheapest cuts, the last place included.

    No two neighbouring places may lie more than ``limit`` apart.
    """
    place, penalty = places.tolist(), penalties.tolist()
    exact = _exact_transitions(places, limit)
    cost, came = [0] * len(place), [0] * len(place)
    queue: deque[int] = deque([0])
    key = [place[0]] * len(place)  # cost + place, the part of a transition that belongs to i
    for j in range(1, len(place)):
        p = place[j]
        while place[queue[0]] < p - limit:
            queue.popleft()
        i = queue[0]
        best = key[i] + limit - p
        if j in exact:
            for k in exact[j]:
                if cost[k] < best:
                    best, i = cost[k], k
        best += penalty[j]
        cost[j], came[j] = best, i
        value = key[j] = best + p
        while queue and key[queue[-1]] >= value:
            queue.pop()
        queue.append(j)
    cuts, j = [], len(place) - 1
    while j:
        cuts.append(j)
        j = came[j]
    return cuts[::-1]


def _exact_transitions(places: np.ndarray, limit: int) -> dict[int, list[int]]:
    """For each place, the earlier ones that lie a power of two below ``limit`` before."""
    number = np.full(int(places[-1]) + 1, -1, np.int32)
    number[places] = np.arange(len(places))
    out: dict[int, list[int]] = {}
    for power in (1 << k for k in range(limit.bit_length()) if 1 << k < limit):
        after = np.flatnonzero(places >= power)
        before = number[places[after] - power]
        hit = before >= 0
        for j, k in zip(after[hit].tolist(), before[hit].tolist()):
            out.setdefault(j, []).append(k)
    return out


class Packer:
    """Packs the documents of one task, STREAM_TOKENS at a time."""

    def __init__(self, ends: np.ndarray, first_sequence: int):
        self.ends, self.sequence = ends, first_sequence
        self.docs: list[tuple[int | None, int, int]] = []  # doc_id, tokens before, all its tokens
        self.parts: list[np.ndarray] = []
        self.held = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        for start in range(0, len(ids), STREAM_TOKENS):
            part = ids[start : start + STREAM_TOKENS]
            if self.held + len(part) > STREAM_TOKENS:
                yield from self.flush()
            self.docs.append((doc_id, start, len(ids)))
            self.parts.append(part)
            self.held += len(part)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        ids = np.concatenate(self.parts).astype("<u4", copy=False)
        doc_ends = np.cumsum([len(p) for p in self.parts])
        places, penalties = candidates(ids, self.ends, doc_ends)
        cuts = places[best_cuts(places, penalties)]
        # Pieces lie between neighbouring cuts of either kind.
        stops = np.union1d(cuts, doc_ends)
        starts = np.append(0, stops[:-1])
        doc = np.searchsorted(doc_ends, starts, side="right")
        doc_starts = np.append(0, doc_ends[:-1])
        sequence = np.searchsorted(cuts, starts, side="right")
        sequence_starts = np.append(0, cuts[:-1])
        before = np.array([d[1] for d in self.docs])
        raw = ids.tobytes()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([self.docs[k][0] for k in doc], pa.int64()),
                pa.array(before[doc] + starts - doc_starts[doc], pa.int64()),
                pa.array(stops - starts, pa.int64()),
                pa.array([raw[4 * a : 4 * b] for a, b in zip(starts.tolist(), stops.tolist())], pa.binary()),
                pa.array([self.docs[k][2] for k in doc], pa.int64()),
                pa.array(self.sequence + sequence, pa.int64()),
                pa.array(starts - sequence_starts[sequence], pa.int64()),
            ],
            ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
        )
        self.sequence += len(cuts)
        self.docs, self.parts, self.held = [], [], 0


def _tokenizer(path: str, known_words: int) -> tuple[Ids, np.ndarray]:
    """Tokenizer and known ids, kept as long as the Python worker lives."""
    from tokenizers import Tokenizer

    store = sys.modules.setdefault("_lexsnap_worker", types.ModuleType("_lexsnap_worker")).__dict__
    key = f"{path} {known_words}"
    if key not in store:
        tokenizer = Tokenizer.from_file(path)
        store[key] = Ids(tokenizer, size=known_words), sentence_ends(tokenizer)
    return store[key]


def _pack(path: str, known_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, ends = _tokenizer(path, known_words)
        end = np.array([END_TOKEN], "<u4")
        packer = Packer(ends, TaskContext.get().partitionId() << 40)
        for batch in row_slices(batches, "text", SLICE_BYTES):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                yield from packer.add(doc_id, np.concatenate([ids.of(text or ""), end]))
        yield from packer.flush()

    return run


def pack(docs: DataFrame, tokenizer_path: str, known_words: int = GENERATION_WORDS) -> DataFrame:
    """Pack ``(doc_id, text, …)`` into sequences of at most SEQUENCE_TOKENS tokens.

    ``tokenizer_path`` names a tokenizer file that executors can open. A document is its
    ids and END_TOKEN; a null text has only that one. A row comes back per piece:
    ``(doc_id, start, length, ids, doc_tokens, sequence_id, offset)``, with ``ids``
    unsigned 32-bit little-endian. Pieces keep the order of the rows within a partition,
    repeated rows and null doc_ids are documents like others, and nothing is shuffled.
    sequence_id is unique over all partitions; other columns are not read.
    ``known_words`` trades a worker's memory (some 400 bytes each) for time.
    """
    rows = in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(
        _pack(tokenizer_path, known_words),
        "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long",
    )

