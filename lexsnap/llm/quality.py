"""Quality classifier: random Fourier features of document statistics, ridge, isotonic.

Documents become a few dozen statistics of their whole text. A fixed random map takes
them to features whose products approximate a Gaussian kernel. Each task sums the
normal equations of its rows, the sums are added up, and one small system is solved.
An isotonic step function then turns raw scores into probabilities; it is fitted on
training rows that the ridge fit has not seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexsnap.llm.words import in_small_batches, row_slices, sent_when_small
from lexsnap.session import materialize

FEATURES = 384
WIDTH = 8.0  # of the kernel, in standard deviations
RIDGE = 1e-4
SEED = 20240101
SCORE_BINS = 2048  # of raw scores from -0.5 to 1.5, for calibration
REDUCERS = 16  # tasks that add up the matrices of all others
CALIBRATION_FOLDS = 5  # one of so many training rows calibrates

_UPPER = np.zeros(256)
_UPPER[65:91] = 1
_LOWER = np.zeros(256)
_LOWER[97:123] = 1
_DIGIT = np.zeros(256)
_DIGIT[48:58] = 1
_SPACE = np.zeros(256)
_SPACE[[9, 10, 11, 12, 13, 32]] = 1
_STOP = np.zeros(256)
_STOP[[33, 46, 63]] = 1
_COMMA = np.zeros(256)
_COMMA[[44, 58, 59]] = 1
_HIGH = np.zeros(256)
_HIGH[128:] = 1
_LINE = np.zeros(256)
_LINE[10] = 1
_OTHER = 1 - np.minimum(1, _UPPER + _LOWER + _DIGIT + _SPACE + _STOP + _COMMA + _HIGH)
_CLASSES = np.stack([_UPPER, _LOWER, _DIGIT, _SPACE, _STOP, _COMMA, _HIGH, _LINE, _OTHER], axis=1)
STATISTICS = 24


def statistics(text: str | None) -> np.ndarray:
    """STATISTICS numbers about a whole text; all but the length are shares or means."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(STATISTICS)
    if not raw:
        return out
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size = len(raw)
    out[0] = np.log1p(size)
    out[1:10] = counts @ _CLASSES / size
    share = counts[counts > 0] / size
    out[10] = -(share * np.log(share)).sum()
    words = raw.split()
    n = len(words)
    if n:
        lengths = np.fromiter(map(len, words), np.int64, n)
        different = set(words)
        out[11] = np.log1p(lengths.mean())
        out[12] = np.log1p(lengths.std())
        out[13] = len(different) / n
        out[14] = np.log1p(n / len(different))
        out[15] = (lengths <= 2).mean()
        out[16] = (lengths >= 12).mean()
        out[17] = sum(map(bytes.isupper, words)) / n
        out[18] = sum(map(bytes.istitle, words)) / n
        out[19] = sum(map(bytes.isalpha, words)) / n
        out[20] = len(set(zip(words, words[1:]))) / max(1, n - 1)
        sentences = counts[33] + counts[46] + counts[63]
        out[21] = np.log1p(n / (1 + sentences))
    lines = raw.split(b"\n")
    out[22] = len(set(lines)) / len(lines)
    out[23] = np.log1p(size / len(lines))
    return out


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in row_slices(batches, "text"):
        table = np.array([statistics(t) for t in part.column("text").to_pylist()])
        offsets = pa.array(np.arange(0, table.size + 1, STATISTICS, dtype=np.int32))
        values = pa.ListArray.from_arrays(offsets, pa.array(table.reshape(-1)))
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), values], ["doc_id", "text_key", "stats"])


def _matrix(batch: pa.RecordBatch, column: str = "stats") -> np.ndarray:
    values = batch.column(column).flatten().to_numpy(zero_copy_only=False)
    return values.reshape(-1, STATISTICS)


class Fourier:
    """The random map, the same for everyone with the seed; scaled by the training rows."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.weights = rng.normal(size=(STATISTICS, FEATURES)) / WIDTH
        self.phases = rng.uniform(0, 2 * np.pi, FEATURES)
        self.mean, self.deviation = mean, np.where(deviation > 1e-9, deviation, 1)

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        scaled = np.clip((stats - self.mean) / self.deviation, -8, 8)
        waves = np.cos(scaled @ self.weights + self.phases) * np.sqrt(2 / FEATURES)
        return np.hstack([waves, np.ones((len(stats), 1))])


_WIDE = FEATURES + 1


def _normal_equations(features: Fourier):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((_WIDE, _WIDE + 1))
        for batch in batches:
            z = features(_matrix(batch))
            y = batch.column("quality").to_numpy(zero_copy_only=False).astype(np.float64)
            total += z.T @ np.hstack([z, y[:, None]])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((_WIDE, _WIDE + 1))
    for batch in batches:
        for value in batch.column("sums"):
            total += np.frombuffer(value.as_buffer()).reshape(total.shape)
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])


def _bin(raw: np.ndarray) -> np.ndarray:
    return np.clip(np.floor((raw + 0.5) * (SCORE_BINS / 2)), 0, SCORE_BINS - 1).astype(np.int64)


def _binned(features: Fourier, weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _bin(features(_matrix(batch)) @ weights)
            yield pa.RecordBatch.from_arrays([batch.column("quality"), pa.array(at)], ["quality", "bin"])

    return run


def _scores(features: Fourier, weights: np.ndarray, steps: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = steps[_bin(features(_matrix(batch)) @ weights)]
            kept = ["doc_id", "text_key", "held_out"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(score)], [*kept, "score"])

    return run


def isotonic(ones: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Non-decreasing shares nearest to ones / counts (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for one, count in zip(ones, counts):
        blocks.append([one, count, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.concatenate([np.full(int(n), one / count) for one, count, n in blocks])


def held_out_row():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted, text_key)`` for each row of ``(doc_id, text, …)``.

    ``labels`` has ``(doc_id, quality)``; rows of the fold crc32(doc_id) mod 3 = 1 are held
    out and never read for a fit, and all others are used, none sampled. Scores come from
    the text alone. Null text is empty and gets a score like any other; null labels and
    null doc_ids train nothing; a doc_id labelled twice, or repeated, counts as often.
    Without training rows of both classes every score is the share of ones (0.5 if none).
    Only sums over rows reach the driver: means, one matrix, SCORE_BINS counts.
    """
    texts = in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    measured = materialize(texts.mapInArrow(_measure, "doc_id long, text_key long, stats array<double>"), "statistics")
    result = measured.withColumn("held_out", held_out_row())
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.where("quality in (0, 1)")
    train = result.where("not held_out").join(known, "doc_id").select("doc_id", "stats", "quality")
    train = materialize(train, "training")

    sums = [f(F.col("stats")[k]) for k in range(STATISTICS) for f in (F.avg, F.stddev_pop)]
    count, ones, *moments = train.agg(F.count("*"), F.sum("quality"), *sums).first()
    if not count or ones in (0, count):
        score = F.lit(float(ones) / count if count else 0.5)
        return result.withColumn("score", score).select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "text_key")
    moments = np.array(moments)
    features = Fourier(moments[0::2], moments[1::2])

    fold = F.pmod(F.xxhash64("doc_id"), F.lit(CALIBRATION_FOLDS))
    parts = train.where(fold > 0).mapInArrow(_normal_equations(features), "sums binary")
    matrices = parts.repartition(REDUCERS).mapInArrow(_add_up, "sums binary").coalesce(1).mapInArrow(_add_up, "sums binary")
    matrix = np.frombuffer(bytes(matrices.first().sums)).reshape(_WIDE, _WIDE + 1)
    penalty = RIDGE * max(1.0, matrix[-1, _WIDE - 1]) * np.eye(_WIDE)
    penalty[-1, -1] = 1e-9
    weights = np.linalg.solve(matrix[:, :_WIDE] + penalty, matrix[:, _WIDE])

    seen = train.where(fold == 0).mapInArrow(_binned(features, weights), "quality int, bin long")
    bins = sorted(seen.groupBy("bin").agg(F.sum("quality").alias("ones"), F.count("*").alias("n")).collect())
    steps = np.clip((np.arange(SCORE_BINS) + 0.5) * (2 / SCORE_BINS) - 0.5, 0, 1)
    if bins:
        at, ones, n = np.array(bins, float).T
        steps = np.interp(np.arange(SCORE_BINS), at, isotonic(ones, n))
    scored = result.mapInArrow(_scores(features, weights, steps), "doc_id long, text_key long, held_out boolean, score double")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "text_key")


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All columns of the rows that the classifier does not reject."""
    poor = score_quality(docs, labels).where("predicted = 0").select(F.col("doc_id").alias("poor_id"), F.col("text_key").alias("poor_key"))
    poor = sent_when_small(materialize(poor.distinct(), "poor"))
    same = docs.doc_id.cast("long").eqNullSafe(poor.poor_id) & (F.xxhash64(docs.text) == poor.poor_key)
    return docs.join(poor, same, "left_anti")
