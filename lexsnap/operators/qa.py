"""Question/answer lists: parsing, generating, exploding, regenerating."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexsnap.functions.markup import html_to_text
from lexsnap.functions.text import normalize_whitespace
from lexsnap.operators.numbering import running_sum
from lexsnap.schemas import KEY, QA_ITEM
from lexsnap.session import in_small_batches, materialize

# Fixed value: the question of a row whose generation failed.
FAILED_QUESTION = "Failed to generate."

# Characters of questions and answers that a caller gathers before it passes them on.
RESULT_CHARS = 4 << 20

_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
_RESPONSE = "array<struct<qa_list: array<struct<question: variant, answer: variant>>>>"


def _is_text(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value) == "STRING", F.lit(False))


def parse_responses(responses: DataFrame, body: str = "body") -> DataFrame:
    """Replace ``body``, a JSON response, by ``qa_list`` and ``problem``.

    A valid response is ``{"qa_list": [{question, answer}, ...]}``. Else ``qa_list``
    is null and ``problem`` one of ``invalid_json``, ``missing_list`` and
    ``invalid_item`` (no object, or a question or answer that is missing or no
    text). A null body has neither.
    """
    # A parser stops at the end of the first value and overlooks text after it.
    # Only a single JSON value fits both into an array and into an object.
    in_array = F.concat(F.lit("["), body, F.lit("]"))
    in_object = F.concat(F.lit('{"v":'), body, F.lit("}"))
    fits_object = F.size(F.json_object_keys(in_object)) == 1
    items = F.get("_parsed", F.lit(0)).qa_list
    valid = (
        (F.size("_parsed") == 1)
        & F.forall(items, lambda item: _is_text(item.question) & _is_text(item.answer))
        & fits_object
    )
    # Only a response that is not valid is looked at again, for its problem.
    reread = ~F.col("_valid") & (F.json_array_length(in_array) == 1) & fits_object
    problem = (
        F.when(F.col(body).isNull() | F.col("_valid"), None)
        .when(F.col("_value").isNull(), "invalid_json")
        .when(
            F.try_variant_get("_value", "$.qa_list", "array<variant>").isNull(),
            "missing_list",
        )
        .otherwise("invalid_item")
    )
    texts = F.transform(
        items,
        lambda item: F.struct(
            item.question.cast("string").alias("question"),
            item.answer.cast("string").alias("answer"),
        ),
    )
    return (
        responses.withColumn("_parsed", F.from_json(in_array, _RESPONSE, _STRICT))
        .withColumn("_valid", F.coalesce(valid, F.lit(False)))
        .withColumn("_value", F.when(reread, F.try_parse_json(body)))
        .withColumn("problem", problem)
        .withColumn("qa_list", F.when(F.col("_valid"), texts))
        .drop("_parsed", "_valid", "_value", body)
    )


def quarantine(parsed: DataFrame) -> DataFrame:
    """The responses that failed validation."""
    return parsed.filter(F.col("problem").isNotNull())


def plain_text(regulations: DataFrame) -> DataFrame:
    """``(permalink, body_final)`` with the body as normalised plain text."""
    return regulations.select(
        KEY, normalize_whitespace(html_to_text(F.col("body_final"))).alias("body_final")
    )


def _place_in_list() -> Column:
    """1 for the first item and for a missing one; null keys are not counted."""
    place = F.coalesce("pos", F.lit(0)) + 1
    return F.when(F.col(KEY).isNull(), F.lit(0)).otherwise(place)


def explode_qa(documents: DataFrame) -> DataFrame:
    """``(permalink, qa_list)`` to ``(id, permalink, question, answer)``.

    Needs one list per permalink; the id is then the place in the list, with no
    shuffle. An empty or null list keeps one row of nulls with id 1, as long as
    the permalink is not null.
    """
    exploded = documents.select(KEY, F.posexplode_outer("qa_list").alias("pos", "item"))
    return exploded.select(
        _place_in_list().cast("long").alias("id"), KEY, "item.question", "item.answer"
    )


def explode_qa_parts(
    documents: DataFrame, part: str = "part", parts_per_slice: int = 1 << 20
) -> DataFrame:
    """As ``explode_qa`` for documents whose list comes in numbered parts.

    Ids run on from part to part. Only the list lengths are summed up, apart from
    the lists, so give a stored table and not one that has to be built each time.
    """
    length = F.greatest(F.size("qa_list"), F.lit(1))
    lengths = documents.select(KEY, part, length.alias("_length"))
    offsets = (
        running_sum(
            lengths, KEY, part, F.col("_length"), "_through", rows_per_slice=parts_per_slice
        )
        .filter("_through > _length")
        .select(
            F.col(KEY).alias("_key"),
            F.col(part).alias("_part"),
            (F.col("_through") - F.col("_length")).alias("_offset"),
        )
    )
    same_part = (F.col(KEY) == F.col("_key")) & (F.col(part) == F.col("_part"))
    exploded = documents.join(offsets, same_part, "left").select(
        KEY, "_offset", F.posexplode_outer("qa_list").alias("pos", "item")
    )
    return exploded.select(
        (_place_in_list() + F.coalesce("_offset", F.lit(0))).cast("long").alias("id"),
        KEY,
        "item.question",
        "item.answer",
    )


def valid_response(text: str) -> list[tuple[str, str]]:
    """The pairs of one response; raises ``ValueError`` when it is not valid."""
    parsed = json.loads(text)
    items = parsed.get("qa_list") if isinstance(parsed, dict) else None
    if not isinstance(items, list):
        raise ValueError("no qa_list")
    pairs = []
    for item in items:
        pair = (item.get("question"), item.get("answer")) if isinstance(item, dict) else ()
        if len(pair) != 2 or not all(isinstance(value, str) for value in pair):
            raise ValueError("a pair needs a question and an answer")
        pairs.append(pair)
    return pairs


def generate_qa(
    documents: DataFrame,
    generator: Callable[[str], str],
    max_attempts: int = 3,
    wait_seconds: float = 0.1,
    parallelism: int | None = None,
) -> DataFrame:
    """Call ``generator`` on each body: adds ``qa_list``, ``attempts``, ``error``.

    ``generator`` turns a text into a JSON response. A call that raises or
    returns an invalid response is retried up to ``max_attempts`` times, then the
    row keeps the error and a null list. Null bodies are not sent. The calls are
    costly and may differ between runs: write the result before using it twice
    (``lexsnap.session.materialize``). ``parallelism`` sets the number of
    concurrent callers. Bodies and results pass a caller some megabytes at a time,
    however many rows its partition has.
    """
    schema = T.StructType(
        [
            T.StructField(KEY, T.StringType()),
            T.StructField("qa_list", T.ArrayType(QA_ITEM)),
            T.StructField("attempts", T.LongType()),
            T.StructField("error", T.StringType()),
        ]
    )

    def attempt(body: str | None) -> tuple:
        if body is None:
            return None, 0, None
        error = None
        for n in range(1, max_attempts + 1):
            try:
                pairs = valid_response(generator(body))
                return [{"question": q, "answer": a} for q, a in pairs], n, None
            except Exception as problem:
                error = f"{type(problem).__name__}: {problem}"
                if n < max_attempts:
                    time.sleep(wait_seconds)
        return None, max_attempts, error

    def frame(rows: list[tuple]) -> pd.DataFrame:
        columns = zip(*rows)
        return pd.DataFrame(
            {f.name: pd.Series(column, dtype=object) for f, column in zip(schema, columns)}
        )

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, held = [], 0
            for key, body in zip(batch[KEY], batch["body_final"]):
                pairs, attempts, error = attempt(body)
                rows.append((key, pairs, attempts, error))
                held += sum(len(p["question"]) + len(p["answer"]) for p in pairs or ())
                if held >= RESULT_CHARS:
                    yield frame(rows)
                    rows, held = [], 0
            if rows:
                yield frame(rows)

    documents = documents.select(KEY, "body_final")
    if parallelism:
        documents = documents.repartition(parallelism, KEY)
    return in_small_batches(documents).mapInPandas(call, schema)


def mark_failed(generated: DataFrame) -> DataFrame:
    """Rows whose generation failed get one pair that says so."""
    failed = F.array(
        F.struct(
            F.lit(FAILED_QUESTION).alias("question"),
            F.lit(None).cast("string").alias("answer"),
        )
    )
    return generated.select(
        KEY,
        F.when(F.col("error").isNotNull(), failed)
        .otherwise(F.col("qa_list"))
        .alias("qa_list"),
    )


def failed_items(qa: DataFrame, sentinel: str = FAILED_QUESTION) -> DataFrame:
    return qa.filter(F.col("question") == sentinel)


def kept_items(qa: DataFrame, sentinel: str = FAILED_QUESTION) -> DataFrame:
    """All but the failed rows; a null question is not kept either."""
    return qa.filter(F.col("question") != sentinel)


def with_outcome(generated: DataFrame) -> DataFrame:
    """``(permalink, qa_list, attempts, error)``; a generator that reports nothing has not failed."""
    defaults = {"attempts": F.lit(1).cast("long"), "error": F.lit(None).cast("string")}
    missing = {c: v for c, v in defaults.items() if c not in generated.columns}
    return generated.withColumns(missing).select(KEY, "qa_list", "attempts", "error")


def after_kept(items: DataFrame, kept: DataFrame) -> DataFrame:
    """New items of documents, numbered on from the last id that is kept of each."""
    last = kept.groupBy(KEY).agg(F.max("id").alias("last"))
    return items.join(last, KEY, "left").select(
        (F.col("id") + F.coalesce("last", F.lit(0))).alias("id"), KEY, "question", "answer"
    )


def regenerate_failed(
    qa: DataFrame,
    regulations: DataFrame,
    generate: Callable[[DataFrame], DataFrame],
    sentinel: str = FAILED_QUESTION,
    restart_ids: bool = False,
) -> DataFrame:
    """Generate failed documents again and put the new rows in place.

    ``generate`` maps ``(permalink, body_final)`` to ``(permalink, qa_list)`` and
    runs once per document, however many of its rows failed; new ids continue
    after the kept ones. With ``restart_ids`` a document appears once per failed
    row and ids start at 1, which can repeat ids. Without any failed row the
    table is returned as it is.
    """
    failed = failed_items(qa, sentinel)
    if failed.isEmpty():
        return qa
    kept = kept_items(qa, sentinel)
    documents = failed.groupBy(KEY).agg(F.count("*").alias("copies"))
    sources = plain_text(regulations.join(documents.select(KEY), KEY, "left_semi"))
    fresh = materialize_lists(generate(sources))
    if restart_ids:
        repeated = fresh.join(documents, KEY).select(
            KEY, "qa_list", F.explode(F.expr("sequence(0L, copies - 1)")).alias("copy")
        )
        size = F.greatest(F.size("qa_list"), F.lit(1))
        pairs = repeated.select(
            KEY,
            (F.col("copy") * F.coalesce(size, F.lit(1))).alias("offset"),
            F.posexplode_outer("qa_list").alias("pos", "item"),
        )
        position = F.coalesce("pos", F.lit(0)) + 1
        renewed = pairs.select(
            (F.col("offset") + position).cast("long").alias("id"),
            KEY,
            "item.question",
            "item.answer",
        )
    else:
        renewed = after_kept(explode_qa(fresh), kept)
    return kept.select("id", KEY, "question", "answer").unionByName(renewed)


def materialize_lists(generated: DataFrame) -> DataFrame:
    """Keep generated lists, so that no later step calls the generator again."""
    return materialize(generated.select(KEY, "qa_list"), "qa-lists")
