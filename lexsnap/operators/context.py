"""Topic labels, context prompts and citation cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexsnap.functions.render import card_body, card_heading, context_line, prompt_text
from lexsnap.session import materialize


def _codes(topik: Column) -> Column:
    return F.transform(F.split(topik, " "), lambda code: code.try_cast("int"))


def topic_labels(
    df: DataFrame,
    topics: DataFrame,
    column: str = "topik",
    out: str = "topik_labels",
    strict: bool = False,
) -> DataFrame:
    """Space-separated codes to their labels, in order, joined by ``", "``.

    An unknown or empty code is skipped, or an error if ``strict``. Of several labels
    of one code the smallest counts. Each distinct code list is resolved once and
    joined back; Spark broadcasts the lists while they are small.
    """
    topics = topics.filter(F.col("uuid").isNotNull())
    topics = topics.groupBy("uuid").agg(F.min("keterangan").alias("keterangan"))
    return _joined_labels(df, topics, column, out, strict)


def _checked(label: Column, known: Column, code: Column, strict: bool) -> Column:
    if not strict:
        return label
    problem = F.raise_error(
        F.concat(F.lit("unknown topic code: "), F.coalesce(code.cast("string"), F.lit("")))
    )
    return F.when(known, label).otherwise(problem)


def _joined_labels(df, topics, column, out, strict) -> DataFrame:
    lists = df.select(column).filter(F.col(column).isNotNull()).distinct()
    coded = lists.select(column, F.posexplode(_codes(F.col(column))).alias("_pos", "_code"))
    named = topics.select(F.col("uuid").alias("_code"), "keterangan", F.lit(1).alias("_known"))
    label = _checked(
        F.col("keterangan"), F.col("_known").isNotNull(), F.col("_code"), strict
    )
    resolved = (
        coded.join(named, "_code", "left")
        .select(column, F.struct("_pos", label.alias("label")).alias("_item"))
        .groupBy(column)
        .agg(F.sort_array(F.collect_list("_item")).alias("_items"))
        .select(
            F.col(column).alias("_list"),
            F.array_join(F.col("_items.label"), ", ").alias(out),
        )
    )
    return df.join(resolved, F.col(column) == F.col("_list"), "left").drop("_list")


def retrieved(hits: DataFrame, vectors: DataFrame) -> DataFrame:
    """Hits with their records: ``(query_id, rank, document, metadata)``.

    The hits, k rows per query, are written first: the search runs once, and the
    planner sees their true size when it joins them with the records.
    """
    found = materialize(hits.select("query_id", "rank", "id"), "hits")
    records = vectors.select("id", "document", "metadata")
    return records.join(found, "id").select(
        "query_id", "rank", "document", "metadata"
    )


def rag_prompts(queries: DataFrame, results: DataFrame) -> DataFrame:
    """One prompt per query: its context lines by rank, then the question.

    A query without results gets an empty context.
    """
    line = context_line(
        F.col("document"),
        F.col("metadata.answer"),
        F.col("metadata.jenis_peraturan"),
        F.col("metadata.nomor_peraturan"),
    )
    lines = (
        results.select("query_id", F.struct("rank", line.alias("line")).alias("item"))
        .groupBy("query_id")
        .agg(F.sort_array(F.collect_list("item")).alias("items"))
    )
    context = F.coalesce(F.array_join("items.line", "\n"), F.lit(""))
    return (
        queries.select("query_id", "prompt")
        .join(lines, "query_id", "left")
        .select("query_id", prompt_text(context, F.col("prompt")).alias("prompt"))
    )


def citation_cards(results: DataFrame, topics: DataFrame, strict: bool = False) -> DataFrame:
    """One card per retrieved record, with its topic labels."""
    flat = results.select(
        "query_id",
        "rank",
        "metadata.jenis_peraturan",
        "metadata.nomor_peraturan",
        "metadata.permalink",
        "metadata.topik",
        F.col("document").alias("question"),
        "metadata.answer",
    )
    return topic_labels(flat, topics, strict=strict).select(
        "query_id",
        "rank",
        "jenis_peraturan",
        "nomor_peraturan",
        "permalink",
        "topik_labels",
        "question",
        "answer",
        card_heading(
            F.col("jenis_peraturan"),
            F.col("nomor_peraturan"),
            F.col("permalink"),
            F.col("topik_labels"),
        ).alias("heading"),
        card_body(F.col("question"), F.col("answer")).alias("body"),
    )
