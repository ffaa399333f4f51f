"""The logical input tables, derived from the given Parquet tables."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexsnap.functions.dates import parse_listing_date
from lexsnap.operators.listing import ingest_listing
from lexsnap.operators.qa import (
    FAILED_QUESTION,
    explode_qa_parts,
    parse_responses,
)
from lexsnap.operators.regulations import clean_regulations, looked_up, with_detail
from lexsnap.operators.vectors import vector_documents
from lexsnap.schemas import KEY, LISTING
from lexsnap.session import materialize, scratch_path, sent, stored_bytes

# Turns per response. Long conversations give several responses of bounded size.
TURNS_PER_PART = 64
# Of the sync whose directories are looked at; many, so that some stay.
SYNC_BUCKETS = 64
# With two turns per response a document has several, and some of them fail.
SHORT_PART = 2
# Of a table's files, compressed, that is sent to all executors at most.
SENT_BYTES = 16 << 20


# Given schemas save a look into the files each time a query is built.
TABLES = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "labels": "doc_id long, quality int, toxic int",
    "pages": "page_id long, url string, html string",
    "conversations": "conv_id long, turn long, role string, text string",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "events": (
        "event_id long, ts timestamp_ntz, user_id long, event_type string, "
        "value double, props string"
    ),
    "benchmark": "item_id long, text string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def base_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested listing rows with ``doc_id``; narrow before the join with labels."""
    rows = table(spark, sf_dir, "documents").selectExpr(
        "doc_id",
        "'doc-' || doc_id AS permalink",
        "text AS perihal",
        """date_format(date_add(DATE'2024-01-01', CAST(doc_id % 365 AS INT)),
             'dd-MM-yyyy') AS tanggal_efektif""",
        """transform(array(doc_id % 4, doc_id % 7 + 1), code -> named_struct(
             'uuid', CAST(code AS INT), 'keterangan', 'Topik ' || code)) AS topik""",
    )
    # Two numbers a row: while they are few, the texts are not shuffled to meet them.
    quality = table(spark, sf_dir, "labels").select("doc_id", "quality")
    quality = sent(quality, stored_bytes(quality) <= SENT_BYTES)
    return rows.join(quality, "doc_id", "left").selectExpr(
        "doc_id",
        "permalink",
        "perihal",
        "tanggal_efektif",
        """CASE quality WHEN 1 THEN 'Berlaku' WHEN 0 THEN 'Dicabut'
             ELSE 'Tidak diketahui' END AS status_dokumen""",
        "topik",
    )


def listing_old(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base_listing(spark, sf_dir).filter(F.col("doc_id") % 10 != 0)
    return rows.select(*LISTING.names)


def listing_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base_listing(spark, sf_dir).filter(F.col("doc_id") % 11 != 0)
    status = F.when(F.col("doc_id") % 13 == 0, "Diubah").otherwise(F.col("status_dokumen"))
    # A change at the very end of a title must be seen.
    title = F.when(F.col("doc_id") % 17 == 0, F.concat("perihal", F.lit(" (perubahan)"))).otherwise(F.col("perihal"))
    return rows.withColumns({"status_dokumen": status, "perihal": title}).select(*LISTING.names)


def old_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat listing of the old snapshot."""
    return ingest_listing(listing_old(spark, sf_dir))


def new_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat listing of the new snapshot."""
    return ingest_listing(listing_new(spark, sf_dir))


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return old_snapshot(spark, sf_dir), new_snapshot(spark, sf_dir)


def detail_responses(
    spark: SparkSession,
    sf_dir: str,
    with_body: bool = True,
    wanted: DataFrame | None = None,
) -> DataFrame:
    """One detail response per document; every 29th has no record.

    Without bodies the pages are not read at all. With ``wanted``, a table with their
    permalinks, only those documents are looked up, before the bodies are attached.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    if wanted is not None:
        docs = looked_up(docs.withColumn(KEY, F.expr("'doc-' || doc_id")), wanted).drop(KEY)
    if with_body:
        pages = table(spark, sf_dir, "pages").select("page_id", "html")
        page_count = table(spark, sf_dir, "pages").select(F.count("*")).scalar()
        docs = docs.withColumn("page_id", F.col("doc_id") % page_count).join(
            pages, "page_id"
        )
    body = "html" if with_body else "CAST(NULL AS STRING)"
    record = f"""filter(array(named_struct(
        'jenis_peraturan', upper(lang),
        'nomor_peraturan', source || '/' || doc_id,
        'body_final', {body},
        'peraturan_terbaru', transform(
          filter(array(doc_id + 1), id -> doc_id % 3 = 0),
          id -> named_struct('permalink', 'doc-' || id)),
        'peraturan_sebelumnya', transform(
          filter(array(doc_id - 1, doc_id - 2), id -> doc_id % 5 = 0),
          id -> named_struct('permalink', 'doc-' || id)),
        'peraturan_relevan', if(doc_id % 7 = 0, NULL,
          array(named_struct('permalink', 'doc-' || (doc_id * 2)))),
        'meta', named_struct('keywords', lang || ' ' || source)
      )), record -> doc_id % 29 <> 0) AS data"""
    return docs.selectExpr("'doc-' || doc_id AS permalink", record)


def regulations(
    spark: SparkSession, sf_dir: str, listing: DataFrame, with_body: bool = True
) -> DataFrame:
    details = detail_responses(spark, sf_dir, with_body, wanted=listing)
    return clean_regulations(with_detail(listing, details))


def all_regulations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regulation table of every document, whatever its topics."""
    listing = base_listing(spark, sf_dir).select(
        "permalink",
        "perihal",
        parse_listing_date(F.col("tanggal_efektif")).alias("tanggal_efektif"),
        "status_dokumen",
        F.lit("2 3").alias("topik"),
    )
    return regulations(spark, sf_dir, listing)


def land_pages(
    spark: SparkSession, listing: DataFrame, total_page: Column, page: Column
) -> str:
    """Write a listing as page envelopes, one per line; returns the folder."""
    path = scratch_path(spark, "pages")
    row = F.struct(*LISTING.names)
    (
        listing.groupBy(page.alias("page"))
        .agg(F.collect_list(row).alias("search_data"))
        .select(
            "page",
            F.struct("search_data").alias("data"),
            F.struct(total_page.alias("total_page")).alias("pagination"),
        )
        .write.option("compression", "gzip")
        .json(path)
    )
    return path


def qa_responses(
    spark: SparkSession,
    sf_dir: str,
    turns_per_part: int = TURNS_PER_PART,
    prose_for_system: bool = False,
) -> DataFrame:
    """``(permalink, part, body)``: question/answer pairs of a conversation as JSON.

    A user turn directly followed by an assistant turn is a pair. Both are put
    under the user's turn number, and a group holds a bounded range of turns.
    With ``prose_for_system`` a response with a system turn is that turn's text,
    as if the generator had answered in prose and not in JSON.
    """
    placed = table(spark, sf_dir, "conversations").selectExpr(
        "'doc-' || conv_id AS permalink",
        "if(role = 'assistant', greatest(turn - 1, 0), turn) AS place",
        "role",
        "text",
    )
    body = """to_json(named_struct('qa_list', transform(
        filter(sequence(0, size(items) - 1), i ->
          i > 0 and items[i].role = 'user' and items[i - 1].role = 'assistant'
          and items[i].place = items[i - 1].place),
        i -> named_struct('question', items[i].text, 'answer', items[i - 1].text))))"""
    if prose_for_system:
        system = "filter(items, item -> item.role = 'system')"
        body = f"coalesce(get({system}, 0).text, {body})"
    return (
        placed.groupBy("permalink", F.expr(f"place div {turns_per_part}").alias("part"))
        .agg(F.sort_array(F.collect_list(F.struct("place", "role", "text"))).alias("items"))
        .selectExpr("permalink", "part", f"{body} AS body")
    )


def qa_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Generated lists are a stored table: their lengths and their items are read
    # apart, and building them again for each would shuffle the texts each time.
    lists = parse_responses(qa_responses(spark, sf_dir))
    return explode_qa_parts(materialize(lists, "qa-lists"))


def qa_with_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A QA table in which invalid responses left failed rows."""
    parsed = parse_responses(qa_responses(spark, sf_dir, SHORT_PART, True))
    failed = F.array(
        F.struct(
            F.lit(FAILED_QUESTION).alias("question"),
            F.lit(None).cast("string").alias("answer"),
        )
    )
    marked = F.when(F.col("problem").isNotNull(), failed).otherwise(F.col("qa_list"))
    return explode_qa_parts(materialize(parsed.withColumn("qa_list", marked), "qa-lists"))


def halves(text: str) -> str:
    """Stand-in for a text generator: asks for one half, answers with the other.

    Texts of a length divisible by five fail, so that failures occur too.
    """
    return _halves_unless(text, 5)


def halves_later(text: str) -> str:
    """The same stand-in at a later time: most of the texts that failed succeed."""
    return _halves_unless(text, 35)


def _halves_unless(text: str, divisor: int) -> str:
    if len(text) % divisor == 0:
        raise ValueError("no response")
    middle = len(text) // 2
    first, second = text[:middle], text[middle:]
    pairs = [{"question": first, "answer": second}, {"question": second, "answer": first}]
    return json.dumps({"qa_list": pairs})


def embed(spark: SparkSession, sf_dir: str, documents: DataFrame) -> DataFrame:
    """Give vector records an embedding, chosen by the numbers in their id."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    count = table(spark, sf_dir, "embeddings").select(F.count("*")).scalar()
    numbers = F.regexp_extract_all("id", F.lit(r"(\d+)"), F.lit(1))
    document = F.element_at(numbers, 1).cast("long")
    item = F.element_at(numbers, -1).cast("long")
    return (
        documents.withColumn("vec_id", (document * 7 + item) % count)
        .join(vectors, "vec_id")
        .drop("vec_id")
    )


def vector_table(
    spark: SparkSession, sf_dir: str, listing: DataFrame, qa: DataFrame | None = None
) -> DataFrame:
    """Vector records, without embeddings, of a listing's documents.

    Give ``qa``, a stored question table, where several tables are made of it.
    """
    about = regulations(spark, sf_dir, listing, with_body=False)
    return vector_documents(qa_table(spark, sf_dir) if qa is None else qa, about)


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question per benchmark item, with the embedding of the same number."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return (
        table(spark, sf_dir, "benchmark")
        .join(vectors, F.col("item_id") == F.col("vec_id"))
        .select(F.col("item_id").alias("query_id"), F.col("text").alias("prompt"), "embedding")
    )
