"""The registered queries: every operator over the whole given tables."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexsnap.functions import dates, markup, nested, text
from lexsnap.operators import changes as C
from lexsnap.operators import context, listing, nearest, numbering, qa, regulations
from lexsnap.operators import vectors as V
from lexsnap.plans import adapters as A
from lexsnap.plans.snapshot_jobs import (
    audit_tables,
    flattened_vectors,
    read_tables,
    retry_failures as retry_job,
    sync_snapshot,
    write_audit,
)
from lexsnap.schemas import (
    KEY,
    LISTING_COLUMNS,
    REGULATION,
    REGULATION_COLUMNS,
    RELATION_COLUMNS,
    VECTOR_DOCUMENT,
)
from lexsnap.session import materialize, scratch_path
from lexsnap.sources import stages
from lexsnap.sources import tables as S
from lexsnap.sources.listing import listing_rows, missing_pages, read_listing_pages
from lexsnap.sources.versions import Rewrite, bucket_of, publish, read_keys
from lexsnap.streaming import snapshot_sync

Query = Callable[[SparkSession, str], DataFrame]

PAGE_ROWS = 50
SMALL_PAGE_ROWS = 4
NEIGHBOURS = 5
CONTEXT_ROWS = 3
BATCH_ROWS = 100
STORE_FILE_ROWS = 120
CHUNK_SIZE, CHUNK_OVERLAP = 1000, 200
VECTOR_DIM = 64

_QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    _QUERIES[function.__name__] = function
    return function


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _last_page(spark: SparkSession, d: str, rows: int):
    """Number of the last page of all documents."""
    documents = A.table(spark, d, "documents")
    last = documents.select((F.floor(F.max("doc_id") / rows) + 1).alias("n"))
    return last.scalar()


# ---- sources and sinks ------------------------------------------------------


@query
def listing_pages_inline(spark, d):
    rows = A.base_listing(spark, d)
    page = F.floor(F.col("doc_id") / PAGE_ROWS) + 1
    path = A.land_pages(spark, rows, _last_page(spark, d, PAGE_ROWS), page)
    return listing_rows(read_listing_pages(spark, path)).select(
        "permalink",
        "perihal",
        "tanggal_efektif",
        "status_dokumen",
        nested.flatten_codes(F.col("topik")).alias("topik"),
        F.size("topik").cast("long").alias("topics"),
    )


@query
def listing_missing_pages(spark, d):
    labelled = A.table(spark, d, "labels").select("doc_id")
    rows = A.base_listing(spark, d).join(labelled, "doc_id", "left_semi")
    page = F.floor(F.col("doc_id") / SMALL_PAGE_ROWS) + 1
    path = A.land_pages(spark, rows, _last_page(spark, d, SMALL_PAGE_ROWS), page)
    return missing_pages(read_listing_pages(spark, path))


@query
def detail_enrich_join(spark, d):
    rows = A.old_snapshot(spark, d)
    enriched = regulations.with_detail(rows, A.detail_responses(spark, d, wanted=rows))
    return enriched.select(
        KEY,
        "status_dokumen",
        "detail.jenis_peraturan",
        "detail.nomor_peraturan",
        F.col("detail.meta.keywords").alias("keywords"),
        F.length("detail.body_final").cast("long").alias("body_length"),
        F.col("detail").isNotNull().alias("found"),
    )


@query
def json_rows_to_table(spark, d):
    events = A.table(spark, d, "events").select("event_id", "props")
    return S.json_rows(events, "props", "k long")


@query
def json_roundtrip(spark, d):
    documents = A.table(spark, d, "documents")
    path = scratch_path(spark, "documents-json")
    S.write_json(documents, path)
    return S.read_json(spark, path, documents.schema)


@query
def csv_roundtrip(spark, d):
    documents = A.table(spark, d, "documents")
    path = scratch_path(spark, "documents-csv")
    S.write_csv(documents, path)
    return S.read_csv(spark, path, documents.schema)


@query
def csv_split_read(spark, d):
    """Records with line ends in them, read by as many tasks as the files have splits."""
    documents = A.table(spark, d, "documents")
    path = scratch_path(spark, "documents-csv")
    S.write_csv(documents, path)
    return S.read_csv(spark, path, documents.schema, splittable=True)


@query
def json_array_split_read(spark, d):
    """Arrays of rows, read by as many tasks as the files have splits."""
    documents = A.table(spark, d, "documents")
    path = scratch_path(spark, "documents-array")
    S.write_json(documents, path, array_of_rows=True)
    return S.read_json(spark, path, documents.schema, array_of_rows=True, splittable=True)


@query
def load_table_dispatch(spark, d):
    labels = A.table(spark, d, "labels")
    base = scratch_path(spark, "labels")
    S.write_csv(labels, f"{base}.csv")
    S.write_json(labels, f"{base}.json")
    loaded = [
        S.load_table(spark, base + suffix, labels.schema).withColumn(
            "suffix", F.lit(suffix)
        )
        for suffix in (".csv", ".json")
    ]
    return loaded[0].unionByName(loaded[1])


@query
def promote_snapshot(spark, d):
    clean = scratch_path(spark, "regulation-clean")
    old = A.old_snapshot(spark, d)
    A.regulations(spark, d, old).write.parquet(clean)
    return S.promote(spark, clean, scratch_path(spark, "regulation"))


@query
def stage_once(spark, d):
    """The second run of the stage finds its output and changes nothing."""
    labels = A.table(spark, d, "labels")
    path = scratch_path(spark, "stage")
    stages.stage_once(labels, path)
    return stages.stage_once(labels.withColumn("quality", F.lit(-1)), path)


@query
def stage_outdated(spark, d):
    """A stage over a folder of labels, run again after more of them have landed."""
    labels = A.table(spark, d, "labels")
    base = scratch_path(spark, "landed")
    landed = labels.limit(0)
    for part in ("quality = 1", "quality = 0"):
        labels.filter(part).write.mode("append").parquet(base)
        landed = spark.read.schema(labels.schema).parquet(base)
        out = stages.stage_once(landed.groupBy("toxic").agg(F.count("*").alias("n")), f"{base}-counts")
    return out


@query
def vector_batches(spark, d):
    """First load of the vectors: what each file of whole records holds."""
    path = scratch_path(spark, "vector-batches")
    records = _vectors(spark, d)
    stages.write_batches(records, path, BATCH_ROWS, [F.asc("id")])
    stored = spark.read.schema(records.schema).parquet(path)
    files = stored.groupBy(F.col("_metadata.file_path").alias("file")).agg(
        F.count_if(F.size("embedding") == VECTOR_DIM).alias("records"),
        F.min("id").alias("first_id"),
        F.max("id").alias("last_id"),
    )
    return numbering.batch_number(files.drop("file"), [F.asc("first_id")], 1)


@query
def changeset_audit(spark, d):
    old, new = A.snapshots(spark, d)
    stored = A.regulations(spark, d, old)
    changes = materialize(C.snapshot_diff(old, new), "changes")
    path = scratch_path(spark, "audit")
    change_sets = audit_tables(
        C.inserted(changes), C.updated(changes, stored), C.deleted(changes)
    )
    kept = spark.createDataFrame([], REGULATION).select(
        F.lit("").alias("change_set"), *REGULATION_COLUMNS
    )
    for name in write_audit(change_sets, path):
        rows = S.load_table(spark, f"{path}/{name}.json", REGULATION)
        kept = kept.unionByName(rows.select(F.lit(name).alias("change_set"), *REGULATION_COLUMNS))
    return kept


# ---- listing and regulations ------------------------------------------------


@query
def listing_dedup(spark, d):
    """Two listings read into one; the newer copy of a permalink stays."""
    both = (
        A.listing_old(spark, d)
        .withColumn("read_no", F.lit(1))
        .unionByName(A.listing_new(spark, d).withColumn("read_no", F.lit(2)))
        .withColumn("topik", nested.flatten_codes(F.col("topik")))
    )
    return listing.dedupe(both, latest_by="read_no").withColumn(
        "read_no", F.col("read_no").cast("long")
    )


@query
def listing_ingest(spark, d):
    """Overlapping pages: every row was read twice."""
    rows = A.listing_old(spark, d)
    return listing.ingest_listing(rows.unionByName(rows))


@query
def topic_flatten(spark, d):
    return A.base_listing(spark, d).select(
        KEY, nested.flatten_codes(F.col("topik")).alias("topik")
    )


@query
def topic_filter(spark, d):
    flat = topic_flatten(spark, d)
    whole = listing.with_any_code(flat, ["2", "3"]).select(KEY, F.lit(True).alias("w"))
    return (
        listing.topic_filter(flat)
        .join(whole, KEY, "left")
        .select(KEY, "topik", F.coalesce("w", F.lit(False)).alias("whole_code"))
    )


@query
def topic_dimension(spark, d):
    return regulations.topic_dimension(A.base_listing(spark, d)).withColumn(
        "uuid", F.col("uuid").cast("long")
    )


@query
def listing_page(spark, d):
    """Second page of the listing, newest first."""
    rows = A.base_listing(spark, d).select(
        KEY,
        dates.parse_listing_date(F.col("tanggal_efektif")).alias("tanggal_efektif"),
        "status_dokumen",
    )
    return listing.listing_page(rows, page=2, limit=PAGE_ROWS)


@query
def listing_stored_page(spark, d):
    """A deep page of the listing out of a sorted store: the last whole one."""
    rows = A.base_listing(spark, d).select(
        KEY,
        dates.parse_listing_date(F.col("tanggal_efektif")).alias("tanggal_efektif"),
        "status_dokumen",
    )
    path = scratch_path(spark, "listing-store")
    order = [F.desc("tanggal_efektif"), F.asc(KEY)]
    stages.write_ordered(rows, path, order, max_rows=STORE_FILE_ROWS)
    page = A.table(spark, d, "documents").count() // PAGE_ROWS
    return stages.read_page(spark, path, rows.schema, order, page, PAGE_ROWS)


@query
def struct_extract(spark, d):
    records = regulations.first_record(A.detail_responses(spark, d))
    flat = records.select(KEY, *regulations.detail_fields())
    return flat.select(
        KEY,
        "jenis_peraturan",
        "nomor_peraturan",
        "body_final",
        "keywords",
        *(F.size(c).cast("long").alias(f"{c}_links") for c in RELATION_COLUMNS),
    )


@query
def relations_flatten(spark, d):
    records = regulations.first_record(A.detail_responses(spark, d))
    return records.select(
        KEY,
        *(nested.flatten_links(F.col(f"detail.{c}")).alias(c) for c in RELATION_COLUMNS),
    )


@query
def relation_default(spark, d):
    """Length of each relation list once empty ones got their default."""
    records = regulations.first_record(A.detail_responses(spark, d))
    links = {
        c: nested.default_if_empty(nested.element_field(F.col(f"detail.{c}"), KEY))
        for c in RELATION_COLUMNS
    }
    return records.select(
        KEY,
        *(F.size(v).cast("long").alias(f"{c}_links") for c, v in links.items()),
        *(nested.sorted_join(v).alias(c) for c, v in links.items()),
    )


@query
def regulation_clean(spark, d):
    old = A.old_snapshot(spark, d)
    return A.regulations(spark, d, old)


# ---- snapshot diff and merge ------------------------------------------------


@query
def snapshot_diff(spark, d):
    return C.snapshot_diff(*A.snapshots(spark, d))


@query
def change_summary(spark, d):
    return C.change_summary(C.compare_snapshots(*A.snapshots(spark, d)))


@query
def changes_insert(spark, d):
    changes = C.snapshot_diff(*A.snapshots(spark, d))
    return C.inserted(changes)


@query
def changes_update(spark, d):
    old, new = A.snapshots(spark, d)
    stored = A.regulations(spark, d, old)
    return C.updated(C.snapshot_diff(stored, new), stored)


@query
def changes_delete(spark, d):
    return C.deleted(C.snapshot_diff(*A.snapshots(spark, d)))


@query
def snapshot_merge(spark, d):
    old, new = A.snapshots(spark, d)
    stored = A.regulations(spark, d, old)
    changes = materialize(C.snapshot_diff(old, new), "changes")
    fresh = C.with_details(
        changes.filter("op = 'insert'"), A.detail_responses(spark, d)
    )
    return C.snapshot_merge(stored, changes, fresh)


@query
def sync_stream(spark, d):
    """Both snapshots, announced as landed pages one after the other, synced by a stream."""
    base = scratch_path(spark, "sync")
    snapshots = {"1-old": A.listing_old(spark, d), "2-new": A.listing_new(spark, d)}
    number = F.substring_index(KEY, "-", -1).cast("long")
    page = F.floor(number / PAGE_ROWS) + 1
    for name, rows in snapshots.items():
        landed = A.land_pages(spark, rows, rows.select(F.max(page)).scalar(), page)
        snapshot_sync.announce(spark, f"{base}/announced", name, landed)

    def sync(snapshot_id: str, path: str) -> None:
        pages = read_listing_pages(spark, path)
        sync_snapshot(
            spark,
            f"{base}/tables",
            snapshot_id,
            listing_rows(pages),
            lambda wanted: A.detail_responses(spark, d, wanted=wanted),
            generate=_attempt,
            embed=lambda records: A.embed(spark, d, records),
            missing=missing_pages(pages),
        )

    stream = snapshot_sync.sync_stream(
        spark, f"{base}/announced", f"{base}/checkpoint", sync
    )
    stream.awaitTermination()
    tables = read_tables(spark, f"{base}/tables")
    per_document = (
        tables["vectors"].groupBy("metadata.permalink").agg(F.count("*").alias("records"))
    )
    return (
        tables["regulation"]
        .select(KEY, *LISTING_COLUMNS, "jenis_peraturan", "nomor_peraturan")
        .join(per_document, KEY, "left")
    )


@query
def sync_touched_buckets(spark, d):
    """The new snapshot changes only documents of src0; where the rows lie then, and since when."""
    base = scratch_path(spark, "buckets")
    of_src0 = A.table(spark, d, "documents").filter("source = 'src0'")
    of_src0 = of_src0.select(F.concat(F.lit("doc-"), "doc_id").alias(KEY))
    rows = A.listing_old(spark, d)
    changed = A.listing_new(spark, d).join(of_src0, KEY, "left_semi")
    mixed = changed.unionByName(rows.join(of_src0, KEY, "left_anti"))
    for name, listed in (("1-old", rows), ("2-new", mixed)):
        version = sync_snapshot(
            spark,
            base,
            name,
            listed,
            A.detail_responses(spark, d, with_body=False),
            generate=_attempt,
            embed=lambda records: A.embed(spark, d, records),
            audit=False,
            buckets=A.SYNC_BUCKETS,
        )
    written = spark.createDataFrame(
        list(enumerate(version.buckets["regulation"])), "bucket long, written long"
    )
    stored = read_tables(spark, base)["regulation"]
    counts = stored.groupBy(bucket_of(KEY, A.SYNC_BUCKETS).alias("bucket")).agg(
        F.count("*").alias("documents"), F.max("status_dokumen").alias("last_status")
    )
    return counts.join(written, "bucket")


@query
def retry_failures(spark, d):
    """Published vectors and the ledger of failures after a load and a later retry."""
    base = scratch_path(spark, "retry")

    def embed(records):
        return A.embed(spark, d, records)

    start = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    sync_snapshot(
        spark, base, "1", A.listing_old(spark, d),
        lambda wanted: A.detail_responses(spark, d, wanted=wanted),
        generate=_attempt, embed=embed, audit=False, now=start,
    )
    retry_job(spark, base, _attempt_again, embed, now=start + datetime.timedelta(hours=2))
    tables = read_tables(spark, base)
    records = tables["vectors"].groupBy(F.col("metadata.permalink").alias(KEY)).agg(
        F.count("*").alias("records"),
        F.count_if(F.col("document") == qa.FAILED_QUESTION).alias("failed_records"),
        F.max("id").alias("last_id"),
    )
    ledger = tables["failures"].withColumn(
        "next_try", F.date_format("next_try", "yyyy-MM-dd HH:mm")
    )
    return tables["regulation"].select(KEY).join(records, KEY, "left").join(ledger, KEY, "left")


# ---- text -------------------------------------------------------------------


@query
def text_clean(spark, d):
    return A.table(spark, d, "documents").select(
        "doc_id", text.clean_body(F.col("text")).alias("body")
    )


@query
def text_normalize(spark, d):
    return A.table(spark, d, "documents").select(
        "doc_id", text.normalize_whitespace(F.col("text")).alias("body")
    )


@query
def html_to_text(spark, d):
    return A.table(spark, d, "pages").select(
        "page_id",
        text.normalize_whitespace(markup.html_to_text(F.col("html"))).alias("body"),
    )


@query
def text_chunks(spark, d):
    pieces = text.chunks(F.col("text"), CHUNK_SIZE, CHUNK_OVERLAP)
    return A.table(spark, d, "documents").select("doc_id", F.inline(pieces))


@query
def date_parse(spark, d):
    rows = A.base_listing(spark, d)
    listed = dates.parse_listing_date(F.col("tanggal_efektif"))
    as_text = F.date_format(listed, "yyyy-MM-dd")
    # Every fifth date does not exist, every other fifth is no date at all.
    damaged = (
        F.when(F.col("doc_id") % 5 == 0, "31-02-2024")
        .when(F.col("doc_id") % 5 == 1, as_text)
        .otherwise(F.col("tanggal_efektif"))
    )
    return rows.select(
        KEY,
        listed.alias("listed"),
        dates.parse_iso_date(as_text).alias("stored"),
        dates.parse_listing_date(damaged, strict=False).alias("lenient"),
    )


@query
def jakarta_stamp(spark, d):
    return A.table(spark, d, "events").select(
        "event_id", dates.jakarta_stamp(F.col("ts")).alias("stamp")
    )


# ---- questions and answers --------------------------------------------------


def _attempt(documents: DataFrame) -> DataFrame:
    return qa.generate_qa(documents, A.halves, max_attempts=2, wait_seconds=0.0)


def _attempt_again(documents: DataFrame) -> DataFrame:
    return qa.generate_qa(documents, A.halves_later, max_attempts=2, wait_seconds=0.0)


def _generate(documents: DataFrame) -> DataFrame:
    return qa.mark_failed(_attempt(documents))


@query
def qa_parse(spark, d):
    return qa.parse_responses(A.qa_responses(spark, d)).select(
        KEY,
        F.col("part").cast("long").alias("part"),
        F.size("qa_list").cast("long").alias("pairs"),
        F.get("qa_list", F.lit(0)).question.alias("first_question"),
        F.get("qa_list", F.size("qa_list") - 1).answer.alias("last_answer"),
        "problem",
    )


@query
def qa_quarantine(spark, d):
    """Answers in prose, and event properties that are no responses at all."""
    prose = A.qa_responses(spark, d, A.SHORT_PART, True).select(
        F.concat(KEY, F.lit("/"), F.col("part").cast("string")).alias("source"), "body"
    )
    other = A.table(spark, d, "events").select(
        F.concat(F.lit("event-"), F.col("event_id").cast("string")).alias("source"),
        F.col("props").alias("body"),
    )
    parsed = qa.parse_responses(prose.unionByName(other))
    return qa.quarantine(parsed).select("source", "problem")


@query
def qa_pair_counts(spark, d):
    parsed = qa.parse_responses(A.qa_responses(spark, d))
    return parsed.groupBy(KEY).agg(F.sum(F.size("qa_list")).alias("pairs"))


@query
def qa_explode(spark, d):
    return A.qa_table(spark, d)


@query
def running_count(spark, d):
    events = A.table(spark, d, "events").select("event_id", "user_id", "event_type")
    return numbering.running_count(events, "user_id", "event_id", out="n")


@query
def qa_enrich(spark, d):
    """QA items of the new snapshot's documents, failed ones marked."""
    new = A.new_snapshot(spark, d)
    documents = qa.plain_text(A.regulations(spark, d, new))
    return qa.explode_qa(_generate(documents))


@query
def failed_split(spark, d):
    items = A.qa_with_failures(spark, d)
    failed = qa.failed_items(items).withColumn("failed", F.lit(True))
    kept = qa.kept_items(items).withColumn("failed", F.lit(False))
    return kept.unionByName(failed)


@query
def failed_regenerate(spark, d):
    items = materialize(A.qa_with_failures(spark, d), "qa")
    return qa.regenerate_failed(items, A.all_regulations(spark, d), _generate)


# ---- vectors ----------------------------------------------------------------


@query
def vector_documents(spark, d):
    old = A.old_snapshot(spark, d)
    return flattened_vectors(A.vector_table(spark, d, old))


@query
def vector_upsert(spark, d):
    """Records of the new snapshot over those of the old one."""
    old, new = A.snapshots(spark, d)
    qa = materialize(A.qa_table(spark, d), "qa")
    records = materialize(A.vector_table(spark, d, new, qa), "records")
    return flattened_vectors(V.upsert(A.vector_table(spark, d, old, qa), records))


@query
def vector_metadata_update(spark, d):
    old, new = A.snapshots(spark, d)
    stored = A.regulations(spark, d, old, with_body=False)
    changes = materialize(C.snapshot_diff(old, new), "changes")
    changed = materialize(C.updated(changes, stored), "changed")
    return flattened_vectors(V.update_metadata(A.vector_table(spark, d, old), changed))


@query
def vector_delete(spark, d):
    old, new = A.snapshots(spark, d)
    gone = C.deleted(materialize(C.snapshot_diff(old, new), "changes"))
    return flattened_vectors(V.delete_where_in(A.vector_table(spark, d, old), gone))


@query
def vector_get_where(spark, d):
    old, new = A.snapshots(spark, d)
    changes = materialize(C.snapshot_diff(old, new), "changes")
    changed = changes.filter("op = 'update'").select(KEY)
    return flattened_vectors(V.get_where_in(A.vector_table(spark, d, old), changed))


@query
def vector_sync(spark, d):
    """Upsert, metadata update and delete in one pass."""
    old, new = A.snapshots(spark, d)
    stored = A.regulations(spark, d, old, with_body=False)
    changes = materialize(C.snapshot_diff(old, new), "changes")
    details = A.detail_responses(spark, d, with_body=False)
    fresh = C.with_details(changes.filter("op = 'insert'"), details)
    qa = materialize(A.qa_table(spark, d), "qa")
    records = materialize(V.vector_documents(qa, fresh), "records")
    changed = materialize(C.updated(changes, stored), "changed")
    merged = V.apply_changes(
        A.vector_table(spark, d, old, qa), records, changed, C.deleted(changes)
    )
    return flattened_vectors(merged)


@query
def vector_lookup(spark, d):
    """The records of the documents that have changed, out of a published vector table."""
    base = scratch_path(spark, "lookup")
    old, new = A.snapshots(spark, d)
    changed = materialize(C.snapshot_diff(old, new).filter("op = 'update'").select(KEY), "changed")
    records = _vectors(spark, d).select(*VECTOR_DOCUMENT.names)
    every = Rewrite(records, f"metadata.{KEY}", range(A.SYNC_BUCKETS))
    version = publish(spark, base, {}, "1", rewrites={"vectors": every}, buckets=A.SYNC_BUCKETS)
    found = read_keys(spark, version, "vectors", VECTOR_DOCUMENT, f"metadata.{KEY}", changed)
    return flattened_vectors(found)


# ---- retrieval --------------------------------------------------------------


def _rounded(hits: DataFrame) -> DataFrame:
    return hits.withColumn("distance", F.round("distance", 6))


@query
def knn_topk(spark, d):
    docs = A.table(spark, d, "embeddings")
    found = nearest.nearest(docs, A.questions(spark, d), NEIGHBOURS, id_col="vec_id")
    return _rounded(found)


def _vectors(spark, d):
    old = A.old_snapshot(spark, d)
    return materialize(A.embed(spark, d, A.vector_table(spark, d, old)), "vectors")


@query
def knn_topk_filtered(spark, d):
    """Nearest records among those in force."""
    records = A.vector_table(spark, d, A.old_snapshot(spark, d))
    records = records.filter(F.col("metadata.status_dokumen") == "Berlaku").select("id")
    docs = A.embed(spark, d, records)
    return _rounded(nearest.nearest(docs, A.questions(spark, d), NEIGHBOURS))


@query
def knn_lsh(spark, d):
    """Approximate neighbours, each with the recall of its question."""
    docs = A.table(spark, d, "embeddings").select("vec_id", "embedding")
    asked = A.questions(spark, d)
    index = nearest.build_lsh_index(
        docs, scratch_path(spark, "lsh"), VECTOR_DIM, id_col="vec_id", bits=4
    )
    found = materialize(
        nearest.nearest_lsh(
            index, asked, NEIGHBOURS, VECTOR_DIM, id_col="vec_id", bits=4
        ),
        "lsh",
    )
    exact = nearest.nearest(docs, asked, NEIGHBOURS, id_col="vec_id")
    measured = nearest.recall(exact, found, "query_id", "vec_id")
    return _rounded(found).join(measured, "query_id", "left")


@query
def topic_labels(spark, d):
    flat = topic_flatten(spark, d)
    topics = regulations.topic_dimension(A.base_listing(spark, d))
    # Code 5 stays out of the table, so that unknown codes occur.
    return context.topic_labels(flat, topics.filter("uuid <> 5"))


def _retrieved(spark, d):
    vectors = _vectors(spark, d)
    asked = A.questions(spark, d)
    hits = nearest.nearest(vectors, asked, CONTEXT_ROWS)
    return asked, context.retrieved(hits, vectors)


@query
def rag_prompt(spark, d):
    return context.rag_prompts(*_retrieved(spark, d))


@query
def citation_cards(spark, d):
    _, results = _retrieved(spark, d)
    topics = regulations.topic_dimension(A.base_listing(spark, d))
    return context.citation_cards(results, topics)
