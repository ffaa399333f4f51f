"""The jobs: first load and snapshot sync, and the retry of failed generations."""

from __future__ import annotations

import datetime
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexsnap.operators import vectors as V
from lexsnap.operators.changes import (
    change_summary,
    deleted,
    require_keys,
    snapshot_diff,
    snapshot_merge,
    updated,
    with_details,
)
from lexsnap.operators.listing import ingest_listing, wanted_rows
from lexsnap.operators.qa import (
    FAILED_QUESTION,
    after_kept,
    explode_qa,
    kept_items,
    mark_failed,
    plain_text,
    with_outcome,
)
from lexsnap.operators.regulations import topic_dimension
from lexsnap.schemas import (
    DETAIL_COLUMNS,
    FAILURE,
    KEY,
    LISTING_COLUMNS,
    QA,
    REGULATION,
    TOPIC,
    VECTOR_DOCUMENT,
)
from lexsnap.session import few, materialize, sent, stored_bytes
from lexsnap.sources.tables import write_json
from lexsnap.sources.versions import (
    Rewrite,
    Version,
    current_version,
    in_few_tasks,
    publish,
    read_version,
    touched_buckets,
)

CHANGE_COUNTS = T.StructType(
    [T.StructField("op", T.StringType()), T.StructField("n", T.LongType())]
)

# The tables kept in buckets, all by document: what touches a document touches the same
# bucket of each.
BUCKETED = {
    "regulation": (REGULATION, KEY),
    "qa": (QA, KEY),
    "vectors": (VECTOR_DOCUMENT, f"metadata.{KEY}"),
    "failures": (FAILURE, KEY),
}
BUCKETS = 16

# Until a failed document is generated again: doubled with each round.
FIRST_WAIT = datetime.timedelta(hours=1)

Plugin = Callable[[DataFrame], DataFrame]


def sync_snapshot(
    spark: SparkSession,
    root: str,
    snapshot_id: str,
    listing: DataFrame,
    responses: DataFrame | Plugin,
    generate: Plugin,
    embed: Plugin,
    missing: DataFrame | None = None,
    refresh_updates: bool = False,
    audit: bool = True,
    buckets: int = BUCKETS,
    now: datetime.datetime | None = None,
) -> Version:
    """Bring the tables under ``root`` in line with one whole listing snapshot.

    ``listing`` is the nested listing and ``responses`` the landed details of (at
    least) the inserted rows, or a function that looks these up for a table with their
    permalinks. ``generate`` maps ``(permalink, body_final)`` to
    ``(permalink, qa_list)``, with ``attempts`` and ``error`` if it can fail, and
    ``embed`` adds ``embedding`` to vector records. ``missing`` holds page numbers that
    were not read: a partial snapshot would look like deletes, so it is refused. With no
    version yet this is the first load. A snapshot that is not newer than the last one is
    skipped, which makes a repeated run a no-op.

    The stored tables lie in ``buckets`` buckets (a number that the first load fixes;
    take one that leaves some hundred MB to each). Only those that hold a changed
    document are read and written; of all others the diff reads the compared columns.
    Documents whose generation failed get a row in ``failures``, from which
    ``retry_failures`` takes them; they have no vectors until then. ``audit`` keeps the
    change sets as JSON.
    """
    current = current_version(spark, root)
    if current.snapshot_id is not None and snapshot_id <= current.snapshot_id:
        return current
    if missing is not None and not missing.isEmpty():
        raise ValueError("the snapshot lacks pages; deletes cannot be told")
    if "regulation" in current.buckets:
        buckets = len(current.buckets["regulation"])

    # Each change set is written once: it feeds several tables, and the joins
    # below are planned by its true size. Those with a row per document are stored by
    # its key, so that a text is shuffled when it comes in and not again.
    stored = read_version(spark, current, "regulation", REGULATION)
    changes = _by_key(snapshot_diff(stored, ingest_listing(listing)), "changes")
    # A null key of the listing matches nothing, so it shows as an insert.
    require_keys(changes.filter("op = 'insert'"), unique=False)
    touched = touched_buckets(changes, KEY, buckets)
    old = {
        name: read_version(spark, current, name, schema, touched)
        for name, (schema, _) in BUCKETED.items()
    }
    # A first load has no keys to compare. Where there are few, the stored tables
    # stay in place: neither joins nor buckets shuffle them.
    first_load = not current.buckets
    in_place = first_load or few(changes.select(KEY))

    renewed = "op in ('insert', 'update')" if refresh_updates else "op = 'insert'"
    listed = changes.filter(renewed)
    found = responses(listed.select(KEY)) if callable(responses) else responses
    details = _by_key(with_details(listed, found).select(KEY, *DETAIL_COLUMNS), "details")
    require_keys(details)
    fresh = listed.select(KEY, *LISTING_COLUMNS).join(details, KEY)
    changed = _stored(updated(changes, old["regulation"], in_place), "changed")
    gone = deleted(changes)

    generated = _by_key(with_outcome(generate(plain_text(details))), "generated")
    fresh_qa = explode_qa(mark_failed(generated))
    records = embed(V.vector_documents(answered(fresh_qa), fresh))
    if not first_load:  # then their ids are compared, besides
        records = _stored(records, "records")
    new_rows = {"regulation": fresh, "qa": fresh_qa, "vectors": records}
    if in_place:
        text_bytes = stored_bytes(generated)
        sizes = {
            "regulation": stored_bytes(changes) + stored_bytes(details),
            "qa": text_bytes,
            "vectors": 2 * text_bytes,
        }
        new_rows = {
            name: in_few_tasks(rows, sizes[name], buckets) for name, rows in new_rows.items()
        }

    dropped = gone
    if refresh_updates:
        # All records of a renewed document give way to its new ones.
        dropped = changes.filter("op in ('update', 'delete')").select(KEY)
        kept_vectors = V.delete_where_in(old["vectors"], sent(dropped, in_place))
        vectors = V.upsert(kept_vectors, new_rows["vectors"], in_place and few(records))
    else:
        vectors = V.apply_changes(
            old["vectors"], new_rows["vectors"], changed, gone, in_place,
            ids_are_few=not first_load and few(records),
        )
    dropped = sent(dropped, in_place)
    qa = old["qa"].join(dropped, KEY, "left_anti").unionByName(new_rows["qa"])
    failures = old["failures"].join(dropped, KEY, "left_anti")
    failures = failures.unionByName(_failed(generated, now))

    rows = {
        "regulation": snapshot_merge(
            old["regulation"], changes, new_rows["regulation"], refresh_updates, changed, in_place
        ),
        "qa": qa,
        "vectors": vectors,
        "failures": failures,
    }
    tables = {
        "topic": topic_dimension(wanted_rows(listing)),
        "change_counts": change_summary(changes).filter("op <> 'same'"),
    }
    if audit:
        write_audit(audit_tables(fresh, changed, gone), f"{root}/audit/{snapshot_id}")
    return publish(
        spark,
        root,
        tables,
        snapshot_id,
        rewrites=_rewrites(rows, touched, in_place),
        buckets=buckets,
        before=current,
    )


def _stored(df: DataFrame, label: str) -> DataFrame:
    return materialize(df, label, codec="zstd")


def _by_key(df: DataFrame, label: str) -> DataFrame:
    return materialize(df, label, by=KEY, codec="zstd")


def _rewrites(
    rows: dict[str, DataFrame], touched: list[int], in_place: bool
) -> dict[str, Rewrite]:
    """The ledger has few short rows, and is always dealt anew."""
    out = {}
    for name, df in rows.items():
        schema, key = BUCKETED[name]
        stays = in_place and name != "failures"
        out[name] = Rewrite(df.select(*schema.names), key, touched, stays)
    return out


def answered(qa: DataFrame) -> DataFrame:
    """All items but those that stand for a failed generation."""
    return qa.filter(~F.col("question").eqNullSafe(FAILED_QUESTION))


def _failed(generated: DataFrame, now: datetime.datetime | None) -> DataFrame:
    """First rows of the ledger for the documents that failed."""
    return _ledger(
        generated.filter("error is not null").select(
            KEY, "error", "attempts", F.lit(1).cast("long").alias("rounds")
        ),
        now,
    )


def _ledger(rows: DataFrame, now: datetime.datetime | None) -> DataFrame:
    wait = F.lit(FIRST_WAIT.total_seconds()) * F.pow(F.lit(2.0), F.col("rounds") - 1)
    later = F.unix_micros(_time(now)) + (wait * 1_000_000).cast("long")
    return rows.withColumn("next_try", F.timestamp_micros(later)).select(*FAILURE.names)


def _time(now: datetime.datetime | None) -> Column:
    return F.current_timestamp() if now is None else F.lit(now)


def retry_failures(
    spark: SparkSession,
    root: str,
    generate: Plugin,
    embed: Plugin,
    now: datetime.datetime | None = None,
    max_rounds: int = 8,
) -> Version:
    """Generate the documents again that failed and are due, and publish what comes of it.

    ``generate`` and ``embed`` are those of ``sync_snapshot``. A document that succeeds
    gets its question rows, numbered on from those it has kept, and its vectors, and
    leaves the ledger. One that fails again waits twice as long as before, and is left
    alone after ``max_rounds`` rounds; its ledger row keeps the last error and the number
    of attempts. All of that becomes current together, and only the buckets of the due
    documents are written. With nothing due the tables stay as they are, so a repeated
    run is harmless.
    """
    current = current_version(spark, root)
    ledger = read_version(spark, current, "failures", FAILURE)
    is_due = (F.col("next_try") <= _time(now)) & (F.col("rounds") < max_rounds)
    due = materialize(ledger.filter(is_due), "due")
    if due.isEmpty():
        return current
    touched = touched_buckets(due, KEY, len(current.buckets["failures"]))
    old = {
        name: read_version(spark, current, name, schema, touched)
        for name, (schema, _) in BUCKETED.items()
    }
    # While few are due, the stored tables stay in place.
    in_place = few(due)
    due_keys = sent(due.select(KEY), in_place)
    documents = old["regulation"].join(due_keys, KEY, "left_semi")
    generated = _stored(with_outcome(generate(plain_text(documents))), "generated")
    solved = generated.filter("error is null")
    solved_keys = sent(solved.select(KEY), in_place)

    mine = old["qa"].join(solved_keys, KEY, "left_semi")
    kept = kept_items(mine)
    items = _stored(after_kept(explode_qa(solved), kept), "qa")
    records = _stored(embed(V.vector_documents(answered(items), documents)), "records")
    others = old["qa"].join(solved_keys, KEY, "left_anti")
    # Ids hold the permalink: those of other documents are others.
    vectors = V.upsert(V.get_where_in(old["vectors"], solved_keys), records)
    renewed = kept.select(*QA.names).unionByName(items)
    if in_place:
        n_buckets = len(current.buckets["failures"])
        renewed = in_few_tasks(renewed, stored_bytes(items), n_buckets)
        vectors = in_few_tasks(vectors, stored_bytes(records), n_buckets)

    again = generated.filter("error is not null").join(
        due.select(KEY, F.col("attempts").alias("_attempts"), F.col("rounds").alias("_rounds")), KEY
    )
    again = again.select(
        KEY,
        "error",
        (F.col("attempts") + F.col("_attempts")).alias("attempts"),
        (F.col("_rounds") + 1).alias("rounds"),
    )
    waiting = old["failures"].join(due.select(KEY), KEY, "left_anti")
    rows = {
        "qa": others.unionByName(renewed),
        "vectors": V.delete_where_in(old["vectors"], solved_keys).unionByName(vectors),
        "failures": waiting.unionByName(_ledger(again, now)),
    }
    return publish(
        spark,
        root,
        {},
        current.snapshot_id,
        rewrites=_rewrites(rows, touched, in_place),
        before=current,
    )


def audit_tables(
    fresh: DataFrame, changed: DataFrame, gone: DataFrame
) -> dict[str, DataFrame]:
    """The change sets under the names by which they are kept for audit."""
    return {"_new": fresh, "_update": changed, "_delete": gone}


def write_audit(change_sets: dict[str, DataFrame], path: str) -> list[str]:
    """Keep each change set that is not empty as JSON, gzipped; a repeated run rewrites it.

    Gives the names of those written.
    """

    def write(name: str) -> bool:
        if change_sets[name].select(KEY).isEmpty():
            return False
        write_json(change_sets[name], f"{path}/{name}.json", mode="overwrite", compression="gzip")
        return True

    with ThreadPoolExecutor(len(change_sets)) as writers:
        written = list(writers.map(write, change_sets))
    return [name for name, done in zip(change_sets, written) if done]


def read_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The current tables."""
    version = current_version(spark, root)
    schemas = {name: schema for name, (schema, _) in BUCKETED.items()}
    schemas |= {"topic": TOPIC, "change_counts": CHANGE_COUNTS}
    return {
        name: read_version(spark, version, name, schema)
        for name, schema in schemas.items()
    }


def flattened_vectors(vectors: DataFrame) -> DataFrame:
    """Vector records with their metadata as columns, for CSV and comparison."""
    return vectors.select("id", "metadata.*", F.col("document"))
