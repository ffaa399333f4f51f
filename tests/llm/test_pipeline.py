from __future__ import annotations

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import corpus_pipeline
import oracle
from lexsnap.llm import exact_dedup, mixing, near_dedup, oracles, quality, queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    con = oracle.connect(DATA)
    assert oracle.mismatch(queries.queries()[name](spark, DATA), con, oracles.oracle_sql()[name]) is None


def test_one_query_per_operator():
    numbers = sorted(int(name[2:].split("_")[0]) for name in queries.queries())
    assert numbers == list(range(1, 14))


def test_stages_over_each_other_equal_the_run(spark):
    docs = queries.table(spark, DATA, "documents")
    columns = docs.columns
    kept = []
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        kept.append([r.doc_id for r in docs.collect()])
    first = queries.table(spark, DATA, "documents")
    scores = quality.score_quality(first, queries.table(spark, DATA, "labels")).collect()
    assert sorted(kept[0]) == sorted(r.doc_id for r in scores if r.predicted)
    # The copies left are exactly what each operator says about its own input.
    accepted = first.where(first.doc_id.isin(kept[0]))
    assert sorted(kept[1]) == sorted(r.doc_id for r in exact_dedup.exact_groups(accepted).collect() if r.kept)
    single = first.where(first.doc_id.isin(kept[1]))
    assert sorted(kept[2]) == sorted(r.doc_id for r in near_dedup.near_duplicates(single).collect() if r.kept)
    last = first.where(first.doc_id.isin(kept[2]))
    assert sorted(kept[3]) == sorted(r.doc_id for r in mixing.mixed(last, queries.SOURCE_WEIGHTS).collect())
    pieces = corpus_pipeline.run(spark, DATA).collect()
    assert sorted(p.doc_id for p in pieces if p.start == 0) == sorted(kept[3])


ODD = "doc_id long, text string, lang string, source string, n_chars long, mask int, set_key string, copy int"


def odd_tables(spark, folder, docs):
    spark.createDataFrame(docs, ODD).write.parquet(f"{folder}/documents.parquet")
    labels = [(k, k % 2, 0) for k in range(0, 60, 2)] + [(None, 1, 1), (4, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_odd_rows_pass_all_stages(spark, tmp_path):
    rng = random.Random(6)
    prose = lambda n: " ".join("w%d" % rng.randrange(900) for _ in range(n))
    docs = [(k, prose(rng.randrange(1, 200)), "en", "src%d" % (k % 3), 5, 1, "x", 2) for k in range(40)]
    docs += [(40, None, None, None, None, None, None, None), (41, "", "en", "src0", 0, 1, "x", 2), (42, " \n", "en", None, 0, 1, "x", 2)]
    docs += [(43, prose(60_000), "en", "src1", 1, 1, "x", 2), (None, prose(30), "en", "src1", 1, 1, "x", 2)]
    docs += [docs[3]] * 15 + [(50, docs[3][1].upper(), "en", "src2", 1, 1, "x", 2)]
    folder = odd_tables(spark, tmp_path, docs)
    rows = queries.table(spark, folder, "documents")
    columns = rows.columns
    for _, stage in corpus_pipeline.STAGES[:4]:
        rows = stage(spark, rows, folder)
        assert rows.columns == columns
        rows = spark.createDataFrame(rows.collect(), rows.schema)
    kept = {r.doc_id for r in rows.collect()}
    pieces = corpus_pipeline.run(spark, folder).collect()
    assert {p.doc_id for p in pieces} == kept
    assert not kept & {3} or not kept & {50}  # of equal texts one stays
    by_document = {}
    for p in pieces:
        by_document.setdefault(p.doc_id, []).append(p)
    for own in by_document.values():
        assert sum(p.length for p in own) % own[0].doc_tokens == 0


def test_empty_tables_give_no_rows(spark, tmp_path):
    assert corpus_pipeline.run(spark, odd_tables(spark, tmp_path, [])).count() == 0
