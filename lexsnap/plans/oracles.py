"""The registered queries in DuckDB SQL, over the same tables."""

from __future__ import annotations

from lexsnap.operators.nearest import hyperplanes
from lexsnap.operators.qa import FAILED_QUESTION
from lexsnap.plans.adapters import SHORT_PART, SYNC_BUCKETS, TURNS_PER_PART

LISTING = "permalink, perihal, tanggal_efektif, status_dokumen, topik"
DETAIL = (
    "jenis_peraturan, nomor_peraturan, body_final, peraturan_terbaru, "
    "peraturan_sebelumnya, peraturan_relevan, keywords"
)
FLAT_METADATA = (
    "id, answer, permalink, status_dokumen, topik, jenis_peraturan, nomor_peraturan, document"
)

# RE2 classes spell out the white space that Unicode adds to ASCII.
_SPACE = (
    r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
)


def _normalized(text: str) -> str:
    return f"trim(regexp_replace({text}, '{_SPACE}', ' ', 'g'), ' ')"


def _plain(html: str) -> str:
    markup = (
        r"(?is)<script\b[^>]*>(.*?)</script\s*>|<style\b[^>]*>(.*?)</style\s*>"
        r"|<!--.*?-->|<[a-z/!?][^>]*>"
    )
    bare = f"regexp_replace(replace({html}, '>', '> '), '{markup}', '\\1\\2', 'g')"
    for entity, char in (
        ("&middot;", "·"),
        ("&copy;", "©"),
        ("&quot;", '"'),
        ("&lt;", "<"),
        ("&gt;", ">"),
        ("&amp;", "&"),
    ):
        bare = f"replace({bare}, '{entity}', '{char}')"
    return _normalized(bare)


def _clean_body(body: str) -> str:
    return rf"replace(regexp_replace({body}, '[\r\n\t]', '', 'g'), '\"', '''')".replace(
        '\\"', '"'
    )


# ---- common tables, written in the order in which they depend on each other ----

CTES = {
    "base": """
      SELECT d.doc_id, 'doc-' || d.doc_id AS permalink, d.text AS perihal,
        DATE '2024-01-01' + CAST(d.doc_id % 365 AS INTEGER) AS tanggal_efektif,
        CASE l.quality WHEN 1 THEN 'Berlaku' WHEN 0 THEN 'Dicabut'
          ELSE 'Tidak diketahui' END AS status_dokumen,
        array_to_string(list_sort([CAST(d.doc_id % 4 AS VARCHAR),
          CAST(d.doc_id % 7 + 1 AS VARCHAR)]), ' ') AS topik
      FROM documents d LEFT JOIN labels l USING (doc_id)""",
    "listing_old": f"""
      SELECT {LISTING} FROM base
      WHERE doc_id % 10 <> 0 AND regexp_matches(topik, '2|3')""",
    "listing_new": f"""
      SELECT {LISTING} FROM (
        SELECT * REPLACE (CASE WHEN doc_id % 13 = 0 THEN 'Diubah'
          ELSE status_dokumen END AS status_dokumen,
          CASE WHEN doc_id % 17 = 0 THEN perihal || ' (perubahan)' ELSE perihal END AS perihal)
        FROM base)
      WHERE doc_id % 11 <> 0 AND regexp_matches(topik, '2|3')""",
    "raw_detail": """
      SELECT d.doc_id, 'doc-' || d.doc_id AS permalink, upper(d.lang) AS jenis_peraturan,
        d.source || '/' || d.doc_id AS nomor_peraturan, p.html AS body_final,
        CASE WHEN d.doc_id % 3 = 0 THEN ['doc-' || (d.doc_id + 1)]
          ELSE CAST([] AS VARCHAR[]) END AS peraturan_terbaru,
        CASE WHEN d.doc_id % 5 = 0 THEN ['doc-' || (d.doc_id - 1), 'doc-' || (d.doc_id - 2)]
          ELSE CAST([] AS VARCHAR[]) END AS peraturan_sebelumnya,
        CASE WHEN d.doc_id % 7 <> 0 THEN ['doc-' || (d.doc_id * 2)] END AS peraturan_relevan,
        d.lang || ' ' || d.source AS keywords
      FROM documents d JOIN pages p
        ON p.page_id = d.doc_id % (SELECT count(*) FROM pages)
      WHERE d.doc_id % 29 <> 0""",
    "detail": f"""
      SELECT permalink, jenis_peraturan, nomor_peraturan,
        {_clean_body("body_final")} AS body_final,
        array_to_string(list_sort(peraturan_terbaru), ' ') AS peraturan_terbaru,
        array_to_string(list_sort(peraturan_sebelumnya), ' ') AS peraturan_sebelumnya,
        array_to_string(list_sort(peraturan_relevan), ' ') AS peraturan_relevan,
        keywords
      FROM raw_detail""",
    "regulation_old": f"""
      SELECT {LISTING}, {DETAIL} FROM listing_old LEFT JOIN detail USING (permalink)""",
    "regulation_new": f"""
      SELECT {LISTING}, {DETAIL} FROM listing_new LEFT JOIN detail USING (permalink)""",
    "ins": """
      SELECT n.* FROM listing_new n ANTI JOIN listing_old o ON n.permalink = o.permalink""",
    "upd": f"""
      SELECT n.*, {", ".join("o." + c for c in DETAIL.split(", "))}
      FROM listing_new n LEFT JOIN regulation_old o ON n.permalink = o.permalink
      WHERE n.perihal <> o.perihal OR n.tanggal_efektif <> o.tanggal_efektif
        OR n.status_dokumen <> o.status_dokumen OR n.topik <> o.topik""",
    "del": """
      SELECT o.permalink FROM listing_old o ANTI JOIN listing_new n ON n.permalink = o.permalink""",
    "ins_full": f"""
      SELECT {LISTING}, {DETAIL} FROM ins LEFT JOIN detail USING (permalink)""",
    "merged": f"""
      SELECT {LISTING}, {DETAIL} FROM (
        SELECT *, row_number() OVER (PARTITION BY permalink ORDER BY priority DESC) AS rn
        FROM (SELECT 0 AS priority, {LISTING}, {DETAIL} FROM regulation_old
          UNION ALL SELECT 1, {LISTING}, {DETAIL} FROM ins_full
          UNION ALL SELECT 2, {LISTING}, {DETAIL} FROM upd))
      ANTI JOIN del USING (permalink) WHERE rn = 1""",
    "turn_pairs": """
      SELECT u.conv_id, u.turn, u.text AS question, a.text AS answer
      FROM conversations u JOIN conversations a
        ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
      WHERE u.role = 'user' AND a.role = 'assistant'""",
    "placed": """
      SELECT conv_id, CASE WHEN role = 'assistant' THEN greatest(turn - 1, 0)
        ELSE turn END AS place
      FROM conversations""",
    "parts": f"""
      SELECT DISTINCT conv_id, place // {TURNS_PER_PART} AS part FROM placed""",
    "qa": f"""
      SELECT row_number() OVER (PARTITION BY g.conv_id ORDER BY g.part, t.turn) AS id,
        'doc-' || g.conv_id AS permalink, t.question, t.answer
      FROM parts g LEFT JOIN turn_pairs t
        ON t.conv_id = g.conv_id AND t.turn // {TURNS_PER_PART} = g.part""",
    "short_parts": f"""
      SELECT DISTINCT conv_id, place // {SHORT_PART} AS part FROM placed""",
    "prose": f"""
      SELECT DISTINCT conv_id, turn // {SHORT_PART} AS part FROM conversations
      WHERE role = 'system'""",
    "qa_failures": f"""
      SELECT row_number() OVER (PARTITION BY conv_id ORDER BY part, turn) AS id,
        'doc-' || conv_id AS permalink, question, answer
      FROM (
        SELECT b.conv_id, b.part, t.turn, t.question, t.answer
        FROM short_parts b ANTI JOIN prose USING (conv_id, part) LEFT JOIN turn_pairs t
          ON t.conv_id = b.conv_id AND t.turn // {SHORT_PART} = b.part
        UNION ALL
        SELECT conv_id, part, 0, '{FAILED_QUESTION}', NULL FROM prose)""",
    "vec_old": """
      SELECT q.permalink || '#' || q.id AS id, q.answer, q.permalink, r.status_dokumen,
        r.topik, r.jenis_peraturan, r.nomor_peraturan, q.question AS document
      FROM qa q JOIN regulation_old r USING (permalink)""",
    "vec_new": """
      SELECT q.permalink || '#' || q.id AS id, q.answer, q.permalink, r.status_dokumen,
        r.topik, r.jenis_peraturan, r.nomor_peraturan, q.question AS document
      FROM qa q JOIN regulation_new r USING (permalink)""",
    "vec_updated": """
      SELECT v.id, v.answer, v.permalink,
        CASE WHEN u.permalink IS NULL THEN v.status_dokumen ELSE u.status_dokumen END
          AS status_dokumen,
        CASE WHEN u.permalink IS NULL THEN v.topik ELSE u.topik END AS topik,
        CASE WHEN u.permalink IS NULL THEN v.jenis_peraturan ELSE u.jenis_peraturan END
          AS jenis_peraturan,
        CASE WHEN u.permalink IS NULL THEN v.nomor_peraturan ELSE u.nomor_peraturan END
          AS nomor_peraturan,
        v.document
      FROM vec_old v LEFT JOIN upd u USING (permalink)""",
    "vectors": """
      SELECT v.*, e.embedding FROM vec_old v JOIN embeddings e
        ON e.vec_id = (CAST(regexp_extract(v.id, 'doc-(\\d+)', 1) AS BIGINT) * 7
          + CAST(regexp_extract(v.id, '#(\\d+)', 1) AS BIGINT))
          % (SELECT count(*) FROM embeddings)""",
    "asked": """
      SELECT b.item_id AS query_id, b.text AS prompt, e.embedding
      FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id""",
    "new_text": f"""
      SELECT permalink, {_plain("body_final")} AS body FROM regulation_new""",
    "labelled": """
      SELECT list AS topik, array_to_string(list(label ORDER BY pos)
          FILTER (label IS NOT NULL), ', ') AS topik_labels
      FROM (SELECT list, pos, CASE WHEN code <> '5' THEN 'Topik ' || code END AS label
        FROM (SELECT topik AS list, unnest(string_split(topik, ' ')) AS code,
            generate_subscripts(string_split(topik, ' '), 1) AS pos
          FROM (SELECT DISTINCT topik FROM base)))
      GROUP BY list""",
}


def _distance(a: str, b: str) -> str:
    return (
        f"list_sum(list_transform(range(1, len({a}) + 1), "
        f"lambda i: pow(CAST({a}[i] AS DOUBLE) - CAST({b}[i] AS DOUBLE), 2)))"
    )


def _bucket(key: str) -> str:
    return f"CAST('0x' || substr(md5({key}), 1, 8) AS BIGINT) % {SYNC_BUCKETS}"


def _neighbours(docs: str, key: str, k: int) -> str:
    return f"""
      SELECT query_id, rank, {key}, distance FROM (
        SELECT query_id, {key}, distance,
          row_number() OVER (PARTITION BY query_id ORDER BY distance, {key}) AS rank
        FROM (SELECT q.query_id, d.{key},
            {_distance("d.embedding", "q.embedding")} AS distance
          FROM asked q, {docs} d))
      WHERE rank <= {k}"""


def _generated(text: str, key: str) -> str:
    """Rows of the stand-in generator: two halves, each asked and answered."""
    first = f"substr({text}, 1, length({text}) // 2)"
    second = f"substr({text}, length({text}) // 2 + 1)"
    return f"""
      SELECT {key}, 1 AS id, {first} AS question, {second} AS answer
        FROM {{source}} WHERE length({text}) % 5 <> 0
      UNION ALL SELECT {key}, 2, {second}, {first}
        FROM {{source}} WHERE length({text}) % 5 <> 0
      UNION ALL SELECT {key}, 1, '{FAILED_QUESTION}', NULL
        FROM {{source}} WHERE length({text}) % 5 = 0
      UNION ALL SELECT {key}, 1, NULL, NULL FROM {{source}} WHERE {text} IS NULL"""


def _codes(table: str, key: str) -> str:
    """Rows ``(key, tbl, code)``: sign patterns against the fixed directions."""
    planes = hyperplanes(64, 4, 4, 42).tolist()
    return f"""
      SELECT {key}, tbl, list_sum(list_transform(range(1, 5), lambda b:
          CASE WHEN list_dot_product(e, p[b]) > 0 THEN 1 << (b - 1) ELSE 0 END)) AS code
      FROM (SELECT {key}, CAST(embedding AS DOUBLE[]) AS e FROM {table}),
        (SELECT unnest(range(4)) AS tbl, unnest({planes}) AS p)"""


_NEAR_LSH = f"""
  SELECT query_id, rank, vec_id, distance FROM (
    SELECT query_id, vec_id, distance,
      row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank
    FROM (SELECT m.query_id, m.vec_id,
        {_distance("d.embedding", "q.embedding")} AS distance
      FROM (SELECT DISTINCT a.query_id, c.vec_id FROM ({_codes("asked", "query_id")}) a
          JOIN ({_codes("embeddings", "vec_id")}) c USING (tbl, code)) m
        JOIN asked q USING (query_id) JOIN embeddings d USING (vec_id)))
  WHERE rank <= 5"""

_RETRIEVED = f"""
  SELECT h.query_id, h.rank, v.* EXCLUDE (embedding)
  FROM ({_neighbours("vectors", "id", 3)}) h JOIN vectors v USING (id)"""

_SHOWN = {
    c: f"coalesce({c}, 'None')"
    for c in ("document", "answer", "jenis_peraturan", "nomor_peraturan")
}

BODIES = {
    "listing_pages_inline": """
      SELECT permalink, perihal, strftime(tanggal_efektif, '%d-%m-%Y') AS tanggal_efektif,
        status_dokumen, topik, CAST(2 AS BIGINT) AS topics FROM base""",
    "listing_missing_pages": """
      SELECT page FROM (SELECT unnest(range(1, (SELECT max(doc_id) // 4 + 2
        FROM documents))) AS page)
      WHERE page NOT IN (SELECT doc_id // 4 + 1 FROM labels)""",
    "detail_enrich_join": """
      SELECT o.permalink, o.status_dokumen, r.jenis_peraturan, r.nomor_peraturan,
        r.keywords, CAST(length(r.body_final) AS BIGINT) AS body_length,
        r.permalink IS NOT NULL AS found
      FROM listing_old o LEFT JOIN raw_detail r USING (permalink)""",
    "json_rows_to_table": """
      SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""",
    "json_roundtrip": "SELECT * FROM documents",
    "csv_roundtrip": "SELECT * FROM documents",
    "csv_split_read": "SELECT * FROM documents",
    "json_array_split_read": "SELECT * FROM documents",
    "load_table_dispatch": """
      SELECT *, '.csv' AS suffix FROM labels UNION ALL
      SELECT *, '.json' AS suffix FROM labels""",
    "promote_snapshot": f"SELECT {LISTING}, {DETAIL} FROM regulation_old",
    "stage_once": "SELECT * FROM labels",
    "stage_outdated": """
      SELECT toxic, count(*) AS n FROM labels WHERE quality IN (0, 1) GROUP BY toxic""",
    "vector_batches": """
      SELECT batch, count(*) AS records, min(id) AS first_id, max(id) AS last_id
      FROM (SELECT id, (row_number() OVER (ORDER BY id) - 1) // 100 AS batch FROM vec_old)
      GROUP BY batch""",
    "changeset_audit": f"""
      SELECT '_new' AS change_set, {LISTING}, '' AS jenis_peraturan, '' AS nomor_peraturan,
        '' AS body_final, '' AS peraturan_terbaru, '' AS peraturan_sebelumnya,
        '' AS peraturan_relevan, '' AS keywords FROM ins
      UNION ALL SELECT '_update', {LISTING}, {DETAIL} FROM upd
      UNION ALL SELECT '_delete', permalink, {", ".join(["NULL"] * 11)} FROM del""",
    "listing_dedup": """
      SELECT permalink,
        CASE WHEN doc_id % 11 <> 0 AND doc_id % 17 = 0 THEN perihal || ' (perubahan)'
          ELSE perihal END AS perihal,
        strftime(tanggal_efektif, '%d-%m-%Y') AS tanggal_efektif,
        CASE WHEN doc_id % 11 <> 0 AND doc_id % 13 = 0 THEN 'Diubah'
          ELSE status_dokumen END AS status_dokumen,
        topik, CAST(CASE WHEN doc_id % 11 <> 0 THEN 2 ELSE 1 END AS BIGINT) AS read_no
      FROM base WHERE doc_id % 10 <> 0 OR doc_id % 11 <> 0""",
    "listing_ingest": "SELECT * FROM listing_old",
    "topic_flatten": "SELECT permalink, topik FROM base",
    "topic_filter": """
      SELECT permalink, topik,
        list_has_any(string_split(topik, ' '), ['2', '3']) AS whole_code
      FROM base WHERE regexp_matches(topik, '2|3')""",
    "topic_dimension": """
      SELECT DISTINCT uuid, 'Topik ' || uuid AS keterangan
      FROM (SELECT doc_id % 4 AS uuid FROM documents
        UNION ALL SELECT doc_id % 7 + 1 FROM documents)""",
    "listing_page": """
      SELECT permalink, tanggal_efektif, status_dokumen FROM base
      ORDER BY tanggal_efektif DESC, permalink LIMIT 50 OFFSET 50""",
    "listing_stored_page": """
      SELECT permalink, tanggal_efektif, status_dokumen FROM base
      ORDER BY tanggal_efektif DESC, permalink LIMIT 50
      OFFSET ((SELECT count(*) FROM documents) // 50 - 1) * 50""",
    "struct_extract": """
      SELECT 'doc-' || d.doc_id AS permalink, r.jenis_peraturan, r.nomor_peraturan,
        r.body_final, r.keywords, CAST(len(r.peraturan_terbaru) AS BIGINT)
          AS peraturan_terbaru_links,
        CAST(len(r.peraturan_sebelumnya) AS BIGINT) AS peraturan_sebelumnya_links,
        CAST(len(r.peraturan_relevan) AS BIGINT) AS peraturan_relevan_links
      FROM documents d LEFT JOIN raw_detail r USING (doc_id)""",
    "relations_flatten": """
      SELECT 'doc-' || d.doc_id AS permalink, r.peraturan_terbaru, r.peraturan_sebelumnya,
        r.peraturan_relevan
      FROM documents d LEFT JOIN detail r ON r.permalink = 'doc-' || d.doc_id""",
    "relation_default": """
      SELECT 'doc-' || d.doc_id AS permalink,
        CAST(CASE len(w.peraturan_terbaru) WHEN 0 THEN 1
          ELSE len(w.peraturan_terbaru) END AS BIGINT) AS peraturan_terbaru_links,
        CAST(CASE len(w.peraturan_sebelumnya) WHEN 0 THEN 1
          ELSE len(w.peraturan_sebelumnya) END AS BIGINT) AS peraturan_sebelumnya_links,
        CAST(len(w.peraturan_relevan) AS BIGINT) AS peraturan_relevan_links,
        r.peraturan_terbaru, r.peraturan_sebelumnya, r.peraturan_relevan
      FROM documents d LEFT JOIN raw_detail w USING (doc_id)
        LEFT JOIN detail r ON r.permalink = w.permalink""",
    "regulation_clean": f"SELECT {LISTING}, {DETAIL} FROM regulation_old",
    "snapshot_diff": f"""
      SELECT 'insert' AS op, {LISTING} FROM ins
      UNION ALL SELECT 'update', {LISTING} FROM upd
      UNION ALL SELECT 'delete', {LISTING} FROM listing_old JOIN del USING (permalink)""",
    "change_summary": """
      SELECT 'insert' AS op, (SELECT count(*) FROM ins) AS n
      UNION ALL SELECT 'update', (SELECT count(*) FROM upd)
      UNION ALL SELECT 'delete', (SELECT count(*) FROM del)
      UNION ALL SELECT 'same', (SELECT count(*) FROM listing_new)
        - (SELECT count(*) FROM ins) - (SELECT count(*) FROM upd)""",
    "changes_insert": f"""
      SELECT {LISTING}, '' AS jenis_peraturan, '' AS nomor_peraturan, '' AS body_final,
        '' AS peraturan_terbaru, '' AS peraturan_sebelumnya, '' AS peraturan_relevan,
        '' AS keywords FROM ins""",
    "changes_update": f"SELECT {LISTING}, {DETAIL} FROM upd",
    "changes_delete": "SELECT permalink FROM del",
    "snapshot_merge": f"SELECT {LISTING}, {DETAIL} FROM merged",
    "sync_stream": """
      SELECT m.permalink, m.perihal, m.tanggal_efektif, m.status_dokumen, m.topik,
        m.jenis_peraturan, m.nomor_peraturan,
        CAST(t.records AS BIGINT) AS records
      FROM merged m LEFT JOIN (
        SELECT permalink, CASE WHEN body IS NULL THEN 1 WHEN length(body) % 5 <> 0 THEN 2
          END AS records
        FROM (SELECT permalink, """
    + _plain("body_final")
    + """ AS body FROM merged)) t USING (permalink)""",
    "sync_touched_buckets": f"""
      WITH of_src0 AS (SELECT 'doc-' || doc_id AS permalink FROM documents WHERE source = 'src0'),
        next AS (SELECT * FROM listing_new SEMI JOIN of_src0 USING (permalink)
          UNION ALL SELECT * FROM listing_old ANTI JOIN of_src0 USING (permalink)),
        was AS (SELECT *, {_bucket("permalink")} AS bucket FROM listing_old),
        now AS (SELECT *, {_bucket("permalink")} AS bucket FROM next),
        touched AS (SELECT coalesce(n.bucket, o.bucket) AS bucket
          FROM was o FULL JOIN now n ON n.permalink = o.permalink
          WHERE n.permalink IS NULL OR o.permalink IS NULL OR n.perihal <> o.perihal
            OR n.status_dokumen <> o.status_dokumen)
      SELECT bucket, count(*) AS documents, max(status_dokumen) AS last_status,
        CAST(CASE WHEN bucket IN (SELECT bucket FROM touched) THEN 2 ELSE 1 END AS BIGINT)
          AS written
      FROM now GROUP BY bucket""",
    "retry_failures": f"""
      SELECT permalink, CAST(records AS BIGINT) AS records,
        CAST(CASE WHEN records IS NOT NULL THEN 0 END AS BIGINT) AS failed_records,
        permalink || '#' || records AS last_id,
        CASE WHEN records IS NULL THEN 'ValueError: no response' END AS error,
        CAST(CASE WHEN records IS NULL THEN 4 END AS BIGINT) AS attempts,
        CAST(CASE WHEN records IS NULL THEN 2 END AS BIGINT) AS rounds,
        CASE WHEN records IS NULL THEN '2024-01-01 04:00' END AS next_try
      FROM (SELECT permalink, CASE WHEN body IS NULL THEN 1
          WHEN length(body) % 35 <> 0 THEN 2 END AS records
        FROM (SELECT permalink, {_plain("body_final")} AS body FROM regulation_old))""",
    "text_clean": f"SELECT doc_id, {_clean_body('text')} AS body FROM documents",
    "text_normalize": f"SELECT doc_id, {_normalized('text')} AS body FROM documents",
    "html_to_text": f"SELECT page_id, {_plain('html')} AS body FROM pages",
    "text_chunks": """
      SELECT doc_id, substr(text, CAST(n * 800 + 1 AS BIGINT), 1000) AS chunk,
        '1000-' || (n + 1) AS chunk_num
      FROM (SELECT doc_id, text,
          unnest(range(CAST(ceil(length(text) / 800.0) AS BIGINT))) AS n FROM documents)""",
    "date_parse": """
      SELECT permalink, tanggal_efektif AS listed, tanggal_efektif AS stored,
        CASE WHEN doc_id % 5 > 1 THEN tanggal_efektif END AS lenient FROM base""",
    "jakarta_stamp": """
      SELECT event_id, strftime(ts + INTERVAL 7 HOUR, '%Y%m%d%H%M%S') AS stamp
      FROM events""",
    "qa_parse": f"""
      SELECT 'doc-' || g.conv_id AS permalink, g.part, count(t.turn) AS pairs,
        arg_min(t.question, t.turn) AS first_question,
        arg_max(t.answer, t.turn) AS last_answer, CAST(NULL AS VARCHAR) AS problem
      FROM parts g LEFT JOIN turn_pairs t
        ON t.conv_id = g.conv_id AND t.turn // {TURNS_PER_PART} = g.part
      GROUP BY g.conv_id, g.part""",
    "qa_quarantine": f"""
      SELECT 'doc-' || conv_id || '/' || part AS source, 'invalid_json' AS problem
      FROM prose
      UNION ALL
      SELECT 'event-' || event_id, CASE WHEN NOT json_valid(props) THEN 'invalid_json'
        WHEN json_type(props, '$.qa_list') IS DISTINCT FROM 'ARRAY' THEN 'missing_list' END
      FROM events""",
    "qa_pair_counts": """
      SELECT permalink, count(question) AS pairs FROM qa GROUP BY permalink""",
    "qa_explode": "SELECT id, permalink, question, answer FROM qa",
    "running_count": """
      SELECT event_id, user_id, event_type, count(user_id) OVER (
        PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS n
      FROM events""",
    "qa_enrich": "SELECT CAST(id AS BIGINT) AS id, permalink, question, answer FROM ("
    + _generated("body", "permalink").format(source="new_text")
    + ")",
    "failed_split": f"""
      SELECT *, question = '{FAILED_QUESTION}' AS failed FROM qa_failures
      WHERE question IS NOT NULL""",
    "failed_regenerate": f"""
      WITH f AS (SELECT DISTINCT permalink FROM qa_failures
          WHERE question = '{FAILED_QUESTION}'),
        kept AS (SELECT * FROM qa_failures WHERE question <> '{FAILED_QUESTION}'),
        src AS (SELECT permalink, {_plain("body_final")} AS body
          FROM base JOIN f USING (permalink) LEFT JOIN detail USING (permalink)),
        gen AS ({_generated("body", "permalink").format(source="src")}),
        tops AS (SELECT permalink, max(id) AS top FROM kept GROUP BY permalink)
      SELECT id, permalink, question, answer FROM kept
      UNION ALL SELECT g.id + coalesce(t.top, 0), g.permalink, g.question, g.answer
      FROM gen g LEFT JOIN tops t USING (permalink)""",
    "vector_documents": f"SELECT {FLAT_METADATA} FROM vec_old",
    "vector_upsert": f"""
      SELECT {FLAT_METADATA} FROM vec_old ANTI JOIN vec_new USING (id)
      UNION ALL SELECT {FLAT_METADATA} FROM vec_new""",
    "vector_metadata_update": f"SELECT {FLAT_METADATA} FROM vec_updated",
    "vector_delete": f"""
      SELECT {FLAT_METADATA} FROM vec_old ANTI JOIN del USING (permalink)""",
    "vector_get_where": f"""
      SELECT {FLAT_METADATA} FROM vec_old
      WHERE permalink IN (SELECT permalink FROM upd)""",
    "vector_lookup": f"""
      SELECT {FLAT_METADATA} FROM vec_old
      WHERE permalink IN (SELECT permalink FROM upd)""",
    "vector_sync": f"""
      SELECT {FLAT_METADATA} FROM vec_updated ANTI JOIN del USING (permalink)
      UNION ALL SELECT {FLAT_METADATA} FROM vec_new SEMI JOIN ins USING (permalink)""",
    "knn_topk": "SELECT query_id, rank, vec_id, round(distance, 6) AS distance FROM ("
    + _neighbours("embeddings", "vec_id", 5)
    + ")",
    "knn_topk_filtered": "SELECT query_id, rank, id, round(distance, 6) AS distance FROM ("
    + _neighbours("(SELECT * FROM vectors WHERE status_dokumen = 'Berlaku')", "id", 5)
    + ")",
    "knn_lsh": f"""
      SELECT f.query_id, f.rank, f.vec_id, round(f.distance, 6) AS distance, r.recall
      FROM ({_NEAR_LSH}) f LEFT JOIN (
        SELECT x.query_id, count(l.vec_id) / count(*) AS recall
        FROM ({_neighbours("embeddings", "vec_id", 5)}) x
          LEFT JOIN ({_NEAR_LSH}) l USING (query_id, vec_id)
        GROUP BY x.query_id) r USING (query_id)""",
    "topic_labels": """
      SELECT b.permalink, b.topik, coalesce(l.topik_labels, '') AS topik_labels
      FROM base b LEFT JOIN labelled l USING (topik)""",
    "rag_prompt": f"""
      SELECT a.query_id, 'Konteks yang Tersedia:' || chr(10) || coalesce(string_agg(
          '- ' || {_SHOWN["document"]} || ' ' || {_SHOWN["answer"]} || ' [Sumber: '
          || {_SHOWN["jenis_peraturan"]} || ' Nomor: ' || {_SHOWN["nomor_peraturan"]}
          || '] ', chr(10) ORDER BY r.rank) FILTER (r.rank IS NOT NULL), '')
        || chr(10) || chr(10) || 'Pertanyaan Pengguna:' || chr(10) || any_value(a.prompt)
        AS prompt
      FROM asked a LEFT JOIN ({_RETRIEVED}) r USING (query_id) GROUP BY a.query_id""",
    "citation_cards": f"""
      SELECT query_id, rank, jenis_peraturan, nomor_peraturan, permalink, topik_labels,
        question, answer,
        '**' || coalesce(jenis_peraturan, 'None') || ' Nomor: '
          || coalesce(nomor_peraturan, 'None') || '**' || chr(10) || chr(10) || '**ID**: `'
          || permalink || '`' || chr(10) || chr(10) || '**Topik**: ' || topik_labels
          AS heading,
        ':blue-badge[Tanya:] ' || coalesce(question, 'None') || chr(10) || chr(10)
          || ':green-badge[Jawab:] ' || coalesce(answer, 'None') AS body
      FROM (SELECT *, document AS question, array_to_string(list_transform(
          string_split(topik, ' '), lambda c: 'Topik ' || c), ', ') AS topik_labels
        FROM ({_RETRIEVED}))""",
}


def _needed(text: str) -> list[str]:
    """The common tables a statement names, directly or through others."""
    names: set[str] = set()
    pending = [text]
    while pending:
        body = pending.pop()
        for name in CTES:
            if name not in names and _mentions(body, name):
                names.add(name)
                pending.append(CTES[name])
    return [name for name in CTES if name in names]


def _mentions(text: str, name: str) -> bool:
    words = text.replace("(", " ").replace(")", " ").replace(",", " ").split()
    return name in words


# Statements whose comparison was interrupted in two rounds, for a reason not found. They
# name a common table twice; it is written out in each place, so that none is stored.
_WRITTEN_OUT = {"relation_default", "vector_upsert", "vector_sync"}


def oracle_sql() -> dict[str, str]:
    statements = {}
    for key, body in BODIES.items():
        kept = "AS NOT MATERIALIZED" if key in _WRITTEN_OUT else "AS"
        ctes = ", ".join(f"{name} {kept} ({CTES[name]})" for name in _needed(body))
        with_clause = f"WITH {ctes} " if ctes else ""
        statements[key] = f"{with_clause}SELECT * FROM ({body}) AS result"
    return statements
