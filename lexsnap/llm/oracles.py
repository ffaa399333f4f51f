"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

_UPPER, _LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"

OP8 = f"""
WITH texts AS (
    SELECT doc_id, translate(coalesce(text, ''), {_UPPER}, {_LOWER}) AS body FROM documents
), groups AS (
    SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM texts GROUP BY body
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256
FROM texts JOIN groups USING (body)
"""


OP2 = """
WITH payloads AS (
    SELECT page_id, coalesce(html, '') AS payload FROM pages
), hashed AS (
    SELECT page_id, octet_length(encode(payload)) AS payload_bytes, sha1(payload) AS hex,
           max(page_id) OVER (PARTITION BY payload) AS first_id
    FROM payloads
), digits AS (
    SELECT *, list_transform(range(8), lambda k: ('0x' || substr(hex, CAST(5 * k + 1 AS BIGINT), 5))::BIGINT) AS parts FROM hashed
)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + ((parts[k // 4 + 1] >> CAST(15 - 5 * (k % 4) AS BIGINT)) & 31), 1)), '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM digits
"""


OP3 = """
WITH RECURSIVE sizes AS (
    SELECT source, CAST(sum(coalesce(length(text), 0) + 1) AS BIGINT) AS size,
           CAST(CASE source WHEN 'src0' THEN 4 WHEN 'src1' THEN 2 WHEN 'src2' THEN 2 ELSE 1 END AS BIGINT) AS weight
    FROM documents GROUP BY source
), totals AS (
    SELECT CAST(sum(size) AS BIGINT) AS all_size, CAST(sum(weight) AS BIGINT) AS all_weight FROM sizes
), rates AS (
    SELECT source, CAST(weight * all_size AS DOUBLE) / CAST(size * all_weight AS DOUBLE) AS rate FROM sizes, totals
), parts AS (
    SELECT source, CAST(greatest(ceil(rate / 32), 1) AS INTEGER) AS n_parts, rate FROM rates
), steps AS (
    SELECT source, n_parts, rate / n_parts AS r, 0 AS k, exp(-(rate / n_parts)) AS p, exp(-(rate / n_parts)) AS total FROM parts
    UNION ALL
    SELECT source, n_parts, r, k + 1, p * r / (k + 1), total + p * r / (k + 1) FROM steps WHERE k < 127
), sums AS (
    SELECT source, n_parts, list(total) AS totals FROM steps GROUP BY source, n_parts
), draws AS (
    SELECT d.*, totals, unnest(range(1, n_parts + 1)) AS part
    FROM documents d JOIN sums s ON d.source IS NOT DISTINCT FROM s.source
), counts AS (
    SELECT doc_id, text, lang, source, n_chars,
           sum(len(list_filter(totals, lambda t: t <=
               ('0x' || substr(md5('17:' || doc_id || ':' || part), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE))) AS n
    FROM draws GROUP BY ALL
)
SELECT doc_id, text, lang, source, n_chars, CAST(n AS INTEGER) AS n_copies,
       CAST(unnest(range(1, CAST(n AS BIGINT) + 1)) AS INTEGER) AS copy
FROM counts
"""


OP12 = r"""
WITH texts AS (
    SELECT doc_id, coalesce(text, '') AS body, coalesce(source, '') AS part FROM documents
), split AS (
    SELECT *, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY body) AS least
    FROM texts
), masks AS (
    SELECT doc_id, part,
           CASE WHEN len(words) < 200 THEN 1 ELSE 0 END
           + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
           + CASE WHEN 100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 2 * length(body) THEN 4 ELSE 0 END
           + CASE WHEN regexp_matches(body, '[#$%&*|]') THEN 8 ELSE 0 END
           + CASE WHEN doc_id > least THEN 16 ELSE 0 END AS mask
    FROM split
), told AS (
    SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
    FROM labels GROUP BY doc_id
), counts AS (
    SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
    FROM masks LEFT JOIN told USING (doc_id) GROUP BY part, mask
), letters AS (
    SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([1, 2, 4, 8, 16]) AS bit
), orders AS (
    SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order,
           [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
    FROM letters a, letters b, letters c, letters d, letters e
    WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31
), steps AS (
    SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INTEGER AS before
    FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), measured AS (
    SELECT part, filter_order, step, bit,
           sum(CASE WHEN mask & (bit | before) = 0 THEN n ELSE 0 END) AS kept,
           sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
           sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS redundant,
           sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
           sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost,
           sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
    FROM counts, steps GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
       redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
       toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM measured
"""


def _linked_by_shingles(percent: int, extra: str = "") -> str:
    """Components of documents whose shingle sets have at least this Jaccard similarity."""
    return rf"""
WITH RECURSIVE split AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_UPPER}, {_LOWER}), '[^\x20\x09-\x0D]+') AS words
    FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(words) = 0 THEN [] ELSE list_distinct(list_transform(
        range(1, greatest(len(words) - 4, 1) + 1), lambda k: array_to_string(words[k:k + 4], ' '))) END AS shingles
    FROM split
), grams AS (
    SELECT doc_id, len(shingles) AS n, unnest(shingles) AS gram FROM sets
), links AS (
    SELECT a.doc_id AS one, b.doc_id AS other
    FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n
    HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))
), reach AS (
    SELECT one, other FROM links
    UNION
    SELECT r.one, l.other FROM reach r JOIN links l ON r.other = l.one
), least AS (
    SELECT one, min(other) AS smallest FROM reach GROUP BY one
)
SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, least(doc_id, coalesce(smallest, doc_id)) AS component_id{extra}
FROM sets LEFT JOIN least ON doc_id = one
"""


OP9 = _linked_by_shingles(75, ", doc_id = least(doc_id, coalesce(smallest, doc_id)) AS kept")
OP13 = _linked_by_shingles(80)


def oracle_sql() -> dict[str, str]:
    return {"op9_superminhash_dedup": OP9, "op13_rare_first_join": OP13, "op2_warc": OP2, "op3_mixing": OP3, "op8_exact_dedup": OP8, "op12_filter_tries": OP12}
