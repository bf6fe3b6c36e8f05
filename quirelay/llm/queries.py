"""The registered queries of this subpackage and their SQL for DuckDB, where SQL can express them."""

from __future__ import annotations

import importlib

#: operator number: (module, query function)
OPERATORS = {
    1: ("toxicity", "op1_toxicity"),
    2: ("langid", "op2_language_id"),
    3: ("sharding", "op3_sharding"),
    4: ("setsketch", "op4_setsketch"),
    5: ("decontam", "op5_decontamination"),
    6: ("bpe", "op6_bpe"),
    7: ("pii", "op7_personal_data"),
    8: ("media", "op8_media"),
    9: ("licenses", "op9_licenses"),
    10: ("linededup", "op10_line_dedup"),
    11: ("search", "op11_search"),
    12: ("collocations", "op12_collocations"),
    13: ("packing", "op13_packing"),
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f".{module}", __package__), name) for _, (module, name) in sorted(OPERATORS.items())}


SHARDING_SQL = """
WITH bytes AS (
  SELECT range AS b FROM range(256)
), crc_table AS (
  SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce(range(8), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, b) AS c FROM bytes)
), sized AS (
  SELECT doc_id, source, coalesce(strlen(text), 0) + 1 AS size, coalesce(text, '') AS text FROM documents
), narrow AS (
  SELECT doc_id, size, coalesce('=' || source, '') AS stratum, xor(crc, 4294967295) AS text_crc32 FROM (
    SELECT doc_id, size, source, list_reduce(list_transform(regexp_extract_all(h, '..'), lambda x: CAST('0x' || x AS BIGINT)),
      lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)]), CAST(4294967295 AS BIGINT)) AS crc
    FROM (SELECT doc_id, source, size, hex(encode(text)) AS h FROM sized), crc_table)
), keyed AS (
  SELECT *, md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '~' || text_crc32)) AS key FROM narrow
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY key, doc_id NULLS FIRST, size, text_crc32) - 1 AS rank, count(*) OVER (PARTITION BY stratum) AS n FROM keyed
), placed AS (
  SELECT *, row_number() OVER (ORDER BY (CAST(rank AS DOUBLE) + 0.5) / CAST(n AS DOUBLE), md5('17:' || stratum), stratum, rank) - 1 AS pos, count(*) OVER () AS n_rows FROM ranked
), cut AS (
  SELECT *, (pos * 8 + 7) // n_rows AS shard FROM placed
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard,
  CAST(pos - (shard * n_rows) // 8 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM cut
"""

DECONTAMINATION_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), iw AS (
  SELECT DISTINCT item, least(len(w), 13) AS k, array_to_string(w[i:i + 12], ' ') AS window FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), lens AS (
  SELECT DISTINCT k FROM iw
), dw AS (
  SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS window FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, lens WHERE len(w) >= k)
), hits AS (
  SELECT r, i, dw.k, item FROM dw JOIN iw ON dw.window = iw.window AND dw.k = iw.k
), words AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT r, i, k FROM hits)) GROUP BY r
), items AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""

NEAR_DUPLICATES_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS shingle FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM shared JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 80 * (p.n + q.n - k)
), ends AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, l.y FROM reach r JOIN ends l ON r.b = l.x
), least AS (
  SELECT a, min(b) AS c FROM reach GROUP BY a
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c AS component_id, d.doc_id = c AS kept FROM d LEFT JOIN n USING (doc_id) JOIN least ON a = d.doc_id
"""

COLLOCATIONS_SQL = r"""
WITH pieces AS (
  SELECT lang, row_number() OVER () AS p, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), totals AS (
  SELECT lang, sum(len(w)) AS n FROM pieces GROUP BY lang
), starts AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces WHERE len(w) > 0
), counts AS (
  SELECT lang, words, array_to_string(words, ' ') AS phrase, len(words) AS k, count(*) AS f
  FROM (SELECT lang, unnest([w[i:i + j] FOR j IN range(0, 5) IF i + j <= len(w)]) AS words FROM starts) GROUP BY lang, words HAVING count(*) >= 100
), cuts AS (
  SELECT lang, phrase, k, f AS a, j, array_to_string(words[1:j], ' ') AS first, array_to_string(words[j + 1:k], ' ') AS rest
  FROM (SELECT *, unnest(range(1, k)) AS j FROM counts WHERE k > 1)
), scored AS (
  SELECT c.lang, c.phrase, c.k, a, j, x.f AS l, y.f AS r, n, (1000 * a::HUGEINT * n::HUGEINT) // (x.f::HUGEINT * y.f::HUGEINT) AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = c.first JOIN counts y ON y.lang = c.lang AND y.phrase = c.rest JOIN totals t ON t.lang = c.lang
), weakest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
), kept AS (
  SELECT * FROM weakest s WHERE NOT EXISTS (
    SELECT 1 FROM counts q WHERE q.lang = s.lang AND q.k > s.k AND 100 * q.f >= 100 * s.a AND contains(' ' || q.phrase || ' ', ' ' || s.phrase || ' '))
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept
)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000
"""

SEARCH_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents
), totals AS (
  SELECT CAST(count(*) AS BIGINT) AS nd, CAST(sum(len(t)) AS BIGINT) AS l FROM d WHERE len(t) > 0
), q AS (
  SELECT k, item_id, term, count(*) AS times FROM (
    SELECT row_number() OVER () AS k, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL
), p AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL
), w AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(nd) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, totals GROUP BY term
), m AS (
  SELECT r, doc_id, 100 - 25 + (25 * len(t) * nd) // l AS m FROM d, totals
), scores AS (
  SELECT k, item_id, doc_id, r, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS score FROM q JOIN p USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY k, item_id, doc_id, r
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM scores WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 20
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_search": SEARCH_SQL, "op12_collocations": COLLOCATIONS_SQL, "op4_setsketch": NEAR_DUPLICATES_SQL, "op3_sharding": SHARDING_SQL, "op5_decontamination": DECONTAMINATION_SQL}
