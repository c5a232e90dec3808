"""DuckDB SQL with the same result, for the queries that SQL can express.

Limits and patterns are written out here on purpose, so that a change in an operator shows.
"""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {}

ORACLES["op1_quality_rules"] = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text, {WORDS.format("text")} AS ws FROM documents
), lines AS (
  SELECT doc_id, source, line, pos, len({WORDS.format("line")}) AS n,
    array_to_string({WORDS.format(LOWER.format("line"))}, ' ') AS norm
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d)
), worded AS (SELECT * FROM lines WHERE n > 0
), dup AS (
  SELECT doc_id, count(*) AS n_dup FROM
    (SELECT doc_id, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) AS k FROM worded) WHERE k > 1 GROUP BY doc_id
), win AS (
  SELECT doc_id, i, array_to_string(ws[i : i + 7], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM d WHERE len(ws) >= 8)
), rep AS (
  SELECT doc_id, count(DISTINCT p) AS n_rep FROM (
    SELECT doc_id, unnest(range(i, i + 8)) AS p FROM
      (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c > 1) GROUP BY doc_id
), per_doc AS (SELECT doc_id, source, norm, sum(n) AS n FROM worded GROUP BY ALL
), hosts AS (SELECT source, count(*) AS host_docs FROM d GROUP BY source
), over AS (
  SELECT p.source, p.norm, p.first_id FROM
    (SELECT source, norm, count(*) AS docs, min(doc_id) AS first_id FROM per_doc GROUP BY ALL) p
    JOIN hosts h ON p.source IS NOT DISTINCT FROM h.source WHERE docs > 10 AND docs > least(0.01 * host_docs, 1000)
), gone AS (
  SELECT p.doc_id, sum(p.n) AS removed FROM per_doc p JOIN over o
    ON p.norm = o.norm AND p.source IS NOT DISTINCT FROM o.source AND p.doc_id <> o.first_id GROUP BY p.doc_id
), c AS (
  SELECT d.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup, 0) AS n_dup_lines,
    coalesce(n_rep, 0) AS n_repeat_words, coalesce(removed, 0)::BIGINT AS removed_words
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, n_words, coalesce(word_chars, 0) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, removed_words,
  (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT
    (removed_words > 0 AND (n_words - removed_words < 20 OR n_words - removed_words < 0.2 * n_words)) AS kept
FROM c
"""

ORACLES["op2_near_vectors"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), ok AS (
  SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0
), near AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.95
), reach AS (
  SELECT vec_id, vec_id AS c FROM v UNION SELECT n.y, r.c FROM reach r JOIN near n ON n.x = r.vec_id
), comp AS (SELECT vec_id, min(c) AS component_id FROM reach GROUP BY vec_id)
SELECT vec_id, (SELECT count(*) FROM near WHERE x = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM comp
"""

ORACLES["op4_jaccard_join"] = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format(LOWER.format("coalesce(text, '')"))} AS ws FROM documents
), sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN
      list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i : i + 3], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM d
), n AS (SELECT d.doc_id, count(s) AS n FROM d LEFT JOIN sh USING (doc_id) GROUP BY d.doc_id
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM shared JOIN n a ON x = a.doc_id JOIN n b ON y = b.doc_id WHERE 100 * c >= 85 * (a.n + b.n - c)
), reach AS (
  SELECT doc_id, doc_id AS c FROM d UNION SELECT l.y, r.c FROM reach r JOIN links l ON l.x = r.doc_id
), comp AS (SELECT doc_id, min(c) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, n AS n_shingles, component_id FROM comp JOIN n USING (doc_id)
"""

ORACLES["op5_warc"] = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS h FROM pages
), f AS (SELECT h, min(page_id) AS first_id FROM p WHERE n >= 100 GROUP BY h)
SELECT page_id, n AS payload_bytes, h AS payload_digest,
  CASE WHEN first_id < page_id OR page_id IS NULL AND first_id IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_id < page_id OR page_id IS NULL THEN first_id END AS refers_to
FROM p LEFT JOIN f USING (h)
"""

_SPANS = """
, first_in AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS f FROM win
), starts AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM first_in WHERE doc_id > f
), runs AS (
  SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run
  FROM starts
), spans AS (SELECT doc_id, run, min(i) AS a, max(i) + 49 AS b FROM runs GROUP BY ALL)
"""

ORACLES["op6_radix_dedup"] = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx FROM documents
), win AS (
  SELECT doc_id, i, substr(hx, 2 * i - 1, 100) AS s
  FROM (SELECT doc_id, hx, unnest(range(1, len(hx) // 2 - 48)) AS i FROM d WHERE len(hx) >= 100)
) {_SPANS}
, edges AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans
), cut AS (
  SELECT doc_id, count(*) AS n_spans, sum(b - a + 1)::BIGINT AS n_removed, max(b) AS last,
    string_agg(substr(hx, 2 * before + 1, 2 * (a - before - 1)), '' ORDER BY a) AS front
  FROM edges JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT d.doc_id, len(hx) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN last IS NULL THEN hx ELSE front || substr(hx, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""

ORACLES["op8_suffix_trees"] = rf"""
WITH d AS (SELECT doc_id, {WORDS.format("text")} AS ws FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(ws[i : i + 49], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM d WHERE len(ws) >= 50)
) {_SPANS}
, gone AS (SELECT doc_id, flatten(list(range(a, b + 1))) AS p, sum(b - a + 1)::BIGINT AS n FROM spans GROUP BY doc_id
), words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM d
), kept AS (
  SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.p) AS text FROM words w
  LEFT JOIN (SELECT doc_id, unnest(p) AS p FROM gone) g ON g.doc_id = w.doc_id AND g.p = w.p WHERE g.p IS NULL GROUP BY w.doc_id
)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

ORACLES["op9_mix_sources"] = rf"""
WITH d AS (
  SELECT doc_id, source, len({WORDS.format("text")}) AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || '/' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source
), w AS (SELECT *, CASE k % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight FROM s
), r AS (
  SELECT *, row_number() OVER o AS nr,
    1.5::DOUBLE * sum(size) OVER () - 2 * (sum(size) OVER o - size) AS rest, sum(weight) OVER () - (sum(weight) OVER o - weight) AS share
  FROM w WINDOW o AS (ORDER BY 2 * size / weight, k ROWS UNBOUNDED PRECEDING)
), b AS (SELECT rest, share, nr FROM r WHERE rest * weight < 2 * size * share ORDER BY nr LIMIT 1
), t AS (
  SELECT r.source, r.size, CASE WHEN b.nr IS NULL OR r.nr < b.nr THEN 2.0::DOUBLE * r.size ELSE b.rest * r.weight / b.share END AS target
  FROM r LEFT JOIN b ON true
), p AS (SELECT *, CASE WHEN size > 0 THEN floor(target / size) ELSE 0 END AS whole FROM t
), q AS (SELECT *, target - whole * size AS part FROM p
), c AS (
  SELECT source, h, sum(size) AS n, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS upto FROM d GROUP BY source, h
), e AS (
  SELECT q.source, min(CASE WHEN q.part <= 0 THEN 0 WHEN upto > part THEN h + (upto - part < part - (upto - n))::INT END) AS below
  FROM q JOIN c ON q.source IS NOT DISTINCT FROM c.source GROUP BY q.source
)
SELECT d.doc_id, d.size, q.size AS source_size, q.target,
  (d.size * (q.whole + CASE WHEN below IS NULL OR h < below THEN 1 ELSE 0 END))::BIGINT AS taken,
  (q.whole + CASE WHEN below IS NULL OR h < below THEN 1 ELSE 0 END)::INT AS copies
FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source JOIN e ON d.source IS NOT DISTINCT FROM e.source
"""


def _rounds(rounds: int) -> str:
    """Lloyd's rounds one after the other: r0 holds the first centroids, each next one the floored means."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""
, far{i} AS MATERIALIZED (
  SELECT vec_id, x, k, list_sum(list_transform(list_zip(x, m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS far FROM v, r{i}
), a{i} AS MATERIALIZED (
  SELECT vec_id, x, arg_min(k, (far, k)) AS k, min(far) AS far FROM far{i} GROUP BY vec_id, x
)""")
        if i < rounds:
            steps.append(f"""
, r{i + 1} AS MATERIALIZED (
  SELECT r.k, coalesce(new.m, r.m) AS m FROM r{i} r LEFT JOIN (
    SELECT k, list(mean ORDER BY d) AS m FROM (
      SELECT k, d, ((sum(c) - ((sum(c) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS mean
      FROM (SELECT k, unnest(x) AS c, generate_subscripts(x, 1) AS d FROM a{i}) GROUP BY k, d) GROUP BY k) new ON r.k = new.k
)""")
    return "".join(steps)


ORACLES["op11_centroids"] = f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), r0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id::VARCHAR)) - 1 AS k, x AS m FROM v
  QUALIFY row_number() OVER (ORDER BY sha256('2:' || vec_id::VARCHAR)) <= 40
) {_rounds(5)}
SELECT vec_id, a5.k::INT AS cluster, far AS distance, (sum(far) OVER (PARTITION BY a5.k))::BIGINT AS cluster_inertia,
  (sum(far) OVER ())::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a5 JOIN r5 ON a5.k = r5.k
"""

ORACLES["op12_exact_dedup"] = f"""
WITH d AS (SELECT doc_id, {LOWER.format("coalesce(text, '')")} AS t FROM documents
), g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
"""

ORACLES["op13_phrases"] = rf"""
WITH pieces AS (
  SELECT row_number() OVER () AS piece, lang, regexp_extract_all(t, '[^\x20\x09]+') AS ws FROM (
    SELECT coalesce(lang, 'und') AS lang,
      unnest(regexp_split_to_array({LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS t FROM documents)
), grams AS MATERIALIZED (
  SELECT lang, ws[i] AS w1, ws[i + 1] AS w2, ws[i + 2] AS w3 FROM (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM pieces)
), f1 AS MATERIALIZED (SELECT lang, w1, count(*) AS n FROM grams GROUP BY ALL
), f2 AS MATERIALIZED (SELECT lang, w1, w2, count(*) AS n FROM grams WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10
), f3 AS MATERIALIZED (SELECT lang, w1, w2, w3, count(*) AS n FROM grams WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10
), sizes AS (SELECT lang, sum(n)::BIGINT AS n FROM f1 GROUP BY lang
), t AS MATERIALIZED (
  SELECT f3.*, p.n AS n12, q.n AS n23 FROM f3
  JOIN f2 p ON p.lang = f3.lang AND p.w1 = f3.w1 AND p.w2 = f3.w2 JOIN f2 q ON q.lang = f3.lang AND q.w1 = f3.w2 AND q.w2 = f3.w3
), covered AS (
  SELECT lang, w1, w2 FROM t WHERE 100 * n >= 50 * n12 UNION SELECT lang, w2, w3 FROM t WHERE 100 * n >= 50 * n23
), cuts AS (
  SELECT p.lang, w1 || ' ' || w2 AS phrase, 1 AS k, p.n AS a, x.n AS l, y.n AS r
  FROM (SELECT * FROM f2 ANTI JOIN covered USING (lang, w1, w2)) p
    JOIN f1 x USING (lang, w1) JOIN f1 y ON y.lang = p.lang AND y.w1 = p.w2
  UNION ALL SELECT t.lang, t.w1 || ' ' || w2 || ' ' || w3, 1, t.n, x.n, n23 FROM t JOIN f1 x USING (lang, w1)
  UNION ALL SELECT t.lang, t.w1 || ' ' || w2 || ' ' || w3, 2, t.n, n12, y.n FROM t JOIN f1 y ON y.lang = t.lang AND y.w1 = t.w3
), best AS (
  SELECT *, (1000000::HUGEINT * a * a // (l::HUGEINT * r))::BIGINT AS score FROM cuts
  QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000
"""
