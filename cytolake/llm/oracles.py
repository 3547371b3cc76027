"""SQL for the queries that SQL can express, as DuckDB runs it."""

QUALITY = r"""
WITH t AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, lang, source, COALESCE(text, '') AS t FROM documents),
s AS MATERIALIZED (
  SELECT *, list_filter(regexp_split_to_array(t, '[\x09-\x0D\x20]+'), lambda x: x <> '') AS words,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x09-\x0D\x20]')) AS lines FROM t),
w AS MATERIALIZED (
  SELECT rid, p, words[p] || ' ' || words[p + 1] || ' ' || words[p + 2] AS w
  FROM (SELECT rid, words, unnest(generate_series(1, len(words) - 2)) AS p FROM s WHERE len(words) > 2)),
again AS (SELECT rid, p FROM (SELECT rid, p, COUNT(*) OVER (PARTITION BY rid, w) AS n FROM w) WHERE n > 1),
covered AS (
  SELECT rid, COUNT(DISTINCT q) AS n FROM (SELECT rid, p AS q FROM again UNION ALL SELECT rid, p + 1 FROM again UNION ALL SELECT rid, p + 2 FROM again)
  GROUP BY 1),
m AS MATERIALIZED (
  SELECT s.rid, doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(COALESCE(c.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS BIGINT) AS n_upper
  FROM s LEFT JOIN covered c ON c.rid = s.rid),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
b AS MATERIALIZED (
  SELECT *, ceil(ln(word_chars::DOUBLE / NULLIF(n_words, 0)) / g) AS b_w, ceil(ln((n_symbols + 1)::DOUBLE / (n_words + 1)) / g) AS b_s,
         ceil(ln((n_dup_lines + 1)::DOUBLE / (n_lines + 1)) / g) AS b_d, ceil(ln((n_repeat_words + 1)::DOUBLE / (n_words + 1)) / g) AS b_r,
         ceil(ln((n_upper + 1)::DOUBLE / (word_chars + 1)) / g) AS b_u FROM f, (SELECT ln(1.01::DOUBLE / 0.99::DOUBLE) AS g)),
sketch AS MATERIALIZED (
  SELECT lang, source, metric, b, COUNT(*) AS n FROM (
    SELECT lang, source, unnest(['w', 's', 'd', 'r', 'u']) AS metric, unnest([b_w, b_s, b_d, b_r, b_u]) AS b FROM b WHERE NOT base_failed) GROUP BY ALL),
levels AS (
  SELECT 2 AS lev, lang, source, metric, b, SUM(n) AS n FROM sketch GROUP BY ALL UNION ALL
  SELECT 1, lang, NULL, metric, b, SUM(n) FROM sketch GROUP BY ALL UNION ALL
  SELECT 0, NULL, NULL, metric, b, SUM(n) FROM sketch GROUP BY ALL),
upto AS (
  SELECT *, SUM(n) OVER (PARTITION BY lev, lang, source, metric ORDER BY b) AS upto, SUM(n) OVER (PARTITION BY lev, lang, source, metric) AS rows FROM levels),
q AS MATERIALIZED (
  SELECT lev, lang, source, metric, MIN(b) FILTER (upto > 0.25 * (rows - 1))::DOUBLE AS q1, MIN(b) FILTER (upto > 0.75 * (rows - 1))::DOUBLE AS q3,
         MAX(rows)::DOUBLE AS rows FROM upto GROUP BY 1, 2, 3, 4),
pick AS (
  SELECT a.lang, a.source, a.metric, (a.q1 * a.rows + (l.q1 * l.rows + g.q1 * 20) / (l.rows + 20) * 20) / (a.rows + 20) AS q1,
         (a.q3 * a.rows + (l.q3 * l.rows + g.q3 * 20) / (l.rows + 20) * 20) / (a.rows + 20) AS q3
  FROM q a JOIN q l ON l.lev = 1 AND l.lang IS NOT DISTINCT FROM a.lang AND l.metric = a.metric JOIN q g ON g.lev = 0 AND g.metric = a.metric WHERE a.lev = 2),
fence AS (SELECT lang, source, metric, round(q1 - 2.5 * (q3 - q1) - 1, 6) AS low, round(q3 + 2.5 * (q3 - q1) + 1, 6) AS high FROM pick),
lim AS MATERIALIZED (
  SELECT lang, source, MAX(low) FILTER (metric = 'w') AS low_w, MAX(high) FILTER (metric = 'w') AS high_w, MAX(high) FILTER (metric = 's') AS high_s,
         MAX(high) FILTER (metric = 'd') AS high_d, MAX(high) FILTER (metric = 'r') AS high_r, MAX(high) FILTER (metric = 'u') AS high_u FROM fence GROUP BY 1, 2),
judged AS (
  SELECT b.*, concat_ws(',', CASE WHEN b_w > high_w OR b_w < low_w THEN 'word_length' END, CASE WHEN b_s > high_s AND n_symbols > 0 THEN 'symbol_share' END,
         CASE WHEN b_d > high_d AND n_dup_lines > 0 THEN 'dup_line_share' END, CASE WHEN b_r > high_r AND n_repeat_words > 0 THEN 'repeat_share' END,
         CASE WHEN b_u > high_u AND n_upper > 0 THEN 'upper_share' END) AS why
  FROM b LEFT JOIN lim ON lim.lang IS NOT DISTINCT FROM b.lang AND lim.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND why = '' AS kept, why FROM judged
"""

EXACT = """
SELECT doc_id, MAX(doc_id) OVER (PARTITION BY n) AS keep_id, COUNT(*) OVER (PARTITION BY n) AS group_size,
       ROW_NUMBER() OVER (PARTITION BY n ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(n) AS text_sha256
FROM (SELECT doc_id, translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS n FROM documents)
"""


def vector_codes(rounds: int, parts: int = 16, entries: int = 64) -> str:
    """Lloyd rounds written out one after the other, every part compared with every entry of its codebook."""
    assigned = """d{k} AS (
  SELECT p.vec_id, p.part, b.entry, list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS dist
  FROM p JOIN b{k} b USING (part)),
a{k} AS MATERIALIZED (
  SELECT vec_id, part, entry, dist FROM d{k} QUALIFY ROW_NUMBER() OVER (PARTITION BY vec_id, part ORDER BY dist, entry) = 1)"""
    moved = """b{n} AS MATERIALIZED (
  SELECT part, entry, COALESCE(m.v, b.v) AS v FROM b{k} b LEFT JOIN (
    SELECT part, entry, list(s ORDER BY pos) AS v FROM (
      SELECT a.part, a.entry, u.pos, CAST(floor(SUM(p.v[u.pos]) / COUNT(*)) AS BIGINT) AS s
      FROM a{k} a JOIN p USING (vec_id, part), (SELECT unnest(generate_series(1, (SELECT MAX(len(v)) FROM p))) AS pos) u GROUP BY ALL) GROUP BY ALL) m USING (part, entry))"""
    steps = ",\n".join(x for k in range(rounds) for x in (assigned.format(k=k), moved.format(k=k, n=k + 1)))
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
p AS MATERIALIZED (
  SELECT vec_id, part, v[part * (len(v) // {parts}) + 1 : (part + 1) * (len(v) // {parts})] AS v
  FROM kept, (SELECT unnest(generate_series(0, {parts - 1})) AS part)),
b0 AS MATERIALIZED (
  SELECT part, entry, v FROM p JOIN (SELECT vec_id, ROW_NUMBER() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT {entries}) USING (vec_id)),
{steps},
{assigned.format(k=rounds)},
coded AS MATERIALIZED (
  SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(SUM(dist) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id),
book AS (
  SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS s FROM b{rounds})
SELECT vec_id, code, error, CAST(SUM(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, s AS codebooks_sha256
FROM coded JOIN kept USING (vec_id), book
"""


ORACLES = {"op4_quality_rules": QUALITY, "op11_vector_codes": vector_codes(2), "op13_exact_dedup": EXACT}
