"""DuckDB SQL of the registered queries, where SQL can express them."""

from __future__ import annotations

from slotcast.llm.rules import STOP_WORDS

WORD = r"'[^\x20\x09-\x0D]+'"

MIX_SQL = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, {WORD})), 0) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s),
r AS (SELECT *, CAST(2 * source_size AS DOUBLE) / weight AS ratio FROM w),
k AS (
  SELECT ratio,
    (CAST(1.5 AS DOUBLE) * CAST(sum(source_size) OVER () AS DOUBLE)
      - coalesce(CAST(sum(2 * source_size) OVER
          (ORDER BY ratio ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE), 0))
    / CAST(sum(weight) OVER (ORDER BY ratio ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE)
    AS level
  FROM r),
t AS (
  SELECT source, source_size,
    CASE WHEN lv.level IS NULL OR 2 * source_size <= weight * lv.level
      THEN CAST(2 * source_size AS DOUBLE) ELSE weight * lv.level END AS target
  FROM r LEFT JOIN (SELECT level FROM k WHERE ratio > level ORDER BY ratio LIMIT 1) lv ON true),
n AS (
  SELECT d.*, source_size, target,
    row_number() OVER (PARTITION BY d.source ORDER BY size DESC, doc_id NULLS LAST) AS i,
    CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
    CAST(CAST('0x' || substr(md5('mix:' || coalesce('=' || d.source, '')), 1, 8) AS BIGINT) AS DOUBLE)
      / 4294967296 AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
j AS (
  SELECT n.*, j, (u + CAST(j AS DOUBLE) / 32) - floor(u + CAST(j AS DOUBLE) / 32) AS v
  FROM n CROSS JOIN (SELECT unnest(range(32)) AS j)),
e AS (
  SELECT source, j, any_value(v) AS v, abs(any_value(target) - sum(
    (CAST(floor(i * rate + v) AS BIGINT) - CAST(floor((i - 1) * rate + v) AS BIGINT)) * size)) AS apart
  FROM j GROUP BY source, j),
b AS (SELECT source, v FROM e QUALIFY row_number() OVER (PARTITION BY source ORDER BY apart, j) = 1),
c AS (
  SELECT n.*, CAST(floor(i * rate + v) AS BIGINT) - CAST(floor((i - 1) * rate + v) AS BIGINT) AS copies
  FROM n JOIN b ON n.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM c
"""

_STOP = ", ".join(f"'{w}'" for group in STOP_WORDS for w in group.split())

RULES_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), {WORD}) AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, {WORD})) AS lines
  FROM documents),
g AS (
  SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
  FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM d)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1),
cov AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY r),
c AS (
  SELECT doc_id, len(words) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,
    len(lines) AS n_lines, len(list_filter(words, lambda w: lower(w) IN ({_STOP}))) AS n_stop,
    len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09]*[-*•]'))) AS n_bullets,
    len(regexp_extract_all(text, '\p{{Lu}}')) AS n_upper
  FROM d LEFT JOIN cov USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars / greatest(n_words, 1) BETWEEN 2 AND 25
    AND n_symbols / greatest(word_chars, 1) <= 0.1 AND n_dup_lines / greatest(n_lines, 1) <= 0.5
    AND n_stop / greatest(n_words, 1) >= 0.02 AND n_bullets / greatest(n_lines, 1) <= 0.9
    AND n_upper / greatest(word_chars, 1) <= 0.5 AS kept
FROM f
"""

_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
    "'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)

DECONTAMINATION_SQL = f"""
WITH b AS (SELECT item_id, {_WORDS} AS words FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(words), 10) AS n,
    array_to_string(list_slice(words, i, i + 9), ' ') AS wid
  FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 8, 2))) AS i FROM b WHERE len(words) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS words FROM documents),
g AS (
  SELECT r, i, n, array_to_string(list_slice(words, i, i + n - 1), ' ') AS wid
  FROM (SELECT r, words, n, unnest(range(1, len(words) - n + 2)) AS i
        FROM d CROSS JOIN (SELECT DISTINCT n FROM win))),
occ AS (SELECT r, i, g.n, item_id FROM g JOIN win ON g.wid = win.wid AND g.n = win.n),
w AS (
  SELECT r, count(DISTINCT p) AS n_hit
  FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM occ)) GROUP BY r),
it AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM occ) GROUP BY r)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN w USING (r) LEFT JOIN it USING (r)
"""

# The given pages hold no canonical links and no redirects, so here the method allows what no rule decides;
# aliases are tested against a plain version in the tests.
URL_SQL = r"""
WITH p AS (
  SELECT row_number() OVER () AS r, page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
rules(domain, prefix, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'),
    ('org', '/fr/', 'allow')),
f AS (
  SELECT r, domain || prefix AS rule, verdict FROM p JOIN rules
    ON (host = domain OR ends_with(host, '.' || domain)) AND starts_with(path, prefix)
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY length(domain || prefix) DESC, verdict) = 1)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN f USING (r)
"""

# The template adds 6, 7 and 4 characters to a turn, and an escape for each control string and backslash.
CHAT_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(17 + length(role) + length(text)
    + len(regexp_extract_all(role || ' ' || text, '\\|\[INST\]|\[/INST\]|</s>'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""

WARC_SQL = """
WITH p AS (
  SELECT row_number() OVER () AS r, page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d
  FROM pages),
f AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY page_id NULLS LAST, r) AS i,
    first_value(page_id) OVER (PARTITION BY d ORDER BY page_id NULLS LAST, r) AS low FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 100 AND i > 1 THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND i > 1 THEN low END AS refers_to
FROM f
"""


def centroid_sql(k: int = 40, rounds: int = 5, width: int = 64) -> str:
    """Assignment and update written out for every round, by a full search."""
    each = range(1, width + 1)
    steps = [
        f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: isfinite(x))) = {width})""",
        f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), vec_id, v) - 1 AS c, v AS m
  FROM v QUALIFY c < {k})""",
    ]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
  SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
    SELECT r, c, {' + '.join(f'(v[{j}] - m[{j}]) * (v[{j}] - m[{j}])' for j in each)} AS d FROM v, c{i})
  GROUP BY r)""")
        if i < rounds:
            mean = ", ".join(f"(sum(v[{j}]) - ((sum(v[{j}]) % count(*)) + count(*)) % count(*)) // count(*)" for j in each)
            steps.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT c{i}.c, coalesce(n.m, c{i}.m) AS m FROM c{i} LEFT JOIN (
    SELECT a{i}.c, list_transform([{mean}], lambda x: CAST(x AS BIGINT)) AS m FROM a{i} JOIN v USING (r) GROUP BY a{i}.c) n
  ON n.c = c{i}.c)""")
    return f"""WITH {', '.join(steps)}
SELECT vec_id, CAST(a{rounds}.c AS INTEGER) AS cluster, d AS distance,
  CAST(sum(d) OVER (PARTITION BY a{rounds}.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (r) JOIN c{rounds} ON c{rounds}.c = a{rounds}.c
"""


INFILL_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
    sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
h AS (
  SELECT *, [CAST('0x' || substr(h, 1, 8) AS BIGINT), CAST('0x' || substr(h, 9, 8) AS BIGINT),
    CAST('0x' || substr(h, 17, 8) AS BIGINT), CAST('0x' || substr(h, 25, 8) AS BIGINT)] AS u FROM d),
f AS (
  SELECT doc_id, t, n, least(u[1] % (n + 1), u[2] % (n + 1)) AS a, greatest(u[1] % (n + 1), u[2] % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR u[3] % 100 >= 90 THEN 'plain'
      WHEN u[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM h),
o AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM o
"""

ORACLES: dict[str, str] = {
    "op1_mix_sources": MIX_SQL,
    "op2_url_filter": URL_SQL,
    "op6_decontamination": DECONTAMINATION_SQL,
    "op7_chat_format": CHAT_SQL,
    "op10_quality_rules": RULES_SQL,
    "op11_warc": WARC_SQL,
    "op12_centroids": centroid_sql(),
    "op13_infill": INFILL_SQL,
}
