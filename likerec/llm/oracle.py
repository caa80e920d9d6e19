"""Check SQL of the queries that SQL can express."""

from __future__ import annotations

# Upper case A-Z and its lower case, for translate().
AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

LINES = f"""lines AS (
  SELECT doc_id, unnest(range(1, len(parts) + 1)) AS i, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)),
keyed AS (SELECT doc_id, i, line, translate(trim(line, {BLANK}), {AZ}) AS key FROM lines)"""

OP2 = f"""WITH {LINES},
frequent AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE f.key IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM keyed k LEFT JOIN frequent f ON f.key = k.key GROUP BY doc_id"""

OP3 = """WITH sizes AS (
  SELECT source, sum(strlen(coalesce(text, '')) + 1)::DOUBLE AS n_bytes FROM documents GROUP BY source),
rates AS (
  SELECT source, (SELECT sum(n_bytes) FROM sizes) * (sqrt(n_bytes) / (SELECT sum(sqrt(n_bytes)) FROM sizes)) / n_bytes AS rate
  FROM sizes),
pieces AS (
  SELECT source, unnest(range(1, ceil(rate / 32)::BIGINT + 1)) AS piece, rate / ceil(rate / 32) AS mean FROM rates),
terms AS (
  SELECT source, piece, k, exp(-mean + k * ln(mean) - lgamma(k + 1)) AS term FROM pieces, range(0, 101) t(k)),
cdf AS (
  SELECT source, piece, sum(term) OVER (PARTITION BY source, piece ORDER BY k) AS p FROM terms),
draws AS (
  SELECT d.doc_id, p.source, p.piece,
         (('0x' || substr(md5(concat_ws('|', '20', p.piece::VARCHAR, coalesce(d.doc_id::VARCHAR, 'null'))), 1, 13))::BIGINT + 0.5)
         / 4503599627370496.0 AS u
  FROM documents d JOIN pieces p ON p.source IS NOT DISTINCT FROM d.source),
counts AS (
  SELECT doc_id, sum((SELECT count(*) FROM cdf c WHERE c.source IS NOT DISTINCT FROM r.source AND c.piece = r.piece AND c.p < r.u)) AS n
  FROM draws r GROUP BY doc_id),
copies AS (SELECT doc_id, unnest(range(1, n::BIGINT + 1))::INTEGER AS copy FROM counts WHERE n > 0)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, c.copy,
       ('0x' || substr(md5(concat_ws('|', 'order', '20', c.copy::VARCHAR, coalesce(d.doc_id::VARCHAR, 'null'))), 1, 15))::BIGINT AS shuffle_key
FROM documents d JOIN copies c ON c.doc_id = d.doc_id"""


OP6 = """WITH RECURSIVE usable AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM least LEFT JOIN counts USING (vec_id)"""

# The prior's weight of one rule, from the hosts' counts.
PRIOR = """SELECT sum({f}) / sum(n) AS p, CASE
    WHEN sum({f}) = 0 OR sum({f}) = sum(n) OR count(*) < 2
      OR sum(n) - sum(n * n) / sum(n) - (count(*) - 1) <= 0 THEN 10000
    WHEN ((sum({f} * {f} / n) - sum({f}) * sum({f}) / sum(n)) / (sum({f}) / sum(n) * (1 - sum({f}) / sum(n))) - (count(*) - 1)) <= 0 THEN 10000
    ELSE least(10000, greatest(1, (sum(n) - sum(n * n) / sum(n) - (count(*) - 1))
      / ((sum({f} * {f} / n) - sum({f}) * sum({f}) / sum(n)) / (sum({f}) / sum(n) * (1 - sum({f}) / sum(n))) - (count(*) - 1)) - 1)) END AS m
  FROM hosts"""

PRIORS = ",\n".join(f"prior{k} AS ({PRIOR.format(f=f'f{k}')})" for k in range(1, 6))
# Shrunk rates over their limits: four standard deviations of the prior over its mean, within 0.1 and 0.5.
VERDICT = " OR ".join(
    f"(f{k} + prior{k}.p * prior{k}.m) / (n + prior{k}.m) > "
    f"least(0.5, greatest(0.1, prior{k}.p + 4 * sqrt(prior{k}.p * (1 - prior{k}.p) / (prior{k}.m + 1))))" for k in range(1, 6))

OP7 = f"""WITH texts AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(list_slice(words, i, i + 4), ' ') AS w
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM texts)),
repeated AS (
  SELECT doc_id, count(DISTINCT place) AS n FROM (
    SELECT doc_id, unnest(range(i, i + 5)) AS place FROM (
      SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS times FROM windows) WHERE times > 1)
  GROUP BY doc_id),
split AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM texts),
dup AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM split WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
measured AS (
  SELECT doc_id, source, len(words) AS n_words,
         CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(d.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
  FROM texts LEFT JOIN dup d USING (doc_id) LEFT JOIN repeated r USING (doc_id)),
judged AS (
  SELECT *, n_words < 10 AS too_short, 100 * n_repeat_words > 20 * n_words AS too_repetitive, 100 * n_symbols > 10 * word_chars AS symbol_heavy,
         20 * n_dup_lines > n_words AS repeats_lines, word_chars > 10 * n_words AS long_words FROM measured),
hosts AS (
  SELECT source, count(*)::DOUBLE AS n, (count(*) FILTER (WHERE too_short))::DOUBLE AS f1,
         (count(*) FILTER (WHERE too_repetitive))::DOUBLE AS f2, (count(*) FILTER (WHERE symbol_heavy))::DOUBLE AS f3,
         (count(*) FILTER (WHERE repeats_lines))::DOUBLE AS f4, (count(*) FILTER (WHERE long_words))::DOUBLE AS f5 FROM judged GROUP BY source),
{PRIORS},
verdicts AS (
  SELECT source, {VERDICT} AS host_failed
  FROM hosts, prior1, prior2, prior3, prior4, prior5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, too_short OR too_repetitive AS base_failed,
       NOT (too_short OR too_repetitive) AND NOT host_failed AS kept
FROM judged j JOIN verdicts v ON v.source IS NOT DISTINCT FROM j.source"""


OP11 = """WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
firsts AS (SELECT text, min(doc_id) AS least FROM texts GROUP BY text),
marks AS (SELECT doc_id, max((quality = 1)::INTEGER) AS good, max((toxic = 1)::INTEGER) AS toxic FROM labels GROUP BY doc_id),
failed AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, [
    len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words),
    100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text),
    regexp_matches(text, '[#$%&*|]'), doc_id > least] AS f
  FROM texts JOIN firsts USING (text) LEFT JOIN marks USING (doc_id)),
cells AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY part, f),
letters AS (SELECT unnest([1, 2, 3, 4, 5]) AS k),
orders AS (
  SELECT [a.k, b.k, c.k, d.k, e.k] AS o
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
steps AS (SELECT o, unnest([1, 2, 3, 4, 5]) AS step FROM orders),
met AS (
  SELECT part, o, step, n, good, toxic, f[o[step]] AS fails,
         len(list_filter(o[1:step - 1], lambda k: f[k])) > 0 AS gone, len(list_filter(f, lambda x: x)) AS n_failed
  FROM cells, steps),
counted AS (
  SELECT part, o, step, o[step] AS k,
         coalesce(sum(n) FILTER (WHERE NOT gone AND NOT fails), 0) AS kept, coalesce(sum(n) FILTER (WHERE NOT gone AND fails), 0) AS removed,
         coalesce(sum(n) FILTER (WHERE gone AND fails), 0) AS redundant, coalesce(sum(n) FILTER (WHERE fails AND n_failed = 1), 0) AS unique_fails,
         coalesce(sum(good) FILTER (WHERE NOT gone AND fails), 0) AS good_lost, coalesce(sum(toxic) FILTER (WHERE NOT gone AND fails), 0) AS toxic_lost
  FROM met GROUP BY part, o, step)
SELECT part, array_to_string(list_transform(o, lambda k: substr('ABCDE', k, 1)), '') AS filter_order, step, kept::BIGINT AS kept,
       removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
       toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, k))::BIGINT AS shapley
FROM counted"""


def _op12() -> str:
    """Ten rounds of plain assignment and exact integer means."""
    distance = "list_sum(list_transform(list_zip(p, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    steps = ["""points AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS p FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""", """c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id::VARCHAR)) - 1 AS k, p AS c FROM points
  QUALIFY row_number() OVER (ORDER BY sha256('3:' || vec_id::VARCHAR)) <= 8)"""]
    for i in range(11):
        steps.append(f"""a{i} AS MATERIALIZED (
  SELECT r, vec_id, p, k, {distance} AS distance FROM points, c{i}
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY {distance}, k) = 1)""")
        steps.append(f"""c{i + 1} AS MATERIALIZED (
  WITH sums AS (
    SELECT k, i, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n
    FROM (SELECT k, unnest(p) AS x, unnest(range(1, 65)) AS i FROM a{i}) GROUP BY k, i),
  means AS (SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS c FROM sums GROUP BY k)
  SELECT o.k, coalesce(m.c, o.c) AS c FROM c{i} o LEFT JOIN means m USING (k))""")
    return "WITH " + ",\n".join(steps[:-1]) + """
SELECT vec_id, k::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY k))::BIGINT AS cluster_inertia,
       (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a10 JOIN c10 USING (k)"""


WORDS13 = f"regexp_extract_all(translate(coalesce(text, ''), {AZ}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP13 = f"""WITH docs AS (SELECT doc_id, {WORDS13} AS words FROM documents),
items AS (SELECT item_id, {WORDS13} AS words FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(words), 10) AS m, array_to_string(list_slice(words, i, i + least(len(words), 10) - 1), ' ') AS w
  FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 8, 2))) AS i FROM items WHERE len(words) > 0)),
lengths AS (SELECT DISTINCT m FROM windows),
own AS (
  SELECT doc_id, m, i, array_to_string(list_slice(words, i, i + m - 1), ' ') AS w
  FROM (SELECT doc_id, words, m, unnest(range(1, len(words) - m + 2)) AS i FROM docs, lengths WHERE len(words) >= m)),
matched AS (SELECT doc_id, o.m, i, item_id FROM own o JOIN windows b ON o.m = b.m AND o.w = b.w),
places AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM matched) GROUP BY doc_id),
lists AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM matched) GROUP BY doc_id)
SELECT doc_id, len(words) AS n_words, coalesce(p.n, 0) AS n_hit, coalesce(l.n, 0) AS n_items,
       sha256(coalesce(l.items, '')) AS items_sha256, p.n IS NOT NULL AS contaminated
FROM docs LEFT JOIN places p USING (doc_id) LEFT JOIN lists l USING (doc_id)"""


def build() -> dict[str, str]:
    return {"op2_line_dedup": OP2, "op3_mixing": OP3, "op6_embedding_dedup": OP6, "op7_quality_rules": OP7, "op11_filter_audit": OP11,
            "op12_centroid_clusters": _op12(), "op13_decontamination": OP13}
