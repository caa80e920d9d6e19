"""Shared pieces of the check SQL (DuckDB)."""

USERS = """fx_users AS (
  SELECT c_custkey AS id, c_name AS user_id, c_name AS name, CAST(NULL AS VARCHAR) AS email,
         TIMESTAMP '2024-01-01 00:00:00' AS created_at, TIMESTAMP '2024-01-01 00:00:00' AS updated_at
  FROM customer
  UNION ALL
  SELECT -s_suppkey - 1, s_name, s_name, CAST(NULL AS VARCHAR),
         TIMESTAMP '2024-01-01 00:00:00', TIMESTAMP '2024-01-01 00:00:00'
  FROM supplier)"""

SONGS = """fx_songs AS (
  SELECT p_partkey AS id, concat('v', CAST(p_partkey AS VARCHAR)) AS video_id, p_name AS title, p_brand AS artist,
         CASE WHEN p_size > 10 THEN p_type END AS genre,
         CASE WHEN p_size <= 33 THEN concat('size', CAST(p_size AS VARCHAR), ', ', lower(p_type)) END AS tags,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(p_partkey % 700 AS INTEGER)) AS updated_at
  FROM part),
fx_catalog AS (
  SELECT id, video_id, title, artist FROM fx_songs
  UNION ALL SELECT -s_suppkey - 1, concat('x', CAST(s_suppkey AS VARCHAR)), s_name,
                   concat('nation', CAST(s_nationkey AS VARCHAR)) FROM supplier)"""

LIKES = """fx_likes AS (
  SELECT o_custkey AS user_id, l_partkey AS song_id, min(o_orderdate) AS created_at
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  GROUP BY o_custkey, l_partkey)"""

REQUESTS = """fx_items AS (
  SELECT event_id AS request_id, ts, user_id AS uid, event_type AS kind, p_type, p_name, s_name,
         concat(p_name, ' - ', p_brand) AS full_name, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k
  FROM events JOIN part ON p_partkey = event_id * 7919 % (SELECT count(*) FROM part)
  JOIN supplier ON s_suppkey = event_id % (SELECT count(*) FROM supplier)),
fx_requests AS (
  SELECT request_id, ts,
         CASE kind WHEN 'signup' THEN concat('Guest#', CAST(uid AS VARCHAR))
                   WHEN 'error' THEN repeat(concat('Visitor#', CAST(uid AS VARCHAR), ' '), k)
                   ELSE concat('Customer#', lpad(CAST(uid AS VARCHAR), 9, '0')) END AS user_id,
         CASE kind WHEN 'view' THEN [concat('  ', upper(full_name), '!'), full_name]
                   WHEN 'click' THEN [p_name, full_name]
                   WHEN 'signup' THEN [full_name, 'No Such Song', s_name]
                   WHEN 'error' THEN ['???', '']
                   ELSE list_transform(range(k), lambda i: full_name) END AS songs,
         CASE kind WHEN 'click' THEN lower(p_type) WHEN 'signup' THEN NULL
                   WHEN 'purchase' THEN repeat(p_type, k) ELSE p_type END AS genre
  FROM fx_items)"""


def with_ctes(*parts: str, final: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + final
