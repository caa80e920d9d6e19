"""Check SQL for the registered queries.

The statements say what is wanted in the plainest way; the content-based ones fit every user's
corpus directly and do not use the formula of the Spark plan.
"""

from __future__ import annotations

from checks.oracle_base import LIKES, REQUESTS, SONGS, USERS, with_ctes
from likerec.functions.text import default_stop_words

WORDS = r"\p{L}\p{N}_"
BLANKS = r"\t-\r\x{1c}-\x{1f} \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


STOP = ", ".join(f"'{w}'" for w in default_stop_words())

SIMILAR = """alike AS (
  SELECT a.user_id, b.user_id AS similar_user_id, count(*) AS n_common
  FROM fx_likes a JOIN fx_likes b ON a.song_id = b.song_id AND a.user_id <> b.user_id
  GROUP BY a.user_id, b.user_id HAVING count(*) >= 2)"""

COLLABORATIVE = """co_counts AS (
  SELECT s.user_id, l.song_id, count(*) AS n_users
  FROM alike s JOIN fx_likes l ON l.user_id = s.similar_user_id
  WHERE NOT EXISTS (SELECT 1 FROM fx_likes o WHERE o.user_id = s.user_id AND o.song_id = l.song_id)
  GROUP BY s.user_id, l.song_id),
co_top AS (
  SELECT user_id, song_id, n_users, row_number() OVER (PARTITION BY user_id ORDER BY n_users DESC, song_id) AS rank
  FROM co_counts),
collaborative AS (
  SELECT user_id, rank, song_id, video_id, title, artist, n_users
  FROM co_top JOIN fx_songs ON id = song_id)"""

LINES = """fx_lines AS (
  SELECT o_custkey AS user_id, l_partkey AS song_id, o_orderdate AS created_at
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

# What is stored before a batch of requests.
STORED = """st_songs AS (SELECT * FROM fx_songs),
st_likes AS (SELECT * FROM fx_likes)"""


def normalized(text: str) -> str:
    kept = f"lower(regexp_replace({text}, '[^{WORDS}{BLANKS}\\-'']', '', 'g'))"
    trimmed = f"regexp_replace(regexp_replace({kept}, '^[{BLANKS}]+', ''), '[{BLANKS}]+$', '')"
    return f"nullif(substring({trimmed}, 1, 200), '')"


CHECKED = """checked AS (
  SELECT *, CASE WHEN length(user_id) < {low} THEN 'user_id too short' WHEN length(user_id) > 255 THEN 'user_id too long'
    WHEN len(songs) < 1 THEN 'no songs' WHEN len(songs) > 50 THEN 'too many songs'
    WHEN length(genre) > 128 THEN 'genre too long' END AS reason
  FROM fx_requests)"""

ITEMS = CHECKED.format(low=0) + f""",
accepted AS (SELECT * FROM checked WHERE reason IS NULL),
exploded AS (SELECT request_id, ts, user_id, genre, generate_subscripts(songs, 1) - 1 AS position, unnest(songs) AS song_name
             FROM accepted),
items AS (SELECT *, {normalized('song_name')} AS query FROM exploded)"""

RESOLVED = f"""forms AS (
  SELECT 1 AS tier, id, {normalized("concat(title, ' - ', artist)")} AS query FROM fx_catalog
  UNION ALL SELECT 2, id, {normalized('title')} FROM fx_catalog),
best AS (SELECT query, id FROM (
  SELECT *, row_number() OVER (PARTITION BY query ORDER BY tier, id) AS n FROM forms) WHERE n = 1),
resolved AS (
  SELECT i.request_id, i.position, i.ts, i.user_id, i.query, s.video_id, s.title, s.artist
  FROM items i LEFT JOIN best b ON b.query = i.query LEFT JOIN fx_catalog s ON s.id = b.id)"""

# What a batch of requests adds to the tables.
ADDED = """new_users AS (
  SELECT row_number() OVER (ORDER BY user_id) + (SELECT max(id) FROM fx_users) AS id, user_id,
         CAST(NULL AS VARCHAR) AS name, CAST(NULL AS VARCHAR) AS email,
         TIMESTAMP '2024-02-01 00:00:00' AS created_at, TIMESTAMP '2024-02-01 00:00:00' AS updated_at
  FROM (SELECT DISTINCT user_id FROM accepted WHERE user_id NOT IN (SELECT user_id FROM fx_users))),
new_songs AS (
  SELECT row_number() OVER (ORDER BY video_id) + (SELECT max(id) FROM st_songs) AS id, video_id, title, artist,
         CAST(NULL AS VARCHAR) AS genre, CAST(NULL AS VARCHAR) AS tags, TIMESTAMP '2024-02-01 00:00:00' AS updated_at
  FROM (SELECT DISTINCT video_id, title, artist FROM resolved
        WHERE video_id IS NOT NULL AND video_id NOT IN (SELECT video_id FROM st_songs))),
all_users AS (SELECT * FROM fx_users UNION ALL SELECT * FROM new_users),
all_songs AS (SELECT * FROM st_songs UNION ALL SELECT * FROM new_songs),
new_likes AS (
  SELECT p.user_id, p.song_id, min(p.ts) AS first_ts FROM (
    SELECT u.id AS user_id, s.id AS song_id, r.ts FROM resolved r
    JOIN all_users u ON u.user_id = r.user_id JOIN all_songs s ON s.video_id = r.video_id) p
  WHERE NOT EXISTS (SELECT 1 FROM st_likes l WHERE l.user_id = p.user_id AND l.song_id = p.song_id)
  GROUP BY p.user_id, p.song_id)"""

SNAPSHOT = """request_ids AS (
  SELECT a.request_id, a.ts, a.user_id,
         list_sort(list(DISTINCT s.id) FILTER (WHERE s.id IS NOT NULL)) AS song_ids
  FROM accepted a LEFT JOIN resolved r ON r.request_id = a.request_id AND r.video_id IS NOT NULL
  LEFT JOIN all_songs s ON s.video_id = r.video_id GROUP BY a.request_id, a.ts, a.user_id),
snapshot AS (
  SELECT user_id, coalesce(song_ids, CAST([] AS BIGINT[])) AS song_ids, ts FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, request_id DESC) AS n
    FROM request_ids WHERE ts <= TIMESTAMP '2024-01-30 12:00:00') WHERE n = 1
    AND ts + INTERVAL 12 HOUR > TIMESTAMP '2024-01-30 12:00:00')"""


def documents(songs: str, mode: str = "as_coded") -> str:
    if mode == "as_coded":
        artist, genre = "repeat(coalesce(artist, ''), 2)", "repeat(coalesce(genre, ''), 3)"
    else:
        artist = "concat(coalesce(artist, ''), ' ', coalesce(artist, ''))"
        genre = "concat(coalesce(genre, ''), ' ', coalesce(genre, ''), ' ', coalesce(genre, ''))"
    return f"""docs AS (
  SELECT id AS doc_id, concat(coalesce(title, ''), ' ', {artist}, ' ', {genre}, ' ', coalesce(tags, '')) AS text
  FROM {songs})"""


TOKENS = f"""tok AS (
  SELECT doc_id, term FROM (
    SELECT doc_id, unnest(regexp_extract_all(lower(text), '[{WORDS}]{{2,}}')) AS term FROM docs)
  WHERE term NOT IN ({STOP})),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY doc_id, term)"""

WEIGHTS = """idf AS (
  SELECT term, count(*) AS df, ln((1.0 + (SELECT count(*) FROM docs)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY term),
raw AS (SELECT doc_id, term, tf * idf AS w FROM tf JOIN idf USING (term)),
norms AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM raw GROUP BY doc_id),
vectors AS (SELECT doc_id, term, w / norm AS weight FROM raw JOIN norms USING (doc_id))"""

PROFILES = """sizes AS (SELECT user_id, count(*) AS h FROM fx_likes GROUP BY user_id),
profiles AS (
  SELECT l.user_id, v.term, sum(v.weight) / any_value(s.h) AS weight
  FROM fx_likes l JOIN sizes s USING (user_id) JOIN vectors v ON v.doc_id = l.song_id GROUP BY l.user_id, v.term)"""

RANKING = """cells AS (
  SELECT h.user_id, p.doc_id AS song_id, coalesce(c.score, 0) AS score
  FROM sizes h CROSS JOIN pool p LEFT JOIN scored c ON c.user_id = h.user_id AND c.song_id = p.doc_id),
ranked AS (
  SELECT c.user_id, c.song_id, c.score,
         row_number() OVER (PARTITION BY c.user_id ORDER BY floor(c.score * 1e9 + 0.5) DESC, c.score > 0 DESC, c.song_id) AS rank
  FROM cells c WHERE NOT EXISTS (
    SELECT 1 FROM {likes} l WHERE l.user_id = c.user_id AND l.song_id = c.song_id)),
content AS (
  SELECT r.user_id, r.rank, r.song_id, s.video_id, s.title, s.artist, r.score
  FROM ranked r JOIN {songs} s ON s.id = r.song_id)"""


def content(songs: str = "fx_songs", likes: str = "fx_likes", mode: str = "as_coded") -> str:
    """Every user's corpus, the own songs and the 1000 candidates, vectorized directly."""
    return f"""{documents(songs, mode)},
{TOKENS},
pool AS (SELECT id AS doc_id FROM {songs} ORDER BY updated_at DESC, id LIMIT 1000),
sizes AS (SELECT user_id, count(*) AS h FROM {likes} GROUP BY user_id),
pool_tf AS (SELECT * FROM tf WHERE doc_id IN (SELECT doc_id FROM pool)),
pool_df AS (SELECT term, count(*) AS df FROM pool_tf GROUP BY term),
own_tf AS (SELECT l.user_id, t.doc_id, t.term, t.tf FROM {likes} l JOIN tf t ON t.doc_id = l.song_id),
own_df AS (SELECT user_id, term, count(*) AS df FROM own_tf GROUP BY user_id, term),
vocabulary AS (
  SELECT user_id, term, sum(df) AS df FROM (
    SELECT s.user_id, p.term, p.df FROM sizes s CROSS JOIN pool_df p
    UNION ALL SELECT user_id, term, df FROM own_df) GROUP BY user_id, term),
weights AS (
  SELECT v.user_id, v.term, ln((1.0 + s.h + (SELECT count(*) FROM pool)) / (1 + v.df)) + 1 AS idf
  FROM vocabulary v JOIN sizes s USING (user_id)),
own_raw AS (SELECT o.user_id, o.doc_id, o.term, o.tf * w.idf AS w FROM own_tf o JOIN weights w USING (user_id, term)),
own_norm AS (SELECT user_id, doc_id, sqrt(sum(w * w)) AS norm FROM own_raw GROUP BY user_id, doc_id),
mean AS (
  SELECT r.user_id, r.term, sum(r.w / n.norm) / any_value(s.h) AS p
  FROM own_raw r JOIN own_norm n USING (user_id, doc_id) JOIN sizes s USING (user_id) GROUP BY r.user_id, r.term),
mean_norm AS (SELECT user_id, sqrt(sum(p * p)) AS norm FROM mean GROUP BY user_id),
pool_raw AS (SELECT w.user_id, t.doc_id AS song_id, w.term, t.tf * w.idf AS w FROM weights w JOIN pool_tf t USING (term)),
pool_norm AS (SELECT user_id, song_id, sqrt(sum(w * w)) AS norm FROM pool_raw GROUP BY user_id, song_id),
products AS (
  SELECT r.user_id, r.song_id, sum(r.w * m.p) AS dot FROM pool_raw r JOIN mean m USING (user_id, term)
  GROUP BY r.user_id, r.song_id),
scored AS (
  SELECT d.user_id, d.song_id, d.dot / (n.norm * m.norm) AS score
  FROM products d JOIN pool_norm n USING (user_id, song_id) JOIN mean_norm m USING (user_id)),
{RANKING.format(songs=songs, likes=likes)}"""


SHARED = f"""{documents('fx_songs')},
{TOKENS},
pool AS (SELECT id AS doc_id FROM fx_songs ORDER BY updated_at DESC, id LIMIT 1000),
idf AS (
  SELECT term, ln((1.0 + (SELECT count(*) FROM pool)) / (1 + count(*))) + 1 AS idf
  FROM tf WHERE doc_id IN (SELECT doc_id FROM pool) GROUP BY term),
raw AS (SELECT doc_id, term, tf * idf AS w FROM tf JOIN idf USING (term)),
norms AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM raw GROUP BY doc_id),
vectors AS (SELECT doc_id, term, w / norm AS weight FROM raw JOIN norms USING (doc_id)),
{PROFILES},
mean_norm AS (SELECT user_id, sqrt(sum(weight * weight)) AS norm FROM profiles GROUP BY user_id),
scored AS (
  SELECT p.user_id, v.doc_id AS song_id, sum(p.weight * v.weight / m.norm) AS score
  FROM profiles p JOIN mean_norm m USING (user_id) JOIN vectors v USING (term)
  WHERE v.doc_id IN (SELECT doc_id FROM pool) GROUP BY p.user_id, v.doc_id),
{RANKING.format(songs='fx_songs', likes='fx_likes')}"""

CONTENT_ROWS = "SELECT user_id, rank, song_id, video_id, title, artist, round(score, 6) AS score FROM content WHERE rank <= 10"


def popular(songs: str = "fx_songs", likes: str = "fx_likes", k: int = 10) -> str:
    return f"""rated AS (
  SELECT lower(s.genre) AS genre_key, s.id AS song_id, s.video_id, s.title, s.artist, count(*) AS n_likes
  FROM {likes} l JOIN {songs} s ON s.id = l.song_id GROUP BY ALL),
popular AS (
  SELECT genre_key, false AS is_global, row_number() OVER (PARTITION BY genre_key ORDER BY n_likes DESC, song_id) AS rank,
         song_id, video_id, title, artist, n_likes, 1.0 AS score
  FROM rated WHERE genre_key IS NOT NULL QUALIFY rank <= {k}
  UNION ALL
  SELECT NULL, true, row_number() OVER (ORDER BY n_likes DESC, song_id) AS rank,
         song_id, video_id, title, artist, n_likes, 1.0
  FROM rated QUALIFY rank <= {k})"""


LATEST = """latest AS (
  SELECT user_id, lower(genre) AS genre_key FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, request_id DESC) AS n FROM {source}) WHERE n = 1)"""

PICKED = """picked AS (
  SELECT r.user_id, p.rank, p.song_id, p.video_id, p.title, p.artist, p.score
  FROM latest r JOIN popular p ON CASE
    WHEN r.genre_key IN (SELECT genre_key FROM popular WHERE NOT is_global) THEN p.genre_key = r.genre_key
    ELSE p.is_global END)"""


# Result types that DuckDB would choose otherwise.
TYPES = {"rank": "INTEGER", "position": "INTEGER", "score": "DOUBLE"}
TYPED = {
    "rank_unliked": ("rank",), "collaborative_suggestions": ("rank",), "collaborative_suggestions_spread": ("rank",),
    "collaborative_suggestions_refreshed": ("rank",),
    "content_suggestions": ("rank",), "content_suggestions_spread": ("rank",),
    "content_suggestions_bounded": ("rank",), "content_suggestions_of_all_songs": ("rank",),
    "content_suggestions_weighted": ("rank",), "content_suggestions_shared_corpus": ("rank",),
    "popular_by_genre": ("rank", "score"), "popular_for_requests": ("rank", "score"),
    "collaborative_or_popular": ("rank", "score"), "suggest": ("rank", "score"), "suggest_combined": ("rank", "score"),
    "suggest_fused": ("rank", "score"),
    "process_requests_suggestions": ("rank", "score"), "commit_requests_suggestions": ("rank", "score"), "search_responses_first": ("position",),
    "search_responses_all": ("position", "score"), "explode_requests": ("position",), "resolve_songs": ("position",), "resolve_misspelled_songs": ("position",),
    "reusable_searches": ("position",), "stream_reusable_searches": ("position",),
}


def with_types(text: str, columns: tuple[str, ...]) -> str:
    casts = ", ".join(f"CAST({c} AS {TYPES[c]}) AS {c}" for c in columns)
    return f"SELECT * REPLACE ({casts}) FROM ({text})" if columns else text


def build() -> dict[str, str]:
    sql = {}
    sql["scan_users"] = with_ctes(USERS, final="SELECT * FROM fx_users")
    sql["scan_songs"] = with_ctes(SONGS, final="SELECT * FROM fx_songs")
    sql["scan_likes"] = with_ctes(LIKES, final="SELECT * FROM fx_likes")
    sql["scan_requests"] = with_ctes(REQUESTS, final="SELECT * FROM fx_requests")
    sql["table_append_and_read"] = sql["scan_likes"]
    sql["find_users"] = with_ctes(USERS, REQUESTS, final="""
        SELECT * FROM fx_users WHERE user_id IN (SELECT user_id FROM fx_requests)""")
    liked = """SELECT u.user_id, l.song_id, s.video_id, s.title, s.artist, l.created_at
        FROM fx_users u JOIN fx_likes l ON l.user_id = u.id JOIN fx_songs s ON s.id = l.song_id"""
    sql["liked_songs"] = with_ctes(USERS, SONGS, LIKES, final=liked)
    sql["liked_songs_of_requesters"] = with_ctes(USERS, SONGS, LIKES, REQUESTS, final=liked + """
        WHERE u.user_id IN (SELECT user_id FROM fx_requests)""")
    sql["user_history"] = with_ctes(USERS, SONGS, LIKES, final="""
        SELECT u.user_id, l.song_id, s.video_id, s.title, s.artist, s.genre, s.tags
        FROM fx_users u JOIN fx_likes l ON l.user_id = u.id JOIN fx_songs s ON s.id = l.song_id""")
    sql["songs_by_ids"] = with_ctes(SONGS, REQUESTS, final="""
        SELECT * FROM fx_songs WHERE id IN (SELECT request_id FROM fx_requests)""")
    sql["candidate_songs"] = with_ctes(SONGS, final="SELECT * FROM fx_songs ORDER BY updated_at DESC, id LIMIT 1000")
    sql["liked_song_ids"] = with_ctes(LIKES, final="SELECT user_id, song_id FROM fx_likes")
    sql["similar_users"] = with_ctes(LIKES, SIMILAR, final="SELECT * FROM alike")
    sql["similar_users_of_requesters"] = with_ctes(USERS, LIKES, REQUESTS, SIMILAR, final="""
        SELECT * FROM alike WHERE n_common >= 3 AND user_id IN
          (SELECT id FROM fx_users WHERE user_id IN (SELECT user_id FROM fx_requests))""")
    sql["collaborative_suggestions"] = with_ctes(SONGS, LIKES, SIMILAR, COLLABORATIVE,
                                                 final="SELECT * FROM collaborative WHERE rank <= 10")

    sql["validate_requests"] = with_ctes(REQUESTS, CHECKED.format(low=0), final="SELECT request_id, reason FROM checked")
    sql["validate_reads"] = with_ctes(REQUESTS, CHECKED.format(low=1), final="SELECT request_id, reason FROM checked")
    sql["explode_requests"] = with_ctes(REQUESTS, ITEMS, final="""
        SELECT request_id, ts, user_id, position, song_name, query FROM items""")
    sql["normalize_texts"] = f"SELECT doc_id, {normalized('text')} AS query FROM documents"
    responses = """bodies AS (
      SELECT id AS response_id, json_object('items', CASE WHEN tags IS NULL THEN json_array()
          WHEN genre IS NULL THEN json_array(channel, found) ELSE json_array(found, channel) END) AS body
      FROM (SELECT *, json_object('id', json_object('videoId', video_id),
                                  'snippet', json_object('title', title, 'channelTitle', artist)) AS found,
                   json_object('id', json_object(), 'snippet', json_object('title', artist, 'channelTitle', artist)) AS channel
            FROM fx_songs)),
    listed AS (
      SELECT response_id, p AS position, body->>('$.items[' || p || '].id.videoId') AS video_id,
             body->>('$.items[' || p || '].snippet.title') AS title,
             body->>('$.items[' || p || '].snippet.channelTitle') AS artist
      FROM bodies CROSS JOIN (VALUES (0), (1)) v(p) WHERE p < json_array_length(body, '$.items'))"""
    sql["search_responses_first"] = with_ctes(SONGS, responses, final="""
        SELECT * FROM listed WHERE position = 0 AND video_id IS NOT NULL""")
    sql["search_responses_all"] = with_ctes(SONGS, responses, final="""
        SELECT *, 1.0 AS score FROM listed WHERE video_id IS NOT NULL""")
    sql["resolve_songs"] = with_ctes(SONGS, REQUESTS, ITEMS, RESOLVED, final="""
        SELECT request_id, position, query, video_id, title, artist FROM resolved""")

    gram_set = "list_distinct(list_transform(range(1, length(p) - 1), lambda i: substr(p, i, 3)))"
    sql["resolve_misspelled_songs"] = with_ctes(SONGS, REQUESTS, ITEMS, RESOLVED, f"""
        typed AS (
          SELECT request_id, position, concat(substr(song_name, 1, gone), substr(song_name, gone + 2)) AS song_name FROM (
            SELECT *, CAST((request_id * 7 + position) % greatest(length(song_name), 1) AS INTEGER) AS gone FROM exploded)),
        asked AS (SELECT DISTINCT {normalized('song_name')} AS query FROM typed),
        query_grams AS (SELECT query, {gram_set} AS g FROM (SELECT query, concat('  ', query, ' ') AS p FROM asked WHERE query IS NOT NULL)),
        named AS (SELECT query AS form, min(tier * 1e12 + id) AS place, arg_min(id, tier * 1e12 + id) AS id
                  FROM forms WHERE query IS NOT NULL GROUP BY query),
        form_grams AS (SELECT form, place, id, {gram_set} AS g FROM (SELECT *, concat('  ', form, ' ') AS p FROM named)),
        met AS (
          SELECT query, form, count(*) AS n FROM (SELECT query, unnest(g) AS gram FROM query_grams)
          JOIN (SELECT form, unnest(g) AS gram FROM form_grams) USING (gram) GROUP BY query, form),
        scored AS (
          SELECT o.query, f.id, f.place, o.query = o.form AS same, n / (len(q.g) + len(f.g) - n) AS score
          FROM met o JOIN query_grams q USING (query) JOIN form_grams f USING (form)),
        chosen AS (SELECT * FROM scored WHERE score >= 0.6 QUALIFY row_number() OVER (
          PARTITION BY query ORDER BY same DESC, score DESC, place) = 1)""", final=f"""
        SELECT t.request_id, t.position, t.song_name, s.video_id, round(c.score, 6) AS score
        FROM typed t LEFT JOIN chosen c ON c.query = {normalized('t.song_name')} LEFT JOIN fx_catalog s ON s.id = c.id""")

    sql["feature_text"] = with_ctes(SONGS, documents("fx_songs"), final="SELECT * FROM docs")
    sql["feature_text_weighted"] = with_ctes(SONGS, documents("fx_songs", "weighted"), final="SELECT * FROM docs")
    sql["song_tokens"] = with_ctes(SONGS, documents("fx_songs"), TOKENS, final="SELECT * FROM tok")
    texts = "docs AS (SELECT doc_id, text FROM documents)"
    sql["document_term_counts"] = with_ctes(texts, TOKENS, final="SELECT * FROM tf")
    sql["song_idf"] = with_ctes(SONGS, documents("fx_songs"), TOKENS, WEIGHTS, final="""
        SELECT term, df, round(idf, 6) AS idf FROM idf""")
    sql["document_tfidf"] = with_ctes(texts, TOKENS, WEIGHTS, final="""
        SELECT doc_id, term, round(weight, 6) AS weight FROM vectors""")
    sql["user_profiles"] = with_ctes(SONGS, LIKES, documents("fx_songs"), TOKENS, WEIGHTS, PROFILES, final="""
        SELECT user_id, term, round(weight, 6) AS weight FROM profiles""")
    cosine = """
        mean_norm AS (SELECT user_id, sqrt(sum(weight * weight)) AS norm FROM profiles GROUP BY user_id),
        pool AS (SELECT id AS doc_id FROM fx_songs ORDER BY updated_at DESC, id LIMIT 1000),
        scored AS (
          SELECT p.user_id, v.doc_id AS song_id, sum(p.weight * v.weight / m.norm) AS score
          FROM profiles p JOIN mean_norm m USING (user_id) JOIN vectors v USING (term)
          WHERE v.doc_id IN (SELECT doc_id FROM pool) GROUP BY p.user_id, v.doc_id)"""
    sql["rank_unliked"] = with_ctes(SONGS, LIKES, documents("fx_songs"), TOKENS, WEIGHTS, PROFILES, cosine,
                                    RANKING.format(songs="fx_songs", likes="fx_likes"), final="""
        SELECT user_id, song_id, round(score, 6) AS score, rank FROM ranked WHERE rank <= 10""")
    sql["cosine_scores"] = with_ctes(SONGS, LIKES, documents("fx_songs"), TOKENS, WEIGHTS, PROFILES, cosine, final="""
        SELECT user_id, count(*) AS n_scored, round(max(score), 6) AS best, round(avg(score), 6) AS mean
        FROM scored GROUP BY user_id""")
    sql["content_suggestions"] = with_ctes(SONGS, LIKES, content(), final=CONTENT_ROWS)
    sql["content_suggestions_weighted"] = with_ctes(SONGS, LIKES, content(mode="weighted"), final=CONTENT_ROWS)
    sql["content_suggestions_shared_corpus"] = with_ctes(SONGS, LIKES, SHARED, final=CONTENT_ROWS)

    sql["popular_by_genre"] = with_ctes(SONGS, LIKES, popular(), final="SELECT * FROM popular")
    sql["popular_for_requests"] = with_ctes(SONGS, LIKES, REQUESTS, popular(), LATEST.format(source="fx_requests"), PICKED,
                                            final="SELECT * FROM picked")
    fallback = """hybrid AS (
      SELECT u.user_id, c.rank, c.title, c.artist, c.video_id AS youtube_video_id, {score} AS score, '{source}' AS source
      FROM {rows} c JOIN fx_users u ON u.id = c.user_id WHERE c.rank <= 10
      UNION ALL
      SELECT u.user_id, p.rank, p.title, p.artist, p.video_id, p.score, 'popular'
      FROM fx_users u CROSS JOIN popular p WHERE p.is_global AND u.id NOT IN (SELECT user_id FROM {rows}))"""
    sql["collaborative_or_popular"] = with_ctes(
        USERS, SONGS, LIKES, SIMILAR, COLLABORATIVE, popular(),
        fallback.format(rows="collaborative", score="CAST(c.n_users AS DOUBLE)", source="collaborative"),
        final="SELECT * FROM hybrid")
    sql["suggest"] = with_ctes(
        USERS, SONGS, LIKES, content(), popular(),
        fallback.format(rows="content", score="round(c.score, 6)", source="content"), final="SELECT * FROM hybrid")
    sql["suggest_combined"] = with_ctes(
        USERS, SONGS, LIKES, SIMILAR, COLLABORATIVE, content(), popular(k=15), """
        pooled AS (
          SELECT user_id, 0 AS place, rank, title, artist, video_id, CAST(n_users AS DOUBLE) AS score, 'collaborative' AS source
          FROM collaborative WHERE rank <= 15
          UNION ALL SELECT u.id, 1, p.rank, p.title, p.artist, p.video_id, p.score, 'popular'
          FROM fx_users u CROSS JOIN popular p WHERE p.is_global
          UNION ALL SELECT user_id, 2, rank, title, artist, video_id, round(score, 6), 'content' FROM content WHERE rank <= 15),
        once AS (SELECT * FROM pooled QUALIFY row_number() OVER (PARTITION BY user_id, video_id ORDER BY place, rank) = 1),
        listed AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY place, rank) AS final_rank FROM once)""",
        final="""SELECT u.user_id, l.final_rank AS rank, l.title, l.artist, l.video_id AS youtube_video_id, l.score, l.source
        FROM listed l JOIN fx_users u ON u.id = l.user_id WHERE l.final_rank <= 15""")
    share = """{kind}_own AS (
          SELECT l.user_id, lower(coalesce(s.{kind}, '')) AS v, count(*) AS n FROM fx_likes l JOIN fx_songs s ON s.id = l.song_id GROUP BY ALL),
        {kind}_all AS (SELECT v, sum(n) / (SELECT sum(n) FROM {kind}_own) AS share FROM {kind}_own GROUP BY v)"""
    sql["suggest_fused"] = with_ctes(
        USERS, SONGS, LIKES, SIMILAR, COLLABORATIVE, content(), popular(k=20), share.format(kind="genre"), share.format(kind="artist"), """
        pooled AS (
          SELECT user_id, song_id, rank, 'collaborative' AS source FROM collaborative WHERE rank <= 20
          UNION ALL SELECT u.id, p.song_id, p.rank, 'popular' FROM fx_users u CROSS JOIN popular p WHERE p.is_global
          UNION ALL SELECT user_id, song_id, rank, 'content' FROM content WHERE rank <= 20),
        fused AS (
          SELECT user_id, song_id, sum(1.0::DOUBLE / (60 + rank)) AS fused, list_sort(list(source)) AS sources FROM pooled p
          WHERE NOT EXISTS (SELECT 1 FROM fx_likes l WHERE l.user_id = p.user_id AND l.song_id = p.song_id) GROUP BY user_id, song_id),
        own AS (SELECT user_id, count(*) AS h FROM fx_likes GROUP BY user_id),
        weighed AS (
          SELECT f.*, s.video_id, s.title, s.artist,
                 fused * (1 + (coalesce(g.n, 0) + 10 * coalesce(ga.share, 0)) / (coalesce(o.h, 0) + 10)
                            + (coalesce(a.n, 0) + 10 * coalesce(aa.share, 0)) / (coalesce(o.h, 0) + 10)) AS score
          FROM fused f JOIN fx_songs s ON s.id = f.song_id LEFT JOIN own o USING (user_id)
          LEFT JOIN genre_own g ON g.user_id = f.user_id AND g.v = lower(coalesce(s.genre, '')) LEFT JOIN genre_all ga ON ga.v = lower(coalesce(s.genre, ''))
          LEFT JOIN artist_own a ON a.user_id = f.user_id AND a.v = lower(coalesce(s.artist, '')) LEFT JOIN artist_all aa ON aa.v = lower(coalesce(s.artist, ''))),
        listed AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY floor(score * 1e9 + 0.5) DESC, song_id) AS rank FROM weighed)""",
        final="""SELECT u.user_id, l.rank, l.title, l.artist, l.video_id AS youtube_video_id, round(l.score, 6) AS score, l.sources
        FROM listed l JOIN fx_users u ON u.id = l.user_id WHERE l.rank <= 10""")
    sql["to_suggestions"] = with_ctes(SONGS, final="""
        SELECT id, title, artist, CASE WHEN genre IS NOT NULL AND tags IS NOT NULL THEN video_id
          ELSE concat('y', CAST(id AS VARCHAR)) END AS youtube_video_id FROM fx_songs""")
    iso = "CASE WHEN {c} = date_trunc('second', {c}) THEN strftime({c}, '%Y-%m-%dT%H:%M:%S') ELSE strftime({c}, '%Y-%m-%dT%H:%M:%S.%f') END"
    rows = f"""SELECT u.user_id, s.video_id, s.title, s.artist, {iso.format(c='l.created_at')} AS created_at
        FROM fx_users u JOIN fx_likes l ON l.user_id = u.id JOIN fx_songs s ON s.id = l.song_id"""
    sql["liked_rows"] = with_ctes(USERS, SONGS, LIKES, final=rows)
    sql["iso_timestamps"] = f"SELECT event_id, {iso.format(c='ts')} AS iso FROM events"

    requests = (USERS, SONGS, LIKES, REQUESTS, STORED, ITEMS, RESOLVED, ADDED)
    sql["upsert_users"] = with_ctes(*requests, final="SELECT * FROM all_users")
    sql["upsert_songs"] = with_ctes(*requests, final="SELECT * FROM all_songs")
    sql["process_requests_new_users"] = with_ctes(*requests, final="SELECT * FROM new_users")
    sql["process_requests_new_songs"] = with_ctes(*requests, final="SELECT * FROM new_songs")
    sql["process_requests_new_likes"] = with_ctes(*requests, final="""
        SELECT user_id, song_id, TIMESTAMP '2024-02-01 00:00:00' AS created_at FROM new_likes""")
    all_likes = "all_likes AS (SELECT user_id, song_id FROM st_likes UNION ALL SELECT user_id, song_id FROM new_likes)"
    sql["process_requests_suggestions"] = with_ctes(
        *requests, all_likes, content("all_songs", "all_likes"), popular("all_songs", "all_likes"),
        LATEST.format(source="accepted"), PICKED, """
        targets AS (SELECT u.id, u.user_id FROM all_users u JOIN latest r ON r.user_id = u.user_id)""", final="""
        SELECT t.user_id, c.rank, c.title, c.artist, c.video_id AS youtube_video_id, round(c.score, 6) AS score, 'content' AS source
        FROM targets t JOIN content c ON c.user_id = t.id WHERE c.rank <= 10
        UNION ALL
        SELECT t.user_id, p.rank, p.title, p.artist, p.video_id, p.score, 'popular'
        FROM targets t JOIN picked p ON p.user_id = t.user_id WHERE t.id NOT IN (SELECT user_id FROM all_likes)""")
    event_likes = """ev_likes AS (
      SELECT user_id, event_id * 7919 % (SELECT count(*) FROM part) AS song_id, min(ts) AS first_ts FROM events GROUP BY ALL)"""
    appended = """SELECT * FROM fx_likes UNION ALL SELECT user_id, song_id, {time} FROM ev_likes e
        WHERE NOT EXISTS (SELECT 1 FROM fx_likes l WHERE l.user_id = e.user_id AND l.song_id = e.song_id)"""
    sql["append_likes"] = with_ctes(LIKES, event_likes, final=appended.format(time="TIMESTAMP '2024-02-01 00:00:00'"))
    sql["append_likes_twice"] = with_ctes(LIKES, event_likes, final=appended.format(time="first_ts"))
    sql["audit_constraints"] = with_ctes(REQUESTS, """
        u AS (SELECT request_id AS id, user_id, genre AS name, ts FROM fx_requests),
        s AS (SELECT doc_id AS id, source AS video_id, text AS title, lang AS artist FROM documents),
        l AS (SELECT o_orderkey AS user_id, CASE WHEN l_linenumber <= 6 OR l_linenumber IS NULL THEN o_custkey END AS song_id, CASE WHEN l_partkey IS NOT NULL THEN o_orderdate END AS dated
              FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey)""", final="""
        SELECT 'users' AS table_name, 'id not null' AS rule, (SELECT count(*) FROM u WHERE id IS NULL) AS violations
        UNION ALL SELECT 'users', 'user_id not null', (SELECT count(*) FROM u WHERE user_id IS NULL)
        UNION ALL SELECT 'users', 'created_at not null', (SELECT count(*) FROM u WHERE ts IS NULL)
        UNION ALL SELECT 'users', 'updated_at not null', (SELECT count(*) FROM u WHERE ts IS NULL)
        UNION ALL SELECT 'users', 'user_id at most 255', (SELECT count(*) FROM u WHERE length(user_id) > 255)
        UNION ALL SELECT 'users', 'name at most 255', (SELECT count(*) FROM u WHERE length(name) > 255)
        UNION ALL SELECT 'users', 'email at most 255', 0
        UNION ALL SELECT 'users', 'id unique', (SELECT count(*) FROM (SELECT id FROM u WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1))
        UNION ALL SELECT 'users', 'user_id unique',
          (SELECT count(*) FROM (SELECT user_id FROM u WHERE user_id IS NOT NULL GROUP BY user_id HAVING count(*) > 1))
        UNION ALL SELECT 'songs', 'id not null', (SELECT count(*) FROM s WHERE id IS NULL)
        UNION ALL SELECT 'songs', 'video_id not null', (SELECT count(*) FROM s WHERE video_id IS NULL)
        UNION ALL SELECT 'songs', 'title not null', (SELECT count(*) FROM s WHERE title IS NULL)
        UNION ALL SELECT 'songs', 'artist not null', (SELECT count(*) FROM s WHERE artist IS NULL)
        UNION ALL SELECT 'songs', 'updated_at not null', 0
        UNION ALL SELECT 'songs', 'video_id at most 64', (SELECT count(*) FROM s WHERE length(video_id) > 64)
        UNION ALL SELECT 'songs', 'title at most 512', (SELECT count(*) FROM s WHERE length(title) > 512)
        UNION ALL SELECT 'songs', 'artist at most 256', (SELECT count(*) FROM s WHERE length(artist) > 256)
        UNION ALL SELECT 'songs', 'genre at most 128', 0
        UNION ALL SELECT 'songs', 'id unique', (SELECT count(*) FROM (SELECT id FROM s WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1))
        UNION ALL SELECT 'songs', 'video_id unique',
          (SELECT count(*) FROM (SELECT video_id FROM s WHERE video_id IS NOT NULL GROUP BY video_id HAVING count(*) > 1))
        UNION ALL SELECT 'likes', 'user_id not null', (SELECT count(*) FROM l WHERE user_id IS NULL)
        UNION ALL SELECT 'likes', 'song_id not null', (SELECT count(*) FROM l WHERE song_id IS NULL)
        UNION ALL SELECT 'likes', 'created_at not null', (SELECT count(*) FROM l WHERE dated IS NULL)
        UNION ALL SELECT 'likes', 'user_id, song_id unique',
          (SELECT count(*) FROM (SELECT 1 FROM l WHERE user_id IS NOT NULL AND song_id IS NOT NULL GROUP BY user_id, song_id HAVING count(*) > 1))
        UNION ALL SELECT 'likes', 'user_id refers to a row', (SELECT count(*) FROM l WHERE user_id NOT IN (SELECT id FROM u WHERE id IS NOT NULL))
        UNION ALL SELECT 'likes', 'song_id refers to a row', (SELECT count(*) FROM l WHERE song_id NOT IN (SELECT id FROM s WHERE id IS NOT NULL))""")
    gone = "gone AS (SELECT id FROM fx_users WHERE user_id IN (SELECT user_id FROM fx_requests))"
    sql["purge_users"] = with_ctes(USERS, REQUESTS, gone, final="SELECT * FROM fx_users WHERE id NOT IN (SELECT id FROM gone)")
    sql["purge_users_likes"] = with_ctes(USERS, LIKES, REQUESTS, gone, final="""
        SELECT * FROM fx_likes WHERE user_id NOT IN (SELECT id FROM gone)""")
    sql["purge_songs_likes"] = with_ctes(SONGS, LIKES, REQUESTS, ITEMS, RESOLVED, final="""
        SELECT * FROM fx_likes WHERE song_id NOT IN (
          SELECT s.id FROM fx_songs s JOIN resolved r ON r.video_id = s.video_id)""")
    sql["migrate_users_down"] = with_ctes(USERS, final="SELECT id, user_id, created_at FROM fx_users")
    sql["migrate_users_up"] = with_ctes(USERS, final="""
        SELECT id, user_id, CAST(NULL AS VARCHAR) AS name, CAST(NULL AS VARCHAR) AS email, created_at,
               TIMESTAMP '2024-02-01 00:00:00' AS updated_at FROM fx_users""")
    sql["too_long_for_first_version"] = with_ctes(REQUESTS, final="""
        SELECT request_id AS id, user_id FROM fx_requests WHERE length(user_id) > 128""")

    snapshot = (*requests, SNAPSHOT)
    sql["recent_likes_snapshot"] = with_ctes(*snapshot, final="SELECT * FROM snapshot")
    sql["stream_recent_likes"] = sql["recent_likes_snapshot"]
    sql["liked_songs_as_served"] = with_ctes(*snapshot, final=f"""
        SELECT n.user_id, s.video_id, s.title, s.artist, 'from_cache' AS created_at
        FROM (SELECT user_id, unnest(song_ids) AS song_id FROM snapshot) n JOIN all_songs s ON s.id = n.song_id
        WHERE n.user_id IN (SELECT user_id FROM fx_users)
        UNION ALL {rows} WHERE u.user_id NOT IN (SELECT user_id FROM snapshot)""")
    sql["reusable_searches"] = with_ctes(SONGS, REQUESTS, ITEMS, RESOLVED, """
        lookups AS (SELECT DISTINCT query, ts, video_id IS NOT NULL AS hit FROM resolved
                    WHERE query IS NOT NULL)""", final="""
        SELECT i.request_id, i.position, i.ts, i.query,
          CASE WHEN i.ts < l.ts + CASE WHEN l.hit THEN INTERVAL 7 DAY ELSE INTERVAL 1 DAY END THEN l.ts END AS lookup_ts,
          CASE WHEN i.ts < l.ts + CASE WHEN l.hit THEN INTERVAL 7 DAY ELSE INTERVAL 1 DAY END THEN l.hit END AS hit
        FROM items i ASOF LEFT JOIN lookups l ON l.query = i.query AND l.ts <= i.ts WHERE i.query IS NOT NULL""")
    sql["stream_reusable_searches"] = sql["reusable_searches"]
    sql["stream_likes"] = with_ctes(*requests, final="""
        SELECT user_id, song_id, created_at FROM st_likes UNION ALL
        SELECT user_id, song_id, first_ts FROM new_likes""")
    sql["commit_requests_likes"] = sql["stream_likes"]
    sql["commit_requests_suggestions"] = sql["process_requests_suggestions"]
    sql["similar_users_refreshed"] = sql["similar_users"]
    sql["collaborative_suggestions_refreshed"] = sql["collaborative_suggestions"]
    sql["collaborative_suggestions_spread"] = sql["collaborative_suggestions"]
    sql["content_suggestions_bounded"] = sql["content_suggestions"]
    sql["content_suggestions_of_all_songs"] = sql["content_suggestions"].replace("ORDER BY updated_at DESC, id LIMIT 1000", "")
    sql["content_suggestions_spread"] = sql["content_suggestions"]
    return {name: with_types(text, TYPED.get(name, ())) for name, text in sql.items()}
