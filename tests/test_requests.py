import datetime
import json

from pyspark.sql import functions as F

from likerec.functions.suggestions import iso_timestamp, to_suggestions
from likerec.functions.text import normalize_query
from likerec.operators import ingest, popularity, writes
from likerec.plans import hybrid, serving
from likerec.session import with_new_ids
from tests.conftest import LIKES, REQUESTS, SONGS, USERS, rows

NOW = datetime.datetime(2024, 1, 1)
LATER = "2024-01-02 00:00:00"


def at(minutes):
    return NOW + datetime.timedelta(minutes=minutes)


def test_normalize_query(spark):
    expected = {
        "Don't Look Now - The O'Haras'": "don't look now - the o'haras'",
        "  Étoile!!  ": "étoile",
        "???": None,
        "": None,
        "x" * 199 + " yz": "x" * 199 + " ",
        " a\u3000b ": "a\u3000b",
        "Night Bus (feat. Nobody)": "night bus feat nobody",
        "tab\tname": "tab\tname",
        "A/B": "ab",
        "snow_man ☃ 1": "snow_man  1",
        "\x1cx\x1f": "x",
        "Ünï-cödé": "ünï-cödé",
    }
    df = spark.createDataFrame([(n,) for n in expected], "name string").select("name", normalize_query(F.col("name")).alias("q"))
    assert {r["name"]: r["q"] for r in df.collect()} == expected


def test_short_queries_can_be_left_out(spark):
    df = spark.createDataFrame([("a",), ("ab",)], "name string").select(normalize_query(F.col("name"), 2).alias("q"))
    assert [r.q for r in df.collect()] == [None, "ab"]


def test_validation_limits(spark):
    good = ["x"] * 50
    cases = [
        (1, "u" * 255, good, "g" * 128, None), (2, "u" * 256, good, None, "user_id too long"),
        (3, "", ["a"], None, None), (4, "u", [], None, "no songs"), (5, "u", ["x"] * 51, None, "too many songs"),
        (6, "u", ["a"], "g" * 129, "genre too long"), (7, None, ["a"], None, "user_id missing"),
        (8, "u", None, None, "songs missing"), (9, "u", ["a", None], None, "song missing"),
    ]
    df = spark.createDataFrame([(i, NOW, u, s, g) for i, u, s, g, _ in cases], REQUESTS)
    ok, bad = ingest.validate_requests(df)
    assert [r[0] for r in rows(ok, "request_id")] == [1, 3]
    assert dict(rows(bad, "request_id", "reason")) == {i: r for i, *_, r in cases if r}
    reads = dict(rows(ingest.check_requests(df, min_user_id=1), "request_id", "reason"))
    assert reads[3] == "user_id too short"


def test_search_responses(spark):
    item = lambda v: {"id": v, "snippet": {"title": "t", "channelTitle": "c"}}
    bodies = [{"items": []}, {"items": [item({"videoId": "a"}), item({"videoId": "b"})]},
              {"items": [item({"channelId": "x"}), item({"videoId": "d"})]}, {}]
    df = spark.createDataFrame([(i, json.dumps(b)) for i, b in enumerate(bodies)], "response_id long, body string")
    assert rows(ingest.parse_search_responses(df, "first"), "response_id", "video_id", "title", "artist") == [(1, "a", "t", "c")]
    assert rows(ingest.parse_search_responses(df, "all"), "response_id", "video_id", "score") == [
        (1, "a", 1.0), (1, "b", 1.0), (2, "d", 1.0)]


def catalog(spark):
    return spark.createDataFrame([
        (1, "v1", "Hello", "Adele", None, None, NOW), (2, "v2", "Hello", "Lionel", None, None, NOW),
        (3, "v3", "Hello", "Adele", None, None, NOW), (4, "v4", "hello - adele", "Cover", None, None, NOW),
        (5, "v5", "???", "!", None, None, NOW)], SONGS)


def test_resolution_prefers_full_names_then_small_ids(spark):
    names = spark.createDataFrame([("Hello - Adele",), ("HELLO",), ("hello - lionel",), ("nobody",), ("???",), ("hello - adele - cover",)],
                                  "song_name string")
    found = dict(rows(ingest.resolve_songs(names, catalog(spark), keep_unresolved=True), "song_name", "video_id"))
    assert found == {"Hello - Adele": "v1", "HELLO": "v1", "hello - lionel": "v2", "nobody": None, "???": None,
                     "hello - adele - cover": "v4"}
    assert ingest.resolve_songs(names, catalog(spark)).count() == 4


def test_new_ids_are_dense_and_follow_the_key(spark):
    new = spark.createDataFrame([(f"k{i:03d}",) for i in range(100)], "key string").repartition(7)
    existing = spark.createDataFrame([(41,), (7,)], "id long")
    assert rows(with_new_ids(new, existing, "key"), "id", "key") == sorted([(42 + i, f"k{i:03d}") for i in range(100)], key=repr)


def test_likes_are_added_once(spark):
    likes = spark.createDataFrame([(1, 1, NOW)], LIKES)
    pairs = spark.createDataFrame([(1, 1, at(1)), (1, 2, at(5)), (1, 2, at(3))], LIKES)
    once = writes.append_likes(likes, pairs)
    expected = [(1, 1, NOW), (1, 2, at(3))]
    assert rows(once, "user_id", "song_id", "created_at") == sorted(expected, key=repr)
    assert rows(writes.append_likes(once, pairs), "user_id", "song_id", "created_at") == sorted(expected, key=repr)


def test_purge_removes_likes_too(spark):
    songs, likes = catalog(spark), spark.createDataFrame([(1, 1, NOW), (1, 2, NOW)], LIKES)
    kept, kept_likes = writes.purge(songs, likes, spark.createDataFrame([(1,)], "id long"), "song_id")
    assert kept.count() == 4 and rows(kept_likes, "song_id") == [(2,)]


def test_audit_counts_violations(spark):
    users = spark.createDataFrame([(1, "a", None, None, NOW, NOW), (2, "a", "n" * 300, None, NOW, NOW)], USERS)
    likes = spark.createDataFrame([(1, 1, NOW), (1, 1, NOW), (9, 77, NOW)], LIKES)
    found = {(t, r): n for t, r, n in rows(writes.audit_constraints(users, catalog(spark), likes), "table_name", "rule", "violations")}
    broken = {k: n for k, n in found.items() if n}
    assert broken == {("users", "name at most 255"): 1, ("users", "user_id unique"): 1, ("likes", "user_id, song_id unique"): 1,
                      ("likes", "user_id refers to a row"): 1, ("likes", "song_id refers to a row"): 1}


def test_iso_timestamps(spark):
    moments = [NOW, NOW.replace(microsecond=5), NOW.replace(microsecond=120000), NOW.replace(hour=23, second=59)]
    df = spark.createDataFrame([(m,) for m in moments], "t timestamp_ntz").select(iso_timestamp(F.col("t")).alias("iso"))
    assert [r.iso for r in df.collect()] == [m.isoformat() for m in moments]


def test_suggestion_ids_fall_through_empty_text(spark):
    df = spark.createDataFrame([("a", "y"), ("", "y"), (None, "y")], "video_id string, youtube_video_id string")
    assert [r[0] for r in to_suggestions(df).collect()] == ["a", "y", "y"]


def test_popular_lists(spark):
    songs = spark.createDataFrame([(1, "v1", "a", "x", "Rock", None, NOW), (2, "v2", "b", "x", "rock", None, NOW),
                                   (3, "v3", "c", "x", None, None, NOW)], SONGS)
    likes = spark.createDataFrame([(u, s, NOW) for u, s in [(1, 1), (2, 1), (1, 2), (1, 3), (2, 3), (3, 3)]], LIKES)
    asked = spark.createDataFrame([(1, "ROCK"), (2, None), (3, "jazz"), (4, "")], "user_id long, genre string")
    found = rows(popularity.popular_for_requests(asked, likes, songs, 2), "user_id", "rank", "song_id")
    overall = [(1, 3), (2, 1)]
    assert found == sorted([(1, 1, 1), (1, 2, 2)] + [(u, r, s) for u in (2, 3, 4) for r, s in overall], key=repr)


def test_snapshot_holds_the_latest_request_while_fresh(spark):
    writes_ = spark.createDataFrame([
        (1, at(0), "a", [1, 2]), (2, at(10), "a", [3]), (3, at(-60), "b", [4]), (4, at(20), "c", []), (5, at(40), "a", [9])],
        "request_id long, ts timestamp_ntz, user_id string, song_ids array<long>")
    snapshot = serving.recent_likes_snapshot(writes_, "2024-01-01 00:30:00")
    assert rows(snapshot, "user_id", "song_ids") == [("a", [3]), ("c", [])]
    users = spark.createDataFrame([(i, n, None, None, NOW, NOW) for i, n in enumerate("abc")], USERS)
    likes = spark.createDataFrame([(0, 1, NOW), (1, 2, NOW), (2, 3, NOW)], LIKES)
    served = serving.liked_songs_as_served(users, snapshot, users, likes, catalog(spark))
    assert rows(served, "user_id", "video_id", "created_at") == [("a", "v3", "from_cache"), ("b", "v2", "2024-01-01T00:00:00")]


def test_reusable_searches_expire(spark):
    day = 24 * 60
    lookups = spark.createDataFrame([("hit", at(0), True), ("none", at(0), False), ("hit", at(9 * day), False)],
                                    "query string, ts timestamp_ntz, hit boolean")
    asked = [("hit", -1), ("hit", 0), ("hit", 7 * day - 1), ("hit", 7 * day), ("none", day - 1), ("none", day),
             ("hit", 9 * day + 5), ("hit", 10 * day), ("other", 3)]
    searches = spark.createDataFrame([(i, 0, at(m), q) for i, (q, m) in enumerate(asked)],
                                     "request_id long, position int, ts timestamp_ntz, query string")
    expected = [None, at(0), at(0), None, at(0), None, at(9 * day), None, None]
    for bucket in ("day", "hour", "minute"):
        found = dict(rows(serving.reusable_searches(searches, lookups, bucket), "request_id", "lookup_ts"))
        assert [found[i] for i in range(len(asked))] == expected


def test_suggest_falls_back_in_order(spark):
    users = spark.createDataFrame([(1, "fan", None, None, NOW, NOW), (2, "new", None, None, NOW, NOW),
                                   (3, "all", None, None, NOW, NOW)], USERS)
    songs = spark.createDataFrame([(i, f"v{i}", f"word{i}", "aa", "Rock", None, at(i)) for i in range(1, 6)], SONGS)
    likes = spark.createDataFrame([(1, 5, NOW), (1, 4, NOW), (3, 5, NOW), (3, 4, NOW), (3, 3, NOW)], LIKES)
    asked = spark.createDataFrame([("fan", None), ("new", "rock"), ("all", None), ("unknown", None)], "user_id string, genre string")
    found = hybrid.suggest(users, likes, songs, asked, k=3, pool=3)
    by_user = {}
    for r in found.collect():
        by_user.setdefault(r.user_id, []).append((r["rank"], r.youtube_video_id, r.source))
    assert by_user["fan"] == [(1, "v3", "content")]
    assert sorted(by_user["new"]) == [(1, "v4", "popular"), (2, "v5", "popular"), (3, "v3", "popular")]
    # Likes the whole pool, and the similar user likes nothing else: the overall list remains.
    assert {x[2] for x in by_user["all"]} == {"popular"} and "unknown" not in by_user
    order = ("collaborative", "content", "popular")
    first = hybrid.suggest(users, likes, songs, asked, k=3, pool=3, order=order).where("user_id = 'fan'").collect()
    assert [(r.source, r.youtube_video_id) for r in first] == [("collaborative", "v3")]


def test_process_requests_counts_the_new_likes(spark):
    users = spark.createDataFrame([(1, "old", None, None, NOW, NOW)], USERS)
    songs = spark.createDataFrame([(1, "v1", "Hello", "Adele", None, None, NOW)], SONGS)
    likes = spark.createDataFrame([(1, 1, NOW)], LIKES)
    asked = spark.createDataFrame([
        (1, at(1), "old", ["Hello - Adele", "hello - lionel"], None), (2, at(2), "new", ["nobody"], "Pop"),
        (3, at(3), "bad", [], None), (4, at(4), "new", ["HELLO!", "hello"], None)], REQUESTS)
    done, suggestions = hybrid.process_requests(asked, users, songs, likes, catalog(spark), LATER)
    assert rows(done.new_users, "id", "user_id") == [(2, "new")]
    assert rows(done.new_songs, "id", "video_id", "genre") == [(2, "v2", None)]
    assert rows(done.new_likes, "user_id", "song_id") == [(1, 2), (2, 1)]
    assert rows(done.rejected, "request_id", "reason") == [(3, "no songs")]
    assert rows(suggestions, "user_id", "youtube_video_id", "source") == [
        ("new", "v2", "content"), ("old", "v1", "popular"), ("old", "v2", "popular")]
