import datetime
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from likerec.operators import colikes
from likerec.session import BROADCAST_LIMIT_BYTES, RUNTIME_SETTINGS, broadcast_stored, materialize
from tests.conftest import LIKES, SONGS, rows

NOW = datetime.datetime(2024, 1, 1)


def make_likes(seed, n_users=40, n_songs=30, hot_song=True):
    generator = random.Random(seed)
    likes = set()
    for user in range(n_users):
        for _ in range(generator.randint(0, 7)):
            likes.add((user, generator.randint(1, n_songs)))
        if hot_song and generator.random() < 0.9:
            likes.add((user, 0))
    return likes


def brute_similar(likes, min_common):
    of = defaultdict(set)
    for user, song in likes:
        of[user].add(song)
    return {(u, v): len(of[u] & of[v]) for u in of for v in of if u != v and len(of[u] & of[v]) >= min_common}


def brute_top(likes, min_common, k):
    of = defaultdict(set)
    for user, song in likes:
        of[user].add(song)
    result = set()
    for u in of:
        counts = Counter()
        for (a, v) in brute_similar(likes, min_common):
            if a == u:
                counts.update(of[v] - of[u])
        best = sorted(counts.items(), key=lambda c: (-c[1], c[0]))[:k]
        result |= {(u, rank, song, n) for rank, (song, n) in enumerate(best, 1)}
    return result


def frame(spark, likes):
    return spark.createDataFrame([(u, s, NOW) for u, s in sorted(likes)], LIKES)


def song_frame(spark, n_songs=31):
    return spark.createDataFrame([(i, f"v{i}", f"t{i}", "a", None, None, NOW) for i in range(n_songs)], SONGS)


@pytest.mark.parametrize("min_common", [1, 2, 3])
@pytest.mark.parametrize("hot_song", [False, True])
def test_similar_users_match_brute_force(spark, min_common, hot_song):
    likes = make_likes(min_common, hot_song=hot_song)
    expected = sorted([(u, v, n) for (u, v), n in brute_similar(likes, min_common).items()], key=repr)
    found = colikes.similar_users(frame(spark, likes), min_common)
    assert rows(found, "user_id", "similar_user_id", "n_common") == expected


@pytest.mark.parametrize("min_common", [1, 2])
def test_similar_users_of_wanted(spark, min_common):
    likes = make_likes(11)
    wanted = spark.createDataFrame([(1,), (2,), (99,)], "user_id long")
    expected = sorted([(u, v, n) for (u, v), n in brute_similar(likes, min_common).items() if u in (1, 2)], key=repr)
    found = colikes.similar_users(frame(spark, likes), min_common, wanted)
    assert rows(found, "user_id", "similar_user_id", "n_common") == expected


def test_a_song_everybody_likes_generates_no_pairs(spark):
    likes = {(u, 0) for u in range(50)} | {(u, u + 1) for u in range(50)}
    marked = colikes._split_by_top_song(frame(spark, likes))
    below = marked.where("song_id <> top_song")
    assert below.where("song_id = 0").count() == 0
    assert colikes.similar_users(frame(spark, likes)).count() == 0


@pytest.mark.parametrize("block_fans", [10**9, 4])
def test_three_songs_that_everybody_likes(spark, block_fans):
    """All users are similar; every pair is counted once, in cells of two blocks of fans."""
    likes = {(u, s) for u in range(40) for s in range(3)} | {(u, 10 + u % 7) for u in range(40)}
    found = colikes.similar_users(frame(spark, likes), block_fans=block_fans)
    expected = sorted([(u, v, n) for (u, v), n in brute_similar(likes, 2).items()], key=repr)
    assert rows(found, "user_id", "similar_user_id", "n_common") == expected


@pytest.mark.parametrize("block_fans", [10**9, 5, 1])
def test_collaborative_matches_brute_force(spark, block_fans, monkeypatch):
    monkeypatch.setattr(colikes, "PACKED_SONGS", 3)
    likes = make_likes(5)
    found = colikes.collaborative_suggestions(frame(spark, likes), song_frame(spark), k=4, block_fans=block_fans)
    assert rows(found, "user_id", "rank", "song_id", "n_users") == sorted(brute_top(likes, 2, 4), key=repr)


def test_collaborative_for_wanted_users(spark):
    likes = make_likes(6)
    wanted = spark.createDataFrame([(3,), (4,)], "user_id long")
    found = colikes.collaborative_suggestions(frame(spark, likes), song_frame(spark), k=3, wanted=wanted)
    expected = sorted([r for r in brute_top(likes, 2, 3) if r[0] in (3, 4)], key=repr)
    assert rows(found, "user_id", "rank", "song_id", "n_users") == expected


def test_no_likes_no_rows(spark):
    assert colikes.collaborative_suggestions(frame(spark, set()), song_frame(spark)).count() == 0


@pytest.mark.parametrize("min_common", [1, 2, 3])
def test_refreshed_pairs_and_lists_equal_those_of_one_run(spark, min_common):
    """Three batches of likes, the last one empty; lists of users whom nothing touches are not made anew."""
    everything = sorted(make_likes(21, n_users=60, n_songs=60, hot_song=False))
    random.Random(3).shuffle(everything)
    songs, columns = song_frame(spark, 61), ("user_id", "rank", "song_id", "n_users")
    held = set(everything[:-12])
    pairs = colikes.similar_users(frame(spark, held), min_common)
    tops = colikes.collaborative_suggestions(frame(spark, held), songs, 5, min_common)
    for batch in (everything[-12:-8], everything[-8:], []):
        held |= set(batch)
        before = rows(tops, *columns)
        pairs, touched = colikes.refresh_similar_users(pairs, frame(spark, held), frame(spark, batch), min_common)
        pairs, who = materialize(pairs), {r[0] for r in touched.collect()}
        marked = tops.withColumn("n_users", F.when(F.col("user_id").isin(list(who)), -1).otherwise(F.col("n_users")))
        tops = materialize(colikes.refresh_suggestions(marked, pairs, touched, frame(spark, held), songs, 5))
        assert rows(pairs, "user_id", "similar_user_id", "n_common") == sorted(
            [(u, v, n) for (u, v), n in brute_similar(held, min_common).items()], key=repr)
        assert rows(tops, *columns) == sorted(brute_top(held, min_common, 5), key=repr)
        assert [r for r in before if r[0] not in who] == [r for r in rows(tops, *columns) if r[0] not in who]
        assert len(who) < 60 and (batch or not who)


def test_pairs_are_counted_where_their_lists_arrive(spark):
    likes = materialize(frame(spark, [(u, s) for u in range(6) for s in range(4)]))
    plan = colikes.similar_users(likes)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(u#" in plan
    assert not [line for line in plan.splitlines() if "hashpartitioning(u#" in line and ", v#" in line]


@pytest.mark.parametrize("block_fans", [10**9, 3, 1])
def test_repeated_likes_count_each_time(spark, block_fans):
    likes = frame(spark, [(1, 1), (1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (3, 1), (3, 2)])
    found = colikes.similar_users(likes, min_common=1, block_fans=block_fans)
    counted = [(1, 2, 3), (1, 3, 5), (2, 3, 3)]
    assert rows(found, "user_id", "similar_user_id", "n_common") == sorted(counted + [(v, u, n) for u, v, n in counted])


def test_small_files_of_many_rows_are_not_broadcast(spark):
    stored = materialize(spark.range(3_000_000).select((F.col("id") % 1_000_003).alias("id")))
    plan = stored.join(stored.withColumn("more", F.lit(1)), "id")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_broadcasts_count_rows_and_not_files(spark):
    few = materialize(spark.createDataFrame([(1, "a", None), (2, None, 0.5)], "id long, name string, x double"))
    assert "ResolvedHint" in broadcast_stored(few)._jdf.queryExecution().analyzed().toString()
    # One name over and over takes next to nothing in a file.
    many = materialize(spark.range(3000).select(F.repeat(F.lit("name"), F.lit(BROADCAST_LIMIT_BYTES // 8000)).alias("name")))
    assert "ResolvedHint" not in broadcast_stored(many)._jdf.queryExecution().analyzed().toString()
    with pytest.raises(ValueError, match="numbers and texts"):
        broadcast_stored(spark.range(1).select(F.array("id").alias("ids")))


def test_a_stored_table_of_names_is_shuffled_though_its_file_is_small(spark):
    names = materialize(spark.range(0, 100_000, 1, 1).select(F.col("id"), F.format_string("Customer#%09d", "id").alias("name")))
    def plan():
        return names.alias("a").join(names.alias("b"), F.col("a.name") == F.col("b.name"))._jdf.queryExecution().executedPlan().toString()

    assert "Broadcast" not in plan()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(1024 * 1024))
    try:
        assert "Broadcast" in plan()  # so the file is that small
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", RUNTIME_SETTINGS["spark.sql.autoBroadcastJoinThreshold"])


def test_tasks_count_a_bounded_number_of_pairs(spark, monkeypatch):
    widths, plain = [], colikes.shuffle_width
    monkeypatch.setattr(colikes, "shuffle_width", lambda s, n, per_task: widths.append(per_task) or plain(s, n, per_task))
    likes = spark.createDataFrame([(u, s, None) for u in range(6) for s in range(4)], LIKES)
    assert colikes.similar_users(likes).count() == 30
    assert widths and max(widths) <= 1_000_000
