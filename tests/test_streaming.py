import datetime
import json
import os

from pyspark.sql import functions as F

from likerec.plans import hybrid, serving
from likerec.schema import REQUESTS
from likerec.sources.tables import append_rows, load_tables, read_requests, stream_requests
from likerec.streaming import tables as stored
from likerec.streaming.likes import apply_requests, stream_likes, stream_recent_likes, stream_snapshots
from tests.conftest import LIKES, SONGS, USERS, rows

NOW = datetime.datetime(2024, 1, 1)


def tables(spark):
    songs = spark.createDataFrame([(i, f"v{i}", f"Title {i}", "Band", None, None, NOW) for i in range(1, 9)], SONGS)
    users = spark.createDataFrame([(1, "u1", None, None, NOW, NOW), (2, "u2", None, None, NOW, NOW)], USERS)
    likes = spark.createDataFrame([(1, 1, NOW), (2, 2, NOW)], LIKES)
    return users, songs, likes


def request(i, user, *numbers):
    moment = NOW + datetime.timedelta(minutes=i)
    return {"request_id": i, "ts": moment.isoformat(), "user_id": user, "songs": [f"title {n} - band" for n in numbers]}


BATCHES = [[request(1, "u1", 1, 3), request(2, "u3", 4)], [request(3, "u1", 3, 5), request(4, "u2", 2, 99)],
           [request(5, "u3", 4, 6, 6), request(6, "u4", 77), request(7, "u1")]]


def write_batches(folder):
    folder.mkdir()
    for i, batch in enumerate(BATCHES):
        file = folder / f"{i}.json"
        file.write_text("\n".join(json.dumps(r) for r in batch))
        os.utime(file, (1_700_000_000 + 60 * i,) * 2)  # files are taken in the order of their age
    return str(folder)


def natural(users, songs, likes):
    named = likes.join(users.select(F.col("id").alias("user_id"), F.col("user_id").alias("name")), "user_id").join(
        songs.select(F.col("id").alias("song_id"), "video_id"), "song_id")
    return rows(named, "name", "video_id", "created_at")


def finish(query):
    query.awaitTermination(240)
    assert not query.isActive and query.exception() is None
    return query


def read_all(spark, folder):
    return (stored.read_table(spark, folder, name) for name in ("users", "songs", "likes"))


def moments_agree(spark, folder, writes, moments):
    for moment in moments:
        assert rows(stream_recent_likes(spark, folder, moment), "user_id", "song_ids", "ts") == rows(
            serving.recent_likes_snapshot(writes, moment), "user_id", "song_ids", "ts")


def test_stream_equals_batch_and_replay_changes_nothing(spark, tmp_path):
    users, songs, likes = tables(spark)
    source = write_batches(tmp_path / "in")
    first = songs.where("id <= 4")
    folder = str(tmp_path / "tables")
    stored.start_tables(folder, users, first, likes)
    stream = stream_requests(spark, source, max_files_per_batch=1)
    query = finish(stream_likes(stream, folder, songs, str(tmp_path / "progress"), available_now=True))
    assert query.lastProgress["batchId"] >= 2  # several micro-batches

    batch = hybrid.store_requests(read_requests(spark, source), users, first, likes, songs, "2024-01-02")
    expected = natural(users.unionByName(batch.new_users), first.unionByName(batch.new_songs),
                       likes.unionByName(batch.new_likes.select("user_id", "song_id", "created_at")))
    streamed = natural(*read_all(spark, folder))
    assert streamed == expected and len(streamed) == 6
    for name in ("users", "songs"):
        ids = [r[0] for r in stored.read_table(spark, folder, name).select("id").collect()]
        assert sorted(ids) == list(range(1, len(ids) + 1))

    replay = read_requests(spark, source).where("request_id in (3, 4)")
    apply_requests(folder, songs)(replay, 1)
    assert natural(*read_all(spark, folder)) == expected


def test_copies_and_late_requests_over_a_restart(spark, tmp_path):
    """Each request comes twice, some copies and one late request after a restart from the checkpoint."""
    users, songs, likes = tables(spark)
    source = tmp_path / "in"
    source.mkdir()
    folder, progress = str(tmp_path / "tables"), str(tmp_path / "progress")
    stored.start_tables(folder, users, songs, likes)
    late = request(-300, "u2", 5)  # some hours before all others
    parts = [[*BATCHES[0], BATCHES[0][0]], [BATCHES[0][1], *BATCHES[1]], [late, *BATCHES[2], BATCHES[0][0], BATCHES[1][1]]]
    for number, part in enumerate(parts):
        (source / f"{number}.json").write_text("\n".join(json.dumps(r) for r in part))
        query = finish(stream_likes(stream_requests(spark, str(source)), folder, songs, progress, available_now=True))
        assert sum(p["numInputRows"] for p in query.recentProgress) > 0
    everything = read_requests(spark, str(source)).dropDuplicates(["request_id"])
    batch = hybrid.store_requests(everything, users, songs, likes, songs, "2024-01-02")
    assert natural(*read_all(spark, folder)) == natural(
        users.unionByName(batch.new_users), songs, likes.unionByName(batch.new_likes.select("user_id", "song_id", "created_at")))
    writes = stored.read_table(spark, folder, "writes")
    assert rows(writes, "request_id") == sorted([(i,) for i in (-300, 1, 2, 3, 4, 5, 6)], key=repr)  # 7 names no song


def test_requests_beyond_the_delay_are_dropped(spark, tmp_path):
    users, songs, likes = tables(spark)
    source = tmp_path / "in"
    source.mkdir()
    folder = str(tmp_path / "tables")
    stored.start_tables(folder, users, songs, likes)
    for number, part in enumerate([[request(1, "u1", 3)], [request(600, "u1", 4)], [request(2, "u2", 6)]]):
        (source / f"{number}.json").write_text("\n".join(json.dumps(r) for r in part))
        finish(stream_likes(stream_requests(spark, str(source)), folder, songs, str(tmp_path / "progress"), available_now=True, delay="1 hour"))
    assert rows(stored.read_table(spark, folder, "writes"), "request_id") == [(1,), (600,)]


def test_snapshots_that_the_stream_keeps(spark, tmp_path):
    """Equal to those made of all writes, whatever the micro-batches, at the ends of slices and over a restart."""
    users, songs, likes = tables(spark)
    folder = str(tmp_path / "tables")
    stored.start_tables(folder, users, songs, likes)
    minutes = [3, 9, 10, 11, 12, 29, 30, 31, 55, 61, 70, 130, 10, 30, 200]
    names = ["u1", "u2", "u3"]
    everything = [request(m, names[k % 3], 1 + k % 7, 1 + (k * 3) % 7) | {"request_id": 100 + k} for k, m in enumerate(minutes)]
    for batch_id, part in enumerate((everything[:5], everything[9:], everything[5:9])):
        path = tmp_path / f"part{batch_id}"
        path.mkdir()
        (path / "requests.json").write_text("\n".join(json.dumps(r) for r in part))
        apply_requests(folder, songs)(read_requests(spark, str(path)), batch_id)
        finish(stream_snapshots(spark, folder, str(tmp_path / "progress"), available_now=True))
    writes = stored.read_table(spark, folder, "writes")
    moments_agree(spark, folder, writes, ["2024-01-01 00:10:00", "2024-01-01 00:30:00", "2024-01-01 01:10:00", "2024-01-01 03:10:00", "2024-01-02 00:00:00"])
    slices = stream_recent_likes(spark, folder, "2024-01-01 01:10:00")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(slice" in slices
    try:
        stream_recent_likes(spark, folder, "2024-01-01 00:05:00")
        raise AssertionError("a moment within a slice was read")
    except ValueError:
        pass


def test_a_batch_reads_the_parts_of_its_keys_only(spark, tmp_path):
    users, songs, likes = tables(spark)
    folder = str(tmp_path / "tables")
    stored.start_tables(folder, users, songs, likes)
    keys = spark.createDataFrame([(2, 2), (2, 3), (9, 9)], "owner long, song_id long")
    found = stored.read_keys(spark, folder, "likes", keys)
    assert [(r["user_id"], r["song_id"]) for r in found.collect()] == [(2, 2)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    final = plan[plan.index("Final Plan"):plan.index("Initial Plan")].splitlines()
    scan = next(k for k, line in enumerate(final) if "FileScan" in line)
    assert "dynamicpruning" in final[scan]
    assert not any("Exchange" in line for line in final[:scan])  # stored rows are not shuffled


def test_tables_round_trip(spark, tmp_path):
    users, songs, likes = tables(spark)
    for name, rows_ in (("users", users), ("songs", songs), ("likes", likes)):
        append_rows(rows_, str(tmp_path / name))
    append_rows(likes, str(tmp_path / "likes"))
    loaded = load_tables(spark, str(tmp_path))
    assert loaded["likes"].count() == 4 and loaded["songs"].count() == 8
    assert [f.dataType for f in loaded["users"].schema] == [f.dataType for f in users.schema]
    assert REQUESTS.names == ["request_id", "ts", "user_id", "songs", "genre"]
