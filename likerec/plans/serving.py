"""Time-limited snapshots: recent likes per user, reports served from them, reusable searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from likerec.functions.suggestions import to_liked_rows
from likerec.operators.lookup import liked_songs
from likerec.session import materialize

SNAPSHOT_SECONDS = 3600
HIT_SECONDS = 7 * 24 * 3600
EMPTY_SECONDS = 24 * 3600

# Characters of a time's text that name the bucket it lies in.
BUCKETS = {"day": 10, "hour": 13, "minute": 16}


def _moment(as_of: str | Column) -> Column:
    return (F.lit(as_of) if isinstance(as_of, str) else as_of).cast("timestamp_ntz")


def _later(moment: Column, seconds: Column | int) -> Column:
    seconds = F.lit(seconds) if isinstance(seconds, int) else seconds
    return moment + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))


def recent_likes_snapshot(writes: DataFrame, as_of: str | Column, ttl: int = SNAPSHOT_SECONDS) -> DataFrame:
    """(user_id, song_ids, ts): what the latest request of each user liked, while it is fresh.

    ``writes`` is (request_id, ts, user_id, song_ids), one row per request, with at most as many
    ids as a request may hold. An empty list counts as a snapshot too. Only the latest row per
    user leaves each task.
    """
    moment = _moment(as_of)
    return (
        writes.where((F.col("ts") <= moment) & (_later(F.col("ts"), ttl) > moment))
        .groupBy("user_id")
        .agg(F.max_by(F.struct("song_ids", "ts"), F.struct("ts", "request_id")).alias("s"))
        .select("user_id", "s.song_ids", "s.ts")
    )


def request_song_ids(requests: DataFrame, resolved: DataFrame, songs: DataFrame) -> DataFrame:
    """(request_id, ts, user_id, song_ids): the distinct stored songs each request resolved to.

    A request holds at most 50 names, so its list is bounded.
    """
    ids = (
        resolved.select("request_id", "video_id")
        .join(songs.select("video_id", F.col("id").alias("song_id")), "video_id")
        .groupBy("request_id")
        .agg(F.array_sort(F.collect_set("song_id")).alias("song_ids"))
    )
    return requests.select("request_id", "ts", "user_id").join(ids, "request_id", "left").withColumn(
        "song_ids", F.coalesce("song_ids", F.array().cast("array<bigint>")))


def liked_songs_as_served(wanted: DataFrame, snapshot: DataFrame, users: DataFrame, likes: DataFrame,
                          songs: DataFrame) -> DataFrame:
    """Liked songs of the ``wanted.user_id``: from the snapshot where there is one, else in full.

    Snapshot rows carry ``from_cache`` instead of a time, and song ids that are gone are
    skipped.
    """
    asked = wanted.select("user_id").distinct()
    snapshot = materialize(snapshot)
    hits = snapshot.join(asked, "user_id", "left_semi")
    cached = (
        hits.select("user_id", F.explode("song_ids").alias("id"))
        .join(songs.select("id", "video_id", "title", "artist"), "id")
        .select("user_id", "video_id", "title", "artist", F.lit("from_cache").alias("created_at"))
    )
    misses = asked.join(hits, "user_id", "left_anti")
    full = to_liked_rows(liked_songs(users, likes, songs, wanted=misses, ordered=False))
    return cached.unionByName(full)


def still_valid(answered: DataFrame) -> DataFrame:
    """Searches with their latest lookup as ``answer`` (lookup_ts, hit), which is cleared where its time is over."""
    ttl = F.when(F.col("answer.hit"), HIT_SECONDS).otherwise(EMPTY_SECONDS)
    valid = F.col("ts") < _later(F.col("answer.lookup_ts"), ttl)
    return answered.select(
        "request_id", "position", "ts", "query",
        F.when(valid, F.col("answer.lookup_ts")).alias("lookup_ts"),
        F.when(valid, F.col("answer.hit")).alias("hit"),
    )


def reusable_searches(searches: DataFrame, lookups: DataFrame, bucket: str = "minute") -> DataFrame:
    """Each search with the earlier lookup that can answer it, if any.

    ``searches`` is (request_id, position, ts, query), ``lookups`` (query, ts, hit). The latest
    lookup of the query at or before the search counts; it stays valid for 7 days if it hit and
    for 1 day if it was empty. Gives lookup_ts and hit, null when a new search is needed.

    Both inputs are put on one time line per query instead of being joined with each other. The
    line is cut into buckets so that a query that fills a third of the input spreads over many
    tasks: inside a bucket the last lookup is carried forward row by row, and across buckets a
    small table with one row per query and bucket does the same.
    """
    line = searches.select(
        "query", "ts", F.lit(1).alias("is_search"), "request_id", "position",
        F.lit(None).cast("struct<lookup_ts:timestamp_ntz,hit:boolean>").alias("lookup"),
    ).unionByName(
        lookups.select(
            "query", "ts", F.lit(0).alias("is_search"),
            F.lit(None).cast("bigint").alias("request_id"), F.lit(None).cast("int").alias("position"),
            F.struct(F.col("ts").alias("lookup_ts"), "hit").alias("lookup"),
        )
    ).where(F.col("query").isNotNull()).withColumn("bucket", F.substring(F.col("ts").cast("string"), 1, BUCKETS[bucket]))

    per_bucket = line.groupBy("query", "bucket").agg(F.max("lookup").alias("last"))
    earlier = Window.partitionBy("query").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_bucket.select(
        "query", "bucket", F.last("last", ignorenulls=True).over(earlier).alias("carried"))
    # Lookups sort before searches of the same moment.
    so_far = (
        Window.partitionBy("query", "bucket").orderBy("ts", "is_search", "lookup.hit")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    answered = (
        line.withColumn("inside", F.last("lookup", ignorenulls=True).over(so_far))
        .where(F.col("is_search") == 1)
        .join(carried, ["query", "bucket"], "left")
        .withColumn("answer", F.coalesce("inside", "carried"))
    )
    return still_valid(answered)
