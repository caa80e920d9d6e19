"""Content first, then collaborative, then popular songs; and the whole request flow."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from likerec.functions.suggestions import to_suggestions
from likerec.operators.colikes import collaborative_suggestions
from likerec.operators.ingest import explode_requests, resolve_songs, validate_requests
from likerec.operators.popularity import popular_for_requests
from likerec.operators.writes import new_likes, new_songs, new_users
from likerec.plans.content import content_suggestions
from likerec.session import materialize

ORDER = ("content", "collaborative", "popular")
_COLUMNS = ("user_id", "rank", "song_id", "video_id", "title", "artist", "score", "source")


def branch(source: str, targets: DataFrame, likes: DataFrame, songs: DataFrame, k: int, options: dict,
            everyone: bool) -> DataFrame:
    """One kind of suggestion for the users in ``targets`` (user_id, genre)."""
    wanted = None if everyone else targets
    if source == "content":
        rows = content_suggestions(likes, songs, k, wanted=wanted, **options)
    elif source == "collaborative":
        rows = collaborative_suggestions(likes, songs, k, wanted=wanted).withColumn(
            "score", F.col("n_users").cast("double"))
    elif source == "popular":
        rows = popular_for_requests(targets, likes, songs, k)
    else:
        raise ValueError(f"unknown source: {source}")
    return rows.withColumn("source", F.lit(source)).select(*_COLUMNS)


def _first_non_empty(targets: DataFrame, likes: DataFrame, songs: DataFrame, k: int, order: Sequence[str],
                     options: dict, everyone: bool) -> DataFrame:
    """The first source in ``order`` that has rows, per user. Each later source only sees the
    users that still have none, and is left out when there are no such users."""
    remaining, result = targets, None
    for position, source in enumerate(order):
        rows = materialize(branch(source, remaining, likes, songs, k, options, everyone and position == 0))
        result = rows if result is None else result.unionByName(rows)
        if position + 1 == len(order):
            break
        remaining = materialize(remaining.join(rows.select("user_id").distinct(), "user_id", "left_anti"))
        if remaining.isEmpty():
            break
    return result


def _combined(targets: DataFrame, likes: DataFrame, songs: DataFrame, k: int, order: Sequence[str],
              options: dict, everyone: bool) -> DataFrame:
    """All sources together: each video once, from the first source that has it, then the best ``k``."""
    parts = [
        branch(source, targets, likes, songs, k, options, everyone).withColumn("place", F.lit(position))
        for position, source in enumerate(order)
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    best = Window.partitionBy("user_id", "video_id").orderBy("place", "rank")
    listed = Window.partitionBy("user_id").orderBy("place", "rank")
    return (
        rows.withColumn("n", F.row_number().over(best)).where(F.col("n") == 1)
        .withColumn("rank", F.row_number().over(listed)).where(F.col("rank") <= k)
        .select(*_COLUMNS)
    )


def suggest(users: DataFrame, likes: DataFrame, songs: DataFrame, requests: DataFrame | None = None, k: int = 10,
            order: Sequence[str] = ORDER, combine: bool = False, **content_options) -> DataFrame:
    """Up to ``k`` suggestions per user: user_id (external), rank, title, artist,
    youtube_video_id, score, source.

    ``requests`` is (user_id, genre) with one row per user; without it all users are served and
    no genre is asked for. By default a user gets the rows of the first source in ``order`` that
    has any; with ``combine`` the sources are merged.
    """
    if requests is None:
        targets = users.select(F.col("id").alias("user_id"), F.lit(None).cast("string").alias("genre"))
    else:
        targets = materialize(
            users.select("id", "user_id").join(requests.select("user_id", "genre"), "user_id")
            .select(F.col("id").alias("user_id"), "genre"))
    choose = _combined if combine else _first_non_empty
    rows = choose(targets, likes, songs, k, order, content_options, requests is None)
    names = users.select(F.col("id").alias("user_id"), F.col("user_id").alias("external_id"))
    named = rows.join(names, "user_id").select(F.col("external_id").alias("user_id"), *_COLUMNS[1:])
    return to_suggestions(named.drop("song_id"))


def collaborative_or_popular(users: DataFrame, likes: DataFrame, songs: DataFrame,
                             requests: DataFrame | None = None, k: int = 10) -> DataFrame:
    """The two fallbacks alone."""
    return suggest(users, likes, songs, requests, k, order=("collaborative", "popular"))


@dataclass(frozen=True)
class Processed:
    """What a batch of requests leads to. The tables are given as the rows to add."""

    rejected: DataFrame
    resolved: DataFrame
    new_users: DataFrame
    new_songs: DataFrame
    new_likes: DataFrame


def store_requests(requests: DataFrame, users: DataFrame, songs: DataFrame, likes: DataFrame, catalog: DataFrame,
                   as_of: str | Column, like_time: str | Column | None = None, resolved: DataFrame | None = None,
                   last_ids: dict[str, DataFrame] | None = None) -> Processed:
    """Validate, resolve, and work out the users, songs and likes to add.

    Only the rows to add are materialized; the stored tables are scanned. They may be parts that hold all keys of
    the requests; new ids then follow ``last_ids`` (``id`` of users and of songs). ``resolved`` saves resolving again.
    """
    accepted, rejected = validate_requests(requests)
    if resolved is None:
        resolved = materialize(resolve_songs(explode_requests(accepted), catalog))
    last_ids = last_ids or {}
    songs_to_add = materialize(new_songs(songs, resolved, as_of, last_ids.get("songs")))
    users_to_add = materialize(new_users(users, accepted, as_of, last_ids.get("users")))
    song_ids = songs.select("id", "video_id").unionByName(songs_to_add.select("id", "video_id"))
    user_ids = users.select("id", "user_id").unionByName(users_to_add.select("id", "user_id"))
    pairs = (
        resolved.groupBy("user_id", "video_id").agg(F.min("ts").alias("created_at"))
        .join(song_ids.withColumnRenamed("id", "song_id"), "video_id")
        .join(user_ids.withColumnRenamed("id", "owner"), "user_id")
        .select(F.col("owner").alias("user_id"), "song_id", "created_at")
    )
    return Processed(rejected, resolved, users_to_add, songs_to_add, materialize(new_likes(likes, pairs, like_time)))


def latest_genres(requests: DataFrame) -> DataFrame:
    """(user_id, genre) of each user's latest request."""
    return requests.groupBy("user_id").agg(F.max_by("genre", F.struct("ts", "request_id")).alias("genre"))


def process_requests(requests: DataFrame, users: DataFrame, songs: DataFrame, likes: DataFrame, catalog: DataFrame,
                     as_of: str | Column, k: int = 10, **content_options) -> tuple[Processed, DataFrame]:
    """The whole flow for a batch: what to add to the tables, and suggestions for every
    requesting user with the new likes already counted."""
    done = store_requests(requests, users, songs, likes, catalog, as_of, as_of)
    accepted, _ = validate_requests(requests)
    all_likes = likes.select("user_id", "song_id", "created_at").unionByName(done.new_likes)
    suggestions = suggest(users.unionByName(done.new_users), all_likes, songs.unionByName(done.new_songs),
                          latest_genres(accepted), k, **content_options)
    return done, suggestions
