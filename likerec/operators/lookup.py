"""Lookups by key, liked-song reports and the candidate pool."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SONG_COLUMNS = ("video_id", "title", "artist", "genre", "tags")


def find_users(users: DataFrame, wanted: DataFrame) -> DataFrame:
    """Users whose external id is in ``wanted.user_id``; unknown ids give no row."""
    return users.join(wanted.select("user_id"), "user_id", "left_semi")


def _likes_of(likes: DataFrame, users: DataFrame, wanted: DataFrame | None) -> DataFrame:
    """Likes with the owner's external id, of all users or of the wanted ones only."""
    owners = users if wanted is None else find_users(users, wanted)
    return likes.select(
        F.col("user_id").alias("owner_id"), "song_id", F.col("created_at").alias("liked_at")
    ).join(owners.select(F.col("id").alias("owner_id"), "user_id"), "owner_id")


def liked_songs(users: DataFrame, likes: DataFrame, songs: DataFrame,
                wanted: DataFrame | None = None, ordered: bool = True) -> DataFrame:
    """Each user's liked songs, newest like first, ties by song id; a user's rows lie together."""
    rows = _likes_of(likes, users, wanted).join(
        songs.select(F.col("id").alias("song_id"), "video_id", "title", "artist"), "song_id"
    ).select("user_id", "song_id", "video_id", "title", "artist", F.col("liked_at").alias("created_at"))
    return rows.repartition("user_id").sortWithinPartitions("user_id", F.desc("created_at"), "song_id") if ordered else rows


def user_history(users: DataFrame, likes: DataFrame, songs: DataFrame,
                 wanted: DataFrame | None = None, ordered: bool = True) -> DataFrame:
    """Every song column of each user's likes, in song order; a user's rows lie together."""
    rows = _likes_of(likes, users, wanted).join(
        songs.select(F.col("id").alias("song_id"), *SONG_COLUMNS), "song_id"
    ).select("user_id", "song_id", *SONG_COLUMNS)
    return rows.repartition("user_id").sortWithinPartitions("user_id", "song_id") if ordered else rows


def songs_by_ids(songs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Songs whose id is in ``wanted.song_id``; unknown ids are silently absent."""
    return songs.join(wanted.select(F.col("song_id").alias("id")), "id", "left_semi")


def candidate_songs(songs: DataFrame, limit: int = 1000) -> DataFrame:
    """The most recently updated songs, ties by id. Spark keeps ``limit`` rows per task only."""
    return songs.orderBy(F.desc("updated_at"), "id").limit(limit)


def liked_song_ids(likes: DataFrame) -> DataFrame:
    """The set of song ids of each user, one row per member.

    The set stays a relation: an array per user would collect an unbounded group in one row.
    """
    return likes.select("user_id", "song_id").distinct()
