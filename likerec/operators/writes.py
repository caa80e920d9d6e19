"""Insert-if-absent writes, audits, deletes and table versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from likerec.schema import MAX_LENGTHS
from likerec.session import with_new_ids


def _moment(as_of: str | Column) -> Column:
    return (F.lit(as_of) if isinstance(as_of, str) else as_of).cast("timestamp_ntz")


def new_users(users: DataFrame, requests: DataFrame, as_of: str | Column, last_id: DataFrame | None = None) -> DataFrame:
    """Rows for requesting users that are not stored yet, numbered in the order of their id.

    Numbers follow the largest ``id`` of ``last_id``, or else of ``users``.
    """
    absent = requests.select("user_id").distinct().join(users.select("user_id"), "user_id", "left_anti")
    return with_new_ids(absent, users if last_id is None else last_id, "user_id").select(
        "id", "user_id",
        F.lit(None).cast("string").alias("name"),
        F.lit(None).cast("string").alias("email"),
        _moment(as_of).alias("created_at"),
        _moment(as_of).alias("updated_at"),
    )


def upsert_users(users: DataFrame, requests: DataFrame, as_of: str | Column) -> DataFrame:
    """Stored users, untouched, plus the new ones."""
    return users.unionByName(new_users(users, requests, as_of))


def new_songs(songs: DataFrame, resolved: DataFrame, as_of: str | Column, last_id: DataFrame | None = None) -> DataFrame:
    """Rows for resolved songs whose video id is not stored yet. Genre and tags stay null.

    Of several descriptions of one video the smallest (title, artist) is kept.
    """
    absent = (
        resolved.groupBy("video_id")
        .agg(F.min(F.struct("title", "artist")).alias("d"))
        .join(songs.select("video_id"), "video_id", "left_anti")
        .select("video_id", "d.title", "d.artist")
    )
    return with_new_ids(absent, songs if last_id is None else last_id, "video_id").select(
        "id", "video_id", "title", "artist",
        F.lit(None).cast("string").alias("genre"),
        F.lit(None).cast("string").alias("tags"),
        _moment(as_of).alias("updated_at"),
    )


def upsert_songs(songs: DataFrame, resolved: DataFrame, as_of: str | Column) -> DataFrame:
    """Stored songs, never updated, plus the new ones."""
    return songs.unionByName(new_songs(songs, resolved, as_of))


def new_likes(likes: DataFrame, pairs: DataFrame, as_of: str | Column | None = None) -> DataFrame:
    """The (user_id, song_id) pairs that are not liked yet, each once.

    They are dated ``as_of``, or else at the earliest ``created_at`` of the pair.
    """
    moment = F.min("created_at") if as_of is None else F.min(_moment(as_of))
    return (
        pairs.groupBy("user_id", "song_id").agg(moment.alias("created_at"))
        .join(likes.select("user_id", "song_id"), ["user_id", "song_id"], "left_anti")
    )


def append_likes(likes: DataFrame, pairs: DataFrame, as_of: str | Column | None = None) -> DataFrame:
    """Stored likes plus the missing ones; applying it twice changes nothing."""
    return likes.select("user_id", "song_id", "created_at").unionByName(new_likes(likes, pairs, as_of))


def purge(table: DataFrame, likes: DataFrame, ids: DataFrame, likes_key: str) -> tuple[DataFrame, DataFrame]:
    """Remove rows by ``id`` together with their likes.

    ``likes_key`` is ``user_id`` for users and ``song_id`` for songs.
    """
    gone = ids.select("id").distinct()
    return (
        table.join(gone, "id", "left_anti"),
        likes.join(gone.withColumnRenamed("id", likes_key), likes_key, "left_anti"),
    )


def migrate_users(users: DataFrame, direction: str, as_of: str | Column = "1970-01-01 00:00:00") -> DataFrame:
    """Add (``up``) or drop (``down``) name, email and updated_at."""
    if direction == "up":
        return users.select(
            "id", "user_id",
            F.lit(None).cast("string").alias("name"),
            F.lit(None).cast("string").alias("email"),
            "created_at",
            _moment(as_of).alias("updated_at"),
        )
    if direction == "down":
        return users.select("id", "user_id", "created_at")
    raise ValueError(f"unknown direction: {direction}")


def too_long_for_first_version(users: DataFrame, max_length: int = 128) -> DataFrame:
    """Users whose external id would not fit the older, shorter column."""
    return users.where(F.length("user_id") > max_length)


def _violation(table: str, rule: str, rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("violations")).select(
        F.lit(table).alias("table_name"), F.lit(rule).alias("rule"), "violations")


def audit_constraints(users: DataFrame, songs: DataFrame, likes: DataFrame) -> DataFrame:
    """(table_name, rule, violations) for every declared rule, zero where it holds.

    Null and length rules of a table are counted in one pass; keys that occur more than once and
    likes without a user or a song are counted by aggregates and anti joins. Null keys break the
    not-null rules only.
    """
    required = {
        "users": (users, ["id", "user_id", "created_at", "updated_at"]),
        "songs": (songs, ["id", "video_id", "title", "artist", "updated_at"]),
        "likes": (likes, ["user_id", "song_id", "created_at"]),
    }
    report = []
    for name, (table, columns) in required.items():
        rules = [(f"{c} not null", F.col(c).isNull()) for c in columns]
        rules += [(f"{c} at most {n}", F.length(c) > n) for c, n in MAX_LENGTHS.get(name, {}).items()]
        counts = table.agg(*[F.count_if(broken).alias(rule) for rule, broken in rules])
        pairs = F.array(*[F.struct(F.lit(rule).alias("rule"), F.col(f"`{rule}`").alias("violations")) for rule, _ in rules])
        report.append(counts.select(F.lit(name).alias("table_name"), F.explode(pairs).alias("p")).select(
            "table_name", "p.rule", "p.violations"))
    keys = [("users", users, ["id"]), ("users", users, ["user_id"]), ("songs", songs, ["id"]),
            ("songs", songs, ["video_id"]), ("likes", likes, ["user_id", "song_id"])]
    for name, table, columns in keys:
        repeated = table.dropna(subset=columns).groupBy(*columns).count().where(F.col("count") > 1)
        report.append(_violation(name, f"{', '.join(columns)} unique", repeated))
    for column, parent in (("user_id", users), ("song_id", songs)):
        # Orphans are counted per key, so a hot key meets its parent once.
        per_key = likes.dropna(subset=[column]).groupBy(column).count()
        orphans = per_key.join(parent.select(F.col("id").alias(column)), column, "left_anti")
        report.append(orphans.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("violations")).select(
            F.lit("likes").alias("table_name"), F.lit(f"{column} refers to a row").alias("rule"), "violations"))
    result = report[0]
    for part in report[1:]:
        result = result.unionByName(part)
    return result
