"""Table shapes. Ids are long, times are naive UTC (``timestamp_ntz``)."""

from __future__ import annotations

from pyspark.sql import types as T

USERS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("user_id", T.StringType(), False),
    T.StructField("name", T.StringType(), True),
    T.StructField("email", T.StringType(), True),
    T.StructField("created_at", T.TimestampNTZType(), False),
    T.StructField("updated_at", T.TimestampNTZType(), False),
])

SONGS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("video_id", T.StringType(), False),
    T.StructField("title", T.StringType(), False),
    T.StructField("artist", T.StringType(), False),
    T.StructField("genre", T.StringType(), True),
    T.StructField("tags", T.StringType(), True),
    T.StructField("updated_at", T.TimestampNTZType(), False),
])

# (user_id, song_id) is the key; a surrogate ``id`` column is optional and kept when present.
LIKES = T.StructType([
    T.StructField("user_id", T.LongType(), False),
    T.StructField("song_id", T.LongType(), False),
    T.StructField("created_at", T.TimestampNTZType(), False),
])

REQUESTS = T.StructType([
    T.StructField("request_id", T.LongType(), False),
    T.StructField("ts", T.TimestampNTZType(), False),
    T.StructField("user_id", T.StringType(), True),
    T.StructField("songs", T.ArrayType(T.StringType()), True),
    T.StructField("genre", T.StringType(), True),
])

SEARCH_RESPONSE = T.StructType([
    T.StructField("items", T.ArrayType(T.StructType([
        T.StructField("id", T.StructType([T.StructField("videoId", T.StringType())])),
        T.StructField("snippet", T.StructType([
            T.StructField("title", T.StringType()),
            T.StructField("channelTitle", T.StringType()),
        ])),
    ]))),
])

TABLES = {"users": USERS, "songs": SONGS, "likes": LIKES}

# Longest accepted text per column, as the tables declare it.
MAX_LENGTHS = {
    "users": {"user_id": 255, "name": 255, "email": 255},
    "songs": {"video_id": 64, "title": 512, "artist": 256, "genre": 128},
}
