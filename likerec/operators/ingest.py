"""Requests: validation, flattening, search responses, resolution of names to songs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from likerec.functions.text import normalize_query
from likerec.operators.search import closest_forms, name_forms
from likerec.schema import SEARCH_RESPONSE
from likerec.session import materialize

MAX_USER_ID = 255
MAX_SONGS = 50
MAX_GENRE = 128


def check_requests(requests: DataFrame, min_user_id: int = 0) -> DataFrame:
    """Requests with ``reason``: null for valid ones, else the first rule that fails.

    Writes accept an empty user id; reads need one character (``min_user_id=1``).
    """
    user, songs, genre = F.col("user_id"), F.col("songs"), F.col("genre")
    reason = (
        F.when(user.isNull(), "user_id missing")
        .when(F.length(user) < min_user_id, "user_id too short")
        .when(F.length(user) > MAX_USER_ID, "user_id too long")
        .when(songs.isNull(), "songs missing")
        .when(F.size(songs) < 1, "no songs")
        .when(F.size(songs) > MAX_SONGS, "too many songs")
        .when(F.exists(songs, lambda s: s.isNull()), "song missing")
        .when(F.length(genre) > MAX_GENRE, "genre too long")
    )
    return requests.withColumn("reason", reason)


def validate_requests(requests: DataFrame, min_user_id: int = 0) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected); the rejected rows keep their ``reason``."""
    checked = check_requests(requests, min_user_id)
    return checked.where(F.col("reason").isNull()).drop("reason"), checked.where(F.col("reason").isNotNull())


def explode_requests(requests: DataFrame) -> DataFrame:
    """One row per requested song, with its position from 0 and its search form."""
    others = [c for c in requests.columns if c != "songs"]
    return requests.select(*others, F.posexplode("songs").alias("position", "song_name")).withColumn(
        "query", normalize_query(F.col("song_name")))


def parse_search_responses(responses: DataFrame, mode: str = "first") -> DataFrame:
    """Songs found in stored search responses (``response_id``, ``body`` as JSON text).

    ``first`` takes the first item, if there is one and nothing is missing from it; ``all``
    takes every item that has a video id and gives each a score of 1.
    """
    body = responses.select("response_id", F.from_json("body", SEARCH_RESPONSE).alias("r"))
    if mode == "first":
        found = body.select("response_id", F.lit(0).alias("position"), F.try_element_at("r.items", F.lit(1)).alias("i"))
        whole = F.col("i.id.videoId").isNotNull() & F.col("i.snippet.title").isNotNull()
        found = found.where(whole & F.col("i.snippet.channelTitle").isNotNull())
        score = []
    elif mode == "all":
        found = body.select("response_id", F.posexplode("r.items").alias("position", "i"))
        found = found.where(F.col("i.id.videoId").isNotNull())
        score = [F.lit(1.0).alias("score")]
    else:
        raise ValueError(f"unknown mode: {mode}")
    return found.select(
        "response_id", "position",
        F.col("i.id.videoId").alias("video_id"),
        F.col("i.snippet.title").alias("title"),
        F.col("i.snippet.channelTitle").alias("artist"),
        *score,
    )


def resolve_songs(names: DataFrame, catalog: DataFrame, keep_unresolved: bool = False, similarity: float | None = None) -> DataFrame:
    """``names`` (with a ``song_name`` column) plus query, video_id, title, artist of the best song.

    Names are normalized and looked up once per distinct spelling, so a name that fills a third
    of the input costs one lookup. The answers are sent to the names when they are few.
    With ``similarity`` a name that no song has in equal form finds the closest one of at least that
    similarity, and the rows have its ``score`` (1 for an equal form).
    """
    details = catalog.select(F.col("id").alias("catalog_id"), "video_id", "title", "artist")
    spellings = names.select("song_name").distinct().withColumn("query", normalize_query(F.col("song_name")))
    asked = spellings.where(F.col("query").isNotNull())
    if similarity is None:
        found = name_forms(catalog).select(F.col("form").alias("query"), F.col("id").alias("catalog_id"))
    else:
        spellings = materialize(spellings)
        asked = spellings.where(F.col("query").isNotNull())
        found = closest_forms(asked, name_forms(catalog), similarity).withColumnRenamed("id", "catalog_id")
    hits = asked.join(found, "query").join(details, "catalog_id").drop("catalog_id")
    if keep_unresolved:
        hits = spellings.join(hits.drop("query"), "song_name", "left")
    answers = materialize(hits)
    return names.drop("query").join(answers, "song_name", "left" if keep_unresolved else "inner")
