"""Operators give the same rows with and without generated code."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from likerec.functions.text import normalize_query
from likerec.operators import colikes, ingest, lookup, popularity, textvectors, writes
from likerec.plans import content, hybrid, serving
from likerec.session import materialize
from tests.conftest import LIKES, REQUESTS, SONGS, USERS

NOW = datetime.datetime(2024, 1, 1)


def tables(spark):
    rng = random.Random(3)
    words = ["red", "blue", "night", "bus", "river", "stone", "the", "and"]
    songs = [(k, f"v{k}", " ".join(rng.sample(words, 2)), rng.choice(["Ann", "Bo"]), rng.choice(["Pop", "Folk", None]),
              rng.choice(["slow, old", None]), NOW + datetime.timedelta(minutes=k % 5)) for k in range(1, 31)]
    users = [(k, f"u{k}", None, None, NOW, NOW) for k in range(1, 13)]
    likes = sorted({(rng.randint(1, 10), rng.randint(1, 32)) for _ in range(90)})  # some songs are gone
    requests = [(k, NOW + datetime.timedelta(minutes=k), f"u{rng.randint(1, 14)}",
                 [f"{rng.choice(songs)[2]} - {rng.choice(['ann', 'BO'])}", "???"], "pop") for k in range(20)]
    return (spark.createDataFrame(users, USERS), spark.createDataFrame(songs, SONGS),
            spark.createDataFrame([(u, s, NOW) for u, s in likes], LIKES), spark.createDataFrame(requests, REQUESTS))


def runs(spark):
    users, songs, likes, requests = tables(spark)
    accepted, _ = ingest.validate_requests(requests)
    resolved = materialize(ingest.resolve_songs(ingest.explode_requests(accepted), songs))
    documents = content.song_documents(songs)
    tf = materialize(textvectors.document_terms(documents))
    return {
        "normalized": songs.select("id", normalize_query(F.col("title"))),
        "liked": lookup.liked_songs(users, likes, songs),
        "history": lookup.user_history(users, likes, songs),
        "similar": colikes.similar_users(likes, block_fans=3),
        "collaborative": colikes.collaborative_suggestions(likes, songs, block_fans=3),
        "popular": popularity.popular_by_genre(likes, songs),
        "terms": tf,
        "tfidf": textvectors.tfidf(tf, materialize(textvectors.idf(tf, 30))).withColumn("weight", F.round("weight", 9)),
        "content": content.content_suggestions(likes, songs, pool=20).withColumn("score", F.round("score", 9)),
        "shared": content.content_suggestions(likes, songs, pool=20, corpus="shared").withColumn("score", F.round("score", 9)),
        "suggest": hybrid.suggest(users, likes, songs).withColumn("score", F.round("score", 9)),
        "resolved": resolved.select("request_id", "position", "video_id"),
        "new_likes": hybrid.store_requests(requests, users, songs, likes, songs, "2024-02-01").new_likes,
        "audit": writes.audit_constraints(users, songs, likes),
        "snapshot": serving.recent_likes_snapshot(serving.request_song_ids(accepted, resolved, songs), "2024-01-01 00:15:00"),
    }


@pytest.fixture(scope="module")
def both(spark):
    found = []
    for setting in ("true", "false"):
        spark.conf.set("spark.sql.codegen.wholeStage", setting)
        found.append({name: sorted((tuple(r) for r in df.collect()), key=repr) for name, df in runs(spark).items()})
    return found


def test_same_rows_with_and_without_generated_code(both):
    for name, rows in both[0].items():
        assert rows == both[1][name], name
        assert rows or name == "snapshot", name
