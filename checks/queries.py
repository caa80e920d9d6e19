"""The registered queries: every operator on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from likerec.functions import suggestions as shapes
from likerec.functions.text import normalize_query
from likerec.operators import colikes, ingest, lookup, popularity, profiles, textvectors, writes
from likerec.plans import content, fusion, hybrid, serving
from likerec.session import materialize, scratch_folder, shuffle_width, tune
from likerec.sources import tables
from likerec.sources import testtables as fx
from likerec.streaming import likes as likes_stream
from likerec.streaming import searches as searches_stream
from likerec.streaming import tables as stored

# Fixed moments of the checks.
AS_OF = "2024-02-01 00:00:00"
SNAPSHOT_AS_OF = "2024-01-30 12:00:00"


class Inputs:
    """The test tables as lazy DataFrames."""

    def __init__(self, spark, folder):
        self.spark, self.folder = tune(spark), folder

    users = property(lambda self: fx.users(self.spark, self.folder))
    songs = property(lambda self: fx.songs(self.spark, self.folder))
    likes = property(lambda self: fx.likes(self.spark, self.folder))
    # For queries that scan the likes more than once: derived once and stored, as a table would be.
    like_table = property(lambda self: materialize(self.likes))
    requests = property(lambda self: fx.requests(self.spark, self.folder))
    request_table = property(
        lambda self: materialize(self.requests.repartition(shuffle_width(self.spark), "request_id")))
    documents = property(lambda self: fx.documents(self.spark, self.folder))

    catalog = property(lambda self: fx.catalog(self.spark, self.folder))

    def items(self, requests=None):
        accepted, _ = ingest.validate_requests(self.requests if requests is None else requests)
        return ingest.explode_requests(accepted)

    def request_writes(self):
        """(request_id, ts, user_id, song_ids) of every accepted request, and all songs then stored."""
        requests = self.request_table
        accepted, _ = ingest.validate_requests(requests)
        done = hybrid.store_requests(requests, self.users, self.songs, self.likes, self.catalog, AS_OF, AS_OF)
        stored = self.songs.unionByName(done.new_songs)
        return serving.request_song_ids(accepted, done.resolved, stored), stored


def scan_users(spark, folder):
    return Inputs(spark, folder).users


def scan_songs(spark, folder):
    return Inputs(spark, folder).songs


def scan_likes(spark, folder):
    return Inputs(spark, folder).likes


def scan_requests(spark, folder):
    return Inputs(spark, folder).requests


def find_users(spark, folder):
    t = Inputs(spark, folder)
    return lookup.find_users(t.users, t.requests)


def liked_songs(spark, folder):
    t = Inputs(spark, folder)
    return lookup.liked_songs(t.users, t.likes, t.songs)


def liked_songs_of_requesters(spark, folder):
    t = Inputs(spark, folder)
    return lookup.liked_songs(t.users, t.likes, t.songs, wanted=t.requests)


def user_history(spark, folder):
    t = Inputs(spark, folder)
    return lookup.user_history(t.users, t.likes, t.songs)


def songs_by_ids(spark, folder):
    t = Inputs(spark, folder)
    return lookup.songs_by_ids(t.songs, t.requests.select(F.col("request_id").alias("song_id")))


def candidate_songs(spark, folder):
    return lookup.candidate_songs(Inputs(spark, folder).songs)


def liked_song_ids(spark, folder):
    return lookup.liked_song_ids(Inputs(spark, folder).likes)


def similar_users(spark, folder):
    return colikes.similar_users(Inputs(spark, folder).like_table)


def similar_users_of_requesters(spark, folder):
    t = Inputs(spark, folder)
    wanted = lookup.find_users(t.users, t.requests).select(F.col("id").alias("user_id"))
    return colikes.similar_users(t.like_table, min_common=3, wanted=wanted)


def collaborative_suggestions(spark, folder):
    t = Inputs(spark, folder)
    return colikes.collaborative_suggestions(t.like_table, t.songs)


def collaborative_suggestions_spread(spark, folder):
    """With the fans of every song cut into many blocks."""
    t = Inputs(spark, folder)
    return colikes.collaborative_suggestions(t.like_table, t.songs, block_fans=8)


def _refreshed(spark, folder):
    """Pairs and suggestions of the likes before a moment, refreshed by the likes since."""
    t = Inputs(spark, folder)
    likes = t.like_table
    new = F.col("created_at") >= F.lit("1998-07-01").cast("timestamp_ntz")
    old = materialize(likes.where(~new))
    pairs = materialize(colikes.similar_users(old))
    tops = materialize(colikes.collaborative_suggestions(old, t.songs, pairs=pairs))
    pairs, touched = colikes.refresh_similar_users(pairs, likes, likes.where(new))
    pairs = materialize(pairs)
    return pairs, colikes.refresh_suggestions(tops, pairs, touched, likes, t.songs)


def similar_users_refreshed(spark, folder):
    return _refreshed(spark, folder)[0]


def collaborative_suggestions_refreshed(spark, folder):
    return _refreshed(spark, folder)[1]


def table_append_and_read(spark, folder):
    """Likes written in two appends and read back with the fixed schema."""
    t = Inputs(spark, folder)
    path = scratch_folder(spark, "tables")
    early = F.col("created_at") < F.lit("1998-01-01").cast("timestamp_ntz")
    for part in (t.likes.where(early), t.likes.where(~early)):
        tables.append_rows(part, f"{path}/likes")
    return tables.load_table(spark, path, "likes")


def validate_requests(spark, folder):
    return ingest.check_requests(Inputs(spark, folder).requests).select("request_id", "reason")


def validate_reads(spark, folder):
    return ingest.check_requests(Inputs(spark, folder).requests, min_user_id=1).select("request_id", "reason")


def explode_requests(spark, folder):
    return Inputs(spark, folder).items().drop("genre")


def normalize_texts(spark, folder):
    return Inputs(spark, folder).documents.select("doc_id", normalize_query(F.col("text")).alias("query"))


def search_responses_first(spark, folder):
    return ingest.parse_search_responses(fx.responses(Inputs(spark, folder).songs), "first")


def search_responses_all(spark, folder):
    return ingest.parse_search_responses(fx.responses(Inputs(spark, folder).songs), "all")


def resolve_songs(spark, folder):
    t = Inputs(spark, folder)
    resolved = ingest.resolve_songs(t.items(), t.catalog, keep_unresolved=True)
    return resolved.select("request_id", "position", "query", "video_id", "title", "artist")


def resolve_misspelled_songs(spark, folder):
    """Every requested name without one of its characters, searched by similarity."""
    t = Inputs(spark, folder)
    resolved = ingest.resolve_songs(fx.misspelled(t.items()), t.catalog, keep_unresolved=True, similarity=0.6)
    return resolved.select("request_id", "position", "song_name", "video_id", F.round("score", 6).alias("score"))


def feature_text(spark, folder):
    return content.song_documents(Inputs(spark, folder).songs)


def feature_text_weighted(spark, folder):
    return content.song_documents(Inputs(spark, folder).songs, "weighted")


def song_tokens(spark, folder):
    return textvectors.tokenize(content.song_documents(Inputs(spark, folder).songs))


def document_term_counts(spark, folder):
    return textvectors.document_terms(Inputs(spark, folder).documents)


def song_idf(spark, folder):
    songs = Inputs(spark, folder).songs
    result = textvectors.idf(content.song_term_counts(songs), songs.count())
    return result.withColumn("idf", F.round("idf", 6))


def document_tfidf(spark, folder):
    docs = Inputs(spark, folder).documents
    tf = materialize(textvectors.document_terms(docs))
    result = textvectors.tfidf(tf, materialize(textvectors.idf(tf, docs.count())))
    return result.withColumn("weight", F.round("weight", 6))


def _song_vectors(songs):
    tf = materialize(content.song_term_counts(songs))
    return materialize(textvectors.tfidf(tf, materialize(textvectors.idf(tf, songs.count()))))


def user_profiles(spark, folder):
    t = Inputs(spark, folder)
    result = profiles.user_profiles(t.like_table.select("user_id", "song_id"), _song_vectors(t.songs))
    return result.withColumn("weight", F.round("weight", 6))


def cosine_scores(spark, folder):
    """Summed up per user; the scores themselves are users x songs."""
    t = Inputs(spark, folder)
    vectors = _song_vectors(t.songs)
    mine = profiles.user_profiles(t.likes.select("user_id", "song_id"), vectors)
    pool = lookup.candidate_songs(t.songs).select(F.col("id").alias("doc_id"))
    scores = profiles.cosine_scores(mine, vectors.join(pool, "doc_id", "left_semi"))
    return scores.groupBy("user_id").agg(
        F.count("*").alias("n_scored"), F.round(F.max("score"), 6).alias("best"), F.round(F.avg("score"), 6).alias("mean"))


def rank_unliked(spark, folder):
    """Ranks by the scores of ``cosine_scores``, in which one idf serves all."""
    t = Inputs(spark, folder)
    vectors, likes = _song_vectors(t.songs), t.like_table.select("user_id", "song_id")
    pool = materialize(lookup.candidate_songs(t.songs).select(F.col("id").alias("song_id")))
    scores = profiles.cosine_scores(profiles.user_profiles(likes, vectors),
                                    vectors.join(pool.withColumnRenamed("song_id", "doc_id"), "doc_id", "left_semi"))
    liked = materialize(likes.join(pool, "song_id", "left_semi"))
    # Lists of at most the pool meet the scores by user, so that these stay where they are.
    lists = liked.groupBy("user_id").agg(F.collect_set("song_id").alias("own")).hint("shuffle_hash")
    marked = scores.join(lists, "user_id", "left").select(
        "user_id", "song_id", "score", F.coalesce(F.array_contains("own", F.col("song_id")), F.lit(False)).alias("liked"))
    return _rounded(profiles.rank_unliked(marked, likes.select("user_id").distinct(), liked, pool))


def _rounded(suggestions):
    return suggestions.withColumn("score", F.round("score", 6))


def content_suggestions(spark, folder):
    t = Inputs(spark, folder)
    return _rounded(content.content_suggestions(t.like_table, t.songs))


def content_suggestions_spread(spark, folder):
    """The way taken for users with very long histories, for about half of the users here."""
    t = Inputs(spark, folder)
    return _rounded(content.content_suggestions(t.like_table, t.songs, heavy_history=38))


def content_suggestions_bounded(spark, folder):
    """Only cells that can be among the best, of the usual pool."""
    t = Inputs(spark, folder)
    return _rounded(content.content_suggestions(t.like_table, t.songs, bounded=True))


def content_suggestions_of_all_songs(spark, folder):
    """The whole catalogue as the pool."""
    t = Inputs(spark, folder)
    return _rounded(content.content_suggestions(t.like_table, t.songs, pool=None, bounded=True))


def content_suggestions_weighted(spark, folder):
    t = Inputs(spark, folder)
    return _rounded(content.content_suggestions(t.like_table, t.songs, mode="weighted"))


def content_suggestions_shared_corpus(spark, folder):
    t = Inputs(spark, folder)
    return _rounded(content.content_suggestions(t.like_table, t.songs, corpus="shared"))


def popular_by_genre(spark, folder):
    t = Inputs(spark, folder)
    return popularity.popular_by_genre(t.likes, t.songs)


def popular_for_requests(spark, folder):
    t = Inputs(spark, folder)
    return popularity.popular_for_requests(hybrid.latest_genres(t.requests), t.likes, t.songs)


def collaborative_or_popular(spark, folder):
    t = Inputs(spark, folder)
    return hybrid.collaborative_or_popular(t.users, t.like_table, t.songs)


def suggest(spark, folder):
    t = Inputs(spark, folder)
    return _rounded(hybrid.suggest(t.users, t.like_table, t.songs))


def suggest_combined(spark, folder):
    t = Inputs(spark, folder)
    return _rounded(hybrid.suggest(t.users, t.like_table, t.songs, k=15, combine=True,
                                   order=("collaborative", "popular", "content")))


def suggest_fused(spark, folder):
    t = Inputs(spark, folder)
    return _rounded(fusion.fused_suggestions(t.users, t.like_table, t.songs))


def to_suggestions(spark, folder):
    songs = Inputs(spark, folder).songs
    video_id = F.when(F.col("genre").isNull(), "").when(F.col("tags").isNotNull(), F.col("video_id"))
    return shapes.to_suggestions(songs.select(
        "id", "title", "artist", video_id.alias("video_id"), F.concat(F.lit("y"), F.col("id")).alias("youtube_video_id")))


def liked_rows(spark, folder):
    t = Inputs(spark, folder)
    return shapes.to_liked_rows(lookup.liked_songs(t.users, t.likes, t.songs, ordered=False))


def iso_timestamps(spark, folder):
    times = fx.event_times(tune(spark), folder)
    return times.select("event_id", shapes.iso_timestamp(F.col("ts")).alias("iso"))


def upsert_users(spark, folder):
    t = Inputs(spark, folder)
    accepted, _ = ingest.validate_requests(t.requests)
    return writes.upsert_users(t.users, accepted, AS_OF)


def upsert_songs(spark, folder):
    t = Inputs(spark, folder)
    return writes.upsert_songs(t.songs, ingest.resolve_songs(t.items(), t.catalog), AS_OF)


def append_likes(spark, folder):
    return writes.append_likes(Inputs(spark, folder).likes, fx.event_likes(spark, folder), AS_OF)


def append_likes_twice(spark, folder):
    events = fx.event_likes(spark, folder)
    return writes.append_likes(writes.append_likes(Inputs(spark, folder).likes, events), events)


def audit_constraints(spark, folder):
    tune(spark)
    return writes.audit_constraints(
        fx.untidy_users(spark, folder), fx.untidy_songs(spark, folder), fx.untidy_likes(spark, folder))


def purge_users(spark, folder):
    t = Inputs(spark, folder)
    return writes.purge(t.users, t.likes, lookup.find_users(t.users, t.requests), "user_id")[0]


def purge_users_likes(spark, folder):
    t = Inputs(spark, folder)
    return writes.purge(t.users, t.likes, lookup.find_users(t.users, t.requests), "user_id")[1]


def purge_songs_likes(spark, folder):
    t = Inputs(spark, folder)
    named = t.songs.join(ingest.resolve_songs(t.items(), t.catalog).select("video_id"), "video_id", "left_semi")
    return writes.purge(t.songs, t.likes, named, "song_id")[1]


def migrate_users_down(spark, folder):
    return writes.migrate_users(Inputs(spark, folder).users, "down")


def migrate_users_up(spark, folder):
    return writes.migrate_users(migrate_users_down(spark, folder), "up", AS_OF)


def too_long_for_first_version(spark, folder):
    return writes.too_long_for_first_version(fx.untidy_users(spark, folder)).select("id", "user_id")


def recent_likes_snapshot(spark, folder):
    return serving.recent_likes_snapshot(Inputs(spark, folder).request_writes()[0], SNAPSHOT_AS_OF, ttl=12 * 3600)


def liked_songs_as_served(spark, folder):
    t = Inputs(spark, folder)
    writes_, songs = t.request_writes()
    snapshot = serving.recent_likes_snapshot(writes_, SNAPSHOT_AS_OF, ttl=12 * 3600)
    return serving.liked_songs_as_served(t.users, snapshot, t.users, t.likes, songs)


def _searched(spark, folder):
    """The searches of all requests, and a lookup for each of them."""
    t = Inputs(spark, folder)
    items = t.items(t.request_table)
    resolved = ingest.resolve_songs(items, t.catalog, keep_unresolved=True)
    lookups = resolved.where(F.col("query").isNotNull()).select(
        "query", "ts", F.col("video_id").isNotNull().alias("hit"))
    return items, lookups


def reusable_searches(spark, folder):
    return serving.reusable_searches(*_searched(spark, folder))


def stream_reusable_searches(spark, folder):
    """Searches and lookups as two streams."""
    path = scratch_folder(spark, "searches")
    sides = []
    for name, rows in zip(("searches", "lookups"), _searched(spark, folder)):
        rows.write.parquet(f"{path}/{name}")
        sides.append(spark.readStream.schema(rows.schema).parquet(f"{path}/{name}"))
    _finish(searches_stream.stream_reusable_searches(*sides, f"{path}/answers", f"{path}/progress", available_now=True))
    return searches_stream.read_reusable_searches(spark, f"{path}/answers")


def _processed(spark, folder):
    t = Inputs(spark, folder)
    return hybrid.process_requests(t.request_table, t.users, t.songs, t.like_table, t.catalog, AS_OF)


def _stored(spark, folder):
    t = Inputs(spark, folder)
    return hybrid.store_requests(t.request_table, t.users, t.songs, t.likes, t.catalog, AS_OF, AS_OF)


def process_requests_new_users(spark, folder):
    return _stored(spark, folder).new_users


def process_requests_new_songs(spark, folder):
    return _stored(spark, folder).new_songs


def process_requests_new_likes(spark, folder):
    return _stored(spark, folder).new_likes


def process_requests_suggestions(spark, folder):
    return _rounded(_processed(spark, folder)[1])


def _finish(stream):
    stream.awaitTermination(600)
    if stream.isActive or stream.exception():
        stream.stop()
        raise RuntimeError(f"stream did not end: {stream.exception()}")


def _streamed(spark, folder):
    """The folder of the tables after all requests have been streamed."""
    t = Inputs(spark, folder)
    path = scratch_folder(spark, "stream")
    stored.start_tables(path, t.users, t.songs, t.likes)
    incoming = fx.requests(spark, folder, fx.stream_events(spark, folder))
    _finish(likes_stream.stream_likes(incoming, path, t.catalog, f"{path}/progress", available_now=True))
    return path


def _committed(spark, folder):
    """A batch of all requests, run twice under the same number."""
    t = Inputs(spark, folder)
    path = scratch_folder(spark, "batch")
    stored.start_tables(path, t.users, t.songs, t.likes)
    requests = t.request_table
    likes_stream.commit_requests(spark, path, requests, t.catalog, 0)
    return path, likes_stream.commit_requests(spark, path, requests, t.catalog, 0)


def commit_requests_likes(spark, folder):
    """The likes that the batch left."""
    return stored.read_table(spark, _committed(spark, folder)[0], "likes")


def commit_requests_suggestions(spark, folder):
    return _rounded(_committed(spark, folder)[1])


def stream_likes(spark, folder):
    return stored.read_table(spark, _streamed(spark, folder), "likes")


def stream_recent_likes(spark, folder):
    path = _streamed(spark, folder)
    _finish(likes_stream.stream_snapshots(spark, path, f"{path}/snapshot-progress", available_now=True))
    return likes_stream.stream_recent_likes(spark, path, SNAPSHOT_AS_OF, ttl=12 * 3600)
