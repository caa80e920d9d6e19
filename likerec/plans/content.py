"""Content-based suggestions for all users at once.

Fitting one model per request means a vocabulary per user: the corpus is the user's own songs plus all
candidates, so the idf of a term depends on the user. With N candidates, h songs in the history,
``dfC`` and ``dfH`` counting the candidates and the user's songs that hold a term,

    idf(u, t) = a(h) - ln(1 + dfC(t) + dfH(u, t)),     a(h) = ln(1 + N + h) + 1.

Fitting every user anew would repeat the candidates once per user. Only terms of the user's own
songs have dfH > 0, however, so for all other terms the idf depends on h alone and a candidate's
squared norm splits into

    |c|^2 = a^2 S0(c) - 2 a S1(c) + S2(c)  +  sum over shared terms of tf^2 (idf(u,t)^2 - idf0(h,t)^2)

with idf0 the idf for dfH = 0, and S0, S1, S2 the sums of tf^2, tf^2 ln(1 + dfC) and
tf^2 ln^2(1 + dfC), computed once per candidate. Scores then need one join of (user, term) with
the candidates' postings.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from likerec.functions.text import feature_text
from likerec.operators.lookup import candidate_songs
from likerec.operators.profiles import rank_unliked
from likerec.operators.textvectors import document_terms, idf, tfidf
from likerec.plans.bestcells import best_cells
from likerec.plans.boundedtopk import bounded_scores, squared_norm
from likerec.session import broadcast_rows, broadcast_stored, fits_broadcast, materialize, shuffle_width

# Users with more likes than this are weighted in chunks of about so many songs instead of in one task.
HEAVY_HISTORY = 100_000
HISTORY_CHUNK = 1024
# Entries and terms of a usual user in the task that weights them.
ROWS_OF_USER = 1000
# First character of a candidate's own mark; no token has it.
MARK = "#"


def song_documents(songs: DataFrame, mode: str = "as_coded") -> DataFrame:
    """(doc_id, text) with the feature text of each song."""
    text = feature_text(F.col("title"), F.col("artist"), F.col("genre"), F.col("tags"), mode)
    return songs.select(F.col("id").alias("doc_id"), text.alias("text"))


def song_term_counts(songs: DataFrame, mode: str = "as_coded", stop_words: Sequence[str] | None = None) -> DataFrame:
    return document_terms(song_documents(songs, mode), stop_words)


@dataclass(frozen=True)
class Candidates:
    """The candidate pool, prepared once per job."""

    size: int
    ids: DataFrame  # song_id
    postings: DataFrame  # term, song_id, tf, df; with the marks
    norms: DataFrame  # song_id, s0, s1, s2
    has_terms: bool


def prepare_candidates(songs: DataFrame, pool: int | None, mode: str, stop_words: Sequence[str] | None) -> Candidates:
    chosen = materialize(songs if pool is None else candidate_songs(songs, pool))
    size = chosen.count()
    ids = chosen.select(F.col("id").alias("song_id"))
    tf = song_term_counts(chosen, mode, stop_words)
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    counted = tf.join(df, "term").select("term", F.col("doc_id").alias("song_id"), "tf", "df")
    postings = materialize(counted.unionByName(_marks(ids)))
    squared, log_df = F.col("tf") * F.col("tf"), F.log1p("df")
    norms = postings.groupBy("song_id").agg(
        F.sum(squared).cast("double").alias("s0"),
        F.sum(squared * log_df).alias("s1"),
        F.sum(squared * log_df * log_df).alias("s2"),
    )
    return Candidates(size, ids, postings, norms, not postings.where(F.col("tf") > 0).isEmpty())


def _marks(ids: DataFrame) -> DataFrame:
    """Each candidate's own mark as a term with tf 0, which adds nothing to any weight."""
    zero = F.lit(0).cast("long")
    return ids.select(_own_term("song_id").alias("term"), "song_id", zero.alias("tf"), zero.alias("df"))


def _own_term(song_id: str) -> Column:
    """A term no text can hold; it marks the candidates a user already likes."""
    return F.concat(F.lit(MARK), F.col(song_id).cast("string"))


def song_vectors(songs: DataFrame, candidates: Candidates, mode: str, stop_words: Sequence[str] | None) -> DataFrame:
    """(song_id, entries) with entries (term, tf, df): one row per song, bounded by its text.

    Candidates also carry their own mark.
    """
    df = materialize(candidates.postings.where(F.col("tf") > 0).select("term", "df").distinct())
    counted = (
        song_term_counts(songs, mode, stop_words)
        .join(df, "term", "left")
        .select("term", F.col("doc_id").alias("song_id"), "tf", F.coalesce("df", F.lit(0)).alias("df"))
    )
    return (
        counted.unionByName(_marks(candidates.ids))
        .groupBy("song_id")
        .agg(F.collect_list(F.struct("term", "tf", "df")).alias("entries"))
    )


def _idf(n: int, df: Column) -> Column:
    return F.log(F.lit(1.0) + n + F.col("h")) + 1 - F.log1p(df)


def _weighted_terms(entries: DataFrame, n: int) -> DataFrame:
    """(user_id, h, term, df, dfh, weight, norm2): the user's mean vector and its squared norm.

    ``entries`` is (user_id, h, song_id, term, tf, df). The rows of a user lie in one task and windows count within it.
    """
    def spread(rows: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
        return rows.withColumn(name, value.over(Window.partitionBy(*keys)))

    counted = spread(entries, ["user_id", "term"], F.count(F.lit(1)), "dfh")
    raw = counted.withColumn("w", F.col("tf") * _idf(n, F.col("df") + F.col("dfh")))
    normed = spread(raw, ["user_id", "song_id"], F.sum(F.col("w") * F.col("w")), "w2")
    unit = F.when(F.col("w2") > 0, F.col("w") / F.sqrt("w2")).otherwise(0.0)
    means = normed.groupBy("user_id", "h", "term", "df", "dfh").agg((F.sum(unit) / F.col("h")).alias("weight"))
    return spread(means, ["user_id"], F.sum(F.col("weight") * F.col("weight")), "norm2")


def _chunk_sums(source: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """(user_id, h, term, df, dfh, total): the unit vectors of a chunk's songs added up by term. Rows are (user_id, h, songs, counts)."""
    for batch in source:
        if not batch.num_rows:
            continue
        songs, counts = batch.column("songs"), batch.column("counts")
        song_id, entries = songs.flatten().flatten()
        term, tf, df = entries.flatten().flatten()
        row_of_song = np.repeat(np.arange(batch.num_rows), pc.list_value_length(songs).to_numpy())
        sizes = pc.list_value_length(entries).to_numpy()
        row = np.repeat(row_of_song, sizes)
        # A song that comes twice is one vector of both.
        pair = np.unique(np.stack([row_of_song, song_id.to_numpy()]), axis=1, return_inverse=True)[1].reshape(-1)
        song = np.repeat(pair, sizes)
        counted, dfh = counts.flatten().flatten()
        row_of_count = np.repeat(np.arange(batch.num_rows), pc.list_value_length(counts).to_numpy())
        words = pc.unique(counted)
        keys = row_of_count * len(words) + pc.index_in(counted, value_set=words).to_numpy()
        order = np.argsort(keys)
        place = order[np.searchsorted(keys[order], row * len(words) + pc.index_in(term, value_set=words).to_numpy())]
        dfh, df, h = dfh.to_numpy(), df.to_numpy(), batch.column("h").to_numpy()
        w = tf.to_numpy() * (np.log(1.0 + n + h[row]) + 1 - np.log1p(df + dfh[place]))
        w2 = np.bincount(song, w * w)[song]
        total = np.bincount(place, np.divide(w, np.sqrt(w2), out=np.zeros(len(w)), where=w2 > 0), len(keys))
        known = np.zeros(len(keys), np.int64)
        known[place] = df
        yield pa.RecordBatch.from_arrays(
            [batch.column("user_id").take(pa.array(row_of_count)), pa.array(h[row_of_count]), counted, pa.array(known), pa.array(dfh), pa.array(total)],
            names=["user_id", "h", "term", "df", "dfh", "total"])


def _long_histories(pairs: DataFrame, heavy: DataFrame, vectors: DataFrame, n: int, width: int) -> DataFrame:
    """``_weighted_terms`` of the users in ``heavy`` (user_id, h), no task of which holds a whole history.

    Histories are cut into chunks by song. Songs' entries travel packed, once for each pass over them: the first counts terms in
    chunks, the second adds up unit vectors there. Otherwise rows are the terms of a user and chunk.
    """
    chunk = F.pmod(F.xxhash64("song_id"), F.ceil(F.col("h") / HISTORY_CHUNK)).alias("chunk")
    placed = pairs.join(heavy, "user_id").select("user_id", "h", "song_id", chunk).join(vectors, "song_id").repartition(width, "user_id", "chunk")
    counts = materialize(
        placed.select("user_id", "chunk", F.explode("entries.term").alias("term")).groupBy("user_id", "chunk", "term").agg(F.count("*").alias("n")))
    dfh = counts.groupBy("user_id", "term").agg(F.sum("n").alias("dfh"))
    lists = counts.join(dfh, ["user_id", "term"]).groupBy("user_id", "chunk").agg(F.collect_list(F.struct("term", "dfh")).alias("counts"))
    packed = placed.groupBy("user_id", "h", "chunk").agg(F.collect_list(F.struct("song_id", "entries")).alias("songs"))
    user = pairs.schema["user_id"].dataType.simpleString()
    sums = packed.join(lists, ["user_id", "chunk"]).select("user_id", "h", "songs", "counts").mapInArrow(
        lambda source: _chunk_sums(source, n), f"user_id {user}, h long, term string, df long, dfh long, total double")
    means = materialize(sums.groupBy("user_id", "h", "term", "df", "dfh").agg((F.sum("total") / F.col("h")).alias("weight")))
    return means.join(means.groupBy("user_id").agg(F.sum(F.col("weight") * F.col("weight")).alias("norm2")), "user_id")


def weighted_profiles(likes: DataFrame, vectors: DataFrame, candidates: Candidates,
                      heavy_history: int = HEAVY_HISTORY, bounded: bool = False) -> DataFrame:
    """Mean TF-IDF vector of every user, each in the user's own corpus.

    Their tasks follow the number of cells that will be made there, or with ``bounded``, where none are, that of rows.

    Likes are shuffled once, by user, with each song's entries packed in its row; only users
    with a very long history take the way in chunks.
    """
    spark = likes.sparkSession
    pairs = likes.select("user_id", "song_id")
    sizes = pairs.groupBy("user_id").agg(F.count("*").alias("h"))
    stats = sizes.agg(F.count("*").alias("n_users"), F.max("h").alias("longest")).first()
    packed_vectors = vectors
    width = shuffle_width(spark, (stats["n_users"] or 0) * (min(candidates.size, ROWS_OF_USER) if bounded else candidates.size))
    entry = F.explode("entries").alias("e")

    def regular(part: DataFrame) -> DataFrame:
        packed = part.join(packed_vectors, "song_id", "left").repartition(width, "user_id")
        with_size = packed.withColumn("h", F.count(F.lit(1)).over(Window.partitionBy("user_id")))
        entries = with_size.select("user_id", "h", "song_id", entry).select("user_id", "h", "song_id", "e.*")
        return _weighted_terms(entries, candidates.size)

    if (stats["longest"] or 0) <= heavy_history:
        return regular(pairs)
    heavy = materialize(sizes.where(F.col("h") > heavy_history))
    long_ones = _long_histories(pairs, heavy, packed_vectors, candidates.size, width)
    long_ones = long_ones.select("user_id", "h", "term", "df", "dfh", "weight", "norm2")
    others = regular(pairs.join(heavy, "user_id", "left_anti"))
    return others.unionByName(long_ones).repartition(width, "user_id")


def _score_rows(profiles: DataFrame, n: int) -> DataFrame:
    """(user_id, h, term, df, p, x, y, ratio): p is the unit profile, a dot product is a sum of x tf, the shift of a squared
    norm one of y tf^2, and ratio is the user's idf of the term by that without the user's own songs."""
    idf_user, idf_plain = _idf(n, F.col("df") + F.col("dfh")), _idf(n, F.col("df"))
    unit = F.when(F.col("norm2") > 0, F.col("weight") / F.sqrt("norm2")).otherwise(0.0)
    return profiles.select("user_id", "h", "term", "df", unit.alias("p"), (unit * idf_user).alias("x"),
                           (idf_user * idf_user - idf_plain * idf_plain).alias("y"), (idf_user / idf_plain).alias("ratio"))


def content_scores(profiles: DataFrame, candidates: Candidates, k: int | None = None) -> DataFrame:
    """(user_id, song_id, score, liked) for every candidate that shares a term with the profile.

    With ``k``, and postings that are small, only the ``k`` best unliked ones of each user leave the task (``best_cells``).
    The postings are broadcast when they are small, so profiles stay where they are, and both
    the sums per candidate and the ranking reuse the partitioning by user.
    """
    n = candidates.size
    rows = _score_rows(profiles, n).select("user_id", "h", "term", "df", "x", "y")
    if k is not None and fits_broadcast(candidates.postings):
        known = rows.where((F.col("df") > 0) | F.col("term").startswith(MARK))
        return best_cells(known, candidates.postings, candidates.norms, n, k)
    postings = candidates.postings.select("term", "song_id", F.col("tf").cast("double").alias("ctf"))
    cells = (
        rows.join(broadcast_stored(postings), "term")
        .groupBy("user_id", "song_id")
        .agg(
            F.max("h").alias("h"),
            F.sum(F.col("x") * F.col("ctf")).alias("dot"),
            F.sum(F.col("y") * F.col("ctf") * F.col("ctf")).alias("shift"),
            (F.min("ctf") == 0).alias("liked"),
        )
    )
    squared = squared_norm(F.log(F.lit(1.0) + n + F.col("h")) + 1) + F.col("shift")
    score = F.when(F.col("dot") > 0, F.col("dot") / F.sqrt(squared)).otherwise(0.0)
    return cells.join(broadcast_rows(candidates.norms, n), "song_id").select(
        "user_id", "song_id", score.alias("score"), "liked")


def bounded_content_scores(profiles: DataFrame, candidates: Candidates, liked: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """``content_scores`` of cells that may be among a user's ``k`` best, the best of each slab of candidates, and all such cells."""
    rows = _score_rows(profiles, candidates.size).where("df > 0").select("user_id", "h", "term", "p", "x", "y", "ratio")
    postings = candidates.postings.select("term", "song_id", "tf")
    return bounded_scores(rows, postings, candidates.norms, liked, candidates.size, k)


def _shared_corpus(likes: DataFrame, songs: DataFrame, k: int, pool: int, mode: str,
                   stop_words: Sequence[str] | None) -> DataFrame:
    """Variant with one idf for everybody, from the candidates alone.

    Songs carry their unit vectors packed in a row; likes are shuffled once, by user, and profile,
    scores and ranking stay in that partitioning.
    """
    chosen = materialize(candidate_songs(songs, pool))
    ids = chosen.select(F.col("id").alias("song_id"))
    size = chosen.count()
    tf = materialize(song_term_counts(songs, mode, stop_words))
    term_idf = materialize(idf(tf.join(ids.select(F.col("song_id").alias("doc_id")), "doc_id", "left_semi"), size))
    weights = tfidf(tf, term_idf).select(F.col("doc_id").alias("song_id"), "term", "weight")
    marks = ids.select("song_id", _own_term("song_id").alias("term"), F.lit(0.0).alias("weight"))
    vectors = materialize(
        weights.unionByName(marks).groupBy("song_id").agg(F.collect_list(F.struct("term", "weight")).alias("entries")))
    postings = materialize(
        vectors.join(ids, "song_id", "left_semi").select("song_id", F.explode("entries").alias("e"))
        .select("song_id", "e.term", F.col("e.weight").alias("c")))

    pairs = likes.select("user_id", "song_id")
    n_users = pairs.select("user_id").distinct().count()
    packed = pairs.join(vectors, "song_id", "left").repartition(shuffle_width(likes.sparkSession, n_users * size), "user_id")
    by_user = Window.partitionBy("user_id")
    profile = (
        packed.withColumn("h", F.count(F.lit(1)).over(by_user))
        .select("user_id", "h", F.explode("entries").alias("e"))
        .groupBy("user_id", "h", "e.term").agg(F.sum("e.weight").alias("total"))
        .select("user_id", "term", (F.col("total") / F.col("h")).alias("p"))
        .withColumn("norm", F.sqrt(F.sum(F.col("p") * F.col("p")).over(by_user)))
    )
    unit = F.when(F.col("norm") > 0, F.col("p") / F.col("norm")).otherwise(0.0)
    if fits_broadcast(postings):
        rows = profile.select("user_id", F.lit(1).alias("h"), "term", unit.alias("x"), F.lit(0.0).alias("y"))
        scores = best_cells(rows, postings.withColumnRenamed("c", "tf"), None, size, k)
    else:
        scores = (
            profile.join(postings, "term").groupBy("user_id", "song_id")
            .agg(F.sum(unit * F.col("c")).alias("score"), F.bool_or(F.col("c") == 0).alias("liked"))
        )
    users = pairs.select("user_id").distinct()
    if postings.where(F.col("c") > 0).isEmpty():
        users = users.limit(0)
    liked = pairs.join(ids, "song_id", "left_semi")
    return rank_unliked(scores, users, liked, ids, k)


def content_suggestions(likes: DataFrame, songs: DataFrame, k: int = 10, pool: int | None = 1000,
                        mode: str = "as_coded", corpus: str = "per_user",
                        stop_words: Sequence[str] | None = None, wanted: DataFrame | None = None,
                        heavy_history: int = HEAVY_HISTORY, bounded: bool = False) -> DataFrame:
    """(user_id, rank, song_id, video_id, title, artist, score): the ``k`` unliked candidates
    closest to the user's taste.

    Candidates are the ``pool`` most recently updated songs, or all with ``pool=None``. ``bounded`` scores only those
    that can be among a user's best, with the same result; it is for pools of many songs. Likes of songs that are gone do not
    count. Users without likes get no row, and
    nobody gets one when neither side has a usable token. ``corpus="shared"`` fits one idf on
    the candidates instead of one per user.
    """
    if wanted is not None:
        likes = likes.join(wanted.select("user_id").distinct(), "user_id", "left_semi")
    likes = likes.join(songs.select(F.col("id").alias("song_id")), "song_id", "left_semi")
    details = songs.select(F.col("id").alias("song_id"), "video_id", "title", "artist")
    if bounded and corpus != "per_user":
        raise ValueError("bounds are those of one corpus per user")
    if corpus == "shared":
        ranked = _shared_corpus(likes, songs, k, pool, mode, stop_words)
    elif corpus == "per_user":
        ranked = _per_user_corpus(likes, songs, k, pool, mode, stop_words, heavy_history, bounded)
    else:
        raise ValueError(f"unknown corpus: {corpus}")
    return ranked.join(details, "song_id").select(
        "user_id", "rank", "song_id", "video_id", "title", "artist", "score")


def _per_user_corpus(likes: DataFrame, songs: DataFrame, k: int, pool: int | None, mode: str,
                     stop_words: Sequence[str] | None, heavy_history: int, bounded: bool) -> DataFrame:
    candidates = prepare_candidates(songs, pool, mode, stop_words)
    vectors = materialize(song_vectors(songs, candidates, mode, stop_words))
    profiles = weighted_profiles(likes, vectors, candidates, heavy_history, bounded)
    pairs = likes.select("user_id", "song_id")
    users = pairs.select("user_id").distinct()
    if not candidates.has_terms:  # then a vocabulary can only come from the user's own songs
        worded = vectors.where(F.exists("entries", lambda e: e["tf"] > 0)).select("song_id")
        users = pairs.join(worded, "song_id", "left_semi").select("user_id").distinct()
    liked = pairs.join(broadcast_rows(candidates.ids, candidates.size), "song_id", "left_semi")
    if bounded:
        liked = materialize(liked)
        scores = bounded_content_scores(profiles, candidates, liked, k)[0]
    else:
        scores = content_scores(profiles, candidates, k)
    return rank_unliked(scores, users, liked, candidates.ids, k)
