"""User profiles, cosine scores and ranking over long-form vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from likerec.session import broadcast_stored, materialize, shuffle_width, with_new_ids

# Scores are compared in steps of one billionth, so that the order in which doubles are summed
# cannot decide a rank.
SCORE_STEP = 1e-9
# Likes whose songs' entries a task sums up.
LIKES_OF_TASK = 250_000


def score_steps(score: Column) -> Column:
    return F.floor(score / SCORE_STEP + 0.5)


def best_first() -> list[Column]:
    """Order of scored rows: by step, a score before none, then the smaller id."""
    return [F.desc(score_steps(F.col("score"))), F.desc(F.col("score") > 0), F.col("song_id")]


def user_profiles(history: DataFrame, vectors: DataFrame) -> DataFrame:
    """Mean vector (user_id, term, weight) of each user's songs.

    ``history`` is (user_id, song_id), ``vectors`` (doc_id, term, weight). A song without
    terms is a zero vector and still counts in the divisor. Each song's entries travel packed in the rows of its likes, which
    are shuffled once, by user; sums are made there. ``vectors`` should be materialized.
    """
    spark = history.sparkSession
    packed = vectors.groupBy(F.col("doc_id").alias("song_id")).agg(F.collect_list(F.struct("term", "weight")).alias("entries"))
    placed = history.select("user_id", "song_id").join(packed, "song_id", "left").repartition(
        shuffle_width(spark, history.count(), LIKES_OF_TASK), "user_id")
    return (
        placed.withColumn("h", F.count(F.lit(1)).over(Window.partitionBy("user_id")))
        .where(F.col("user_id").isNotNull())
        .select("user_id", "h", F.explode("entries").alias("e"))
        .groupBy("user_id", "e.term").agg((F.sum("e.weight") / F.max("h")).alias("weight"))
    )


def cosine_scores(profiles: DataFrame, candidate_vectors: DataFrame) -> DataFrame:
    """(user_id, song_id, score) for every user and candidate that share a term.

    ``candidate_vectors`` is (doc_id, term, weight) of any scale. All other pairs score zero
    and have no row. Stored candidates are broadcast when they are few; then scores stay in the profiles' tasks by user and
    none is shuffled.
    """
    norm = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy("user_id")))
    unit_profiles = profiles.select("user_id", "term", (F.col("weight") / norm).alias("p"))
    candidate_norms = candidate_vectors.groupBy("doc_id").agg(
        F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    unit_candidates = materialize(candidate_vectors.join(candidate_norms, "doc_id").select(
        F.col("doc_id").alias("song_id"), "term", (F.col("weight") / F.col("norm")).alias("c")))
    return (
        unit_profiles.where(F.col("user_id").isNotNull()).join(broadcast_stored(unit_candidates), "term")
        .groupBy("user_id", "song_id")
        .agg(F.sum(F.col("p") * F.col("c")).alias("score"))
    )


def rank_unliked(scores: DataFrame, users: DataFrame, liked: DataFrame, pool: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` best candidates per user that the user does not like yet, with ranks from 1.

    ``scores`` is (user_id, song_id, score, liked) for candidates that share a term with the user, ``liked`` marking the
    user's own; ``pool`` holds all candidates as ``song_id``, the table ``liked`` the likes among them, and ``users`` those
    who get a list. Ties go to the smaller id, and candidates that score zero fill the list up.
    """
    # Liked candidates sort last: they only show up in lists that are too short.
    order = Window.partitionBy("user_id").orderBy("liked", *best_first())
    top = materialize(
        scores.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .where(~F.col("liked") & (F.col("score") > 0))
        .select("user_id", "song_id", "score", "rank")
    )
    return top.unionByName(zero_score_fill(top, users, liked, pool, k))


def zero_score_fill(top: DataFrame, users: DataFrame, liked: DataFrame, pool: DataFrame, k: int) -> DataFrame:
    """Rows that complete lists shorter than ``k`` with unliked candidates that score zero.

    ``top`` (user_id, song_id, score, rank) holds every positive unliked candidate of a short
    list, ``liked`` the likes within the pool. Candidates are numbered in id order; a user whose
    list lacks ``m`` rows and who has ``n`` candidates listed or liked finds ``m`` free ones
    among the first ``m + n``.
    """
    listed = top.groupBy("user_id").agg(F.count("*").alias("n"))
    short = materialize(
        users.join(listed, "user_id", "left")
        .select("user_id", F.coalesce("n", F.lit(0)).alias("n"))
        .where(F.col("n") < k)
    )
    if short.isEmpty():
        return top.limit(0)
    numbered = materialize(with_new_ids(pool, pool.select(F.lit(0).alias("position")).limit(0),
                                        "song_id", "position"))
    taken = (
        top.select("user_id", "song_id").unionByName(liked.select("user_id", "song_id"))
        .join(short.select("user_id"), "user_id", "left_semi")
    )
    n_taken = taken.groupBy("user_id").agg(F.count("*").alias("n_taken"))
    reach = F.least(F.lit(numbered.count()), k - F.col("n") + F.coalesce("n_taken", F.lit(0)))
    slots = (
        short.join(n_taken, "user_id", "left")
        .where(reach > 0)
        .select("user_id", "n", F.explode(F.sequence(F.lit(1), reach.cast("long"))).alias("position"))
    )
    order = Window.partitionBy("user_id").orderBy("song_id")
    return (
        slots.join(numbered, "position")
        .join(taken, ["user_id", "song_id"], "left_anti")
        .withColumn("rank", F.col("n").cast("int") + F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("user_id", "song_id", F.lit(0.0).alias("score"), "rank")
    )
