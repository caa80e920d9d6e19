"""Searches and lookups as two streams: which earlier lookup answers each search.

Rows of both streams meet by query, with a watermark on both sides. Spark's state store holds searches until no earlier lookup can
still arrive, and lookups until no earlier search can; of those before only the last one, while it may answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from likerec.plans.serving import HIT_SECONDS, still_valid

DELAY = "1 day"
# Tasks that the searches of one query are spread over; each holds lookups of the query.
SPREAD = 8
SEARCH = ["request_id", "position", "ts", "query"]
ANSWERS = ("request_id long, position int, ts timestamp_ntz, query string, answer struct<lookup_ts: timestamp_ntz, hit: boolean>, "
           "day date, batch_id long")
# What is kept of a query's searches (with the answer so far) and lookups, the code of no lookup, and what leaves the state.
HELD = ["at", "request_id", "position", "gone", "best", "codes"]
NONE = -(2**63)
MATCHED = "query string, at long, request_id long, position long, gone long, code long"


def _code(ts: Column, hit: Column) -> Column:
    """Lookups as numbers by time, then none, no hit, hit, which is the order of the batch form."""
    return ts * 3 + F.coalesce(hit.cast("int") + 1, F.lit(0))


def _sides(searches: DataFrame, lookups: DataFrame, delay: str, spread: int) -> DataFrame:
    """Both streams as one: (query, salt, asked, at, request_id, position, gone, code), with a watermark on either. Numbers
    travel without nulls; ``gone`` has a bit for each of the two that were null."""
    zero = F.lit(0).cast("long")
    asked = (
        searches.select(*SEARCH).where("query IS NOT NULL AND ts IS NOT NULL")
        .withColumn("event_time", F.col("ts").cast("timestamp")).withWatermark("event_time", delay)
        .select("query", F.pmod(F.xxhash64("request_id", "position"), F.lit(spread)).cast("int").alias("salt"), "event_time",
                F.lit(True).alias("asked"), F.unix_micros("event_time").alias("at"),
                F.coalesce("request_id", zero).alias("request_id"), F.coalesce("position", F.lit(0)).alias("position"),
                (F.col("request_id").isNull().cast("int") + 2 * F.col("position").isNull().cast("int")).alias("gone"), zero.alias("code"))
    )
    found = (
        lookups.where("query IS NOT NULL AND ts IS NOT NULL")
        .withColumn("event_time", F.col("ts").cast("timestamp")).withWatermark("event_time", delay)
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
        .select("query", "salt", "event_time", F.lit(False).alias("asked"), F.unix_micros("event_time").alias("at"),
                zero.alias("request_id"), F.lit(0).alias("position"), F.lit(0).alias("gone"),
                _code(F.unix_micros("event_time"), F.col("hit")).alias("code"))
    )
    return asked.unionByName(found)


def _answers(at: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The last lookup up to each moment that is not 7 days old; ``codes`` ascend."""
    place = np.searchsorted(codes, at * 3 + 2, "right") - 1
    best = np.where(place >= 0, codes[np.maximum(place, 0)], NONE) if len(codes) else np.full(len(at), NONE)
    return np.where((best != NONE) & (best // 3 > at - HIT_SECONDS * 1_000_000), best, NONE)


def _answer_query(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The searches of one query (and salt) that get an answer, a later one, or can no longer get one.

    Held are searches later than the watermark, each with its answer so far, lookups later than it, and the last one before:
    no search or lookup to come is earlier, so none needs more.
    """
    kept = [np.array(values, np.int64) for values in (state.get if state.exists else [[]] * len(HELD))]
    held, codes = np.array(kept[:-1]), kept[-1]
    parts = [frame for frame in frames if len(frame)]
    if parts:
        new = [np.concatenate([p[name].to_numpy(np.int64) for p in parts]) for name in ("at", "request_id", "position", "gone", "code", "asked")]
        asked = new[5] == 1
        codes = np.union1d(codes, new[4][~asked])
        codes = codes[np.append(codes[1:] // 3 != codes[:-1] // 3, True)] if len(codes) else codes  # the best of a moment
        held = np.concatenate([held, np.array([*(c[asked] for c in new[:4]), np.full(asked.sum(), NONE)])], axis=1)
    watermark = state.getCurrentWatermarkMs() * 1000
    best = np.maximum(held[4], _answers(held[0], codes))
    over = held[0] <= watermark
    told = (best != held[4]) | (over & (best == NONE))
    held[4] = best
    if told.any():
        yield pd.DataFrame(dict(zip(["at", "request_id", "position", "gone", "code"], held[:, told])))
    held = held[:, ~over]
    codes = codes[max(np.searchsorted(codes, watermark * 3 + 2, "right") - 1, 0):]
    ends = [*held[0, :].tolist(), *(codes[-1:] // 3 + HIT_SECONDS * 1_000_000).tolist()]
    end = -(-min(ends) // 1000) if ends else 0
    if end * 1000 <= watermark:
        if state.exists:
            state.remove()
        return
    state.update((*held.tolist(), codes.tolist()))
    state.setTimeoutTimestamp(end)


def match_searches(searches: DataFrame, lookups: DataFrame, delay: str = DELAY, spread: int = SPREAD) -> DataFrame:
    """(request_id, position, ts, query, answer): each search with the last lookup of its query in the 7 days up to it.

    A search is given again if a later lookup up to it comes in a later micro-batch. One without a lookup gives a row with a null
    answer once the watermark has passed it. Rows without a query or a time are left out. A query that fills much of the stream is
    spread over ``spread`` tasks by search. Lookups of a query are sorted and searched in them, so that no pair is made.
    """
    matched = _sides(searches, lookups, delay, spread).groupBy("query", "salt").applyInPandasWithState(
        _with_query, MATCHED, ", ".join(f"{name} array<bigint>" for name in HELD), "append", GroupStateTimeout.EventTimeTimeout)
    moment = lambda micros: F.timestamp_micros(micros).cast("timestamp_ntz")
    kind = F.pmod("code", F.lit(3))
    hit = F.when(kind > 0, kind == 2)
    answer = F.when(F.col("code") != NONE, F.struct(moment(F.expr("(code - pmod(code, 3)) div 3")).alias("lookup_ts"), hit.alias("hit")))
    return matched.select(
        F.when(F.col("gone").bitwiseAND(1) == 0, F.col("request_id")).alias("request_id"),
        F.when(F.col("gone").bitwiseAND(2) == 0, F.col("position").cast("int")).alias("position"),
        moment(F.col("at")).alias("ts"), "query", answer.alias("answer"))


def _with_query(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    for rows in _answer_query(key, frames, state):
        rows.insert(0, "query", key[0])
        yield rows


def _latest(rows: DataFrame) -> DataFrame:
    """The latest lookup of each search; where several share the time, a hit counts."""
    return rows.groupBy(*SEARCH).agg(F.max("answer").alias("answer"))


def stream_reusable_searches(searches: DataFrame, lookups: DataFrame, folder: str, checkpoint: str, available_now: bool = False,
                             delay: str = DELAY, spread: int = SPREAD) -> StreamingQuery:
    """Run both streams into ``folder``: per micro-batch the best lookup it found for each search.

    Pairs are reduced to one row per search before they leave their task. A batch that is run again overwrites its own
    rows. Rows that come later than ``delay`` behind the newest are dropped by the join, as state for them is gone.
    """
    spark = searches.sparkSession
    spark.createDataFrame([], ANSWERS).write.mode("append").partitionBy("day", "batch_id").parquet(folder)

    def put(batch: DataFrame, batch_id: int) -> None:
        placed = _latest(batch).withColumn("day", F.col("ts").cast("date")).withColumn("batch_id", F.lit(batch_id).cast("long"))
        placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch_id").parquet(folder)

    writer = match_searches(searches, lookups, delay, spread).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_reusable_searches(spark: SparkSession, folder: str, days: tuple[str, str] | None = None) -> DataFrame:
    """Rows as ``reusable_searches`` gives them, of the searches that the stream has answered or given up so far.

    ``days``: first and last day of searches to read; other folders are pruned. A search is one (request_id, position),
    so that a repeated row counts once.
    """
    rows = spark.read.schema(ANSWERS).parquet(folder)
    if days:
        rows = rows.where(F.col("day").between(*[F.lit(day).cast("date") for day in days]))
    return still_valid(_latest(rows))
