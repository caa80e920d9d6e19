"""A uniform shuffle into shards of exact size, with DataFrame functions only.

Method: each task permutes its rows and numbers them. How many rows of which task go to which shard is drawn
exactly, row by row of the task-by-shard matrix, from the hypergeometric distribution (what a uniform permutation
of all rows would give). A task's rows then go to shards by their numbers, are exchanged, and permuted again
within their shard. Only counts (tasks x shards numbers) are held by the driver; rows never are.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from likerec.llm.common import stash, tidy

# Bytes of text in one task of the last exchange, and the least number of tasks per shard.
CELL_BYTES = 64 * 1024 * 1024
MIN_CELLS = 8


def hypergeometric(rng: random.Random, good: int, bad: int, drawn: int) -> int:
    """How many of ``drawn`` balls are good, of ``good + bad``; inverts the distribution outward from its mode."""
    low, high = max(0, drawn - bad), min(drawn, good)
    if low == high:
        return low
    mode = min(high, max(low, (drawn + 1) * (good + 1) // (good + bad + 2)))

    def log_choose(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    at_mode = math.exp(log_choose(good, mode) + log_choose(bad, drawn - mode) - log_choose(good + bad, drawn))
    left = rng.random() - at_mode
    if left < 0:
        return mode
    below, above, p_below, p_above = mode, mode, at_mode, at_mode
    while below > low or above < high:
        if above < high:
            p_above *= (good - above) * (drawn - above) / ((above + 1) * (bad - drawn + above + 1))
            above += 1
            left -= p_above
            if left < 0:
                return above
        if below > low:
            p_below *= below * (bad - drawn + below) / ((good - below + 1) * (drawn - below + 1))
            below -= 1
            left -= p_below
            if left < 0:
                return below
        if p_above + p_below < 1e-18:  # what is left is the error of rounding
            break
    return mode


def communication_matrix(row_counts: list[int], shard_sizes: list[int], seed: int) -> list[list[int]]:
    """A matrix with these row and column sums, distributed as under a uniform permutation."""
    rng = random.Random(seed)
    left = list(shard_sizes)
    matrix = []
    for count in row_counts:
        row, rest = [], sum(left)
        for shard, free in enumerate(left):
            rest -= free
            took = hypergeometric(rng, free, rest, count)
            row.append(took)
            left[shard] -= took
            count -= took
        matrix.append(row)
    return matrix


def shuffle_into_shards(docs: DataFrame, shards: int = 16, seed: int = 0) -> DataFrame:
    """``docs`` with ``size`` (UTF-8 bytes of the text plus 1), ``text_crc32``, ``shard`` and ``slot``.

    Law ``rows``: counts of shards differ by one at most, the first ones being larger; slots of a shard run from 0
    without gaps. Every permutation is equally likely, up to the quality of the hashes that order the rows.

    Every row is dealt, repeated ones one by one. Null texts have size 1 and the checksum of an empty text. Columns
    named like an output are replaced. An empty table gives an empty result; fewer rows than shards leave the last
    shards empty.
    """
    docs = tidy(docs, ["text"], ["size", "text_crc32", "shard", "slot"])
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sized = docs.withColumn("size", (F.octet_length(text) + 1).cast("long")).withColumn("text_crc32", F.crc32(text).cast("long"))

    # Permute within each task; the running number holds the task in its upper bits.
    ticket = F.xxhash64(F.monotonically_increasing_id(), "text_crc32", F.lit(seed))
    staged = stash(
        sized.withColumn("_llm_ticket", ticket).sortWithinPartitions("_llm_ticket").drop("_llm_ticket")
        .withColumn("_llm_number", F.monotonically_increasing_id()),
        "sharding-staged",
    )
    task, number = F.shiftright("_llm_number", 33), F.col("_llm_number").bitwiseAND(F.lit((1 << 33) - 1))
    counted = staged.groupBy(task.alias("task")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).collect()  # a row per task
    counted = sorted(counted, key=lambda row: row["task"])
    rows, n_bytes = sum(row["n"] for row in counted), sum(row["bytes"] for row in counted)
    sizes = [rows // shards + (shard < rows % shards) for shard in range(shards)]
    matrix = communication_matrix([row["n"] for row in counted], sizes, seed)

    bounds = []
    for row, counts in zip(counted, matrix):
        total, ends = 0, []
        for count in counts:
            total += count
            ends.append(total)
        bounds.append((row["task"], ends))
    ends = spark.createDataFrame(bounds, "_llm_task long, _llm_ends array<long>")
    if len(bounds) * (8 * shards + 64) <= 64 * 1024 * 1024:
        ends = F.broadcast(ends)

    # A shard is cut into cells by the number that orders it, so that several tasks share its rows.
    cells = max(MIN_CELLS, -(-n_bytes // (shards * CELL_BYTES)))
    order = F.xxhash64("_llm_number", F.lit(seed + 1))
    dealt = (
        staged.withColumn("_llm_task", task)
        .join(ends, "_llm_task")
        .withColumn("shard", F.size(F.filter("_llm_ends", lambda end: end <= number)))
        .withColumn("_llm_order", order)
        .withColumn("_llm_cell", F.shiftrightunsigned("_llm_order", 32) * F.lit(cells))
        .withColumn("_llm_cell", F.col("shard") * F.lit(cells) + F.shiftrightunsigned("_llm_cell", 32))
        .drop("_llm_task", "_llm_ends")
    )
    per_cell = dict(dealt.groupBy("_llm_cell").count().collect())  # shards x cells numbers
    starts = []
    for shard in range(shards):
        start = 0
        for cell in range(shard * cells, (shard + 1) * cells):
            starts.append((cell, start))
            start += per_cell.get(cell, 0)
    first = spark.createDataFrame(starts, "_llm_cell long, _llm_first long")
    within = Window.partitionBy("_llm_cell").orderBy(F.shiftrightunsigned("_llm_order", 1), "_llm_number")
    return (
        dealt.withColumn("_llm_place", F.row_number().over(within) - 1)
        .join(F.broadcast(first) if len(starts) <= 1_000_000 else first, "_llm_cell")
        .withColumn("slot", F.col("_llm_first") + F.col("_llm_place"))
        .select(*[f"`{c}`" for c in docs.columns], "size", "text_crc32", "shard", "slot")
    )
