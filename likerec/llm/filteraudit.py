"""What each of several filters removes, alone and after others, in every order of application."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from likerec.llm.common import stash, tidy

# The filters' letters, and their limits.
LETTERS = "ABCDE"
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_UPPER_PERCENT = 3
SYMBOLS = "#$%&*|"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

COUNTS = ["n", "good", "toxic"]
STATES = f"part string, states array<struct<{', '.join(f'{c}: bigint' for c in COUNTS)}>>"
STEPS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def text_failures(text: Column) -> dict[str, Column]:
    """The filters that look at one text: failure condition by letter.

    A: under 200 words; B: fewer distinct words than half of them; C: over 3 % of the code points in A-Z; D: one of
    ``#$%&*|``. Words are runs of anything but ASCII blanks; an empty text has none, and fails A alone.
    """
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    return {
        "A": F.size(words) < MIN_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < MIN_DISTINCT_PERCENT * F.size(words),
        "C": 100 * (F.length(text) - F.length(F.translate(text, UPPER, ""))).cast("long") > MAX_UPPER_PERCENT * F.length(text),
        "D": F.length(F.translate(text, SYMBOLS, "")) < F.length(text),
    }


def failure_masks(
    docs: DataFrame, failures: Callable[[Column], dict[str, Column]] = text_failures, letters: str = LETTERS, part: str = "lang"
) -> DataFrame:
    """(doc_id, part, digest, mask): a bit for each filter in ``failures`` that a text fails, and the text's digest."""
    docs = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("_llm_text"))
    mask = F.lit(0)
    for letter, failed in failures(F.col("_llm_text")).items():
        mask = mask + F.when(failed, 1 << letters.index(letter)).otherwise(0)
    return docs.select("doc_id", "part", F.unhex(F.sha2("_llm_text", 256)).alias("digest"), mask.cast("int").alias("mask"))


def failure_cells(masked: DataFrame, labels: DataFrame, copy_bit: int) -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and failures, with the bit of later copies added.

    A document is a later copy if a row with a smaller id has its text, anywhere in the table; a null id is larger than
    every other, and rows of one id are no copies of each other. Nothing is joined for it: rows are counted by text and
    id, then by text and part with the least id and its count, and a text's parts are held against its least id. Each
    count combines within tasks first, so that a text that a third of the rows share is a few rows after them. Labels
    of one id are combined: good if one says so, toxic if one says so.
    """
    labelled = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = masked.groupBy("doc_id", "digest", "mask", "part").agg(F.count("*").alias("n")).join(labelled, "doc_id", "left")
    flags = [F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")]
    # Nulls last: they sort first in a struct, so a flag goes before the id.
    placed = F.struct(F.col("doc_id").isNull().alias("late"), F.col("doc_id").alias("id"), F.col("n").alias("n"))
    groups = stash(
        rows.select("digest", "mask", "part", *flags, "n", placed.alias("first")).groupBy("digest", "mask", "part", "good", "toxic").agg(
            F.sum("n").alias("n"), F.min("first").alias("first")), "audit-texts")
    least = groups.groupBy("digest").agg(F.min(F.struct("first.late", "first.id")).alias("least"))
    same = (F.col("first.late") == F.col("least.late")) & F.col("first.id").eqNullSafe(F.col("least.id"))
    first = F.when(same, F.col("first.n")).otherwise(0)
    split = groups.join(least, "digest").select("part", "mask", "good", "toxic", F.explode(F.array(
        F.struct(F.col("mask").alias("all"), first.alias("rows")),
        F.struct((F.col("mask") + (1 << copy_bit)).alias("all"), (F.col("n") - first).alias("rows")))).alias("c"))
    return split.where("c.rows > 0").groupBy("part", F.col("c.all").alias("mask")).agg(
        F.sum("c.rows").alias("n"), F.sum(F.expr("good * c.rows")).alias("good"), F.sum(F.expr("toxic * c.rows")).alias("toxic"))


def gray_walk(cells: list[tuple[int, tuple[int, ...]]], filters: int) -> list[tuple[int, ...]]:
    """What survives each set of filters, by the set's bits; ``cells`` has the counts of each failure mask.

    The sets are met in the order of the Gray code, so that each step turns one filter on or off. A cell counts
    how many active filters it fails; it leaves the running survivors when that count rises from none and joins them
    when it falls back to none.
    """
    survivors = [sum(counts[k] for _, counts in cells) for k in range(len(COUNTS))]
    failing = [0] * len(cells)
    states = {0: tuple(survivors)}
    active = 0
    for step in range(1, 1 << filters):
        bit = step & -step  # the one in which step's code differs from its predecessor's
        active ^= bit
        change = 1 if active & bit else -1
        for k, (mask, counts) in enumerate(cells):
            if mask & bit:
                before, failing[k] = failing[k], failing[k] + change
                if not before or not failing[k]:
                    survivors = [s - change * c for s, c in zip(survivors, counts)]
        states[active] = tuple(survivors)
    return [states[s] for s in range(1 << filters)]


def survivor_states(cells: DataFrame, filters: int) -> DataFrame:
    """(part, states): documents, good and toxic ones that pass each set of filters; a row of 2^filters states per part.

    No part has more than 2^filters cells, whatever its documents.
    """
    packed = cells.groupBy("part").agg(F.collect_list(F.struct("mask", *COUNTS)).alias("cells"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([(c, pa.int64()) for c in COUNTS])
        for batch in batches:
            states = [[dict(zip(COUNTS, s)) for s in gray_walk([(c["mask"], tuple(c[k] for k in COUNTS)) for c in found], filters)]
                      for found in batch.column("cells").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("part"), pa.array(states, pa.list_(kind))], names=["part", "states"])

    return packed.mapInArrow(walk, STATES)


def steps_of_orders(states: DataFrame, letters: str) -> DataFrame:
    """A row for each part, order of the filters and step: the difference of the two states around the step.

    ``shapley`` weighs the filter's differences by the number of orders that meet them, which is its ``removed`` summed
    over all orders.
    """
    size = len(letters)
    everything = (1 << size) - 1
    state = lambda which, count: F.element_at("states", which + 1)[count]
    alone = [(state(F.lit(everything ^ bit), "n") - state(F.lit(everything), "n")) for bit in (1 << k for k in range(size))]
    fails = [(state(F.lit(0), "n") - state(F.lit(1 << k), "n")) for k in range(size)]
    shapley = []
    for k in range(size):
        total = F.lit(0).cast("long")
        for others in (s for s in range(1 << size) if not s >> k & 1):
            orders = math.factorial(others.bit_count()) * math.factorial(size - 1 - others.bit_count())
            total = total + orders * (state(F.lit(others), "n") - state(F.lit(others | 1 << k), "n"))
        shapley.append(total)
    made = []
    for order in itertools.permutations(range(size)):
        before = 0
        for step, k in enumerate(order, 1):
            made.append(("".join(letters[i] for i in order), step, k, before, before | 1 << k))
            before |= 1 << k
    steps = F.from_json(F.lit("[" + ",".join('{"o":"%s","s":%d,"k":%d,"b":%d,"a":%d}' % m for m in made) + "]"),
                        "array<struct<o: string, s: int, k: int, b: int, a: int>>")
    by_filter = states.select("part", "states", *[F.array(*values).alias(name) for name, values in
                                                  (("unique", alone), ("fails", fails), ("shapley", shapley))])
    rows = by_filter.select("part", "states", "unique", "fails", "shapley", F.explode(steps).alias("t"))
    lost = lambda count: state(F.col("t.b"), count) - state(F.col("t.a"), count)
    of = lambda name: F.element_at(name, F.col("t.k") + 1)
    return rows.select(
        "part", F.col("t.o").alias("filter_order"), F.col("t.s").alias("step"), F.substring(F.col("t.o"), F.col("t.s"), F.lit(1)).alias("filter"),
        state(F.col("t.a"), "n").alias("kept"), lost("n").alias("removed"), (of("fails") - lost("n")).alias("redundant"),
        of("unique").alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), of("shapley").alias("shapley"))


def audit_filters(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """How filters A to E (``text_failures``, and E: a copy of a row with a smaller id) interact, by part.

    One row for each part (null: empty string, counted with parts that are empty), order of the filters and step, with
    the filter's letter and counts of documents: ``kept`` after the step, ``removed`` by it, ``redundant`` (failing
    it, removed earlier), ``unique_fails`` (failing it alone), ``good_lost`` and ``toxic_lost`` (removed, of these labels) and
    ``shapley`` (removed by this filter, summed over all orders). Each row of a repeated document counts; null texts
    are empty; documents without a label are neither good nor toxic; empty documents give no rows.
    """
    masked = failure_masks(tidy(docs, ["doc_id", "text", part], []), part=part)
    cells = failure_cells(masked, tidy(labels, ["doc_id", "quality", "toxic"], []), LETTERS.index("E"))
    return steps_of_orders(survivor_states(cells, len(LETTERS)), LETTERS)
