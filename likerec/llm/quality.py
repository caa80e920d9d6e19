"""Quality rules on documents, and verdicts on the hosts they come from.

Each document is held against base rules. Failures are counted by host and rule, and each host's rate is shrunk
towards the rate of all hosts: the prior is a beta distribution whose mean and weight are fitted to the hosts'
counts by the method of moments, so a host of few documents is judged mostly by what hosts are like. Hosts whose
shrunk rate of some rule is too high lose all their documents. Some rules are for hosts only: a document may break
them, but a host whose documents often do is bad. What is too high follows from the prior: more than hosts differ.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from likerec.llm.common import BLANKS, broadcast_bounded, stash, text_bytes, tidy, with_arrow_columns

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RULES = {"too_short": "n_words < {min_words}", "too_repetitive": "100 * n_repeat_words > {max_repeat_percent} * n_words"}
# Not a reason to drop a document by itself.
HOST_RULES = {
    "symbol_heavy": "100 * n_symbols > {max_symbol_percent} * word_chars",
    "repeats_lines": "{words_per_dup_line} * n_dup_lines > n_words",
    "long_words": "word_chars > {max_word_chars} * n_words",
}
ALL_RULES = [*RULES, *HOST_RULES]
# A host's limit is so many standard deviations of the prior over its mean, but at least ``LEAST_RATE``.
DEVIATIONS, LEAST_RATE = 4.0, 0.1
# The weight of the prior, in documents, stays within these bounds.
LEAST_WEIGHT, MOST_WEIGHT = 1.0, 10_000.0


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """How many words lie in a window of ``width`` words that is found at least twice."""
    if len(words) <= width:
        return 0
    table: dict[bytes, int] = {}
    ids = np.fromiter((table.setdefault(w, len(table)) for w in words), np.int64, len(words))
    code, values = ids, len(table)
    for k in range(1, width):
        if values * len(table) >= 1 << 62:
            distinct, code = np.unique(code, return_inverse=True)
            values = len(distinct)
        code = code[:-1] * len(table) + ids[k:]
        values *= len(table)
    _, inverse, counts = np.unique(code, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[inverse] > 1)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + width, -1)
    return int(np.count_nonzero(np.cumsum(change)))


def measure(text: bytes) -> tuple[int, ...]:
    """The numbers of ``MEASURES`` for one text."""
    words = text.split()
    joined = b"".join(words)
    lines = [line for line in text.split(b"\n") if line.strip(BLANKS)]
    return (
        len(words),
        len(joined.decode()),
        len(joined) - len(joined.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def base_rules(docs: DataFrame, min_words: int = 10, max_repeat_percent: int = 20, max_symbol_percent: int = 10,
               words_per_dup_line: int = 20, max_word_chars: int = 10) -> DataFrame:
    """``docs`` with the columns of ``MEASURES``, one boolean per rule, and ``base_failed`` (any of ``RULES``).

    Words are runs without blanks. ``word_chars``: code points in words. ``n_symbols``: characters of ``#*$%&|<>``.
    ``n_dup_lines``: lines with a word that equal an earlier line. ``n_repeat_words``: words in five-word windows
    found at least twice in the text. Null and empty texts have no words and fail. Columns named like an output are
    replaced; an empty table gives an empty result.
    """
    docs = tidy(docs, ["text"], [*MEASURES, *ALL_RULES, "base_failed"])

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        rows = [measure(text) for text in text_bytes(batch, "_llm_text")]
        return [pa.array([row[k] for row in rows], pa.int64()) for k in range(len(MEASURES))]

    fields = [T.StructField(name, T.LongType()) for name in MEASURES]
    measured = with_arrow_columns(docs.withColumn("_llm_text", F.col("text").cast("string")), fields, compute, "_llm_text")
    limits = {"min_words": min_words, "max_repeat_percent": max_repeat_percent, "max_symbol_percent": max_symbol_percent,
              "words_per_dup_line": words_per_dup_line, "max_word_chars": max_word_chars}
    failed = {name: F.expr(rule.format(**limits)) for name, rule in (RULES | HOST_RULES).items()}
    return measured.withColumns(failed).withColumn("base_failed", F.expr(" OR ".join(RULES)))


def host_rates(judged: DataFrame, host: str = "source", max_rate: float = 0.5) -> DataFrame:
    """One row per host: ``n_docs``, and for each rule its failures ``f_<rule>``, shrunk rate ``rate_<rule>`` and the ``limit_<rule>``.

    With N documents of k hosts, f of them failing, p = f / N, Q = sum n_i (p_i - p)^2: the share of variance between
    hosts is (Q / (p (1 - p)) - (k - 1)) / (N - sum n_i^2 / N - (k - 1)), and the weight of the prior its inverse
    less 1, within bounds. Where p is 0 or 1 or there is one host, the weight m is at its upper bound. The limit is
    ``DEVIATIONS`` standard deviations of the prior, sqrt(p (1 - p) / (m + 1)), over p, within ``LEAST_RATE`` and ``max_rate``.
    """
    counts = [F.sum(F.col(rule).cast("long")).alias(f"f_{rule}") for rule in ALL_RULES]
    hosts = stash(judged.groupBy(host).agg(F.count("*").alias("n_docs"), *counts), "quality-hosts")
    n = F.col("n_docs")
    sums = [F.count("*").alias("k"), F.sum("n_docs").alias("n"), F.sum(n.cast("double") * n).alias("nn")]
    for rule in ALL_RULES:
        f = F.col(f"f_{rule}").cast("double")
        sums += [F.sum(f"f_{rule}").alias(f"f_{rule}"), F.sum(f * f / n).alias(f"ff_{rule}")]
    total = hosts.agg(*sums).first()  # one row of sums
    rates = {}
    for rule in ALL_RULES:
        weight, p = MOST_WEIGHT, 0.0
        if total["n"]:
            p = total[f"f_{rule}"] / total["n"]
            spread = total["n"] - total["nn"] / total["n"] - (total["k"] - 1)
            if 0 < p < 1 and total["k"] > 1 and spread > 0:
                q = total[f"ff_{rule}"] - total["n"] * p * p
                between = (q / (p * (1 - p)) - (total["k"] - 1)) / spread
                weight = min(MOST_WEIGHT, max(LEAST_WEIGHT, 1 / between - 1)) if between > 0 else MOST_WEIGHT
        rates[f"rate_{rule}"] = (F.col(f"f_{rule}") + F.lit(p * weight)) / (n + F.lit(weight))
        usual = p + DEVIATIONS * math.sqrt(p * (1 - p) / (weight + 1))
        rates[f"limit_{rule}"] = F.lit(min(max_rate, max(LEAST_RATE, usual)))
    return hosts.withColumns(rates)


def with_host_verdicts(judged: DataFrame, host: str = "source", max_rate: float = 0.5) -> DataFrame:
    """``judged`` (of ``base_rules``) with ``host_failed`` and ``kept``.

    A host fails if the shrunk rate of some rule is over its limit, ``max_rate`` at most: it breaks the rule more often
    than hosts differ. Kept are documents that pass the base rules, of hosts that pass. A null host is a host of its own.
    """
    judged = stash(tidy(judged, [host, *ALL_RULES, "base_failed"], ["host_failed", "kept"]), "quality-judged")
    rates = host_rates(judged, host, max_rate)
    failed = F.greatest(*[F.col(f"rate_{rule}") - F.col(f"limit_{rule}") for rule in ALL_RULES]) > 0
    verdicts = stash(rates.select(F.col(host).alias("_llm_host"), failed.alias("host_failed")), "quality-verdicts")
    return (
        judged.join(broadcast_bounded(verdicts, 256), F.col(host).eqNullSafe(F.col("_llm_host")), "left").drop("_llm_host")
        .withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed"))
    )
