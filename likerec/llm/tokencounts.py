"""Token counts of whole texts, by a tokenizer library in Arrow functions that return lengths only.

Texts are cut at safe boundaries: before a single space between two characters that are no blanks. A byte-level
tokenizer's splitting pattern starts a new piece at each of them, whatever stands around, so counts add up. The
distinct pieces of a group of texts are encoded in batches of about the same number of bytes; counts of short
pieces are kept in a table of bounded size per worker.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from likerec.llm.common import tidy, with_arrow_columns

BOUNDARY = re.compile(r"(?<=\S) (?=\S)")
# Characters of texts taken together, characters of one call of the library.
GROUP_CHARS, BATCH_CHARS = 4_000_000, 250_000
# Longest piece whose count is kept, and how many are.
KEPT_CHARS, KEPT_PIECES = 40, 400_000


@lru_cache(maxsize=2)
def _load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class _Counter:
    """Counts tokens of texts by their pieces."""

    def __init__(self, path: str):
        self.tokenizer = _load(path)
        self.known: dict[str, int] = {}

    def _encode(self, pieces: list[str]) -> Iterator[int]:
        at = 0
        while at < len(pieces):
            end, size = at, 0
            while end < len(pieces) and (end == at or size + len(pieces[end]) <= BATCH_CHARS):
                size += len(pieces[end])
                end += 1
            for encoded in self.tokenizer.encode_batch_fast(pieces[at:end], add_special_tokens=False):
                yield len(encoded.ids)
            at = end

    def __call__(self, texts: list[str]) -> list[int]:
        known = self.known
        if len(known) > KEPT_PIECES:
            known.clear()
        cut = []
        for text in texts:
            pieces = BOUNDARY.split(text)
            cut.append((pieces[:1], pieces[1:]))
        unknown = {f" {piece}" for _, rest in cut for piece in set(rest) if f" {piece}" not in known}
        unknown.update(piece for first, _ in cut for piece in first if piece not in known)
        wanted = sorted(unknown, key=len)
        counts = dict(zip(wanted, self._encode(wanted)))
        known.update((piece, n) for piece, n in counts.items() if len(piece) <= KEPT_CHARS)

        def of(piece: str) -> int:
            n = known.get(piece)
            return counts[piece] if n is None else n

        return [sum(of(p) for p in first) + sum([of(f" {p}") for p in rest]) for first, rest in cut]


@lru_cache(maxsize=2)
def _counter(path: str) -> _Counter:
    """The counter of a worker, whose table of pieces outlives a batch."""
    return _Counter(path)


def _grouped(texts: list[str | None]) -> Iterator[list[str]]:
    group, size = [], 0
    for text in texts:
        text = text or ""
        if group and size + len(text) > GROUP_CHARS:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield group


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 512) -> DataFrame:
    """``docs`` with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    Counts are those of the library for the whole text, without begin or end tokens; strings of special tokens in
    a text are treated as the library does by default. The file must describe a byte-level tokenizer whose pattern
    takes a space together with what follows, and lie at the same path on all executors. Null texts count as
    empty: 0 bytes, 0 tokens. Columns named like an output are replaced; an empty table gives an empty result.
    """
    outputs = [T.StructField("n_tokens", T.LongType())]
    docs = tidy(docs, ["text"], ["n_bytes", "n_tokens", "over_limit"])

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        counter = _counter(tokenizer_path)
        counts = [n for group in _grouped(batch.column("_llm_text").to_pylist()) for n in counter(group)]
        return [pa.array(counts, pa.int64())]

    with_text = docs.withColumn("_llm_text", F.col("text").cast("string"))
    counted = with_arrow_columns(with_text, outputs, compute, "_llm_text")
    n_bytes = F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long")
    return counted.select(*[f"`{c}`" for c in docs.columns], n_bytes.alias("n_bytes"), "n_tokens",
                          (F.col("n_tokens") > limit).alias("over_limit"))
