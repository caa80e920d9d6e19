"""Byte-level BPE encoding and decoding of whole texts by tree reduction.

Encodings of neighbouring texts form a monoid: ``join`` makes the encoding of the whole from those of two halves.
It looks for a safe boundary on each side of the seam, in windows that grow until there is one, re-encodes what
lies between and keeps all tokens outside. A boundary is safe if the splitting pattern has one there whatever the
rest of the text is, which the two characters beside it decide; so tokens outside are proven final.

A piece of the pattern longer than a leaf (a run of letters without end) is a tree too. There the window of tokens
grows until the pair of tokens at either edge is what their joined bytes encode to: an encoding all of whose
neighbouring pairs are such is the encoding of the whole.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from likerec.llm.common import tidy, with_arrow_columns

LEAF_CHARS = 2048
FIRST_WINDOW = 48
MAX_WINDOW = 4096
LEAF_IDS = 8192

# Between no blank and a space with no blank behind it; after a letter, before another kind; after a digit likewise.
SAFE = regex.compile(r"(?<=\S)(?= \S)|(?<=\p{L})(?=[^\s\p{L}])|(?<=\p{N})(?=[^\s\p{N}])")


class TreeEncoder:
    """Encodes by the ranks of one vocabulary, as a tree over the text."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf_chars: int = LEAF_CHARS):
        import tiktoken

        self.leaf = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.leaf_chars = leaf_chars
        self.bytes_of = {rank: token for token, rank in ranks.items()}

    def encode(self, text: str) -> list[int]:
        if len(text) <= self.leaf_chars:
            return self.leaf.encode_ordinary(text)
        middle = len(text) // 2
        left, right = text[:middle], text[middle:]
        return self.join(left, self.encode(left), right, self.encode(right))

    def join(self, left: str, left_ids: list[int], right: str, right_ids: list[int]) -> list[int]:
        """The encoding of ``left + right`` from those of its parts."""
        tail, head = self._tail(left), self._head(right)
        drop_left, drop_right = len(self._between(tail)), len(self._between(head))
        return left_ids[: len(left_ids) - drop_left] + self._between(tail + head) + right_ids[drop_right:]

    @staticmethod
    def _windows(length: int) -> Iterator[int]:
        width = FIRST_WINDOW
        while width < min(length, MAX_WINDOW):
            yield width
            width *= 4
        yield length

    def _tail(self, text: str) -> str:
        """What follows the last safe boundary that a window shows; all of the text if there is none."""
        for width in self._windows(len(text)):
            start = len(text) - width
            found = None
            for found in SAFE.finditer(text, pos=start + 1 if start else 0):
                pass
            if found:
                return text[found.start():]
        return text

    def _head(self, text: str) -> str:
        """What precedes the first safe boundary."""
        for width in self._windows(len(text)):
            found = SAFE.search(text[:width])
            if found:
                return text[: found.start()]
        return text

    def _between(self, text: str) -> list[int]:
        if len(text) <= 2 * self.leaf_chars:
            return self.leaf.encode_ordinary(text)
        return [token for piece in self.pattern.finditer(text) for token in self.encode_piece(piece.group())]

    def encode_piece(self, piece: str) -> list[int]:
        """The encoding of one piece of the pattern."""
        if len(piece) <= self.leaf_chars:
            return self._merge(piece.encode())
        middle = len(piece) // 2
        return self.join_piece(self.encode_piece(piece[:middle]), self.encode_piece(piece[middle:]))

    def _merge(self, piece: bytes) -> list[int]:
        return self.leaf._encode_single_piece(piece)

    def join_piece(self, left: list[int], right: list[int]) -> list[int]:
        width = 4
        while True:
            before, after = left[:-width], right[width:]
            window = self._merge(b"".join(self.bytes_of[t] for t in left[-width:] + right[:width]))
            if (not before or self._final(before[-1], window[0])) and (not after or self._final(window[-1], after[0])):
                return before + window + after
            width *= 2

    def _final(self, a: int, b: int) -> bool:
        """Whether two tokens are what their joined bytes encode to."""
        return self._merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]


def decode(ids: np.ndarray, bytes_of: dict[int, bytes]) -> bytes:
    """The bytes of token ids, by halves."""
    if len(ids) <= LEAF_IDS:
        return b"".join([bytes_of[k] for k in ids.tolist()])
    middle = len(ids) // 2
    return decode(ids[:middle], bytes_of) + decode(ids[middle:], bytes_of)


def load_ranks(ranks_path: str) -> dict[bytes, int]:
    """The ranks of a file with a token in base64 and its rank per line."""
    with open(ranks_path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def load_tokens(ranks_path: str) -> dict[int, bytes]:
    return {rank: token for token, rank in load_ranks(ranks_path).items()}


def load(ranks_path: str, pattern: str) -> TreeEncoder:
    return TreeEncoder(load_ranks(ranks_path), pattern)


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``docs`` with ``n_tokens`` and ``ids``: token ids packed as little-endian unsigned 32-bit integers.

    Null texts encode as empty ones: no ids, 0 tokens. The file must lie at the same path on all executors.
    Columns named like an output are replaced; an empty table gives an empty result.
    """
    outputs = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())]
    docs = tidy(docs, ["text"], [f.name for f in outputs])

    held: list[TreeEncoder] = []  # of one task; it goes with it

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        if not held:
            held.append(load(ranks_path, pattern))
        encoder = held[0]
        packed = [np.array(encoder.encode(text.as_py() or ""), dtype="<u4").tobytes() for text in batch.column("text")]
        return [pa.array([len(ids) // 4 for ids in packed], pa.int64()), pa.array(packed, pa.binary())]

    return with_arrow_columns(docs.withColumn("text", F.col("text").cast("string")), outputs, compute)


def decode_ids(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """``encoded`` with ``decoded``: the bytes that ``ids`` stand for; null ids decode as none."""
    outputs = [T.StructField("decoded", T.BinaryType())]
    encoded = tidy(encoded, ["ids"], ["decoded"])

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        bytes_of = load_tokens(ranks_path)
        return [pa.array([decode(np.frombuffer(ids.as_py() or b"", "<u4"), bytes_of) for ids in batch.column("ids")], pa.binary())]

    return with_arrow_columns(encoded, outputs, compute)
