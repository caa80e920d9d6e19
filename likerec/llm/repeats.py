"""Repeated byte strings are cut from all documents, wherever they stand.

Every window of ``width`` bytes gets a key that equal windows share: the least hash of the strings of half the
width within it. Neighbouring windows mostly have the same key, so a text falls into few segments. Keys that occur
once are dropped before any text is moved; segments of the others meet by key, where a suffix array (``suffix.py``)
of the distinct segments finds the windows that start anywhere else.

Keys that gather too much text are split, again and again, by a further hash: equal windows have equal keys under
any hash, and segments that only have a passage in common part. Equal texts are one text with a count.

A passage that very many texts share keeps its windows under one key whatever the hash. The windows of keys that stay
heavy are counted by their digests instead, a row for each, combined before they are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from likerec.llm.common import stash, text_bytes, tidy, with_arrow_columns
from likerec.llm.suffix import repeated_starts

# A text is cut into segments in blocks of this size.
BLOCK_BYTES = 1 << 17
# Distinct text under one key beyond which the key is split, and how often before its windows are counted by digest.
KEY_BYTES = 400_000
SPLITS = 8
MULTIPLIER = 0x9E3779B97F4A7C15


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    base = 0xD6E8FEB86659FD93
    inverse = pow(base, -1, 1 << 64)
    ones = np.ones(BLOCK_BYTES + (1 << 14), np.uint64)
    up, down = ones * np.uint64(base), ones * np.uint64(inverse)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _string_hashes(block: np.ndarray, length: int, seed: int) -> np.ndarray:
    """A hash of each string of ``length`` bytes of a block."""
    up, down = _powers()
    sums = np.zeros(len(block) + 1, np.uint64)
    np.cumsum((block.astype(np.uint64) + np.uint64(1)) * up[: len(block)], out=sums[1:])
    hashes = (sums[length:] - sums[:-length]) * down[: len(block) - length + 1]
    hashes ^= np.uint64((seed * MULTIPLIER) & (1 << 64) - 1)
    for shift in (32, 29):
        hashes ^= hashes >> np.uint64(shift)
        hashes *= np.uint64(MULTIPLIER)
    return hashes ^ (hashes >> np.uint64(32))


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbouring values."""
    count = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max)
    padded[: len(values)] = values
    rows = padded.reshape(-1, width)
    forward = np.minimum.accumulate(rows, axis=1).ravel()
    backward = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:count], forward[width - 1: width - 1 + count])


def segments(text: bytes, width: int, seed: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Starts, ends, keys of the segments of a text, and whether the string of the key is in the segment twice.

    Each window of ``width`` bytes lies in exactly one segment.
    """
    half = width // 2
    span = width - half + 1  # strings in a window
    for at in range(0, max(0, len(text) - width + 1), BLOCK_BYTES):
        block = np.frombuffer(text, np.uint8, min(BLOCK_BYTES + width - 1, len(text) - at), at)
        hashes = _string_hashes(block, half, seed)
        least = _sliding_least(hashes, span)
        first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
        last = np.r_[first[1:], len(least)] - 1
        keys = least[first]
        again = np.zeros(len(first), bool)
        for k in range(0, len(first), 4096):
            part = slice(k, k + 4096)
            steps = np.arange(span)
            left = (hashes[first[part, None] + steps] == keys[part, None]).argmax(axis=1) + first[part]
            right = last[part] + span - 1 - (hashes[last[part, None] + steps[::-1]] == keys[part, None]).argmax(axis=1)
            again[part] = left != right
        yield first + at, last + at + width, keys.view(np.int64), again


def _key_rows(width: int):
    def rows(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            refs, parts = [], []
            for ref, text in zip(batch.column("_llm_ref").to_pylist(), text_bytes(batch)):
                for part in segments(text, width):
                    parts.append(part)
                    refs += [ref] * len(part[0])
            joined = [np.concatenate(column) for column in zip(*parts)] if parts else [np.empty(0, t) for t in ("i8", "i8", "i8", "?")]
            yield pa.RecordBatch.from_arrays(
                [pa.array(refs, pa.binary()), *[pa.array(x) for x in joined]], names=["ref", "start", "stop", "key", "again"])
    return rows


def _cut_rows(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each listed segment of a text."""
    for batch in source:
        ref, start, key, again, piece = [], [], [], [], []
        for r, text, listed in zip(batch.column("ref").to_pylist(), text_bytes(batch), batch.column("listed")):
            for s in listed.as_py():
                ref.append(r)
                start.append(s["start"])
                key.append(s["key"])
                again.append(s["again"])
                piece.append(text[s["start"]: s["stop"]])
        yield pa.RecordBatch.from_arrays(
            [pa.array(ref, pa.binary()), pa.array(start, pa.int64()), pa.array(key, pa.int64()), pa.array(again, pa.bool_()),
             pa.array(piece, pa.binary())], names=["ref", "start", "key", "again", "piece"])


def _split_rows(width: int, seed: int):
    def rows(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Segments of segments, by a further hash; the new key depends on the old one."""
        for batch in source:
            ref, start, key, again, piece = [], [], [], [], []
            columns = [batch.column(c).to_pylist() for c in ("ref", "start", "key", "piece")]
            for r, s, k, p in zip(*columns):
                for first, last, keys, twice in segments(p, width, seed):
                    for a, b, new, t in zip(first.tolist(), last.tolist(), keys.view(np.uint64).tolist(), twice.tolist()):
                        mixed = ((k & (1 << 64) - 1) * MULTIPLIER + new) & (1 << 64) - 1
                        ref.append(r)
                        start.append(s + a)
                        key.append(mixed - (1 << 64) if mixed >> 63 else mixed)
                        again.append(t)
                        piece.append(p[a:b])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ref, pa.binary()), pa.array(start, pa.int64()), pa.array(key, pa.int64()), pa.array(again, pa.bool_()),
                 pa.array(piece, pa.binary())], names=["ref", "start", "key", "again", "piece"])
    return rows


def _window_rows(width: int):
    def rows(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The digest of each window of each piece, in parts of bounded size."""
        for batch in source:
            for ref, start, piece in zip(*[batch.column(c).to_pylist() for c in ("ref", "start", "piece")]):
                count = len(piece) - width + 1
                for at in range(0, count, 20_000):
                    offsets = range(at, min(at + 20_000, count))
                    digests = [hashlib.blake2b(piece[k: k + width], digest_size=16).digest() for k in offsets]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([ref] * len(digests), pa.binary()), pa.array([start] * len(digests), pa.int64()),
                         pa.array(offsets, pa.int64()), pa.array(digests, pa.binary())], names=["ref", "start", "at", "window"])
    return rows


def _repeated_windows(pieces: DataFrame, width: int) -> DataFrame:
    """(ref, start, ranges) of ``pieces`` (ref, start, piece): their windows that are there more than once.

    Equal windows have equal keys under all hashes, so all of them are in ``pieces``, each place once.
    """
    windows = pieces.select("ref", "start", "piece").mapInArrow(_window_rows(width), "ref binary, start long, at long, window binary")
    repeated = windows.groupBy("window").count().where("count > 1").select("window")
    neighbours = F.row_number().over(Window.partitionBy("ref", "start").orderBy("at"))
    return (
        windows.join(repeated, "window", "left_semi").select("ref", "start", "at").withColumn("run", F.col("at") - neighbours)
        .groupBy("ref", "start", "run").agg(F.min("at").alias("first"), F.max("at").alias("last"))
        .groupBy("ref", "start").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    )


def _runs(starts: np.ndarray) -> list[dict[str, int]]:
    """Neighbouring starts as ranges, both ends included."""
    if not len(starts):
        return []
    breaks = np.flatnonzero(np.diff(starts) > 1)
    return [{"first": int(a), "last": int(b)} for a, b in zip(np.r_[starts[0], starts[breaks + 1]], np.r_[starts[breaks], starts[-1]])]


RANGES = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def _repeat_rows(width: int):
    def rows(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (key, piece, n, again) sorted by key: which windows of each distinct piece are repeated."""
        current, held = None, []

        def made() -> Iterator[pa.RecordBatch]:
            pieces = [piece for piece, _, _ in held]
            if len(held) > 1 or (held and held[0][2]):
                starts = repeated_starts(pieces, width)
            else:
                starts = [np.empty(0, np.int64)] * len(held)
            ranges = [_runs(s) if n == 1 else [{"first": 0, "last": len(piece) - width}] for s, (piece, n, _) in zip(starts, held)]
            found = [k for k, r in enumerate(ranges) if r]
            if found:
                digests = [hashlib.md5(pieces[k]).hexdigest() for k in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([current] * len(found), pa.int64()), pa.array(digests), pa.array([ranges[k] for k in found], RANGES)],
                    names=["key", "digest", "ranges"])

        for batch in source:
            for key, piece, n, again in zip(*[batch.column(c).to_pylist() for c in ("key", "piece", "n", "again")]):
                if key != current:
                    yield from made()
                    current, held = key, []
                held.append((piece, n, again))
        yield from made()

    return rows


def remove_repeats(docs: DataFrame, width: int = 400) -> DataFrame:
    """``docs`` with ``kept`` (the bytes left), ``n_bytes`` (before), ``n_removed`` and ``n_spans``.

    Each byte goes that is covered by a string of ``width`` bytes that also starts anywhere else, in the same
    document or another; strings may overlap, never cross documents, and are judged on the input. ``n_spans``
    counts the maximal runs removed. Cuts may fall within characters, so ``kept`` is binary.

    Null texts count as empty; texts shorter than ``width`` stay. Each row counts, so repeated rows lose all of
    their texts. Columns named like an output are replaced; an empty table gives an empty result.
    """
    added = [T.StructField("kept", T.BinaryType()), *[T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")]]
    docs = tidy(docs, ["doc_id", "text"], [f.name for f in added])
    with_ref = docs.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit(""))).withColumn("_llm_ref", F.unhex(F.md5("text")))
    long_texts = with_ref.where(F.octet_length("text") >= width)
    texts = stash(
        long_texts.groupBy(F.col("_llm_ref").alias("ref")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("keeper")),
        "repeat-texts")

    keys = stash(
        long_texts.select("_llm_ref", "text").mapInArrow(_key_rows(width), "ref binary, start long, stop long, key long, again boolean"),
        "repeat-keys")

    def shared(rows: DataFrame) -> DataFrame:
        """Keys of two different places, or twice in one."""
        place = F.xxhash64("ref", "start")
        return (
            rows.groupBy("key").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.max("again").alias("again"))
            .where("a <> b OR again").select("key")
        )

    listed = (
        # Equal texts give equal rows; a set takes them once, and nothing between the join and the shuffle by text
        # keeps Spark from splitting a key that very many texts have.
        keys.join(shared(keys), "key", "left_semi")
        .groupBy("ref").agg(F.collect_set(F.struct("start", "stop", "key", "again")).alias("listed"))
        .join(texts.select("ref", "keeper"), "ref")
    )
    # One row of equal texts is cut into segments.
    one = long_texts.select("doc_id", "_llm_ref", "text").join(
        listed, (F.col("_llm_ref") == F.col("ref")) & F.col("doc_id").eqNullSafe(F.col("keeper")))
    schema = "ref binary, start long, key long, again boolean, piece binary"
    pieces = stash(one.select("ref", "text", "listed").mapInArrow(_cut_rows, schema), "repeat-pieces")

    settled = counted = None
    for split in range(1, SPLITS + 2):
        sizes = pieces.groupBy("key", F.md5("piece").alias("digest")).agg(F.first(F.octet_length("piece")).alias("n"))
        heavy = stash(sizes.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > KEY_BYTES).select("key"), "repeat-heavy-keys")
        if heavy.isEmpty():
            break
        light = pieces.join(heavy, "key", "left_anti")
        settled = light if settled is None else settled.unionByName(light)
        dense = pieces.join(heavy, "key", "left_semi")
        if split > SPLITS:
            counted, pieces = _repeated_windows(dense, width), None
            break
        divided = stash(dense.mapInArrow(_split_rows(width, split), schema), "repeat-divided")
        pieces = stash(divided.join(shared(divided), "key", "left_semi"), "repeat-pieces")
    if settled is not None:
        pieces = settled if pieces is None else settled.unionByName(pieces)

    distinct = pieces.groupBy("key", "piece").agg(F.count("*").alias("n"), F.max("again").alias("again"))
    repeated = (
        distinct.repartition("key").sortWithinPartitions("key")
        .mapInArrow(_repeat_rows(width), "key long, digest string, ranges array<struct<first:long,last:long>>")
    )
    hits = (
        pieces.withColumn("digest", F.md5("piece")).select("ref", "start", "key", "digest")
        .join(repeated, ["key", "digest"]).select("ref", "start", "ranges")
    )
    found = (
        (hits if counted is None else hits.unionByName(counted))
        .groupBy("ref").agg(F.collect_list(F.struct("start", "ranges")).alias("_llm_found"))
    )
    known = texts.join(found, "ref", "left").where("copies > 1 OR _llm_found IS NOT NULL").select(
        F.col("ref").alias("_llm_known"), (F.col("copies") > 1).alias("_llm_whole"), "_llm_found")

    def cut(batch: pa.RecordBatch) -> list[pa.Array]:
        made = []
        for text, whole, hits in zip(text_bytes(batch), batch.column("_llm_whole").to_pylist(), batch.column("_llm_found")):
            if whole:
                made.append((b"", len(text), len(text), 1))
                continue
            spans = sorted((hit["start"] + r["first"], hit["start"] + r["last"] + width)
                           for hit in hits.as_py() or () for r in hit["ranges"])
            merged: list[list[int]] = []
            for a, b in spans:
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            edges = [0, *[x for span in merged for x in span], len(text)]
            kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
            made.append((kept, len(text), len(text) - len(kept), len(merged)))
        types = [pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        return [pa.array([row[k] for row in made], kind) for k, kind in enumerate(types)]

    joined = with_ref.join(known, F.col("_llm_ref") == F.col("_llm_known"), "left")
    return with_arrow_columns(joined, added, cut, "_llm_ref", "_llm_known", "_llm_whole", "_llm_found")
