"""Near-duplicate documents by SimHash fingerprints, found with Golay-code fuzzy keys.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits, each a word of the perfect binary Golay code of
length 23 (leading zeros). Decoding a word gives the index of its codeword; a word and its one-bit neighbours decode
to at most six indices. Of three errors in three segments, some two segments have at most one each (pigeonhole).
So one fingerprint's own pair of indices is among the index pairs of the other's neighbours, for one of three pairs
of segments: each fingerprint is stored under 3 keys and looks under 3 x 36 at most. Rows that meet under a key are
verified, and each key yields only the links of a spanning forest, never all pairs.

Keys under which many fingerprints are stored or looked for are cut into cells: stored rows are dealt to blocks,
looking rows to others, and each pair of blocks is a cell of its own, so no task gathers more than two blocks of one
key. How many blocks a key needs is estimated from the keys of every 64th fingerprint; that decides about cells, not
about results. There are 3 x 2^24 keys, so a key of a table of N spread fingerprints has N / 2^24 stored and 36 N / 2^24
looking rows: 60 and 2,100 of 10^9, far below a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from likerec.llm.common import broadcast_bounded, stash, text_bytes, tidy, with_arrow_columns
from likerec.llm.components import component_labels
from likerec.session import shuffle_width

# Fixed value: a generator polynomial of the binary Golay code of length 23.
GOLAY_GENERATOR = 0b101011100011
SEGMENTS = ((42, 22), (21, 21), (0, 21))  # lowest bit and length
MAX_INDICES = 6
# Rows of a cell: stored and looking ones.
BLOCK_ROWS, LOOK_ROWS = 4096, 65_536
# Every so many fingerprints are counted to find crowded keys.
COUNTED = 64
COMPARED_AT_ONCE = 1 << 20
# Bytes of text that are taken into words at a time.
TEXT_BLOCK = 1 << 20


def word_blocks(text: bytes) -> Iterator[list[bytes]]:
    """Lists of lower-cased words; a block ends at a blank if there is one near enough."""
    start = 0
    while start < len(text):
        end = min(len(text), start + TEXT_BLOCK)
        while end < len(text) and text[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield text[start:end].lower().split()
        start = end


def shingle_hashes(text: bytes, words: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of the shingles of a text in order, repeats included, block by block."""
    carried: list[bytes] = []
    whole = True
    for block in word_blocks(text):
        carried = carried + block
        if len(carried) >= words:
            whole = False
            windows = zip(*[carried[k:] for k in range(words)])
            yield np.array([xxhash.xxh64_intdigest(b" ".join(w), 42) for w in windows], dtype=np.uint64)
            carried = carried[len(carried) - words + 1:]
    if whole and carried:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(carried), 42)], dtype=np.uint64)


def fingerprint(text: bytes, words: int) -> int:
    """A bit is 1 if it is set in over half the hashes; 0 for a text without words."""
    ones, total = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text, words):
        for at in range(0, len(hashes), 65_000):
            part = hashes[at: at + 65_000]
            bits = np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            ones += bits.sum(axis=0, dtype=np.uint16)
        total += len(hashes)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """``docs`` with ``_llm_fp``: the fingerprint as a signed 64-bit number. Null texts have no words."""

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        made = np.array([fingerprint(text, words) for text in text_bytes(batch)], dtype=np.uint64)
        return [pa.array(made.view(np.int64), pa.int64())]

    return with_arrow_columns(docs.withColumn("text", F.col("text").cast("string")), [T.StructField("_llm_fp", T.LongType())], compute)


@lru_cache(maxsize=1)
def _golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """The remainder of each upper half of a word by the generator, and the error that each remainder stands for."""
    def remainder(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GOLAY_GENERATOR << (bit - 11)
        return word

    upper = np.array([remainder(k << 11) for k in range(4096)], dtype=np.int64)
    errors = np.zeros(2048, np.int64)
    for weight in range(4):
        for places in combinations(range(23), weight):
            error = sum(1 << p for p in places)
            errors[upper[error >> 11] ^ (error & 2047)] = error
    return upper, errors


def codeword_index(words: np.ndarray, with_codeword: bool = False):
    """The index (upper 12 bits) of the codeword within distance 3 of each 23-bit word, and the codeword if asked for."""
    upper, errors = _golay_tables()
    codewords = words ^ errors[upper[words >> 11] ^ (words & 2047)]
    return (codewords >> 11, codewords) if with_codeword else codewords >> 11


def neighbour_indices(words: np.ndarray, length: int) -> np.ndarray:
    """The distinct indices of each word and its one-bit neighbours, in six columns; -1 fills up."""
    around = np.concatenate([words[:, None], words[:, None] ^ (1 << np.arange(length, dtype=np.int64))], axis=1)
    indices = np.sort(codeword_index(around), axis=1)
    indices[:, 1:][indices[:, 1:] == indices[:, :-1]] = -1
    return -np.sort(-indices, axis=1)[:, :MAX_INDICES]


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys that fingerprints are stored under, and those that they look under, each with the fingerprint's place."""
    words = [((fps >> np.uint64(low)) & np.uint64((1 << length) - 1)).astype(np.int64) for low, length in SEGMENTS]
    own = [codeword_index(w) for w in words]
    near = [neighbour_indices(w, length) for w, (_, length) in zip(words, SEGMENTS)]
    place = np.arange(len(fps))
    stored, looking, looker = [], [], []
    for number, (a, b) in enumerate(((0, 1), (0, 2), (1, 2))):
        stored.append((number << 24) | (own[a] << 12) | own[b])
        grid = (number << 24) | (near[a][:, :, None] << 12) | near[b][:, None, :]
        valid = (near[a][:, :, None] >= 0) & (near[b][:, None, :] >= 0)
        looking.append(grid[valid])
        looker.append(np.broadcast_to(place[:, None, None], valid.shape)[valid])
    return np.concatenate(stored), np.tile(place, 3), np.concatenate(looking), np.concatenate(looker)


def _key_rows(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Key with a last bit of 0 for stored and 1 for looking rows, and the fingerprint."""
    for batch in source:
        fps = batch.column(0).to_numpy().view(np.uint64)
        for at in range(0, len(fps), 5000):
            part = fps[at: at + 5000]
            stored, store_at, looking, look_at = fuzzy_keys(part)
            keys = np.concatenate([stored << 1, (looking << 1) | 1])
            rows = np.concatenate([part[store_at], part[look_at]]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(rows)], names=["key", "fp"])


def _forest(stored: np.ndarray, looking: np.ndarray, max_distance: int) -> Iterator[tuple[int, int]]:
    """Links of a spanning forest of the pairs (looking > stored) within the distance."""
    label = np.arange(len(stored))
    step = max(1, COMPARED_AT_ONCE // len(stored))
    for at in range(0, len(looking), step):
        part = looking[at: at + step]
        close = (np.bitwise_count(stored[None, :] ^ part[:, None]) <= max_distance) & (stored[None, :] < part[:, None])
        for row in np.flatnonzero(close.any(axis=1)).tolist():
            found = np.flatnonzero(close[row])
            labels, first = np.unique(label[found], return_index=True)
            for k in first.tolist():
                yield int(part[row]), int(stored[found[k]])
            if len(labels) > 1:
                label[np.isin(label, labels)] = labels[0]


def _link_rows(max_distance: int):
    def rows(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by cell and key, stored rows first; a key's rows may span batches."""
        kept = [np.empty(0, np.int64)] * 3

        def links(cell: np.ndarray, key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            if not len(key):
                return
            change = np.r_[True, (key[1:] >> 1 != key[:-1] >> 1) | (cell[1:] != cell[:-1])]
            starts = np.flatnonzero(change)
            ends = np.r_[starts[1:], len(key)]
            looks = key & 1
            n_looking = np.add.reduceat(looks, starts)
            differ = np.minimum.reduceat(fp, starts) != np.maximum.reduceat(fp, starts)
            made = []
            for k in np.flatnonzero(differ & (n_looking > 0) & (n_looking < ends - starts)).tolist():
                middle = ends[k] - n_looking[k]
                stored, looking = fp[starts[k]: middle].view(np.uint64), fp[middle: ends[k]].view(np.uint64)
                made.extend(_forest(stored, looking, max_distance))
            a, b = np.array(made, dtype=np.uint64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(x.copy().view(np.int64)) for x in (a, b)], names=["a", "b"])

        for batch in source:
            whole = [np.concatenate([old, batch.column(n).to_numpy()]) for old, n in zip(kept, ("cell", "key", "fp"))]
            cell, key, _ = whole
            same = (key >> 1 == key[-1] >> 1) & (cell == cell[-1]) if len(key) else np.zeros(0, bool)
            cut = int(np.argmax(same)) if len(same) else 0
            yield from links(*[x[:cut] for x in whole])
            kept = [x[cut:] for x in whole]
        yield from links(*kept)

    return rows


def _crowded_keys(fps: DataFrame) -> DataFrame:
    """(hot, blocks, looks): keys whose rows are more than a block, by the keys of a part of the fingerprints."""
    counted = fps.where(F.pmod(F.xxhash64("fp"), F.lit(COUNTED)) == 0).mapInArrow(_key_rows, "key long, fp long")
    looking = F.sum(F.col("key") % 2) * COUNTED
    stored = F.sum(1 - F.col("key") % 2) * COUNTED
    blocks = counted.groupBy(F.shiftright("key", 1).alias("hot")).agg(
        F.greatest(F.ceil(stored / BLOCK_ROWS), F.lit(1)).cast("int").alias("blocks"),
        F.greatest(F.ceil(looking / LOOK_ROWS), F.lit(1)).cast("int").alias("looks"))
    return stash(blocks.where("blocks > 1 OR looks > 1"), "simhash-hot-keys")


def fingerprint_links(fps: DataFrame, max_distance: int = 3) -> DataFrame:
    """(a, b): links between distinct fingerprints ``fp`` that connect all of those within ``max_distance`` (3 at most)."""
    if max_distance > 3:
        raise ValueError("the keys find up to 3 differing bits")
    # A fingerprint makes 111 rows, so its table's few files are spread over tasks first.
    fps = stash(fps.select("fp"), "simhash-nodes")
    spread = fps.repartition(shuffle_width(fps.sparkSession, 111 * fps.count()), "fp")
    keyed = spread.mapInArrow(_key_rows, "key long, fp long")
    pair = F.shiftright("key", 1)
    blocks, looks = (F.coalesce(c, F.lit(1)) for c in ("blocks", "looks"))
    every = lambda n: F.sequence(F.lit(0), n - 1)
    mine = lambda n: F.pmod(F.xxhash64("fp"), n).cast("int")
    cells = F.when(F.col("key") % 2 == 0, F.transform(every(looks), lambda x: x * blocks + mine(blocks))).otherwise(
        F.transform(every(blocks), lambda x: mine(looks) * blocks + x))
    dealt = (
        keyed.join(broadcast_bounded(_crowded_keys(fps), 32), pair == F.col("hot"), "left")
        .select(F.explode(cells).alias("cell"), "key", "fp")
    )
    return (
        dealt.repartition("cell", F.shiftright("key", 1)).sortWithinPartitions("cell", "key")
        .mapInArrow(_link_rows(max_distance), "a long, b long")
    )


def _rooted(nodes: DataFrame, max_distance: int) -> DataFrame:
    """``nodes`` (fp, ...) with the ``root`` of each fingerprint's component."""
    labels = component_labels(fingerprint_links(nodes.select("fp"), max_distance))
    return nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, words: int = 3, max_distance: int = 3) -> DataFrame:
    """``docs`` with ``fingerprint`` (16 hex digits) and ``component_id``.

    Texts are lower-cased (A-Z only), cut into words at blanks and into shingles of ``words`` words (fewer words:
    all of them; none: fingerprint zero, which links like any other). Documents whose fingerprints differ in at most
    ``max_distance`` bits are linked; ``component_id`` is the least doc_id in reach, the document's own included.

    Null texts have no words. Null ids are passed over for the least one; a component of null ids only has a null
    ``component_id``. Repeated rows and equal texts share a fingerprint. Columns named like an output are replaced;
    an empty table gives an empty result.
    """
    docs = tidy(docs, ["doc_id", "text"], ["fingerprint", "component_id"])
    marked = stash(fingerprints(docs, words), "simhash-fingerprints")
    nodes = stash(marked.groupBy(F.col("_llm_fp").alias("fp")).agg(F.min("doc_id").alias("least")), "simhash-distinct")
    rooted = _rooted(nodes, max_distance)
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = rooted.join(least, "root").select(F.col("fp").alias("_llm_fp"), "component_id")
    return (
        marked.join(of_fp, "_llm_fp")
        .withColumn("fingerprint", F.lower(F.lpad(F.hex("_llm_fp"), 16, "0")))
        .select(*[f"`{c}`" for c in docs.columns], "fingerprint", "component_id")
    )


def first_of_each_group(docs: DataFrame, words: int = 3, max_distance: int = 3) -> DataFrame:
    """One row of ``docs`` for each component of ``near_duplicates``: the one of the least doc_id.

    Null ids come last; of rows of one id the text's hash decides, then the place. Groups are found by fingerprint
    alone, and only the rows that stay travel by their place, so a group of very many copies is no group of texts
    anywhere. Columns and edge cases are those of ``near_duplicates``.
    """
    docs = tidy(docs, ["doc_id", "text"], [])
    marked = stash(fingerprints(docs, words).withColumn("_llm_row", F.monotonically_increasing_id()), "simhash-rows")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("hash"),
                     F.col("_llm_row").alias("_llm_row"))
    nodes = stash(marked.groupBy(F.col("_llm_fp").alias("fp")).agg(F.min(order).alias("first")), "simhash-distinct")
    stay = _rooted(nodes, max_distance).groupBy("root").agg(F.min("first").alias("first")).select("first._llm_row")
    return marked.join(stay, "_llm_row", "left_semi").select(*[f"`{c}`" for c in docs.columns])
