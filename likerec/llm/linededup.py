"""Lines that many documents share are removed from all of them.

Method: a first pass over the documents makes two Bloom filters, of line hashes seen at least once and at least
twice. A second pass asks the second filter; only lines that may repeat are shuffled, as whole keys, to be
counted exactly. A false positive of the filter costs a shuffled line, never a wrong result. Of confirmed lines,
all occurrences go, or all but the first one (``keep_first``).

The filters are cut into slices by hash. Tasks send each slice the hashes of its lines, once per Arrow batch, so
a line that fills a third of all documents sends one number per batch. The size of a filter is 10 bits per line
within fixed bounds (1 to 64 MB), so broadcasting it is bounded; beyond some 50 million lines more and more
lines are merely suspected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from likerec.llm.common import BLANKS, stash, text_bytes, tidy, with_arrow_columns

SLICE_BITS = 1 << 19
MIN_SLICES, MAX_SLICES = 16, 1024
BITS_PER_LINE = 10
PROBES = 4


def line_keys(text: bytes, min_chars: int) -> tuple[list[bytes], list[bytes]]:
    """The lines of a text, and their keys; a key that is too short is empty."""
    lines = text.split(b"\n")
    keys = [line.strip(BLANKS).lower() for line in lines]
    if min_chars > 1:
        keys = [key if len(key.decode()) >= min_chars else b"" for key in keys]
    return lines, keys


def _distinct_keys(text: bytes, min_chars: int) -> set[bytes]:
    keys = set(line_keys(text, min_chars)[1])
    keys.discard(b"")
    return keys


def _bits(hashes: np.ndarray) -> np.ndarray:
    """The bits of each hash in its slice, one row per probe."""
    low, high = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(16)) | np.uint64(1)
    steps = np.arange(PROBES, dtype=np.uint64)[:, None]
    return ((low + steps * high) % np.uint64(SLICE_BITS)).astype(np.int64)


def _slice_of(hashes: np.ndarray, slices: int) -> np.ndarray:
    return ((hashes >> np.uint64(40)) % np.uint64(slices)).astype(np.int32)


def _has(bits: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    return ((bits[wanted >> 3] >> (wanted & 7)) & 1).all(axis=0)


def _set(bits: np.ndarray, wanted: np.ndarray) -> None:
    np.bitwise_or.at(bits, wanted >> 3, (1 << (wanted & 7)).astype(np.uint8))


def _hash_rows(slices: int, min_chars: int):
    def rows(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            found = [xxhash.xxh64_intdigest(key) for text in text_bytes(batch) for key in _distinct_keys(text, min_chars)]
            hashes, counts = np.unique(np.array(found, dtype=np.uint64), return_counts=True)
            part, again, packed = [], [], []
            for repeated in (False, True):
                chosen = hashes[(counts > 1) == repeated]
                of = _slice_of(chosen, slices)
                order = np.argsort(of, kind="stable")
                for k, piece in zip(*_runs(of[order], chosen[order])):
                    part.append(k)
                    again.append(repeated)
                    packed.append(piece.tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int32()), pa.array(again, pa.bool_()), pa.array(packed, pa.binary())],
                names=["slice", "again", "hashes"])
    return rows


def _runs(sorted_keys: np.ndarray, values: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    if not len(sorted_keys):
        return [], []
    starts = np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]])
    return sorted_keys[starts].tolist(), np.split(values, starts[1:])


def _build(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by slice: one pair of filters at a time, of which the second is kept."""
    current, once, twice = None, None, None

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([current], pa.int32()), pa.array([twice.tobytes()], pa.binary())],
                                          names=["slice", "bits"])

    for batch in source:
        for k, again, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if k != current:
                if current is not None:
                    yield made()
                current, once, twice = k, np.zeros(SLICE_BITS // 8, np.uint8), np.zeros(SLICE_BITS // 8, np.uint8)
            wanted = _bits(np.frombuffer(packed, np.uint64))
            _set(twice, wanted if again else wanted[:, _has(once, wanted)])
            _set(once, wanted)
    if current is not None:
        yield made()


def _suspect_rows(filters, slices: int, min_chars: int):
    def rows(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = filters.value
        for batch in source:
            refs, keys = [], []
            for ref, text in zip(batch.column("_llm_ref").to_pylist(), text_bytes(batch)):
                own = list(_distinct_keys(text, min_chars))
                hashes = np.array([xxhash.xxh64_intdigest(key) for key in own], dtype=np.uint64)
                of, wanted = _slice_of(hashes, slices), _bits(hashes)
                for k in np.unique(of).tolist():
                    if k not in twice:
                        continue
                    at = np.flatnonzero(of == k)
                    for i in at[_has(twice[k], wanted[:, at])].tolist():
                        refs.append(ref)
                        keys.append(own[i])
            yield pa.RecordBatch.from_arrays([pa.array(refs, pa.string()), pa.array(keys, pa.binary())],
                                             names=["_llm_ref", "key"])
    return rows


def _first_owners(owned: DataFrame, with_ref: DataFrame, id_column: str) -> DataFrame:
    """(_llm_ref, _llm_own, _llm_least): keys whose first document has the text, and that document's id.

    The first document is the one with the least id, nulls last, then with the least digest of the text.
    """
    least = with_ref.groupBy("_llm_ref").agg(F.min(id_column).alias("_llm_least"))
    place = F.struct(F.col("_llm_least").isNull().alias("without"), "_llm_least", "_llm_ref")
    first = owned.join(least, "_llm_ref").groupBy("key").agg(F.min(place).alias("first"))
    return first.groupBy(F.col("first._llm_ref").alias("_llm_ref"), F.col("first._llm_least").alias("_llm_least")).agg(
        F.collect_list("key").alias("_llm_own"))


def _kept_lines(lines: list[bytes], keys: list[bytes], gone: set[bytes], own: set[bytes]) -> list[bytes]:
    """Lines whose key is not in ``gone``, and of a key in ``own`` the first one."""
    own, kept = set(own), []
    for line, key in zip(lines, keys):
        if key in own:
            own.remove(key)
            kept.append(line)
        elif key not in gone:
            kept.append(line)
    return kept


def drop_shared_lines(docs: DataFrame, min_documents: int = 10, min_chars: int = 1, keep_first: bool = False,
                      id_column: str = "doc_id") -> DataFrame:
    """``docs`` with ``text`` cut to the lines kept, and ``n_lines`` (before), ``n_dropped``.

    A line's key is the line without blanks at its ends, in lower case (A-Z only). Keys of at least ``min_chars``
    code points that are found in at least ``min_documents`` rows lose all their lines in every document. With
    ``keep_first`` the first line of such a key stays in the document with the least id. Null ids come last, and the text's
    digest decides between equal ids; repeated rows, equal in id and text, are one document and keep the line alike.

    Null and empty texts count one empty line, which stays; the kept text is then empty, not null. Each row counts
    as a document, repeated rows and rows with equal or null ids too. Other columns pass unchanged, except those
    named like an output. An empty table gives an empty result.
    """
    outputs = [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]
    needed = ["text", id_column] if keep_first else ["text"]
    docs = tidy(docs, needed, [f.name for f in outputs]).withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    spark = docs.sparkSession
    texts = docs.select("text")
    lines = texts.agg(F.sum(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    slices = int(min(MAX_SLICES, max(MIN_SLICES, -(-lines * BITS_PER_LINE // SLICE_BITS))))

    filters = (
        texts.mapInArrow(_hash_rows(slices, min_chars), "slice int, again boolean, hashes binary")
        .repartition("slice").sortWithinPartitions("slice")
        .mapInArrow(_build, "slice int, bits binary")
    )
    # At most MAX_SLICES rows of SLICE_BITS bits: 64 MB.
    twice = {row["slice"]: np.frombuffer(row["bits"], np.uint8) for row in filters.toLocalIterator()}
    shared = spark.sparkContext.broadcast(twice)

    # A text's digest names it: equal texts lose equal lines.
    with_ref = docs.withColumn("_llm_ref", F.md5("text"))
    suspects = stash(
        with_ref.select("_llm_ref", "text").mapInArrow(_suspect_rows(shared, slices, min_chars), "_llm_ref string, key binary"),
        "line-suspects")
    frequent = suspects.groupBy("key").count().where(F.col("count") >= min_documents).select("key")
    owned = suspects.distinct().join(frequent, "key")
    if keep_first:
        owned = stash(owned, "line-owners")
    dropped = owned.groupBy("_llm_ref").agg(F.collect_list("key").alias("_llm_keys"))

    def cut(batch: pa.RecordBatch) -> list[pa.Array]:
        kept, n_lines, n_dropped = [], [], []
        own_keys = batch.column("_llm_own") if keep_first else pa.nulls(batch.num_rows)
        for text, gone, own in zip(text_bytes(batch), batch.column("_llm_keys"), own_keys):
            lines, keys = line_keys(text, min_chars)
            gone = set(gone.as_py() or ())
            stay = _kept_lines(lines, keys, gone, set(own.as_py() or ())) if gone else lines
            kept.append(b"\n".join(stay))
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(stay))
        return [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]

    joined = with_ref.join(dropped, "_llm_ref", "left")
    if keep_first:
        own = F.when(F.col(id_column).eqNullSafe(F.col("_llm_least")), F.col("_llm_own"))
        joined = joined.join(_first_owners(owned, with_ref, id_column), ["_llm_ref"], "left").withColumn("_llm_own", own).drop("_llm_least")
    result = with_arrow_columns(joined, [T.StructField("text", T.StringType()), *outputs], cut, "_llm_ref", "_llm_keys", "_llm_own")
    return result.select(*[f"`{c}`" for c in docs.columns], *[f.name for f in outputs])
