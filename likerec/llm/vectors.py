"""Near-duplicate vectors by cosine, with randomised-rotation binary codes.

Each unit vector is rotated at random and kept as the signs of its coordinates, with a correction factor: the
inner product of the vector and its code. The inner product of a code and another rotated vector, over that
factor, is an unbiased estimate of the two vectors' cosine, with a confidence bound that the factor gives. Only
pairs whose upper bound reaches the threshold are recomputed exactly, in double precision.

Pairs are those that meet in a bucket: several tables of buckets, each by some signs of a rotation. The number of
tables follows from the number of signs so that a pair just at the threshold is missed with a probability of
``MISSED`` at most. A pair is judged in the first table where it meets, which the rows' bucket numbers tell, so
links can be counted without storing pairs. Large buckets are cut into blocks that meet in cells, pair by pair of
blocks. Equal vectors are one row throughout.

Only codes travel to all tables: signs, factor, the rotated vector in a byte per coordinate, bucket numbers. They
leave few rows of a cell with a pair that may reach the threshold; just these rows' vectors are sent there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from likerec.llm.common import broadcast_bounded, stash, tidy
from likerec.llm.components import component_labels

BUCKET_ROWS = 512
BLOCK_ROWS = 4096
MISSED = 1e-3
# Standard deviations, roughly, that the confidence bound of an estimate spans.
CONFIDENCE = 4.5
EXACT_AT_ONCE = 50_000
# What estimates in single precision may lose.
FLOAT_ERROR = np.float32(1e-4)


@lru_cache(maxsize=8)
def rotation(dimension: int, number: int) -> np.ndarray:
    """An orthonormal matrix drawn at random, the same in every task."""
    normal = np.random.Generator(np.random.PCG64([dimension, number])).standard_normal((dimension, dimension))
    q, r = np.linalg.qr(normal)
    return q * np.sign(np.diag(r))


def table_shape(rows: int, threshold: float) -> tuple[int, int]:
    """Signs per bucket number, and tables."""
    signs = min(30, max(1, math.ceil(math.log2(max(2, rows / BUCKET_ROWS)))))
    same = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** signs
    return signs, 1 if same >= 1 else max(1, math.ceil(math.log(MISSED) / math.log1p(-same)))


def bucket_numbers(units: np.ndarray, signs: int, tables: int) -> np.ndarray:
    """The bucket of each vector in each table."""
    dimension = units.shape[1]
    rotations = -(-signs * tables // dimension)
    bits = np.concatenate([units @ rotation(dimension, k + 1) for k in range(rotations)], axis=1)[:, : signs * tables] > 0
    return bits.reshape(len(units), tables, signs) @ (1 << np.arange(signs, dtype=np.int32))


def usable(vector: Column) -> Column:
    """Neither null nor all zeros nor with null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))) & ~F.isnan(x))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit_rows(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _by_length(vectors: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of vectors of one length, at most 1,000 at a time, and the vectors."""
    offsets, values = vectors.offsets.to_numpy(), vectors.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(offsets)
    for dimension in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == dimension)
        for part in np.array_split(at, -(-len(at) // 1000)):
            yield part, values[offsets[part][:, None] + np.arange(dimension)].astype(np.float64)


def _number_type(signs: int) -> type:
    return np.uint8 if signs <= 8 else np.uint16 if signs <= 16 else np.int32


def _factors(code: np.ndarray, turned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Correction factors of codes, and how far an estimate by them may be off."""
    dimension = turned.shape[1]
    factor = np.maximum((code * turned).sum(axis=1), 1e-6)
    return factor, CONFIDENCE * np.sqrt(np.maximum(0, 1 - factor**2)) / factor / math.sqrt(max(1, dimension - 1))


def _signs(turned: np.ndarray) -> np.ndarray:
    return np.where(turned > 0, 1, -1).astype(np.float32) / np.float32(math.sqrt(turned.shape[1]))


def _code_rows(signs: int, tables: int):
    def rows(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector's code, once per table."""
        for batch in source:
            node = batch.column("node").to_numpy()
            for part, vectors in _by_length(batch.column("vector")):
                unit = _unit_rows(vectors)
                dimension = unit.shape[1]
                buckets = bucket_numbers(unit, signs, tables).astype(np.int32)
                turned = (unit @ rotation(dimension, 0)).astype(np.float32)
                step = np.maximum(np.abs(turned).max(axis=1), np.float32(1e-30)) / np.float32(127)
                levels = np.rint(turned / step[:, None]).astype(np.int8)
                packed = np.packbits(turned > 0, axis=1)
                codes = [own.tobytes() + level.tobytes() for own, level in zip(packed, levels)]
                numbers = [row.tobytes() for row in buckets.astype(_number_type(signs))]
                factor = _factors(_signs(turned), turned)[0].astype(np.float32)
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(part), dimension, np.int32)), pa.array(np.full(len(part), t, np.int32)),
                         pa.array(buckets[:, t]), pa.array(node[part]), pa.array(factor), pa.array(step),
                         pa.array(numbers, pa.binary()), pa.array(codes, pa.binary())],
                        names=["dim", "tab", "bucket", "node", "factor", "step", "buckets", "code"])
    return rows


def _bound_share(threshold: float) -> np.float32:
    """The part of the bound that holds for pairs of at least the threshold.

    The error of an estimate is in proportion to the sine of the two vectors' angle. The estimate of a pair with a
    cosine c is c less the bound times the sine at least, which grows with c, so the pair at the threshold is the least.
    """
    return np.float32(math.sqrt(max(0.0, 1 - threshold**2)) if threshold > 0 else 1.0)


class _Codes:
    """The codes (node, factor, step, buckets, code, block) of one block in a cell."""

    def __init__(self, batch: list[tuple], dimension: int, numbers: type):
        signs = -(-dimension // 8)
        packed = np.frombuffer(b"".join(row[4] for row in batch), np.uint8).reshape(len(batch), signs + dimension)
        bits = np.unpackbits(packed[:, :signs], axis=1, count=dimension)
        step = np.array([row[2] for row in batch], np.float32)
        self.code = (bits.astype(np.float32) * 2 - 1) / np.float32(math.sqrt(dimension))
        self.turned = packed[:, signs:].view(np.int8).astype(np.float32) * step[:, None]
        self.factor = np.array([row[1] for row in batch], np.float32)
        self.bound = CONFIDENCE * np.sqrt(np.maximum(0, 1 - self.factor**2)) / self.factor / math.sqrt(max(1, dimension - 1))
        # What rounding to bytes can do to a product with a code at most.
        self.rounding = step * np.float32(math.sqrt(dimension) / 2) + FLOAT_ERROR
        self.buckets = np.stack([np.frombuffer(row[3], numbers) for row in batch])


def _open_rows_of(a: _Codes, b: _Codes, same: bool, table: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of ``a`` and of ``b`` are in a pair that first meets in ``table`` and whose bounds reach the threshold.

    Either code gives an estimate of the pair, and both bounds have to.
    """
    share = _bound_share(threshold)
    open_a, open_b = np.zeros(len(a.code), bool), np.zeros(len(b.code), bool)
    step = max(1, (1 << 22) // max(1, len(b.code)))
    for start in range(0, len(a.code), step):
        rows = slice(start, start + step)
        reach = (a.code[rows] @ b.turned.T + b.rounding) / a.factor[rows, None] + share * a.bound[rows, None]
        back = (a.turned[rows] @ b.code.T + a.rounding[rows, None]) / b.factor + share * b.bound
        possible = (reach >= threshold) & (back >= threshold)
        if same:
            possible &= np.arange(len(b.code))[None, :] > np.arange(start, start + len(reach))[:, None]
        i, j = np.nonzero(possible)
        i += start
        for at in range(0, len(i), EXACT_AT_ONCE):
            x, y = i[at: at + EXACT_AT_ONCE], j[at: at + EXACT_AT_ONCE]
            new = ~(a.buckets[x, :table] == b.buckets[y, :table]).any(axis=1)
            open_a[x[new]] = True
            open_b[y[new]] = True
    return open_a, open_b


CELL = ["dim", "tab", "bucket", "first", "second"]


def _cells_of(source: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows sorted by cell, as (cell, rows); a cell has two blocks of rows at most."""
    current, held = None, []
    for batch in source:
        values = [batch.column(k).to_pylist() for k in (*CELL, *columns)]
        for row in zip(*values):
            if row[: len(CELL)] != current:
                if len(held) > 1:
                    yield current, held
                current, held = row[: len(CELL)], []
            held.append(row[len(CELL):])
    if len(held) > 1:
        yield current, held


def _open_rows(signs: int, threshold: float):
    def rows(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of each cell whose vectors are needed there."""
        for cell, held in _cells_of(source, ["node", "factor", "step", "buckets", "code", "block"]):
            dimension, table, _, first, second = cell
            of_first, of_second = ([row for row in held if row[5] == block] for block in (first, second))
            if not of_first or not of_second:
                continue
            a = _Codes(of_first, dimension, _number_type(signs))
            b = a if first == second else _Codes(of_second, dimension, _number_type(signs))
            open_a, open_b = _open_rows_of(a, b, a is b, table, threshold)
            if a is b:
                found = [of_first[k] for k in np.flatnonzero(open_a | open_b).tolist()]
            else:
                found = [side[k] for side, is_open in ((of_first, open_a), (of_second, open_b)) for k in np.flatnonzero(is_open).tolist()]
            numbers = [np.frombuffer(row[3], _number_type(signs)).astype(np.int32).tobytes() for row in found]
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(np.full(len(found), value, np.int32)) for value in cell], pa.array([row[0] for row in found], pa.int64()),
                 pa.array(numbers, pa.binary()), pa.array([row[5] for row in found], pa.int32())],
                names=[*CELL, "node", "buckets", "block"])

    return rows


class _Rows:
    """The rows of one block in a cell, with their codes."""

    def __init__(self, batch: list[tuple]):
        self.node = np.array([row[0] for row in batch], np.int64)
        self.copies = np.array([row[1] for row in batch], np.int64)
        self.buckets = np.stack([np.frombuffer(row[2], np.int32) for row in batch])
        self.unit = np.stack([np.frombuffer(row[3], np.float64) for row in batch])
        self.turned = (self.unit @ rotation(self.unit.shape[1], 0)).astype(np.float32)
        self.code = _signs(self.turned)
        self.factor, self.bound = _factors(self.code, self.turned)


def linked_pairs(a: _Rows, b: _Rows, same: bool, table: int, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in ``a`` and ``b`` of pairs that first meet in ``table`` and reach the threshold."""
    step = max(1, (1 << 22) // max(1, len(b.node)))
    for start in range(0, len(a.node), step):
        rows = slice(start, start + step)
        estimate = (a.code[rows] @ b.turned.T) / a.factor[rows, None]
        possible = estimate + _bound_share(threshold) * a.bound[rows, None] + FLOAT_ERROR >= threshold
        if same:
            possible &= np.arange(len(b.node))[None, :] > np.arange(start, start + len(estimate))[:, None]
        i, j = np.nonzero(possible)
        i += start
        for at in range(0, len(i), EXACT_AT_ONCE):
            x, y = i[at: at + EXACT_AT_ONCE], j[at: at + EXACT_AT_ONCE]
            new = ~(a.buckets[x, :table] == b.buckets[y, :table]).any(axis=1)
            x, y = x[new], y[new]
            near = np.einsum("ij,ij->i", a.unit[x], b.unit[y]) >= threshold
            yield x[near], y[near]


def _cell_links(rows: list[tuple], cell: tuple, threshold: float) -> tuple[dict[int, int], list[tuple[int, int]]]:
    """Counted links by node, and links of a spanning forest, of a cell's rows (node, n, buckets, unit, block)."""
    _, table, _, first, second = cell
    of_first, of_second = ([row for row in rows if row[4] == block] for block in (first, second))
    if not of_first or not of_second:
        return {}, []
    a = _Rows(of_first)
    b = a if first == second else _Rows(of_second)
    counted: dict[int, int] = {}
    n_a, n_b = np.zeros(len(a.node), np.int64), np.zeros(len(b.node), np.int64)
    label_a = np.arange(len(a.node))
    label_b = label_a if a is b else np.arange(len(b.node)) + len(a.node)
    forest = []
    for x, y in linked_pairs(a, b, a is b, table, threshold):
        np.add.at(n_a, x, b.copies[y])
        np.add.at(n_a if a is b else n_b, y, a.copies[x])
        while len(x):
            apart = label_a[x] != label_b[y]
            x, y = x[apart], y[apart]
            if not len(x):
                break
            # One link for each larger label, then that label gives way.
            low, high = np.minimum(label_a[x], label_b[y]), np.maximum(label_a[x], label_b[y])
            kept, at = np.unique(high, return_index=True)
            forest.extend(zip(a.node[x[at]].tolist(), b.node[y[at]].tolist()))
            target = dict(zip(kept.tolist(), low[at].tolist()))
            goes = np.arange(max(label_a.max(), label_b.max(), kept.max()) + 1)
            for k in sorted(target):
                goes[k] = goes[target[k]]
            if a is b:
                label_a = label_b = goes[label_a]
            else:
                label_a, label_b = goes[label_a], goes[label_b]
    for nodes, numbers in ((a.node, n_a), (b.node, n_b))[: 1 if a is b else 2]:
        for k in np.flatnonzero(numbers).tolist():
            counted[int(nodes[k])] = counted.get(int(nodes[k]), 0) + int(numbers[k])
    return counted, forest


def _link_rows(threshold: float):
    def rows(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def with_units() -> Iterator[pa.RecordBatch]:
            for batch in source:
                units = [b""] * batch.num_rows
                for part, vectors in _by_length(batch.column("vector")):
                    for place, unit in zip(part.tolist(), _unit_rows(vectors)):
                        units[place] = unit.tobytes()
                yield batch.append_column("unit", pa.array(units, pa.binary()))

        for cell, held in _cells_of(with_units(), ["node", "n", "buckets", "unit", "block"]):
            counted, forest = _cell_links(held, cell, threshold)
            a = [*counted, *[x for x, _ in forest]]
            b = [None] * len(counted) + [y for _, y in forest]
            n = [*counted.values()] + [0] * len(forest)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())],
                                             names=["a", "b", "n"])

    return rows


def near_vectors(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """``vectors`` with ``n_links``, ``component_id`` and ``kept``.

    Two rows link if the cosine of their vectors, of the same length, is ``threshold`` or more. ``n_links`` counts
    the other rows linked directly, ``component_id`` is the least id in reach, and rows that have it are kept.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, not even their
    like. Rows of equal vectors link with each other, repeated rows too. Null ids are passed over for the least one.
    Columns named like an output are replaced; an empty table gives an empty result.
    """
    outputs = ["n_links", "component_id", "kept"]
    vectors = tidy(vectors, [id_column, vector_column], outputs)
    ids = F.col(id_column)
    doubles = F.col(vector_column).cast("array<double>")
    cleaned = F.when(usable(doubles), F.transform(doubles, lambda x: x + F.lit(0.0)))
    with_vector = vectors.withColumn("_llm_vector", cleaned)
    distinct = stash(
        with_vector.where("_llm_vector IS NOT NULL").groupBy(F.col("_llm_vector").alias("vector"))
        .agg(F.count("*").alias("n"), F.min(ids).alias("least")).withColumn("node", F.monotonically_increasing_id()),
        "vectors-distinct")
    signs, tables = table_shape(distinct.count(), threshold)

    schema = "dim int, tab int, bucket int, node long, factor float, step float, buckets binary, code binary"
    coded = distinct.select("node", "vector").mapInArrow(_code_rows(signs, tables), schema)
    large = stash(
        coded.groupBy("dim", "tab", "bucket").count().where(F.col("count") > BLOCK_ROWS)
        .withColumn("blocks", F.ceil(F.col("count") / BLOCK_ROWS).cast("int")).drop("count"),
        "vectors-large-buckets")
    blocks = F.coalesce("blocks", F.lit(1))
    cells = F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: F.struct(
        F.least(k, F.col("block")).alias("first"), F.greatest(k, F.col("block")).alias("second")))
    dealt = (
        coded.join(broadcast_bounded(large, 64), ["dim", "tab", "bucket"], "left")
        .withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
        .withColumn("cell", F.explode(cells))
        .select("dim", "tab", "bucket", "cell.first", "cell.second", "node", "factor", "step", "buckets", "code", "block")
    )
    in_open_pairs = stash(
        dealt.repartition(*CELL).sortWithinPartitions(*CELL)
        .mapInArrow(_open_rows(signs, threshold), ", ".join(f"{c} int" for c in CELL) + ", node long, buckets binary, block int"),
        "vectors-open")
    fetched = in_open_pairs.join(distinct.select("node", "n", "vector"), "node").select(*CELL, "node", "n", "buckets", "vector", "block")
    links = stash(
        fetched.repartition(*CELL).sortWithinPartitions(*CELL).mapInArrow(_link_rows(threshold), "a long, b long, n long"),
        "vectors-links")

    counts = links.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    labels = component_labels(links.where("b IS NOT NULL").select("a", "b"))
    rooted = distinct.select("node", "n", "least").join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("least").alias("_llm_component"))
    known = (
        rooted.join(least, "root").join(counts, "node", "left")
        .select("node", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("_llm_links"), "_llm_component")
        .join(distinct.select("node", "vector"), "node").drop("node")
    )
    component = F.coalesce("_llm_component", ids)
    return (
        with_vector.join(known, F.col("_llm_vector") == F.col("vector"), "left")
        .withColumn("n_links", F.coalesce("_llm_links", F.lit(0)).cast("long"))
        .withColumn("component_id", component.cast("long"))
        .withColumn("kept", ids.eqNullSafe(F.col("component_id")))
        .select(*[f"`{c}`" for c in vectors.columns], *outputs)
    )
