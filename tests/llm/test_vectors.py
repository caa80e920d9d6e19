"""Vectors near each other by cosine, against brute force, and recall on the test table."""

from __future__ import annotations

import numpy as np
import pytest

from likerec.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string, node int"


def brute(rows, threshold):
    def unit(v):
        if v is None or not len(v) or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        v = np.array(v, np.float32).astype(np.float64)
        return v / np.linalg.norm(v)

    units = [unit(r[1]) for r in rows]
    linked = [[b for b in range(len(rows)) if a != b and units[a] is not None and units[b] is not None
               and len(units[a]) == len(units[b]) and units[a] @ units[b] >= threshold] for a in range(len(rows))]
    out = []
    for a, row in enumerate(rows):
        reach, todo = {a}, [a]
        while todo:
            for b in linked[todo.pop()]:
                if b not in reach:
                    reach.add(b)
                    todo.append(b)
        ids = [rows[b][0] for b in reach if rows[b][0] is not None]
        least = min(ids) if ids else None
        out.append((row[0], len(linked[a]), least, row[0] == least))
    return sorted(out, key=repr)


def made(seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for group in range(12):
        centre = rng.standard_normal(16)
        for _ in range(8):
            rows.append((centre + 0.12 * rng.standard_normal(16)).astype(np.float32).tolist())
    rows += [rows[0], rows[0], [2 * x for x in rows[1]], None, [], [0.0] * 16, [None] * 16, [float("nan")] * 16,
             [float("inf")] + [0.0] * 15, [1.0, 2.0], [2.0, 4.0], [-0.0, 1.0], [0.0, 1.0]]
    numbered = [(k * 7 % 1009, v, 1, "x", 5) for k, v in enumerate(rows)]
    return numbered + [(None, rows[0], 1, "x", 5), (None, [5.0, -1.0, 3.0], None, None, None), numbered[3]]


@pytest.mark.parametrize("block", [4096, 5])
def test_links_like_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", block)
    rows = made()
    got = vectors.near_vectors(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert got.columns == ["vec_id", "embedding", "label", "n_links", "component_id", "kept"] or "node" in got.columns
    assert sorted((tuple(r) for r in got.select("vec_id", "n_links", "component_id", "kept").collect()), key=repr) == brute(rows, 0.95)
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_recall_of_pairs_at_the_threshold(spark, monkeypatch):
    """Pairs just above the threshold, in many buckets: at least 0.99 are found, and none below it."""
    monkeypatch.setattr(vectors, "BUCKET_ROWS", 8)
    rng = np.random.default_rng(1)
    first = rng.standard_normal((400, 64))
    first /= np.linalg.norm(first, axis=1, keepdims=True)
    aside = rng.standard_normal((400, 64))
    aside -= (aside * first).sum(axis=1, keepdims=True) * first
    aside /= np.linalg.norm(aside, axis=1, keepdims=True)
    cosine = np.where(np.arange(400) % 2 == 0, 0.9505, 0.9495)[:, None]
    second = cosine * first + np.sqrt(1 - cosine**2) * aside
    rows = [(k, v.tolist()) for k, v in enumerate(np.concatenate([first, second]))]
    got = {r[0]: r[1] for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
           .select("vec_id", "n_links").collect()}
    assert sum(got[k] for k in range(0, 400, 2)) >= 198
    assert sum(got[k] for k in range(1, 400, 2)) == 0


def test_estimates_are_unbiased():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = vectors._Rows([(k, 1, np.zeros(1, np.int32).tobytes(), v.tobytes(), 0) for k, v in enumerate(x)])
    error = (rows.code[:1000] * rows.turned[1000:]).sum(axis=1) / rows.factor[:1000] - (x[:1000] * x[1000:]).sum(axis=1)
    assert abs(error.mean()) < 0.01
    assert (np.abs(error) <= rows.bound[:1000]).mean() > 0.999


@pytest.mark.parametrize("cosine", [0.3, 0.9, 0.95, 0.999])
def test_the_bound_shrinks_with_the_angle(cosine):
    rng = np.random.default_rng(4)
    x, aside = rng.standard_normal((2, 5000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    aside -= (aside * x).sum(axis=1, keepdims=True) * x
    aside /= np.linalg.norm(aside, axis=1, keepdims=True)
    first, second = (vectors._Rows([(k, 1, np.zeros(1, np.int32).tobytes(), v.tobytes(), 0) for k, v in enumerate(side)])
                     for side in (x, cosine * x + np.sqrt(1 - cosine**2) * aside))
    error = (first.code * second.turned).sum(axis=1) / first.factor - cosine
    assert abs(error.mean()) < 0.01
    assert (np.abs(error) <= vectors._bound_share(cosine) * first.bound + vectors.FLOAT_ERROR).mean() > 0.9995


@pytest.mark.parametrize("dimension", [3, 16, 64])
def test_codes_open_every_row_that_the_floats_would(spark, dimension):
    """Codes rounded to bytes leave at least the pairs that unrounded ones do, and few others."""
    rng = np.random.default_rng(dimension)
    centres = rng.standard_normal((300, dimension))
    x = np.concatenate([centres, centres[:60] + 0.1 * rng.standard_normal((60, dimension))])
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "node long, vector array<double>")
    schema = "dim int, tab int, bucket int, node long, factor float, step float, buckets binary, code binary"
    made = sorted(rows.coalesce(1).mapInArrow(vectors._code_rows(1, 1), schema).collect(), key=lambda r: r["node"])
    codes = vectors._Codes([(r["node"], r["factor"], r["step"], r["buckets"], r["code"], 0) for r in made], dimension, np.uint8)
    units = vectors._unit_rows(x)
    plain = vectors._Rows([(k, 1, np.zeros(1, np.int32).tobytes(), v.tobytes(), 0) for k, v in enumerate(units)])
    reach = (plain.code @ plain.turned.T) / plain.factor[:, None] + vectors._bound_share(0.95) * plain.bound[:, None]
    possible = (reach >= 0.95) & (reach.T >= 0.95)
    i, j = np.nonzero(np.triu(possible, 1))
    assert len(i) >= 60 * 0.9 or dimension < 64
    open_first, open_second = vectors._open_rows_of(codes, codes, True, 0, 0.95)
    assert open_first[i].all() and open_second[j].all()
    if dimension == 64:
        assert (open_first | open_second).sum() < 150
        assert max(len(r["code"]) for r in made) == 72
