"""Mixing sources and exact shards, against plain rules and the exact laws."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import pytest

from likerec.llm import mixing, sharding
from tests.llm import edge


def plain_copies(doc_id, rate, seed):
    pieces, total = math.ceil(rate / 32), 0
    for piece in range(1, pieces + 1):
        key = f"{seed}|{piece}|{'null' if doc_id is None else doc_id}"
        u = (int(hashlib.md5(key.encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        mean, k = rate / pieces, 0
        below = term = math.exp(-mean)
        while below < u and k < 100:
            k += 1
            term *= mean / k
            below += term
            total += 1
    return total


def plain_rates(rows, weights=None):
    size = Counter()
    for r in rows:
        size[r[3]] += len((r[1] or "").encode()) + 1
    weight = {s: (n**0.5 if weights is None else weights.get(s, 0.0)) for s, n in size.items()}
    return {s: sum(size.values()) * weight[s] / sum(weight.values()) / n for s, n in size.items()}


@pytest.mark.parametrize("weights", [None, {"s0": 1.0, None: 3.0}, {"s1": 1e-9, "s2": 1000.0}])
def test_copies_like_the_plain_rule(spark, weights):
    rows = edge.rows(9)
    given = None if weights is None else spark.createDataFrame(list(weights.items()), "source string, weight double")
    rates = plain_rates(rows, weights)
    want = Counter()
    for r in rows:
        for k in range(1, plain_copies(r[0], rates[r[3]], 5) + 1 if rates[r[3]] else 1):
            want[(r[0], r[1], r[3], k)] += 1
    got = mixing.mix_sources(edge.documents(spark, 9), given, seed=5)
    assert Counter(tuple(r) for r in got.select("doc_id", "text", "source", "copy").collect()) == want
    assert mixing.mix_sources(edge.empty(spark), given).count() == 0


def test_shares_meet_their_targets(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "repeat('x', 9) AS text", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('s', id % 10) END AS source")
    weights = spark.createDataFrame([("hot", 1.0), ("s1", 1.0), ("s2", 2.0)], "source string, weight double")
    counted = dict(mixing.mix_sources(docs, weights).groupBy("source").count().collect())
    total = sum(counted.values())
    assert set(counted) == {"hot", "s1", "s2"}
    assert abs(total - 20_000) < 900
    for source, share in (("hot", 0.25), ("s1", 0.25), ("s2", 0.5)):
        assert abs(counted[source] / total - share) < 0.03


def test_shards_are_exact(spark):
    rows = edge.rows(10)
    for shards in (16, 5, 200):
        got = sharding.shuffle_into_shards(edge.documents(spark, 10), shards)
        found = got.select("doc_id", "size", "text_crc32", "shard", "slot").collect()
        assert Counter((r[0], r[1], r[2]) for r in found) == Counter(
            (r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
        counts = Counter(r["shard"] for r in found)
        assert [counts[k] for k in range(shards)] == [len(rows) // shards + (k < len(rows) % shards) for k in range(shards)]
        for shard in range(shards):
            assert sorted(r["slot"] for r in found if r["shard"] == shard) == list(range(counts[shard]))
    assert sharding.shuffle_into_shards(edge.empty(spark)).count() == 0


def test_shuffles_are_uniform(spark):
    """Over many seeds each row meets each shard and place about as often as any other."""
    docs = spark.range(12).selectExpr("id AS doc_id", "'t' AS text").repartition(3)
    seen = Counter()
    for seed in range(40):
        for r in sharding.shuffle_into_shards(docs, 2, seed).select("doc_id", "shard").collect():
            seen[tuple(r)] += 1
    assert len(seen) == 24 and min(seen.values()) >= 7


def test_hypergeometric_draws_follow_the_law():
    rng = random.Random(4)
    good, bad, drawn, n = 30, 50, 25, 20_000
    seen = Counter(sharding.hypergeometric(rng, good, bad, drawn) for _ in range(n))
    for k in range(26):
        p = math.comb(good, k) * math.comb(bad, drawn - k) / math.comb(good + bad, drawn)
        assert abs(seen[k] - n * p) < 5 * math.sqrt(n * p * (1 - p)) + 5
    assert sharding.hypergeometric(rng, 0, 9, 4) == 0 and sharding.hypergeometric(rng, 9, 0, 4) == 4
    mean = sum(sharding.hypergeometric(rng, 10**9, 10**10, 10**7) for _ in range(50)) / 50
    assert abs(mean / (10**7 / 11) - 1) < 0.01


def test_matrix_sums():
    counts, sizes = [5, 0, 17, 3, 100], [40, 40, 45]
    matrix = sharding.communication_matrix(counts, sizes, 1)
    assert [sum(row) for row in matrix] == counts
    assert [sum(column) for column in zip(*matrix)] == sizes
