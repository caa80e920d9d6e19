"""The audit of filters against plain application in every order."""

from __future__ import annotations

import itertools
import random
from collections import Counter

from likerec.llm import filteraudit
from tests.llm import edge

BLANKS = " \t\n\x0b\x0c\r"


def plain_failures(text):
    words = "".join(" " if c in BLANKS else c for c in text).split(" ")
    words = [w for w in words if w]
    return [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text),
            any(c in "#$%&*|" for c in text)]


def plain_audit(docs, labels):
    """Rows of the audit from (doc_id, text, part) and (doc_id, quality, toxic)."""
    ids = {}
    for doc_id, text, _ in docs:
        if doc_id is not None:
            ids[text or ""] = min(doc_id, ids.get(text or "", doc_id))
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    by_part = {}
    for doc_id, text, part in docs:
        text = text or ""
        copied = text in ids and (doc_id is None or doc_id > ids[text])
        by_part.setdefault(part or "", []).append((dict(zip("ABCDE", [*plain_failures(text), copied])), doc_id in good, doc_id in toxic))
    out, shapley = [], Counter()
    for part, rows in by_part.items():
        for order in itertools.permutations("ABCDE"):
            left = rows
            for step, letter in enumerate(order, 1):
                gone = [r for r in left if r[0][letter]]
                left = [r for r in left if not r[0][letter]]
                shapley[part, letter] += len(gone)
                failing = sum(r[0][letter] for r in rows)
                unique = sum(r[0][letter] and sum(r[0].values()) == 1 for r in rows)
                out.append((part, "".join(order), step, len(left), len(gone), failing - len(gone), unique,
                            sum(r[1] for r in gone), sum(r[2] for r in gone)))
    return Counter((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


def audited(frame):
    return Counter(tuple(r) for r in frame.select("part", "filter_order", "step", *filteraudit.STEPS).collect())


def test_audit_like_plain_application(spark):
    rng = random.Random(5)
    texts = [edge.prose(rng, 250), edge.prose(rng, 250) + " #", "Ab Cd " * 150, edge.prose(rng, 250).upper(), edge.prose(rng, 30) + "|", "x " * 300]
    rows = [(500 + k, rng.choice(texts), rng.choice(["de", "en", "", None]), None, None, *edge.CLASHING) for k in range(150)]
    rows += edge.rows(3) + [rows[0], rows[0], rows[1], (None, texts[0], "de", None, None, *edge.CLASHING)]
    labels = [(r[0], rng.choice([0, 1, None]), rng.choice([0, 1, None]), "x") for r in rows if rng.random() < 0.7] + [(10**9, 1, 1, "y")]
    docs = spark.createDataFrame(rows, edge.SCHEMA.replace("`TEXT`", "other")).withColumnRenamed("other", "TEXT").repartition(3)
    got = filteraudit.audit_filters(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int, QUALITY2 string"))
    assert audited(got) == plain_audit([(r[0], r[1], r[2]) for r in rows], [r[:3] for r in labels])


def test_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filteraudit.audit_filters(edge.empty(spark), labels).count() == 0
    assert audited(filteraudit.audit_filters(edge.documents(spark, 4), labels)) == plain_audit([r[:3] for r in edge.rows(4)], [])


def test_walk_meets_every_set_once():
    rng = random.Random(0)
    cells = [(mask, (rng.randint(1, 9), rng.randint(0, 9), rng.randint(0, 9))) for mask in range(32) if mask % 7]
    for active, state in enumerate(filteraudit.gray_walk(cells, 5)):
        assert state == tuple(sum(c[k] for mask, c in cells if not mask & active) for k in range(3))
    assert filteraudit.gray_walk([], 5) == [(0, 0, 0)] * 32
