"""Words shared with a benchmark, against a search of every window."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from likerec.llm import common, decontamination
from tests.llm import edge

ITEMS = "item_id long, text string, WORDS string, doc_id int, key double"


def plain_words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return "".join(c if c > "\x7f" or "0" <= c <= "9" or "a" <= c <= "z" else " " for c in lowered).split(" ")


def clean_words(text):
    return [w for w in plain_words(text) if w]


def brute(docs, items, width=10):
    windows = {}
    for item in items:
        words = clean_words(item[1])
        size = min(width, len(words))
        for k in range(len(words) - size + 1 if words else 0):
            windows.setdefault(tuple(words[k:k + size]), set()).add("null" if item[0] is None else str(item[0]))
    out = Counter()
    for doc in docs:
        words, hit, found = clean_words(doc[1]), set(), set()
        for size in {len(w) for w in windows}:
            for k in range(len(words) - size + 1):
                if tuple(words[k:k + size]) in windows:
                    hit.update(range(k, k + size))
                    found |= windows[tuple(words[k:k + size])]
        spans = [k for k in sorted(hit) if k - 1 not in hit], [k + 1 for k in sorted(hit) if k + 1 not in hit]
        out[(doc[0], len(words), len(hit), len(found), tuple(sorted(found)), tuple(zip(*spans)), bool(hit))] += 1
    return out


def got(frame):
    rows = frame.select("doc_id", *decontamination.OUTPUTS).collect()
    return Counter((r[0], r[1], r[2], r[3], tuple(r[4]), tuple((s["start"], s["end"]) for s in r[5]), r[6]) for r in rows)


def made(short):
    """Edge texts, passages of items of 9 to 30 words in them, touching and overlapping ones, and one in many texts and items."""
    rng = random.Random(3)
    items = [edge.prose(rng, n) for n in (10, 11, 14, 15, 25, 40)]
    items += [items[4], items[4] + " " + items[0], "Same Word " * 12, "¿Ünï çödé? " * 6, None, "", "?!"]
    items += ["two words", "ONE", "it's", edge.prose(rng, 4), edge.prose(rng, 9)] if short else []
    rows = [(None if k == 3 else k % 11, t, "x", 1, 2.0) for k, t in enumerate(items)]
    docs = edge.rows(9)
    for k in range(120):
        words = edge.prose(rng, rng.choice([0, 3, 30, 60])).split()
        for text in rng.sample([t for t in items if t], rng.choice([0, 1, 1, 2, 3])):
            part = text.split()
            a = rng.randrange(max(1, len(part) - 9))
            part = part[a:a + rng.choice([8, 9, 10, 10, 11, 17, 40])]
            at = rng.randint(0, len(words))
            words[at:at] = [w.upper() + rng.choice(["", ",", "\n"]) for w in part]
        docs.append((1000 + k, " ".join(words) if k % 3 else "; ".join(words), "en", "s", None, *edge.CLASHING))
    hot = " ".join(items[5].split()[5:30])
    docs += [(2000 + k, f"{edge.prose(rng, 5)} {hot} {edge.prose(rng, k % 4)}", "en", "s", None, *edge.CLASHING) for k in range(40)]
    docs += [(3000 + k, hot, None, None, None, *edge.CLASHING) for k in range(40)] + [docs[-1]]
    return docs, rows


def frames(spark, docs, items):
    schema = edge.SCHEMA.replace("`TEXT`", "other")
    return spark.createDataFrame(docs, schema).withColumnRenamed("other", "TEXT").repartition(3), spark.createDataFrame(items, ITEMS)


@pytest.mark.parametrize("short", [False, True])
def test_hits_like_a_search_of_every_window(spark, short):
    docs, items = made(short)
    assert got(decontamination.find_benchmark_words(*frames(spark, docs, items))) == brute(docs, items)


def test_the_same_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "broadcast_bounded", lambda df, row_bytes: common.broadcast_bounded(df, row_bytes, 0))
    docs, items = made(True)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert got(decontamination.find_benchmark_words(*frames(spark, docs, items))) == brute(docs, items)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(32 << 20))


def test_every_span_of_ten_words_is_found(spark):
    """Spans of exactly ten words of an item, anywhere in a text, with every distance to its ends."""
    rng = random.Random(8)
    item = edge.prose(rng, 200).split()
    docs = [(k, " ".join([*edge.prose(rng, k % 7).split(), *item[k:k + 10], *edge.prose(rng, k % 5).split()]), None, None, None, *edge.CLASHING) for k in range(190)]
    docs += [(500 + k, " ".join(item[k:k + 9] + ["other"] + item[k + 9:k + 18]), None, None, None, *edge.CLASHING) for k in range(0, 180, 9)]
    found = decontamination.find_benchmark_words(*frames(spark, docs, [(1, " ".join(item), "x", 1, 2.0)]))
    rows = {r[0]: (r[1], r[2]) for r in found.select("doc_id", "n_hit", "contaminated").collect()}
    assert all(rows[k][1] and rows[k][0] >= 10 for k in range(190))
    assert got(found) == brute(docs, [(1, " ".join(item))])


def test_empty_tables(spark):
    docs, items = made(False)
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert got(decontamination.find_benchmark_words(frames(spark, docs, items)[0], nothing)) == brute(docs, [])
    assert decontamination.find_benchmark_words(edge.empty(spark), frames(spark, docs, items)[1]).count() == 0
