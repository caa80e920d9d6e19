"""SimHash near-dedup, line dedup and repeated strings, against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from likerec.llm import components, linededup, repeats, simhash, suffix
from tests.llm import edge

BLANKS = " \t\n\x0b\x0c\r"


def plain_fingerprint(text, words):
    found = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for blank in BLANKS:
        found = found.replace(blank, " ")
    found = [w for w in found.split(" ") if w]
    shingles = [" ".join(found[k:k + words]) for k in range(len(found) - words + 1)] or ([" ".join(found)] if found else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values, linked):
    root = list(range(len(values)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(values)):
        for b in range(a):
            if linked(values[a], values[b]):
                root[find(a)] = find(b)
    return [find(k) for k in range(len(values))]


def least_by_root(ids, roots):
    least = {}
    for i, r in zip(ids, roots):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return [least.get(r) for r in roots]


def test_near_duplicates_like_brute_force(spark):
    rows = edge.rows(1)
    prints = [plain_fingerprint(r[1], 3) for r in rows]
    roots = plain_components(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    want = Counter(zip([r[0] for r in rows], [f"{p:016x}" for p in prints], least_by_root([r[0] for r in rows], roots)))
    got = simhash.near_duplicates(edge.documents(spark, 1))
    assert [c for c in got.columns if c in ("fingerprint", "component_id", "lang")] == ["lang", "fingerprint", "component_id"]
    assert Counter(tuple(r) for r in got.select("doc_id", "fingerprint", "component_id").collect()) == want
    assert simhash.near_duplicates(edge.empty(spark)).count() == 0


def plain_firsts(rows):
    """Of (doc_id, text) rows, the ids that stay: the least of each component."""
    prints = [plain_fingerprint(r[1], 3) for r in rows]
    roots = plain_components(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    return Counter(least_by_root([r[0] for r in rows], roots)[roots.index(k)] for k in set(roots))


def test_one_of_each_group_stays(spark):
    rows = edge.rows(6)
    stay = simhash.first_of_each_group(edge.documents(spark, 6))
    kept = [tuple(r) for r in stay.select("doc_id", "text").collect()]
    assert Counter(r[0] for r in kept) == plain_firsts(rows)
    assert set(kept) <= {(r[0], r[1]) for r in rows}
    assert stay.columns == [c for c in edge.documents(spark, 6).columns if c not in ("_llm_fp", "TEXT")]
    assert simhash.first_of_each_group(edge.empty(spark)).count() == 0
    none = spark.createDataFrame([(None, "one two three four"), (None, "one two three four"), (None, "")], "doc_id long, text string")
    assert simhash.first_of_each_group(none).count() == 2


@pytest.mark.parametrize(("block", "look"), [(4096, 65_536), (7, 65_536), (4096, 11), (7, 11)])
def test_links_of_crowded_fingerprints(spark, monkeypatch, block, look):
    """Chains and crowds of near fingerprints, also with keys cut into cells of stored and looking blocks."""
    monkeypatch.setattr(simhash, "BLOCK_ROWS", block)
    monkeypatch.setattr(simhash, "LOOK_ROWS", look)
    monkeypatch.setattr(simhash, "COUNTED", 1)
    rng = np.random.default_rng(2)
    crowd = np.uint64(0x0123456789ABCDEF) ^ (np.uint64(1) << rng.integers(0, 64, 150, dtype=np.uint64)) ^ (
        np.uint64(1) << rng.integers(0, 64, 150, dtype=np.uint64))
    loose = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    near = loose.copy()
    for k in range(3):
        near ^= np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64)
    values = sorted({int(v) for v in np.concatenate([crowd, loose, near])})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash.fingerprint_links(spark.createDataFrame([(v,) for v in signed], "fp long").repartition(3))
    labels = dict(components.component_labels(links).collect())
    roots = plain_components(values, lambda a, b: (a ^ b).bit_count() <= 3)
    want = least_by_root(signed, roots)
    assert [labels.get(v, v) for v in signed] == want
    assert links.count() < 12 * len(values) * (1 if block > 100 else 12)


@given(st.integers(0, (1 << 64) - 1), st.lists(st.integers(0, 63), max_size=3))
@settings(max_examples=300, deadline=None)
def test_keys_meet_within_three_bits(value, flips):
    other = value
    for bit in flips:
        other ^= 1 << bit
    stored, _, _, _ = simhash.fuzzy_keys(np.array([value], np.uint64))
    _, _, looking, _ = simhash.fuzzy_keys(np.array([other], np.uint64))
    assert set(stored.tolist()) & set(looking.tolist())


def test_components_of_a_long_chain(spark):
    edges = [(k, k + 1) for k in range(300)] + [(1000, 1001), (1001, 1000), (5, 5)]
    labels = dict(components.component_labels(spark.createDataFrame(edges, "a long, b long")).collect())
    assert labels == {**{k: 0 for k in range(1, 301)}, 1001: 1000}


def plain_lines(rows, least, min_chars=1):
    def key(line):
        line = line.strip(BLANKS)
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)

    split = [(r[1] or "").split("\n") for r in rows]
    found = Counter(k for lines in split for k in {key(line) for line in lines} if len(k) >= max(1, min_chars))
    kept = [[line for line in lines if found[key(line)] < least or not key(line)] for lines in split]
    return Counter((r[0], len(a), len(a) - len(b), "\n".join(b)) for r, a, b in zip(rows, split, kept))


@pytest.mark.parametrize("least", [2, 10])
def test_line_dedup_like_brute_force(spark, least):
    rows = edge.rows(2)
    got = linededup.drop_shared_lines(edge.documents(spark, 2), min_documents=least)
    assert Counter(tuple(r) for r in got.select("doc_id", "n_lines", "n_dropped", "text").collect()) == plain_lines(rows, least)
    assert linededup.drop_shared_lines(edge.empty(spark)).count() == 0


def plain_first_lines(rows, least):
    """(doc_id, lines, dropped, text) where the first line of each shared key stays in the first document."""
    def keys_of(text):
        return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r")) for line in (text or "").split("\n")]

    found = Counter(key for r in rows for key in set(keys_of(r[1])) if key)
    def place(r):
        return r[0] is None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest()

    first = {}
    for r in rows:
        for key in set(keys_of(r[1])):
            first[key] = min(first.get(key, place(r)), place(r))
    out = []
    for r in rows:
        stay, seen = [], set()
        lines = (r[1] or "").split("\n")
        for line, key in zip(lines, keys_of(r[1])):
            if found[key] < least or (first[key] == place(r) and key not in seen):
                stay.append(line)
            seen.add(key)
        out.append((r[0], len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


@pytest.mark.parametrize("least", [2, 10])
def test_the_first_occurrence_of_a_line_stays(spark, least):
    extra = [(k, "shared\nown %d\n shared\t" % (k % 4), "en", "s", 1, *edge.CLASHING) for k in (500, 400, 400, 300, 300, 300, 600, 700, 800, 900, 950)]
    rows = edge.rows(2) + extra
    docs = spark.createDataFrame(rows, edge.SCHEMA.replace("`TEXT`", "other")).withColumnRenamed("other", "TEXT").repartition(3)
    got = linededup.drop_shared_lines(docs, min_documents=least, keep_first=True)
    expected = plain_first_lines(rows, least)
    assert Counter(tuple(r) for r in got.select("doc_id", "n_lines", "n_dropped", "text").collect()) == Counter(expected)
    assert sum("shared" in r[3].split("\n") for r in expected) == 3  # the repeated rows of the least id
    assert got.columns == linededup.drop_shared_lines(docs, min_documents=least).columns
    assert linededup.drop_shared_lines(edge.empty(spark), keep_first=True).count() == 0


def plain_repeats(rows, width):
    texts = [(r[1] or "").encode() for r in rows]
    found = Counter(t[k:k + width] for t in texts for k in range(len(t) - width + 1))
    out = Counter()
    for r, t in zip(rows, texts):
        gone = bytearray(len(t))
        for k in range(len(t) - width + 1):
            if found[t[k:k + width]] > 1:
                gone[k:k + width] = b"\x01" * width
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out[(r[0], len(t), len(t) - len(kept), sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1])), kept)] += 1
    return out


@pytest.mark.parametrize(("width", "key_bytes"), [(400, 400_000), (400, 3000), (60, 2000)])
def test_repeats_like_brute_force(spark, monkeypatch, width, key_bytes):
    monkeypatch.setattr(repeats, "KEY_BYTES", key_bytes)
    rows = edge.rows(3)
    got = repeats.remove_repeats(edge.documents(spark, 3), width)
    assert Counter((r[0], r[1], r[2], r[3], bytes(r[4])) for r in
                   got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept").collect()) == plain_repeats(rows, width)


def test_a_passage_of_many_texts_is_counted_by_windows(spark, monkeypatch):
    monkeypatch.setattr(repeats, "KEY_BYTES", 5000)
    longest = []
    monkeypatch.setattr(repeats, "_window_rows", lambda width, made=repeats._window_rows: longest.append(width) or made(width))
    rng = random.Random(12)
    passage = edge.prose(rng, 130)[:600]
    texts = [f"{edge.prose(rng, 40)} {passage} {edge.prose(rng, 40)}" for _ in range(60)] + [edge.prose(rng, 200), "a" * 9000, passage * 3]
    rows = [(k, t, "en", "s", 1) for k, t in enumerate(texts)]
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3))
    assert Counter((r[0], r[1], r[2], r[3], bytes(r[4])) for r in
                   got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept").collect()) == plain_repeats(rows, 400)
    assert longest == [400]


def test_repeats_of_an_empty_table(spark):
    assert repeats.remove_repeats(edge.empty(spark)).count() == 0


@given(st.lists(st.integers(1, 4), max_size=60))
@settings(max_examples=300, deadline=None)
def test_suffix_array(symbols):
    symbols = [*symbols, 0]
    assert suffix.suffix_array(np.array(symbols)) == sorted(range(len(symbols)), key=lambda k: symbols[k:])


@given(st.binary(max_size=400).map(lambda b: bytes(x % 3 for x in b)), st.integers(2, 20), st.integers(0, 3))
@settings(max_examples=100, deadline=None)
def test_segments_hold_each_window_once(text, half, seed):
    width = 2 * half
    starts = []
    for first, last, _, _ in repeats.segments(text, width, seed):
        starts += [k for a, b in zip(first.tolist(), last.tolist()) for k in range(a, b - width + 1)]
    assert sorted(starts) == list(range(len(text) - width + 1))
