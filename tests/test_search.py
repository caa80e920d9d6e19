"""The closest name by trigrams, against a comparison of all names."""

import random

import pytest

from likerec.operators import ingest, search

FORMS = "form string, tier int, id long"


def grams(text):
    padded = f"  {text} "
    return {padded[k:k + 3] for k in range(len(padded) - 2)}


def brute(queries, forms, similarity):
    found = {}
    for query in {q for q in queries if q is not None}:
        a = grams(query)
        ranked = []
        for form, tier, i in forms:
            b = grams(form)
            score = len(a & b) / len(a | b)
            if score >= similarity:
                ranked.append((form != query, -score, tier, i))
        if ranked:
            found[query] = (min(ranked)[3], -min(ranked)[1])
    return found


def made(seed, words=12):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdé你") for _ in range(rng.randint(1, 6))) for _ in range(words)]
    names = {" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 5))) for _ in range(150)} | {"a", "aaaa", "aaaaa", "𝄞x"}
    forms = [(name, 1 + k % 2, (k * 37) % 1000 - 20) for k, name in enumerate(sorted(names))]
    queries = [None, "", "zzz", "aaaaaa", "𝄞", *sorted(names)[::5]]
    for name in sorted(names):
        at = rng.randrange(len(name))
        queries += [name[:at] + name[at + 1:], name[:at] + "x" + name[at:], name + name[-1], name[::-1]]
    return queries, forms


@pytest.mark.parametrize(("similarity", "common"), [(0.51, 0), (0.6, 20), (0.8, 0), (0.6, 256)])
def test_closest_forms_like_brute_force(spark, similarity, common):
    queries, forms = made(int(similarity * 100) + common)
    got = search.closest_forms(spark.createDataFrame([(q,) for q in queries], "query string").repartition(3),
                               spark.createDataFrame(forms, FORMS), similarity, common)
    rows = got.collect()
    assert {r["query"]: (r["id"], r["score"]) for r in rows} == brute(queries, forms, similarity)
    assert len(rows) == len({r["query"] for r in rows})


def test_names_resolve_to_the_closest_song(spark):
    songs = [(1, "v1", "Yellow Submarine", "Beatles"), (2, "v2", "Yellow", "Coldplay"), (3, "v3", "Yellow", "Other")]
    catalog = spark.createDataFrame(songs, "id long, video_id string, title string, artist string")
    names = ["yelow submarine", "Yellow!", "yellow - coldplai", "Yellow Submarin - Beatles", "something else", "???", None]
    asked = spark.createDataFrame([(k, n) for k, n in enumerate(names)], "k int, song_name string")
    resolved = ingest.resolve_songs(asked, catalog, keep_unresolved=True, similarity=0.6)
    assert {r["k"]: r["video_id"] for r in resolved.collect()} == {0: "v1", 1: "v2", 2: "v2", 3: "v1", 4: None, 5: None, 6: None}
    assert {r["k"] for r in ingest.resolve_songs(asked, catalog, similarity=0.6).collect()} == {0, 1, 2, 3}
    assert {r["k"] for r in ingest.resolve_songs(asked, catalog).collect()} == {1}
    with pytest.raises(ValueError, match="half"):
        ingest.resolve_songs(asked, catalog, similarity=0.5)


def test_empty_sides(spark):
    queries, forms = made(1)
    asked, known = spark.createDataFrame([(q,) for q in queries], "query string"), spark.createDataFrame(forms, FORMS)
    assert search.closest_forms(asked.limit(0), known).count() == 0
    assert search.closest_forms(asked, known.limit(0)).count() == 0


def test_queries_with_a_very_similar_name_are_not_asked_for_less_similar_ones(spark, monkeypatch):
    forms = [("yellow submarine - beatles", 1, 1), ("yellow submarine - beetles", 1, 2), ("blue train", 1, 3)]
    queries = ["yelow submarine - beatles", "blu train", "blue trane song"]
    asked, plain = [], search._best_forms

    def noted(rows, *rest):
        asked.append({r["query"] for r in rows.collect()})
        return plain(rows, *rest)

    monkeypatch.setattr(search, "_best_forms", noted)
    got = search.closest_forms(spark.createDataFrame([(q,) for q in queries], "query string"), spark.createDataFrame(forms, FORMS), 0.51)
    assert {r["query"]: (r["id"], r["score"]) for r in got.collect()} == brute(queries, forms, 0.51)
    assert asked[0] == set(queries) and queries[0] not in asked[-1] and len(asked) == len(search.FIRST_SIMILARITIES) + 1
