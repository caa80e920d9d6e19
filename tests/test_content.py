"""Content-based suggestions against a plain re-computation for one user at a time."""

import datetime
import math
import random
import re
from collections import Counter, defaultdict

import pytest

from likerec.functions.text import default_stop_words
from likerec.plans import boundedtopk, content
from likerec.session import materialize
from tests.conftest import LIKES, SONGS, rows

NOW = datetime.datetime(2024, 1, 1)


def song(i, title, artist="A", genre=None, tags=None, minute=0):
    return (i, f"v{i}", title, artist, genre, tags, NOW + datetime.timedelta(minutes=minute))


def text_of(s, mode):
    _, _, title, artist, genre, tags, _ = s
    title, artist, genre, tags = (x or "" for x in (title, artist, genre, tags))
    if mode == "as_coded":
        return " ".join([title, artist * 2, genre * 3, tags])
    return " ".join([title, artist, artist, genre, genre, genre, tags])


def brute(songs, likes, k, pool, mode):
    stop = set(default_stop_words())
    terms = {s[0]: Counter(t for t in re.findall(r"\w\w+", text_of(s, mode).lower()) if t not in stop) for s in songs}
    chosen = sorted(songs, key=lambda s: (-s[6].timestamp(), s[0]))[:pool]
    of = defaultdict(list)
    for user, song_id in sorted(likes):
        of[user].append(song_id)
    result = []
    for user, own in of.items():
        corpus = [terms[i] for i in own] + [terms[s[0]] for s in chosen]
        if not any(corpus) or not chosen:
            continue
        df = Counter(t for doc in corpus for t in doc)
        idf = {t: math.log((1 + len(corpus)) / (1 + n)) + 1 for t, n in df.items()}

        def unit(doc):
            raw = {t: n * idf[t] for t, n in doc.items()}
            norm = math.sqrt(sum(w * w for w in raw.values()))
            return {t: w / norm for t, w in raw.items()}

        profile = Counter()
        for i in own:
            for t, w in unit(terms[i]).items():
                profile[t] += w / len(own)
        norm = math.sqrt(sum(w * w for w in profile.values()))
        scored = []
        for s in chosen:
            dot = sum(w * profile.get(t, 0) for t, w in unit(terms[s[0]]).items())
            scored.append((round(dot / norm if norm else 0.0, 9), s[0]))
        best = sorted((x for x in scored if x[1] not in own), key=lambda x: (-x[0], x[1]))[:k]
        result += [(user, rank, i, round(score, 6)) for rank, (score, i) in enumerate(best, 1)]
    return sorted(result, key=repr)


def found(spark, songs, likes, **options):
    df = content.content_suggestions(
        spark.createDataFrame([(u, s, NOW) for u, s in sorted(likes)], LIKES), spark.createDataFrame(songs, SONGS), **options)
    return sorted([(r.user_id, r.rank, r.song_id, round(r.score, 6)) for r in df.collect()], key=repr)


BASIC = [song(1, "Pop Song", "A", "Pop", "upbeat", 0), song(2, "Pop Song 2", "A", "Pop", "upbeat", 1),
         song(3, "Rock Song", "B", "Rock", "heavy", 1)]


@pytest.mark.parametrize("mode, third", [("as_coded", 0.102515), ("weighted", 0.026246)])
def test_known_scores(spark, mode, third):
    assert found(spark, BASIC, {(7, 1)}, pool=2, mode=mode) == [(7, 1, 2, 1.0), (7, 2, 3, third)]
    assert found(spark, BASIC, {(7, 1)}, pool=2, mode=mode, k=1) == [(7, 1, 2, 1.0)]


def random_songs(seed, n=40):
    generator = random.Random(seed)
    words = ["Blue", "Red", "Night", "the", "a", "Été", "Straße", "love_song", "x", "99", "rock'n'roll", ""]
    pick = lambda m: " ".join(generator.choice(words) for _ in range(generator.randint(0, m)))
    return [song(i, pick(4), pick(2), generator.choice([None, "Pop", "Rock and Roll", ""]),
                 generator.choice([None, "happy, summer", pick(3)]), generator.randint(0, 5)) for i in range(n)]


@pytest.mark.parametrize("mode", ["as_coded", "weighted"])
@pytest.mark.parametrize("heavy_history", [10**6, 4, 0])
def test_matches_plain_computation(spark, mode, heavy_history):
    songs = random_songs(3)
    generator = random.Random(4)
    likes = {(u, generator.randrange(40)) for u in range(12) for _ in range(generator.randint(1, 9))}
    assert found(spark, songs, likes, pool=25, k=6, mode=mode, heavy_history=heavy_history) == brute(
        songs, likes, 6, 25, mode)


def test_zero_scores_fill_the_list_in_id_order(spark):
    songs = [song(1, "alpha", "q", minute=1)] + [song(i, f"other{i}", "zz", minute=2) for i in range(2, 9)]
    likes = {(1, 1), (1, 3), (2, 1)}
    assert found(spark, songs, likes, pool=7, k=5) == brute(songs, likes, 5, 7, "as_coded")
    filled = [r for r in found(spark, songs, likes, pool=7, k=5) if r[0] == 2]
    assert [r[2] for r in filled] == [2, 3, 4, 5, 6] and {r[3] for r in filled} == {0.0}


def test_no_usable_token_gives_no_rows(spark):
    songs = [song(1, "a", ""), song(2, "the", ""), song(3, "!", "")]
    assert found(spark, songs, {(1, 1)}) == []


def test_tokens_only_in_history_fill_with_zero_scores(spark):
    songs = [song(1, "word", ""), song(2, "a", "", minute=1), song(3, "!", "", minute=1)]
    likes = {(1, 1), (2, 2)}
    assert found(spark, songs, likes, pool=2) == brute(songs, likes, 10, 2, "as_coded") == [(1, 1, 2, 0.0), (1, 2, 3, 0.0)]


def test_empty_history_and_empty_pool(spark):
    assert found(spark, BASIC, set()) == []
    assert found(spark, BASIC, {(1, 1)}, pool=0) == []


def test_user_who_likes_everything_gets_nothing(spark):
    assert found(spark, BASIC, {(1, 1), (1, 2), (1, 3)}) == []


def test_wanted_users_only(spark):
    wanted = spark.createDataFrame([(2,)], "user_id long")
    songs, likes = random_songs(5), {(u, s) for u in range(4) for s in (u, u + 3)}
    expected = [r for r in brute(songs, likes, 10, 1000, "as_coded") if r[0] == 2]
    assert found(spark, songs, likes, wanted=wanted) == expected


def test_shared_corpus_ranks_like_per_user_on_the_basic_case(spark):
    result = found(spark, BASIC, {(7, 1)}, pool=2, corpus="shared")
    assert [r[2] for r in result] == [2, 3] and result[0][3] == 1.0


def test_shared_corpus_fills_up_and_never_suggests_a_liked_song(spark):
    songs = random_songs(8)
    likes = {(u, s) for u in range(6) for s in range(u, u + 5)}
    result = found(spark, songs, likes, pool=20, k=7, corpus="shared")
    assert not {(r[0], r[2]) for r in result} & likes
    for user in range(6):
        assert [r[1] for r in sorted(r for r in result if r[0] == user)] == list(range(1, 8))


def test_document_text(spark):
    songs = spark.createDataFrame([song(1, "Song 1", "Artist A", "Pop", "happy, summer"), song(2, "Song 1", None)], SONGS)
    assert rows(content.song_documents(songs), "text") == [
        ("Song 1   ",), ("Song 1 Artist AArtist A PopPopPop happy, summer",)]
    weighted = dict(rows(content.song_documents(songs, "weighted"), "doc_id", "text"))
    assert weighted[1] == "Song 1 Artist A Artist A Pop Pop Pop happy, summer" and weighted[2].strip() == "Song 1"


@pytest.mark.parametrize("block", [1024, 2])
@pytest.mark.parametrize("pool", [25, None])
def test_bounds_leave_the_same_rows(spark, monkeypatch, pool, block):
    monkeypatch.setattr(boundedtopk, "BLOCK_POSTINGS", block)
    songs = random_songs(13)
    generator = random.Random(14)
    likes = {(u, generator.randrange(40)) for u in range(12) for _ in range(generator.randint(1, 9))}
    assert found(spark, songs, likes, pool=pool, k=3, bounded=True) == brute(songs, likes, 3, pool or 40, "as_coded")
    assert found(spark, BASIC, set(), bounded=True) == found(spark, BASIC, {(1, 1)}, pool=0, bounded=True) == []


def test_most_cells_of_a_large_vocabulary_are_never_made(spark):
    """Songs with a common word, some often used and some rare ones; users who like a few."""
    generator = random.Random(15)
    songs = []
    for i in range(400):
        rare = " ".join(f"word{int(300 * generator.random() ** 2)}" for _ in range(3))
        songs.append(song(i, f"live {rare}", f"band{generator.randrange(60)}"))
    likes = {(u, generator.randrange(400)) for u in range(25) for _ in range(3)}
    assert found(spark, songs, likes, pool=None, k=5, bounded=True) == brute(songs, likes, 5, 400, "as_coded")

    rows_ = spark.createDataFrame([(u, s, NOW) for u, s in sorted(likes)], LIKES)
    table = spark.createDataFrame(songs, SONGS)
    candidates = content.prepare_candidates(table, None, "as_coded", None)
    profiles = content.weighted_profiles(rows_, content.song_vectors(table, candidates, "as_coded", None), candidates)
    _, cells = content.bounded_content_scores(profiles, candidates, rows_.select("user_id", "song_id"), 5)
    assert content.content_scores(profiles, candidates).count() == 25 * 400
    assert cells.count() < 0.2 * 25 * 400


def test_scores_stay_in_the_tasks_of_their_users(spark):
    from likerec.operators.profiles import cosine_scores, user_profiles
    vectors = spark.createDataFrame([(1, "a", 0.6), (1, "b", 0.8), (2, "b", 1.0), (3, "c", 1.0)], "doc_id long, term string, weight double")
    history = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (2, 9), (None, 1)], "user_id long, song_id long")
    profiles = user_profiles(history, materialize(vectors))
    assert rows(profiles.selectExpr("user_id", "term", "round(weight, 9) w"), "user_id", "term", "w") == [
        (1, "a", 0.3), (1, "b", 0.9), (2, "b", 0.5)]
    scores = cosine_scores(profiles, vectors)
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "hashpartitioning(user_id" in line and (", term" in line or ", song_id" in line)]
    assert {(u, s) for u, s, _ in rows(scores, "user_id", "song_id", "score")} == {(1, 1), (1, 2), (2, 1), (2, 2)}


def test_only_the_best_cells_of_a_user_leave_the_task(spark):
    """Ties at the last place go to the smaller id; liked songs and songs without a common word are left out."""
    generator = random.Random(16)
    songs = [song(i, f"live {generator.choice(['red', 'blue', 'night'])}", f"band{i % 3}") for i in range(60)] + [song(60, "alone", "Solo")]
    rows_ = spark.createDataFrame(sorted({(u, generator.randrange(60), NOW) for u in range(8) for _ in range(5)}), LIKES)
    table = spark.createDataFrame(songs, SONGS)
    candidates = content.prepare_candidates(table, None, "as_coded", None)
    profiles = materialize(content.weighted_profiles(rows_, content.song_vectors(table, candidates, "as_coded", None), candidates))
    cells = defaultdict(list)
    for r in content.content_scores(profiles, candidates).collect():
        if not r.liked and r.score > 0:
            cells[r.user_id].append((-math.floor(r.score / 1e-9 + 0.5), r.song_id))
    expected = sorted((user, song_id) for user, own in cells.items() for _, song_id in sorted(own)[:7])
    assert rows(content.content_scores(profiles, candidates, 7), "user_id", "song_id") == sorted(expected, key=repr)
    assert len(expected) == 8 * 7


@pytest.mark.parametrize("corpus", ["per_user", "shared"])
def test_array_scores_give_the_rows_of_the_join(spark, monkeypatch, corpus):
    songs, generator = random_songs(17), random.Random(18)
    likes = {(u, generator.randrange(42)) for u in range(9) for _ in range(generator.randint(1, 12))}
    packed = found(spark, songs, likes, pool=30, k=6, corpus=corpus)
    monkeypatch.setattr(content, "fits_broadcast", lambda df: False)
    assert packed and packed == found(spark, songs, likes, pool=30, k=6, corpus=corpus)


@pytest.mark.parametrize("slab, matrix", [(10**6, 10**6), (10**6, 0), (60, 10**6), (60, 0)])
def test_bounded_cells_are_no_rows(spark, monkeypatch, slab, matrix):
    """Few words name all songs, so bounds leave nearly all cells; only the best of a user and slab become rows."""
    monkeypatch.setattr(boundedtopk, "SLAB_POSTINGS", slab)
    monkeypatch.setattr(boundedtopk, "MATRIX_NUMBERS", matrix)
    songs = random_songs(21, 60)
    generator = random.Random(22)
    likes = {(u, generator.randrange(60)) for u in range(10) for _ in range(generator.randint(1, 9))}
    assert found(spark, songs, likes, pool=None, k=3, bounded=True) == brute(songs, likes, 3, 60, "as_coded")
    rows_, table = spark.createDataFrame([(u, s, NOW) for u, s in sorted(likes)], LIKES), spark.createDataFrame(songs, SONGS)
    candidates = content.prepare_candidates(table, None, "as_coded", None)
    profiles = content.weighted_profiles(rows_, content.song_vectors(table, candidates, "as_coded", None), candidates)
    scores, cells = content.bounded_content_scores(profiles, candidates, rows_.select("user_id", "song_id"), 3)
    slabs = -(-candidates.postings.where("tf > 0").count() // slab)
    assert scores.count() <= 10 * 3 * slabs and cells.count() > 10 * 3 * 2
    assert scores.select("user_id", "song_id").exceptAll(cells).isEmpty()


@pytest.mark.parametrize("chunk", [1024, 2])
def test_long_histories_are_shuffled_packed(spark, monkeypatch, chunk):
    """In chunks of two songs and in whole ones; no shuffle by user and term holds a row for each song's term."""
    monkeypatch.setattr(content, "HISTORY_CHUNK", chunk)
    songs = random_songs(31)
    generator = random.Random(32)
    likes = {(u, generator.randrange(40)) for u in range(9) for _ in range(generator.randint(1, 12))}
    assert found(spark, songs, likes, pool=25, k=6, heavy_history=2) == brute(songs, likes, 6, 25, "as_coded")
    rows_, table = spark.createDataFrame([(u, s, NOW) for u, s in sorted(likes)], LIKES), spark.createDataFrame(songs, SONGS)
    candidates = content.prepare_candidates(table, 25, "as_coded", None)
    vectors = materialize(content.song_vectors(table, candidates, "as_coded", None))
    plain, heavy = (content.weighted_profiles(rows_, vectors, candidates, h) for h in (10**6, 0))
    columns = ["user_id", "h", "term", "df", "dfh", "round(weight, 9) weight", "round(norm2, 9) norm2"]
    assert rows(plain.selectExpr(*columns), "*") == rows(heavy.selectExpr(*columns), "*")
    plan = heavy._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(user_id" in plan and not [line for line in plan.splitlines() if "hashpartitioning(user_id" in line and ", song_id" in line]
