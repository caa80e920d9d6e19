"""Words of documents that occur in a benchmark, by winnowed fingerprints and exact windows; DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from likerec.llm.common import broadcast_bounded, stash, tidy

# Everything but digits, a-z and what is not ASCII parts words, once A-Z are lower case.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

GRAM = 5
# Copies of a text that a third of the rows share are spread over so many tasks where they meet the list of hits.
SALTS = 32

OUTPUTS = ["n_words", "n_hit", "n_items", "items", "hit_spans", "contaminated"]


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), then)[0]


def words_of(text: Column) -> Column:
    """The words of a text, with A-Z lower-cased; none for null."""
    plain = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.coalesce(F.array_remove(F.split(plain, BETWEEN_WORDS), ""), F.array().cast("array<string>"))


def _up_to(last: Column) -> Column:
    """0, 1, ... ``last``; nothing if that is negative."""
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def _grams(hashes: Column, length: int) -> Column:
    """The hash of each run of ``length`` words, from the hashes of the words."""
    return F.transform(_up_to(F.size(hashes) - length), lambda i: F.xxhash64(*[hashes[i + k] for k in range(length)]))


def _winnowed(hashes: Column, width: int) -> Column:
    """For each window of ``width`` words the least hash of its runs of ``GRAM`` words."""
    runs = width - GRAM + 1
    return _let(_grams(hashes, GRAM), lambda grams: F.transform(
        _up_to(F.size(grams) - runs), lambda i: F.array_min(F.slice(grams, i + 1, runs))))


def _prints(hashes: Column, length: int, width: int) -> Column:
    """The fingerprint of each window of ``length`` words: the winnowed one for whole windows, else the window's hash."""
    return _winnowed(hashes, width) if length == width else _grams(hashes, length)


def _hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _windows(words: Column, hashes: Column, length: int, width: int) -> Column:
    """(at, length, print, key) of each window of ``length`` words; the key is the digest of its words."""
    prints = F.transform(_prints(hashes, length, width), lambda p, i: F.struct(p.alias("print"), i.alias("at")))
    return F.transform(prints, lambda p: F.struct(
        p["at"].alias("at"), F.lit(length).alias("length"), p["print"].alias("print"),
        F.sha2(F.array_join(F.slice(words, p["at"] + 1, length), " "), 256).alias("key")))


def benchmark_windows(items: DataFrame, width: int) -> DataFrame:
    """(item, at, length, print, key): windows of ``width`` words of each item, or all its words where it has fewer; none without words."""
    words = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), words_of(F.col("text")).alias("words"))
    found = words.select("item", "words", F.size("words").alias("n")).where("n > 0")

    def of(length: int) -> Column:
        fits = F.col("n") >= width if length == width else F.col("n") == length
        return F.when(fits, _let(F.col("words"), lambda w: _let(_hashed(w), lambda h: _windows(w, h, length, width))))

    return found.select("item", F.explode(F.coalesce(*map(of, range(1, width + 1)))).alias("w")).select("item", "w.*")


def find_benchmark_words(docs: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """Documents with their words that lie in an occurrence of a benchmark window.

    A window is ``width`` consecutive words of an item; an item of fewer words, but not none, is one window. Winnowing
    keeps the least hash of five-word runs in every window of ``width`` words, so a shared window shares a fingerprint,
    whatever stands around it. Fingerprints of documents and items are joined; in texts with a hit every window is then
    held against the items' windows under its fingerprint, by a digest of all its words, and overlapping windows merge.
    Windows of items shorter than that are their own fingerprints, so all runs of that many words are looked up.

    Gives the columns of ``docs`` but the text, ``n_words``, ``n_hit``, ``n_items``, ``items`` (ids of the items with occurring windows, as
    sorted strings; a null id is ``null``), ``hit_spans`` (word positions, end exclusive) and ``contaminated``. A null text has no
    words. Equal texts are searched once; the items of documents that hold the same windows are gathered once, so
    neither a passage of many documents nor one of many items makes pairs of both. Either table may be empty.
    """
    docs = tidy(docs, ["doc_id", "text"], OUTPUTS)
    windows = stash(benchmark_windows(tidy(items, ["item_id", "text"], []), width).select("item", "length", "print", "key").distinct(), "benchmark-windows")
    lengths = sorted(r[0] for r in windows.select("length").distinct().collect())  # no more than width numbers

    digest = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    worded = docs.withColumn("_llm_digest", digest).withColumn("_llm_words", words_of(F.col("text")))
    prints = _let(_hashed(F.col("_llm_words")), lambda h: F.array_distinct(F.concat(
        F.array().cast("array<bigint>"), *[_prints(h, k, width) for k in lengths])))
    others = [c for c in docs.columns if c != "text"]
    printed = stash(worded.select(*others, "_llm_digest", F.size("_llm_words").cast("long").alias("n_words"), prints.alias("_llm_prints")), "document-prints")

    wanted = broadcast_bounded(stash(windows.select("print").distinct(), "benchmark-prints"), 32)
    hits = printed.select("_llm_digest", F.explode("_llm_prints").alias("print")).join(wanted, "print", "left_semi").select("_llm_digest").distinct()
    texts = _texts_of(docs.select("text").withColumn("_llm_digest", digest), stash(hits, "document-hits"))
    matches = stash(_matches(texts, windows, lengths, width), "benchmark-matches")
    found = _spans(matches).join(_items(matches, windows), "_llm_digest")
    merged = printed.drop("_llm_prints").join(found, "_llm_digest", "left")
    return merged.select(
        *others, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("hit_spans", F.array().cast("array<struct<start: int, end: int>>")).alias("hit_spans"),
        F.col("n_hit").isNotNull().alias("contaminated"))


def _texts_of(texts: DataFrame, digests: DataFrame) -> DataFrame:
    """One text for each of the stored ``digests``.

    Copies are combined within tasks. Where the list is too long for a broadcast, copies of one text are spread over
    tasks first, as nothing could split them between the join and the combination by the same key.
    """
    joined = broadcast_bounded(digests, 96)
    if joined is digests:
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_llm_salt")
        spread = texts.withColumn("_llm_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
        texts = spread.join(digests.select("_llm_digest", salts), ["_llm_digest", "_llm_salt"], "left_semi")
    else:
        texts = texts.join(joined, "_llm_digest", "left_semi")
    return texts.groupBy("_llm_digest").agg(F.first("text").alias("text"))


def _matches(texts: DataFrame, windows: DataFrame, lengths: list[int], width: int) -> DataFrame:
    """(digest, start, end, key) of each window of a text that an item has."""
    words = texts.select("_llm_digest", words_of(F.col("text")).alias("words"))
    kind = "array<struct<at: int, length: int, print: bigint, key: string>>"
    cut = _let(F.col("words"), lambda w: _let(_hashed(w), lambda h: F.concat(F.array().cast(kind), *[_windows(w, h, k, width) for k in lengths])))
    own = words.select("_llm_digest", F.explode(cut).alias("w")).select("_llm_digest", "w.*")
    known = broadcast_bounded(stash(windows.select("length", "print", "key").distinct(), "benchmark-keys"), 160)
    return own.join(known, ["length", "print", "key"], "left_semi").select(
        "_llm_digest", F.col("at").alias("start"), (F.col("at") + F.col("length")).alias("end"), "key")


def _spans(matches: DataFrame) -> DataFrame:
    """(digest, n_hit, hit_spans): windows that overlap or touch, merged."""
    by_place = Window.partitionBy("_llm_digest").orderBy("start", "end")
    before = F.max("end").over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    started = matches.select("_llm_digest", "start", "end", (F.col("start") > F.coalesce(before, F.lit(-1))).cast("int").alias("new"))
    runs = started.withColumn("run", F.sum("new").over(by_place.rowsBetween(Window.unboundedPreceding, 0))).groupBy("_llm_digest", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"))
    return runs.groupBy("_llm_digest").agg(
        F.sum(F.col("end") - F.col("start")).alias("n_hit"), F.sort_array(F.collect_list(F.struct("start", "end"))).alias("hit_spans"))


def _items(matches: DataFrame, windows: DataFrame) -> DataFrame:
    """(digest, items): gathered once for all texts that hold the same windows."""
    held = matches.groupBy("_llm_digest").agg(F.sort_array(F.collect_set("key")).alias("keys"))
    held = stash(held.withColumn("profile", F.sha2(F.array_join("keys", ""), 256)), "benchmark-profiles")
    profiles = held.groupBy("profile").agg(F.first("keys").alias("keys")).select("profile", F.explode("keys").alias("key"))
    items = profiles.join(windows.select("key", "item").distinct(), "key").groupBy("profile").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return held.select("_llm_digest", "profile").join(items, "profile").select("_llm_digest", "items")
