"""Search that tolerates spelling: the closest name by common trigrams, found through rare ones.

A name is the set of its trigrams, and two names are as similar as their sets (Jaccard). Names of a similarity of
more than a half share at least two trigrams among the rarest of each, in any fixed order of the trigrams
(prefix filtering): with n trigrams, of which at least m are shared, among the first n - m + 2. Rare trigrams of these
are looked up one by one. Trigrams of many names are never looked up alone, but in pairs, so that what ``the`` or
``remix`` have in common brings nobody together. Names that meet are compared exactly.

The higher the similarity, the fewer trigrams a name is looked up by. So very similar names are searched first, and only
queries that have found none are asked again for less similar ones: the best name of a query that has found some is among them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from likerec.functions.text import normalize_query
from likerec.session import materialize, shuffle_width

SIMILARITY = 0.6
# A trigram of more names than this is looked up in pairs only.
COMMON_NAMES = 256
# Similarities that are searched before the wanted one, if they are higher.
FIRST_SIMILARITIES = (0.8, 0.7)
# Longs of a name's signature, in which each trigram sets a bit.
SIGNATURE = 4


def trigrams(text: Column) -> Column:
    """The distinct trigrams of a text with two blanks before and one behind; two or more for any text.

    A trigram is the number that its three code points of 21 bits make.
    """
    padded = F.concat(F.lit("  "), text, F.lit(" "))
    codes = F.transform(F.sequence(F.lit(1), F.length(padded)), lambda i: F.ascii(F.substr(padded, i, F.lit(1))).cast("long"))
    return F.transform(F.array(codes), lambda c: F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(c) - 3), lambda i: (
        F.shiftleft(c[i], 42).bitwiseOR(F.shiftleft(c[i + 1], 21)).bitwiseOR(c[i + 2])))))[0]


def _signature(grams: Column) -> list[Column]:
    """Longs with the bit of each trigram's hash, one of 64 times as many."""
    def word(k: int) -> Column:
        def add(mask: Column, gram: Column) -> Column:
            bit = F.pmod(F.xxhash64(gram), F.lit(64 * SIGNATURE))
            return F.when(F.floor(bit / 64) == k, mask.bitwiseOR(F.call_function(
                "shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int")))).otherwise(mask)
        return F.aggregate(grams, F.lit(0).cast("long"), add).alias(f"bits{k}")
    return [word(k) for k in range(SIGNATURE)]


def name_forms(catalog: DataFrame) -> DataFrame:
    """(form, tier, id): the song each search form stands for.

    ``title - artist`` (tier 1) beats the bare title (tier 2), then the smaller id wins. One row per form, so
    however many songs share a name, a search meets one row.
    """
    title, artist = F.col("title"), F.col("artist")
    forms = F.array(
        F.struct(F.lit(1).alias("tier"), normalize_query(F.concat(title, F.lit(" - "), artist)).alias("form")),
        F.struct(F.lit(2).alias("tier"), normalize_query(title).alias("form")),
    )
    return (
        catalog.select("id", F.explode(forms).alias("f"))
        .where(F.col("f.form").isNotNull())
        .groupBy(F.col("f.form").alias("form"))
        .agg(F.min(F.struct(F.col("f.tier"), F.col("id"))).alias("first"))
        .select("form", "first.tier", "first.id")
    )


def _numbered(names: DataFrame, number: str, text: str) -> DataFrame:
    """``names`` stored with a number, a signature, and the trigrams of ``text``, at most as many as a query is long."""
    with_grams = names.withColumn(number, F.monotonically_increasing_id()).withColumn("grams", trigrams(F.col(text)))
    return materialize(with_grams.select("*", *_signature(F.col("grams"))))


def _keys(names: DataFrame, number: str, counts: DataFrame, similarity: float, common: int) -> DataFrame:
    """(number, key, size, bits): what a name is looked up by, its number of trigrams and its signature."""
    bits = [f"bits{k}" for k in range(SIGNATURE)]
    ordered = (
        names.select(number, *bits, F.explode("grams").alias("gram")).join(counts, "gram", "left")
        .groupBy(number, *bits).agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))).alias("grams"))
    )
    size = F.size("grams")
    shared = F.ceil(size * F.lit(similarity) - 1e-9)
    first = ordered.select(number, *bits, size.alias("size"), F.slice("grams", F.lit(1), (size - shared + 2).cast("int")).alias("first"))
    parted = first.select(number, *bits, "size", F.filter("first", lambda g: g["n"] <= common)["gram"].alias("rare"),
                          F.filter("first", lambda g: g["n"] > common)["gram"].alias("often"))
    # A pair's hash may be another pair's; that brings names together which are then told apart.
    pairs = F.flatten(F.transform("often", lambda a, i: F.transform(
        F.slice("often", i + 2, F.greatest(F.size("often"), F.lit(1))), lambda b: F.xxhash64(a, b))))
    return parted.select(number, *bits, "size", F.explode(F.concat("rare", pairs)).alias("key"))


def _may_be_similar(similarity: float) -> Column:
    """Whether two rows of ``_keys``, the second with names that begin with ``form_``, can have enough in common.

    A bit that one signature alone has stands for one trigram at least that the other name lacks.
    """
    needed = (F.col("size") + F.col("form_size")) * (similarity / (1 + similarity)) - 1e-9
    alone = other = F.lit(0)
    for k in range(SIGNATURE):
        a, b = F.col(f"bits{k}"), F.col(f"form_bits{k}")
        alone, other = alone + F.bit_count(a.bitwiseAND(F.bitwise_not(b))), other + F.bit_count(b.bitwiseAND(F.bitwise_not(a)))
    return (F.col("size") - alone >= needed) & (F.col("form_size") - other >= needed)


def closest_forms(queries: DataFrame, forms: DataFrame, similarity: float = SIMILARITY, common: int = COMMON_NAMES) -> DataFrame:
    """(query, id, score): the best form for each distinct ``query``, if there is one of at least the similarity.

    An equal form comes first, then the higher score, the lower ``tier`` and the smaller ``id``. ``forms`` is (form, tier, id).
    Every form of at least the similarity is found; it has to be over 0.5. Null queries have no answer.
    """
    if not 0.5 < similarity <= 1:
        raise ValueError("names have to share more than half of their trigrams")
    queries = queries.select("query").where(F.col("query").isNotNull()).distinct()
    known = _numbered(forms, "form_number", "form")
    equal = queries.join(known.select(F.col("form").alias("query"), "id"), "query").withColumn("score", F.lit(1.0))
    asked = _numbered(queries.join(known.select(F.col("form").alias("query")), "query", "left_anti"), "query_number", "query")
    counts = materialize(known.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("n")))

    rounds = []
    for level in [*(first for first in FIRST_SIMILARITIES if first > similarity), similarity]:
        rounds.append(_best_forms(asked, known, counts, level, common))
        if level > similarity:
            rounds[-1] = materialize(rounds[-1])
            asked = materialize(asked.join(rounds[-1].select("query"), "query", "left_anti"))
    result = equal.select("query", "id", "score")
    for best in rounds:
        result = result.unionByName(best)
    return result


def _best_forms(asked: DataFrame, known: DataFrame, counts: DataFrame, similarity: float, common: int) -> DataFrame:
    """(query, id, score) of the queries that have a form of at least the similarity."""
    mine = _keys(asked, "query_number", counts, similarity, common)
    theirs = _keys(known, "form_number", counts, similarity, common)
    theirs = theirs.withColumnsRenamed({c: f"form_{c}" for c in theirs.columns if c not in ("form_number", "key")})
    # Keys are few bytes but meet many, so tasks must not be as few as the bytes suggest.
    met = mine.repartition(shuffle_width(known.sparkSession), "key").join(theirs, "key").where(_may_be_similar(similarity)).select("query_number", "form_number").distinct()
    both = met.join(asked.select("query_number", "query", F.col("grams").alias("own")), "query_number").join(
        known.select("form_number", "tier", "id", "grams"), "form_number")
    counted = both.select("query", "tier", "id", F.size(F.array_intersect("own", "grams")).alias("n"), (F.size("own") + F.size("grams")).alias("all"))
    score = F.col("n") / (F.col("all") - F.col("n"))
    return (
        counted.select("query", "tier", "id", score.alias("score")).where(F.col("score") >= similarity)
        .groupBy("query").agg(F.min(F.struct((-F.col("score")).alias("worse"), "tier", "id")).alias("b"))
        .select("query", "b.id", (-F.col("b.worse")).alias("score"))
    )
