"""Sources are mixed to target weights by Poisson replication, with DataFrame functions only.

Each source has a target rate of repetition: its target share of the bytes over its actual share. Each document
draws its number of copies from the Poisson distribution of that mean, by inverting the distribution at a number
in (0, 1) that a hash of its id and a seed gives: the same rows and seed give the same copies on any cluster. The
copies are exploded and shuffled by a second hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from likerec.llm.common import broadcast_bounded, stash, tidy

# A mean above this is drawn as a sum of Poisson numbers of smaller means, so the table of a source is short.
MAX_MEAN = 32.0
# Values at which the distribution is tabulated: up to 12 standard deviations above the largest mean.
TABULATED = 101


def hashed_integer(*parts: Column, digits: int = 13) -> Column:
    """A number of 4 * ``digits`` bits, from the MD5 of the joined parts; null parts are spelled out."""
    joined = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, digits), 16, 10).cast("long")


def uniform(*parts: Column) -> Column:
    """A number in (0, 1), by ``hashed_integer``."""
    return (hashed_integer(*parts) + F.lit(0.5)) / F.lit(float(1 << 52))


def _poisson_table(mean: Column) -> Column:
    """P(X <= k) for k = 0, 1, ..., by the ratio of neighbouring terms."""
    first = F.exp(-mean)
    start = F.struct(first.alias("term"), first.alias("total"), F.array(first).alias("cdf"))

    def step(state: Column, k: Column) -> Column:
        term = state["term"] * mean / k
        total = state["total"] + term
        return F.struct(term.alias("term"), total.alias("total"), F.concat(state["cdf"], F.array(total)).alias("cdf"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TABULATED - 1)), start, step, lambda state: state["cdf"])


def source_rates(docs: DataFrame, weights: DataFrame | None = None, temperature: float = 0.5, epochs: float = 1.0) -> DataFrame:
    """source, n_bytes, rate: how often each source's documents are to be repeated on average.

    ``weights`` (source, weight) are target shares in any unit; a source without a row has weight 0. Without them a
    source's weight is its bytes to the power ``temperature``. All shares together make ``epochs`` times the bytes.
    A text's size is its UTF-8 bytes plus 1, so that empty texts have a size too.
    """
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")
    sizes = docs.groupBy("source").agg(F.sum(size).alias("n_bytes"))
    if weights is None:
        weighted = sizes.withColumn("weight", F.pow(F.col("n_bytes").cast("double"), F.lit(temperature)))
    else:
        given = weights.groupBy(F.col("source").alias("_llm_source")).agg(F.sum(F.col("weight").cast("double")).alias("weight"))
        weighted = (
            sizes.join(given, F.col("source").eqNullSafe(F.col("_llm_source")), "left").drop("_llm_source")
            .withColumn("weight", F.when(F.col("weight") > 0, F.col("weight")).otherwise(F.lit(0.0)))
        )
    weighted = stash(weighted, "source-weights")
    # One row of two sums; the driver holds nothing else.
    total = weighted.agg(F.sum("weight").alias("weight"), F.sum("n_bytes").alias("n_bytes")).first()
    share = F.col("weight") / F.lit(total["weight"]) if total["weight"] else F.lit(0.0)
    rate = F.lit(epochs) * F.lit(float(total["n_bytes"] or 0)) * share / F.col("n_bytes")
    return weighted.select("source", "n_bytes", rate.alias("rate"))


def mix_sources(
    docs: DataFrame, weights: DataFrame | None = None, temperature: float = 0.5, epochs: float = 1.0, seed: int = 0
) -> DataFrame:
    """``docs``, each row as often as it drew, with ``copy`` (1, 2, ...) and ``shuffle_key``, globally shuffled.

    Rows are dealt to partitions by ``shuffle_key`` and sorted by it within them. The mean number of copies is the
    source's rate (``source_rates``). Rows with the same doc_id (null is one) draw the same number. A null source
    is a source of its own; null and empty texts have size 1; columns named like an output are replaced; an empty
    table gives an empty result.
    """
    docs = tidy(docs, ["doc_id", "text", "source"], ["copy", "shuffle_key"])
    rates = source_rates(docs, weights, temperature, epochs).where(F.col("rate") > 0)
    pieces = F.ceil(F.col("rate") / F.lit(MAX_MEAN)).cast("int")
    tables = stash(
        rates.withColumn("_llm_pieces", pieces)
        .select(F.col("source").alias("_llm_source"), "_llm_pieces", _poisson_table(F.col("rate") / F.col("_llm_pieces")).alias("_llm_cdf")),
        "poisson-tables")

    def draw(piece: Column) -> Column:
        u = uniform(F.lit(seed), piece, F.col("doc_id"))
        return F.size(F.filter("_llm_cdf", lambda p: p < u))

    copies = F.aggregate(F.transform(F.sequence(F.lit(1), F.col("_llm_pieces")), draw), F.lit(0), lambda a, b: a + b)
    drawn = (
        docs.join(broadcast_bounded(tables, 8 * TABULATED + 64), F.col("source").eqNullSafe(F.col("_llm_source")))
        .withColumn("_llm_copies", copies)
        .where(F.col("_llm_copies") > 0)
        .select(*[f"`{c}`" for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col("_llm_copies"))).alias("copy"))
        .withColumn("shuffle_key", hashed_integer(F.lit("order"), F.lit(seed), F.col("copy"), F.col("doc_id"), digits=15))
    )
    return drawn.repartition("shuffle_key").sortWithinPartitions("shuffle_key")
