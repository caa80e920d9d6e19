"""A training corpus from ``documents``: toxicity, line dedup, near-dedup, mixing, encoding.

``STAGES`` lists the stages; each takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read
again as the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from likerec.llm import bpe, linededup, mixing, simhash, toxicity
from likerec.llm.common import stash, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOXIC_SCORE = 0.7


def _documents(docs: DataFrame) -> DataFrame:
    """The columns of documents, with ``n_chars`` as the text now is."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; labels are those of the folder."""
    model = toxicity.fit_from_labels(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs.select(*COLUMNS), model).where(F.col("score") < TOXIC_SCORE).select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more of them share."""
    return _documents(linededup.drop_shared_lines(docs.select(*COLUMNS), min_documents=10))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near fingerprints: the first by id."""
    return simhash.first_of_each_group(docs.select(*COLUMNS), words=3, max_distance=3).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target rate has it drawn, in shuffled order."""
    return mixing.mix_sources(docs.select(*COLUMNS), temperature=0.5, epochs=1.0, seed=20).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and the digest of what they decode to."""
    import public_tokenizers

    vocabulary = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    encoded = bpe.encode_texts(docs.select(*COLUMNS), *vocabulary).drop("text")
    decoded = bpe.decode_ids(encoded, vocabulary[0])
    return decoded.select("doc_id", "lang", "source", "n_chars", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("mixing", mix),
    ("byte_bpe", encode),
]

# Trained models and fingerprints are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage before is stored."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
