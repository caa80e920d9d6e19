"""Term vectors in long form: (doc_id, term, tf or weight)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from likerec.functions.text import default_stop_words, tokens
from likerec.session import broadcast_stored


def tokenize(docs: DataFrame, text: Column | str = "text", stop_words: Sequence[str] | None = None) -> DataFrame:
    """One row (doc_id, term) per token that is not a stop word."""
    words = list(default_stop_words() if stop_words is None else stop_words)
    column = F.col(text) if isinstance(text, str) else text
    rows = docs.select("doc_id", F.explode(tokens(column)).alias("term"))
    return rows.where(~F.col("term").isin(words)) if words else rows


def term_counts(token_rows: DataFrame) -> DataFrame:
    """Raw counts (doc_id, term, tf); tasks add up their own tokens before the shuffle."""
    return token_rows.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def _batch_counts(lists: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The row, the term and the count of every term of each list."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    coded = lists.flatten().dictionary_encode()
    width = max(len(coded.dictionary), 1)
    keys, n = np.unique(np.repeat(np.arange(len(sizes)), sizes) * width + coded.indices.to_numpy(), return_counts=True)
    return keys // width, coded.dictionary.take(pa.array(keys % width)), n


def _document_rows(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, term, tf) of rows (doc_id, terms) sorted by document; the last document of a batch may go on in the next."""
    held_id, held = None, Counter()

    def rows(ids: pa.Array, terms: pa.Array, n: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids, terms, n], names=["doc_id", "term", "tf"])

    def held_rows(kind: pa.DataType) -> pa.RecordBatch:
        return rows(pa.array([held_id] * len(held), kind), pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64()))

    kind = None
    for batch in source:
        if not batch.num_rows:
            continue
        ids = batch.column("doc_id")
        kind = ids.type
        # Each document's rows get the number of its run.
        same = pc.or_(pc.fill_null(pc.equal(ids[1:], ids[:-1]), False), pc.and_(pc.is_null(ids[1:]), pc.is_null(ids[:-1])))
        run = np.concatenate([[0], np.cumsum(~same.to_numpy(zero_copy_only=False))])
        starts = np.searchsorted(run, np.arange(run[-1] + 1))
        lists = batch.column("terms")
        sizes = np.add.reduceat(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(), starts)
        joined = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), lists.flatten())
        of, terms, n = _batch_counts(joined)
        ids = ids.take(pa.array(starts))
        first, last = np.searchsorted(of, 1), np.searchsorted(of, len(starts) - 1)
        if held and held_id != ids[0].as_py():
            yield held_rows(kind)
            held = Counter()
        if held and len(starts) > 1:  # the document held so far ends here
            held.update(dict(zip(terms[:first].to_pylist(), n[:first].tolist())))
            yield held_rows(kind)
            held = Counter()
        else:
            first = 0
        if len(starts) > 1 and last > first:
            yield rows(ids.take(pa.array(of[first:last])), terms[first:last], pa.array(n[first:last]))
        held_id = ids[-1].as_py()
        held.update(dict(zip(terms[last:].to_pylist(), n[last:].tolist())))
    if held:
        yield held_rows(kind)


def document_terms(docs: DataFrame, stop_words: Sequence[str] | None = None) -> DataFrame:
    """``term_counts`` of documents (doc_id, text), without a row for each token.

    Texts are shuffled once, by document; the tokens of an Arrow batch are counted with arrays.
    """
    words = list(default_stop_words() if stop_words is None else stop_words)
    terms = tokens(F.col("text"))
    terms = F.filter(terms, lambda t: ~t.isin(words)) if words else terms
    placed = docs.select("doc_id", "text").repartition("doc_id").sortWithinPartitions("doc_id")
    schema = T.StructType([docs.schema["doc_id"], T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])
    return placed.select("doc_id", terms.alias("terms")).mapInArrow(_document_rows, schema)


def smoothed_idf(n_docs: Column, df: Column) -> Column:
    return F.log((1 + n_docs) / (1 + df)) + 1


def idf(tf: DataFrame, n_docs: int) -> DataFrame:
    """(term, df, idf) with idf = ln((1 + n) / (1 + df)) + 1 over ``n_docs`` documents."""
    counted = tf.groupBy("term").agg(F.count("*").alias("df"))
    return counted.withColumn("idf", smoothed_idf(F.lit(n_docs), F.col("df")))


def tfidf(tf: DataFrame, term_idf: DataFrame) -> DataFrame:
    """(doc_id, term, weight): tf x idf divided by the document's norm.

    Terms without an idf are dropped, so a document may end up without rows (a zero vector).
    The norm is summed over the terms of one document, which its text bounds. Both inputs are used
    more than once and should be materialized; a vocabulary whose counted rows are few is broadcast, so that
    counts are shuffled once, by document; a larger one joins by shuffle, where the adaptive skew join splits very common terms.
    """
    raw = F.col("tf") * F.col("idf")
    weighted = tf.join(broadcast_stored(term_idf.select("term", "idf")), "term").select(
        "doc_id", "term", raw.alias("raw"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("doc_id")))
    return weighted.select("doc_id", "term", (F.col("raw") / norm).alias("weight"))
