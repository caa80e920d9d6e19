"""Toxicity of documents by multiple-instance learning.

Labels say whether a document is toxic, not which of its sentences is. Each sentence gets a probability from a
linear model of its words; a document is toxic if any sentence is, so its score combines them by noisy-or:
1 - product(1 - p). The model is trained from document labels through that formula, and the sentences with a high
probability of their own are the offending ones.

Sentences that are not offending by themselves count for as many as a usual document has at most, so that length
alone makes no document toxic; each offending one counts in full, whatever the length.

The model is fitted on the driver from a sample of labelled documents of bounded size (``SAMPLE``), of long ones from
an excerpt; scoring reads every document whole.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from likerec.llm.common import tidy, with_arrow_columns

# Labelled documents that the model is fitted on, at most, of each label; of longer ones sentences of this size in all.
SAMPLE = {0: 3000, 1: 1500}
SAMPLE_CHARS = 20_000
# The share of fitted documents that have at most the usual number of sentences.
USUAL_SHARE = 0.9
EPOCHS = 200
STEP = 4.0
MOMENTUM = 0.9
PENALTY = 1e-4
FIRST_BIAS = -4.0
# The least G statistic of a feature's presence in toxic and in other documents; chance alone reaches it once in 10,000.
LEAST_G = 15.0
PREFIXES = (4, 5, 6)
SENTENCE_WORDS = 60
OFFENDING = 0.5
LEAST_LOGIT = math.log(OFFENDING / (1 - OFFENDING))

SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
EDGES = ".,;:!?\"'()[]{}<>*_-"


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans of sentences; one without end is cut after ``SENTENCE_WORDS`` words."""
    spans, start = [], 0
    ends = [(m.start(), m.end()) for m in SENTENCE.finditer(text)] + [(len(text), len(text))]
    for end, following in ends:
        if text[start:end].strip():
            if end - start < 4 * SENTENCE_WORDS or text.count(" ", start, end) < SENTENCE_WORDS:
                spans.append((start, end))
            else:
                words = [m.start() for m in re.finditer(r"\S+", text[start:end])]
                cuts = [start + w for w in words[::SENTENCE_WORDS]] + [end]
                spans.extend(zip(cuts, cuts[1:]))
        start = following
    return spans


def word_features(word: str) -> list[str]:
    """A word and its beginnings, so that inflected and compound forms share some."""
    word = word.lower().strip(EDGES)
    return [word, *[f"{word[:n]}*" for n in PREFIXES if len(word) > n]] if word else []


@dataclass
class SentenceModel:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -math.inf
    usual: float = math.inf

    def sentence_logits(self, text: str, known: dict[str, float]) -> tuple[list[tuple[int, int]], list[float]]:
        """``known`` keeps the weights of words between calls."""
        spans = sentences(text)
        logits = []
        for start, end in spans:
            total = self.bias
            for word in text[start:end].split():
                value = known.get(word)
                if value is None:
                    value = sum(self.weights.get(f, 0.0) for f in word_features(word))
                    if len(known) < 500_000:
                        known[word] = value
                total += value
            logits.append(total)
        return spans, logits


def _softplus(z):
    return np.logaddexp(0.0, z)


def _shares(z: np.ndarray, document_of: np.ndarray, documents: int, usual: float) -> np.ndarray:
    """How much each sentence counts: those that are not offending, together, as ``usual`` ones at most."""
    weak = z < LEAST_LOGIT
    n_weak = np.bincount(document_of, weak, minlength=documents)
    return np.where(weak, np.minimum(1.0, usual / np.maximum(n_weak, 1.0))[document_of], 1.0)


def noisy_or(logits: list[float], usual: float = math.inf) -> float:
    if not logits:
        return 0.0
    z = np.array(logits)
    return float(-np.expm1(-(_shares(z, np.zeros(len(z), np.int64), 1, usual) * _softplus(z)).sum()))


def excerpt(text: str) -> str:
    """A text of at most ``SAMPLE_CHARS`` code points whole; of a longer one sentences from all over it, by a hash."""
    if len(text) <= SAMPLE_CHARS:
        return text
    chosen, left = [], SAMPLE_CHARS
    for start, end in sorted(sentences(text), key=lambda span: zlib.crc32(b"%d" % span[0])):
        if left <= 0:
            break
        chosen.append((start, min(end, start + left)))
        left -= end - start + 1
    return "\n".join(text[a:b] for a, b in sorted(chosen))


def _excerpt_rows(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in source:
        made = [excerpt(text.as_py()) for text in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made, pa.string()), batch.column("toxic")], names=["doc_id", "text", "toxic"])


def _dependence(toxic: np.ndarray, other: np.ndarray, all_toxic: float, all_other: float) -> np.ndarray:
    """The G statistic of two by two counts of documents, for each feature."""
    share = (toxic + other) / (all_toxic + all_other)
    total = np.zeros(len(toxic))
    for seen, expected in ((toxic, all_toxic * share), (other, all_other * share),
                           (all_toxic - toxic, all_toxic * (1 - share)), (all_other - other, all_other * (1 - share))):
        with np.errstate(divide="ignore", invalid="ignore"):
            total += np.where(seen > 0, 2 * seen * np.log(seen / expected), 0.0)
    return total


def fit(texts: list[str], labels: list[int]) -> SentenceModel:
    """Fits sentence weights to document labels. With one label only the model scores everything 0 or 1."""
    if not any(labels) or all(labels):
        return SentenceModel({}, math.inf if labels and all(labels) else -math.inf)
    index: dict[str, int] = {}
    features, sentence_of, document_of = array("i"), array("i"), array("i")
    for number, text in enumerate(texts):
        for start, end in sentences(text):
            for word in text[start:end].split():
                for feature in word_features(word):
                    features.append(index.setdefault(feature, len(index)))
                    sentence_of.append(len(document_of))
            document_of.append(number)
    features, sentence_of, document_of = (np.frombuffer(x, np.int32) for x in (features, sentence_of, document_of))
    y = np.array(labels, np.float64)
    usual = max(1.0, float(np.quantile(np.bincount(document_of, minlength=len(y)), USUAL_SHARE)))

    # Keep features whose presence depends on the label.
    pairs = np.unique(features.astype(np.int64) * len(texts) + document_of[sentence_of])
    toxic = np.bincount(pairs // len(texts), y[pairs % len(texts)], minlength=len(index))
    kept = _dependence(toxic, np.bincount(pairs // len(texts), minlength=len(index)) - toxic, y.sum(), len(y) - y.sum()) >= LEAST_G
    number = np.cumsum(kept) - 1
    chosen = kept[features]
    features, sentence_of = number[features[chosen]], sentence_of[chosen]
    names = [name for name, at in index.items() if kept[at]]

    w, bias = np.zeros(len(names)), FIRST_BIAS
    moved, bias_moved = np.zeros(len(names)), 0.0
    for _ in range(EPOCHS):
        z = bias + np.bincount(sentence_of, w[features], minlength=len(document_of))
        share = _shares(z, document_of, len(y), usual)
        total = np.bincount(document_of, share * _softplus(z), minlength=len(y))
        by_total = np.where(y > 0, -1 / np.expm1(np.clip(total, 1e-2, 500)), 1.0) / len(y)
        by_z = by_total[document_of] * share / (1 + np.exp(-np.clip(z, -50, 50)))
        moved = MOMENTUM * moved - STEP * (np.bincount(features, by_z[sentence_of], minlength=len(w)) + PENALTY * w)
        bias_moved = MOMENTUM * bias_moved - 0.1 * STEP * by_z.sum()
        w += moved
        bias += bias_moved
    return SentenceModel(dict(zip(names, w.tolist())), float(bias), usual)


def fit_from_labels(docs: DataFrame, labels: DataFrame, sample: dict[int, int] | None = None) -> SentenceModel:
    """The model of a bounded sample of labelled documents, by the order of a hash of their ids; not of held-out ones.

    An excerpt of a clean document is clean, one of a toxic document may lack what is toxic. So clean documents are
    drawn whatever their length, toxic ones that are too long to be read whole only where there are not enough others.
    """
    sample = SAMPLE if sample is None else sample
    docs = tidy(docs, ["doc_id", "text"], []).select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    usable = (
        tidy(labels, ["doc_id", "toxic"], []).where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .join(docs.groupBy("doc_id").agg(F.max(F.length("text") > SAMPLE_CHARS).alias("long")), "doc_id")
    )
    order = [F.col("long") & (F.col("toxic") == 1), F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = None
    for label, size in sample.items():
        part = usable.where(F.col("toxic") == label).orderBy(*order).limit(size).drop("long")
        chosen = part if chosen is None else chosen.unionByName(part)
    # At most sum(sample) ids.
    rows = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic")
    rows = rows.mapInArrow(_excerpt_rows, rows.schema).groupBy("doc_id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic")).collect()
    rows.sort(key=lambda row: row["doc_id"])
    return fit([row["text"] for row in rows], [row["toxic"] for row in rows])


def score_toxicity(docs: DataFrame, model: SentenceModel) -> DataFrame:
    """``docs`` with ``score`` (noisy-or of all sentences, 0 to 1) and ``offending``: the spans (start, end in code
    points, probability) of sentences that are likely toxic by themselves.

    Null and empty texts have no sentences and score 0. Columns named like an output are replaced; an empty table
    gives an empty result.
    """
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("probability", T.DoubleType())])
    outputs = [T.StructField("score", T.DoubleType()), T.StructField("offending", T.ArrayType(span))]
    docs = tidy(docs, ["text"], [f.name for f in outputs])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))
    known: dict[str, float] = {}

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        scores, spans = [], []
        for text in batch.column("text"):
            at, logits = shared.value.sentence_logits(text.as_py() or "", known)
            scores.append(noisy_or(logits, shared.value.usual))
            spans.append([{"start": s, "end": e, "probability": 1 / (1 + math.exp(-min(z, 500)))}
                          for (s, e), z in zip(at, logits) if z >= LEAST_LOGIT])
        return [pa.array(scores, pa.float64()), pa.array(spans, arrow)]

    return with_arrow_columns(docs.withColumn("text", F.col("text").cast("string")), outputs, compute)
