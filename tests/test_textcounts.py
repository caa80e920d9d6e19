import random
from collections import Counter

import pyarrow as pa
import pytest

from likerec.operators import textvectors
from tests.conftest import rows


@pytest.mark.parametrize("size", [1, 2, 7, 100])
def test_documents_over_several_rows_and_batches(size):
    """Repeated and null ids, null and empty texts."""
    generator = random.Random(size)
    docs = [(d, [generator.choice("abcde") for _ in range(generator.randint(0, 6))] if generator.random() < 0.9 else None)
            for d in (None, 1, 2, 3, 4) for _ in range(generator.choice([1, 2, 9]))]
    whole = pa.record_batch([pa.array([d for d, _ in docs], pa.int64()), pa.array([t for _, t in docs], pa.list_(pa.string()))], names=["doc_id", "terms"])
    got = [r for b in textvectors._document_rows(iter([whole.slice(0, 0), *(whole.slice(i, size) for i in range(0, len(docs), size))]))
           for r in zip(*(c.to_pylist() for c in b.columns))]
    expected = Counter((d, t) for d, terms in docs for t in terms or [])
    assert len(got) == len(expected) and {(d, t): n for d, t, n in got} == expected


def test_document_terms_equal_counted_tokens_and_make_no_token_rows(spark):
    docs = spark.createDataFrame([(1, "The cat, the Cat sat"), (1, "cat dog"), (2, None), (None, "owl"), (None, "owl x"), (3, "")], "doc_id long, text string")
    found = textvectors.document_terms(docs)
    assert rows(found, "doc_id", "term", "tf") == rows(textvectors.term_counts(textvectors.tokenize(docs)), "doc_id", "term", "tf")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan
