"""The corpus pipeline: each stage on what its predecessor kept, against the operators' plain rules."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest

import corpus_pipeline
from tests.llm import edge
from tests.llm.test_dedup import plain_firsts, plain_lines
from tests.llm.test_mixing_sharding import plain_copies, plain_rates
from tests.llm.test_quality import labelled

COLUMNS = corpus_pipeline.COLUMNS


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Labelled prose, some of it toxic, and the edge cases, as tables of one folder."""
    docs, labels = labelled(3, 500)
    rng = random.Random(1)
    rows = [(1000 + k, t, "en", rng.choice(["s0", "s1", None]), None) for k, t in docs]
    rows += [(r[0], r[1], *r[2:5]) for r in edge.rows(11)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1000 + k, t) for k, t in labels], "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, {1000 + k for k, t in labels if t}


@pytest.fixture(scope="module")
def stages(spark, folder, tmp_path_factory):
    """The rows of documents and of each stage, each stage reading what the one before wrote."""
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, tables[-1], folder[0]).write.parquet(out)
        tables.append(spark.read.parquet(out))
    return tables


def rows(table, *columns):
    return [tuple(r) for r in table.select(*columns or COLUMNS).collect()]


def test_toxic_documents_go_and_clean_ones_stay(stages, folder):
    before, after = Counter(rows(stages[0])), Counter(rows(stages[1]))
    assert not after - before
    gone = {r[0] for r in (before - after)}
    assert len(gone & folder[1]) > 0.85 * len(folder[1])
    assert len(gone - folder[1]) <= 3


def test_shared_lines_go(stages):
    before = rows(stages[1])
    want = Counter((key[0], key[3]) for key, n in plain_lines(before, 10).items() for _ in range(n))
    after = rows(stages[2])
    assert Counter((r[0], r[1]) for r in after) == want
    assert all(r[4] == len(r[1]) for r in after)


def test_one_of_each_group_stays(stages):
    before, after = rows(stages[2]), rows(stages[3])
    assert not Counter(after) - Counter(before)
    assert Counter(r[0] for r in after) == plain_firsts(before)


def test_sources_are_mixed(stages):
    before = rows(stages[3])
    rates = plain_rates(before)
    want = Counter()
    for r in before:
        want[r] += plain_copies(r[0], rates[r[3]], 20)
    assert Counter(rows(stages[4])) == +want


def test_texts_are_encoded(stages):
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("r", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for r in rows(stages[4]):
        ids = library.encode_ordinary(r[1])
        want[(r[0], len(ids), b"".join(i.to_bytes(4, "little") for i in ids), hashlib.sha256(r[1].encode()).hexdigest())] += 1
    got = rows(stages[5], "doc_id", "n_tokens", "ids", "decoded_sha256")
    assert Counter((a, b, bytes(c), d) for a, b, c, d in got) == want


def test_run_gives_the_last_stage(spark, stages, folder):
    columns = ["doc_id", "n_tokens", "decoded_sha256"]
    assert Counter(rows(corpus_pipeline.run(spark, folder[0]), *columns)) == Counter(rows(stages[-1], *columns))
