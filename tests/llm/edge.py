"""Documents with everything that may go wrong, shared by the tests."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, key string, _llm_fp int, `TEXT` string, shard double, copy int"
CLASHING = (None, "x", 1, "y", 2.0, 3)


def word(rng: random.Random) -> str:
    return "".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 8)))


def prose(rng: random.Random, words: int) -> str:
    return " ".join(word(rng) for _ in range(words))


def texts(seed: int = 0) -> list[str | None]:
    """Null, empty, blank, short, repeated, near-equal, shared-line, non-ASCII and long texts."""
    rng = random.Random(seed)
    base = [prose(rng, 120) for _ in range(6)]
    near = [t.replace(t.split()[60], "changed", 1) for t in base[:3]]
    shared = "A Shared line, with CAPITALS"
    lined = [f"{prose(rng, 12)}\n  {shared.upper() if k % 2 else shared}\t\n{prose(rng, 9)}" for k in range(12)]
    return [
        None, "", " ", "\n\n", "one", "two words", "Ünï çödé 你好世界 \x1c\x85 ÄÖ ÄÖ", *base, *near, base[0], base[0], base[1],
        *lined, f"{prose(rng, 20)}\n" * 3, "a" * 3000, "ab " * 900, prose(rng, 6000), base[2] + " " + base[3], "  it's  \t x\n\n\ny's 12ab",
        "<|endoftext|> and <|endoftext|>", "　" * 700 + "x", "你好世界" * 700,
    ]


def rows(seed: int = 0, null_ids: bool = True) -> list[tuple]:
    made = [(k * 3 % 101, t, "en", f"s{k % 3}" if k % 5 else None, None, *CLASHING) for k, t in enumerate(texts(seed))]
    made += [made[8], made[8]]  # repeated rows
    return made + ([(None, "two words", None, None, None, *CLASHING), (None, None, None, None, None, *CLASHING)] if null_ids else [])


def documents(spark, seed: int = 0, null_ids: bool = True):
    return spark.createDataFrame(rows(seed, null_ids), SCHEMA.replace("`TEXT`", "other")).withColumnRenamed("other", "TEXT").repartition(3)


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
