"""Text expressions: search normalization, song feature text, tokens."""

from __future__ import annotations

from functools import lru_cache
from pathlib import Path

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Character classes.
WORD = r"\p{L}\p{N}_"
BLANK = (r"\t-\r\x{1c}-\x{1f} \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
         r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")
# The same blanks as characters.
BLANK_CHARACTERS = "".join(map(chr, [*range(0x09, 0x0e), *range(0x1c, 0x21), 0x85, 0xa0, 0x1680,
                                     *range(0x2000, 0x200b), 0x2028, 0x2029, 0x202f, 0x205f, 0x3000]))
MAX_QUERY_LENGTH = 200
ARTIST_REPEATS = 2
GENRE_REPEATS = 3


def normalize_query(name: Column, min_length: int = 0) -> Column:
    """Search form of a song name, or null when nothing is left to search for.

    Drops characters other than word characters, blanks, ``-`` and ``'``; lower-cases; trims;
    cuts to 200 characters. The cut comes last, so a trailing blank may reappear.
    """
    kept = F.regexp_replace(name, f"[^{WORD}{BLANK}\\-']", "")
    trimmed = F.trim(F.lower(kept), F.lit(BLANK_CHARACTERS))
    query = F.substring(trimmed, 1, MAX_QUERY_LENGTH)
    return F.when(F.length(query) >= max(min_length, 1), query)


def feature_text(title: Column, artist: Column, genre: Column, tags: Column, mode: str = "as_coded") -> Column:
    """The text a song is compared by.

    ``as_coded`` repeats the artist twice and the genre three times without a blank between,
    so ``Queen`` gives the single new token ``queenqueen``. ``weighted`` repeats them as
    separate words, which is what raises their weight.
    """
    def filled(text: Column) -> Column:
        return F.coalesce(text, F.lit(""))

    if mode == "as_coded":
        artist, genre = F.repeat(filled(artist), ARTIST_REPEATS), F.repeat(filled(genre), GENRE_REPEATS)
    elif mode == "weighted":
        artist = F.array_join(F.array_repeat(filled(artist), ARTIST_REPEATS), " ")
        genre = F.array_join(F.array_repeat(filled(genre), GENRE_REPEATS), " ")
    else:
        raise ValueError(f"unknown mode: {mode}")
    return F.concat_ws(" ", filled(title), artist, genre, filled(tags))


def tokens(text: Column) -> Column:
    """Lower-cased runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"[{WORD}]{{2,}}"), 0)


@lru_cache(maxsize=None)
def default_stop_words() -> tuple[str, ...]:
    """The English stop words of ``stop_words.txt`` beside this module; needs no session."""
    lines = Path(__file__).with_name("stop_words.txt").read_text(encoding="utf-8").splitlines()
    return tuple(word for word in lines if word and not word.startswith("#"))


def read_stop_words(spark: SparkSession, path: str) -> tuple[str, ...]:
    """A stop-word list kept as text, one word per line; a short list by nature."""
    return tuple(row[0] for row in spark.read.text(path).select(F.lower(F.trim("value"))).collect() if row[0])
