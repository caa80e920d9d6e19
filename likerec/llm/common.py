"""What the operators of this package share: input columns, stored intermediates, Arrow helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from likerec.session import scratch_folder

# The blanks of [\x20\x09-\x0D], as bytes.
BLANKS = b" \t\n\x0b\x0c\r"


# What a Python worker is sent at a time, so that its memory stays bounded whatever the texts' lengths.
ARROW_SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 * 1024 * 1024),
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tidy(df: DataFrame, needed: list[str], outputs: list[str]) -> DataFrame:
    """``df`` without columns whose names clash, so that operators can name columns freely; sets the batch sizes.

    Columns in ``needed`` stay. Of the others, those go that have the name of an output, of a needed
    column in another case, of an earlier column, or of an internal one (``_llm...``).
    """
    for key, value in ARROW_SETTINGS.items():
        df.sparkSession.conf.set(key, value)
    missing = [name for name in needed if name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    taken = {name.lower() for name in [*needed, *outputs]}
    names, kept, found = [], [], set()
    for position, name in enumerate(df.columns):
        if name in needed and name not in found:
            found.add(name)
        elif name.lower() in taken or name.lower().startswith("_llm"):
            names.append(f"_llm_dropped_{position}")
            continue
        else:
            taken.add(name.lower())
        names.append(name)
        kept.append(name)
    return df.toDF(*names).select(*[f"`{name}`" for name in kept])


def stash(df: DataFrame, name: str) -> DataFrame:
    """Compute ``df`` once, as Parquet in the folder all executors share, and read it from there."""
    folder = scratch_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def with_arrow_columns(
    df: DataFrame, fields: list[T.StructField], compute: Callable[[pa.RecordBatch], list[pa.Array]], *drop: str
) -> DataFrame:
    """``df`` with the columns that ``compute`` makes of each Arrow batch, and without those in ``drop``."""
    kept = [f for f in df.schema.fields if f.name not in drop and f.name not in {x.name for x in fields}]
    names = [f.name for f in kept]

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            made = compute(batch)
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + made, names=names + [f.name for f in fields])

    return df.mapInArrow(batches, T.StructType(kept + fields))


def text_bytes(batch: pa.RecordBatch, column: str = "text") -> Iterator[bytes]:
    """The UTF-8 bytes of each text, nothing for null; one at a time, so that memory stays bounded."""
    for value in batch.column(column).cast(pa.large_binary()):
        yield value.as_py() or b""


def broadcast_bounded(df: DataFrame, row_bytes: int, limit_bytes: int = 64 * 1024 * 1024) -> DataFrame:
    """A broadcast hint if the counted rows allow it; else Spark joins by shuffling, splitting skewed keys.

    Only for a stored ``df``, whose rows are counted from its files.
    """
    return F.broadcast(df) if df.count() * row_bytes <= limit_bytes else df
