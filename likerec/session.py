"""Session settings and the few physical-plan helpers the operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Runtime settings every job relies on; they can be set on a session that already runs.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Joins are broadcast by the size of stored files and of finished shuffles; larger ones shuffle. Files count as they lie
    # on disk, where repeated values take next to nothing, and not what an explode makes of them, so theirs is the lower limit.
    # A hash table takes some three times its rows, and twenty times a file of similar names, all of it in the driver too.
    "spark.sql.autoBroadcastJoinThreshold": str(256 * 1024),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(4 * 1024 * 1024),
    # Shuffles start with many partitions, which are then merged by size, so that a task's part does not grow with the input.
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "1024",
    # What a Python worker is sent at a time, as rows may hold long lists.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 * 1024 * 1024),
}

# Whether a shuffle's files go when its query has ended.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# Largest table that may be shipped to every executor.
BROADCAST_LIMIT_BYTES = 8 * 1024 * 1024

MAX_PARTITIONS = 50_000


def build_session(app_name: str = "likerec", master: str | None = None, **settings: str) -> SparkSession:
    """A session with the settings above; ``settings`` use ``_`` for ``.`` in their names."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in RUNTIME_SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in settings.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session made elsewhere."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        context.setCheckpointDir(configured)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="likerec-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared checkpoint folder."""
    _ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and keep it as Parquet in the shared folder.

    Used where a result feeds several branches of one job: the stored files survive the loss of
    executors, later scans read only the columns they need, and joins know their size. Files of the shuffles that made them
    go when they are written; of other actions, which may still read theirs, none are removed.
    """
    spark = df.sparkSession
    folder = scratch_folder(spark, "rows")
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(folder)
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(folder)


def broadcast_rows(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast of a table of numbers whose row count is already known."""
    if any(isinstance(f.dataType, (T.StringType, T.ArrayType)) for f in df.schema.fields):
        raise ValueError("only for columns of fixed width")
    return F.broadcast(df) if rows * 16 * len(df.columns) <= BROADCAST_LIMIT_BYTES else df


def fits_broadcast(df: DataFrame) -> bool:
    """Whether the rows of a stored table of numbers and texts, not its files, are small enough for a broadcast; counts them."""
    width = F.lit(16 * len(df.columns))
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            raise ValueError("only for numbers and texts")
        if isinstance(f.dataType, T.StringType):
            width = width + F.coalesce(F.octet_length(f.name), F.lit(0))
    return (df.agg(F.sum(width).alias("bytes")).first()["bytes"] or 0) <= BROADCAST_LIMIT_BYTES


def broadcast_stored(df: DataFrame) -> DataFrame:
    """Hint a broadcast of a stored table of numbers and texts if it fits; counts it first."""
    return F.broadcast(df) if fits_broadcast(df) else df


def shuffle_width(spark: SparkSession, rows: int = 0, rows_per_task: int = 2_000_000) -> int:
    """Number of partitions for an explicit repartition that will produce ``rows`` rows: a
    multiple of the session's shuffle partitions, so that no wave of tasks is half empty, and
    no more than a driver can keep track of."""
    base = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return base * max(1, min(-(-rows // (rows_per_task * base)), MAX_PARTITIONS // base))


def with_new_ids(new_rows: DataFrame, existing: DataFrame, key: str, id_column: str = "id") -> DataFrame:
    """Number ``new_rows`` densely after the largest existing id, in the order of ``key``.

    ``key`` must be unique. Rows are range-partitioned and sorted by it, each task numbers its
    own rows, and only one count per task is gathered to turn these into global numbers; a
    global ``row_number`` would send every row to a single task.
    """
    spark = new_rows.sparkSession
    numbered = materialize(
        new_rows.repartitionByRange(key)
        .sortWithinPartitions(key)
        .withColumn("_position", F.monotonically_increasing_id())
    )
    task_of = F.shiftright("_position", 33)
    counts = numbered.groupBy(task_of.alias("task")).count().collect()  # one row per task
    start = existing.agg(F.coalesce(F.max(id_column), F.lit(0)).alias("m")).first()["m"]
    offsets, total = [], start
    for row in sorted(counts, key=lambda r: r["task"]):
        offsets.append((row["task"], total))
        total += row["count"]
    offset_table = spark.createDataFrame(offsets, "_task long, _offset long")
    row_in_task = F.col("_position").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        numbered.withColumn("_task", task_of)
        .join(F.broadcast(offset_table), "_task")
        .withColumn(id_column, F.col("_offset") + row_in_task + 1)
        .drop("_position", "_task", "_offset")
    )
