"""Users, songs and likes as Parquet folders that grow by batches, partitioned by a part of their key.

A batch writes folders of its own and reads only what earlier batches wrote. One that is run again after a failure
sees the same input, derives the same rows and overwrites the same folders. Lookups by key join the part as well, so
Spark prunes the scan to the parts that hold the keys (dynamic partition pruning). To compact, start new tables from
what the old ones hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from likerec.schema import LIKES, SONGS, USERS
from likerec.session import materialize

PARTS = 64

WRITES = T.StructType([
    T.StructField("request_id", T.LongType(), False),
    T.StructField("ts", T.TimestampNTZType(), False),
    T.StructField("user_id", T.StringType(), True),
    T.StructField("song_ids", T.ArrayType(T.LongType()), True),
])
# The largest ids that a batch left.
IDS = T.StructType([T.StructField("users", T.LongType()), T.StructField("songs", T.LongType())])

SCHEMAS = {"users": USERS, "songs": SONGS, "likes": LIKES, "writes": WRITES, "ids": IDS}
KEYS = {"users": "user_id", "songs": "video_id", "likes": "user_id", "writes": "user_id", "ids": "users"}
_FOLDERS = [T.StructField("part", T.IntegerType(), False), T.StructField("batch_id", T.LongType(), False)]


def _with_part(rows: DataFrame, key: str) -> DataFrame:
    return rows.withColumn("part", F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int"))


def put_batch(rows: DataFrame, folder: str, name: str, batch_id: int) -> None:
    """Write the rows of a batch, in place of those it wrote when it ran before."""
    placed = _with_part(rows.select(*SCHEMAS[name].names), KEYS[name]).withColumn("batch_id", F.lit(batch_id).cast("long"))
    placed.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "part", "batch_id").parquet(f"{folder}/{name}")


def _stored(spark: SparkSession, folder: str, name: str, before_batch: int | None) -> DataFrame:
    rows = spark.read.schema(T.StructType([*SCHEMAS[name].fields, *_FOLDERS])).parquet(f"{folder}/{name}")
    return rows if before_batch is None else rows.where(F.col("batch_id") < before_batch)


def read_table(spark: SparkSession, folder: str, name: str, before_batch: int | None = None) -> DataFrame:
    """All rows, or those of the batches before ``before_batch``."""
    return _stored(spark, folder, name, before_batch).select(*SCHEMAS[name].names)


def read_keys(spark: SparkSession, folder: str, name: str, keys: DataFrame, before_batch: int | None = None) -> DataFrame:
    """Rows whose key columns are in ``keys``, the table's key (of any name) first; only parts that hold such keys are read.

    The keys are stored first, so that their size is known: while they can be broadcast, as those of a batch can, stored
    rows are not shuffled.
    """
    columns = [KEYS[name], *keys.columns[1:]]
    wanted = _with_part(materialize(keys.toDF(*columns).distinct()), KEYS[name]).where(F.col("part") >= 0)
    return _stored(spark, folder, name, before_batch).join(wanted, ["part", *columns], "left_semi").select(*SCHEMAS[name].names)


def start_tables(folder: str, users: DataFrame, songs: DataFrame, likes: DataFrame) -> None:
    """Store the tables as they are before any batch, under batch -1."""
    spark = users.sparkSession
    last = users.agg(F.max("id").alias("users")).crossJoin(songs.agg(F.max("id").alias("songs")))  # one row each
    for name, rows in (("users", users), ("songs", songs), ("likes", likes), ("writes", spark.createDataFrame([], WRITES)), ("ids", last)):
        put_batch(rows, folder, name, -1)


def last_ids(spark: SparkSession, folder: str, before_batch: int) -> dict[str, DataFrame]:
    """The largest id of users and of songs, as tables of one row; read from a row per batch."""
    row = read_table(spark, folder, "ids", before_batch).agg(F.max("users").alias("users"), F.max("songs").alias("songs")).first()
    return {name: spark.createDataFrame([(row[name],)], "id long") for name in ("users", "songs")}
