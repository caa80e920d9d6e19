"""Users, songs, likes and requests derived from the shop tables used for checks and timing.

Every input row is used: customers and suppliers are users (suppliers like nothing), parts are
songs, ordered parts are likes, events are requests. Suppliers are also songs that can be searched
for but are not stored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


# Columns read from each table; giving them saves a job per table that would infer them.
TABLES = {
    "customer": "c_custkey long, c_name string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int",
    "orders": "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz",
    "lineitem": "l_orderkey long, l_partkey long, l_linenumber int",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, props string",
    "documents": "doc_id long, text string, lang string, source string",
}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}.parquet")


def _ntz(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def users(spark: SparkSession, folder: str) -> DataFrame:
    start = _ntz("2024-01-01 00:00:00")
    rest = (F.lit(None).cast("string").alias("email"), start.alias("created_at"), start.alias("updated_at"))
    customers = _table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("user_id"), F.col("c_name").alias("name"), *rest)
    suppliers = _table(spark, folder, "supplier").select(
        (-F.col("s_suppkey") - 1).alias("id"), F.col("s_name").alias("user_id"), F.col("s_name").alias("name"), *rest)
    return customers.unionByName(suppliers)


def songs(spark: SparkSession, folder: str) -> DataFrame:
    """Parts; small sizes have no genre, large ones no tags, and update times are tied."""
    size = F.col("p_size")
    minutes = F.make_dt_interval(F.lit(0), F.lit(0), (F.col("p_partkey") % 700).cast("int"))
    return _table(spark, folder, "part").select(
        F.col("p_partkey").alias("id"),
        F.concat(F.lit("v"), F.col("p_partkey").cast("string")).alias("video_id"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("artist"),
        F.when(size > 10, F.col("p_type")).alias("genre"),
        F.when(size <= 33, F.concat(F.lit("size"), size.cast("string"), F.lit(", "), F.lower("p_type"))).alias("tags"),
        (_ntz("2024-01-01 00:00:00") + minutes).alias("updated_at"),
    )


def likes(spark: SparkSession, folder: str) -> DataFrame:
    """One row per customer and ordered part, at the first order."""
    return line_likes(spark, folder).groupBy("user_id", "song_id").agg(F.min("created_at").alias("created_at"))


def requests(spark: SparkSession, folder: str, events: DataFrame | None = None) -> DataFrame:
    """One request per event, from the stored events or from a given (streaming) frame.

    Views hold a noisy and a clean spelling, clicks a bare title, sign-ups come from unknown
    users and name a song that is not stored, errors have nothing to search for and may have an overlong user id, purchases repeat
    a name 0 to 99 times and may have an overlong genre.
    """
    kind, k = F.col("event_type"), F.col("k")
    full = F.concat(F.col("p_name"), F.lit(" - "), F.col("p_brand"))
    customer = F.concat(F.lit("Customer#"), F.lpad(F.col("user_id").cast("string"), 9, "0"))
    guest = F.concat(F.lit("Guest#"), F.col("user_id").cast("string"))
    visitor = F.expr("repeat(concat('Visitor#', cast(user_id AS string), ' '), k)")
    names = (
        F.when(kind == "view", F.array(F.concat(F.lit("  "), F.upper(full), F.lit("!")), full))
        .when(kind == "click", F.array(F.col("p_name"), full))
        .when(kind == "signup", F.array(full, F.lit("No Such Song"), F.col("s_name")))
        .when(kind == "error", F.array(F.lit("???"), F.lit("")))
        .otherwise(F.array_repeat(full, k))
    )
    genre = (
        F.when(kind == "click", F.lower("p_type"))
        .when(kind == "signup", F.lit(None).cast("string"))
        .when(kind == "purchase", F.expr("repeat(p_type, k)"))
        .otherwise(F.col("p_type"))
    )
    events = _table(spark, folder, "events") if events is None else events
    events = events.withColumn("k", F.regexp_extract("props", "[0-9]+", 0).cast("int"))
    parts = _table(spark, folder, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    suppliers = _table(spark, folder, "supplier").select("s_suppkey", "s_name")
    named = events.join(parts, F.col("p_partkey") == _part_of(parts.count())).join(
        suppliers, F.col("s_suppkey") == F.pmod(F.col("event_id"), F.lit(suppliers.count())))
    return named.select(
        F.col("event_id").alias("request_id"),
        "ts",
        F.when(kind == "signup", guest).when(kind == "error", visitor).otherwise(customer).alias("user_id"),
        names.alias("songs"),
        genre.alias("genre"),
    )


def stream_events(spark: SparkSession, folder: str) -> DataFrame:
    """The events as a file stream; all tables share one folder, hence the name filter."""
    return spark.readStream.schema(TABLES["events"]).option("pathGlobFilter", "events.parquet").parquet(folder)


def catalog(spark: SparkSession, folder: str) -> DataFrame:
    """What searches find: the stored songs, and one song per supplier that is not stored."""
    known = songs(spark, folder)
    others = _table(spark, folder, "supplier").select(
        (-F.col("s_suppkey") - 1).alias("id"),
        F.concat(F.lit("x"), F.col("s_suppkey").cast("string")).alias("video_id"),
        F.col("s_name").alias("title"),
        F.concat(F.lit("nation"), F.col("s_nationkey").cast("string")).alias("artist"),
    )
    return known.unionByName(others, allowMissingColumns=True)


def misspelled(items: DataFrame) -> DataFrame:
    """Requested songs whose name lacks the character at a place that the request and the position decide."""
    name = F.col("song_name")
    gone = F.pmod(F.col("request_id") * 7 + F.col("position"), F.greatest(F.length(name), F.lit(1))).cast("int")
    return items.withColumn("song_name", F.concat(F.substr(name, F.lit(1), gone), F.substr(name, gone + 2)))


def event_likes(spark: SparkSession, folder: str) -> DataFrame:
    """Every event as a like of a part by its user."""
    events = _table(spark, folder, "events")
    parts = _table(spark, folder, "part").count()
    return events.select("user_id", _part_of(parts).alias("song_id"), F.col("ts").alias("created_at"))


def _part_of(parts: int) -> Column:
    """The part an event is about, spread over all parts."""
    return F.pmod(F.col("event_id") * 7919, F.lit(parts))


def line_likes(spark: SparkSession, folder: str) -> DataFrame:
    """Every ordered line as a (user_id, song_id, created_at) row, with repeats."""
    lines = _table(spark, folder, "lineitem").select("l_orderkey", "l_partkey")
    orders = _table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("song_id"), F.col("o_orderdate").alias("created_at"))


def responses(songs: DataFrame) -> DataFrame:
    """A stored search response per song: empty where the song has no tags, led by an item
    without a video id where it has no genre."""
    def item(video_id: Column, title: Column) -> Column:
        return F.struct(F.struct(video_id.alias("videoId")).alias("id"),
                        F.struct(title.alias("title"), F.col("artist").alias("channelTitle")).alias("snippet"))

    found = item(F.col("video_id"), F.col("title"))
    channel = item(F.lit(None).cast("string"), F.col("artist"))
    items = F.when(F.col("genre").isNull(), F.array(channel, found)).otherwise(F.array(found, channel))
    items = F.when(F.col("tags").isNull(), F.slice(items, 1, 0)).otherwise(items)
    return songs.select(F.col("id").alias("response_id"), F.to_json(F.struct(items.alias("items"))).alias("body"))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "documents").select("doc_id", "text")


def event_times(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "events").select("event_id", "ts")


def untidy_users(spark: SparkSession, folder: str) -> DataFrame:
    """Requests read as user rows: repeated, empty and overlong ids, overlong names."""
    return requests(spark, folder).select(
        F.col("request_id").alias("id"), "user_id", F.col("genre").alias("name"),
        F.lit(None).cast("string").alias("email"), F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"))


def untidy_songs(spark: SparkSession, folder: str) -> DataFrame:
    """Documents read as song rows: repeated video ids and overlong titles."""
    return _table(spark, folder, "documents").select(
        F.col("doc_id").alias("id"), F.col("source").alias("video_id"), F.col("text").alias("title"),
        F.col("lang").alias("artist"), F.lit(None).cast("string").alias("genre"), F.col("text").alias("tags"),
        _ntz("2024-01-01 00:00:00").alias("updated_at"))


def untidy_likes(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines read as likes of orders: repeated pairs, null songs, and keys without a row."""
    lines = _table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    orders = _table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return orders.join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left").select(
        F.col("o_orderkey").alias("user_id"),
        F.when(F.coalesce("l_linenumber", F.lit(0)) <= 6, F.col("o_custkey")).alias("song_id"),
        F.when(F.col("l_partkey").isNotNull(), F.col("o_orderdate")).alias("created_at"))
