"""Registered queries of streams: the events as records of a topic, read from files until none are left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import new_path
from ..streaming import streams
from .queries import add, query, t

RECORDS = "key binary, value binary, topic string, partition int, offset long, part int"
SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("user", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("v", T.DoubleType())])


def records(spark, sf) -> DataFrame:
    """A record an event: each 20th isn't JSON, each 20th after it has no value, each 10th comes twice."""
    e = t(spark, sf, "events")
    text = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("user_id").alias("user"), F.col("event_type").alias("kind"), F.col("value").alias("v")))
    value = F.when(F.col("event_id") % 20 == 0, F.concat(F.lit("{broken "), "event_id")).when(F.col("event_id") % 20 != 1, text)
    of = F.col("event_id").cast("string").cast("binary")
    once = e.select(of.alias("key"), value.cast("binary").alias("value"), F.lit("events").alias("topic"), (F.col("user_id") % 3).cast("int").alias("partition"), F.col("event_id").alias("offset"), (F.col("event_id") % 4).cast("int").alias("part"))
    return once.union(once.where("offset % 10 = 0"))


GOOD = "(SELECT event_id AS id, user_id AS \"user\", event_type AS kind, value AS v FROM events WHERE event_id % 20 NOT IN (0, 1))"
PUBLISH = [{"name": "in", "type": "stream_consume"}, {"name": "high", "type": "filter", "input": "in", "column": "v", "operator": "gte", "value": 20}, {"name": "out", "type": "stream_publish", "input": "high", "topic": "high-values", "key_column": "id"}]
CHECKED = [{"name": "in", "type": "stream_consume"}, {"name": "ok", "type": "validate", "input": "in", "rules": [{"check": "in_values", "column": "part", "values": [0, 1, 2]}]}]


def consumed(spark, sf, steps: list[dict], schema: T.StructType, source: DataFrame, files: int | None = None):
    """source written as files and read as a stream to its end; (results, dead letters, statistics). A batch's output is named after it, so a repeated batch replaces its own."""
    base = new_path(spark, "stream")
    source.repartition(16, "part", F.col("offset") % 4).write.partitionBy("part").parquet(f"{base}/in")
    reader = spark.readStream.schema(RECORDS)
    stream = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(f"{base}/in")

    def sink(name: str):
        return lambda df, batch: df.write.mode("overwrite").parquet(f"{base}/{name}/batch={batch}")

    batches = streams.Batches(steps, schema, sink("good"), sink("dead"))
    running = streams.start(stream, batches, f"{base}/offsets", once=True)
    running.awaitTermination()
    return f"{base}/good", f"{base}/dead", batches.stats | {"input_rows": streams.stream_stats(running)["messages"]}


PUBLISHED = "key string, value string, topic string"
LETTERS = f"key binary, value binary, topic string, headers {streams.HEADERS}"


@query(f"SELECT id::VARCHAR AS key, 'high-values' AS topic, id, \"user\", kind, v FROM {GOOD} WHERE v >= 20")
def str6_steps_of_batches(spark, sf):
    """Consume, decode, drop repeats, filter, publish."""
    good, _, _ = consumed(spark, sf, PUBLISH, SCHEMA, records(spark, sf))
    return spark.read.schema(PUBLISHED).parquet(good).withColumn("r", F.from_json("value", SCHEMA)).select("key", "topic", "r.*")


@query("SELECT event_id::VARCHAR AS key, '{broken ' || event_id AS value, 'value is not a JSON object of the schema' AS error, 'events' AS original_topic, event_id AS original_offset, true AS dated FROM events WHERE event_id % 20 = 0")
def str7_dead_letters(spark, sf):
    """All of them: the limit of an inspection is the number of events."""
    _, dead, _ = consumed(spark, sf, PUBLISH, SCHEMA, records(spark, sf))
    letters = spark.read.schema(LETTERS).parquet(dead)
    return streams.inspect_dead_letters(letters, max(1, letters.count())).select("key", "value", "error", "original_topic", "original_offset", F.col("failed_at").isNotNull().alias("dated"))


WITH_PART = T.StructType([T.StructField("id", T.LongType()), T.StructField("part", T.IntegerType())])


def parted(spark, sf) -> DataFrame:
    text = F.to_json(F.struct(F.col("offset").alias("id"), "part")).cast("binary")
    return records(spark, sf).where("offset % 20 <> 1").withColumn("value", text)


@query("SELECT event_id AS id, CASE WHEN event_id % 4 = 3 THEN 'dead' ELSE 'good' END AS went FROM events WHERE event_id % 20 <> 1")
def str8_failed_batches(spark, sf):
    """A file is a batch, and files hold one part each: batches of part 3 break a rule and go to the dead letters whole, the others go on."""
    good, dead, _ = consumed(spark, sf, CHECKED, WITH_PART, parted(spark, sf), files=1)
    letters = spark.read.schema(LETTERS).parquet(dead).select(F.col("key").cast("string").cast("long").alias("id"), F.lit("dead").alias("went"))
    return spark.read.schema("id long, part int").parquet(good).select("id", F.lit("good").alias("went")).union(letters)


@query("""SELECT count(*) + count(*) FILTER (event_id % 10 = 0) AS input_rows, count(*) FILTER (event_id % 20 <> 1) AS messages, count(*) FILTER (event_id % 20 = 0) AS dead_letters, 0::BIGINT AS failed_batches, 1::BIGINT AS batches FROM events""")
def str11_statistics(spark, sf):
    _, _, stats = consumed(spark, sf, PUBLISH, SCHEMA, records(spark, sf))
    names = ["input_rows", "messages", "dead_letters", "failed_batches", "batches"]
    return spark.createDataFrame([tuple(stats[n] for n in names)], ", ".join(f"{n} long" for n in names))


@query("SELECT (user_id % 3)::INT AS \"partition\", event_id AS \"offset\", 1::BIGINT AS times FROM events")
def str5_repeats_across_batches(spark, sf):
    """Each record comes once and each fifth again, in another file: files are read in several micro-batches, so that repeats arrive in later ones."""
    e = t(spark, sf, "events")
    rows = e.select(F.lit("events").alias("topic"), (F.col("user_id") % 3).cast("int").alias("partition"), F.col("event_id").alias("offset"), F.col("ts").cast("timestamp").alias("timestamp"), (F.col("event_id") % 4).cast("int").alias("part"))
    base = new_path(spark, "stream")
    rows.union(rows.where("offset % 5 = 0").withColumn("part", F.col("part") + 4)).repartition(8, "part").write.partitionBy("part").parquet(f"{base}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{base}/in")
    once = streams.unrepeated(stream, delay="60 days")  # the table spans a month, and files come in any order
    running = once.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/offsets").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{base}/out").groupBy("partition", "offset").agg(F.count("*").alias("times"))


@query("SELECT count(DISTINCT event_id % 120) AS batches, count(*) AS messages, max(event_id % 120) - min(event_id % 120) + 1 - count(DISTINCT event_id % 120) AS lost FROM events")
def str11_long_run(spark, sf):
    """A file a batch, more than a hundred of them, all counted by the listener; lost: numbers that no report has."""
    e = t(spark, sf, "events").select("event_id", "user_id", (F.col("event_id") % 120).cast("int").alias("part"))
    base = new_path(spark, "stream")
    e.repartition(8, "part").write.partitionBy("part").parquet(f"{base}/in")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    with streams.ProgressLog(spark, f"{base}/log") as log:
        running = stream.writeStream.format("noop").option("checkpointLocation", f"{base}/offsets").trigger(availableNow=True).start()
        running.awaitTermination()
        log.finished(running.runId)
    one = log.table().where((F.col("run_id") == str(running.runId)) & (F.col("input_rows") > 0))
    return one.agg(F.count("*").alias("batches"), F.sum("input_rows").alias("messages"), (F.max("batch_id") - F.min("batch_id") + 1 - F.count_distinct("batch_id")).alias("lost"))


add("str4_decode_raw", lambda s, d: streams.decode(records(s, d), deserialize="text").select("offset", F.coalesce(F.get_json_object("data.raw", "$.kind"), "data.raw").alias("raw"), "error").distinct(), "SELECT event_id AS \"offset\", CASE WHEN event_id % 20 = 0 THEN '{broken ' || event_id ELSE event_type END AS raw, NULL::VARCHAR AS error FROM events WHERE event_id % 20 <> 1")
add("str5_offset_repeats", lambda s, d: records(s, d).dropDuplicates(["topic", "partition", "offset"]).select("topic", "partition", "offset"), "SELECT 'events' AS topic, (user_id % 3)::INT AS \"partition\", event_id AS \"offset\" FROM events")
add("str9_publish", lambda s, d: streams.publish_rows(t(s, d, "orders"), "orders", "o_orderkey").select("key", "topic", *[F.get_json_object("value", f"$.{c}").cast(k).alias(c) for c, k in t(s, d, "orders").dtypes if c != "o_orderdate"], F.to_timestamp(F.get_json_object("value", "$.o_orderdate")).alias("o_orderdate")),
    "SELECT o_orderkey::VARCHAR AS key, 'orders' AS topic, * FROM orders")
add("str14_replay", lambda s, d: streams.replay_dead_letters(streams.dead_letters(records(s, d).where("offset % 20 = 0").distinct(), "broken")).select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "topic"),
    "SELECT event_id::VARCHAR AS key, '{broken ' || event_id AS value, 'events' AS topic FROM events WHERE event_id % 20 = 0 ORDER BY topic, value LIMIT 100")
