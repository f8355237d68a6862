"""Micro-batches of Kafka records through pipeline steps, with a dead-letter queue."""

from __future__ import annotations

import json
import re
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener

from ..functions.arguments import StepError, need_columns
from ..plans.pipeline import run

#: Records of a micro-batch at most, and failed batches in a row after which the stream stops.
BATCH_CAP, FAILURES = 50_000, 50
HEADERS = "array<struct<key: string, value: binary>>"


def topic_name(name: str) -> str:
    """The name, if it is 1 to 249 of a-z A-Z 0-9 . _ - and doesn't begin with _."""
    if not re.fullmatch(r"(?!_)[a-zA-Z0-9._-]{1,249}", name or ""):
        raise StepError(f"topic name {name!r} isn't valid")
    return name


def consume(spark: SparkSession, servers: str, topic: str, consumer_group: str | None = None, batch_size: int = 1000, start: str = "latest", **options) -> DataFrame:
    """A stream of the topic's records with headers; offsets are kept in the query's checkpoint. Needs Spark's Kafka connector."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic_name(topic))
    reader = reader.option("startingOffsets", start).option("maxOffsetsPerTrigger", min(batch_size, BATCH_CAP)).option("includeHeaders", "true")
    reader = reader.option("kafka.group.id", consumer_group) if consumer_group else reader
    return reader.options(**options).load()


def unrepeated(records: DataFrame, time: str = "timestamp", delay: str = "1 hour", key: tuple = ("topic", "partition", "offset")) -> DataFrame:
    """A stream of records without repeats of a key, also where a repeat comes in a later micro-batch or after a restart.

    Keys are kept in Spark's state store until the watermark (the latest time seen, less delay) has passed them, so the state is bounded by what arrives
    within the delay. Records that are later than the watermark are dropped, as they could be repeats: delay must be what records can be late. A null time never expires its key.
    """
    return records.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(key))


def decode(records: DataFrame, schema: T.StructType | None = None, deserialize: str = "json") -> DataFrame:
    """records with ``data`` (a struct by schema; for other formats than json: its text as raw) and ``error`` for what couldn't be read.

    Records without a value are left out. Repeats of (topic, partition, offset) within a batch are dropped.
    """
    rows = records.where(F.col("value").isNotNull())
    text = F.make_valid_utf8(F.col("value").cast("string"))
    if deserialize != "json":
        return rows.withColumn("data", F.struct(text.alias("raw"))).withColumn("error", F.lit(None).cast("string"))
    if schema is None:
        raise StepError("decode: json needs a schema")
    marked = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    rows = rows.withColumn("__all", F.from_json(text, marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("__all").isNull() | F.col("__all._bad").isNotNull() | ~F.trim(text).startswith("{")
    data = F.struct(*[F.col(f"__all.`{f.name}`").alias(f.name) for f in schema.fields])
    return rows.withColumn("error", F.when(bad, F.lit("value is not a JSON object of the schema"))).withColumn("data", F.when(F.col("error").isNull(), data)).drop("__all")


def dead_letters(records: DataFrame, error) -> DataFrame:
    """Records for the topic's dead-letter queue: key, value, topic {topic}.dlq, headers x-error (500 characters), x-original-topic, x-failed-at, x-original-offset."""
    text = F.substring(error if not isinstance(error, str) else F.lit(error), 1, 500)
    header = lambda k, v: F.struct(F.lit(k).alias("key"), v.cast("string").cast("binary").alias("value"))
    headers = F.array(header("x-error", text), header("x-original-topic", F.col("topic")), header("x-failed-at", F.current_timestamp()), header("x-original-offset", F.col("offset")))
    return records.select("key", "value", F.concat("topic", F.lit(".dlq")).alias("topic"), headers.alias("headers"))


def publish_rows(df: DataFrame, topic: str, key_column: str | None = None) -> DataFrame:
    """key (text), value (the row as JSON) and topic, as the Kafka sink takes them."""
    if key_column:
        need_columns(df, [key_column], "stream_publish")
    key = F.col(f"`{key_column}`").cast("string") if key_column else F.lit(None).cast("string")
    return df.select(key.alias("key"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"), F.lit(topic_name(topic)).alias("topic"))


def kafka_writer(servers: str) -> Callable[[DataFrame, int], None]:
    return lambda df, batch: df.write.format("kafka").option("kafka.bootstrap.servers", servers).option("includeHeaders", "true").save()


class Batches:
    """What foreachBatch calls: decode, run the steps, write the results and the dead letters, count.

    steps: a step list whose first step is the consume step; the rows of a batch are that step's output. A batch on which the steps fail goes
    to the dead letters whole and the stream goes on, until FAILURES fail in a row. A failing sink fails the batch, which Spark then repeats from the checkpoint.
    """

    def __init__(self, steps: list[dict], schema: T.StructType | None, sink: Callable[[DataFrame, int], None], dead: Callable[[DataFrame, int], None], tables: dict[str, DataFrame] | None = None):
        self.first, self.steps = steps[0], steps[1:]
        self.schema, self.sink, self.dead, self.tables = schema, sink, dead, tables or {}
        self.stats = {"batches": 0, "messages": 0, "failed_batches": 0, "dead_letters": 0}
        self.in_a_row = 0

    def __call__(self, records: DataFrame, batch: int) -> None:
        records = records.dropDuplicates(["topic", "partition", "offset"]).persist()
        try:
            rows = decode(records, self.schema, self.first.get("deserialize", "json")).persist()
            bad = rows.where("error is not null")
            n, n_bad = rows.agg(F.count("*"), F.count("error")).first()
            if n_bad:
                self.dead(dead_letters(bad, F.col("error")), batch)
            self.stats["messages"] += n
            self.stats["dead_letters"] += n_bad
            publish = self.steps[-1] if self.steps and self.steps[-1]["type"] == "stream_publish" else None
            try:
                load = {"name": self.first["name"], "type": "load", "table": "__batch"}
                made = run([load, *(self.steps[:-1] if publish else self.steps)], {**self.tables, "__batch": rows.where("error is null").select("data.*")})
                out = next(reversed(made.values())).frame if not publish else made[publish["input"]].frame
                out = (publish_rows(out, publish["topic"], publish.get("key_column")) if publish else out).persist()
                out.count()  # the steps' own failures show here, before anything is written
                self.in_a_row = 0
            except Exception as e:  # noqa: BLE001  a batch that fails is set aside
                self.in_a_row += 1
                self.stats["failed_batches"] += 1
                self.stats["dead_letters"] += n - n_bad
                if self.in_a_row >= FAILURES:
                    raise
                self.dead(dead_letters(rows.where("error is null"), str(e)), batch)
                out = None
            if out is not None:
                self.sink(out, batch)
                out.unpersist()
            self.stats["batches"] += 1
            rows.unpersist()
        finally:
            records.unpersist()


def start(stream: DataFrame, batches: Batches, checkpoint: str, every: str = "5 seconds", once: bool = False):
    """The running query. Stop it with stop(); starting again with the same checkpoint goes on where it was."""
    writer = stream.writeStream.foreachBatch(batches).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def stream_stats(query) -> dict:
    """Of a query's progress: batches, input rows, rows per second, batch duration and lag."""
    progress = [_plain(p) for p in query.recentProgress]
    if not progress:
        return {"batches": 0, "messages": 0, "rows_per_second": 0.0, "batch_ms": None, "lag": None}
    last = progress[-1]
    return {"batches": len(progress), "messages": sum(p["numInputRows"] for p in progress), "rows_per_second": last.get("processedRowsPerSecond", 0.0), "batch_ms": last.get("batchDuration"), "lag": lag(last)}


class ProgressLog(StreamingQueryListener):
    """Every progress report of the session's streams as a row of a table, however many batches a stream runs (recentProgress forgets all but the last hundred).

    Rows are written when ``every`` are at hand, and when a stream ends. Use as a context manager; finished(run_id) waits for the rows of a stream that has ended.
    """

    ROW = "run_id string, name string, batch_id long, at string, input_rows long, rows_per_second double, batch_ms long, state_rows long, lag long"

    def __init__(self, spark: SparkSession, path: str, every: int = 200):
        self.spark, self.path, self.every = spark, path, every
        self.rows: list[tuple] = []
        self.ended: dict[str, threading.Event] = {}

    def __enter__(self) -> ProgressLog:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_) -> None:
        self.spark.streams.removeListener(self)
        self._write()

    def onQueryStarted(self, event) -> None:
        self.ended.setdefault(str(event.runId), threading.Event())

    def onQueryProgress(self, event) -> None:
        p = _plain(event.progress)
        state = sum(s.get("numRowsTotal", 0) for s in p.get("stateOperators", []))
        self.rows.append((p["runId"], p.get("name"), p["batchId"], p["timestamp"], p["numInputRows"], p.get("processedRowsPerSecond"), p.get("batchDuration"), state, lag(p)))
        if len(self.rows) >= self.every:
            self._write()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._write()
        self.ended.setdefault(str(event.runId), threading.Event()).set()

    def _write(self) -> None:
        if self.rows:
            rows, self.rows = self.rows, []
            self.spark.createDataFrame(rows, self.ROW).coalesce(1).write.mode("append").parquet(self.path)

    def finished(self, run_id, seconds: float = 60) -> bool:
        """Whether the stream's end has been told and its rows written, within so many seconds."""
        return self.ended.setdefault(str(run_id), threading.Event()).wait(seconds)

    def table(self) -> DataFrame:
        return self.spark.read.schema(self.ROW).parquet(self.path)

    def stats(self) -> DataFrame:
        """Per run: batches with and without input, messages, the mean rate and duration of batches with input, and the last batch's state and lag."""
        filled = F.col("input_rows") > 0
        return self.table().groupBy("run_id").agg(
            F.count("*").alias("reports"), F.count_if(filled).alias("batches"), F.sum("input_rows").alias("messages"), F.avg(F.when(filled, F.col("rows_per_second"))).alias("rows_per_second"), F.avg(F.when(filled, F.col("batch_ms"))).alias("batch_ms"),
            F.max_by("state_rows", "batch_id").alias("state_rows"), F.max_by("lag", "batch_id").alias("lag"),
        )


def _plain(progress) -> dict:
    """A progress report as a dict; PySpark's own objects hold offsets as the text of Python dicts, their JSON has them whole."""
    return progress if isinstance(progress, dict) else json.loads(progress.json)


def lag(progress) -> int | None:
    """Latest offsets less end offsets, summed over partitions, a partition without an end offset from 0; None where the source doesn't tell offsets by topic."""
    total, told = 0, False
    for source in _plain(progress)["sources"]:
        latest, end = source.get("latestOffset"), source.get("endOffset")
        if isinstance(latest, dict) and all(isinstance(parts, dict) for parts in latest.values()):
            told, end = True, end if isinstance(end, dict) else {}
            total += sum(max(0, n - end.get(topic, {}).get(p, 0)) for topic, parts in latest.items() for p, n in parts.items())
    return total if told else None


def inspect_dead_letters(records: DataFrame, limit: int = 50) -> DataFrame:
    """Dead letters with value as text and a column for each header."""
    pick = lambda name: F.try_element_at(F.filter("headers", lambda h: h["key"] == name), F.lit(1))["value"].cast("string")
    out = records.select(F.col("key").cast("string").alias("key"), F.make_valid_utf8(F.col("value").cast("string")).alias("value"), pick("x-error").alias("error"), pick("x-original-topic").alias("original_topic"), pick("x-failed-at").alias("failed_at"), pick("x-original-offset").cast("long").alias("original_offset"))
    return out.orderBy("original_topic", "original_offset").limit(limit)


def replay_dead_letters(records: DataFrame, limit: int = 100) -> DataFrame:
    """key, value and the original topic of the first dead letters, to be written again."""
    topic = F.try_element_at(F.filter("headers", lambda h: h["key"] == "x-original-topic"), F.lit(1))["value"].cast("string")
    return records.select("key", "value", topic.alias("topic")).orderBy("topic", "value").limit(limit)
