"""What the SQL step lets through, and streams whose repeats and reports go beyond one batch."""

import datetime

import pytest
from pyspark.sql import functions as F

from weftline.functions.arguments import StepError
from weftline.operators import sqlstep
from weftline.streaming import streams


@pytest.fixture(scope="module")
def file(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("guard") / "x.parquet")
    spark.range(3).write.parquet(path)
    return path


@pytest.mark.parametrize("text", [
    "SELECT count(*) FROM parquet/**/.`{f}`", "SELECT * FROM `parquet`.`{f}`", "SELECT * FROM {{{{input}}}} WHERE id IN (SELECT id FROM `parquet`.`{f}`)", "SELECT (SELECT max(id) FROM `PARQUET` . `{f}`) FROM {{{{input}}}}",
    "WITH w AS (SELECT * FROM `parquet`.`{f}`) SELECT * FROM w", "SELECT * FROM IDENTIFIER('parquet.`{f}`')", "SELECT * FROM (WITH t AS (SELECT 1 AS x) SELECT * FROM t), t", "SELECT * FROM some_table", "SELECT `reflect`('java.lang.System', 'gc') FROM {{{{input}}}}",
    "WITH t AS (SELECT * FROM t) SELECT * FROM t", "SELECT (1 FROM {{{{input}}}}",
])
def test_only_inputs_are_read(spark, file, text):
    with pytest.raises(StepError):
        sqlstep.sql(text.format(f=file), input=spark.range(5)).count()


def test_what_a_statement_may_do(spark):
    df = spark.range(5)
    for text, n in (("SELECT * FROM {{input}} a JOIN {{other}} b USING (id)", 5), ("WITH t AS (SELECT * FROM {{input}}), u AS (SELECT * FROM t) SELECT * FROM u WHERE id IN (SELECT id FROM t WHERE id > 2)", 2), ("SELECT 'FROM parquet.`x`' AS s -- drop\nFROM {{input}}", 5),
                    ("WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 9) SELECT * FROM t", 9), ("SELECT explode(array(id, 1)) FROM {{input}}", 10)):
        assert sqlstep.sql(text, input=df, other=df).count() == n


def put(spark, base, rows):
    spark.createDataFrame(rows, "topic string, partition int, offset long, timestamp timestamp").coalesce(1).write.mode("append").parquet(f"{base}/in")


def test_repeats_of_later_batches_and_after_a_restart(spark, tmp_path):
    base, at = str(tmp_path), datetime.datetime(2024, 1, 1)
    hour = datetime.timedelta(hours=1)

    def drain():
        stream = streams.unrepeated(spark.readStream.schema("topic string, partition int, offset long, timestamp timestamp").parquet(f"{base}/in"), delay="2 hours")
        running = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/offsets").trigger(availableNow=True).start()
        running.awaitTermination()
        return sorted((r.partition, r.offset) for r in spark.read.parquet(f"{base}/out").collect())

    put(spark, base, [("t", 0, 1, at), ("t", 0, 1, at), ("t", 0, 2, at), ("t", 1, 1, at)])
    assert drain() == [(0, 1), (0, 2), (1, 1)]
    put(spark, base, [("t", 0, 2, at), ("t", 0, 3, at + hour), ("t", 1, 1, at + hour)])  # another query run: the state is the checkpoint's
    assert drain() == [(0, 1), (0, 2), (0, 3), (1, 1)]
    put(spark, base, [("t", 0, 4, at + 9 * hour)])
    drain()
    put(spark, base, [("t", 0, 3, at + hour), ("t", 0, 5, at + 9 * hour)])  # too late to be told from a repeat: left out
    assert drain() == [(0, 1), (0, 2), (0, 3), (0, 4), (0, 5), (1, 1)]


def test_every_report_is_a_row(spark, tmp_path):
    base = str(tmp_path)
    spark.range(90).withColumn("part", (F.col("id") % 9).cast("int")).repartition(4, "part").write.partitionBy("part").parquet(f"{base}/in")
    stream = spark.readStream.schema("id long, part int").option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    with streams.ProgressLog(spark, f"{base}/log", every=4) as log:
        running = stream.writeStream.format("noop").option("checkpointLocation", f"{base}/offsets").trigger(availableNow=True).start()
        running.awaitTermination()
        assert log.finished(running.runId)
    got = log.stats().where(F.col("run_id") == str(running.runId)).first()
    assert (got.batches, got.messages, got.state_rows, got.lag) == (9, 90, 0, None) and got.rows_per_second > 0 and log.table().select("batch_id").distinct().count() >= 9
