"""Reading and writing tables: CSV, JSON, Parquet, with column policies, metadata and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arguments import StepError
from ..functions.masks import apply_policies


def load(spark: SparkSession, path: str, kind: str | None = None, schema=None, multiline: bool = False, role: str | None = None, policies=None) -> DataFrame:
    """A table by its extension (csv, json, parquet) or kind; policies, if given, apply before any step sees it.

    Without a schema CSV types are inferred by one more pass; pass a schema on large inputs. multiline: the JSON file is one array.
    """
    kind = kind or path.rstrip("/").rpartition(".")[2].lower()
    read = spark.read.schema(schema) if schema else spark.read
    if kind == "csv":
        df = read.csv(path, header=True, inferSchema=schema is None)
    elif kind == "json":
        df = read.json(path, multiLine=multiline)
    elif kind == "parquet":
        df = read.parquet(path)
    else:
        raise StepError(f"load: unknown format {kind!r} (csv, json, parquet)")
    return apply_policies(df, role, policies) if policies else df


def file_metadata(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """file, bytes, row_count, columns, dtypes of every file below path, files without rows too.

    Parquet counts read no column: rows come from the files' footers (the scan's schema is empty). Files are listed without being opened.
    """
    df = load(spark, path, kind)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    counted = df.groupBy(name.alias("file")).agg(F.count("*").alias("row_count"))
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"))
    found = listed.join(counted, "file", "left").withColumn("row_count", F.coalesce("row_count", F.lit(0)))
    return found.select("file", "bytes", "row_count", F.lit(len(df.columns)).alias("column_count"), F.array(*map(F.lit, df.columns)).alias("columns"), F.array(*[F.lit(t) for _, t in df.dtypes]).alias("dtypes"))


def preview(df: DataFrame, rows: int = 20, role: str | None = None, policies=None) -> DataFrame:
    """The first 1 to 100 rows, policies applied."""
    if not 1 <= rows <= 100:
        raise StepError("preview: rows must be 1 to 100")
    return apply_policies(df, role, policies or []).limit(rows)


def save(df: DataFrame, path: str, mode: str = "overwrite") -> dict:
    """Write by extension (csv, json, parquet; anything else as csv) and report rows, format, bytes and path.

    JSON has no NaN or infinity: they become null. The rows are counted while they are written.
    """
    kind = path.rstrip("/").rpartition(".")[2].lower()
    kind = kind if kind in ("json", "parquet") else "csv"
    if kind == "json":
        for field in df.schema.fields:
            if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
                c = F.col(f"`{field.name}`")
                df = df.withColumn(field.name, F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c))
    seen = Observation()
    writer = df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode(mode)
    if kind == "csv":
        writer.option("header", True).csv(path)
    elif kind == "json":
        writer.json(path)
    else:
        writer.option("compression", "snappy").parquet(path)
    spark = df.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    size = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    return {"rows": seen.get["rows"], "format": kind, "bytes": size, "path": path}
