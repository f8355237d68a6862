"""Tables that are merged in place, bucket by bucket, and an inverted index of names."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import _file_system


class BucketedTable:
    """Rows in buckets of their key's hash, each bucket in the version that last changed it.

    merge reads and writes only the buckets that the new rows fall into; the others stay where they are. The list of buckets and versions (a row each) is written
    last, as a folder of its own, so a merge that fails leaves the table as it was, and readers of an older version aren't disturbed. Null keys are a key.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], merged: Callable[[DataFrame, DataFrame], DataFrame], buckets: int = 64):
        self.spark, self.path, self.keys, self.merged, self.buckets = spark, path.rstrip("/"), list(keys), merged, buckets

    def versions(self) -> dict[int, int]:
        """bucket -> version, of the newest complete list; empty for a new table."""
        at, files = _file_system(self.spark, f"{self.path}/list")
        if not files.exists(at):
            return {}
        done = [int(x.getPath().getName().removeprefix("v")) for x in files.listStatus(at) if files.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS"))]
        return {r["bucket"]: r["version"] for r in self.spark.read.schema("bucket int, version int").parquet(f"{self.path}/list/v{max(done)}").collect()} if done else {}

    def bucket_of(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _read(self, versions: dict[int, int], schema) -> DataFrame:
        if not versions:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/v{v}/bucket={b}" for b, v in sorted(versions.items())])

    def table(self, schema) -> DataFrame:
        """All rows, with the columns of schema."""
        return self._read(self.versions(), schema)

    def merge(self, new: DataFrame) -> set[int]:
        """Merge new rows in and return the buckets that were rewritten. Running it again with the same rows gives the same table."""
        held = self.versions()
        touched = {r[0] for r in new.select(self.bucket_of()).distinct().collect()}  # at most a row a bucket
        if not touched:
            return touched
        version = max(held.values(), default=0) + 1
        both = self.merged(self._read({b: v for b, v in held.items() if b in touched}, new.schema), new).select(*new.columns)
        both.withColumn("bucket", self.bucket_of()).repartition(min(len(touched), self.buckets), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/v{version}")
        self.spark.createDataFrame(sorted((held | dict.fromkeys(touched, version)).items()), "bucket int, version int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/list/v{version}")
        return touched


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _windows(of: Column, size: int) -> Column:
    return F.flatten(F.transform(of, lambda w: F.when(F.length(w) >= size, F.transform(F.sequence(F.lit(1), F.length(w) - size + 1), lambda k: F.substring(w, k, size))).otherwise(F.array().cast("array<string>"))))


def grams(name: Column) -> Column:
    """What a name is filed under: windows of three letters of its words, with two spaces before and one after each, and of two, with one space on either side."""
    of = words(name)
    wide, narrow = F.transform(of, lambda w: F.concat(F.lit("  "), w, F.lit(" "))), F.transform(of, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    return F.array_distinct(F.concat(_windows(wide, 3), _windows(narrow, 2)))


def needed_grams(query: str) -> list[str]:
    """Grams that every name holding the query has: windows within its words, and over those ends of words that lie inside the query."""
    low, found = query.lower(), set()
    letters = [c.isalnum() for c in low]
    start = 0
    while start < len(low):
        if not letters[start]:
            start += 1
            continue
        end = start
        while end < len(low) and letters[end]:
            end += 1
        word, begun, ended = low[start:end], start > 0, end < len(low)
        wide, narrow = "  " * begun + word + " " * ended, " " * begun + word + " " * ended
        found |= {wide[k : k + 3] for k in range(len(wide) - 2)} | {narrow[k : k + 2] for k in range(len(narrow) - 1)}
        start = end
    longest = {g for g in found if len(g) == 3}
    return sorted(longest or found)


class NameIndex:
    """Postings gram -> (key, name) in folders by the gram's hash, for finding names that hold a text without reading all names.

    add files the names of rows that aren't filed yet; search reads the postings of the query's grams only, the folders of the others are never opened.
    Postings are appended; filing the same rows again, or after a failure half way, changes no result.
    """

    def __init__(self, spark: SparkSession, path: str, key: Sequence[str], name: str = "name", slots: int = 256):
        self.spark, self.path, self.key, self.name, self.slots = spark, path.rstrip("/"), list(key), name, slots

    def _slot(self, *columns) -> Column:
        return F.pmod(F.xxhash64(*columns), F.lit(self.slots)).cast("int")

    def _has(self, folder: str) -> bool:
        at, files = _file_system(self.spark, f"{self.path}/{folder}")
        return files.exists(at)

    def add(self, rows: DataFrame) -> None:
        new = rows.select(*self.key).where(F.col(self.name).isNotNull()).distinct().withColumn("slot", self._slot(*self.key))
        if self._has("keys"):
            touched = [r[0] for r in new.select("slot").distinct().collect()]  # at most slots rows
            known = self.spark.read.parquet(f"{self.path}/keys").where(F.col("slot").isin(touched))
            new = new.join(known, [new[c].eqNullSafe(known[c]) for c in [*self.key, "slot"]], "left_anti")
        filed = new.select(*self.key, F.explode(grams(F.col(self.name))).alias("gram")).withColumn("slot", self._slot("gram"))
        filed.repartition("slot").sortWithinPartitions("slot", "gram").write.mode("append").partitionBy("slot").parquet(f"{self.path}/postings")
        new.repartition("slot").write.mode("append").partitionBy("slot").parquet(f"{self.path}/keys")

    def candidates(self, query: str) -> DataFrame:
        """Keys of the names that may hold the query: those under all of its grams. A query without a letter or digit has none, so all keys are read."""
        asked = needed_grams(query)
        if not asked:
            return self.spark.read.parquet(f"{self.path}/keys").drop("slot").distinct()
        slots = [r[0] for r in self.spark.createDataFrame([(g,) for g in asked], "gram string").select(self._slot("gram")).distinct().collect()]
        found = self.spark.read.parquet(f"{self.path}/postings").where(F.col("slot").isin(slots) & F.col("gram").isin(asked))
        return found.groupBy(*self.key).agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(asked)).drop("n")

    def holding(self, query: str) -> DataFrame:
        """Keys of the names that hold the query, in any case."""
        return self.candidates(query).where(F.contains(F.lower(self.name), F.lit(query.lower())))
