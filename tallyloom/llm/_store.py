"""Tables between the steps of an operator, in the folder that the driver and all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyloom.sources.shared import shared_folder
from tallyloom.sources.shipping import ship


#: Rows in an Arrow batch, where the session doesn't say: documents are long, and a batch is held by JVM and worker at once.
BATCH_ROWS = 2000
#: Frequent keys are dealt in parts of no more than one of so many parts of all rows, and no fewer than so many rows.
PARTS = 2048
PART_ROWS = 1000
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_watchers: list[list] = []


@contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """Closes, at the end, the workspaces that were opened within."""
    opened: list[Workspace] = []
    _watchers.append(opened)
    try:
        yield
    finally:
        _watchers[:] = [w for w in _watchers if w is not opened]
        for space in opened:
            space.close()


@contextmanager
def _tidy_shuffles(spark: SparkSession) -> Iterator[None]:
    """What a step shuffles is removed when its table is written, not when the driver's garbage collector comes to it."""
    before = spark.conf.get(TIDY)
    spark.conf.set(TIDY, "true")
    try:
        yield
    finally:
        spark.conf.set(TIDY, before)


def each_part(parts: Column) -> Column:
    """Its row once for each part."""
    return F.explode(F.sequence(F.lit(0), parts - 1))


def parted(rows: DataFrame, hot: DataFrame, key: str, by: list[str]) -> DataFrame:
    """rows with part and parts, by a hash of the columns `by`; hot (key, parts) is bounded: see `dealt`."""
    met = rows.join(F.broadcast(hot), key, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    return met.withColumn("part", F.pmod(F.xxhash64(*by), F.col("parts")).cast("int"))


def in_parts(counts: DataFrame, n: str) -> DataFrame:
    """counts with parts: how many tasks the n rows of a key are dealt to."""
    share = max((counts.agg(F.sum(n)).first()[0] or 0) / PARTS, PART_ROWS)
    return counts.withColumn("parts", F.greatest(F.ceil(F.col(n) / share), F.lit(1)).cast("int"))


def dealt(rows: DataFrame, counts: DataFrame, key: str, by: list[str], n: str = "n") -> tuple[DataFrame, DataFrame]:
    """Both sides of a join on [key, "part"], which gives what a join on the key gives, but deals the rows of a frequent key to many tasks.

    counts has one row per key, and in n how many rows have it; it is read three times, so it should be a written table. A key in several
    parts has more than one of PARTS parts of all rows: there are fewer than PARTS such keys, with fewer than 2 * PARTS parts together,
    whatever the size of the tables. Only these keys are broadcast.
    """
    split = in_parts(counts, n)
    return parted(rows, split.where("parts > 1").select(key, "parts"), key, by), split.select("*", each_part(F.col("parts")).alias("part")).drop("parts")


class Workspace:
    """A folder of one run. A written table cuts the lineage: later steps read it, also after executors are lost."""

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        self.spark = spark
        self.path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        for opened in _watchers:
            opened.append(self)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        self.count += 1
        path = f"{self.path}/{self.count:03d}-{name}"
        schema = df.schema
        with _tidy_shuffles(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        out._tallyloom_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            self.remove(table._tallyloom_path)

    def close(self) -> None:
        """Removes all of its tables; for when the result has been written elsewhere."""
        self.remove(self.path)

    def remove(self, path: str) -> None:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
