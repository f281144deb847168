"""Upserts as versioned merges: a batch meets the live head, the result is a new snapshot. Nothing is deleted by absence."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

KEY = ["conversation_id", "native_id", "part"]


def last_of_each(batch: DataFrame) -> DataFrame:
    """One row per key: the one with the highest offset, where the batch has offsets, else with the longest text. Sources deliver at least
    once, so a batch may hold a key several times."""
    order = [F.col("offset")] if "offset" in batch.columns else []
    last = F.max_by("text", F.struct(*order, F.length("text"), F.col("text")))
    return batch.groupBy(*KEY).agg(last.alias("text"))


def actions(head: DataFrame, batch: DataFrame) -> DataFrame:
    """The action for each key of the batch: insert, touch (the same text), grow (the text goes on) or version (another text)."""
    batch = last_of_each(batch)
    old = head.where(~F.col("superseded")).select(*KEY, F.col("text").alias("old_text"), F.lit(True).alias("__old"))
    grown = F.col("text").startswith(F.col("old_text"))
    action = F.when(F.col("__old").isNull(), "insert").when(F.col("text") == F.col("old_text"), "touch").when(grown, "grow").otherwise("version")
    return batch.join(old, KEY, "left").select(*KEY, "text", action.alias("action"))


def upsert(head: DataFrame, batch: DataFrame, generation: int) -> DataFrame:
    """The next snapshot: grown rows have the new text, replaced ones are superseded by a row of the next version."""
    done = actions(head, batch)
    marks = done.select(*KEY, "action", F.col("text").alias("new_text"))
    live = head.where(~F.col("superseded")).join(marks, KEY, "left")
    kept = live.withColumn("text", F.when(F.col("action") == "grow", F.col("new_text")).otherwise(F.col("text")))
    kept = kept.withColumn("superseded", F.coalesce(F.col("action") == "version", F.lit(False)))
    kept = kept.withColumn("source_generation", F.when(F.col("action").isin("touch", "grow"), F.lit(generation).cast("long")).otherwise(F.col("source_generation"))).select(*head.columns)
    fresh = done.where(F.col("action").isin("insert", "version")).join(head.where(~F.col("superseded")).select(*KEY, F.col("version").alias("__v")), KEY, "left")
    values = {"text": F.col("text"), "version": F.coalesce(F.col("__v") + 1, F.lit(1)).cast("int"), "superseded": F.lit(False), "source_generation": F.lit(generation).cast("long"), "id": F.concat_ws("/", *[F.col(k).cast("string") for k in KEY], F.coalesce(F.col("__v") + 1, F.lit(1)).cast("string"))}
    types = dict(head.dtypes)
    columns = [F.col(c) if c in KEY else values[c].cast(types[c]).alias(c) if c in values else F.lit(None).cast(types[c]).alias(c) for c in head.columns]
    return head.where("superseded").unionByName(kept).unionByName(fresh.select(*columns))


def supersede_absent(head: DataFrame, generation: int) -> DataFrame:
    """Live rows that the generation did not bring are superseded."""
    return head.withColumn("superseded", F.col("superseded") | (F.col("source_generation") < generation))


def set_active_path(head: DataFrame, path: DataFrame) -> DataFrame:
    """on_active_path by membership of (conversation_id, native_id), for conversations that the path names; others keep theirs."""
    named = path.select("conversation_id").distinct().withColumn("__named", F.lit(True))
    on = path.select("conversation_id", "native_id").distinct().withColumn("__on", F.lit(True))
    rows = head.join(named, "conversation_id", "left").join(on, ["conversation_id", "native_id"], "left")
    return rows.withColumn("on_active_path", F.when(F.col("__named"), F.coalesce("__on", F.lit(False))).otherwise(F.col("on_active_path"))).select(*head.columns)


def fill_only(head: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Sessions with what they lack filled from a batch; the first start and the last activity win."""
    other = batch.select(*[F.col(c).alias(f"__{c}") if c != key else F.col(c) for c in batch.columns])
    both = head.join(other, key, "full_outer")

    def merged(c):
        if c == key or c not in batch.columns:
            return F.col(c)
        pick = F.least if c == "started_at" else F.greatest if c == "last_activity_at" else F.coalesce
        return pick(F.col(c), F.col(f"__{c}")).alias(c)

    return both.select(*[merged(c) for c in head.columns])


class Snapshots:
    """Versions of a table below one folder: each is written whole, then named by a new pointer file; readers pin one."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _pointers(self) -> list[tuple[int, str]]:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/pointers")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted((int(n.split("-", 1)[0]), n.split("-", 1)[1]) for n in names if not n.startswith((".", "_")) and "-" in n)

    def version(self) -> int:
        found = self._pointers()
        return found[-1][0] if found else 0

    def commit(self, df: DataFrame) -> int:
        version, name = self.version() + 1, uuid.uuid4().hex
        df.write.parquet(f"{self.folder}/data/{name}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/pointers/{version:010d}-{name}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).createNewFile(path):
            raise RuntimeError("another writer was first")
        return version

    def read(self, version: int | None = None) -> DataFrame:
        found = dict(self._pointers())
        return self.spark.read.parquet(f"{self.folder}/data/{found[version or max(found)]}")
