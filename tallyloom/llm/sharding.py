"""Sharding by a minimax contiguous partition of atomic groups.

A group is all rows with equal text (by 64-bit hash); a shard holds it whole. Groups lie in the order of their
hash. A heavy group, larger than the GRAIN-th part of a shard, is an atom of its own; all other groups are
gathered into hash bins, each an atom. There are at most shards * GRAIN of either kind, whatever the size of
the input, so the driver may hold their sizes. It binary-searches the smallest capacity with which a greedy
walk over the ordered atoms needs no more than the given number of shards. The cuts are those within that capacity that
leave the shards as even as it allows. A bin is not one group: the capacity is the least for the atoms, which can be above
the least for the groups themselves by no more than the largest bin, about a GRAIN-th part of a shard.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window as W, functions as F

from tallyloom.llm._store import Workspace

SHARDS = 24
GRAIN = 2048
SLOT_ROWS = 10_000  # rows that one task numbers, about


def greedy_cuts(sizes: np.ndarray, capacity: int, shards: int) -> list[int] | None:
    """Index of the first atom of each shard but the first, each shard being filled as far as it goes; None if that takes more shards."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    at, cuts = 0, []
    while True:
        at = int(np.searchsorted(ends, ends[at] + capacity, "right")) - 1
        if at >= len(sizes):
            return cuts
        cuts.append(at)
        if len(cuts) >= shards:
            return None


def even_cuts(sizes: np.ndarray, capacity: int, shards: int) -> list[int]:
    """Cuts within the capacity that leave the shards as even as it allows: each is the one nearest to an equal
    part of the rest, of those that the capacity lets it reach and from which the rest still fits."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    earliest = [len(sizes)]  # from the end: the first atom from which so many shards hold the rest
    for _ in range(shards - 1):
        earliest.append(int(np.searchsorted(ends, ends[earliest[-1]] - capacity, "left")))
    at, cuts = 0, []
    for left in range(shards - 1, 0, -1):
        furthest = int(np.searchsorted(ends, ends[at] + capacity, "right")) - 1
        wish = ends[at] + (ends[-1] - ends[at]) / (left + 1)
        near = int(np.searchsorted(ends, wish, "left"))
        if near > at and wish - ends[near - 1] < ends[min(near, len(sizes))] - wish:
            near -= 1
        at = min(max(near, earliest[left], at), furthest)
        if at >= len(sizes):
            break
        cuts.append(at)
    return cuts


def minimax_cuts(sizes: np.ndarray, shards: int) -> tuple[int, list[int]]:
    """The smallest capacity with which a greedy walk needs no more than `shards`, and even cuts within it."""
    if not len(sizes):
        return 0, []
    low = max(int(sizes.max()), -(-int(sizes.sum()) // shards))
    high = int(sizes.sum())
    while low < high:
        middle = (low + high) // 2
        if greedy_cuts(sizes, middle, shards) is None:
            low = middle + 1
        else:
            high = middle
    return low, even_cuts(sizes, low, shards)


def shard(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS, grain: int = GRAIN) -> DataFrame:
    """doc_id, size (UTF-8 bytes and 8), text_crc32, shard, slot (from 0, without gaps in each shard).

    A null text has no bytes: size 8, crc 0, in one group with empty texts. Null ids are placed as any other and come
    first among equal texts of a group that is not heavy. Slots follow a hash and do not depend on the number of tasks. Repeated rows are in one shard, in neighbouring slots that are interchangeable. An empty
    table gives no rows; fewer atoms than shards leave some shards empty.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "shards")
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.xxhash64(body).alias("key"))
    rows = space.table(rows, "rows")
    groups = rows.groupBy("key").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    bins = shards * grain
    least = max(1, total // bins)
    binned = F.pmod(F.shiftrightunsigned("key", 16), F.lit(bins))
    heavy = F.col("size") > least
    atoms = groups.select(binned.alias("bin"), F.when(heavy, F.col("key")).alias("heavy"), "size").groupBy("bin", "heavy").agg(F.sum("size").alias("size"))
    # At most `bins` bins and, their sizes adding up to no more than the total, `bins` heavy groups.
    held = atoms.sort("bin", F.col("heavy").asc_nulls_first()).collect()
    _, cuts = minimax_cuts(np.array([r["size"] for r in held], np.int64), shards)
    number = np.searchsorted(np.array(cuts, int), np.arange(len(held)), "right")
    placed = [(r["bin"], r["heavy"], int(k)) for r, k in zip(held, number, strict=True)]
    known = spark.createDataFrame(placed, "bin long, heavy long, shard int")
    singles = F.broadcast(known.where("heavy is not null").select(F.col("heavy").alias("key"), F.col("shard").alias("own")))
    shared = F.broadcast(known.where("heavy is null").select("bin", "shard"))
    out = rows.withColumn("bin", binned).join(singles, "key", "left").join(shared, "bin", "left")
    parts = 1 + count // (shards * SLOT_ROWS)
    # Part of a shard: a range of a hash of the group, for the rows of a heavy group of the id too; each part is numbered by one task.
    spread = F.shiftrightunsigned(F.when(F.col("own").isNotNull(), F.xxhash64("key", "doc_id")).otherwise(F.xxhash64("key")), 33)
    out = out.select("doc_id", "size", "text_crc32", "key", F.coalesce("own", "shard").alias("shard"), spread.alias("spread"), F.shiftright(spread * parts, 31).alias("part"))
    out = space.table(out, "placed")
    counts = out.groupBy("shard", "part").agg(F.count("*").alias("n"))
    bases = counts.select("shard", "part", (F.sum("n").over(W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("base"))
    inner = F.row_number().over(W.partitionBy("shard", "part").orderBy("spread", "key", F.col("doc_id").asc_nulls_first(), "text_crc32", "size")) - 1
    return out.withColumn("inner", inner).join(bases, ["shard", "part"]).select(F.col("doc_id").alias(doc_id), "size", "text_crc32", "shard", (F.col("base") + F.col("inner")).alias("slot"))
