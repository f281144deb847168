"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are few and short, documents many and long. Items are partitioned by size (their number of
distinct shingles, in powers of two). Every document is cut into blocks of shingles whose length follows
the size class; one pass of MinHash over the smallest blocks gives the minima of all larger ones, as a
larger block is a union of smaller ones. Two neighbouring blocks hold any item of their class whole, so
that the similarity of item and window is about 0.2 at least, and 64 bands of one row each lose such a
pair with a probability below 1e-6; an item scattered over a document meets as many bands in all. Items of
up to TINY shingles are looked up directly, and an item of fewer words than a shingle is one run of all its words, looked
up among the document's runs of so many words. Every candidate is then verified: the exact share of the
item's distinct shingles that the whole document holds must reach the threshold.

Nothing of the documents is shuffled or collected. Items are taken in blocks of at most `block_bytes`
of index, each block being sent to the executors: more items mean more passes, never a larger broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tallyloom.llm import _bytes as B
from tallyloom.llm._store import Workspace

BANDS = 64
TINY = 8
BLOCK_BYTES = 32 << 20
MULTIPLIERS = B.mix(np.arange(1, BANDS + 1, dtype=np.uint64)) | np.uint64(1)


class ItemIndex:
    """Signatures and shingles of one block of items."""

    def __init__(self, ids: list, texts: list, k: int):
        self.k, self.ids, self.sets = k, [], []
        raw, at = B.text_bytes(pa.array(texts, pa.string()))
        start, end, bounds = B.words(raw, at)
        values, owner = B.shingles(B.Hasher(raw).spans(start, end), bounds, k)
        n = np.diff(bounds)
        order = np.argsort(owner, kind="stable")
        values, edges = values[order], np.searchsorted(owner[order], np.arange(len(ids) + 1))
        for i in np.flatnonzero(n >= k):
            self.ids.append(ids[i])
            self.sets.append(np.unique(values[edges[i] : edges[i + 1]]))
        self.whole = {}  # by number of words: sorted hashes of the short items, and the items
        for length in range(1, k):
            own = np.flatnonzero(n == length)
            if len(own):
                runs = B.windows(B.Hasher(raw).spans(start, end), bounds, length)
                run = runs[0][np.searchsorted(runs[1], bounds[own])]
                sort = np.argsort(run)
                self.whole[length] = (run[sort], len(self.ids) + sort)
                self.ids += [ids[i] for i in own]
                self.sets += [run[j : j + 1] for j in range(len(own))]
        size = np.array([len(s) for s in self.sets], np.int64)
        self.level = np.where(size <= TINY, -1, np.floor(np.log2(np.maximum(size, 1)))).astype(int)
        shorter = sum(len(items) for _, items in self.whole.values())
        tiny = np.flatnonzero(self.level[: len(self.ids) - shorter] < 0)
        pairs = sorted((int(v), int(i)) for i in tiny for v in self.sets[i])
        self.tiny = (np.array([v for v, _ in pairs], np.uint64), np.array([i for _, i in pairs], np.int64))
        self.levels = {}
        for lv in sorted({int(x) for x in self.level if x >= 0}):
            own = np.flatnonzero(self.level == lv)
            sig = np.stack([(self.sets[i][None, :] * MULTIPLIERS[:, None]).min(1) for i in own], 1)
            order = np.argsort(sig, axis=1)
            self.levels[lv] = (np.take_along_axis(sig, order, 1), own[order])

    def __len__(self):
        return len(self.ids)

    def find(self, raw: np.ndarray, at: np.ndarray, threshold: float) -> Iterator[tuple[int, int, float]]:
        """(text index, item index, containment) of the texts' verified hits."""
        start, end, bounds = B.words(raw, at)
        hashes = B.Hasher(raw).spans(start, end)
        for length, (keys, items) in self.whole.items():
            values, first = B.windows(hashes, bounds, length)
            whole: set[tuple[int, int]] = set()
            self._look_up(keys, items, values, first, lambda i: np.searchsorted(bounds, i, "right") - 1, whole)
            yield from ((d, i, 1.0) for d, i in whole)
        values, first = B.windows(hashes, bounds, self.k)
        if not len(values) or not self.ids:
            return
        edges = np.searchsorted(first, bounds)  # shingles before each text
        found: set[tuple[int, int]] = set()
        if len(self.tiny[0]):
            self._look_up(*self.tiny, values, np.arange(len(values)), lambda i: np.searchsorted(edges, i, "right") - 1, found)
        if self.levels:
            self._windows(values, edges, found)
        sets: dict[int, np.ndarray] = {}
        for d, i in sorted(found):
            if d not in sets:
                sets[d] = np.unique(values[edges[d] : edges[d + 1]])
            item, have = self.sets[i], sets[d]
            at_ = np.minimum(np.searchsorted(have, item), len(have) - 1)
            share = float((have[at_] == item).mean())
            if share >= threshold:
                yield d, i, share

    @staticmethod
    def _look_up(keys, items, values, places, owner, found):
        if not len(values):
            return
        lo = np.searchsorted(keys, values, "left")
        hit = np.flatnonzero(keys[np.minimum(lo, len(keys) - 1)] == values)
        if not len(hit):
            return
        hi = np.searchsorted(keys, values[hit], "right")
        for place, a, b in zip(owner(places[hit]), lo[hit], hi, strict=True):
            found.update((int(place), int(i)) for i in items[a:b])

    def _windows(self, values, edges, found):
        lowest = min(self.levels)
        width = 2 << lowest
        counts = np.diff(edges)
        blocks = -(-counts // width)
        total = int(blocks.sum())
        offset = np.cumsum(blocks) - blocks
        owner = np.repeat(np.arange(len(counts)), blocks)
        local = np.arange(total) - offset[owner]
        begin = edges[owner] + local * width
        minima = np.empty((BANDS, total), np.uint64)
        for j in range(BANDS):
            minima[j] = np.minimum.reduceat(values * MULTIPLIERS[j], begin)
        for lv in range(lowest, max(self.levels) + 1):
            if lv > lowest:
                even = np.flatnonzero(local % 2 == 0)
                minima = np.minimum.reduceat(minima, even, axis=1)
                owner, local = owner[even], local[even] // 2
            if lv in self.levels:
                # The minimum of a window is that of one of its two blocks, so blocks are enough.
                sigs, items = self.levels[lv]
                for j in range(BANDS):
                    self._look_up(sigs[j], items[j], minima[j], np.arange(len(owner)), lambda i, o=owner: o[i], found)


def _blocks(items: DataFrame, item_id: str, item_text: str, k: int, block_bytes: int) -> Iterator[ItemIndex]:
    rows = items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).cast("string").alias("t")).where("i is not null and t is not null").distinct()
    ids, texts, size = [], [], 0
    for row in rows.toLocalIterator():
        ids.append(row.i)
        texts.append(row.t)
        size += BANDS * 16 + 16 * len(row.t)
        if size >= block_bytes:
            yield ItemIndex(ids, texts, k)
            ids, texts, size = [], [], 0
    if ids:
        yield ItemIndex(ids, texts, k)


def find_leaks(docs: DataFrame, items: DataFrame, keys: list[str], text: str = "text", item_id: str = "item_id", item_text: str = "text",
               k: int = 5, threshold: float = 0.8, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document and block of items: the key columns, items (sorted ids that the document
    contains) and containment (the largest share).

    Null and empty texts hold nothing. Items of fewer than k words are found where all their words stand in a row; items
    without a word, or with a null id or text, are left out. Items that share an id count as one, found if any is.
    Repeated rows are answered one by one. Other columns of either table are not looked at.
    """
    spark = docs.sparkSession
    Workspace(spark, "leaks")
    schema = docs.select(*keys).schema
    schema = schema.add("items", T.ArrayType(T.LongType())).add("containment", "double")
    at = keys.index(text) if text in keys and docs.schema[text].dataType.simpleString() == "string" else len(keys)
    more = [F.col(text).cast("string").alias("__text")] if at == len(keys) else []
    parts = []
    for index in _blocks(items, item_id, item_text, k, block_bytes):
        shared = spark.sparkContext.broadcast(index)

        def scan(batches, shared=shared, n=len(keys)):
            index = shared.value
            for batch in batches:
                hits: list[set] = [set() for _ in range(batch.num_rows)]
                best = np.zeros(batch.num_rows)
                for a, _, raw, edges in B.in_slices(batch.column(at)):
                    for d, i, share in index.find(raw, edges, threshold):
                        hits[a + d].add(index.ids[i])
                        best[a + d] = max(best[a + d], share)
                lists = pa.array([sorted(h) for h in hits], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], lists, pa.array(best)], names=[*batch.schema.names[:n], "items", "containment"])

        parts.append(docs.select(*keys, *more).mapInArrow(B.lean(scan), schema))
    if not parts:
        return docs.select(*keys, F.array().cast("array<long>").alias("items"), F.lit(0.0).alias("containment"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    out._tallyloom_blocks = len(parts)
    return out


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """One row per document: key, contaminated, n_items, items, containment. Documents that share a key are
    answered one by one."""
    spread = docs.withColumn("__hash", F.md5(F.coalesce(F.col(options.get("text", "text")).cast("string"), F.lit(""))))
    found = find_leaks(spread, items, [key, "__hash"], **options)
    blocks = getattr(found, "_tallyloom_blocks", 1)
    if blocks > 1:
        # Each row is answered once by each block; rows with the same key and text have the same answer.
        found = found.groupBy(key, "__hash").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), F.max("containment").alias("containment"), F.count("*").alias("__n"))
        found = found.withColumn("__row", F.explode(F.sequence(F.lit(1), F.expr(f"__n div {blocks}"))))
    return found.select(key, (F.size("items") > 0).alias("contaminated"), F.size("items").cast("long").alias("n_items"), "items", "containment")


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents that hold no test item, with all their columns."""
    names = docs.columns
    columns = [f"c{i}" for i in range(len(names))]
    plain = docs.toDF(*columns)
    index = names.index(text)
    found = find_leaks(plain, items, columns, text=f"c{index}", **options)
    if getattr(found, "_tallyloom_blocks", 1) > 1:
        # Equal texts have equal answers, so the answers of all blocks meet by text.
        marked = plain.withColumn("__h", F.md5(F.col(f"c{index}").cast("string")))
        bad = found.where(F.size("items") > 0).select(F.md5(F.col(f"c{index}").cast("string")).alias("__h")).distinct()
        return marked.join(bad, "__h", "left_anti").select(*columns).toDF(*names)
    return found.where(F.size("items") == 0).select(*columns).toDF(*names)
