"""Files between scans: what changed, content-defined chunks, companions."""

from __future__ import annotations

import hashlib
import random

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyloom.sources.shipping import ship

MIN_CHUNK, MEAN_CHUNK, MAX_CHUNK = 128 << 10, 512 << 10, 4 << 20
HEAD_BYTES = 4096


def decisions(known: DataFrame, seen: DataFrame) -> DataFrame:
    """path and decision (new, unchanged, append, rewrite, gone) of files by identity, size, change time and hashes.

    `known` has path, identity, size, ctime, head, anchor (hash of the last bytes read, at the old size); `seen` the
    same of now, with anchor taken at the size that is known.
    """
    old = known.select("path", *[F.col(c).alias(f"old_{c}") for c in ("identity", "size", "ctime", "head", "anchor")], F.lit(True).alias("was"))
    both = old.join(seen.withColumn("now", F.lit(True)), "path", "full_outer")
    same = (F.col("identity") == F.col("old_identity")) & (F.col("head") == F.col("old_head"))
    decision = (
        F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "gone").when(same & (F.col("size") == F.col("old_size")) & (F.col("ctime") == F.col("old_ctime")), "unchanged")
        .when(same & (F.col("size") >= F.col("old_size")) & (F.col("anchor") == F.col("old_anchor")), "append").otherwise("rewrite")
    )
    return both.select("path", decision.alias("decision"))


def cut_points(data: bytes, least: int = MIN_CHUNK, mean: int = MEAN_CHUNK, most: int = MAX_CHUNK) -> list[int]:
    """Ends of content-defined chunks: a gear hash with a strict mask up to the mean size and a loose one beyond it."""
    bits = mean.bit_length() - 1
    strict, loose = (1 << bits + 1) - 1, (1 << bits - 1) - 1
    ends, start, n = [], 0, len(data)
    while n - start > least:
        h, end = 0, min(n, start + most)
        for i in range(start + least, end):
            h = (h << 1) + GEAR[data[i]] & 0xFFFFFFFFFFFFFFFF
            if not (h >> 16) & (strict if i - start < mean else loose):
                end = i + 1
                break
        ends.append(end)
        start = end
    if start < n:
        ends.append(n)
    return ends


_r = random.Random(20240229)
GEAR = [_r.getrandbits(64) for _ in range(256)]


def chunked(files: DataFrame, least: int = MIN_CHUNK, mean: int = MEAN_CHUNK, most: int = MAX_CHUNK) -> DataFrame:
    """path, ordinal, offset, size, hash and is_tail (the last chunk, which may still grow) of binary files (path, content)."""
    ship(files.sparkSession)

    def scan(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                start, rows = 0, []
                for i, end in enumerate(cut_points(content or b"", least, mean, most)):
                    rows.append((path, i, start, end - start, hashlib.sha256(content[start:end]).hexdigest(), end == len(content)))
                    start = end
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
                types = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=["path", "ordinal", "offset", "size", "hash", "is_tail"])

    return files.select("path", "content").mapInArrow(scan, "path string, ordinal int, offset long, size long, hash string, is_tail boolean")


def with_companions(sources: DataFrame, companions: DataFrame) -> DataFrame:
    """Sources with the side files in their folder of the same stem."""
    stem = F.regexp_replace("path", r"\.[^./]+$", "")
    side = companions.select(F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("__stem"), F.col("path").alias("companion"))
    return sources.withColumn("__stem", stem).join(side, "__stem", "left").drop("__stem")


def capped(text: str, most: int = 16_384, head: int = 6_144, tail: int = 6_144) -> str:
    """A long tool text cut to its head, its tail and, of the middle, the lines that tell of errors, places and exits."""
    import re

    if len(text) <= most:
        return text
    middle = text[head:-tail].split("\n")
    telling = [x for x in middle if re.search(r"(?i)\b(?:error|fail(?:ed|ure)?|panic|exception|fatal|warning)\b|[\w./-]+\.\w+:\d+|exit (?:code|status) \d+", x)]
    room, kept = most - head - tail - 64, []
    for line in telling:
        if room < len(line) + 1:
            break
        room -= len(line) + 1
        kept.append(line)
    return f"{text[:head]}\n… {len(middle)} lines left out, {len(kept)} of them shown …\n" + "\n".join(kept) + f"\n{text[-tail:]}"
