"""Line dedup by winnowing over line hashes.

A text is the sequence of hashes of its lines that hold a word. From each line a window runs to the first line with
which it holds MIN_WORDS words, and likewise back from each line; in each window the line with the least hash is
selected (of lines with many words first, as short ones are common). Any run of lines with MIN_WORDS words or more
holds whole windows, and equal runs select equal lines at equal places: the guaranteed fingerprints.

Fingerprints that occur at one place only match nothing. The positions of all others are joined; around each, the
match is extended both ways over the windows that selected it, as far as the same window also stands at an earlier
place (by id, then line). Overlapping windows make one run. The later repeated runs, and only those, are deleted.
Windows are compared by a hash of all their lines, so a group of any size costs one row per place: no pairs.

`dedup_passages` does the same on words, wherever lines break: windows are all runs of MIN_WORDS words, and in each the
run of half as many words with the least hash is selected. What it finds holds all that `dedup_lines` finds, and the
passages that begin or end inside a line.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyloom.llm import _bytes as B
from tallyloom.llm._store import Workspace, dealt

MIN_WORDS = 50
MANY_WORDS = 8


def line_table(raw: np.ndarray, at: np.ndarray):
    """Of the lines that hold a word: start, end, hash, words, and the edges of the texts."""
    start, end, edges = B.lines(raw, at)
    ws, _, _ = B.words(raw, at)
    n = np.searchsorted(ws, end) - np.searchsorted(ws, start)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(edges))
    own = np.flatnonzero(n > 0)
    start, end, owner, n = start[own], end[own], owner[own], n[own]
    return start, end, B.Hasher(raw).spans(start, end) if len(start) else np.zeros(0, np.uint64), n, np.searchsorted(owner, np.arange(len(at)))


def text_windows(hashes: np.ndarray, words: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(first, end, selected) of all forward and backward windows of one text's lines, each once."""
    total = np.concatenate([[0], np.cumsum(words)])
    first = np.arange(len(hashes))
    end = np.searchsorted(total, total[:-1] + least, "left")
    forward = [(int(a), int(b)) for a, b in zip(first, end, strict=True) if b <= len(hashes)]
    begin = np.searchsorted(total, total[1:] - least, "right") - 1
    back = [(int(a), int(b)) for a, b in zip(begin, first + 1, strict=True) if total[b] - total[a] >= least]
    order = np.where(words >= MANY_WORDS, 0, 1)
    out = []
    for a, b in sorted({*forward, *back}):
        if b - a == 1:
            out.append((a, b, a))
            continue
        rank = order[a:b]
        inside = np.flatnonzero(rank == rank.min())
        out.append((a, b, a + int(inside[np.argmin(hashes[a:b][inside])])))
    return out


def lines_of(docs: DataFrame, doc_id: str, text: str, least: int) -> DataFrame:
    """doc_id, text_hash, hashes and words (of lines that hold a word), selected (hash of each fingerprint)."""

    def scan(batches):
        for batch in batches:
            for a, b, raw, at in B.in_slices(batch.column(2)):
                _, _, hashes, words, edges = line_table(raw, at)
                lists = [[], [], []]
                for i in range(b - a):
                    h, w = hashes[edges[i] : edges[i + 1]], words[edges[i] : edges[i + 1]]
                    picked = sorted({s for _, _, s in text_windows(h, w, least)}) if w.sum() >= least else []
                    lists[0].append(h.view(np.int64))
                    lists[1].append(w.astype(np.int32))
                    lists[2].append(h[picked].view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *(pa.array(x, pa.list_(k)) for x, k in zip(lists, (pa.int64(), pa.int32(), pa.int64()), strict=True))], names=["doc_id", "text_hash", "hashes", "words", "selected"])

    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(body).alias("text_hash"), body.alias("text"))
    return rows.mapInArrow(B.lean(scan), "doc_id long, text_hash long, hashes array<long>, words array<int>, selected array<long>")


def repeated_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = MIN_WORDS) -> DataFrame:
    """doc_id, text_hash, runs (first and end line, of the lines that hold a word) of the later repeated runs; texts without any are left out."""
    spark = docs.sparkSession
    space = Workspace(spark, "lines")
    key = ["doc_id", "text_hash"]
    lines = space.table(lines_of(docs, doc_id, text, least).dropDuplicates(key), "lines")
    marks = lines.select(*key, F.posexplode("selected").alias("i", "mark")).select(*key, "mark")
    # A fingerprint twice in one text counts as well, so marks are not distinct.
    often = space.table(marks.groupBy("mark").agg(F.count("*").alias("n")).where("n > 1"), "often")
    marks, often = dealt(marks, often, "mark", key)
    matched = marks.join(often, ["mark", "part"], "left_semi").groupBy(*key).agg(F.collect_set("mark").alias("marks"))
    candidates = lines.alias("l").join(matched.alias("m"), F.col("l.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("l.text_hash") == F.col("m.text_hash"))).select("l.doc_id", "l.text_hash", "hashes", "words", "marks")

    def scan(batches):
        for batch in batches:
            ids, keys, firsts, ends, wins = [], [], [], [], []
            for i in range(batch.num_rows):
                hashes = np.array(batch.column(2)[i].values, dtype=np.int64).view(np.uint64)
                words = np.array(batch.column(3)[i].values, dtype=np.int64)
                marks = np.array(batch.column(4)[i].values, dtype=np.int64).view(np.uint64)
                found = _matching(hashes, words, marks, least)
                if not found:
                    continue
                first, end = np.array(found).T
                total = B.Hasher(hashes.view(np.uint8)).spans(first * 8, end * 8)
                doc, text_hash = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                ids += [doc] * len(found)
                keys += [text_hash] * len(found)
                firsts.append(first)
                ends.append(end)
                wins.append(total.view(np.int64))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(np.concatenate(firsts), pa.int32()), pa.array(np.concatenate(ends), pa.int32()), pa.array(np.concatenate(wins), pa.int64())], names=[*key, "first", "end", "win"])

    wins = space.table(candidates.mapInArrow(B.lean(scan), "doc_id long, text_hash long, first int, end int, win long"), "windows")
    place = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_hash", "first")
    origin = space.table(wins.groupBy("win").agg(F.min(place).alias("origin"), F.count("*").alias("n")).where("n > 1"), "origins")
    wins, origin = dealt(wins, origin, "win", [*key, "first"])
    later = wins.join(origin, ["win", "part"]).where(place > F.col("origin"))
    spans = later.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("first", "end"))).alias("windows"))
    # Overlapping or touching windows make one run.
    return spans.select(*key, _merged("windows").alias("runs"))


def _matching(hashes, words, marks, least):
    ordered = np.sort(marks)
    windows = text_windows(hashes, words, least)
    at = np.minimum(np.searchsorted(ordered, hashes), len(ordered) - 1)
    has = ordered[at] == hashes
    return [(a, b) for a, b, s in windows if has[s]]


def _merged(windows: str):
    """Sorted windows, gathered to runs: a window begins a run if it starts after all that came before have ended."""
    kind = "struct<runs:array<struct<first:int,end:int>>,first:int,end:int>"
    start = F.struct(F.array().cast("array<struct<first:int,end:int>>").alias("runs"), F.lit(-1).alias("first"), F.lit(-1).alias("end")).cast(kind)

    def step(acc, w):
        grown = F.struct(acc["runs"].alias("runs"), acc["first"].alias("first"), F.greatest(acc["end"], w["end"]).alias("end"))
        closed = F.when(acc["first"] >= 0, F.concat(acc["runs"], F.array(F.struct(acc["first"].alias("first"), acc["end"].alias("end"))))).otherwise(acc["runs"])
        fresh = F.struct(closed.alias("runs"), w["first"].alias("first"), w["end"].alias("end"))
        return F.when((acc["first"] >= 0) & (w["first"] <= acc["end"]), grown).otherwise(fresh).cast(kind)

    return F.aggregate(windows, start, step, lambda acc: F.concat(acc["runs"], F.array(F.struct(acc["first"].alias("first"), acc["end"].alias("end")))))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = MIN_WORDS, keys: list[str] | None = None) -> DataFrame:
    """The key columns, n_lines, n_removed (lines that hold a word), runs, and text without the removed lines.

    Null texts count as empty. Lines without a word take no part; those between two removed lines go with them.
    The earliest place of a run stays: by id (nulls last), then hash of the text, then line. Rows with the same id and
    the same text share one fate. Within one text, later repeats go as well. An empty table gives no rows.
    """
    keys = keys or [doc_id]
    runs = repeated_runs(docs, doc_id, text, least)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(*keys, F.col(doc_id).cast("long").alias("__id"), F.xxhash64(body).alias("__hash"), body.alias("__text"))
    on = F.col("d.__id").eqNullSafe(F.col("r.doc_id")) & (F.col("d.__hash") == F.col("r.text_hash"))
    both = rows.alias("d").join(runs.alias("r"), on, "left").select(*[f"d.{k}" for k in keys], "r.runs", "d.__text")
    schema = docs.select(*keys).schema.add("n_lines", "long").add("n_removed", "long").add("removed", "string").add("text", "string")

    def scan(batches, n=len(keys)):
        for batch in batches:
            runs = batch.column(n).to_pylist()
            for a, b, raw, at in B.in_slices(batch.column(n + 1)):
                start, end, _, _, edges = line_table(raw, at)
                texts, gone, spans = [], [], []
                whole = raw.tobytes()
                for i in range(b - a):
                    body, own = whole[at[i] : at[i + 1]], runs[a + i] or []
                    removed, pieces, last = 0, [], 0
                    for r in own:
                        first, final = edges[i] + r["first"], edges[i] + r["end"] - 1
                        removed += r["end"] - r["first"]
                        pieces.append(body[last : start[first] - at[i]])
                        last = min(end[final] - at[i] + 1, len(body))  # with its line feed
                    pieces.append(body[last:])
                    kept = b"".join(pieces)
                    if own and last == len(body) and kept.endswith(b"\n"):
                        kept = kept[:-1]
                    texts.append(kept.decode())
                    gone.append(removed)
                    spans.append(",".join(f"{r['first']}:{r['end']}" for r in own))
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[:n]), pa.array(np.diff(edges), pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.string()), pa.array(texts, pa.string())], names=[*batch.schema.names[:n], "n_lines", "n_removed", "removed", "text"])

    return both.mapInArrow(B.lean(scan), schema)


def _sliding(x: np.ndarray, n: int, least) -> np.ndarray:
    """np.minimum or np.maximum of each run of n values."""
    out, span = x, 1
    while 2 * span <= n:
        out, span = least(out[:-span], out[span:]), 2 * span
    count = len(x) - n + 1
    return least(out[:count], out[n - span : n - span + count])


def _run_hashes(values: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n values."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * B._power_table("up", len(values)), out=sums[1:])
    count = len(values) - n + 1
    return B.mix((sums[n:] - sums[:count]) * B._power_table("down", count))


def word_windows(raw: np.ndarray, at: np.ndarray, least: int):
    """Words before each text, hashes of all words, the first word of each window of `least` words within one text, the
    hash that each window selects, and of all selected places the first word and the hash."""
    start, end, bounds = B.words(raw, at)
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(start) < least:
        return bounds, np.zeros(0, np.uint64), *none, *none
    words = B.Hasher(raw).spans(start, end)
    size = max(1, least // 2)
    grams = _run_hashes(words, size)
    span = least - size + 1
    selected = _sliding(grams, span, np.minimum)
    left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(len(words))
    inside = left[: len(selected)] >= least
    # A run is selected if it is the least of a window that holds it.
    edge = np.zeros(span - 1, np.uint64)
    places = np.flatnonzero(_sliding(np.concatenate([edge, np.where(inside, selected, np.uint64(0)), edge]), span, np.maximum) == grams)
    first = np.flatnonzero(inside)
    return bounds, words, first, selected[first], places, grams[places]


def _selected(docs: DataFrame, doc_id: str, text: str, least: int) -> DataFrame:
    """doc_id, text_hash, marks (hash of each fingerprint, as often as it is selected)."""

    def scan(batches):
        for batch in batches:
            for a, b, raw, at in B.in_slices(batch.column(2)):
                bounds, _, _, _, places, marks = word_windows(raw, at, least)
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(places, bounds), pa.int32()), pa.array(marks.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), lists], names=["doc_id", "text_hash", "marks"])

    return _keyed(docs, doc_id, text).mapInArrow(B.lean(scan), "doc_id long, text_hash long, marks array<long>")


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(body).alias("text_hash"), body.alias("text"))


def repeated_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = MIN_WORDS) -> DataFrame:
    """doc_id, text_hash, firsts (first word of each window that stands at an earlier place; null: all of them do, as an
    earlier document has the same text). Texts without any are left out."""
    space = Workspace(docs.sparkSession, "passages")
    key = ["doc_id", "text_hash"]
    texts = space.table(_selected(docs, doc_id, text, least).where(F.size("marks") > 0).dropDuplicates(key), "texts")
    # Of equal texts only the earliest is looked at: all windows of the others stand there.
    earliest = texts.groupBy("text_hash").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id")).alias("e"), F.count("*").alias("copies"))
    earliest = space.table(earliest.select("text_hash", F.col("e.doc_id").alias("own"), "copies"), "earliest")
    each, several = dealt(texts.select(*key), earliest.where("copies > 1"), "text_hash", ["doc_id"], "copies")
    copies = space.table(each.join(several, ["text_hash", "part"]).where(~F.col("doc_id").eqNullSafe(F.col("own"))).select(*key), "copies")
    own = earliest.select("text_hash", F.col("own").alias("doc_id"))
    alone = texts.alias("t").join(own.alias("o"), (F.col("t.text_hash") == F.col("o.text_hash")) & F.col("t.doc_id").eqNullSafe(F.col("o.doc_id")), "left_semi")
    marks = alone.select(*key, F.explode("marks").alias("mark"))
    often = space.table(marks.groupBy("mark").agg(F.count("*").alias("n")).where("n > 1"), "often")
    # A passage that stands in a third of all texts has its fingerprints dealt to many tasks, and below its windows.
    once = alone.select(*key, F.explode(F.array_distinct("marks")).alias("mark"))
    each, several = dealt(once, often, "mark", key)
    matched = space.table(each.join(several, ["mark", "part"], "left_semi").groupBy(*key).agg(F.collect_set("mark").alias("marks")), "matched")
    on = (F.col("d.text_hash") == F.col("m.text_hash")) & F.col("d.doc_id").eqNullSafe(F.col("m.doc_id"))
    candidates = _keyed(docs, doc_id, text).alias("d").join(matched.alias("m"), on).select("d.doc_id", "d.text_hash", "marks", "text")

    def scan(batches):
        for batch in batches:
            known = batch.column(2)
            for a, b, raw, at in B.in_slices(batch.column(3)):
                bounds, words, first, selected, _, _ = word_windows(raw, at, least)
                if not len(first):
                    continue
                owner = np.searchsorted(bounds, first, "right") - 1
                edges = np.searchsorted(owner, np.arange(b - a + 1))
                hit = np.zeros(len(first), bool)
                for i in range(b - a):
                    mine = np.sort(known[a + i].values.to_numpy(zero_copy_only=False)).view(np.uint64)
                    hit[edges[i] : edges[i + 1]] = np.isin(selected[edges[i] : edges[i + 1]], mine)
                first, owner = first[hit], owner[hit]
                rows = pa.array(a + owner)
                wins = _run_hashes(words, least)[first].view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array((first - bounds[owner]).astype(np.int32)), pa.array(wins)], names=[*key, "first", "win"])

    space.drop(texts, earliest, often)
    wins = space.table(candidates.mapInArrow(B.lean(scan), "doc_id long, text_hash long, first int, win long"), "windows")
    space.drop(matched)
    place = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_hash", "first")
    origins = space.table(wins.groupBy("win").agg(F.min(place).alias("origin"), F.count("*").alias("n")).where("n > 1"), "origins")
    each, several = dealt(wins, origins, "win", [*key, "first"])
    spans = space.table(each.join(several, ["win", "part"]).where(place > F.col("origin")).groupBy(*key).agg(F.collect_list("first").alias("firsts")), "spans")
    space.drop(wins, origins)
    return spans.unionByName(copies.withColumn("firsts", F.lit(None).cast("array<int>")))


def _cut(body: bytes, start: np.ndarray, end: np.ndarray, runs: list[tuple[int, int]]) -> bytes:
    """The text without runs of words. A line that loses all its words goes with its line feed; others keep their breaks."""
    pieces, last = [], 0
    for a, b in runs:
        before = int(end[a - 1]) if a else 0
        after = int(start[b]) if b < len(start) else len(body)
        head = body.rfind(b"\n", before, int(start[a])) + 1
        feed = body.find(b"\n", int(end[b - 1]), after)
        if head or not a:
            first, final = (max(head, before), feed + 1) if feed >= 0 else (int(start[a]), after)
        else:
            first, final = (before, feed) if feed >= 0 else (int(start[a]), after)
        pieces.append(body[last:first])
        last = final
    kept = b"".join([*pieces, body[last:]])
    return kept[:-1] if runs and last == len(body) and kept.endswith((b"\n", b" ")) else kept


def dedup_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = MIN_WORDS, keys: list[str] | None = None) -> DataFrame:
    """The key columns, n_lines (lines that hold a word), n_removed (those of them that lose all their words), removed
    (first and end word of each run), and text without the removed words.

    A word goes if a run of `least` words around it stands at an earlier place: by id (nulls last), then hash of the
    text, then word. White space between words does not count. Null texts count as empty. Rows with the same id and the
    same text share one fate. Within one text, later repeats go as well. An empty table gives no rows.
    """
    keys = keys or [doc_id]
    found = repeated_words(docs, doc_id, text, least).withColumn("found", F.lit(True))
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(*keys, F.col(doc_id).cast("long").alias("__id"), F.xxhash64(body).alias("__hash"), body.alias("__text"))
    on = F.col("d.__id").eqNullSafe(F.col("r.doc_id")) & (F.col("d.__hash") == F.col("r.text_hash"))
    both = rows.alias("d").join(found.alias("r"), on, "left").select(*[f"d.{k}" for k in keys], "r.found", "r.firsts", "d.__text")
    schema = docs.select(*keys).schema.add("n_lines", "long").add("n_removed", "long").add("removed", "string").add("text", "string")

    def scan(batches, n=len(keys)):
        for batch in batches:
            has, firsts = batch.column(n).to_pylist(), batch.column(n + 1)
            for a, b, raw, at in B.in_slices(batch.column(n + 2)):
                start, _, _, _, edges = line_table(raw, at)
                ws, we, bounds = B.words(raw, at)
                line = np.searchsorted(start, ws, "right") - 1
                whole = raw.tobytes()
                texts, gone, spans = [], np.zeros(b - a, np.int64), [""] * (b - a)
                for i in range(b - a):
                    body = whole[at[i] : at[i + 1]]
                    if has[a + i]:
                        own = slice(bounds[i], bounds[i + 1])
                        count = int(bounds[i + 1] - bounds[i])
                        if firsts[a + i].is_valid:
                            begin = np.unique(firsts[a + i].values.to_numpy(zero_copy_only=False).astype(np.int64))
                            new = np.append(True, begin[1:] > begin[:-1] + least)
                            final = begin[np.append(np.flatnonzero(new)[1:] - 1, len(begin) - 1)] + least
                            runs = list(zip(begin[new].tolist(), final.tolist(), strict=True))
                        else:
                            runs = [(0, count)]
                        left = np.ones(count, bool)
                        for x, y in runs:
                            left[x:y] = False
                        gone[i] = edges[i + 1] - edges[i] - len(np.unique(line[own][left]))
                        spans[i] = ",".join(f"{x}:{y}" for x, y in runs)
                        body = _cut(body, ws[own] - at[i], we[own] - at[i], runs)
                    texts.append(body.decode())
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[:n]), pa.array(np.diff(edges), pa.int64()), pa.array(gone), pa.array(spans, pa.string()), pa.array(texts, pa.string())], names=[*batch.schema.names[:n], "n_lines", "n_removed", "removed", "text"])

    return both.mapInArrow(B.lean(scan), schema)
