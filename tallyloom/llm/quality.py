"""Quality rules: base counts of each text, and a calibrated classifier on hashed word and character n-grams.

The classifier is a logistic regression on the relative frequencies of hashed word 1- and 2-grams and of
hashed character (code point) 4-grams, trained on the labelled rows (a bounded sample of them: TRAIN_ROWS and
TRAIN_CHARS, taken by hash) and calibrated by Platt scaling on a held-out fold. Documents are scored in Arrow batches; a document is
rejected if the base rules fail or the calibrated probability of low quality reaches REJECT_AT.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyloom.llm import _bytes as B
from tallyloom.llm._linear import Rows, fit_logistic, platt
from tallyloom.llm._store import Workspace

TRAIN_ROWS = 3000
TRAIN_CHARS = 32 << 20  # characters of the sample's texts; the row that reaches them is the last
REJECT_AT = 0.5
BITS = 14
SYMBOLS = np.zeros(256, np.int64)
SYMBOLS[np.frombuffer(b"#*$%&|<>", np.uint8)] = 1
LEAD = np.ones(256, np.int64)  # bytes that begin a code point
LEAD[0x80:0xC0] = 0
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, values.dtype if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[edges[1:]] - total[edges[:-1]]


def _twice(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks of the values that occur more than once, and of those that an equal one precedes."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    same = ordered[1:] == ordered[:-1]
    more, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    more[order[1:]] |= same
    more[order[:-1]] |= same
    later[order[1:]] = same
    return more, later


class Text:
    """What both the counts and the features need of a slice of texts."""

    def __init__(self, raw: np.ndarray, at: np.ndarray):
        self.raw, self.at = raw, at
        self.start, self.end, self.bounds = B.words(raw, at)
        self.hasher = B.Hasher(raw)
        self.hashes = self.hasher.spans(self.start, self.end)

    def counts(self) -> dict[str, np.ndarray]:
        raw, at, bounds = self.raw, self.at, self.bounds
        salt = B.mix(np.arange(len(at) - 1, dtype=np.uint64))
        lead = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(LEAD[raw], out=lead[1:])
        chars = lead[self.end] - lead[self.start]
        start, end, edges = B.lines(raw, at)
        filled = np.searchsorted(self.start, end) > np.searchsorted(self.start, start)
        owner = np.repeat(np.arange(len(at) - 1), np.diff(edges))
        later = np.zeros(len(start), bool)
        own = np.flatnonzero(filled)
        later[own] = _twice(self.hasher.spans(start[own], end[own]) ^ salt[owner[own]])[1]
        runs, first = B.windows(self.hashes, bounds, 8)
        covered = np.zeros(len(self.hashes) + 1, np.int64)
        again = first[_twice(runs ^ salt[np.searchsorted(bounds, first, "right") - 1])[0]] if len(first) else first
        np.add.at(covered, again, 1)
        np.add.at(covered, again + 8, -1)
        repeated = (np.cumsum(covered)[:-1] > 0).astype(np.int64)
        return {
            "n_words": np.diff(bounds), "word_chars": _sums(chars, bounds), "n_symbols": _sums(SYMBOLS[raw], at),
            "n_dup_lines": _sums(later.astype(np.int64), edges), "n_repeat_words": _sums(repeated, bounds),
        }

    def features(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """(bucket of each n-gram, edges by text) for words, word pairs and code point 4-grams."""
        bits = np.uint64(64 - BITS)
        word = (self.hashes >> bits).astype(np.int32)
        pair, first = B.windows(self.hashes, self.bounds, 2)
        pair_edges = np.searchsorted(first, self.bounds)
        out = [(word, self.bounds), ((pair >> bits).astype(np.int32) + (1 << BITS), pair_edges)]
        points = np.frombuffer(self.raw.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
        if len(points) >= 4:
            lead = np.zeros(len(self.raw) + 1, np.int64)
            np.cumsum(LEAD[self.raw], out=lead[1:])
            at = lead[self.at]
            gram = points[3:].copy()
            for j in (2, 1, 0):
                gram = gram * np.uint32(0x01000193) + points[j : len(points) - 3 + j]
            gram = ((gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int32) + (2 << BITS)
            begins = np.minimum(at[:-1], len(gram))
            out.append((gram, (begins, np.maximum(np.minimum(at[1:] - 3, len(gram)), begins))))
        return out


def _means(weights: np.ndarray, grams: np.ndarray, edges) -> np.ndarray:
    begins, ends = edges if isinstance(edges, tuple) else (edges[:-1], edges[1:])
    total = np.zeros(len(grams) + 1)
    np.cumsum(weights[grams], out=total[1:])
    return (total[ends] - total[begins]) / np.maximum(ends - begins, 1)


class Model:
    """Weights over all buckets, an intercept, and the two numbers of the calibration."""

    def __init__(self, weights: np.ndarray, intercept: float, slope: float, shift: float):
        self.weights, self.intercept, self.slope, self.shift = weights, intercept, slope, shift

    def bad(self, text: Text) -> np.ndarray:
        """Calibrated probability of low quality."""
        z = np.full(len(text.at) - 1, self.intercept)
        for grams, edges in text.features():
            z += _means(self.weights, grams, edges)
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -30, 30)))


def _sparse(texts: list[str]) -> Rows:
    rows = Rows()
    for _, _, raw, at in B.in_slices(pa.array(texts, pa.string())):
        features = Text(raw, at).features()
        for i in range(len(at) - 1):
            index, value = [], []
            for grams, edges in features:
                a, b = (edges[0][i], edges[1][i]) if isinstance(edges, tuple) else (edges[i], edges[i + 1])
                if b > a:
                    bucket, n = np.unique(grams[a:b], return_counts=True)
                    index.append(bucket)
                    value.append(n / (b - a))
            rows.add(np.concatenate(index) if index else np.zeros(0, int), np.concatenate(value) if value else np.zeros(0))
    return rows


def labelled(docs: DataFrame, labels: DataFrame, target: str, rows: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """t and y (text and label) of a sample of at most `rows` labelled documents: of each of the labels 0 and 1, half as many with the lowest hash of their id."""
    known = labels.select(F.col(doc_id).alias("id"), F.col(target).cast("int").alias("y")).where("id is not null and y is not null").groupBy("id").agg(F.min("y").alias("y"))
    chosen = None
    for y in (0, 1):
        some = known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(rows // 2)
        chosen = some if chosen is None else chosen.unionByName(some)
    got = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("t")).where("t is not null").join(F.broadcast(chosen), "id")
    return got.groupBy("id", "y").agg(F.min("t").alias("t"))


def trained(sample: DataFrame, fit, chars: int = TRAIN_CHARS):
    """fit(texts, labels), run as one task over the bounded sample in the order of the ids' hash, so that the driver
    needs no memory for it; only the model comes back. Texts after the one with which the sample holds `chars` characters
    are not used."""

    def run(batches):
        texts, y, size = [], [], 0
        for batch in batches:
            for t, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if size <= chars:
                    texts.append(t)
                    y.append(label)
                    size += len(t)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(texts, np.array(y, float)))], pa.binary())], names=["model"])

    Workspace(sample.sparkSession, "train")
    one = sample.repartition(1).sortWithinPartitions(F.xxhash64("id"), "id").select("t", "y")
    got = one.mapInArrow(B.lean(run), "model binary").first()
    return pickle.loads(got.model) if got else None


def fit(texts: list[str], quality: np.ndarray) -> Model | None:
    """A fifth of the texts is held out for the calibration. Where that fold or the rest lacks a class (a handful of labels), the
    weights are fitted on all and calibrated on the same texts, so that the probabilities are too sure of themselves."""
    bad = (quality == 0).astype(float)
    if not 0 < bad.sum() < len(bad):
        return None
    x = _sparse(texts)
    fold = np.arange(len(bad)) % 5 == 0
    if not 0 < bad[fold].sum() < fold.sum() or not 0 < bad[~fold].sum() < (~fold).sum():
        fold[:] = True
        w, b = fit_logistic(x, bad, 3 << BITS)
    else:
        w, b = fit_logistic(x.take(~fold), bad[~fold], 3 << BITS)
    slope, shift = platt(x.take(fold).dot(w) + b, bad[fold])
    return Model(w.astype(np.float32), b, slope, shift)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> Model | None:
    """The model of low quality (labels.quality = 0), fitted on a sample of at most `rows` labelled documents, and of those,
    by hash of the id, the first that hold `chars` characters together. None if the sample lacks either class."""
    return trained(labelled(docs, labels, "quality", rows), fit, chars)


def _verdict(counts: dict, bad: np.ndarray | None, reject_at: float) -> tuple[np.ndarray, np.ndarray]:
    failed = (counts["n_words"] < 20) | (100 * counts["n_repeat_words"] > 30 * counts["n_words"])
    kept = ~failed if bad is None else ~failed & (bad < reject_at)
    return failed, kept


def score(docs: DataFrame, model: Model | None, keys: list[str], text: str = "text", reject_at: float = REJECT_AT, only_kept: bool = False) -> DataFrame:
    """The key columns with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, p_low and kept.

    Null texts count as empty; texts without a word fail the base rules. Without a model (no labelled rows of
    both classes) p_low is null and the base rules decide alone. Repeated rows are answered one by one.
    """
    spark = docs.sparkSession
    Workspace(spark, "quality")
    shared = spark.sparkContext.broadcast(model)
    schema = docs.select(*keys).schema
    if not only_kept:
        for name in COUNTS:
            schema = schema.add(name, "long")
        schema = schema.add("base_failed", "boolean").add("p_low", "double").add("kept", "boolean")

    at = keys.index(text) if text in keys and docs.schema[text].dataType.simpleString() == "string" else len(keys)

    def scan(batches, n=len(keys)):
        model = shared.value
        for batch in batches:
            parts: dict[str, list] = {name: [] for name in (*COUNTS, "base_failed", "p_low", "kept")}
            for _, _, raw, edges in B.in_slices(batch.column(at)):
                t = Text(raw, edges)
                counts = t.counts()
                bad = None if model is None else model.bad(t)
                failed, kept = _verdict(counts, bad, reject_at)
                for name, value in (*counts.items(), ("base_failed", failed), ("kept", kept), ("p_low", np.full(len(edges) - 1, np.nan) if bad is None else bad)):
                    parts[name].append(value)
            if not parts["kept"]:
                continue
            columns = {k: np.concatenate(v) for k, v in parts.items()}
            keep = batch.columns[:n]
            if only_kept:
                mask = pa.array(columns["kept"])
                yield pa.RecordBatch.from_arrays(keep, names=batch.schema.names[:n]).filter(mask)
            else:
                more = [pa.array(columns[c], pa.int64()) for c in COUNTS]
                more += [pa.array(columns["base_failed"]), pa.array(columns["p_low"], mask=np.isnan(columns["p_low"])), pa.array(columns["kept"])]
                yield pa.RecordBatch.from_arrays([*keep, *more], names=[*batch.schema.names[:n], *COUNTS, "base_failed", "p_low", "kept"])

    more = [F.col(text).cast("string").alias("__text")] if at == len(keys) else []
    return docs.select(*keys, *more).mapInArrow(B.lean(scan), schema)


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", rows: int = TRAIN_ROWS) -> DataFrame:
    """The documents that are kept, with all their columns."""
    names = docs.columns
    columns = [f"c{i}" for i in range(len(names))]
    model = train(docs, labels, rows)
    return score(docs.toDF(*columns), model, columns, text=columns[names.index(text)], only_kept=True).toDF(*names)
