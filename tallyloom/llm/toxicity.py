"""Toxicity by cumulative-link ordinal regression on sparse text features.

Features are the words of a text (runs of letters, ASCII in lower case) and their beginnings of PREFIXES bytes,
hashed. A word's value is log2(1 + count). That of a beginning is log2(count), and less where it makes up under half a
percent of the words: beginnings are shared with other words, so that one alone, or a few in a long text, say nothing.
Features that few toxic texts of the sample have, or other texts hardly less often, are left out, and so are near
copies in the sample. The labels tell toxic from not; the grades are made from them: 0 not toxic, 1 and 2 toxic, 2 where the features that a first
estimate by log-odds ties to toxic texts weigh more than in the median toxic text. One weight vector is shared
by both ordered thresholds; the result is the expected grade, sum over j of P(grade > j). The training sample is
bounded (TRAIN_ROWS and TRAIN_CHARS, taken by hash of the id).

What is validated on held-out labels is P(grade > 0), toxic or not. The order within toxic texts is the model's own measure
(how much of a text is of the kind that toxic texts have); no graded labels exist to hold it against.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyloom.llm import _bytes as B
from tallyloom.llm._linear import Rows, fit_ordinal, sigmoid
from tallyloom.llm._store import Workspace
from tallyloom.llm.quality import TRAIN_CHARS, labelled, trained

TRAIN_ROWS = 3000
BITS = 18
PREFIXES = (6, 7, 8)
SHARE = 0.005
LEAST_ODDS = 1.0  # log-odds of a feature for toxic texts, from which it is used
GRADES = 3
TOXIC_AT = 0.35  # of P(grade > 0); the ridge draws it towards the middle

NOT_LETTER = np.ones(256, bool)
NOT_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def features(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and value of each text's distinct features, and the edges of the texts."""
    low = LOWER[raw]
    start, end, bounds = B.words(low, at, NOT_LETTER)
    hasher = B.Hasher(low)
    n = np.diff(bounds)
    owner = np.repeat(np.arange(len(n)), n)
    hashes, owners = [hasher.spans(start, end)], [owner]
    for k in PREFIXES:
        long = end - start > k
        hashes.append(B.mix(hasher.spans(start[long], start[long] + k) + np.uint64(k)))
        owners.append(owner[long])
    # The last bit tells beginnings from words.
    buckets = [(h >> np.uint64(64 - BITS)).astype(np.int64) & ~1 | (i > 0) for i, h in enumerate(hashes)]
    pairs, counts = np.unique(np.concatenate(owners).astype(np.int64) << BITS | np.concatenate(buckets), return_counts=True)
    text = pairs >> BITS
    share = np.minimum(1.0, counts / np.maximum(n[text], 1) / SHARE)
    value = np.where(pairs & 1, np.log2(counts) * share, np.log2(1.0 + counts))
    several = value > 0
    pairs, text, value = pairs[several], text[several], value[several]
    return (pairs & ((1 << BITS) - 1)).astype(np.int32), value, np.searchsorted(text, np.arange(len(n) + 1))


class Model:
    """The shared weights and the ordered thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def above(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """P(grade > j) of each text, a column for each threshold."""
        buckets, value, edges = features(raw, at)
        total = np.zeros(len(buckets) + 1)
        np.cumsum(self.weights[buckets] * value, out=total[1:])
        return sigmoid((total[edges[1:]] - total[edges[:-1]])[:, None] - self.thresholds[None, :])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> Model | None:
    """Fitted on a sample of at most `rows` labelled documents, and of those, by hash of the id, the first that hold `chars`
    characters together. None if the sample lacks toxic or other texts."""
    return trained(labelled(docs, labels, "toxic", rows), fit, chars)


def one_of_each(texts: list[str]) -> list[int]:
    """Places of the texts that share none of two minima of five-word hashes with an earlier one: near copies would teach the words of one text as those of many."""
    seen, out, k = set(), [], 0
    for _, _, raw, at in B.in_slices(pa.array(texts, pa.string())):
        start, end, bounds = B.words(raw, at)
        values, owner = B.shingles(B.Hasher(raw).spans(start, end), bounds)
        for i in range(len(at) - 1):
            own = values[owner == i]
            keys = {int(own.min()), int(B.mix(own).min())} if len(own) else {k}
            if not keys & seen:
                out.append(k)
            seen |= keys
            k += 1
    return out


def fit(texts: list[str], toxic: np.ndarray) -> Model | None:
    if not 0 < toxic.sum() < len(toxic):
        return None
    own = one_of_each(texts)
    texts, toxic = [texts[i] for i in own], toxic[own]
    size = 1 << BITS
    rows_, values = [], []
    for _, _, raw, at in B.in_slices(pa.array(texts, pa.string())):
        buckets, value, edges = features(raw, at)
        for i in range(len(at) - 1):
            rows_.append(buckets[edges[i] : edges[i + 1]])
            values.append(value[edges[i] : edges[i + 1]])
    counts = np.zeros((2, size))
    for own, y in zip(rows_, toxic.astype(int), strict=True):
        counts[y, own] += 1
    n = np.array([(toxic == 0).sum(), (toxic == 1).sum()])[:, None]
    odds = np.log((counts[1] + 0.5) / (n[1] + 1)) - np.log((counts[0] + 0.5) / (n[0] + 1))
    known = (counts[1] >= max(3, 0.01 * n[1, 0])) & (odds > LEAST_ODDS)
    tied = known & (odds > 2)
    x, weight = Rows(), np.zeros(len(toxic))
    for i, (own, value) in enumerate(zip(rows_, values, strict=True)):
        x.add(own[known[own]], value[known[own]])
        weight[i] = value[tied[own]].sum()
    grade = toxic.astype(int)
    grade[(toxic == 1) & (weight > np.median(weight[toxic == 1]))] = 2
    return Model(*fit_ordinal(x, grade, size, GRADES))


def score(docs: DataFrame, model: Model | None, keys: list[str], text: str = "text", toxic_at: float = TOXIC_AT) -> DataFrame:
    """The key columns with severity (expected grade, 0 to 2), p_toxic (P(grade > 0)) and toxic.

    Null, empty and wordless texts have the model's score of no feature. Without a model all are null. Repeated
    rows are answered one by one. An empty table gives no rows.
    """
    spark = docs.sparkSession
    Workspace(spark, "toxicity")
    shared = spark.sparkContext.broadcast(model)
    schema = docs.select(*keys).schema.add("severity", "double").add("p_toxic", "double").add("toxic", "boolean")

    def scan(batches, n=len(keys)):
        model = shared.value
        for batch in batches:
            for a, b, raw, at in B.in_slices(batch.column(n)):
                if model is None:
                    more = [pa.nulls(b - a, pa.float64()), pa.nulls(b - a, pa.float64()), pa.nulls(b - a, pa.bool_())]
                else:
                    p = model.above(raw, at)
                    more = [pa.array(p.sum(1)), pa.array(p[:, 0]), pa.array(p[:, 0] >= toxic_at)]
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[:n]), *more], names=[*batch.schema.names[:n], "severity", "p_toxic", "toxic"])

    return docs.select(*keys, F.col(text).cast("string").alias("__text")).mapInArrow(B.lean(scan), schema)
