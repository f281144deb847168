"""Near-duplicate classes by DartMinHash over word shingles.

A text is a weighted set: its five-word shingles, each with its number of occurrences. The similarity is the
weighted Jaccard similarity, 0.8 or more by default (the plain one where no shingle repeats). Darts are thrown
at the region of every element (shingle, unit of weight): their ranks are a Poisson process seeded by the
element's hash, and each dart is hashed to one of K coordinates. Only darts below a rank that leaves about
K (ln K + 3) of them per text are made, so that a long text costs hardly more than a short one. The earliest
dart of each coordinate is the signature; two texts agree in a coordinate with their similarity's probability.
BANDS bands of ROWS coordinates find a pair at 0.8 with probability 0.9999.

Exact copies are one node (by md5 of the text). In each band bucket the members are first compared with one member,
which keeps the pairs in proportion to the members. A bucket whose members then lie in several classes is open. For a
link between two classes, a member must share at least that similarity's part of its own weight with other classes'
members of open buckets: those that don't are certain to have no such link and leave, which empties large groups of
loosely similar texts, as these differ from all others by shingles of their own. The others are compared with the
bucket's most central member, whose shingles are the most common. What then is left is compared with all that share one
of its rarest shingles (a prefix filter, which is exact), so that no link between classes is lost. All comparisons are exact, on the sorted shingle hashes. Classes are the connected components
of the verified links, found by minimum labels with pointer jumping over written tables.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from tallyloom.llm import _bytes as B
from tallyloom.llm._store import Workspace, dealt, each_part, in_parts, parted

BANDS, ROWS = 24, 5
K = BANDS * ROWS
STARS = 1  # rounds of comparison with the most central member of each open bucket
SHINGLE = 5
SEEN = 50_000  # texts that a worker remembers, so that it makes the signature of a copy only once
SIMILARITY = 0.8


def darts(values: np.ndarray, owner: np.ndarray, n: int, k: int = K) -> np.ndarray:
    """Signature (n texts, k coordinates) of the elements `values` (hashes, repeated by weight) of texts `owner`."""
    signature = np.zeros((n, k), np.uint64)
    size = np.bincount(owner, minlength=n)
    columns = _columns(values, owner)
    bound = np.where(size > 0, k * (np.log(k) + 3.0) / np.maximum(size, 1), 0.0)
    todo = size > 0
    while todo.any():
        mine = todo[owner]
        column, text = columns[mine], owner[mine]
        rank = np.zeros(len(column))
        at, ranks, ids = [], [], []
        level = 0
        while len(column):
            level += 1
            draw = B.mix(column + np.uint64(level * 0xA0761D6478BD642F & (1 << 64) - 1))
            rank = rank - np.log(B.unit(draw))
            live = rank <= bound[text]
            column, text, rank, draw = column[live], text[live], rank[live], draw[live]
            dart = B.mix(draw ^ np.uint64(0xE7037ED1A0B428DB))
            at.append(text * k + (dart % np.uint64(k)).astype(np.int64))
            ranks.append(rank)
            ids.append(dart)
        at, ranks, ids = np.concatenate(at), np.concatenate(ranks), np.concatenate(ids)
        first = np.full(n * k, np.inf)
        np.minimum.at(first, at, ranks)
        won = ranks == first[at]
        flat = signature.reshape(-1)
        flat[at[won]] = ids[won]
        filled = np.isfinite(first).reshape(n, k).all(1)
        todo &= ~filled
        bound = bound * 2  # texts with an empty coordinate are thrown at again, further
    return signature


def _columns(values: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """A hash for each unit of weight: of the element and which occurrence in its text it is."""
    key = values ^ B.mix(owner.astype(np.uint64))
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    new = np.append(True, ordered[1:] != ordered[:-1])
    begin = np.flatnonzero(new)
    nth = np.arange(len(key)) - np.repeat(begin, np.diff(np.append(begin, len(key))))
    out = np.empty(len(key), np.uint64)
    out[order] = B.mix(values[order] + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    out = np.zeros((len(signature), BANDS), np.uint64)
    for r in range(ROWS):
        out = B.mix(out * np.uint64(B.BASE) + signature[:, r::ROWS][:, :BANDS])
    return B.mix(out + np.arange(BANDS, dtype=np.uint64)[None, :])


def weighted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(values, return_counts=True)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sorted weighted sets."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    if not len(a[0]):
        return 0.0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    same = b[0][at] == a[0]
    both = int(np.minimum(a[1][same], b[1][at[same]]).sum())
    return both / (int(a[1].sum()) + int(b[1].sum()) - both)


def _grams(raw: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    start, end, bounds = B.words(raw, at)
    return B.shingles(B.Hasher(raw).spans(start, end), bounds, k)


def signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE) -> DataFrame:
    """id, node (md5 of the text) and bands of every document; a worker makes the bands of equal texts once, they are null for the rest."""

    def scan(batches):
        seen: set[bytes] = set()
        for batch in batches:
            nodes = batch.column(1).to_pylist()
            fresh = []
            for i, node in enumerate(nodes):
                if node not in seen:
                    fresh.append(i)
                    seen.add(node)
            if len(seen) > SEEN:
                seen.clear()
            out: list = [None] * batch.num_rows
            for a, b, raw, at in B.in_slices(batch.column(2).take(pa.array(fresh, pa.int64()))):
                values, owner = _grams(raw, at, k)
                found = bands(darts(values, owner, b - a)).view(np.int64)
                has = np.bincount(owner, minlength=b - a) > 0
                for j in np.flatnonzero(has):
                    out[fresh[a + j]] = found[j]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int64()))], names=["id", "node", "bands"])

    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.unhex(F.md5(body)).alias("node"), body.alias("text"))
    return rows.mapInArrow(B.lean(scan), "id long, node binary, bands array<long>")


def _shingle_table(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str, k: int) -> DataFrame:
    """node, grams, counts of one document of each wanted node (node, rep)."""

    def scan(batches):
        for batch in batches:
            for a, b, raw, at in B.in_slices(batch.column(1)):
                values, owner = _grams(raw, at, k)
                order = np.argsort(owner, kind="stable")
                values, edges = values[order], np.searchsorted(owner[order], np.arange(b - a + 1))
                sets = [weighted(values[edges[i] : edges[i + 1]]) for i in range(b - a)]
                grams = pa.array([s[0].view(np.int64) for s in sets], pa.list_(pa.int64()))
                counts = pa.array([None if (s[1] == 1).all() else s[1].astype(np.int32) for s in sets], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), grams, counts], names=["node", "grams", "counts"])

    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.unhex(F.md5(body)).alias("node"), body.alias("text"))
    on = (F.col("r.node") == F.col("w.node")) & F.col("r.id").eqNullSafe(F.col("w.rep"))
    return rows.alias("r").join(wanted.alias("w"), on, "left_semi").select("node", "text").mapInArrow(B.lean(scan), "node binary, grams array<long>, counts array<int>").dropDuplicates(["node"])


def _verified(pairs: DataFrame, shingles: DataFrame, least: float) -> DataFrame:
    """pairs (a, b) with linked: whether they reach the similarity."""
    left = shingles.select(F.col("node").alias("a"), F.col("grams").alias("ga"), F.col("counts").alias("ca"))
    right = shingles.select(F.col("node").alias("b"), F.col("grams").alias("gb"), F.col("counts").alias("cb"))

    def one(grams, counts):
        values = grams.values.to_numpy(zero_copy_only=False).view(np.uint64)
        return values, np.ones(len(values), np.int64) if counts.values is None else counts.values.to_numpy(zero_copy_only=False).astype(np.int64)

    def scan(batches):
        for batch in batches:
            ga, ca, gb, cb = (batch.column(i) for i in range(2, 6))
            out = [similarity(one(ga[i], ca[i]), one(gb[i], cb[i])) >= least - 1e-12 for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.bool_())], names=["a", "b", "linked"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "ga", "ca", "gb", "cb").mapInArrow(B.lean(scan), "a binary, b binary, linked boolean")


def components(space: Workspace, edges: DataFrame) -> DataFrame:
    """node, label: the least node of each node's connected component, for the nodes of `edges` (a, b)."""
    both = space.table(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    first = space.table(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select(F.col("a").alias("node"), F.least("a", "m").alias("label"), "n"), "labels")
    # A node with many links has them dealt to several tasks.
    labels = in_parts(first, "n").select("node", "label", "parts")
    spread = space.table(parted(both, labels.where("parts > 1").select(F.col("node").alias("b"), "parts"), "b", ["a"]).select("a", "b", "part"), "dealt")
    space.drop(both)
    labels._tallyloom_path = first._tallyloom_path
    while True:
        at = labels.select(F.col("node").alias("b"), "label", each_part(F.col("parts")).alias("part"))
        near = spread.join(at, ["b", "part"]).groupBy("a").agg(F.min("label").alias("m")).withColumnRenamed("a", "node")
        hooked = labels.join(near, "node").select("node", "parts", F.col("label").alias("old"), F.least("label", "m").alias("to"))
        up = labels.select(F.col("node").alias("to"), F.col("label").alias("top"))
        step = space.table(hooked.join(up, "to").select("node", "parts", "old", F.least("to", "top").alias("label")), "labels")
        changed = step.where("old != label").limit(1).count()
        space.drop(labels)
        labels = step.select("node", "label", "parts")
        labels._tallyloom_path = step._tallyloom_path
        if not changed:
            space.drop(spread)
            out = labels.select("node", "label")
            out._tallyloom_path = labels._tallyloom_path
            return out


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id, class_size (rows) of every document; class_id is the least doc_id of the class.

    Equal texts are one class, also without a word; null counts as the empty text. A text of one to four words is a
    single shingle. Null ids are in a class as any other, with class_id null if all its ids are. Repeated rows are
    all returned. An empty table gives no rows.
    """
    sigs, by_node = _classed(docs, doc_id, text, k, least)
    return sigs.select("id", "node").join(by_node.drop("keep"), "node").select(F.col("id").alias(doc_id), "class_id", "class_size")


def _classed(docs: DataFrame, doc_id: str, text: str, k: int, least: float) -> tuple[DataFrame, DataFrame]:
    """The signatures; and node, class_id, class_size and keep (the node of the class that has the least id, null ids last) of every node."""
    spark = docs.sparkSession
    space = Workspace(spark, "near")
    sigs = space.table(signatures(docs, doc_id, text, k), "signatures")
    nodes = space.table(sigs.groupBy("node").agg(F.min("id").alias("rep"), F.first("bands", ignorenulls=True).alias("bands"), F.count("*").alias("n")), "nodes")
    links = _links(space, docs, nodes, doc_id, text, k, least)
    named = nodes.select("node", "rep", "n")
    if links is None:
        return sigs, named.select("node", F.col("rep").alias("class_id"), F.col("n").alias("class_size"), F.col("node").alias("keep"))
    labels = components(space, links)
    own = named.join(labels, "node", "left").select("node", "rep", "n", F.coalesce("label", "node").alias("label"))
    first = F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "node"))
    of = own.groupBy("label").agg(first.alias("f"), F.sum("n").alias("class_size")).select("label", "class_size", F.col("f.rep").alias("class_id"), F.col("f.node").alias("keep"))
    return sigs, own.join(of, "label").select("node", "class_id", "class_size", "keep")


def _links(space: Workspace, docs: DataFrame, nodes: DataFrame, doc_id: str, text: str, k: int, least: float) -> DataFrame | None:
    """All links (a, b) that are needed to connect what is similar, or None if there are none."""
    spread = nodes.where("bands is not null").select("node", F.explode("bands").alias("key"))
    buckets = space.table(spread.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("center")).where("size > 1"), "buckets")
    # The members of a large bucket are dealt to several tasks, here and in all later joins by key.
    each, several = dealt(spread, buckets, "key", ["node"], "size")
    members = space.table(each.join(several.drop("size"), ["key", "part"]), "members")
    space.drop(buckets)
    pairs = space.table(members.where("node != center").select(F.least("node", "center").alias("a"), F.greatest("node", "center").alias("b")).distinct(), "pairs")
    if not pairs.limit(1).count():
        return None
    wanted = members.select("node").distinct().join(nodes.select("node", "rep"), "node")
    shingles = space.table(_shingle_table(docs, wanted, doc_id, text, k), "shingles")
    checked = space.table(_verified(pairs, shingles, least), "checked")
    open_ = members
    for turn in range(STARS + 1):
        labels = components(space, checked.where("linked"))
        owned = open_.select("key", "part", "parts", "node").join(labels, "node", "left").select("key", "part", "parts", "node", F.coalesce("label", "node").alias("label"))
        mixed = owned.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max("parts").alias("parts")).where("lo != hi")
        open_ = space.table(owned.join(mixed.select("key", each_part(F.col("parts")).alias("part")), ["key", "part"], "left_semi"), "open")
        space.drop(labels)
        if not open_.limit(1).count():
            break
        grams, able = _shared_grams(space, open_, shingles, least)
        if turn < STARS:
            rest = open_.join(able, "node")
            one = F.struct(F.col("node").alias("a"), F.col("label").alias("la"), F.col("weight").alias("wa"), F.col("common").alias("ca"))
            centers = rest.groupBy("key").agg(F.max(F.struct("central", one.alias("one"))).alias("m"), F.max("parts").alias("parts")).select("key", each_part(F.col("parts")).alias("part"), "m.one.*")
            # What two members share is no more than what either shares with other classes.
            near = (F.col("la") != F.col("label")) & (F.least("ca", "common") >= least / (1 + least) * (F.col("wa") + F.col("weight")) - 1e-9)
            pairs = rest.join(centers, ["key", "part"]).where(near).select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b"))
        else:
            pairs = _left_pairs(grams, able, least)
        fresh = space.table(pairs.distinct().join(checked, ["a", "b"], "left_anti"), "pairs")
        if fresh.limit(1).count():
            checked = space.table(checked.unionByName(_verified(fresh, shingles, least)), "checked")
    space.drop(shingles, members)
    return checked.where("linked").select("a", "b")


def _shared_grams(space: Workspace, open_: DataFrame, shingles: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(node, label, gram, w and df of the shingles that several classes have; node, weight, common (what it shares
    with other classes) and central (how common its shingles are) of those members that share enough)."""
    nodes = open_.select("node", "label").distinct()
    grams = nodes.join(shingles, "node").select("node", "label", F.posexplode("grams").alias("i", "gram"), "counts")
    grams = space.table(grams.select("node", "label", "gram", F.coalesce(F.element_at("counts", F.col("i") + 1), F.lit(1)).alias("w")), "grams")
    shared = grams.groupBy("gram").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("df")).where("lo != hi").select("gram", "df")
    shared = space.table(shared, "shingles-df")
    weights = grams.groupBy("node").agg(F.sum("w").alias("weight"))
    each, several = dealt(grams, shared, "gram", ["node"], "df")
    met = space.table(each.join(several, ["gram", "part"]).select("gram", "node", "label", "w", "df"), "shared")
    common = met.groupBy("node").agg(F.sum("w").alias("common"), F.sum(F.col("w") * F.log2("df")).alias("central"))
    enough = common.join(weights, "node").where(F.col("common") >= least * F.col("weight") - 1e-9)
    able = space.table(enough.select("node", "weight", "common", (F.col("central") / F.col("weight")).alias("central")), "able")
    space.drop(grams, shared)
    return met, able


def _left_pairs(grams: DataFrame, able: DataFrame, least: float) -> DataFrame:
    """All pairs of different classes that can reach the similarity, by a prefix filter.

    A text's shingles are taken from the rarest on. If the first that both texts have comes after a weight of W in one of
    them, they share no more than the rest of it; so only the rare beginning of the less central text is looked up.
    """
    rows = grams.join(able, "node")
    order = W.partitionBy("node").orderBy("df", "gram").rowsBetween(W.unboundedPreceding, 0)
    ranked = rows.withColumn("after", F.col("common") - F.sum("w").over(order) + F.col("w")).where(F.col("after") >= least * F.col("weight") - 1e-9)
    x = ranked.select("gram", "after", F.col("node").alias("a"), F.col("label").alias("la"), F.col("weight").alias("wa"), F.col("central").alias("ca"))
    y = rows.select("gram", F.col("node").alias("b"), F.col("label").alias("lb"), F.col("weight").alias("wb"), F.col("central").alias("cb"), "common")
    first = (F.col("ca") < F.col("cb")) | ((F.col("ca") == F.col("cb")) & (F.col("a") < F.col("b")))
    fits = F.least("after", "common") >= least / (1 + least) * (F.col("wa") + F.col("wb")) - 1e-9
    met = x.join(y, "gram").where((F.col("la") != F.col("lb")) & first & fits)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """One document of each class, with all its columns: the one with the least id (nulls last), of several such rows the
    one with the least md5 of the text, of equal rows one. Rows are told apart by id and text, so no class is left out
    where ids are null or repeat."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    i, t = f"c{names.index(doc_id)}", f"c{names.index(text)}"
    _, by_node = _classed(plain, i, t, k, least)
    found = by_node.where(F.col("node") == F.col("keep")).select("node", F.col("class_id").alias("__i"))
    marked = plain.withColumn("__node", F.unhex(F.md5(F.coalesce(F.col(t).cast("string"), F.lit("")))))
    on = (F.col("d.__node") == F.col("f.node")) & F.col(f"d.{i}").cast("long").eqNullSafe(F.col("f.__i"))
    kept = marked.alias("d").join(found.alias("f"), on, "left_semi")
    return kept.dropDuplicates([i, "__node"]).drop("__node").toDF(*names)
