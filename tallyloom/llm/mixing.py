"""Mixing sources to target weights with a low-discrepancy schedule. DataFrame operations only.

Slot n of the schedule takes the point frac(n * golden ratio), which falls into one source's share of the
cumulative weights: every stretch of the schedule holds each source in nearly its share. The r-th slot of a
source takes the r-th block of its stream: its documents in a shuffled order, cut into blocks of equally many
words, the stream repeating up to MAX_REPEATS times. A source has as many slots as its target has blocks
(the last one partial); the few that the points don't provide come at the end.

What the mix takes is what the scheduled blocks hold: documents are cut at the blocks' edges and each piece meets its
slot. `mix` counts the words of the pieces and says in which slot a document comes first; `apply_mix` gives each copy
of a document the slot of the block that holds its first word, and returns the copies in the order of the schedule.

Nothing is ordered in one task: streams are ordered within ranges of the documents' hashes, as many as the input needs
(the order does not depend on their number), slots within stretches of the schedule, and both are offset by small
tables of their totals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tallyloom.llm._store import Workspace

MAX_REPEATS = 3
BLOCK_WORDS = 1 << 14
BUCKET_ROWS = 2_000  # rows that one task orders, about
STRETCH = 1 << 16
CELLS = 1 << 12
GOLDEN = 0.6180339887498949
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text):
    """Number of words of a text; null: 0."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: list[float] | None = None) -> DataFrame:
    """source, source_size, weight, target, low, high: shares of all sizes by weight, none above MAX_REPEATS times its size.

    `sizes` has source and source_size, one row each. Weights go to sources by code point, null last, and repeat
    (1, 2, 3 if not given). The excess of sources at their cap is reshared by weight until none is above:
    target = min(cap, level * weight), where the level is found from the sources in order of cap / weight.
    low and high bound the source's part of the unit interval. The table of sources is small: one row each.
    """
    weights = weights or [1, 2, 3]
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("weight", w).withColumn("cap", MAX_REPEATS * F.col("source_size"))
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    rows = rows.withColumn("level", (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    # The level holds from the first source on whose cap it doesn't reach.
    rows = rows.withColumn("held", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source", "level"))).over(whole)["level"])
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("held") * F.col("weight"), F.col("cap").cast("double")))
    rows = rows.select("source", "source_size", "weight", target.alias("target"))
    ordered = W.orderBy(F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, 0)
    total = F.greatest(F.sum("target").over(whole), F.lit(1e-300))
    rows = rows.withColumn("high", F.sum("target").over(ordered) / total)
    return rows.withColumn("low", F.coalesce(F.lag("high").over(W.orderBy(F.col("source").asc_nulls_last())), F.lit(0.0)))


def plan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: list[float] | None = None,
         block: int = BLOCK_WORDS, seed: str = "mix") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, sources, schedule).

    documents: doc_id, text_hash, source, size, source_size, target, begin (its place in the source's stream).
    schedule: slot, source, block (index in the repeated stream), begin and end (of the block, in words).
    The order of a stream is by hash of id and seed, so reruns agree; ties go by id, then by hash of the text.
    """
    space = Workspace(docs.sparkSession, "mix")
    key = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(seed)))
    place = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), n_words(F.col(text)).alias("size"), F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("text_hash"))
    rows = space.table(rows.withColumn("key", key).withColumn("place", place), "sizes")
    parts = 1 + rows.count() // BUCKET_ROWS
    rows = rows.withColumn("bucket", F.shiftright(F.col("place") * parts, 32)).drop("place")
    buckets = rows.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    at_bucket = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    buckets = buckets.select("source", "bucket", (F.sum("n").over(at_bucket) - F.col("n")).alias("base"))
    sources = space.table(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights), "sources")
    inner = W.partitionBy("source", "bucket").orderBy("key", "doc_id", "text_hash", "size").rowsBetween(W.unboundedPreceding, 0)
    placed = rows.withColumn("inner", F.sum("size").over(inner) - F.col("size"))
    same = placed.alias("p").join(buckets.alias("b"), F.col("p.source").eqNullSafe(F.col("b.source")) & (F.col("p.bucket") == F.col("b.bucket")))
    placed = same.select("p.doc_id", "p.text_hash", "p.source", "p.size", (F.col("b.base") + F.col("p.inner")).alias("begin"))
    placed = placed.alias("p").join(sources.alias("s"), F.col("p.source").eqNullSafe(F.col("s.source")))
    documents = space.table(placed.select("p.doc_id", "p.text_hash", "p.source", "p.size", "s.source_size", "s.target", "p.begin"), "documents")
    return documents, sources, space.table(schedule(sources, block), "schedule")


def schedule(sources: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """slot, source, block, begin, end of every slot that the mix takes, in the order of slot."""
    spark = sources.sparkSession
    quota = sources.select("*", F.least(F.round("target").cast("long"), MAX_REPEATS * F.col("source_size")).alias("quota")).where("quota > 0")
    quota = quota.withColumn("blocks", F.ceil(F.col("quota") / F.lit(block)))
    total = quota.agg(F.sum("blocks")).first()[0] or 0
    points = spark.range(total).select(F.col("id").alias("slot"), (F.col("id") * GOLDEN % 1.0).alias("point"), F.floor(F.col("id") / STRETCH).alias("stretch"))
    # A range join on the point, made an equality: by cell of the unit interval. A source is in the cells that it overlaps.
    cell = lambda x: F.least(F.floor(x * CELLS), F.lit(CELLS - 1))
    spans = quota.withColumn("cell", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high")))))
    drawn = points.withColumn("cell", cell(F.col("point"))).join(spans, "cell").where("point >= low and point < high").select("slot", "stretch", "source")
    counts = drawn.groupBy("source", "stretch").agg(F.count("*").alias("n"))
    counts = counts.select("source", "stretch", (F.sum("n").over(W.partitionBy("source").orderBy("stretch").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("base"))
    ranked = drawn.withColumn("r", F.row_number().over(W.partitionBy("source", "stretch").orderBy("slot")) - 1).alias("d")
    ranked = ranked.join(counts.alias("c"), F.col("d.source").eqNullSafe(F.col("c.source")) & (F.col("d.stretch") == F.col("c.stretch"))).select("d.slot", "d.source", (F.col("c.base") + F.col("d.r")).alias("block"))
    ends = quota.select("source", "quota", "blocks").alias("q")
    main = ranked.alias("r").join(ends, F.col("r.source").eqNullSafe(F.col("q.source"))).where("r.block < q.blocks").select("r.slot", "q.source", "r.block", "q.quota")
    have = ranked.groupBy("source").agg(F.count("*").alias("n")).alias("h")
    short = ends.join(have, F.col("q.source").eqNullSafe(F.col("h.source")), "left").where("q.blocks > coalesce(h.n, 0)")
    tail = short.select("q.source", F.explode(F.sequence(F.coalesce(F.col("h.n"), F.lit(0)), F.col("q.blocks") - 1)).alias("block"), "q.quota")
    tail = tail.select((F.lit(total) + F.col("block")).alias("slot"), "source", "block", "quota")
    begin = F.col("block") * block
    return main.unionByName(tail).select("slot", "source", "block", begin.alias("begin"), F.least(begin + block, F.col("quota")).alias("end"))


def pieces(documents: DataFrame, schedule_: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """The documents' copies in the repeated streams, cut at the edges of the scheduled blocks: the columns of documents,
    pass, slot, words (of the piece) and leads (whether it holds the copy's first word), where a block takes a word."""
    copies = documents.where("size > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(MAX_REPEATS - 1)))).withColumn("from", F.col("begin") + F.col("pass") * F.col("source_size"))
    copies = copies.where(F.col("from") < F.col("target") + 1)
    cut = copies.withColumn("block", F.explode(F.sequence(F.floor(F.col("from") / block), F.floor((F.col("from") + F.col("size") - 1) / block))))
    on = F.col("p.source").eqNullSafe(F.col("s.source")) & (F.col("p.block") == F.col("s.block"))
    met = cut.alias("p").join(schedule_.alias("s"), on)
    words = F.least(F.col("p.from") + F.col("p.size"), F.col("s.end")) - F.greatest(F.col("p.from"), F.col("s.begin"))
    leads = (F.col("p.from") >= F.col("s.begin")) & (F.col("p.from") < F.col("s.end"))
    return met.select(*[f"p.{c}" for c in documents.columns], "p.pass", "s.slot", words.alias("words"), leads.alias("leads")).where("words > 0")


def taken(documents: DataFrame, schedule_: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """documents with taken (the words that the scheduled blocks take of each, repeats counted) and first_slot (the first slot that takes of it; null: none)."""
    sums = pieces(documents, schedule_, block).groupBy("source", "begin").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"))
    out = documents.alias("d").join(sums.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")) & (F.col("d.begin") == F.col("t.begin")) & (F.col("d.size") > 0), "left")
    return out.select("d.*", F.coalesce("t.taken", F.lit(0)).alias("taken"), F.when(F.col("d.size") > 0, F.col("t.first_slot")).alias("first_slot"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_slot of every document.

    Null texts have size 0, a null source is a source of its own (the last), null ids are mixed as any other.
    Repeated rows have places of their own in the stream. An empty table gives no rows.
    """
    documents, _, slots = plan(docs, doc_id, text, source, **options)
    out = taken(documents, slots, options.get("block", BLOCK_WORDS))
    return out.select(F.col("doc_id").alias(doc_id), "size", "source_size", "target", "taken", "first_slot")


def apply_mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mixed documents with all their columns, in the order of the schedule: a document comes as often as scheduled
    blocks hold its first word, each time in that block's slot, and within a slot in the order of the stream.

    Documents without a word are in no block and go. The order is that of the partitions, and of the rows in each; files
    written from it keep it.
    """
    documents, _, slots = plan(docs, doc_id, text, source, **options)
    led = pieces(documents, slots, options.get("block", BLOCK_WORDS)).where("leads").groupBy("source", "begin").agg(F.collect_list("slot").alias("slots"))
    # Repeated rows share id, source and text; they are told apart by their number.
    nth = F.row_number().over(W.partitionBy("doc_id", "source", "text_hash").orderBy("begin"))
    sized = documents.where("size > 0").select("doc_id", "source", "text_hash", "begin", nth.alias("nth")).alias("d")
    counted = sized.join(led.alias("l"), F.col("d.source").eqNullSafe(F.col("l.source")) & (F.col("d.begin") == F.col("l.begin"))).select("d.*", "l.slots")
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = {k: F.col(f"c{names.index(v)}") for k, v in (("doc_id", doc_id), ("text", text), ("source", source))}
    keyed = plain.select("*", at["doc_id"].alias("__i"), at["source"].cast("string").alias("__s"), F.xxhash64(F.coalesce(at["text"].cast("string"), F.lit(""))).alias("__h"))
    keyed = keyed.withColumn("__n", F.row_number().over(W.partitionBy("__i", "__s", "__h").orderBy(F.lit(1))))
    on = F.col("k.__i").eqNullSafe(F.col("n.doc_id")) & F.col("k.__s").eqNullSafe(F.col("n.source")) & (F.col("k.__h") == F.col("n.text_hash")) & (F.col("k.__n") == F.col("n.nth"))
    out = keyed.alias("k").join(counted.alias("n"), on).select(*[f"k.{c}" for c in plain.columns], F.explode("n.slots").alias("__slot"), F.col("n.begin").alias("__begin"))
    ordered = out.repartitionByRange("__slot", "__begin").sortWithinPartitions("__slot", "__begin")
    return ordered.select(*plain.columns).toDF(*names)
