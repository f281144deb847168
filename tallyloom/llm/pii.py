"""Personal data by bootstrapped contextual extraction. DataFrame operations only.

Base rules find e-mail addresses, IP addresses, card and phone numbers. These are seeds, and so are words that are plainly
drawn at random (SURE: long, letters and digits mixed), as keys and tokens are. Seeds induce lexical patterns: the word, and
the two words, before them, the name set before them in the same word (`password=`), the word after, and for words with a
beginning of four letters that beginning and the length. The same patterns also stand around other words: those with a digit, and those
that a "=" or ":" introduces (at least MIN_LENGTH characters). In the graph of patterns and instances, a pattern scores the
mean confidence of its instances (smoothed), an instance the noisy-or of its patterns; seeds stay at 1. After TURNS
turns, patterns with at least MIN_SEEDS distinct seed instances and a score of MIN_PATTERN or more are trusted,
and the instances that they vouch for with MIN_INSTANCE or more are identifiers that no base rule knows. A seed of no base
kind is one of them only if a trusted pattern vouches for it, too.

One pass reads the texts; it keeps the spans, the candidate words and what stands around them. All later
steps work on that table, which is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tallyloom.llm._store import Workspace

KINDS = ("email", "ip", "card", "phone")
OTHER = "other"
#: The base patterns. Possessive quantifiers where nothing that follows can need a shorter match: the same matches, in linear time and stack.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for the kind to be looked for.
NEEDS = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
SPACE = r"\x20\x09-\x0D"
#: Candidates: words with a digit, and words after "=" or ":".
TOKEN = rf"(?<![^{SPACE}])[^{SPACE}0-9]*+[0-9][^{SPACE}]*+|(?<=[=:][{SPACE}])[^{SPACE}]++"
#: Words that are plainly drawn at random: at least 16 such characters, 2 digits and 4 letters, no long run of small letters.
SURE = r"^(?=(?:[^0-9]*[0-9]){2})(?=(?:[^A-Za-z]*[A-Za-z]){4})(?!.*[a-z]{7})[A-Za-z0-9_-]{16,}$"
#: A name in a word, set off from its value.
NAMED = r"^([\p{P}]*[A-Za-z][A-Za-z_.-]*[=:])(.+)$"
#: How many a key begins: with letters that no hexadecimal number has.
HEAD = r"^(?=.{0,3}[G-Zg-z_-])[A-Za-z_-]{4}"
OUTER = r"^[\p{P}\p{S}]+|[\p{P}\p{S}]+$"
MIN_LENGTH = 6
TURNS = 3
MIN_SEEDS, MIN_PATTERN, MIN_INSTANCE = 5, 0.8, 0.75
BLOCK = 256


def let(value: Column, body) -> Column:
    """body(value), the value being computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, x: a + x)


def prefix_sums(numbers: Column) -> Column:
    """Sum of the numbers before each; by blocks, so that many numbers don't take quadratic time."""

    def with_blocks(xs):
        blocks = F.when(F.size(xs) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int")), lambda b: total(F.slice(xs, b * BLOCK + 1, BLOCK)))).otherwise(F.array().cast("array<bigint>"))
        return let(blocks, lambda bs: let(F.transform(bs, lambda _, i: total(F.slice(bs, F.lit(1), i))), lambda bases: F.transform(xs, lambda _, i: F.element_at(bases, (F.floor(i / BLOCK) + 1).cast("int")) + total(F.slice(xs, (i - i % BLOCK + 1).cast("int"), (i % BLOCK).cast("int"))))))

    return let(numbers, with_blocks)


def matches(text: Column, pattern: str, needs: Column) -> Column:
    """start, end (code points), text, left (the two words before) and right (the word after; both in lower case) of all
    non-overlapping matches."""
    kind = "array<struct<start:bigint,end:bigint,text:string,left:string,right:string>>"

    def build(found):
        gaps = F.split(text, pattern, -1)

        def placed(gs):
            sizes = F.transform(found, lambda m, i: (F.length(F.element_at(gs, i + 1)) + F.length(m)).cast("bigint"))

            def spans(before):
                def one(m, i):
                    start = F.element_at(before, i + 1) + F.length(F.element_at(gs, i + 1))
                    around = left_words(F.element_at(gs, i + 1)).alias("left"), right_word(F.element_at(gs, i + 2)).alias("right")
                    return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), m.alias("text"), *around)

                return F.transform(found, one)

            return let(prefix_sums(sizes), spans)

        return let(gaps, placed)

    none = F.array().cast(kind)
    return F.when(needs, let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda f: F.when(F.size(f) > 0, build(f)).otherwise(none))).otherwise(none).cast(kind)


def left_words(gap: Column) -> Column:
    """Up to two words at the end of what stands before a match. The last 80 characters mostly hold them; else all is read."""

    def words(part: Column) -> Column:
        return F.split(F.trim(F.regexp_replace(F.lower(part), rf"[{SPACE}]+", " ")), " ")

    near = words(F.right(gap, F.lit(80)))
    found = F.when((F.size(near) > 2) | (F.length(gap) <= 80), near).otherwise(words(gap))
    return let(found, lambda w: F.array_join(F.slice(w, F.greatest(F.size(w) - 1, F.lit(1)), F.lit(2)), " "))


def right_word(gap: Column) -> Column:
    """The first whole word of what stands after a match."""
    return F.lower(F.regexp_extract(gap, rf"^[^{SPACE}]*+[{SPACE}]++([^{SPACE}]++)[{SPACE}]", 1))


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(number: Column) -> Column:
    def value(i, n):
        d = n.substr(F.length(n) - i, F.lit(1)).cast("int")
        doubled = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 1, doubled).otherwise(d)

    return let(number, lambda n: F.aggregate(F.sequence(F.lit(0), F.length(n) - 1), F.lit(0), lambda a, i: a + value(i, n)) % 10 == 0)


def valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: let(F.regexp_replace(p, "^0+", ""), lambda q: (F.length(q) < 3) | ((F.length(q) == 3) & (q <= "255"))))
    if kind == "card":
        return let(digits(m), lambda d: F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(digits(m)).between(10, 15)
    return F.lit(True)


# Functions of one argument for Spark's higher-order functions, which count the arguments.
def _is_valid(kind: str):
    return lambda s: valid(kind, s["text"])


def _of_kind(k: int):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end"), s["text"].alias("text"), s["left"].alias("left"), s["right"].alias("right"))


def _has_kind(k: int):
    return lambda s: s["kind"] == k


def scan(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """row, doc_id, spans (of the base kinds) and words (candidates) of every document."""
    t = F.col("__t")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__t"))
    parts = []
    for k, kind in enumerate(KINDS):
        found = F.filter(matches(t, PATTERNS[kind], t.rlike(NEEDS[kind])), _is_valid(kind))
        parts.append(F.transform(found, _of_kind(k)))
    words = F.filter(matches(t, TOKEN, t.rlike(rf"[0-9]|[=:][{SPACE}]")), lambda s: F.length(s["text"]) >= MIN_LENGTH)
    return rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.array_sort(F.concat(*parts)).alias("spans"), words.alias("words"))


def discover(space: Workspace, scanned: DataFrame) -> DataFrame:
    """row, start, end of the identifiers that trusted patterns vouch for, outside base spans."""
    base = scanned.select("row", F.explode("spans").alias("s")).select("row", "s.start", "s.end", "s.text", "s.left", "s.right", F.lit(1).alias("base"))
    more = scanned.select("row", F.explode("words").alias("s")).select("row", "s.start", "s.end", "s.text", "s.left", "s.right", F.lit(0).alias("base"))
    # A name is not part of what it names, and quotes, brackets and stops aren't either.
    name = F.regexp_extract("text", NAMED, 1)
    more = more.withColumn("name", name).select("row", (F.col("start") + F.length("name")).alias("start"), F.expr("substring(text, length(name) + 1)").alias("text"), "right", "base",
                                                F.when(F.col("name") != "", F.lower(F.trim(F.concat_ws(" ", F.regexp_extract("left", "[^ ]*$", 0), "name")))).otherwise(F.col("left")).alias("left"))
    more = more.withColumn("head", F.length("text") - F.length(F.regexp_replace("text", OUTER.split("|")[0], ""))).withColumn("core", F.regexp_replace("text", OUTER, ""))
    more = more.where(F.length("core") >= MIN_LENGTH).select("row", (F.col("start") + F.col("head")).alias("start"), (F.col("start") + F.col("head") + F.length("core")).alias("end"), F.col("core").alias("text"), "left", "right", "base")
    order = W.partitionBy("row").orderBy("start", F.col("base").desc(), "end")
    reach = F.max(F.when(F.col("base") == 1, F.col("end"))).over(order.rowsBetween(W.unboundedPreceding, -1))
    coming = F.min(F.when(F.col("base") == 1, F.col("start"))).over(order.rowsBetween(1, W.unboundedFollowing))
    free = (F.coalesce(reach, F.lit(0)) <= F.col("start")) & (F.coalesce(coming, F.col("end")) >= F.col("end"))
    both = base.unionByName(more).withColumn("free", free).where("base = 1 or free")
    seed = F.when((F.col("base") == 1) | F.col("text").rlike(SURE), 1).otherwise(0)
    last = F.element_at(F.split("left", " "), -1)
    left = F.when(F.col("left") != "", F.array(F.concat(F.lit("1 "), last), F.concat(F.lit("2 "), F.col("left")))).otherwise(F.array().cast("array<string>"))
    right = F.when(F.col("right") != "", F.array(F.concat(F.lit("r "), F.col("right")))).otherwise(F.array().cast("array<string>"))
    shape = F.when((F.col("base") == 0) & F.col("text").rlike(HEAD), F.array(F.concat(F.lit("s "), F.left("text", F.lit(4)), F.lit(" "), F.length("text")))).otherwise(F.array().cast("array<string>"))
    found = both.select("row", "start", "end", "base", seed.alias("seed"), F.lower("text").alias("instance"), F.explode(F.array_distinct(F.concat(left, right, shape))).alias("pattern"))
    found = space.table(found, "found")
    edges = space.table(found.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")), "edges")
    sure = edges.withColumn("c", F.col("seed").cast("double"))
    for turn in range(TURNS):
        scores = sure.groupBy("pattern").agg((F.sum("c") / (F.count("*") + 0.5)).alias("score"), F.sum("seed").alias("seeds"))
        scores = space.table(scores, "patterns")
        if turn == TURNS - 1:
            break
        vouched = edges.join(scores, "pattern").groupBy("instance").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-6)))))).alias("v"))
        sure = edges.join(vouched, "instance").withColumn("c", F.when(F.col("seed") == 1, 1.0).otherwise(F.col("v")))
    trusted = scores.where((F.col("seeds") >= MIN_SEEDS) & (F.col("score") >= MIN_PATTERN))
    vouched = found.where("base = 0").join(trusted, "pattern")
    doubt = F.exp(F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-6)))))
    return vouched.groupBy("row", "start", "end").agg((1 - doubt).alias("v")).where(F.col("v") >= MIN_INSTANCE).select("row", "start", "end")


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in (*KINDS, OTHER)])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_spans, all_spans (arrays of start, kind, end), n_other.

    Null and empty texts have no spans. Null ids and repeated rows are answered as any other row. A table without
    a base span teaches no pattern, and so has no other identifiers either. An empty table gives no rows.
    """
    space = Workspace(docs.sparkSession, "pii")
    scanned = space.table(scan(docs, doc_id, text), "scan")
    extra = discover(space, scanned).groupBy("row").agg(F.collect_list(F.struct("start", F.lit(len(KINDS)).alias("kind"), "end")).alias("more"))
    base = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    out = scanned.select("row", "doc_id", base.alias("base_spans")).join(extra, "row", "left")
    counts = [F.size(F.filter("base_spans", _has_kind(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    every = F.when(F.col("more").isNull(), F.col("base_spans")).otherwise(F.array_sort(F.concat("base_spans", "more")))
    return out.select(F.col("doc_id").alias(doc_id), *counts, "base_spans", every.alias("all_spans"), F.greatest(F.size("more"), F.lit(0)).cast("long").alias("n_other"))


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The texts with each base match replaced by <kind>. One pass, no patterns."""
    out = F.col(text).cast("string")
    for kind in ("email", "phone", "card", "ip"):
        out = F.when(out.rlike(NEEDS[kind]), F.regexp_replace(out, PATTERNS[kind], f"<{kind}>")).otherwise(out)
    return docs.select(doc_id, out.alias(text))
