"""The registered queries of this subpackage: each applies one operator to its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyloom.llm import decontaminate as _leaks, html_extract as _html, line_dedup as _lines, mixing as _mixing, near_dedup as _near, pii as _pii, quality as _quality, sharding as _sharding, token_store as _tokens, toxicity as _toxicity
from tallyloom.llm._store import Workspace


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines.dedup_passages(_table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = _sharding.shard(_table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return _quality.score(docs, _quality.train(docs, _table(spark, sf_dir, "labels")), ["doc_id"])


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _html.extract(_table(spark, sf_dir, "pages"), ["page_id", "url"])


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixing.mix(_table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return _toxicity.score(docs, _toxicity.train(docs, _table(spark, sf_dir, "labels")), ["doc_id"])


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near.classes(_table(spark, sf_dir, "documents"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _pii.find(_table(spark, sf_dir, "documents"))
    digest = F.sha2(_pii.joined(F.col("base_spans")), 256).alias("base_sha256")
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", digest, _pii.joined(F.col("all_spans")).alias("spans"), "n_other", (F.size("all_spans") > 0).alias("personal"))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = Workspace(spark, "op10").path
    _tokens.write(_table(spark, sf_dir, "documents"), folder, tokenizer_path())
    return _tokens.index(spark, folder)


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_dedup, op2_decontamination, op3_html_text, op4_source_mix, op5_shards, op6_quality_rules, op7_toxicity, op8_near_dedup, op9_personal_data, op10_token_shards
    )
}

#: DuckDB: exact five-word shingle containment of every item in every document; an item of fewer words is its one shingle.
OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
b AS (SELECT DISTINCT item_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
bk AS (SELECT *, least(5, len(w)) AS k FROM b WHERE len(w) > 0),
bs AS (SELECT DISTINCT item_id, w, k, array_to_string(w[i:i+k-1], ' ') AS s FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM bk)),
bn AS (SELECT item_id, w, count(*) AS n FROM bs GROUP BY item_id, w),
ds AS (SELECT DISTINCT doc_id, k, array_to_string(w[i:i+k-1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bk))),
h AS (SELECT doc_id, bs.item_id, count(*) * 1.0 / min(n) AS share FROM ds JOIN bs USING (s, k) JOIN bn ON bn.item_id = bs.item_id AND bn.w = bs.w
      GROUP BY doc_id, bs.item_id, bs.w HAVING count(*) * 1.0 / min(n) >= 0.8),
g AS (SELECT doc_id, list_sort(list(DISTINCT item_id)) AS items, max(share)::DOUBLE AS containment FROM h GROUP BY doc_id)
SELECT doc_id, items IS NOT NULL AS contaminated, coalesce(len(items), 0)::BIGINT AS n_items, coalesce(items, []::BIGINT[]) AS items,
       coalesce(containment, 0.0) AS containment
FROM documents LEFT JOIN g USING (doc_id)
"""

#: DuckDB: the target shares, the schedule of golden-ratio points, and what its blocks take of each source's stream, which is in the order of a hash.
OP4_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
             md5(coalesce(doc_id::VARCHAR, 'null') || ':mix') AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n, 3 * sum(size)::BIGINT AS cap,
        [1.0, 2.0, 3.0][1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3]::DOUBLE AS w FROM d GROUP BY source),
r AS (SELECT *, (sum(n) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0.0)) AS level FROM s
      WINDOW b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h AS (SELECT arg_min(level, cap / w) AS level FROM r WHERE level * w <= cap),
t AS (SELECT r.source, r.n, least(r.cap::DOUBLE, coalesce(h.level * r.w, r.cap)) AS target,
        least(round(least(r.cap::DOUBLE, coalesce(h.level * r.w, r.cap)))::BIGINT, r.cap) AS quota FROM r, h),
u AS (SELECT *, ceil(quota / 16384.0)::BIGINT AS blocks, sum(target) OVER (ORDER BY encode(source) NULLS LAST ROWS UNBOUNDED PRECEDING) / sum(target) OVER () AS high FROM t),
v AS (SELECT *, coalesce(lag(high) OVER (ORDER BY encode(source) NULLS LAST), 0.0) AS low FROM u),
c AS (SELECT coalesce(sum(blocks), 0)::BIGINT AS total FROM v WHERE quota > 0),
y AS (SELECT i AS slot, source, row_number() OVER (PARTITION BY source ORDER BY i) - 1 AS block, blocks
      FROM (SELECT unnest(range(total)) AS i FROM c) JOIN v ON (i * 0.6180339887498949::DOUBLE) % 1.0 >= low AND (i * 0.6180339887498949::DOUBLE) % 1.0 < high WHERE quota > 0),
z AS (SELECT slot, source, block FROM y WHERE block < blocks UNION ALL
      SELECT total + block, source, block FROM (
        SELECT v.source, unnest(range(coalesce(have, 0), blocks)) AS block FROM v LEFT JOIN (SELECT source, count(*) AS have FROM y GROUP BY source) y ON v.source IS NOT DISTINCT FROM y.source WHERE quota > 0), c),
p AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY k, doc_id ROWS UNBOUNDED PRECEDING) - size AS a FROM d),
m AS (SELECT p.doc_id, p.source, p.k, size, quota, a + pass * n AS x, unnest(range((a + pass * n)::BIGINT // 16384, (a + pass * n + size - 1)::BIGINT // 16384 + 1)) AS block
      FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source, (SELECT unnest([0, 1, 2]) AS pass) WHERE size > 0),
f AS (SELECT m.doc_id, m.source, least(x + size, (m.block + 1) * 16384, quota) - greatest(x, m.block * 16384) AS words, slot FROM m JOIN z ON m.source IS NOT DISTINCT FROM z.source AND m.block = z.block),
g AS (SELECT doc_id, source, sum(words)::BIGINT AS taken, min(slot)::BIGINT AS first_slot FROM f WHERE words > 0 GROUP BY doc_id, source)
SELECT p.doc_id, p.size, n AS source_size, target, coalesce(taken, 0)::BIGINT AS taken, first_slot
FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source LEFT JOIN g ON p.doc_id IS NOT DISTINCT FROM g.doc_id AND p.source IS NOT DISTINCT FROM g.source
"""

ORACLES = {"op2_decontamination": OP2_SQL, "op4_source_mix": OP4_SQL}
