"""The pipeline's stages against brute force on the driver's smallest tables, and the SQL of the queries that have one."""

import zlib

import duckdb
import numpy as np
import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from tallyloom.llm import mixing, quality
from tallyloom.llm.queries import ORACLES, QUERIES, tokenizer_path

from test_llm_operators import base_counts, brute_classes, holds, library_ids, words


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, sf_dir, name):
    connection = duckdb.connect()
    for table in ("documents", "benchmark", "labels", "pages"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    plain = lambda v: round(v, 6) if isinstance(v, float) else list(v) if isinstance(v, (list, tuple)) else v
    mine = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    result = connection.execute(ORACLES[name])
    at = [[d[0] for d in result.description].index(c) for c in columns]
    assert mine == sorted(repr([plain(r[i]) for i in at]) for r in result.fetchall())


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        assert out.columns == columns or i == len(corpus_pipeline.STAGES) - 1
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        kept.append(docs.collect())
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    # Quality: never one that the base rules fail; the model's verdict on the rest.
    model = quality.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    verdict = {r.doc_id: r.kept for r in quality.score(spark.read.parquet(f"{sf_dir}/documents.parquet"), model, ["doc_id"]).collect()}
    assert {r.doc_id for r in kept[0]} == {i for i, k in verdict.items() if k}
    assert all(base_counts(texts[i])[0] >= 20 for i in verdict if verdict[i])
    # Near duplicates: one of each class.
    rows = [(r.doc_id, r.text) for r in kept[0]]
    assert {r.doc_id for r in kept[1]} == {c for c, _ in brute_classes(rows).values()}
    # Leaks.
    items = [words(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = {r.doc_id for r in kept[1] if not any(holds(words(r.text), i) >= 0.8 for i in items)}
    assert {r.doc_id for r in kept[2]} == clean
    # The mix: as often as the document's first word is taken, never more than three times.
    size, count, target = {}, {}, {}
    source = {r.doc_id: r.source for r in kept[2]}
    for x in mixing.mix(spark.read.parquet(f"{tmp_path}/2")).collect():
        target[source[x.doc_id]] = x.target
    for r in kept[3]:
        count[r.doc_id] = count.get(r.doc_id, 0) + 1
        size[source[r.doc_id]] = size.get(source[r.doc_id], 0) + len(words(r.text))
    assert set(count) <= clean and max(count.values()) <= 3
    longest = max(len(words(r.text)) for r in kept[2])
    assert all(abs(size.get(s, 0) - t) <= longest for s, t in target.items())
    # Tokens: in the order of the mix, which is that of the scheduled slots.
    ordered = spark.read.parquet(f"{tmp_path}/3").select("doc_id", "text", F.col("_metadata.file_name").alias("f"), F.col("_metadata.row_index").alias("r")).orderBy("f", "r").collect()
    documents, _, slots = mixing.plan(spark.read.parquet(f"{tmp_path}/2"))
    led = mixing.pieces(documents, slots).where("leads").orderBy("slot", "begin").collect()
    assert [r.doc_id for r in ordered] == [r.doc_id for r in led]
    start = 0
    for r, ids, got in zip(ordered, library_ids([r.text or "" for r in ordered], tokenizer_path()), sorted(kept[4], key=lambda r: r.start), strict=True):
        ids = [*ids, 2]
        assert (got.doc_id, got.start, got.n_tokens, got.ids_crc32) == (r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() > 50
