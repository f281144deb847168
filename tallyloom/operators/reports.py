"""Operational reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def parse_coverage(parses: DataFrame) -> DataFrame:
    """device, untracked, pending, failing, quarantined, oldest_pending of each device's latest generations."""
    rows = latest(parses)
    pending = (F.col("requested") > F.coalesce("parsed", F.lit(0))) & ~F.col("quarantined")
    count = lambda c: F.count(F.when(c, 1))
    return rows.groupBy("device").agg(
        count(F.col("requested").isNull()).alias("untracked"), count(pending).alias("pending"), count(pending & (F.col("failures") > 0)).alias("failing"), count(F.col("quarantined")).alias("quarantined"),
        F.min(F.when(pending, F.col("requested_at"))).alias("oldest_pending"),
    )


def latest(parses: DataFrame) -> DataFrame:
    """The row of each source's latest generation."""
    rest = [c for c in parses.columns if c != "source"]
    return parses.groupBy("source").agg(F.max_by(F.struct(*rest), "generation").alias("p")).select("source", *[f"p.{c}" for c in rest])


def key_sums(parses: DataFrame, column: str = "report") -> DataFrame:
    """key and n: the sums over a JSON map of counts, positive ones only."""
    rows = parses.select(F.explode(F.from_json(column, "map<string,long>")).alias("key", "n"))
    return rows.groupBy("key").agg(F.sum("n").alias("n")).where("n > 0")


def issues(parses: DataFrame) -> DataFrame:
    """source and its report without zero counts; sources without a report are unknown, not zero."""
    return parses.select("source", "generation", F.map_filter(F.from_json("report", "map<string,long>"), lambda k, v: v > 0).alias("issues"), F.col("report").isNotNull().alias("known"))


def hidden_summary(sessions: DataFrame) -> DataFrame:
    """user_id, hidden_rule, hidden and oldest: by user and rule, by user, and in all (nulls)."""
    rows = sessions.where("hidden_at is not null")
    one = lambda *by: rows.groupBy(*by).agg(F.count("*").alias("hidden"), F.min("hidden_at").alias("oldest"))
    null = F.lit(None).cast("string")
    out = one("user_id", "hidden_rule").select("user_id", "hidden_rule", "hidden", "oldest")
    out = out.unionByName(one("user_id").select("user_id", null.alias("hidden_rule"), "hidden", "oldest"))
    return out.unionByName(one().select(null.alias("user_id"), null.alias("hidden_rule"), "hidden", "oldest"))


def storage_usage(chunks: DataFrame) -> DataFrame:
    """owner, stored and tails (bytes) of each owner."""
    return chunks.groupBy("owner").agg(F.sum("stored").alias("stored"), F.coalesce(F.sum(F.octet_length("tail")), F.lit(0)).cast("long").alias("tails"))


def orphan_chunks(chunks: DataFrame, manifest: DataFrame) -> DataFrame:
    return chunks.join(manifest.select("hash").distinct(), "hash", "left_anti")


def missing_chunks(manifest: DataFrame, chunks: DataFrame) -> DataFrame:
    return manifest.join(chunks.select("hash").distinct(), "hash", "left_anti")


def extraction(reports: DataFrame) -> DataFrame:
    """code, n and samples (up to eight locators) of diagnostics (code, locator), mergeable."""
    return reports.groupBy("code").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_set("locator")), 1, 8).alias("samples"))


def quarantined(parses: DataFrame) -> DataFrame:
    return latest(parses).where("quarantined").orderBy("requested_at", "source")


def newest_events(events: DataFrame, n: int) -> DataFrame:
    return events.orderBy(F.col("ts").desc_nulls_last(), F.col("event_id").asc()).limit(n)


def extraction_summary(parses: DataFrame, info: tuple[str, ...] = ("unknown_record_type",)) -> DataFrame:
    """One row: assessed, unassessed, affected, warning and info sources, by the issues that their reports count."""
    rows = issues(parses)
    has = F.coalesce(F.size("issues"), F.lit(0)) > 0
    warns = F.coalesce(F.exists(F.map_keys("issues"), lambda k: ~k.isin(*info)), F.lit(False))
    tells = F.coalesce(F.exists(F.map_keys("issues"), lambda k: k.isin(*info)), F.lit(False))
    count = lambda c: F.count(F.when(c, 1))
    return rows.agg(count(F.col("known")).alias("assessed"), count(~F.col("known")).alias("unassessed"), count(F.col("known") & has).alias("affected"), count(F.col("known") & warns).alias("warning"), count(F.col("known") & tells).alias("info"))


def upload_snapshot(parses: DataFrame) -> DataFrame:
    """One row over all devices: devices, sources, pending, quarantined."""
    by_device = parse_coverage(parses)
    sources = parses.select("source").distinct().agg(F.count("*").alias("sources"))
    totals = by_device.agg(F.count("*").alias("devices"), F.coalesce(F.sum("pending"), F.lit(0)).alias("pending"), F.coalesce(F.sum("quarantined"), F.lit(0)).alias("quarantined"))
    return totals.join(F.broadcast(sources))  # one row each
