"""Answers as text and JSON, and output budgets."""

from __future__ import annotations

import hashlib
import hmac
import json
import re

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tallyloom.operators.filters import live, on_path

HEADER_BYTES = 260
MAX_ROWS, MAX_BYTES = 1024, 4 << 20


def header(pairs: dict) -> str:
    """key=value pairs in one line of at most HEADER_BYTES; values that are not one token are quoted as JSON."""
    out = ""
    for key, value in pairs.items():
        if value is None or value == "":
            continue
        text = str(value)
        piece = f"{key}={text if re.fullmatch(r'[^\s\"=]+', text) else json.dumps(text, ensure_ascii=False)}"
        if len((out + " " + piece).encode()) > HEADER_BYTES:
            break
        out = f"{out} {piece}".strip()
    return out


def within_budget(rows: DataFrame, size: Column, order: list[Column], by: list[str], most_rows: int = MAX_ROWS, most_bytes: int = MAX_BYTES) -> DataFrame:
    """The first whole rows of each group that fit both the number of rows and of bytes; rank and running bytes are kept."""
    window = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).withColumn("running_bytes", F.sum(size).over(window))
    return ranked.where((F.col("rank") <= most_rows) & (F.col("running_bytes") <= most_bytes))


def as_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct("*")).alias("json"))


def text_page(rows: list[dict], totals: dict, budget: int = 16_384) -> str:
    """A page of hits: a header, then a block for each; whole blocks only, and a hint where the budget cut."""
    out = header(totals) + "\n"
    for i, r in enumerate(rows):
        copies = f" (+{r['copies']} copies)" if r.get("copies") else ""
        block = f"\n{r['session_id']}/{r['ordinal']} {r['kind']}{copies}\n" + "".join(f"  {n}: {t}\n" for n, t in r.get("lines", []))
        if len((out + block).encode()) > budget:
            return out + f"\n… {len(rows) - i} more; next offset {i}\n"
        out += block
    return out


def sign(cursor: str, scope: str, revision: int, key: bytes) -> str:
    """A cursor that holds for one scope and one revision only."""
    body = f"{revision}|{cursor}"
    return f"{body}|{hmac.new(key, f'{scope}|{body}'.encode(), hashlib.sha256).hexdigest()[:32]}"


def verify(signed: str, scope: str, revision: int, key: bytes) -> str:
    """The cursor; ValueError if it was made for another scope or revision, and the walk must start again."""
    number, _, rest = signed.partition("|")
    cursor, _, _ = rest.rpartition("|")
    if not hmac.compare_digest(sign(cursor, scope, int(number), key), signed):
        raise ValueError("the cursor is not of this query")
    if int(number) != revision:
        raise ValueError("the data has changed since; start again")
    return cursor


def outline_lines(messages: DataFrame) -> DataFrame:
    rows = messages.where(live() & on_path())
    return rows.select("conversation_id", "ordinal", F.concat_ws(" ", F.col("ordinal").cast("string"), "kind", F.left(F.regexp_replace("text", r"\s+", " "), F.lit(100))).alias("line"))
