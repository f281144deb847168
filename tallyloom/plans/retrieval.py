"""Queries of search and listing: grep, ranked search, lines, pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import text as T
from tallyloom.operators import filters as fl, grep as g, search as s, sessions as se
from tallyloom.plans.fixtures import cte, frame
from tallyloom.plans.registry import query
from tallyloom.sources import views as v

#: conversations as messages, in SQL.
CHAT = """chat AS (SELECT conv_id::VARCHAR || '/' || lpad(turn::VARCHAR, 6, '0') AS id, conv_id::VARCHAR AS session_id, turn << 12 AS ordinal, role AS kind, text, sha256(text) AS content_sha FROM conversations)"""
CORPUS = """corpus AS (SELECT lpad(doc_id::VARCHAR, 12, '0') AS id, source AS session_id, doc_id AS ordinal, lang AS kind, text, sha256(text) AS content_sha FROM documents)"""
WORDS = r"'[\p{L}\p{N}\p{Co}_\-./]+'"
TERMS = rf"list_filter(list_transform(regexp_extract_all(text, {WORDS}), lambda t: lower(regexp_replace(regexp_replace(t, '^[./]+', ''), '[-./]+$', ''))), lambda t: t <> '')"

WORD_ION = g.Pattern((r"[A-Z][a-z]+ion\b",), ignore_case=False)


@query("grep_content", f"""WITH {CHAT}, hits AS (SELECT *, row_number() OVER (PARTITION BY content_sha ORDER BY id) AS n, count(*) OVER (PARTITION BY content_sha) - 1 AS copies
FROM chat WHERE regexp_matches(text, '(?m)[A-Z][a-z]+ion\\b')) SELECT id, session_id, kind, copies, text FROM hits WHERE n = 1 ORDER BY id LIMIT 20""".replace("\\\\", "\\"))  # fmt: skip
def grep_content(spark, sf_dir):
    page = g.page(v.chat(spark, sf_dir), WORD_ION, limit=20)
    return page.select("id", "session_id", "kind", "copies", "text")


@query("grep_literal_icase", f"WITH {CORPUS} SELECT id, session_id FROM corpus WHERE lower(text) LIKE '%thatand%' OR lower(text) LIKE '%license%'")
def grep_literal_icase(spark, sf_dir):
    return g.found(v.corpus(spark, sf_dir), g.Pattern(("THATAND", "License"), fixed=True, ignore_case=True)).select("id", "session_id")


@query("grep_regex_icase", f"WITH {CORPUS} SELECT id FROM corpus WHERE regexp_matches(text, '(?im)^the.*(tion|ing)\\.$')".replace("\\\\", "\\"))
def grep_regex_icase(spark, sf_dir):
    return g.found(v.corpus(spark, sf_dir), g.Pattern((r"^the.*(tion|ing)\.$",))).select("id")


@query("grep_words", f"WITH {CORPUS} SELECT id FROM corpus WHERE regexp_matches(text, '\\b(?:ouan|that)\\b')")
def grep_words(spark, sf_dir):
    return g.found(v.corpus(spark, sf_dir), g.Pattern(("ouan|that",), words=True, ignore_case=False)).select("id")


@query("grep_multiline", f"WITH {CORPUS} SELECT id FROM corpus WHERE regexp_matches(text, '(?s)ing\\.\\n[A-Z]')")
def grep_multiline(spark, sf_dir):
    return g.found(v.corpus(spark, sf_dir), g.Pattern((r"ing\.\n[A-Z]",), multiline=True, ignore_case=False)).select("id")


@query("filter_kinds", f"WITH {CHAT} SELECT kind, count(*) AS n FROM chat WHERE kind IN ('user', 'assistant') AND kind NOT IN ('assistant') GROUP BY kind")
def filter_kinds(spark, sf_dir):
    f = fl.Filters(kinds=("user", "assistant"), not_kinds=("assistant",), include_superseded=True, include_off_path=True)
    return v.chat(spark, sf_dir).where(f.message_predicate()).groupBy("kind").agg(F.count("*").alias("n"))


@query("filter_time_range", "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12'")
def filter_time_range(spark, sf_dir):
    f = fl.Filters(since="2024-01-10", until="2024-01-12", include_superseded=True, include_off_path=True)
    return v.table(spark, sf_dir, "events").withColumn("kind", F.col("event_type")).where(f.message_predicate()).select("event_id", "ts")


@query("filter_tools_ci", f"WITH {cte('messages')} SELECT id FROM messages WHERE NOT superseded AND coalesce(on_active_path, TRUE) AND kind <> 'injected' AND lower(tool_name) IN ('bash', 'write')")
def filter_tools_ci(spark, sf_dir):
    return frame(spark, "messages", sf_dir).where(fl.Filters(tools=("BASH", "write")).message_predicate()).select("id")


@query("filter_glob_ilike", f"""WITH {cte('sessions')} SELECT id FROM sessions WHERE hidden_at IS NULL AND (session_id ILIKE '%beta%' OR coalesce(title ILIKE '%beta%', FALSE) OR coalesce(coalesce(repo_root, cwd) ILIKE '%beta%', FALSE)
  OR coalesce(split_part(coalesce(repo_root, cwd), '/', -1) ILIKE '%beta%', FALSE))""")  # fmt: skip
def filter_glob_ilike(spark, sf_dir):
    return frame(spark, "sessions", sf_dir).where(fl.Filters(sessions="BETA").session_predicate()).select("id")


@query("filter_glob_escapes", f"WITH {cte('sessions')} SELECT id FROM sessions WHERE hidden_at IS NULL AND title LIKE '100\\%\\_%' ESCAPE '\\'")
def filter_glob_escapes(spark, sf_dir):
    return frame(spark, "sessions", sf_dir).where(fl.Filters(sessions="100%_*").session_predicate()).select("id")


@query("filter_branch", f"WITH {cte('sessions')} SELECT id FROM sessions WHERE hidden_at IS NULL AND len(list_filter(branches, lambda b: b ILIKE 'main')) > 0")
def filter_branch(spark, sf_dir):
    return frame(spark, "sessions", sf_dir).where(fl.Filters(branch="main").session_predicate()).select("id")


@query("filter_repo", f"WITH {cte('sessions')} SELECT id FROM sessions WHERE hidden_at IS NULL AND (repo_root = '/work/app' OR repo_root LIKE '/work/app/%' OR cwd = '/work/app' OR cwd LIKE '/work/app/%')")
def filter_repo(spark, sf_dir):
    return frame(spark, "sessions", sf_dir).where(fl.Filters(repo="/work/app").session_predicate()).select("id")


@query("filter_repo_name", f"WITH {cte('sessions')} SELECT id FROM sessions WHERE hidden_at IS NULL AND ('/' || repo_root ILIKE '%/app' OR '/' || cwd ILIKE '%/app')")
def filter_repo_name(spark, sf_dir):
    return frame(spark, "sessions", sf_dir).where(fl.Filters(repo="app").session_predicate()).select("id")


@query("filter_live", f"WITH {cte('sessions')} SELECT id FROM sessions WHERE hidden_at IS NULL AND NOT coalesce(last_activity_at > TIMESTAMP '2026-01-06 01:05:00' - INTERVAL 10 MINUTE, FALSE)")
def filter_live(spark, sf_dir):
    return frame(spark, "sessions", sf_dir).where(fl.Filters(exclude_live=True, now="2026-01-06 01:05:00").session_predicate()).select("id")


@query("filter_top_level", f"WITH {cte('sessions')} SELECT id FROM sessions WHERE hidden_at IS NULL AND depth = 0 AND parent_session_id IS NULL AND agent IN ('claude', 'devin')")
def filter_top_level(spark, sf_dir):
    return frame(spark, "sessions", sf_dir).where(fl.Filters(exclude_subagents=True, agents=("claude", "devin")).session_predicate()).select("id")


@query("filter_device_user", f"WITH {cte('sessions', 'devices', 'users')} SELECT s.id FROM sessions s JOIN devices d ON d.id = s.device_id AND (d.id = 'laptop' OR d.name = 'laptop') JOIN users u ON u.id = s.user_id AND (u.id = 'ann@example.org' OR lower(u.email) = 'ann@example.org')")
def filter_device_user(spark, sf_dir):
    return fl.by_device_or_user(frame(spark, "sessions", sf_dir), frame(spark, "devices", sf_dir), frame(spark, "users", sf_dir), "laptop", "ANN@example.org").select("id")


@query("filter_tombstones", f"WITH {cte('sessions', 'tombstones')} SELECT id FROM sessions s WHERE NOT EXISTS (SELECT 1 FROM tombstones t WHERE t.user_id = s.user_id AND t.session_id = s.session_id)")
def filter_tombstones(spark, sf_dir):
    return fl.without_tombstones(frame(spark, "sessions", sf_dir), frame(spark, "tombstones", sf_dir)).select("id")


@query("default_view_tristate", f"WITH {cte('messages', 'sessions')} SELECT m.id FROM messages m JOIN sessions s ON s.id = m.conversation_id WHERE NOT m.superseded AND coalesce(m.on_active_path, TRUE) AND m.kind <> 'injected' AND s.hidden_at IS NULL")
def default_view_tristate(spark, sf_dir):
    return fl.scoped(frame(spark, "messages", sf_dir), frame(spark, "sessions", sf_dir), fl.Filters()).select("id")


LICENSE = g.Pattern(("License",), fixed=True, ignore_case=False)
THE_TION = g.Pattern((r"th[a-z]+tion",), ignore_case=False)


@query("grep_collapse_copies", f"WITH {CORPUS} SELECT min(id) AS id, count(*) - 1 AS copies FROM corpus WHERE text LIKE '%License%' GROUP BY content_sha")
def grep_collapse_copies(spark, sf_dir):
    return g.collapsed(g.found(v.corpus(spark, sf_dir), LICENSE), g.newest()).select("id", "copies")


COUNTED = f"""WITH {CORPUS}, h AS (SELECT DISTINCT session_id, content_sha, len(regexp_extract_all(text, 'th[a-z]+tion')) AS n FROM corpus WHERE regexp_matches(text, 'th[a-z]+tion'))
SELECT session_id, count(*) AS messages, sum(n)::BIGINT AS matches FROM h GROUP BY session_id"""


@query("grep_sessions_l", f"SELECT session_id FROM ({COUNTED}) t")
def grep_sessions_l(spark, sf_dir):
    return g.sessions_with(v.corpus(spark, sf_dir), THE_TION).select("session_id")


@query("grep_count_c", COUNTED)
def grep_count_c(spark, sf_dir):
    return g.sessions_with(v.corpus(spark, sf_dir), THE_TION)


@query("grep_totals", f"WITH {CORPUS} SELECT count(*) AS messages, count(DISTINCT content_sha) AS texts, count(DISTINCT session_id) AS sessions FROM corpus WHERE regexp_matches(text, 'th[a-z]+tion')")
def grep_totals(spark, sf_dir):
    return g.totals(v.corpus(spark, sf_dir), THE_TION)


@query("grep_relevance", f"""WITH {CORPUS}, h AS (SELECT id, content_sha, least(len(regexp_extract_all(text, 'th[a-z]+tion')), 1000) AS matches FROM corpus WHERE regexp_matches(text, 'th[a-z]+tion')),
c AS (SELECT min(id) AS id, matches FROM h GROUP BY content_sha, matches) SELECT id, matches FROM c ORDER BY matches DESC, id LIMIT 25""")  # fmt: skip
def grep_relevance(spark, sf_dir):
    return g.page(v.corpus(spark, sf_dir), THE_TION, order="relevance", limit=25).select("id", "matches")


@query("grep_max_per_session", f"""WITH {CORPUS}, c AS (SELECT id, session_id, row_number() OVER (PARTITION BY content_sha ORDER BY id) AS n FROM corpus WHERE regexp_matches(text, 'th[a-z]+tion')),
k AS (SELECT id, session_id, row_number() OVER (PARTITION BY session_id ORDER BY id) AS m FROM c WHERE n = 1) SELECT id, session_id FROM k WHERE m <= 2""")  # fmt: skip
def grep_max_per_session(spark, sf_dir):
    hits = g.collapsed(g.found(v.corpus(spark, sf_dir), THE_TION), g.newest())
    return g.capped_per_session(hits, g.newest(), 2).select("id", "session_id")


@query("grep_oldest_nulls_last", f"WITH {cte('messages')} SELECT id, ts FROM messages WHERE text ILIKE '%parser%' ORDER BY ts ASC NULLS LAST, id LIMIT 12")
def grep_oldest_nulls_last(spark, sf_dir):
    rows = frame(spark, "messages", sf_dir).withColumn("content_sha", F.col("id"))
    return g.page(rows, g.Pattern(("parser",), fixed=True, ignore_case=True), order="oldest", limit=12).select("id", "ts")


@query("grep_continuation", f"WITH {cte('messages')} SELECT id FROM messages WHERE text ILIKE '%parser%' AND (ts < TIMESTAMP '2026-01-02 08:02:00' OR (ts = TIMESTAMP '2026-01-02 08:02:00' AND id > 'm16') OR ts IS NULL) ORDER BY ts DESC NULLS LAST, id LIMIT 5")
def grep_continuation(spark, sf_dir):
    rows = frame(spark, "messages", sf_dir).withColumn("content_sha", F.col("id"))
    return g.continued(rows, g.Pattern(("parser",), fixed=True, ignore_case=True), ("2026-01-02 08:02:00", "m16"), 5).select("id")


@query("sessions_list", f"WITH {cte('sessions')} SELECT id, last_activity_at FROM sessions WHERE hidden_at IS NULL ORDER BY last_activity_at DESC NULLS LAST, id DESC LIMIT 5")
def sessions_list(spark, sf_dir):
    rows = frame(spark, "sessions", sf_dir).where("hidden_at is null")
    return rows.orderBy(*se.listing(rows)).limit(5).select("id", "last_activity_at")


@query("sessions_keyset_page", f"WITH {cte('sessions')} SELECT id FROM sessions WHERE last_activity_at < TIMESTAMP '2026-01-03 12:10:10' OR (last_activity_at = TIMESTAMP '2026-01-03 12:10:10' AND id < 'c3') OR last_activity_at IS NULL ORDER BY last_activity_at DESC NULLS LAST, id DESC LIMIT 4")
def sessions_keyset_page(spark, sf_dir):
    return se.page_after(frame(spark, "sessions", sf_dir), ("2026-01-03 12:10:10", "c3"), 3).select("id")


@query("user_activity_page", "SELECT user_id, max(ts) AS last_activity_at, count(*) AS n FROM events GROUP BY user_id ORDER BY last_activity_at DESC, user_id LIMIT 30")
def user_activity_page(spark, sf_dir):
    rows = v.table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("last_activity_at"), F.count("*").alias("n"))
    return rows.orderBy(F.col("last_activity_at").desc(), "user_id").limit(30)


@query("offset_page", f"WITH {CORPUS}, c AS (SELECT min(id) AS id FROM corpus WHERE regexp_matches(text, 'th[a-z]+tion') GROUP BY content_sha) SELECT id FROM c ORDER BY id LIMIT 10 OFFSET 20")
def offset_page(spark, sf_dir):
    return g.page(v.corpus(spark, sf_dir), THE_TION, limit=10, offset=20).select("id")


LINES = f"""{CHAT}, l AS (SELECT id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line, unnest(string_split(text, chr(10))) AS line_text FROM chat WHERE regexp_matches(text, 'th[a-z]+tion')),
m AS (SELECT *, regexp_matches(line_text, 'th[a-z]+tion') AS is_match FROM l)"""


@query("grep_lines", f"WITH {LINES} SELECT id, line::INTEGER AS line, line_text FROM m WHERE is_match")
def grep_lines(spark, sf_dir):
    return g.lines(g.found(v.chat(spark, sf_dir), THE_TION), THE_TION).select("id", "line", "line_text")


@query("grep_context_lines", f"WITH {LINES}, n AS (SELECT *, max(is_match) OVER (PARTITION BY id ORDER BY line ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS near FROM m) SELECT id, line::INTEGER AS line, line_text, is_match FROM n WHERE near")
def grep_context_lines(spark, sf_dir):
    return g.lines(g.found(v.chat(spark, sf_dir), THE_TION), THE_TION, before=1, after=2)


@query("grep_only_matching", f"WITH {LINES} SELECT id, line::INTEGER AS line, unnest(range(1, len(x) + 1))::INTEGER AS nth, unnest(x) AS match FROM (SELECT id, line, regexp_extract_all(line_text, 'th[a-z]+tion') AS x FROM m WHERE is_match) t")
def grep_only_matching(spark, sf_dir):
    return g.only_matching(g.found(v.chat(spark, sf_dir), THE_TION), THE_TION)


@query("search_snippet", f"""WITH {CORPUS}, a AS (SELECT id, text, strpos(lower(text), 'license') AS pos FROM corpus WHERE lower(text) LIKE '%license%'), b AS (SELECT *, greatest(pos - 40, 1) AS start FROM a)
SELECT id, (CASE WHEN start > 1 THEN '…' ELSE '' END || regexp_replace(substring(text, start, 160), '[ \\t\\n\\r]+', ' ', 'g') || CASE WHEN start + 160 <= length(text) THEN '…' ELSE '' END) AS snippet,
  (length(substring(text, 1, pos - 1)) - length(replace(substring(text, 1, pos - 1), chr(10), '')) + 1)::INTEGER AS line FROM b""")  # fmt: skip
def search_snippet(spark, sf_dir):
    rows = v.corpus(spark, sf_dir).where(F.lower("text").contains("license"))
    return rows.select("id", s.snippet(F.col("text"), "license").alias("s")).select("id", "s.*")


@query("tokenize_terms", f"SELECT term, count(*) AS n FROM (SELECT unnest({TERMS}) AS term FROM documents) t GROUP BY term")
def tokenize_terms(spark, sf_dir):
    return v.corpus(spark, sf_dir).select(F.explode(T.terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


_indexes: dict[tuple, object] = {}


def file_state(spark, rows) -> tuple:
    """The session, and the name, size and time of every file that the rows come from."""
    files = [spark._jvm.org.apache.hadoop.fs.Path(f) for f in sorted(rows.inputFiles())]
    found = [p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p) for p in files]
    return (spark.sparkContext.applicationId, *((str(x.getPath()), x.getLen(), x.getModificationTime()) for x in found))


def indexed(spark, sf_dir):
    """The stored index of documents: built once for a session and state of the table's files, then only read."""
    from uuid import uuid4

    from tallyloom.operators.index import SearchIndex
    from tallyloom.sources.shared import shared_folder

    rows = v.corpus(spark, sf_dir)
    key = file_state(spark, rows)
    if key not in _indexes:
        _indexes[key] = SearchIndex.build(rows, f"{shared_folder(spark)}/index-{uuid4().hex}")
    return _indexes[key]


def _bm25(condition: str, words: list[str], extra: str = "") -> str:
    part = lambda w: f"greatest(ln((N - n_{w} + 0.5) / (n_{w} + 0.5)), 1e-6) * f_{w} * 2.2 / (f_{w} + 1.2 * (0.25 + 0.75 * dl / avgdl))"
    return f"""WITH {CORPUS}, t AS (SELECT id, text, kind, {TERMS} AS w FROM corpus), d AS (SELECT id, text, kind, len(w) AS dl, {', '.join(f"len(list_filter(w, lambda x: x = '{w}')) AS f_{w}" for w in words)} FROM t),
st AS (SELECT count(*) AS N, avg(dl) AS avgdl, {', '.join(f'count(*) FILTER (WHERE f_{w} > 0) AS n_{w}' for w in words)} FROM d)
SELECT id, round({' + '.join(part(w) for w in words)}, 6) AS score FROM d, st WHERE {condition} {extra}"""


@query("search_bm25_all", _bm25("f_license > 0 AND f_version > 0", ["license", "version"]))
def search_bm25_all(spark, sf_dir):
    return indexed(spark, sf_dir).bm25(s.parse("License version")).select("id", F.round("score", 6).alias("score"))


@query("search_bm25_any", _bm25("(f_license > 0 OR f_token > 0)", ["license", "token"]))
def search_bm25_any(spark, sf_dir):
    return indexed(spark, sf_dir).bm25(s.parse("license OR token")).select("id", F.round("score", 6).alias("score"))


@query("search_bm25_top", _bm25("(f_the > 0 OR f_of > 0)", ["the", "of"], "ORDER BY score DESC, id LIMIT 20"))
def search_bm25_top(spark, sf_dir):
    scored = indexed(spark, sf_dir).bm25(s.parse("the of", any_=True)).select("id", F.round("score", 6).alias("score"))
    return scored.orderBy(F.col("score").desc(), "id").limit(20)


@query("search_phrase", f"WITH {CORPUS} SELECT id FROM corpus WHERE lower(text) LIKE '%apache license, version%'")
def search_phrase(spark, sf_dir):
    return s.matching(v.corpus(spark, sf_dir), s.parse('"Apache License, Version"')).select("id")


@query("search_prefix_term", f"WITH {CORPUS} SELECT id FROM corpus WHERE len(list_filter({TERMS}, lambda t: starts_with(t, 'licen'))) > 0")
def search_prefix_term(spark, sf_dir):
    return s.matching(indexed(spark, sf_dir), s.parse("licen*")).select("id")


@query("search_without", f"WITH {CORPUS} SELECT id FROM corpus WHERE list_contains({TERMS}, 'license') AND NOT list_contains({TERMS}, 'apache')")
def search_without(spark, sf_dir):
    return s.matching(indexed(spark, sf_dir), s.parse("license -apache")).select("id")


@query("search_auto_relax", f"WITH {CORPUS} SELECT id FROM corpus WHERE list_contains({TERMS}, 'apache') AND list_contains({TERMS}, 'license')")
def search_auto_relax(spark, sf_dir):
    rows = indexed(spark, sf_dir)
    return s.matching(rows, s.relaxed(rows, "what is the Apache qqqzzz License")).select("id")


@query("search_newest", f"WITH {cte('messages')} SELECT id, ts FROM messages WHERE NOT superseded AND list_contains({TERMS}, 'parser') ORDER BY ts DESC NULLS LAST, id LIMIT 6")
def search_newest(spark, sf_dir):
    return s.matching(frame(spark, "messages", sf_dir).where(fl.live()), s.parse("parser")).orderBy(*g.newest()).limit(6).select("id", "ts")


@query("search_probe_count", f"WITH {CORPUS} SELECT count(*) AS n FROM (SELECT id FROM corpus WHERE list_contains({TERMS}, 'the') LIMIT 100) t")
def search_probe_count(spark, sf_dir):
    return s.matching(indexed(spark, sf_dir), s.parse("the")).limit(100).agg(F.count("*").alias("n"))


@query("trigram_candidates", f"""WITH {CORPUS}, g AS (SELECT id, list_distinct(list_transform(range(1, length(text) - 1), lambda i: lower(substring(text, i, 3)))) AS x FROM corpus WHERE length(text) >= 3)
SELECT id FROM g WHERE list_has_all(x, ['lic', 'ice', 'cen'])""")  # fmt: skip
def trigram_candidates(spark, sf_dir):
    rows = v.corpus(spark, sf_dir).withColumn("x", g.trigrams(F.col("text")))
    return rows.where(F.size(F.array_intersect("x", F.array(F.lit("lic"), F.lit("ice"), F.lit("cen")))) == 3).select("id")


@query("benchmark_phrases", "SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def benchmark_phrases(spark, sf_dir):
    return phrases(v.table(spark, sf_dir, "documents"), v.table(spark, sf_dir, "benchmark"))


def phrases(documents, benchmark):
    """Whole items as literal patterns, one row per pair of rows. An equality join narrows the pairs that are compared,
    on what each text that contains the item must have: the item's second to fourth word, which stand between white
    space in the item itself, or, of items with fewer than five words, its first three characters (all, if fewer)."""
    words = F.split("text", r"\s+")
    items = benchmark.where("text is not null").groupBy("item_id", F.col("text").alias("item")).agg(F.count("*").alias("n")).withColumn("w", F.split("item", r"\s+"))
    docs = documents.select("doc_id", "text", F.xxhash64("text").alias("h")).where("text is not null")
    # Only hashes of texts meet the items; the texts themselves are fetched for the pairs that are left.
    long = items.where(F.size("w") >= 5).select("item_id", "item", "n", F.array_join(F.slice("w", 2, 3), " ").alias("head"))
    heads = docs.select("h", words.alias("w")).where(F.size("w") >= 5).select("h", F.explode(F.transform(F.slice("w", F.lit(1), F.size("w") - 2), lambda x, i: F.concat_ws(" ", x, F.get("w", i + 1), F.get("w", i + 2)))).alias("head"))
    met = heads.join(long, "head").select("h", "item_id", "item", "n")
    short = items.where(F.size("w") < 5).select("item_id", "item", "n", F.substring("item", 1, 3).alias("head"))
    lengths = sorted(r.n for r in short.select(F.length("head").alias("n")).distinct().collect())
    if lengths:
        # Runs of as many characters as the heads have; the last ones of a text are shorter and meet no head that is not there.
        runs = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("text"), F.lit(1))), lambda i: F.substring(F.col("text"), i, F.lit(n)))
        grams = docs.select("h", F.explode(F.array_distinct(F.concat(*[runs(n) for n in lengths]))).alias("head"))
        met = met.unionByName(grams.join(short, "head").select("h", "item_id", "item", "n"))
    pairs = docs.join(met.distinct(), "h").where(F.col("text").contains(F.col("item")))
    return pairs.select("doc_id", "item_id", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k")).drop("k")


@query("output_budget", f"""WITH {CHAT}, b AS (SELECT id, session_id, row_number() OVER w AS rank, sum(octet_length(encode(text))) OVER w AS running_bytes FROM chat WINDOW w AS (PARTITION BY session_id ORDER BY ordinal, id ROWS UNBOUNDED PRECEDING))
SELECT id, session_id, rank::INTEGER AS rank, running_bytes::BIGINT AS running_bytes FROM b WHERE rank <= 4 AND running_bytes <= 3000""")  # fmt: skip
def output_budget(spark, sf_dir):
    from tallyloom.operators.render import within_budget

    rows = within_budget(v.chat(spark, sf_dir), F.octet_length("text").cast("long"), [F.col("ordinal"), F.col("id")], ["session_id"], 4, 3000)
    return rows.select("id", "session_id", "rank", "running_bytes")


@query("short_session_ids", """WITH s AS (SELECT DISTINCT sha256(conv_id::VARCHAR) AS session_id FROM conversations), o AS (SELECT session_id, lag(session_id) OVER (ORDER BY session_id) AS p, lead(session_id) OVER (ORDER BY session_id) AS n FROM s),
c AS (SELECT session_id, (SELECT max(k) FROM range(0, 65) r(k) WHERE left(p, k::INT) = left(session_id, k::INT) OR left(n, k::INT) = left(session_id, k::INT)) AS shared FROM o)
SELECT session_id, left(session_id, greatest(coalesce(shared, 0) + 1, 8)::INT) AS short FROM c""")  # fmt: skip
def short_session_ids(spark, sf_dir):
    ids = v.table(spark, sf_dir, "conversations").select(F.sha2(F.col("conv_id").cast("string"), 256).alias("session_id"))
    return se.short_ids(ids)
