"""Text functions on columns, and their plan-time counterparts."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

#: A run of letters, numbers, private-use characters and _-./ is one term: without ./ at its beginning and -./ at its end.
RUN = r"[\p{L}\p{N}\p{Co}_\-./]++"

#: English words that a relaxed search leaves out.
STOPWORDS = frozenset(
    "a about after all also an and any are as at be been but by can could did do does for from had has have how i if in into is it its just me my no not of on or our so some than that the their them "
    "then there these they this to too us was we were what when where which while who why will with would you your".split()
)


def terms(text: Column) -> Column:
    """The index terms of a text, in order, in lower case."""
    trimmed = F.transform(F.regexp_extract_all(text, F.lit(RUN), F.lit(0)), lambda t: F.lower(F.ltrim(F.rtrim(t, F.lit("-./")), F.lit("./"))))
    return F.filter(trimmed, lambda t: t != "")


def n_terms(text: Column) -> Column:
    return F.size(terms(text))


def plain_terms(query: str) -> list[str]:
    """The same at plan time."""
    import regex

    return [t for t in (r.rstrip("-./").lstrip("./").lower() for r in regex.findall(RUN, query)) if t]


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def like_escape(s: str) -> str:
    return re.sub(r"([\\%_])", r"\\\1", s)


def glob_like(glob: str) -> str:
    """LIKE pattern of a glob; without a wildcard it matches anywhere inside."""
    if not glob:
        return ""
    if "*" not in glob and "?" not in glob:
        return f"%{like_escape(glob)}%"
    return _wild(glob)


def _wild(glob: str) -> str:
    return "".join({"*": "%", "?": "_"}.get(c, like_escape(c)) for c in glob)


def repo_match(repo: str) -> tuple[str, str]:
    """(path prefix, LIKE pattern) of a repository argument; one of them is empty."""
    if not repo:
        return "", ""
    if any(c in repo for c in "*?["):
        return "", ("" if "/" in repo else "%/") + _wild(repo)
    if repo.startswith("/"):
        return repo.removesuffix("/"), ""
    return "", "%/" + like_escape(repo.removesuffix("/"))


def under(path: Column, prefix: str) -> Column:
    """The path is the prefix or lies below it."""
    return (path == prefix) | path.startswith(prefix + "/")


def last_element(path: Column) -> Column:
    """Last element of a path or remote, without .git and leading dots."""
    return F.regexp_replace(F.regexp_replace(F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1), r"\.git$", ""), r"^\.+", "")


def normal_remote(url: Column) -> Column:
    """host/owner/name of a remote URL in any of its spellings."""
    out = F.regexp_replace(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    out = F.regexp_replace(out, r"^[^@/]*@", "")
    out = F.regexp_replace(out, r"^([^/:]+):(?:[0-9]+/)?", "$1/")
    out = F.regexp_replace(F.regexp_replace(out, r"/+$", ""), r"\.git$", "")
    host = F.lower(F.split(out, "/")[0])
    return F.when(F.instr(out, "/") > 0, F.concat(host, F.substring(out, F.instr(out, "/"), F.length(out)))).otherwise(host)


def preview(text: Column, n: int = 80) -> Column:
    """First line that holds more than white space, cut to n characters."""
    lines = F.filter(F.transform(F.split(text, "\n"), one_line), lambda x: x != "")
    return F.left(F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit("")), F.lit(n))


def clean(text: Column) -> Column:
    """Without control and direction characters, tabs and line feeds excepted."""
    return F.regexp_replace(text, r"[\x00-\x08\x0b-\x1f\x7f\u0080-\u009f\u200e\u200f\u202a-\u202e\u2066-\u2069]", "")


def clip_bytes(text: Column, n: int) -> Column:
    """At most n bytes, cut at a character, the cut marked by an ellipsis of three bytes."""
    body = F.left(text, F.lit(n))
    # The longest prefix within the bytes: its length is found among the prefixes' byte sizes.
    fits = F.aggregate(F.split(body, ""), F.struct(F.lit(0).alias("bytes"), F.lit(0).alias("chars")), lambda acc, c: F.when((acc["bytes"] + F.octet_length(c) <= n - 3) & (acc["bytes"] >= 0), F.struct((acc["bytes"] + F.octet_length(c)).alias("bytes"), (acc["chars"] + 1).alias("chars"))).otherwise(F.struct(F.lit(-1).alias("bytes"), acc["chars"].alias("chars"))), lambda acc: acc["chars"])
    return F.when(F.octet_length(text) <= n, text).otherwise(F.concat(F.rtrim(F.substring(text, F.lit(1), fits)), F.lit("…")))


def number_label(n: Column) -> Column:
    """1.2k, 3.4M: numbers from a thousand on, with one digit."""
    return F.when(n < 1000, n.cast("string")).when(n < 1_000_000, F.concat(F.round(n / 1000, 1).cast("string"), F.lit("k"))).otherwise(F.concat(F.round(n / 1_000_000, 1).cast("string"), F.lit("M")))


def plural(n: Column, one: str, many: str | None = None) -> Column:
    """"1 file", "2 files"."""
    return F.concat_ws(" ", n.cast("string"), F.when(n == 1, F.lit(one)).otherwise(F.lit(many or one + "s")))


def place_label(repo: Column, branches: Column) -> Column:
    """repo@branch; several branches in their order, as a→b."""
    return F.concat(last_element(repo), F.when(F.size(branches) > 0, F.concat(F.lit("@"), F.array_join(branches, "→"))).otherwise(F.lit("")))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common beginning."""
    chars = lambda s: F.filter(F.split(s, ""), lambda c: c != "")
    same = F.zip_with(chars(a), chars(b), lambda x, y: x.eqNullSafe(y))
    end = F.array_position(same, F.lit(False))
    return F.coalesce(F.when(end > 0, end - 1).otherwise(F.size(same)), F.lit(0)).cast("int")


def duration_seconds(spec: str) -> float:
    """Seconds of "90m", "36h", "7d", "2w", or a sum such as "1h30m"."""
    units = {"ms": 0.001, "s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}
    parts = re.findall(r"(\d+(?:\.\d+)?)(ms|[smhdw])", spec)
    if not parts or "".join(a + b for a, b in parts) != spec:
        raise ValueError(f"not a duration: {spec}")
    return sum(float(a) * units[b] for a, b in parts)


def entropy(text: Column) -> Column:
    """Shannon entropy in bits per character: log2(n) less the mean of log2 of how often each character stands in the text.
    The characters are sorted, so that one walk counts them."""
    chars = F.array_sort(F.filter(F.split(text, ""), lambda c: c != ""))
    weight = lambda n: F.when(n > 0, n * F.log2(n)).otherwise(F.lit(0.0))
    kind = "struct<last:string,n:bigint,total:double>"

    def step(acc, c):
        same = F.struct(acc["last"].alias("last"), (acc["n"] + 1).alias("n"), acc["total"].alias("total"))
        other = F.struct(c.alias("last"), F.lit(1).alias("n"), (acc["total"] + weight(acc["n"])).alias("total"))
        return F.when(acc["last"] == c, same.cast(kind)).otherwise(other.cast(kind))

    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("n"), F.lit(0.0).alias("total")).cast(kind)
    n = F.char_length(text)
    return F.when(n > 0, F.log2(n) - F.aggregate(chars, start, step, lambda acc: acc["total"] + weight(acc["n"])) / n).otherwise(F.lit(0.0))


def address(session: Column, ordinal: Column) -> Column:
    return F.concat_ws("/", session, ordinal.cast("string"))


def parse_address(text: Column) -> Column:
    """session, ordinal and line of SESSION/ORDINAL[:LINE]; null where absent."""
    pattern = r"^(.+?)(?:/(\d+))?(?::(\d+))?$"
    part = lambda i: F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))
    return F.struct(part(1).alias("session"), part(2).cast("long").alias("ordinal"), part(3).cast("int").alias("line"))


def line_window(text: Column, line: Column, before: int, after: int) -> Column:
    """The lines around a line (from 1), joined."""
    first = F.greatest(line - before, F.lit(1))
    return F.array_join(F.slice(F.split(text, "\n"), first, line + after - first + 1), "\n")


def line_range(suffix: str) -> tuple[int, int] | None:
    """(first, last) of "L10-L20", "10-20" or "L10"; None if it is no range."""
    m = re.fullmatch(r"L?(\d+)(?:-L?(\d+))?", suffix)
    if not m or int(m[1]) < 1 or int(m[2] or m[1]) < int(m[1]):
        return None
    return int(m[1]), int(m[2] or m[1])
