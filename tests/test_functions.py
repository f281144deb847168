import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tallyloom.functions import text as T
from tallyloom.functions.regex import PatternError, required_literals, smart_case, to_java
from tallyloom.operators.filters import Filters
from tallyloom.operators.policy import glob_regex, parse_rule, remote_regex
from tallyloom.operators.search import parse, split_query


@pytest.mark.parametrize("pattern, text, expected", [
    (r"a$", "a\r\nb", False), (r"a$", "a\nb", True), (r"x.y", "x\u0085y", True), (r"x.y", "x\ny", False), (r"[[:digit:]]+z", "12z", True), (r"[[:^alpha:]]", "abc", False), (r"\s", "\x0b", False), (r"(?P<name>ab)c", "abc", True),
    (r"\bion\b", "éion", True), (r"[a&&b]", "&", True), (r"[]a]", "]", True), (r"\Qa.b\E", "a.b", True), (r"\Qa.b\E", "axb", False), (r"\pL+", "é", True), (r"\p{Greek}", "α", True), (r"^b", "a\nb", True),
])
def test_patterns_mean_what_they_mean_elsewhere(spark, pattern, text, expected):
    row = spark.createDataFrame([(text,)], "t string").select(F.col("t").rlike(to_java(pattern))).first()
    assert row[0] is expected


def test_kelvin_sign_folds(spark):
    assert spark.createDataFrame([("K",)], "t string").select(F.col("t").rlike(to_java("k", ignore_case=True))).first()[0]


@pytest.mark.parametrize("pattern", [r"(?=a)", r"(a)\1", r"a++", r"(?U)a", r"[[:nope:]]", "[a", "\\"])
def test_what_the_dialect_lacks_is_refused(pattern):
    with pytest.raises(PatternError):
        to_java(pattern)


@settings(max_examples=300, deadline=None)
@given(st.recursive(st.sampled_from(["abc", "foo", "q", "barn", "."]), lambda x: st.one_of(st.tuples(x, x).map("".join), st.tuples(x, x).map(lambda p: f"(?:{p[0]}|{p[1]})"), x.map(lambda p: f"(?:{p})+"), x.map(lambda p: f"(?:{p})*")), max_leaves=6), st.text("abcforqn", max_size=14))
def test_prefilter_never_loses_a_match(pattern, text):
    found = required_literals(pattern)
    if re.search(pattern, text) and found:
        assert any(x in text for x in found)


def test_prefilter_and_case():
    assert required_literals("foo(?:bar|baz)qux") is not None
    assert required_literals("sake", ignore_case=True) is None
    assert smart_case(["abc", r"\S"]) and not smart_case(["Abc"])


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(T.terms(F.lit("./a/b.py, It's -x Foo_1. --"))) == ["a/b.py", "it", "s", "-x", "foo_1"] == T.plain_terms("./a/b.py, It's -x Foo_1. --")
    assert one(T.clip_bytes(F.lit("é" * 20), 11)) == "éééé…" and one(T.clip_bytes(F.lit("short"), 11)) == "short"
    assert one(T.preview(F.lit("  \n  two  words \nx"))) == "two words"
    assert [one(T.normal_remote(F.lit(u))) for u in ("git@Host.org:me/app.git", "https://u:p@host.org/me/app/", "ssh://git@host.org:22/me/app")] == ["host.org/me/app"] * 3
    assert one(T.last_element(F.lit("/x/.dots.git"))) == "dots"
    assert one(T.entropy(F.lit("abab"))) == 1.0 and one(T.entropy(F.lit(""))) == 0.0
    assert one(T.common_prefix(F.lit("abcd"), F.lit("abxd"))) == 2
    assert one(T.parse_address(F.lit("s-1/4096:7"))).asDict() == {"session": "s-1", "ordinal": 4096, "line": 7}
    assert one(T.clean(F.lit("a\x07b‮c\td"))) == "abc\td"
    assert one(T.number_label(F.lit(1234))) == "1.2k"


def test_plan_time_functions():
    assert T.glob_like("a*b_?") == r"a%b\__" and T.glob_like("x%") == r"%x\%%" and T.repo_match("app/") == ("", "%/app") and T.repo_match("/w/") == ("/w", "")
    assert T.duration_seconds("1h30m") == 5400 and T.duration_seconds("2w") == 1209600
    with pytest.raises(ValueError):
        T.duration_seconds("soon")
    assert split_query('a "b  c" d "e') == (["a", "d"], ["b c", "e"])
    assert parse("a OR b -c").any and parse("a -c").without == ("c",)
    f = Filters(kinds=("user",), since="2026-01-01", limit=9)
    assert Filters.from_dict(f.to_dict()) == f and Filters(limit=9999).clamp() == 500 and Filters(limit=0).clamp() == 20


@pytest.mark.parametrize("pattern, path, hit", [("/a/**", "/a/b/c", True), ("/a", "/a/b", True), ("/a", "/ab", False), ("src", "/x/src/y", True), ("/a/**/z", "/a/z", True), ("/a/**/z", "/a/b/c/z", True), ("/a/*/z", "/a/b/c/z", False), ("/A", "/a", True)])
def test_path_globs(pattern, path, hit):
    assert bool(re.match(glob_regex(pattern), path.lower())) is hit


def test_rules():
    assert bool(re.match(remote_regex("github.com/me/*"), "github.com/me/x")) and not re.match(remote_regex("github.com/me/*"), "evil/github.com/me/x")
    assert parse_rule("deny repo:github.com/x", admin=True).repo
    with pytest.raises(ValueError):
        parse_rule("maybe /x")
