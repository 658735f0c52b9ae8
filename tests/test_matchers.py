import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronoloom.plans.matchers import Matcher, effective, predicate, value_predicate
from chronoloom.plans.regex import Refused, translate

VALUES = ["", "a", "b", "ab", "abc", "node1", "node*", "(", "a(", "vm0", "vm12", "abc\n", "a.b", "aXb", "A", "é", "a b", "a\tb", "x{", "[", "&", "a&", "12", "a-b", "_"]


def matches(spark, pattern, values=VALUES):
    df = spark.createDataFrame([(v,) for v in values], "v string").where(F.coalesce(value_predicate(F.col("v"), Matcher("n", pattern, True)), F.lit(False)))
    return sorted(r["v"] for r in df.collect())


@pytest.mark.parametrize("pattern", ["a|b|vm0", "node.*", "node*", ".*b", "a.b", "[a-c]+", "[[:alpha:]]+", "[^a]", r"\d+", r"a\sb", "(?i)a", "(?P<n>a)(?P<m>b)", "x{", r"\Qa.b\E", "a{1,2}b?c?", "(a|b)+", "[&]", r"[\[]", "[]a]", "a$", "^a", r"\x61", r"\141", "(?s).*", "vm[0-9]{1,2}", ".+", "", "a-b|_", r"\w", r"\p{L}", r"[\p{Lu}]", "(?:a|ab)(?:c|b)"])
def test_patterns_match_what_re2_matches(spark, pattern):
    values = [v for v in VALUES if "\n" not in v]
    con = duckdb.connect()
    expected = sorted(v for v in values if v and con.execute("SELECT regexp_full_match(?, ?)", [v, pattern]).fetchone()[0])
    assert matches(spark, pattern, values) == expected


@pytest.mark.parametrize("pattern", ["(", "a)", "*", "a**", "a++", "(?=a)a", "(?<!a)b", r"(a)\1", "(?>a)", "a{1001}", "a{3,2}", "[z-a]", "[a", r"\h", r"\Z", "a\\", "(?P<n>a)(?P<n>b)", "(?#x)a", "[[:nope:]]", r"\y"])
def test_what_re2_refuses_compares_the_text(spark, pattern):
    with pytest.raises(Refused):
        translate(pattern)
    assert matches(spark, pattern, [*VALUES, pattern]) == [v for v in sorted([*VALUES, pattern]) if v == pattern]


def test_whole_values_only(spark):
    assert matches(spark, "node*") == []
    assert matches(spark, "abc") == ["abc"]
    assert "abc\n" in matches(spark, "(?s)abc.*") and "abc\n" not in matches(spark, "abc.*")


@pytest.mark.parametrize(("pattern", "part"), [("disk.*", ("disk", "", "")), (".*io", ("", "io", "")), ("a.*b", ("a", "b", "")), (".*mid.*", ("", "", "mid")), ("a.*|b", ("", "", ""))])
def test_plain_parts(pattern, part):
    t = translate(pattern)
    assert (t.prefix, t.suffix, t.inner) == part


@settings(max_examples=150, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text("ab.*+?|()[]^$-0\\d{2}", max_size=8))
def test_reader_agrees_with_re2_on_what_is_a_pattern(pattern):
    """Whatever the reader takes, an RE2 takes as well, and the other way round."""
    con = duckdb.connect()
    try:
        con.execute("SELECT regexp_full_match('a', ?)", [pattern])
        valid = True
    except duckdb.Error:
        valid = False
    try:
        translate(pattern)
        taken = True
    except Refused:
        taken = False
    assert taken == valid, pattern


def test_effective():
    given_ = [Matcher("a", ""), Matcher("a", "1"), Matcher("b", "2"), Matcher("b", "3"), Matcher("", "x"), Matcher("c", "y", True)]
    assert effective(given_) == [Matcher("b", "2"), Matcher("c", "y", True)]


def test_absent_labels_and_empty_values_never_match(spark):
    df = spark.createDataFrame([({"a": "1"},), ({"b": "2"},)], "m map<string,string>")

    def n(*matchers):
        return df.where(predicate(matchers, F.col("m"))).count()

    assert n(Matcher("a", ".*", True)) == 1 and n(Matcher("a", "")) == 0 and n(Matcher("c", "", True)) == 0 and n() == 0
    assert n(Matcher("a", "1"), Matcher("a", "[0-9]", True)) == 1 and n(Matcher("a", "1"), Matcher("b", "2")) == 0


def test_plain_alternatives_become_values():
    assert translate("a|b|a").literals == ("a", "b")
