import re
from urllib.parse import quote_plus

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from threadloom.functions import text, urls
from threadloom.functions.counts import parse_count


def column(spark, values, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", expression(F.col("v")).alias("got"))
    return [r.got for r in rows.orderBy("i").collect()]


COUNTS = {
    "1.2k": 1200, "823": 823, "": 0, "1,234": 1234, "2.5M": 2_500_000, " 7 ": 7, "k": 0, "abc": 0, "1d": 0, "-3": -3, "1e3": 1000, ".5k": 500,
    "4.35k": 4350, "1.k": 1000, "-0.9": 0, "nan": 0, "12 k": 12_000, None: 0, "\t9\n": 9, "+4": 4, "1kk": 0, "0x10": 0, "5%": 0, "1.2.3": 0,
    "1_000": 1000, "1__0": 0, "_1": 0, "1_": 0, "1_0.5_0k": 10_500, "\u0663": 3, "\uff11\uff12k": 12_000, "\u0967,\u0968": 12, "inf": 0, "9e99": 0,
}


def test_parse_count(spark):
    assert column(spark, list(COUNTS), parse_count) == list(COUNTS.values())


@pytest.mark.parametrize("count", [text.literal_count, text.substring_count])
def test_blank_terms_are_refused(spark, count):
    with pytest.raises(ValueError):
        count(F.lit("x"), " ")


POST_IDS = {
    "https://www.example.com/r/x/comments/abc/title/": "abc",
    "/r/x/comments/abc": "abc",
    "https://e.com/r/x/comments/abc?y=/comments/z": "abc",
    "https://e.com/r/x/comments/abc#frag": "abc",
    "https://e.com/r/x/": None,
    "https://e.com/r/x/comments": None,
    "https://e.com/r/x/comments/": None,
    "comments/comments/z": "comments",
    "/comments-x/comments/w": "w",
    "https://comments/abc": None,
    "//host/comments/q/": "q",
    "https://e.com/comments/a;p=1": "a",
    "https://e.com/comments/a;p/b": "a;p",
    "": None,
    "https://e.com/comments//b": "",
    "HTTPS://e.com/comments/up": "up",
    "https://e.com?comments/a": None,
    "///comments/x": "x",
    "mailto:comments/x": "x",
}


def test_post_id(spark):
    assert column(spark, list(POST_IDS), urls.post_id) == list(POST_IDS.values())


def test_form_encoding_of_every_printable_character(spark):
    values = [chr(c) for c in range(32, 127)] + ["é ñ", "😀", "a b+c"]
    assert column(spark, values, urls.form_encoded) == [quote_plus(v) for v in values]


def test_search_url(spark):
    got = column(spark, ["C++ & é"], lambda v: urls.search_url(F.lit("Sub"), v, "week"))
    assert got == ["https://www.reddit.com/r/Sub/search/?q=C%2B%2B+%26+%C3%A9&restrict_sr=1&t=week&sort=relevance"]


TEXTS = ["", "aaa", "AaA a.b A.B", "É é e", "x\\Ey \\E", "ﬁ ſs K k İi", "300 view jail 300 VIEW", "\n.\n", "😀😀😀"]
TERMS = ["a", "aa", "a.b", "é", "\\E", "s", "k", "300 view", "😀", "\\Ey"]


@pytest.mark.parametrize("term", TERMS)
def test_literal_counts(spark, term):
    any_case = [len(re.findall(re.escape(term), t, re.IGNORECASE)) for t in TEXTS]
    assert column(spark, TEXTS, lambda v: text.literal_count(v, term)) == any_case
    assert column(spark, TEXTS, lambda v: text.substring_count(v, term)) == [t.count(term) for t in TEXTS]


@pytest.mark.parametrize("pattern", [r"\d+", r"\bé\b", "a.", r"[ae]$", "(a)(a)?", r"\w+"])
def test_pattern_counts(spark, pattern):
    assert column(spark, TEXTS, lambda v: text.pattern_count(v, pattern)) == [len(re.findall(pattern, t)) for t in TEXTS]


def test_patterns_the_jvm_cannot_read_fail_on_the_driver(spark):
    text.check_patterns(spark, [r"\b(a|b)\b", "didn[''`]?t"])
    with pytest.raises(PySparkException):
        text.check_patterns(spark, ["(?P<name>a)"])
