import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pathloom.functions import text
from pathloom.operators import search


def values(spark, rows, column):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "n int, t string")
    return [r[0] for r in df.orderBy("n").select(column).collect()]


def test_terms_are_whole_unicode_words(spark):
    rows = ["the LXR path", "LXRα only", None, "lxr", "xlxr lxr2"]
    assert values(spark, rows, text.has_term(F.col("t"), "LXR")) == [True, False, False, True, False]
    assert values(spark, ["iPSCs here", "IPSCs here"], text.has_term(F.col("t"), "iPSCs", case_sensitive=True)) == [True, False]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab .é-", max_size=12), min_size=1, max_size=30))
def test_term_pattern_like_python(spark, rows):
    want = [re.search(r"\ba b\b", r.lower().replace("  ", " ")) is not None or re.search(r"\ba\s+b\b", r.lower()) is not None for r in rows]
    assert values(spark, rows, text.has_term(F.col("t"), "a b")) == want


def test_html(spark):
    html = "<p>One&nbsp;<b>two</b></p><script>x</script><!-- c --><p>three &amp; four</p>"
    assert values(spark, [html], text.clean_html(F.col("t"))) == ["One twothree & four"]
    assert values(spark, ["<p>&nbsp;</p>", '<p><img src="x"></p>', "", None], text.has_visible_content(F.col("t"))) == [False, True, False, False]


def test_snippet(spark):
    row = "First one. Then the liver fails (see no. 3). Last."
    assert values(spark, [row, "no term", "The liver. Next"], text.snippet(F.col("t"), "liver")) == ["Then the liver fails (see no.", None, "The liver."]


def test_overlaps_keep_the_first(spark):
    df = spark.createDataFrame([(["abc", "b", "abcd", None, "xyz"],)], "s array<string>")
    assert df.select(text.without_overlaps(F.col("s"))).first()[0] == ["abc", "xyz"]


def test_term_groups():
    assert text.parse_term_groups(["a=x|y", "a=z|x"]) == {"a": ["x", "y", "z"]}
    with pytest.raises(ValueError):
        text.parse_term_groups(["nothing"])


def test_scoped_search_and_groups(spark):
    texts = spark.createDataFrame([("1", "f", "iPSCs grow. The end"), ("2", "f", "IPSCs fall"), ("3", "f", "the iPSCs")], "entity_id string, field string, text string")
    scope = spark.createDataFrame([("1",), ("2",)], "entity_id string")
    found = search.scoped_search(texts, scope, ["cs:iPSCs", "the"]).select("entity_id", "term").collect()
    assert sorted(map(tuple, found)) == [("1", "iPSCs"), ("1", "the")]
    with pytest.raises(ValueError):
        search.scoped_search(texts, scope, ["cs:x", "x"])
    pairs = search.group_pairs(search.term_hits(texts, ["iPSCs", "the", "fall"]), {"a": ["iPSCs"], "b": ["the"], "c": ["fall", "zzz"]})
    assert sorted(map(tuple, pairs.collect())) == [("a", "b", 2), ("a", "c", 1), ("b", "c", 0)]


def test_exclusion_and_dropped_content(spark):
    texts = spark.createDataFrame([("1", "f", "one two"), ("2", "f", "one three"), ("3", "g", "one boiler plate")], "entity_id string, field string, text string")
    hits = search.entity_hits(texts, ["one"], "f")
    assert {r[0] for r in search.excluding(hits, texts, ["two"]).select("entity_id").collect()} == {"2", "3"}
    assert search.term_hits(search.dropping_content(texts, "g", ["boiler plate"]), ["boiler"]).count() == 0
