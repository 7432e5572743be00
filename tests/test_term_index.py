import random

from pyspark.sql import functions as F

from pathloom.operators import search, term_index
from pathloom.plans import search_config


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def fixture(spark):
    draw = random.Random(2)
    words = ["dose", "response", "the", "Liver", "cell-death", "e\u0301x", "naïve", "x_1", "(cs)", "50%", "a.b", "CELL", "İn", "²"]
    rows = [(i, draw.choice(["title", "text"]), " ".join(draw.choice(words) + draw.choice(["", "", ".", ","]) for _ in range(draw.randrange(0, 25)))) for i in range(200)]
    return spark.createDataFrame([*rows, (900, "title", None), (901, "text", ""), (902, "text", "dose dose dose response")], "entity_id int, field string, text string")


TERMS = ["dose", "dose response", "dose dose response", "cell-death", "liver the", "naïve", "x_1", "e\u0301x", "(cs) dose", "50% the", "a.b", "in", "missing", "the missing"]


def test_index_equals_scan(spark, tmp_path):
    texts = fixture(spark)
    term_index.term_index(texts).write.parquet(f"{tmp_path}/index")
    index = spark.read.parquet(f"{tmp_path}/index")
    for terms in ([t] for t in TERMS):
        assert rows_of(search.term_hits(term_index.texts_to_scan(texts, index, terms), terms)) == rows_of(search.term_hits(texts, terms)), terms
    simple = [t for t in TERMS if term_index.term_words(t)]
    assert rows_of(search.entity_hits(term_index.texts_to_scan(texts, index, simple), simple, "title")) == rows_of(search.entity_hits(texts, simple, "title"))
    assert term_index.texts_to_scan(texts, index, ["dose", "%%"]).count() == texts.count()
    few = term_index.texts_to_scan(texts, index, ["dose dose response"])
    assert 0 < few.count() < texts.filter(F.contains(F.lower("text"), F.lit("dose"))).count()


def test_places_of_phrases(spark):
    texts = spark.createDataFrame([(1, "t", "a b a b c"), (2, "t", "b. A, b"), (3, "t", "b c")], "entity_id int, field string, text string")
    index = term_index.term_index(texts)
    found = {(r["entity_id"], r["term_ord"], r["start"]) for r in term_index.phrase_places(index, ["a b", "c", "b a b", "%"]).collect()}
    assert found == {(1, 0, 0), (1, 0, 2), (2, 0, 1), (1, 1, 4), (3, 1, 1), (1, 2, 1), (2, 2, 0)}


def test_configured_search_with_an_index(spark):
    texts = fixture(spark).withColumn("entity_id", F.col("entity_id").cast("string"))
    index = term_index.term_index(texts)
    config = search_config.SearchConfig("c", ["liver", "dose response"], ["title", "text"], "title", co_occurrences=[("dose", "liver")], exclusions=["naïve"], dropped_content={"title": ["the"]})
    assert rows_of(search_config.run_search(texts, config, index)) == rows_of(search_config.run_search(texts, config))


def test_only_wanted_words_are_read(spark, tmp_path):
    term_index.term_index(fixture(spark)).write.parquet(f"{tmp_path}/index")
    plan = term_index.phrase_places(spark.read.parquet(f"{tmp_path}/index"), ["dose response"])._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PushedFilters" in plan and "In(word, [dose,response])" in plan.replace("Or(EqualTo(word,dose),EqualTo(word,response))", "In(word, [dose,response])")


def test_words_of_a_text_are_grouped_within_its_row(spark):
    rows = [(1, "f", "b a b A-b"), (2, "f", None), (3, "f", "..."), (4, "f", "x")]
    found = term_index.text_words(spark.createDataFrame(rows, "entity_id long, field string, text string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan
    assert sorted(tuple(r) for r in found.collect()) == [("a", 1, "f", [1, 3], 2), ("b", 1, "f", [0, 2, 4], 3), ("x", 4, "f", [0], 1)]


def test_texts_under_one_key_are_one_text_to_the_index(spark):
    rows = [(1, "f", "a b"), (1, "f", "a"), (None, "f", "c"), (None, "f", "c"), (2, "f", "a")]
    found = term_index.text_words(spark.createDataFrame(rows, "entity_id long, field string, text string"))
    assert sorted((r["word"], r["entity_id"] or 0, r["n"]) for r in found.collect()) == [("a", 1, 2), ("a", 2, 1), ("b", 1, 1), ("c", 0, 2)]
