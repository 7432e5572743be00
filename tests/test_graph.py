import random

import pytest
from pyspark.sql import functions as F

from pathloom.functions import evidence, fuzzy, scoring
from pathloom.operators import graph


@pytest.fixture(scope="module")
def members(spark):
    rows = [(1, 10, "KE", 0), (1, 10, "MIE", 1), (1, 11, "KE", 2), (1, 12, "AO", 3), (2, 10, "AO", 0), (2, 13, "KE", 1), (3, 14, "MIE", 0)]
    return spark.createDataFrame(rows, "aop_id long, ke_id long, role string, ord int")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_roles(spark, members):
    assert (1, 10, "MIE") in rows_of(graph.resolve_roles(members)) and (2, 10, "AO") in rows_of(graph.resolve_roles(members))
    assert graph.role_flags(members).filter("ke_id = 10").select("serves_as_mie", "serves_as_ao").first() == (True, True)


def test_pairs_keep_pathways_without_a_side(spark, members):
    scope = spark.createDataFrame([(1,), (2,), (3,), (9,)], "aop_id long")
    assert rows_of(graph.mie_ao_pairs(members, scope)) == sorted([(1, 10, 12), (2, None, 10), (3, 14, None), (9, None, None)], key=str)


def test_relationship_ends(spark):
    kers = spark.createDataFrame([("a", "1", "2"), ("b", "2", "3"), ("c", "", "1"), ("d", "1", "1")], "ker_id string, upstream string, downstream string")
    events = spark.createDataFrame([("1",), ("",)], "ke_id string")
    assert rows_of(graph.kers_containing(kers, events)) == [("a", "1", "upstream"), ("c", "1", "downstream"), ("d", "1", "downstream")]


def test_terms_are_needed(spark):
    with pytest.raises(ValueError):
        graph.events_by_title(spark.createDataFrame([("1", "x")], "ke_id string, title string"), [])


def test_event_score(spark):
    rows = spark.createDataFrame(
        [("t", "s", "d", "x", "m", "r", "Cellular", "c", ["a"], ["b"], ["c"], ["e"]), ("t", " ", None, "", None, None, None, None, [], None, [], [])],
        "title string, short_name string, description string, doa_free_text string, measurement_method string, references string, level_of_biological_organization string, cell_term string, taxonomy_terms array<string>, life_stage_terms array<string>, sex_terms array<string>, ecs array<string>",
    )
    full, bare = (r[0] for r in rows.select(scoring.event_completion(rows)).collect())
    assert (full["percent"], full["raw_score"], full["max_score"], full["empty_structured"]) == (100.0, 12, 12, [])
    assert (bare["raw_score"], bare["max_score"]) == (1, 11) and bare["empty_structured"][0] == "level_of_biological_organization"


def test_aop_score(spark):
    names = [*scoring.AOP_FREE_TEXT, *scoring.AOP_STRUCTURED]
    schema = ", ".join(f"`{n}` string" for n in names) + ", event_ids array<string>, kers array<string>, handbook_version double"
    small = [*["<p>x</p>"] * len(names), ["1", "2", "3"], ["a", "b"]]
    rows = spark.createDataFrame([(*small, None), (*small, 2.5), (*["x"] * len(names), ["1", "1"], ["a"], None)], schema)
    scores = [r[0] for r in rows.select(scoring.aop_completion(rows)).collect()]
    assert [(s["raw_score"], s["max_score"]) for s in scores] == [(19, 19), (19, 21), (17, 19)]


def test_ker_score_counts_evidence_blocks(spark):
    rows = spark.createDataFrame([("d",)], "description string")
    assert rows.select(scoring.ker_completion(rows)).first()[0]["raw_score"] == 5


def test_fuzzy(spark):
    terms = spark.createDataFrame([("GABA receptors",), ("nothing like it",), (None,)], "term string")
    titles = spark.createDataFrame([("Sodium channel", 0), ("GABA receptor", 1), ("gaba receptor", 2), (None, 3)], "title string, ord long")
    found = {r[0]: r[1] for r in fuzzy.best_matches(terms, titles, 0.6).collect()}
    assert found == {"GABA receptors": "GABA receptor", "nothing like it": None}
    assert fuzzy.best_matches(terms, titles.limit(0), 0.6).filter("matched_term is not null").count() == 0


@pytest.mark.parametrize(("weighted", "threshold"), [(True, 0.6), (False, 0.7), (True, 0.3)])
def test_fuzzy_equals_all_pairs(spark, weighted, threshold):
    """The bounds lose nothing: long texts (junk heuristic), repeated letters, other scripts, generic words, ties."""
    draw = random.Random(4)
    word = lambda: "".join(draw.choice("abcdefgé") for _ in range(draw.randrange(1, 9)))
    text = lambda n: " ".join(draw.choice([word(), "receptor", "Kinase", "aaaa"]) for _ in range(n))
    titles = [text(draw.randrange(1, 6)) for _ in range(150)] + [text(60), "", "receptor", "R", "a" * 300, "İstanbul ΟΔΟΣ"]
    terms = [t[: draw.randrange(len(t) + 1)] + word() for t in titles[::3]] + ["", "receptor channel", "istanbul οδος", titles[150].upper(), "b" * 250 + "a" * 60]
    score = fuzzy.weighted_ratio if weighted else fuzzy.ratio
    want = {}
    for t in set(terms):
        best, at = max((score(t, x), -i) for i, x in enumerate(titles))
        want[t] = (titles[-at], best) if best >= threshold and best > 0 else (None, None)
    ours = fuzzy.best_matches(spark.createDataFrame([(t,) for t in terms], "term string"), spark.createDataFrame(list(zip(titles, range(len(titles)), strict=True)), "title string, ord long"), threshold, weighted=weighted)
    assert {r[0]: (r[1], r[2]) for r in ours.collect()} == want


def test_families(spark):
    names = spark.createDataFrame([("GABA A",), ("Sodium Channels",), ("NMDA R",)], "n string").select(evidence.target_family(F.col("n"))).collect()
    assert [r[0] for r in names] == ["GABA-A Receptor", "Sodium Channel", "NMDA Receptor"]


def test_level_findings(spark):
    rows = spark.createDataFrame([("1", "Organ", "<p>cells divide</p>", "hepatocyte"), ("2", "Cell", "whole livers", None), ("3", "Organ", "", None), ("4", None, "x", None)], "ke_id string, level_of_biological_organization string, description string, cell_term string")
    found = evidence.level_findings(rows, {"Organ": "liver or kidney", "Cell": "cells"}, cell="cell_term")
    assert sorted((r["ke_id"], r["severity"]) for r in found.collect()) == [("1", "flag"), ("1", "note"), ("2", "flag"), ("3", "unchecked"), ("4", "note")]


def test_carried_headers(spark):
    rows = spark.createDataFrame([("s", 1, "H", "A"), ("s", 2, "r", "x"), ("s", 3, "r", "y"), ("s", 4, "H", "B"), ("s", 5, "r", "z")], "g string, n int, k string, v string")
    out = graph.carried_headers(rows, "g", ["n"], F.col("k") == "H", "v")
    assert sorted((r["v"], r["header"], r["event_index"]) for r in out.collect()) == [("x", "A", 0), ("y", "A", 1), ("z", "B", 0)]


def test_places_of_many_rows(spark, tmp_path):
    """Three million rows of several files in 200 ranges: every row once, places 1 to n, in the order asked for."""
    n, settings = 3_000_000, {"spark.sql.shuffle.partitions": "200", "spark.sql.adaptive.enabled": "true"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        ids = spark.range(0, n, 1, 12).select(F.col("id"), F.pmod(F.xxhash64("id"), F.lit(1000)).alias("score"))
        ids.write.parquet(f"{tmp_path}/rows")
        graph.placed(spark.read.parquet(f"{tmp_path}/rows"), [F.desc("score"), F.col("id")]).write.parquet(f"{tmp_path}/placed")
        out = spark.read.parquet(f"{tmp_path}/placed")
        seen = out.agg(F.count("*"), F.count_distinct("id"), F.count_distinct("place"), F.min("place"), F.max("place")).first()
        assert tuple(seen) == (n, n, n, 1, n)
        above = out.groupBy("score").agg(F.min("place").alias("first"), F.max("place").alias("last"), F.count("*").alias("n"))
        ranked = [tuple(r) for r in above.orderBy(F.desc("score")).collect()]
        assert all(last - first + 1 == size for _, first, last, size in ranked)
        assert all(a[2] + 1 == b[1] for a, b in zip(ranked, ranked[1:], strict=False))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_co_occurring_records_read_records_once(spark):
    from pathloom.operators import scope

    records = spark.createDataFrame([("g", "events", "1", "x", [7], ["a"], ["t"]), ("h", "events", "1", "x", [7], ["b"], ["m"]), ("g", "events", "2", "y", [8], ["a"], ["t"])], "grp string, entity string, entity_id string, label string, aop_ids array<int>, terms array<string>, fields array<string>")
    found = scope.co_occurring_records(records, {"g": ["a"], "h": ["b"], "i": ["c"]})
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in found.collect()] == [("g", "h", "events", "1", "x", [7], ["a"], ["t"], ["b"], ["m"])]
    assert scope.co_occurring_records(records, {"g": ["a"]}).count() == 0
