from pyspark.sql import functions as F

from pathloom.operators import review, workbook
from pathloom.operators.graph import carried_headers
from pathloom.plans import search_config
from pathloom.streaming import stream_hits, text_stream


def test_harmonized_sheet(spark):
    rows = [("AOP 3 x", None), ("KE 10", "Rise"), ("KE 11", "E"), ("KE 10", "Fall"), ("AOP 4", None), ("KE 10", "Rise"), (workbook.SENTINEL, None), ("KE 99", "Late")]
    sheet = spark.createDataFrame([("s", i, h, t) for i, (h, t) in enumerate(rows)], "sheet string, row_ix int, header string, title string")
    events = workbook.harmonized_events(sheet)
    assert sorted((r["aop_id"], r["event_id"], r["event_index"], r["title"]) for r in events.collect()) == [("3", "10", 2, "Fall"), ("3", "11", 1, "E"), ("4", "10", 0, "Rise")]
    assert sorted(tuple(r) for r in workbook.harmonized_titles(events).collect()) == [("10", ["Fall", "Rise"], True), ("11", [workbook.DROPPED], False)]


def test_assays_and_chemicals(spark):
    assays = spark.createDataFrame([(1, "AOPs 214 and 223", "GABA A", "a"), (2, "MIE the binding and KE fall", None, "b"), (2, None, "NMDA R", "c")], "aeid int, relation string, target_family string, endpoint_name string")
    assert [tuple(r) for r in workbook.aeid_conflicts(workbook.assays_by(assays, "aeid")).collect()] == [("2", "assays")]
    assert {(r["key"], r["n_assays"]) for r in workbook.assays_by(assays, "aop_ids").collect()} == {("214", 1), ("223", 1)}
    assert {r["key"] for r in workbook.assays_by(assays, "ke_descriptions").collect()} == {"binding", "fall"}
    assert {(r["key"], r["n_assays"]) for r in workbook.assays_by(assays, "aeid").collect()} == {("1", 1), ("2", 2)}
    families = spark.createDataFrame([("gaba-a receptor", "t")], "target_family string, title string")
    found = {r["family"]: (r["in_chemicals"], r["in_events"], r["in_assays"]) for r in workbook.family_coverage(families.limit(0), families, assays).collect()}
    assert found["NMDA Receptor"] == (False, False, True)
    assert workbook.map_target_families(families, families, assays).first()["assays"] == ["1"]
    chemicals = spark.createDataFrame([(1, "7-1", "positive ", "y?", "Zhai et al 2022"), (2, "7-1", "negative", "NO", None), (3, "8-1", None, None, "x")], "row_ix int, casrn string, direction_of_effect string, pubchem_evidence string, literature_citation string")
    out = {r["casrn"]: r for r in workbook.normalized_chemicals(chemicals).collect()}
    assert out["7-1"]["pubchem_evidence"] == "No" and out["7-1"]["citation"] is None and out["8-1"]["pubchem_evidence"] == "Unknown"


def test_review(spark):
    def judge():
        def ask(ke_id, level, text):
            if ke_id == "5":
                raise RuntimeError("no answer")
            return {"assigned_level_fits": ke_id == "1", "best_fit_level": "Organ" if ke_id == "2" else "cannot tell", "spans_multiple_levels": False}

        return ask

    rows = [("1", "Organ", "x"), ("2", "Cell", "x"), ("3", "Cell", "x"), ("4", "Cell", ""), ("5", "Cell", "x")]
    found = review.reviewed_events(spark.createDataFrame(rows, "ke_id string, level_of_biological_organization string, description string"), judge)
    assert {(r["ke_id"], r["severity"]) for r in found.collect()} == {("2", "flag"), ("3", "note"), ("4", "unchecked"), ("5", "error")}
    assert tuple(review.severity_summary(found).first()) == (1, 1, 1, 1)


def test_review_of_long_descriptions(spark):
    def judge():
        return lambda ke_id, level, text: {"assigned_level_fits": False, "best_fit_level": str(len(text))}

    rows = spark.createDataFrame([("1", "Cell", "x" * 11_000), ("2", "Cell", "x" * 13_000), ("3", "Cell", "")], "ke_id string, level_of_biological_organization string, description string")
    told = lambda **limit: {(r["ke_id"], r["best_fit_level"], r["description_truncated"]) for r in review.reviewed_events(rows, judge, **limit).collect()}
    assert told() == {("1", "11000", False), ("2", "12000", True), ("3", None, False)}
    assert told(description_limit=None) == {("1", "11000", False), ("2", "13000", False), ("3", None, False)}


def test_configured_search(spark):
    texts = spark.createDataFrame([("1", "title", "liver rise"), ("1", "body", "liver and bile"), ("2", "body", "bile acid"), ("3", "title", "drop liver")], "entity_id string, field string, text string")
    config = search_config.SearchConfig("s", ["liver"], ["title", "body"], "title", [("bile", "acid")], ["drop"])
    out = {r["entity_id"]: (r["has_priority_term_match"], r["co_occurrences"]) for r in search_config.run_search(texts, config).collect()}
    assert out == {"1": (True, None), "2": (None, "bile + acid")}


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "<p>the liver</p>"), (2, "<p>none</p>")], "page_id long, html string").write.parquet(str(tmp_path / "in"))
    texts = text_stream(spark, str(tmp_path / "in"), "page_id long, html string", "page_id", "html")
    for _ in range(2):
        stream_hits(texts, ["liver"], str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).filter(F.col("entity_id") == "1").count() == 1


def test_enriched_families(spark):
    from pathloom.functions import fuzzy

    families = spark.createDataFrame([("NMDA Receptor", []), ("GABA", ["Kept"]), ("zzz", None)], "target_family string, h_events array<string>")
    events = spark.createDataFrame([(1, "NMDA receptors", 0), (2, "Liver", 1), (3, "NMDA receptors", 2)], "ke_id int, title string, ord int")
    found = {r["target_family"]: (r["match_with_h_event"], r["matched_term"], r["matched_event_id"]) for r in fuzzy.enriched_families(families, events).collect()}
    assert found == {"NMDA Receptor": (False, "NMDA receptors", 3), "GABA": (True, None, None), "zzz": (False, None, None)}


def test_places(spark):
    from pathloom.operators.graph import placed

    rows = spark.range(0, 500).withColumn("s", F.col("id") % 7)
    out = sorted((r["place"], r["s"], r["id"]) for r in placed(rows, [F.desc("s"), F.col("id")]).collect())
    assert out == [(i, s, k) for i, (s, k) in enumerate(sorted(((k % 7, k) for k in range(500)), key=lambda x: (-x[0], x[1])), 1)]


def test_carried_headers_sort_rows_once_and_number_them_from_their_header(spark):
    rows = [("s", 1, "x"), ("s", 2, "H 1"), ("s", 3, "a"), ("s", 4, "b"), ("s", 5, "H 2"), ("s", 6, "c"), ("t", 1, "d"), (None, 1, "H 3"), (None, 2, "e")]
    table = spark.createDataFrame(rows, "sheet string, row_ix long, cell string")
    found = carried_headers(table, "sheet", ["row_ix"], F.col("cell").startswith("H"), "cell")
    assert sorted((r["cell"], r["header"], r["event_index"]) for r in found.collect()) == [("a", "H 1", 0), ("b", "H 1", 1), ("c", "H 2", 0), ("e", "H 3", 0)]
    found.collect()
    assert found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Sort [") == 1


def test_harmonized_events_keep_columns_without_a_second_reading(spark):
    rows = [("s", 1, "AOP 1", None, None), ("s", 2, "KE 5", "old", "f"), ("s", 3, "KE 5", "new", "g")]
    sheet = spark.createDataFrame(rows, "sheet string, row_ix long, header string, title string, family string")
    found = workbook.harmonized_events(sheet, kept=("family",))
    assert [(r["event_id"], r["title"], r["family"], r["event_index"]) for r in found.collect()] == [("5", "new", "g", 1)]


def test_pair_checks_evaluate_paired_events_once(spark):
    events = spark.createDataFrame([("1", "a", 1), ("1", "b", 2), ("1", "b", 3), ("2", "a", 4)], "aop_id string, title string, row_ix long")
    pairs = spark.createDataFrame([(9, "a", "1", "2")], "pair long, mie string, one string, two string")
    found = workbook.pair_checks(events, pairs)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in plan and "LocalRelation" not in plan
    assert sorted(tuple(r) for r in found.select("validation_type", "aop_id", "title", "row_ix").collect()) == [("count_mismatch", "1", None, None), ("count_mismatch", "2", None, None), ("extra", "1", "b", 2), ("extra", "1", "b", 3), ("merged", "1", "b", None)]
