from pathloom.functions import evidence


def test_a_description_is_cleaned_once_for_all_cues(spark):
    rows = [(1, "Tissue", "<p>Many ORGANS</p>"), (2, "Organ", "an organ"), (3, "Tissue", None), (4, "Cell", "x"), (5, "Tissue", "none of them"), (6, None, "x")]
    events = spark.createDataFrame(rows, "ke_id long, level_of_biological_organization string, description string")
    found = evidence.level_findings(events, {"Tissue": "tissues", "Organ": "organs or glands"})
    assert found._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1
    assert sorted((r["ke_id"], r["severity"]) for r in found.collect()) == [(1, "flag"), (3, "unchecked"), (4, "flag"), (5, "note"), (6, "note")]
