import pytest

from pathloom import cli
from pathloom.operators import review, workbook
from pathloom.plans import search_config
from pathloom.sources import spreadsheet

XML = """<?xml version="1.0"?><data>
<key-event id="k1"><title>Binding of liver receptor</title><short-name>B</short-name><biological-organization-level>Molecular</biological-organization-level>
 <description>&lt;p&gt;The receptor binds. A second sentence on dose.&lt;/p&gt;</description><measurement-methodology>assay</measurement-methodology><references>&lt;p&gt;Smith et al. 2012&lt;/p&gt;&lt;p&gt;Gold study (2015). Nanoparticles in fish. Journal&lt;/p&gt;</references>
 <biological-events><biological-event process-id="p1" object-id="o1" action-id="c1"/></biological-events>
 <applicability><taxonomy taxonomy-id="t1"/><sex><sex>Male</sex></sex></applicability></key-event>
<key-event id="k2"><title>Liver failure</title><biological-organization-level>Organ</biological-organization-level><description>organ text</description></key-event>
<key-event-relationship id="r1"><title><upstream-id>k1</upstream-id><downstream-id>k2</downstream-id></title><description>x</description>
 <weight-of-evidence><value>strong</value><emperical-support-linkage>&lt;table&gt;&lt;tr&gt;&lt;th&gt;KE up&lt;/th&gt;&lt;th&gt;KE down&lt;/th&gt;&lt;th&gt;Reference&lt;/th&gt;&lt;/tr&gt;&lt;tr&gt;&lt;td&gt;a&lt;/td&gt;&lt;td&gt;b&lt;/td&gt;&lt;td&gt;c&lt;/td&gt;&lt;/tr&gt;&lt;/table&gt; There is dose concordance here.</emperical-support-linkage></weight-of-evidence></key-event-relationship>
<taxonomy id="t1"><source>NCBI</source><source-id>1</source-id><name>rat</name></taxonomy>
<biological-process id="p1"><source>GO</source><source-id>2</source-id><name>signaling</name></biological-process>
<biological-object id="o1"><source>PR</source><source-id>3</source-id><name>receptor</name></biological-object>
<biological-action id="c1"><source>x</source><source-id>4</source-id><name>increased</name></biological-action>
<aop id="a1"><title>Liver pathway</title><abstract>Abstract on the receptor.</abstract><handbook-version>2.5</handbook-version><status><oecd-status>Under Development</oecd-status></status>
 <aop-stressors><aop-stressor stressor-id="s1"/></aop-stressors><overall-assessment><description>good</description></overall-assessment>
 <key-events><key-event key-event-id="k1"/></key-events><molecular-initiating-event key-event-id="k1"/><adverse-outcome key-event-id="k2"/>
 <key-event-relationships><relationship id="r1"><adjacency>adjacent</adjacency></relationship></key-event-relationships></aop>
<vendor-specific><aop-reference id="a1" aop-wiki-id="7"/><key-event-reference id="k1" aop-wiki-id="100"/><key-event-reference id="k2" aop-wiki-id="200"/>
 <key-event-relationship-reference id="r1" aop-wiki-id="30"/><stressor-reference id="s1" aop-wiki-id="1"/></vendor-specific>
</data>"""


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("kb")
    (path / "snapshot.xml").write_text(XML)
    sheets = path / "sheets"
    sheets.mkdir()
    (sheets / "harmonization.csv").write_text("sheet,row_ix,header,title,target_family,references\ns,0,AOP 7,,,\ns,1,KE 100,Rise,GABA A,x\ns,2,KE 999,E,NMDA R,\n")
    (sheets / "assays.csv").write_text("aeid,endpoint_name,target_family,relation\n1,A,GABA A,AOPs 7 and 8\n1,B,NMDA R,KE fall\n")
    (sheets / "chemicals.csv").write_text("row_ix,casrn,direction_of_effect,pubchem_evidence,literature_citation\n1,7-1,positive,Y,Zhai et al 2022\n")
    (sheets / "target_families.csv").write_text("target_family\nGABA A\nLiver failure\n")
    (path / "matches.csv").write_text("term,match_score\na,0.4\nb,0.9\n")
    (path / "decisions.csv").write_text("term,human_verified,suggested_match\na,true,\n")
    (path / "pairs.csv").write_text("pair,mie,one,two\np,Rise,7,8\n")
    (path / "family_decisions.csv").write_text("term,human_verified,suggested_match\nLiver failure,true,\n")
    (path / "levels.csv").write_text("level,definition\nMolecular,molecule receptor\nOrgan,organ\n")
    return path


JUDGE = """
def judge():
    return lambda ke_id, level, text: {"assigned_level_fits": ke_id == "100", "best_fit_level": "Tissue"}
"""


search_config.registered(search_config.SearchConfig("liver", ["liver", "receptor"], ["title"], "title", entities=("events", "aops")))

search_config.registered(search_config.EventSearch(["liver"], name="liver_events"))

RUNS = {
    "collect-event-integration-rankings": ([], 0, 2),
    "collect-ker-analytics": ([], 0, 6),
    "find-kers-for-events": (["--ke-terms", "failure"], 0, 1),
    "search-within-aops": (["--aop-ids", "7,8", "--term", "receptor", "--term", "zebra", "--term-group", "a=liver|dose", "--term-group", "b=receptor"], 0, 8),
    "search-kers-for-concordance-text": ([], 0, 1),
    "harmonize-ker-evidence": (["--workbook", "--aop-ids", "7"], 0, 3),
    "search-with-config": (["--config", "liver"], 0, 2),
    "pair-mies-and-aos": (["--terms", "liver"], 0, 1),
    "collect-harmonized-sheets": (["--sheets", "{}/sheets", "--pairs", "{}/pairs.csv", "--decisions", "{}/family_decisions.csv"], 0, 2),
    "manually-review-matches": (["--matches", "{}/matches.csv", "--decisions", "{}/decisions.csv", "--threshold", "0.5"], 0, 2),
    "event-content-internal-alignment": (["--definitions", "{}/levels.csv"], 0, None),
    "event-level-review": (["--judge", "outside_judge:judge", "--definitions", "{}/levels.csv"], 0, 1),
    "search-references": (["--across", "year=2015", "--across", "title=nanoparticles|iron"], 0, 1),
}


@pytest.mark.parametrize("command", list(cli.COMMANDS))
def test_commands(spark, folder, command):
    (folder / "outside_judge.py").write_text(JUDGE)
    spark.sparkContext.addPyFile(str(folder / "outside_judge.py"))
    options, at, rows = RUNS[command]
    saved = cli.run(spark, ["--data-dir", str(folder), "--date", "2026-01-01", command, *[o.format(folder) for o in options]])
    found = spark.read.option("header", True).option("escape", '"').csv(saved[at])
    print(command, found.count(), found.columns)
    assert all((folder / "outputs").joinpath(p.rsplit("/", 1)[1]).exists() for p in saved)
    assert rows is None or found.count() == rows


def test_tables(spark, folder):
    kb = cli.Knowledge(spark, str(folder), day="2026-01-02")
    aop = kb.aops().first()
    assert (aop["num_events"], aop["num_kers"], aop["stressors"], aop["handbook_version"], aop["overall_assessment_description"]) == (2, 1, ["1"], 2.5, "good")
    event = kb.events().filter("ke_id = '100'").first()
    assert event["ecs"][0]["biological_object"]["term"] == "receptor" and event["taxonomy_terms"] == ["rat"]
    ker = kb.kers().first()
    assert ker["has_any_tables"] and (ker["upstream_title"], ker["aop_ids"]) == ("Binding of liver receptor", ["7"])


def test_mistakes(spark, folder):
    for wrong in (["find-kers-for-events"], ["search-within-aops", "--term", "x"], ["search-with-config", "--config", "none"], ["search-references"]):
        with pytest.raises(SystemExit):
            cli.run(spark, ["--data-dir", str(folder), "--date", "2026-01-01", *wrong])
    broken = folder / "broken.xml"
    broken.write_text(XML.replace('<key-event-reference id="k2" aop-wiki-id="200"/>', ""))
    with pytest.raises(KeyError):
        cli.Knowledge(spark, str(folder), str(broken), "2026-01-03").ids().count()


def outputs(spark, paths):
    return {p.rsplit("/", 1)[1].removesuffix("-2026-01-05"): spark.read.option("header", True).option("escape", '"').csv(p) for p in paths if not p.endswith((".json", ".xlsx"))}


def test_search_modes(spark, folder):
    base = ["--data-dir", str(folder), "--date", "2026-01-05"]
    saved = cli.run(spark, [*base, "search-with-config", "--config", "liver_events"])
    found = outputs(spark, saved)
    assert found["liver_events_events"].count() == 2
    assert [tuple(r) for r in found["liver_events_aops"].select("aop_id", "source_events").collect()] == [("7", '["100","200"]')]
    assert {(r["ke_id"], r["found_in_aops"]) for r in found["liver_events_aop_events"].collect()} == {("100", '["7"]'), ("200", '["7"]')}
    document = spark.read.json(saved[-1]).first()
    assert document["aop_id"] == "7" and document["source_events"] == ["100", "200"]
    saved = cli.run(spark, [*base, "search-with-config", "--config", "liver"])
    found = outputs(spark, saved)
    assert {(r["ke_id"], r["text_match"], r["aop_match"]) for r in found["liver_combined_events"].collect()} == {("100", "true", "true"), ("200", "true", "true")}
    document = spark.read.json(next(p for p in saved if "liver_events_results" in p and p.endswith(".json"))).first()
    assert document["search"]["config"] == "liver" and document["search"]["summary"]["total_results"] == 2 and document["result"]["entity_id"] in ("100", "200")


def test_workbooks(spark, folder):
    base = ["--data-dir", str(folder), "--date", "2026-01-05"]
    saved = cli.run(spark, [*base, "harmonize-ker-evidence", "--workbook", "--aop-ids", "7"])
    book, own = saved[-2:]
    assert [n for n, _ in spreadsheet.sheet_parts(book)] == ["Summary", "AOPs_with_harmonizable_KERs", "harmonized_headers", "unmatched_headers", "harmonizable_kers", "KER_30"]
    cells = {(r["sheet"], r["row_ix"], r["col_ix"]): r["value"] for r in spreadsheet.read_cells(spark, book).collect()}
    assert [cells["AOPs_with_harmonizable_KERs", 1, c] for c in range(6)] == ["AOP 7", "Liver pathway", "Y", "Under Development", "1", "30"]
    assert [cells["harmonizable_kers", 1, c] for c in range(3)] == ["KER 30", "Binding of liver receptor", "Liver failure"]
    sheet = {(r, c): v for (s, r, c), v in cells.items() if s == "KER_30"}
    assert sheet == {
        (0, 0): "KER 30", (1, 0): "Upstream KE:", (1, 1): "Binding of liver receptor", (2, 0): "Downstream KE:", (2, 1): "Liver failure",
        **{(4, c): v for c, v in enumerate(["KER ID", "Field Type", "Table Index", "Upstream Key Event", "Downstream Key Event", "References"])},
        **{(5, c): v for c, v in enumerate(["30", "empirical_support", "0", "a", "b", "c"])},
    }
    assert {(r["row_ix"], r["col_ix"]): r["value"] for r in spreadsheet.read_cells(spark, own).collect()} == sheet


def test_curated_workbook(spark, folder):
    """The curated sheets as a workbook give what the same sheets give as CSV files."""
    held = {
        "harmonization": [["AOP Wiki Terminologies", "Standardized Term Applied for the AOP Network", "References", "Target Family", "Category", "More"], ["AOP 7"], ["KE 100", " Altered Synaptic Serotinin Release ", "x", "GABA A"], ["KE 999", "E", None, "NMDA R"]],
        "assays": [["AEID", "Endpoint Name", "Target Families General", "Relationship to KE in AOP Network", "Summary of Target Families"], ["1", "A", "GABA A", "AOPs 7 and 8", "GABA A"], ["1", "B", "NMDA R", "KE fall", "GABA A"], [None, None, None, None, "Liver failure"]],
        "chemicals": [["Chemical", "CASRN", "Positive/Negative", "Evidence of Seizure from Literature", "Evidence of Seizure from PubChem "], ["c", "7-1", "positive", "Zhai et al 2022", "Y"]],
    }
    rows = [(at, workbook.SHEETS[name][0], r, values) for at, (name, sheet) in enumerate(held.items()) for r, values in enumerate([["a title above"], *sheet])]
    path = str(folder / "curated.xlsx")
    spreadsheet.write_workbook(spark.createDataFrame(rows, "place int, sheet string, row_ix int, values array<string>"), path)
    sheets = workbook.refined_sheets(lambda sheet, skip: spreadsheet.read_sheet(spark, path, sheet, skip=skip))
    assert [r["target_family"] for r in sheets["target_families"].orderBy("row_ix").collect()] == ["GABA A", "Liver failure"] and sheets["assays"].count() == 2
    saved = cli.run(spark, ["--data-dir", str(folder), "--date", "2026-01-05", "collect-harmonized-sheets", "--sheets", path, "--pairs", str(folder / "pairs.csv"), "--decisions", str(folder / "family_decisions.csv")])
    found = outputs(spark, saved)
    assert {(r["event_id"], r["titles"]) for r in found["event_titles"].collect()} == {("100", '["Altered Synaptic Serotonin Release"]'), ("999", '["DROPPED"]')}
    assert {(r["validation_type"], r["aop_id"]) for r in found["pair_checks"].collect()} == set()
    assert [(r["title"], r["event_id"], r["source"]) for r in found["bridged_events"].orderBy("title").collect()] == [("Altered Synaptic Serotonin Release", None, "harmonized_workbook"), ("Liver failure", "200", "fuzzy_matched")]
    assert [r["place"] for r in found["target_families"].collect()] == ["1", "2"]
    saved = cli.run(spark, ["--data-dir", str(folder), "--date", "2026-01-05", "collect-harmonized-sheets", "--sheets", path, "--export", "csv,json,xlsx"])
    names = [name for group in workbook.EXPORTS.values() for name in group]
    assert [n for n, _ in spreadsheet.sheet_parts(saved[-1])] == names
    found = outputs(spark, saved)
    assert {tuple(r) for r in found["export_assays_by_aop"].collect()} == {("7", "A", "GABA-A Receptor"), ("8", "A", "GABA-A Receptor")}
    assert spark.read.json(next(p for p in saved if "export_chemicals" in p and p.endswith(".json"))).first()["CASRN"] == "7-1"
    assert [r["Chemical"] for r in spreadsheet.read_sheet(spark, saved[-1], "chemicals").collect()] == ["c"]
    with pytest.raises(SystemExit, match="pdf"):
        cli.run(spark, ["--data-dir", str(folder), "--date", "2026-01-05", "collect-harmonized-sheets", "--sheets", path, "--export", "pdf"])
    with pytest.raises(ValueError, match="category"):
        workbook.refined_sheet(spark.createDataFrame([(1, "x")], "row_ix int, `Target Family` string"), {"target_family": "f", "category": "c"}, "s")


def test_resumed_review(spark, tmp_path):
    """Only what the table of verdicts lacks is asked: nothing on a second run, changed texts, changed definitions, failures."""
    log = tmp_path / "asked"
    log.mkdir()

    def judge():
        def ask(ke_id, level, text):
            (log / f"{ke_id}-{len(list(log.iterdir()))}").write_text(text)
            if text == "breaks" and not (tmp_path / "mended").exists():
                raise RuntimeError("no answer")
            return {"assigned_level_fits": level == "Tissue", "best_fit_level": "Cellular" if "cell" in text else "Cannot tell", "spans_multiple_levels": "both" in text}

        return ask

    def asked(rows, definitions):
        before = {p.name for p in log.iterdir()}
        events = spark.createDataFrame(rows, "ke_id string, level_of_biological_organization string, description string").coalesce(1)
        found = {(r["ke_id"], r["severity"], r["best_fit_level"]) for r in review.resumed_review(events, judge, definitions, f"{tmp_path}/verdicts").collect()}
        return sorted(p.name.split("-")[0] for p in log.iterdir() if p.name not in before), found

    rows = [("1", "Tissue", "fits"), ("2", "Organ", "a cell"), ("3", "Organ", "dim"), ("4", "Tissue", "both"), ("5", "Organ", ""), ("6", None, "x"), ("7", "Organ", "breaks")]
    first = {("2", "flag", "Cellular"), ("3", "note", None), ("4", "flag", "Cannot tell"), ("5", "unchecked", None), ("6", "unchecked", None), ("7", "error", None)}
    levels = {"Tissue": "of cells", "Organ": "of tissues"}
    assert asked(rows, levels) == (["1", "2", "3", "4", "7"], first)
    assert asked(rows, levels) == (["7"], first)
    (tmp_path / "mended").write_text("")
    assert asked(rows, levels) == (["7"], first - {("7", "error", None)} | {("7", "note", None)})
    rows[0] = ("1", "Tissue", "fits and more")
    assert asked(rows, levels)[0] == ["1"]
    assert asked(rows, {**levels, "Organ": "otherwise"})[0] == ["1", "2", "3", "4", "7"]
    assert "of cells" in review.instructions(levels) and review.definitions_digest(levels) != review.definitions_digest({})
    assert review.question("1", " T ", None, "d").splitlines() == ["Event 1: T", "Assigned level: (none)", "", "d"]
    with pytest.raises(ValueError, match="definition"):
        review.instructions({"Tissue": ""})
