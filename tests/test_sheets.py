import __spark_entry__ as entry
from pathloom.functions import fuzzy
from pathloom.operators import sheets

SF = "/root/testdata/sf0.001"


def test_pathway_order(spark):
    """Most relationships first, equals by number, others last; ids in order of numbers; unknown pathways and repeated rows."""
    members = spark.createDataFrame([("10", "3"), ("10", "20"), ("10", "20"), ("9", "3"), ("2", "20"), ("x", "3"), ("5", "77")], "aop_id string, ker_id string")
    harmonizable = spark.createDataFrame([("3",), ("20",), ("3",)], "ker_id string")
    aops = spark.createDataFrame([("10", "Ten", None), ("9", "Nine", "s"), ("2", None, "s")], "aop_id string, title string, status string")
    out = sheets.pathway_order(members, harmonizable, aops, ["9"]).orderBy("place").select("place", "aop_id", "title", "selected", "status", "n_kers", "ker_ids").collect()
    assert [tuple(r) for r in out] == [(1, "10", "Ten", "", "N/A", 2, "3, 20"), (2, "2", "N/A", "", "s", 1, "20"), (3, "9", "Nine", "Y", "s", 1, "3"), (4, "x", "N/A", "", "N/A", 1, "3")]


def test_families_by_score(spark):
    rows = spark.createDataFrame([("b", 0.5), ("a", None), ("c", 0.9), ("d", 0.5)], "target_family string, match_score double")
    assert [r["target_family"] for r in sheets.ranked_families(rows).orderBy("place").collect()] == ["c", "b", "d", "a"]


def test_columns_come_as_first_met(spark):
    cells = spark.createDataFrame(
        [(2, "f", 0, 0, 1, "B", "x"), (2, "f", 0, 0, 0, "Z", "y"), (2, "f", 0, 1, 0, "A", "w"), (10, "f", 0, 0, 0, "B", "q")], "ker_id int, field string, table_ix int, row_ix int, col_ix int, name string, value string"
    )
    kers = spark.createDataFrame([(2, 5, "Up", 6, None)], "ker_id int, upstream int, upstream_title string, downstream int, downstream_title string")
    out = {(r["sheet"], r["row_ix"]): (r["place"], r["values"], r["links"]) for r in sheets.relation_sheets(cells, kers, "https://kb.example", 5).collect()}
    assert out["KER_2", 4][1] == ["KER ID", "Field Type", "Table Index", "Z", "B", "A"]
    assert out["KER_2", 5] == (7, ["2", "f", "0", "y", "x", None], None) and out["KER_2", 6][1] == ["2", "f", "0", None, None, "w"]
    assert out["KER_2", 1] == (7, ["Upstream KE:", "Up"], [None, "https://kb.example/events/5"]) and out["KER_2", 2][1] == ["Downstream KE:", "N/A"]
    assert out["KER_10", 1][1] == ["Upstream KE:", "N/A"] and out["KER_10", 5][1] == ["10", "f", "0", "q"]


def test_headers_by_likeness(spark):
    """The whole query against the ratio of every header and title: list and side words first, upstream before downstream."""
    parts = {r["p_partkey"]: r for r in spark.read.parquet(f"{SF}/part.parquet").collect()}
    found = {(r["ker_id"], r["header"]): r["harmonized"] for r in entry.queries()["headers_by_likeness"](spark, SF).collect()}
    assert len(found) == len(parts)
    for (key, header), harmonized in found.items():
        row = parts[key]
        up, down = row["p_name"] if key % 2 == 0 else row["p_type"], f"{row['p_name']} change"
        low = header.lower().strip().replace("ke:", "").strip()
        want = "Upstream Key Event" if fuzzy.ratio(low, up) > 0.7 else "Downstream Key Event" if fuzzy.ratio(low, down) > 0.7 else None
        assert harmonized == want, (header, up, down)
    assert {"Upstream Key Event", "Downstream Key Event", None} == set(found.values())
