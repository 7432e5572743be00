import pytest
from pyspark.sql import functions as F

from pathloom.sources import json_documents, sinks, snapshot

XML = """<?xml version="1.0"?><data>
<key-event id="k1"><title>Binding</title><short-name>B</short-name><biological-organization-level>Molecular</biological-organization-level>
 <applicability><taxonomy taxonomy-id="t1"/><taxonomy taxonomy-id="t9"/><sex><sex>Male</sex></sex><sex><sex> </sex></sex></applicability></key-event>
<key-event id="k2"><title>Failure</title></key-event>
<key-event-relationship id="r1"><title><upstream-id>k1</upstream-id><downstream-id>k2</downstream-id></title></key-event-relationship>
<taxonomy id="t1"><name>rat</name></taxonomy>
<aop id="a1"><title>P</title><key-events><key-event key-event-id="k1"/></key-events><molecular-initiating-event key-event-id="k1"/><adverse-outcome key-event-id="k2"/>
 <key-event-relationships><relationship id="r1"><adjacency>adjacent</adjacency></relationship><relationship id="zz"><adjacency>x</adjacency></relationship></key-event-relationships></aop>
<vendor-specific><aop-reference id="a1" aop-wiki-id="7"/><key-event-reference id="k1" aop-wiki-id="100"/><key-event-reference id="k2" aop-wiki-id="200"/>
 <key-event-relationship-reference id="r1" aop-wiki-id="30"/><stressor-reference id="s1" aop-wiki-id="1"/></vendor-specific>
</data>"""


@pytest.fixture(scope="module")
def path(tmp_path_factory):
    file = tmp_path_factory.mktemp("xml") / "snapshot.xml"
    file.write_text(XML)
    return str(file)


def test_tables(spark, path):
    ids = snapshot.id_map(spark, path)
    assert ids.count() == 5
    members = {tuple(r) for r in snapshot.membership(spark, path, ids).select("aop_id", "ke_id", "role").collect()}
    assert members == {("7", "100", "KE"), ("7", "100", "MIE"), ("7", "200", "AO")}
    events = {r["ke_id"]: r for r in snapshot.key_events(spark, path, ids).collect()}
    assert set(events) == {"100", "200"} and events["100"]["taxonomy_terms"] == ["rat"] and events["100"]["sex_terms"] == ["Male"]
    ker = snapshot.relationships(spark, path, ids).first()
    assert (ker["ker_id"], ker["upstream"], ker["downstream"]) == ("30", "100", "200")
    assert [tuple(r) for r in snapshot.aop_relationships(spark, path, ids).select("aop_id", "ker_id", "adjacency").collect()] == [("7", "30", "adjacent")]


def test_cache_and_validation(spark, path, tmp_path):
    calls = []
    build = lambda: calls.append(1) or spark.range(3)
    for refresh in (False, False, True):
        assert snapshot.cached(spark, str(tmp_path), "t", "2026-01-01", build, refresh).count() == 3
    assert len(calls) == 2
    assert len([p for p in (tmp_path / "t" / "snapshot_date=2026-01-01").iterdir() if p.is_dir()]) == 1
    with pytest.raises(ValueError):
        snapshot.validated({"aop": spark.range(0)})


def test_broken_writes_are_built_again(spark, tmp_path):
    """A write that breaks half-way, a folder without its mark and a torn note are no tables; required tables have rows."""
    root, day = str(tmp_path), "2026-01-01"

    @F.udf("long")
    def breaks(n):
        if n == 3:
            raise RuntimeError("half-way")
        return n

    with pytest.raises(Exception, match="half-way"):
        snapshot.cached(spark, root, "t", day, lambda: spark.range(0, 4, 1, 4).select(breaks("id").alias("id")))
    assert snapshot.committed(spark, root, "t", day) is None
    assert snapshot.cached(spark, root, "t", day, lambda: spark.range(7)).count() == 7
    noted = snapshot.committed(spark, root, "t", day)
    assert noted["rows"] == 7
    (tmp_path / "_committed" / day / "t.json").write_text('{"folder"')
    assert snapshot.committed(spark, root, "t", day) is None
    assert snapshot.cached(spark, root, "t", day, lambda: spark.range(8)).count() == 8
    folder = snapshot.committed(spark, root, "t", day)["folder"]
    (tmp_path / folder.split(root + "/")[1] / "_SUCCESS").unlink()
    assert snapshot.cached(spark, root, "t", day, lambda: spark.range(9)).count() == 9
    with pytest.raises(ValueError, match="has no e"):
        snapshot.cached(spark, root, "e", day, lambda: spark.range(0), required=True)
    assert snapshot.committed(spark, root, "e", day) is None
    assert snapshot.cached(spark, root, "e", day, lambda: spark.range(0)).count() == 0
    bare = tmp_path / "bare.xml"
    bare.write_text("<data><aop id='1'><title>x</title></aop></data>")
    with pytest.raises(ValueError, match="no export"):
        snapshot.checked_file(spark, str(bare))


def test_json_documents(spark, tmp_path):
    rows = spark.createDataFrame([(1, ["b", "a"], None), (2, [], {"k": 1})], "id int, tags array<string>, m map<string,int>")
    path = f"{tmp_path}/d.json"
    json_documents.write_json(rows, path, sets=["tags"])
    back = json_documents.read_json(spark, path, "id int, tags array<string>, m map<string,int>")
    assert sorted((r["id"], r["tags"], r["m"]) for r in back.collect()) == [(1, ["a", "b"], None), (2, [], {"k": 1})]
    cells = back.select(json_documents.json_cell(F.col("tags"), "array<string>"), json_documents.json_cell(F.col("m"), "map<string,int>"), json_documents.json_cell(F.col("id"), "int")).collect()
    assert sorted(map(tuple, cells)) == [("", '{"k":1}', "2"), ('["a","b"]', "", "1")]
    (tmp_path / "bad.json").write_text('{"id": 1}\n{"id": \n')
    with pytest.raises(json_documents.BrokenRecords, match="1 broken"):
        json_documents.read_json(spark, f"{tmp_path}/bad.json", "id int")
    (tmp_path / "keyed.json").write_text('{"7": {"title": "x", "n": [1, 2]}, "8": {"title": null}}')
    keyed = json_documents.read_keyed(spark, f"{tmp_path}/keyed.json", "struct<title:string,n:array<int>>")
    assert sorted(map(tuple, keyed.collect()), key=str) == [("7", "x", [1, 2]), ("8", None, None)]
    (tmp_path / "list.json").write_text('[{"id": 1}, {"id": 2}]')
    assert json_documents.read_json(spark, f"{tmp_path}/list.json", "id int", multi_line=True).count() == 2


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, [None, "a", ""], 2.0, True, "<b>x</b>  y"), (2, [], None, None, None)], "n int, l array<string>, d double, y boolean, h string")
    fields = [sinks.Field("N", "n"), sinks.Field("L", "l", "list"), sinks.Field("D", "d", "round_2", "N/A"), sinks.Field("Y", "y", "yes_no"), sinks.Field("H", "h", "clean")]
    out = sinks.exported(rows, fields)
    assert sorted(map(tuple, out.collect())) == [("1", "a", "2.00", "Yes", "x y"), ("2", "", "N/A", "No", "")]
    sinks.write_csv(out, str(tmp_path / "c"), one_file=True)
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2
    assert "| a\\|b |" in sinks.markdown_table(spark.createDataFrame([("a|b",)], "x string"))
    assert {tuple(r) for r in sinks.unpivoted(rows.agg({"d": "sum"})).collect()} == {("sum(d)", "2.00")}
