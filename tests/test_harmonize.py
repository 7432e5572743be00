from pathloom.operators import harmonize as h


def test_headers_and_cells(spark):
    kers = spark.createDataFrame([("1", "Decreased testosterone", "AGD, decreased"), ("2", "Binding", "Failure of liver")], "ker_id string, upstream_title string, downstream_title string")
    rows = []
    for field, header in (("woe", "Circulating testosterone level"), ("woe", "anogenital distance"), ("woe", "Ref"), ("woe", "Year"), ("emp", "Ref"), ("emp", "KE up")):
        rows.append(("1", field, 0, 0, len(rows), header, header.lower()))
    rows += [("2", "woe", 0, 0, 0, "failure of livers", "x"), ("2", "woe", 0, 0, 1, "Comment", "y")]
    cells = spark.createDataFrame(rows, "ker_id string, field string, table_ix int, row_ix int, col_ix int, header string, value string")
    headers = h.matched_headers(cells, kers)
    found = {(r["ker_id"], r["field"], r["header"]): r["harmonized"] for r in headers.collect()}
    assert found["1", "woe", "Circulating testosterone level"] == h.UP and found["1", "woe", "anogenital distance"] == h.DOWN
    assert found["1", "woe", "Year"] is None and found["2", "woe", "failure of livers"] == h.DOWN
    assert [tuple(r) for r in h.harmonizable_fields(headers).collect()] == [("1", "woe")]
    assert {r["name"] for r in h.harmonized_cells(cells, kers).collect()} == {h.UP, h.DOWN, "References", "Year"}
    assert tuple(h.harmonization_summary(headers).first()) == (2, 1, 6, 1)


def test_cells_are_read_once_and_titles_may_be_missing(spark, tmp_path):
    rows = [(k, "woe", 0, r, c, x, f"{r}{c}") for k in ("1", "2", None) for r in (0, 1) for c, x in enumerate(("KE up", "ke: Downstream effect", "Ref", "liver failures", "Year", None, "Ref"))]
    schema = "ker_id string, field string, table_ix int, row_ix int, col_ix int, header string, value string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/cells")
    kers = spark.createDataFrame([("1", "Liver failure", None)], "ker_id string, upstream_title string, downstream_title string")
    found = h.harmonized_cells(spark.read.parquet(f"{tmp_path}/cells"), kers)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 1
    cells = {(r["ker_id"], r["row_ix"], r["name"]): (r["value"], r["col_ix"]) for r in found.collect()}
    want = {("1", r, n): v for r in (0, 1) for n, v in ((h.UP, (f"{r}3", 0)), (h.DOWN, (f"{r}1", 1)), ("References", (f"{r}6", 2)), ("Year", (f"{r}4", 4)))}
    want |= {("2", r, n): v for r in (0, 1) for n, v in ((h.UP, (f"{r}0", 0)), (h.DOWN, (f"{r}1", 1)), ("References", (f"{r}6", 2)), ("liver failures", (f"{r}3", 3)), ("Year", (f"{r}4", 4)))}
    assert cells == want
