from pathloom.functions import evidence
from pathloom.sources import html_tables


def cells(html):
    return [(t, r, c, h, v) for t, r, c, h, v, _ in html_tables.table_cells(html)]


def test_headers_padding_and_cutting(spark):
    html = "<table><tr><th>KE up</th><th>Ref</th></tr><tr><td>a</td></tr><tr><td>b</td><td>c</td><td>d</td></tr></table><p>x</p>"
    pages = spark.createDataFrame([("1", html, 0), ("2", None, 0), ("3", "no", 1)], "ker_id string, html string, value int")
    found = html_tables.html_cells(pages, ["ker_id"], "html")
    assert sorted((r["ker_id"], r["row_ix"], r["header"], r["value"]) for r in found.collect()) == [("1", 0, "KE up", "a"), ("1", 0, "Ref", ""), ("1", 1, "KE up", "b"), ("1", 1, "Ref", "c")]
    assert evidence.harmonizable(found, ["ker_id"]).first()["harmonizable"] is False


def test_first_row_as_headers_and_repeated_headers():
    assert cells("<table><tr><td>A</td><td>B</td><td>A</td></tr><tr><td>1</td><td>2</td><td>3</td></tr></table>") == [(0, 0, 0, "A", "3"), (0, 0, 1, "B", "2")]
    assert cells("<table></table><table><tr></tr><tr><td>x</td></tr></table>") == []


def test_text_pieces_entities_and_unclosed_cells():
    assert cells("<table><th>h</th><tr><td> a <b> b</b>\n c&amp;d <!-- x --> e</td></tr></table>") == [(0, 0, 0, "h", "abc&de")]
    assert cells("&lt;table&gt;&lt;tr&gt;&lt;th&gt;h&lt;/th&gt;&lt;/tr&gt;&lt;tr&gt;&lt;td&gt;1&lt;/td&gt;&lt;/tr&gt;") == [(0, 0, 0, "h", "1")]
    assert cells("<table><th>h<tr><td>a<br>b</table>") == [(0, 0, 0, "hab", "ab")]


def test_nested_tables_count_twice():
    html = "<table><tr><td>o</td></tr><tr><td>p<table><tr><th>i</th></tr><tr><td>q</td></tr></table></td></tr></table>"
    assert cells(html) == [(0, 0, 0, "i", "o"), (0, 1, 0, "i", "piq"), (0, 2, 0, "i", "q"), (1, 0, 0, "i", "q")]


def test_lists_in_cells():
    html = "<table><tr><th>h</th></tr><tr><td><ul><li><span>Time <b>point</b></span> 5 h</li><li>no key</li><li><span>dose</span>: 1</li><li><span>DOSE</span>2</li></ul><ul><li><span>z</span>z</li></ul></td></tr></table>"
    assert [x[5] for x in html_tables.table_cells(html)] == ["Time :Point: 5 h; Dose: 2"]


def test_as_rows(spark):
    html = "<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td><ul><li><span>k</span>v</li></ul></td></tr><tr><td>2</td></tr></table>"
    found = html_tables.html_cells(spark.createDataFrame([(1, html)], "id int, html string"), ["id"], "html")
    rows = html_tables.table_frame(found, ["id"], ["b", "a"], [1]).orderBy("row_ix")
    assert [tuple(r) for r in rows.collect()] == [(1, 0, 0, "K: v", "1"), (1, 0, 1, "", "2")]


def test_pages_of_one_layout_keep_their_own_texts():
    page = "<table><tr><th>{0}</th><th>{1}</th></tr><tr><td> {2} <b>b</b></td><td><ul><li><span>k</span>{2}</li></ul></td></tr></table>"
    for values in (("a", "b", "1"), ("a", "a", "2 &amp;amp; 3"), ("", "b", "")):
        plain = list(html_tables.table_cells(page.format(*values)))
        assert plain == list(html_tables.table_cells(page.format(*values) + "<!-- read by the standard library -->"))
    assert cells(page.format("a", "a", "2")) == [(0, 0, 0, "a", "k2")]
    assert html_tables._known_layout.cache_info().hits > 0


def test_tags_that_are_not_plain_are_read_by_the_standard_library():
    assert cells("<table><tr><td>h</td></tr><tr><td>1 < 2</td></tr></table>") == [(0, 0, 0, "h", "1 < 2")]
    assert cells("<table><tr><td>h</td></tr><tr><td><script><td></script>x</td></tr></table>") == [(0, 0, 0, "h", "<td>x")]


def test_rows_with_their_cells_need_no_shuffle(spark):
    html = "<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td><ul><li><span>k</span>v</li></ul></td></tr><tr><td>2</td></tr></table>"
    pages = spark.createDataFrame([(1, html), (2, None), (3, "<table></table>")], "id int, html string")
    rows = html_tables.row_frame(html_tables.html_rows(pages, ["id"], "html"), ["id"], ["b", "a", "none"], [1])
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in rows.orderBy("row_ix").collect()] == [(1, 0, 0, "K: v", "1", ""), (1, 0, 1, "", "2", "")]
