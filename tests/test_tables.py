"""Tables in whole pages of markup by hand: nested, unclosed, commented, by id and by data-stat."""

from pyspark.sql import functions as F

from tipoff.operators.tables import body_rows, by_stat, located, table_rows, tables

PAGE = """<!doctype html><html><head><style>table{x:"<table id='no'>"}</style><script>var t = "<table id='a'><tr><td>no</td></tr></table>";</script></head><body>
<!-- <table id="a"><tr><td data-stat="season">hidden</td></tr></table> -->
<TABLE class=nav><tr><td>Home<td>About &amp; more
<tr><td><table id='inner'><tbody><tr><th data-stat="season" scope=row>1999-00</th><td data-stat="wins"> 2<b>0</b>
 x</td></tr></tbody></table> after</td></tr></TABLE>
<p>text <table id="a" data-x=">"><thead><tr><th data-stat="season">Season</th></thead><tbody><tr class="thead"><td data-stat=season>Again</td></tr><tr><td data-stat="season">2000-01</td><td>plain</td><td data-stat="">none</td></tbody>
<tfoot><tr><td data-stat="season">All</td><td data-stat='wins'>7</td></tr></tfoot></table>
<table id="a"><tr><td data-stat="season">second</td></tr></table>
<table id="open"><tr><td data-stat="losses">3<td data-stat="losses">4<div>5</div"""


def texts(rows):
    return [[c["text"] for c in r["cells"]] for r in rows]


def test_by_id():
    rows = located(PAGE, "a", "wins")
    assert texts(rows) == [["Season"], ["Again"], ["2000-01", "plain", "none"], ["All", "7"]]
    assert [r["part"] for r in rows] == ["head", "body", "body", "foot"] and rows[1]["kind"] == "thead"
    assert [c["stat"] for c in rows[2]["cells"]] == ["season", None, ""]


def test_by_stat_nested_and_unclosed():
    assert texts(located(PAGE, "nowhere", "wins")) == [["1999-00", "20 x"]]
    assert texts(located(PAGE, None, "losses")) == [["3", "45</div"]]  # a tag that never ends is text
    assert located(PAGE, "nowhere", "points") == [] and located(None, "a", "wins") == [] and located("", "a", None) == []
    assert texts(tables(PAGE)[0].rows) == [["Home", "About & more"], ["after"]]
    assert len(tables("<table>" * 500)) == 500 and tables("</table></td><td>x") == []


def test_rows_of_pages(spark):
    pages = spark.createDataFrame([(1, PAGE, "a"), (2, PAGE, None), (3, None, "a"), (4, "<table id=a><tr><td>x", "a"), (5, "", "a")], "page_id int, html string, own string")
    rows = table_rows(pages, F.col("own"), "season")
    got = {k: [[c.text for c in r.cells] for r in sorted((r for r in rows.collect() if r.page_id == k), key=lambda r: r.place)] for k in (1, 2, 3, 4, 5)}
    assert got == {1: [["Season"], ["Again"], ["2000-01", "plain", "none"], ["All", "7"]], 2: [["1999-00", "20 x"]], 3: [], 4: [["x"]], 5: []}
    body = body_rows(rows).select("page_id", by_stat(F.col("cells")).alias("m")).collect()
    assert sorted((r.page_id, sorted(r.m.items())) for r in body) == [(1, [("", "none"), ("season", "2000-01")]), (1, [("season", "Again")]), (2, [("season", "1999-00"), ("wins", "20 x")]), (4, [])]
