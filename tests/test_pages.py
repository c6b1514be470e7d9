from pyspark.sql import functions as F

from webloom.functions.html import page_text_from_nodes, parse_html
from webloom.operators import pages as P
from webloom.session import table

from conftest import SF01


def _text(h):
    return page_text_from_nodes(parse_html(h)[0])


def test_page_text_cases():
    assert _text("<title> T </title><h1>H</h1><p>a <b>x</b> b</p><p> </p>") == "T a b H"
    assert _text("<p><b>t<br><p>u</p>") == "u"
    assert _text('<script>var t="</p>";</script><p>u</p>') == "u"
    assert _text("<div>nothing</div>") == ""


def test_no_text_page_is_rejected(spark):
    pages = spark.createDataFrame([(1, "http://a.com/", "<div>x</div>"), (2, "http://a.com/p", "<p>u</p>")],
                                  "page_id long, url string, html string")
    assert [r.page_id for r in P.page_text(pages).collect()] == [2]
    assert [r.page_id for r in P.extract_rejects(pages).collect()] == [1]


def test_parser_equals_native_on_testdata(spark):
    pages = table(spark, SF01, "pages")
    a = P.page_text(pages, "parser").select("page_id", "content")
    b = P.page_text(pages, "native").select("page_id", "content")
    assert a.count() == b.count() == 250
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    la = P.page_links(pages, "parser").select("page_id", "link")
    lb = P.page_links(pages, "native").select("page_id", "link")
    assert la.exceptAll(lb).count() == 0 and lb.exceptAll(la).count() == 0


def test_title_content_variant(spark):
    pages = spark.createDataFrame([(1, "http://a/", "<title>T </title><p>a <b>x</b> b</p>")],
                                  "page_id long, url string, html string")
    r = P.page_title_content(pages).first()
    assert r.title == "T " and r.content == "a   b"


def test_internal_links_plan_is_semi_join(spark):
    plan = P.internal_links(table(spark, SF01, "pages"))._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan


def test_entities_parser_equals_native(spark):
    html = ("<title>a&amp b</title><p>x&am y &amp;lt; z&nbsp;w &copy &quot;q&quot;</p>"
            "<h1>&middot;&amp;amp;</h1>")
    pages = spark.createDataFrame([(1, "http://a/", html)], "page_id long, url string, html string")
    a = P.page_text(pages, "parser").first().content
    b = P.page_text(pages, "native").first().content
    assert a == b == 'a& b x&am y &lt; z w © "q" ·&amp;'


def test_parser_holds_few_pages_at_a_time(spark):
    """Output batches are bounded however many pages an input batch has (F15, F16, F18: all of a batch's nodes were held)."""
    import pyarrow as pa
    n = 3 * P.PARSE_ROWS + 1
    batch = pa.RecordBatch.from_pydict({"page_id": list(range(n)), "url": ["u"] * n,
                                        "html": [None if i == 5 else f"<p>{i}</p><a href='/{i}'>x</a>" for i in range(n)]})
    out = list(P._parse_batches(iter([batch])))
    assert [b.num_rows for b in out] == [P.PARSE_ROWS] * 3 + [1]
    rows = [r for b in out for r in b.to_pylist()]
    assert [r["page_id"] for r in rows] == list(range(n)) and rows[5]["error"] == "ValueError: no html"
    assert rows[n - 1]["paras"] == [str(n - 1)] and rows[n - 1]["hrefs"] == [f"/{n - 1}"]
