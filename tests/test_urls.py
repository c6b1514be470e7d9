from urllib.parse import urljoin

from pyspark.sql import functions as F

from webloom.functions import urls as U


def _one(spark, expr, value):
    return spark.createDataFrame([(value,)], "u string").select(expr(F.col("u")).alias("o")).first()["o"]


def test_netloc(spark):
    assert _one(spark, U.netloc, "https://u@Host.com:8080/a") == "u@Host.com:8080"
    assert _one(spark, U.netloc, "page/1") == ""
    assert _one(spark, U.netloc, "https://www.x.com/https://www.y.com/") == "www.x.com"


def test_root_domain(spark):
    cases = {"shop.a.com": "a.com", "a.com": "a.com", "localhost": "localhost", "x.a.co.uk": "co.uk"}
    for host, want in cases.items():
        assert _one(spark, U.root_domain, host) == want


def test_hostname(spark):
    assert _one(spark, U.hostname, "https://u@Host.com:8080/a") == "host.com"
    assert _one(spark, U.hostname, "mailto:x@a.com") is None


def test_drop_query_param():
    f = U.drop_query_param
    assert f("http://x/?_escaped_fragment_=&a=1") == "http://x/?_escaped_fragment_=&a=1"
    assert f("http://x/?_escaped_fragment_=k&a=&b=2") == "http://x/?b=2"
    assert f("http://x/?b=2&a=1&_escaped_fragment_=q#f") == "http://x/?b=2&a=1#f"
    assert f("http://x/a?ref=x#top", "ref") == "http://x/a#top"


def test_drop_query_param_column(spark):
    df = spark.createDataFrame([("http://x/?_escaped_fragment_=k&a=&b=2",), ("http://y/?a=1",)], "u string")
    got = [r[0] for r in df.select(U.drop_query_param_col(F.col("u"))).collect()]
    assert got == ["http://x/?b=2", "http://y/?a=1"]


def test_resolve_link_matches_urljoin(spark):
    base = "https://a.com/d/x?q=1#f"
    hrefs = ["/e", "e", "../e", "//b.com/", "mailto:x@a.com", "ftp://a.com/", "/a/./b", "/", "?z=1", "#g"]
    df = spark.createDataFrame([(base, h) for h in hrefs], "b string, h string")
    got = [r[0] for r in df.select(U.resolve_link(F.col("b"), F.col("h"))).collect()]
    assert got == [urljoin(base, h) for h in hrefs]


def test_allowed_links(spark):
    # allowed {a.com}, base https://a.com/d/
    from webloom.functions.urls import netloc
    base = "https://a.com/d/"
    hrefs = ["e", "//b.com/", "mailto:x@a.com", "ftp://a.com/", "https://A.com/"]
    df = spark.createDataFrame([(base, h) for h in hrefs], "b string, h string")
    links = df.select(U.resolve_link(F.col("b"), F.col("h")).alias("link"))
    kept = links.where(F.col("link").startswith("http") & (netloc(F.col("link")) == "a.com"))
    assert [r[0] for r in kept.collect()] == ["https://a.com/d/e"]
