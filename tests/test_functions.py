import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from screeline.functions import text as tx
from screeline.functions.normal import plain_words
from screeline.operators import matching, quality
from screeline.operators.graph import min_label_components, shared_key_edges
from screeline.operators.latest import latest_rows
from screeline.operators.ranking import global_rank
from screeline.staging import Staging


def one(spark, column, *values, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], schema).select(column).collect()]


def test_canonical_urls(spark):
    c = tx.canonical_url(F.col("x"), "peaks.example")
    given = ["https://peaks.example/a.php?x=1#top", "HTTPS://WWW.Peaks.example:443", "/b.php?x=1&amp;y=2", "http://peaks.example/", "https://peaks.example:8080/", "https://u:p@peaks.example/", "https://other.example/", "ftp://peaks.example/", None, ""]
    want = ["https://www.peaks.example/a.php?x=1", "https://www.peaks.example/", "https://www.peaks.example/b.php?x=1&y=2", None, None, None, None, None, None, "https://www.peaks.example/"]
    assert one(spark, c, *given) == want


def test_page_keys(spark):
    k = tx.page_key(F.col("x"))
    given = ["https://h/route.php?route=a_1-b", "https://h/route.php?p=2&route=c", "https://h/route.php?route=a&route=b", "https://h/route.php?route=a b", "https://h/other.php?route=a", None]
    assert one(spark, k, *given) == ["a_1-b", "c", None, None, None, None]


def test_names(spark):
    assert one(spark, tx.normal_name(F.col("x")), "Mt. Evans (East) - the Standard Route", "Mount of the Holy Cross", None, "") == ["mount blue sky east".replace(" east", ""), "holy cross", None, ""]
    assert one(spark, tx.normal_start(F.col("x")), "Upper Gate Trailhead (4WD)", None) == ["upper gate th 4wd", None]


ENDS = ["Elevation\\s+Gain", "Length", "Difficulty"]


def test_figures_and_selection(spark):
    page = "Elevation Gain 3,150 feet from Upper gate 4,250 feet starting at Rockdale 2WD Length 5.75 mi via the ridge, 11.75 mi from Rockdale 2WD Difficulty Class 2"
    d = spark.createDataFrame([(page, "Rockdale 2WD"), (page, "Nowhere"), ("Length From A: 3 With B: 4.5 miles", "b"), ("nothing", None), (None, None)], "t string, start string")
    d = d.withColumn("g", tx.figures(F.col("t"), "Elevation\\s+Gain", "(?:ft|feet)", ENDS)).withColumn("l", tx.figures(F.col("t"), "Length", "mi(?:les)?", ENDS))
    r = d.select("g", "l", tx.selected_figure(F.col("g"), F.col("start")).alias("gain"), tx.selected_figure(F.col("l"), F.col("start")).alias("length")).collect()
    assert [(c.value, c.start_label) for c in r[0].g] == [(3150.0, "Upper gate"), (4250.0, "Rockdale 2WD")]
    assert [(c.value, c.start_label) for c in r[0].l] == [(5.75, "via the ridge"), (11.75, "Rockdale 2WD")]
    assert (r[0].gain, r[0].length) == (4250.0, 11.75) and r[1].gain is None
    assert [(c.value, c.start_label) for c in r[2].l] == [(3.0, "A"), (4.5, "B")] and r[2].length == 4.5
    assert r[3].g == [] and r[3].gain is None and r[4].gain is None


def test_links(spark):
    html = """<a href="/x.php?a=1">x</a><a href='javascript:go()'>j</a><a href="http://other.example/y.php">y</a><button onclick="load('t.gpx')">t</button><script>var u = "\\/z.php"; v = "{u}.php"</script>"""
    assert one(spark, tx.links(F.col("x"), "h.example"), html) == [["https://www.h.example/t.gpx", "https://www.h.example/x.php?a=1", "https://www.h.example/z.php"]]


def test_hmac(spark):
    for key in (b"k" * 32, bytes(range(100))):
        assert one(spark, tx.hmac_sha256(F.col("x"), key), "someone", "") == [hmac.new(key, m, hashlib.sha256).hexdigest() for m in (b"someone", b"")]
    with pytest.raises(ValueError):
        tx.hmac_sha256(F.col("x"), b"short")


def test_plain_words():
    assert plain_words("Un-\n> broken <b>bold</b>&nbsp;te­xt, *stressed* don't​ FÖHN<br>end") == ["unbroken", "bold", "text", "stressed", "dont", "fohn", "end"]
    assert plain_words(None) == plain_words("") == plain_words(" ,;") == []


def test_latest_rows(spark):
    d = spark.createDataFrame([("a", 1, "old"), ("a", 2, "x"), ("a", 2, "y"), ("a", 2, None), ("b", None, "z"), (None, 9, "lost")], "k string, v int, `_c0` string")
    assert sorted(map(tuple, latest_rows(d, "k", "v").collect())) == [("a", 2, "y"), ("b", None, "z")]
    assert latest_rows(d.limit(0), "k", "v").count() == 0


def test_global_rank_with_ties_and_hot_values(spark):
    values = [5.0] * 3000 + [7.0, 7.0, 1.0, -0.0, 0.0, None, float("nan")]
    d = spark.createDataFrame([(i, 0, v) for i, v in enumerate(values)], "i long, s int, v double")
    r = {x.i: (x["rank"], x.of) for x in global_rank(d, "i", "s", "v", Staging(spark, "t")).collect()}
    assert len(r) == 3005 and r[3000] == r[3001] == (1, 3005) and r[0] == (3, 3005) and r[3002] == (3003, 3005) and r[3003] == r[3004] == (3004, 3005)
    assert global_rank(d.limit(0), "i", "s", "v", Staging(spark, "t")).count() == 0


def test_components_of_chains_and_hot_keys(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(0, 200)] + [(500, 501), (501, 500), (7, 7)], "u int, v int")
    got = {r.node: r.label for r in min_label_components(chain, Staging(spark, "t")).collect()}
    assert {got[i] for i in range(201)} == {0} and got[501] == 500
    m = spark.createDataFrame([(i, "hot") for i in range(500)] + [(600, "x"), (None, "hot"), (601, None)], "i int, k string")
    e = shared_key_edges(m, "i", "k", salts=4)
    assert e.count() == 499 and {r.label for r in min_label_components(e, Staging(spark, "t")).collect()} == {0}
    assert min_label_components(e.limit(0), Staging(spark, "t")).count() == 0


def test_quality(spark):
    d = spark.createDataFrame([("a", 1, None), ("b", None, "x|y"), ("b", -1, "x")], "k string, n int, f string")
    v = {(r.rule, r["rows"], r.example) for r in quality.violations(d, "k", {"positive": F.col("n") > 0, "key": F.col("k").isNotNull()}).collect()}
    assert v == {("positive", 2, "b")}
    assert {(r.field, r.nulls, r["rows"]) for r in quality.null_counts(d, ["n", "f"]).collect()} == {("n", 1, 3), ("f", 1, 3)}
    assert {(r.flag, r["rows"]) for r in quality.flag_counts(d, "f").collect()} == {("x", 2), ("y", 1)}
    names, passed = quality.flags({"neg": F.col("n") < 0, "none": F.col("n").isNull()}, ("none",))
    assert [tuple(r) for r in d.select(names, passed).collect()] == [("", True), ("none", True), ("neg", False)]
    assert quality.released(d, ["f"], F.col("n") < 0).filter("f is not null").count() == 1


def test_matching(spark):
    rows = spark.createDataFrame([("1", "Mt. Alpha"), ("2", "Beta"), ("3", "Gama"), ("4", None)], "id string, name string")
    cat = spark.createDataFrame([("a", "Mount Alpha"), ("b", "beta"), ("c", "BETA (north)"), ("d", "Gamma"), ("e", "Delta")], "e string, t string")
    m = {r.id: (r.entry, r.matches) for r in matching.match_by_name(rows, "id", ["name"], cat, "t", "e").collect()}
    assert m == {"1": ("a", 1), "2": (None, 2), "3": (None, 0), "4": (None, 0)}
    n = matching.nearest_names(rows.filter("id = '3'"), "id", "name", cat, "t", "e", k=2).orderBy("place").collect()
    assert n[0].entry == "d" and n[0].ratio == pytest.approx(0.8)


def test_unmatched_candidates(spark):
    """Rows with an address have candidates too, unless page or name gives exactly one entry."""
    from conftest import SF
    from screeline.plans import QUERIES

    rows = {n: QUERIES[n](spark, SF).toPandas() for n in ("match_by_page", "match_by_name", "unmatched_candidates", "canonical_urls")}
    paged = rows["match_by_page"].groupby("route_id").entry.nunique()
    named = rows["match_by_name"].dropna(subset="entry").route_id
    got = rows["unmatched_candidates"].groupby("route_id").size()
    addressed = set(rows["canonical_urls"].dropna(subset="url").route_id)
    assert not set(got.index) & (set(paged[paged == 1].index) | set(named)) and set(got) == {5}
    assert len(set(got.index) & addressed) > len(got) / 2
