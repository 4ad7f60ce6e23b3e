import pytest
from pyspark.sql import functions as F

from screeline.sources import files

GPX = """<?xml version="1.0"?><gpx xmlns="http://www.topografix.com/GPX/1/1"><wpt lat="1" lon="2"/><trk><trkseg>
<trkpt lat="39.1" lon="-106.4"><ele>3000</ele></trkpt><trkpt lat="39.101" lon="-106.401"/></trkseg><trkseg><trkpt lat="1" lon="1"/></trkseg></trk>
<rte><rtept lat="39.2" lon="-106.2"><ele>1</ele></rtept><rtept lat="39.3" lon="-106.3"/></rte></gpx>"""


def test_track_points(spark, tmp_path):
    (tmp_path / "a.gpx").write_text(GPX)
    (tmp_path / "bad.gpx").write_text("<gpx><trk>")
    (tmp_path / "dtd.gpx").write_text('<!DOCTYPE x [<!ENTITY e "3">]>' + GPX.split("?>", 1)[1])
    f = files.read_files(spark, str(tmp_path), "*.gpx")
    p = files.track_points(f, F.regexp_extract("path", r"([^/]+)\.gpx$", 1)).orderBy("track_id", "seq_no", "pt_no").collect()
    assert [(r.track_id, r.seq_no, r.pt_no, r.lat, r.ele) for r in p] == [("a", 1, 1, 39.1, 3000.0), ("a", 1, 2, 39.101, None), ("a", 2, 1, 39.2, 1.0), ("a", 2, 2, 39.3, None)]
    assert f.filter("length(sha256) = 64").count() == 3


def test_text_tables_and_documents(spark, tmp_path):
    (tmp_path / "m.csv").write_text('id,name\n001,"a, ""b"""\n002,\n')
    r = files.read_text_table(spark, str(tmp_path / "m.csv"), ["id", "name"]).collect()
    assert [tuple(x) for x in r] == [("001", 'a, "b"'), ("002", "")]
    (tmp_path / "d.json").write_text('{"a": [1, 2],\n "b": {"c": "x"}}')
    assert files.read_documents(spark, str(tmp_path / "d.json"), "a array<int>, b struct<c:string>").collect()[0].b.c == "x"
    (tmp_path / "l.jsonl").write_text('{"t": 1}\n{"t": 2}\n')
    assert files.read_log(spark, str(tmp_path / "l.jsonl")).count() == 2


def test_cache_needs_address_and_hash(spark):
    import hashlib

    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    asked = spark.createDataFrame([("u1",), ("u2",), ("u3",), (None,)], "url string")
    cache = spark.createDataFrame([(sha("u1"), "u1", sha("body"), "body"), (sha("u2"), "u2", sha("other"), "body"), (sha("u3"), "ux", sha("body"), "body")], "key string, url string, sha256 string, body string")
    assert {r.url: (r.body, r.hit) for r in files.cached_bodies(asked, "url", cache).collect()} == {"u1": ("body", True), "u2": (None, False), "u3": (None, False), None: (None, False)}


def test_retry_waits(spark):
    d = spark.createDataFrame([(0, None), (2, None), (5, None), (1, 120), (1, 400)], "a int, r int")
    assert [x[0] for x in d.select(files.retry_wait(F.col("a"), F.col("r"))).collect()] == [5.0, 20.0, None, 120.0, None]


def test_writers(spark, tmp_path):
    d = spark.createDataFrame([("a", [1, 2], None), ("b", [], 1)], "k string, xs array<int>, n int")
    files.write_subsets(d, str(tmp_path / "s"), {"all": F.lit(True), "numbered": F.col("n") > 0})
    assert spark.read.option("header", True).csv(str(tmp_path / "s/all")).orderBy("k").collect()[0].xs == "[1,2]"
    assert spark.read.option("header", True).csv(str(tmp_path / "s/numbered")).count() == 1
    with pytest.raises(ValueError):
        files.export_public(d, ["k"], ["n"], str(tmp_path / "p"))
    assert not (tmp_path / "p").exists()
    files.export_public(d, ["k"], ["k"], str(tmp_path / "p"))
    assert spark.read.json(str(tmp_path / "p/json")).columns == ["k"]
    assert files.union_of([d.select("k"), d.select("n", "k")]).columns == ["k", "n"]
