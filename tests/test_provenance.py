import pytest
from pyspark.sql import functions as F

from screeline.operators import provenance as pv


def test_digest_ignores_order_and_sees_content(spark):
    d = spark.createDataFrame([("a", 1.0), ("b", None), ("b", None), (None, 2.0)], "k string, v double")
    one = pv.table_digest(d).collect()[0]
    assert one == pv.table_digest(d.select("v", "k").orderBy(F.desc("k"))).collect()[0] and one["rows"] == 4
    others = [d.limit(3), d.fillna(0.0), d.fillna(""), d.withColumnRenamed("v", "w"), d.limit(0), d.unionByName(d)]
    assert len({pv.table_digest(x).collect()[0].digest for x in others} | {one.digest}) == 7


def test_contract_hash():
    assert pv.contract_hash({"a": 1, "b": [2]}) == pv.contract_hash({"b": [2], "a": 1}) != pv.contract_hash({"a": 1})
    with pytest.raises(ValueError):
        pv.contract_hash({"a": float("nan")})


def test_changes(spark):
    old = spark.createDataFrame([("a", 1.0, "x"), ("b", None, None), ("c", 1.0, "x"), ("gone", 1.0, "x")], "k string, v double, s string")
    new = spark.createDataFrame([("a", 1.0 + 1e-12, "y"), ("b", 2.0, None), ("c", 1.1, None)], "k string, v double, s string")
    got = {(r.k, r.field, r.old, r.new) for r in pv.changes(old, new, "k", ["v", "s"]).collect()}
    assert got == {("a", "s", "x", "y"), ("b", "v", None, "2.0"), ("c", "v", "1.0", "1.1"), ("c", "s", "x", None)}


def test_gates(spark):
    d = spark.createDataFrame([(1, "x"), (-1, None), (None, "x")], "n int, s string")
    rules = {"positive": F.col("n") > 0, "named": F.col("s").isNotNull()}
    assert [r[0] for r in d.select(pv.first_failure(rules)).collect()] == [None, "positive", "positive"]
    assert pv.require(d.limit(1), rules).count() == 1
    with pytest.raises(Exception, match="broken rule: positive"):
        pv.require(d, rules).collect()


def test_expand(spark):
    d = spark.createDataFrame([("a", ["b", "c", "c"]), ("b", ["c", "d", None]), ("e", None)], "url string, links array<string>")
    assert {(r.url, r.found_on, r.pages) for r in pv.expand(d, "url", "links").collect() if r.url} == {("c", "a", 2), ("d", "b", 1)}
