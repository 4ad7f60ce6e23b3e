import os
from types import SimpleNamespace

import pytest

from screeline import staging


def test_tables_are_written_read_replaced_and_dropped(spark):
    s = staging.Staging(spark, "t")
    assert s.root.startswith(spark.conf.get("spark.checkpoint.dir"))
    a = s.put("a", spark.range(5).selectExpr("id", "if(id = 3, null, id) as v"))
    first = s.paths["a"]
    b = s.put("a", a.filter("id > 1"))
    assert b.count() == 3 and s.paths["a"] != first and not os.path.exists(first.removeprefix("file://"))
    last = s.paths["a"]
    s.drop("a", "unknown")
    assert not os.path.exists(last.removeprefix("file://"))


def test_a_cluster_must_name_its_folder():
    conf = SimpleNamespace(get=lambda key, default=None: default)
    context = SimpleNamespace(applicationId="cluster-app", master="spark://host:7077")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        staging.shared_folder(SimpleNamespace(conf=conf, sparkContext=context))
    context.applicationId, context.master = "local-app", "local[2]"
    assert staging.shared_folder(SimpleNamespace(conf=conf, sparkContext=context)).startswith("file:///")
