"""Scratch tables: where they go and when they are gone."""

import os
from types import SimpleNamespace

import pytest

from kinspark import scratch as S


def fake(master, folder=None):
    conf = SimpleNamespace(get=lambda key, default=None: folder, set=lambda key, value: None)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[3,2,1024]"])
def test_a_cluster_needs_a_shared_folder(master):
    with pytest.raises(RuntimeError):
        S.shared_dir(fake(master))
    assert S.shared_dir(fake(master, "hdfs:///tmp/x/")) == "hdfs:///tmp/x"


def test_one_process_may_use_a_local_folder():
    assert S.shared_dir(fake("local[4]")).startswith("file://")


def test_tables_are_kept_and_dropped(spark):
    own = S.Scratch(spark)
    rows = own.keep(spark.range(10).withColumnRenamed("id", "k"), "rows")
    buckets = own.keep_bucketed(spark.range(100).withColumnRenamed("id", "k"), "buckets", "k")
    joined = buckets.hint("merge").join(rows, "k")
    assert joined.count() == 10
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 1  # the table in buckets stays where it is
    folder = own.root.removeprefix("file://")
    assert len(os.listdir(folder)) == 2
    child = own.child()
    child.keep(spark.range(1), "x")
    child.drop()
    assert not os.path.exists(child.root.removeprefix("file://")) and os.path.exists(folder)
    names = list(own.tables)
    own.drop()
    assert not os.path.exists(folder) and not any(spark.catalog.tableExists(x) for x in names)
    own.drop()
