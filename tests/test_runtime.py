import shutil
from urllib.parse import urlparse

from gleaner import runtime


def test_cut_writes_to_the_folder_of_the_session(spark):
    df = spark.range(10).withColumnRenamed("id", "x")
    out = runtime.cut(df)
    assert sorted(r.x for r in out.collect()) == list(range(10))
    assert all(f.startswith(runtime.scratch_dir(spark).replace("file:///", "file:/")) or runtime.scratch_dir(spark) in f for f in out.inputFiles())
    assert "Range" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_still_there(spark):
    out = runtime.cut(spark.range(3))
    assert runtime.still_there(out)
    shutil.rmtree(urlparse(out.inputFiles()[0]).path.rsplit("/", 1)[0])
    assert not runtime.still_there(out)


def test_small_and_spread(spark):
    few, many = spark.range(5), spark.range(50)
    plan = lambda d: d._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in plan(runtime.small(few, 10))
    assert "broadcast" not in plan(runtime.small(many, 10))
    assert runtime.spread(spark.range(0, 10, 1, 1)).rdd.getNumPartitions() == runtime.parallelism(spark)
    wide = spark.range(0, 10, 1, 64)
    assert runtime.spread(wide) is wide


def test_small_counts_bytes_too(spark, monkeypatch):
    monkeypatch.setattr(runtime, "BROADCAST_BYTES", 40)
    plan = lambda rows, schema: runtime.small(spark.createDataFrame(rows, schema), 10)._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in plan([("short", None), (None, ["a"])], "a string, b array<string>")
    assert "broadcast" not in plan([("x" * 41, None)], "a string, b array<string>")
    assert "broadcast" not in plan([(None, ["x" * 30, "y" * 30])], "a string, b array<string>")


def test_scratch_folder_of_one_machine_is_refused_on_a_cluster():
    import types

    import pytest

    conf, context = types.SimpleNamespace(get=lambda *_: None), types.SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        runtime.scratch_dir(types.SimpleNamespace(conf=conf, sparkContext=context))
