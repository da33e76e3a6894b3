"""Where intermediate tables go: the named folder, and none of the machine's own on a cluster."""

from types import SimpleNamespace

import pytest

from bramble import storage


def session(master, named=None, own=None):
    kept = [own]
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: kept[0], setCheckpointDir=lambda path: kept.__setitem__(0, path))
    return SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: named if name == "spark.checkpoint.dir" else default), sparkContext=context), kept


def test_named_folder():
    spark, kept = session("spark://host:7077", "hdfs:///shared")
    assert storage.shared_dir(spark) == "hdfs:///shared" == kept[0]
    assert storage.scratch(spark, "x").startswith("hdfs:///shared/x-")


def test_no_folder_of_the_machine_on_a_cluster():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(session("yarn")[0])
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(session("spark://host:7077")[0])


def test_local_session():
    spark, kept = session("local[4]")
    assert storage.shared_dir(spark) == kept[0] is not None
    assert storage.shared_dir(session("local[4]", own="/there")[0]) == "/there"
