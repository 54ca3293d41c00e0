"""Where scratch data may go."""

from __future__ import annotations

import pytest

from promptweave.session import scratch_path, shared_folder


class Conf:
    def __init__(self, **values):
        self.values = values

    def get(self, key, default=None):
        return self.values.get(key, default)


class Context:
    def __init__(self, master, folder=None):
        self.master, self.folder = master, folder

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


class Session:
    def __init__(self, master, folder=None, **conf):
        self.sparkContext, self.conf = Context(master, folder), Conf(**conf)


def test_named_folder_is_used():
    session = Session("yarn", **{"spark.checkpoint.dir": "hdfs://shared/x"})
    assert shared_folder(session) == "hdfs://shared/x"
    assert session.sparkContext.folder == "hdfs://shared/x"


def test_folder_already_set_is_kept():
    assert shared_folder(Session("yarn", "hdfs://set/before")) == "hdfs://set/before"


@pytest.mark.parametrize("master", ["spark://host:7077", "local-cluster[3,2,1024]", "yarn"])
def test_a_cluster_gets_no_local_folder(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session(master))


def test_a_local_session_gets_one():
    assert "promptweave-" in shared_folder(Session("local[2]"))


def test_scratch_paths_differ(spark):
    first, second = scratch_path(spark, "a"), scratch_path(spark, "a")
    assert first != second
    assert first.startswith(spark.conf.get("spark.checkpoint.dir"))
