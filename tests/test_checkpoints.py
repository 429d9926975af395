import pytest

from conceptmill import checkpoints


class Context:
    def __init__(self, master, folder=None):
        self.master, self.folder = master, folder

    def getCheckpointDir(self):  # noqa: N802
        return self.folder

    def setCheckpointDir(self, folder):  # noqa: N802
        self.folder = folder


class Session:
    def __init__(self, master, conf=None, folder=None):
        self.sparkContext, self.conf = Context(master, folder), conf or {}


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(RuntimeError):
        checkpoints.shared_folder(Session("spark://host:7077"))
    with pytest.raises(RuntimeError):
        checkpoints.shared_folder(Session("local-cluster[2,1,1024]"))
    assert checkpoints.shared_folder(Session("yarn", {"spark.checkpoint.dir": "hdfs://x/y/"})) == "hdfs://x/y"
    assert checkpoints.shared_folder(Session("yarn", folder="hdfs://x/z")) == "hdfs://x/z"
    assert checkpoints.shared_folder(Session("local[4]"))


def test_checkpointed_keeps_rows(spark):
    assert checkpoints.checkpointed(spark.range(5)).count() == 5
