"""Where intermediate tables may go."""

import os
from types import SimpleNamespace

import pytest

from lexspark.session import checkpoint_dir


class Context:
    def __init__(self, master, folder=None):
        self.master, self.folder = master, folder

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def session(master, named=None, folder=None):
    return SimpleNamespace(sparkContext=Context(master, folder), conf=SimpleNamespace(get=lambda key, default: named or default))


def test_the_named_folder_is_taken():
    spark = session("spark://host:7077", "hdfs://shared/x")
    assert checkpoint_dir(spark) == "hdfs://shared/x" == spark.sparkContext.folder
    assert checkpoint_dir(session("yarn", None, "hdfs://set/before")) == "hdfs://set/before"


def test_a_cluster_without_one_is_refused():
    with pytest.raises(RuntimeError):
        checkpoint_dir(session("yarn"))


def test_one_machine_gets_a_folder():
    spark = session("local[4]")
    assert os.path.isdir(checkpoint_dir(spark)) and checkpoint_dir(spark) == spark.sparkContext.folder
