"""Shared-folder resolution without a real cluster (stub session)."""

import pytest

from rulescope.session import checkpoint_root, shared_path


class _Conf:
    def __init__(self, value):
        self.value = value

    def get(self, key, default=None):
        return self.value if key == "spark.checkpoint.dir" and self.value else default


class _Ctx:
    def __init__(self, master, ckpt=None):
        self.master = master
        self.ckpt = ckpt

    def getCheckpointDir(self):
        return self.ckpt

    def setCheckpointDir(self, d):
        self.ckpt = d


class _Session:
    def __init__(self, master, conf=None, ckpt=None):
        self.conf = _Conf(conf)
        self.sparkContext = _Ctx(master, ckpt)


def test_configured_folder_is_used():
    s = _Session("yarn", conf="hdfs://nn/shared/ckpt")
    assert checkpoint_root(s) == "hdfs://nn/shared/ckpt"
    assert shared_path(s, "x").startswith("hdfs://nn/shared/ckpt/rulescope/x-")


def test_context_folder_is_second_choice():
    s = _Session("yarn", ckpt="s3a://bucket/ckpt/abc")
    assert checkpoint_root(s) == "s3a://bucket/ckpt/abc"


def test_local_mode_gets_a_fresh_folder():
    s = _Session("local[4]")
    root = checkpoint_root(s)
    assert root and s.sparkContext.getCheckpointDir() == root


def test_cluster_without_folder_is_an_error():
    with pytest.raises(RuntimeError):
        checkpoint_root(_Session("spark://master:7077"))
