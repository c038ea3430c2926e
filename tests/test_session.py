"""The checkpoint folder comes from the session; a scratch one only when unset."""

import pytest

from reelpulse.session import checkpoint_dir


class _Conf:
    def __init__(self, values):
        self.values = values

    def get(self, key, default=None):
        return self.values.get(key, default)


class _Context:
    def __init__(self, current=None, master="local[2]"):
        self.current = current
        self.master = master

    def getCheckpointDir(self):
        return self.current

    def setCheckpointDir(self, path):
        self.current = path


class _Session:
    def __init__(self, conf, current=None, master="local[2]"):
        self.conf = _Conf(conf)
        self.sparkContext = _Context(current, master)


def test_uses_the_configured_shared_folder():
    s = _Session({"spark.checkpoint.dir": "/mnt/shared/ckpt"})
    assert checkpoint_dir(s) == "/mnt/shared/ckpt"
    assert s.sparkContext.current == "/mnt/shared/ckpt"


def test_keeps_an_existing_context_folder():
    s = _Session({}, current="/mnt/shared/other-ckpt")
    assert checkpoint_dir(s) == "/mnt/shared/other-ckpt"
    assert s.sparkContext.current == "/mnt/shared/other-ckpt"


def test_scratch_folder_only_when_unset():
    s = _Session({})
    path = checkpoint_dir(s)
    assert path and s.sparkContext.current == path


def test_a_cluster_without_a_shared_folder_is_an_error():
    for master in ("yarn", "spark://host:7077", "k8s://https://host"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            checkpoint_dir(_Session({}, master=master))
    shared = _Session({"spark.checkpoint.dir": "/mnt/shared/ckpt"}, master="yarn")
    assert checkpoint_dir(shared) == "/mnt/shared/ckpt"
