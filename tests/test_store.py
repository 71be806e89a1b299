"""Where intermediate tables go."""

from types import SimpleNamespace

import pytest

from keepstone.operators import store


def test_a_cluster_needs_a_shared_folder(spark):
    def session(master, **conf):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get("folder", d)), sparkContext=SimpleNamespace(master=master))

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            store.shared_dir(session(master))
        assert store.shared_dir(session(master, folder="hdfs://x/y/")) == "hdfs://x/y"
    assert store.shared_dir(session("local[4]"))
