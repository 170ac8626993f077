"""Tables in the shared folder."""

import os

import pytest

from tokenloom.sources import tables


class Session:
    """A session of a cluster, as far as shared_dir() asks."""

    def __init__(self, master, told=None, checkpoint=None):
        self.master, self.told, self.checkpoint = master, told, checkpoint
        self.sparkContext = self.conf = self

    def getConf(self):
        return self

    def get(self, key, default=None):
        return self.told if key == "spark.checkpoint.dir" else default

    def getCheckpointDir(self):
        return self.checkpoint

    def setCheckpointDir(self, path):
        self.checkpoint = path


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(RuntimeError):
        tables.shared_dir(Session("spark://host:7077"))
    assert tables.shared_dir(Session("spark://host:7077", "hdfs://x/y/")) == "hdfs://x/y"
    assert tables.shared_dir(Session("yarn", None, "hdfs://z")) == "hdfs://z"
    assert os.path.isdir(tables.shared_dir(Session("local[2]")))


def test_cut_and_forget(spark, tmp_path):
    df, path = tables.cut(spark.range(5), str(tmp_path))
    assert path.startswith(str(tmp_path)) and sorted(r["id"] for r in df.collect()) == list(range(5))
    assert "Range" not in df._jdf.queryExecution().optimizedPlan().toString()
    tables.forget(spark, path)
    assert not os.path.exists(path)


def test_scratch_goes_at_the_end(spark, tmp_path):
    import subprocess
    import sys

    code = f"""
from pyspark.sql import SparkSession
from tokenloom.sources import tables
s = SparkSession.builder.master("local[1]").config("spark.checkpoint.dir", "{tmp_path}").config("spark.ui.enabled", "false").getOrCreate()
with open(tables.scratch(s, "x.json"), "w") as f:
    f.write("x")
tables.cut(s.range(3))
import os
assert len(os.listdir("{tmp_path}")) >= 2
s.stop()
"""
    subprocess.run([sys.executable, "-c", code], check=True, env=os.environ, timeout=120, capture_output=True)
    assert not [x for x in os.listdir(tmp_path) if x.startswith("cut-") or len(x) == 32]
