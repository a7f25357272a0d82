"""The shared folder under a plain configuration, where spark.checkpoint.dir is empty."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

from waymark import shared

CODE = """
from pyspark.sql import SparkSession
from waymark import shared
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
assert not spark.conf.get("spark.checkpoint.dir", None)
at = shared.shared_dir(spark)
assert at == shared.shared_dir(spark) and at.startswith("file:///tmp/")
spark.range(3).write.parquet(at + "/x")
assert spark.read.parquet(at + "/x").count() == 3
"""


def test_folder_of_a_plain_session(tmp_path):
    top = str(Path(__file__).resolve().parent.parent)
    subprocess.run([sys.executable, "-c", CODE], check=True, env=os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": top}, timeout=120)


def test_other_masters_need_the_setting():
    class Context:
        master, applicationId = "yarn", "x"

    class Session:
        sparkContext = Context

        class conf:
            get = staticmethod(lambda *_: None)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.shared_dir(Session)
