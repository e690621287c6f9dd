import os
import subprocess
import sys

import pytest

from pagelore.llm import store

CODE = """
from pyspark.sql import SparkSession
from pagelore.llm import store
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{0}").getOrCreate()
t = store.written(spark.range(5))
assert t.count() == 5
import os
assert any(x.startswith("pagelore") for x in os.listdir("{0}"))
{1}
"""


@pytest.mark.parametrize("end", ["", "spark.stop()"])
def test_tables_go_when_the_driver_ends(tmp_path, end):
    done = subprocess.run([sys.executable, "-c", CODE.format(tmp_path, end)], cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
    assert not [x for x in os.listdir(tmp_path) if x.startswith("pagelore")]  # Spark leaves an empty folder of its own


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master, applicationId = "spark://host:7077", "app-1"
        getConf = staticmethod(lambda: Conf())

    class Conf:
        get = staticmethod(lambda *a: None)
        set = staticmethod(lambda *a: None)

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        store.folder(Session())


def test_the_session_decides_on_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    for given, after in (("10000", "2048"), ("500", "500")):
        spark.conf.set(key, given)
        store.small_batches(spark)
        assert spark.conf.get(key) == after
    spark.conf.set(key, before)
