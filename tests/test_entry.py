"""The entry in a process of its own: order of session and import, and the package on the workers."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
LATE = """
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
sys.path.insert(0, ROOT)
import __spark_entry__ as entry
q = entry.queries()
print("ROWS", q[NAME](spark, "/root/testdata/sf0.001").count())
"""


@pytest.mark.parametrize("name", ["json_update", "op3_token_counts"])
def test_a_session_that_began_before_the_import(tmp_path, name):
    sys.path.insert(0, ROOT)
    import __spark_entry__

    if name not in __spark_entry__.queries():
        pytest.skip("taken away")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = LATE.replace("ROOT", repr(ROOT)).replace("NAME", repr(name))
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and int(done.stdout.rpartition("ROWS")[2]) > 100, done.stderr[-2000:]
