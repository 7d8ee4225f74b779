"""The database queries where executors are processes of their own."""

import os
import subprocess
import sys

import duckdb
import pytest

from pulsegrid.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
RUN = """
import sys
from pyspark.sql import SparkSession
from pulsegrid.plans import catalog
conf = {"spark.executor.memory": "600m", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.checkpoint.dir": "file://" + sys.argv[2]}
spark = SparkSession.builder.master("local-cluster[2,1,1000]").config(map=conf).getOrCreate()
for name in ("jdbc_count", "jdbc_query", "jdbc_table"):
    print("rows of", name, sorted(map(tuple, catalog.queries()[name](spark, sys.argv[1]).collect())))
spark.stop()
"""


def test_jdbc_queries_on_separate_executors(tmp_path):
    shared = tmp_path / "shared"
    shared.mkdir()
    env = {k: v for k, v in os.environ.items() if not k.startswith("PYSPARK_GATEWAY")}
    out = subprocess.run([sys.executable, "-c", RUN, SF, str(shared)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{SF}/customer.parquet'")
    want = [f"rows of {name} {sorted(con.execute(catalog.oracle_sql()[name]).fetchall())}" for name in ("jdbc_count", "jdbc_query", "jdbc_table")]
    assert [x for x in out.stdout.splitlines() if x.startswith("rows of")] == want, out.stderr[-2000:]
