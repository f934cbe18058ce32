"""The operators on executors that don't have the package."""

import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[2]
CODE = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
from fathom.llm.queries import QUERIES
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
for name, f in QUERIES.items():
    print(name, f(spark, sys.argv[2]).count())
"""


def test_functions_travel_by_value(sf, tmp_path):
    out = subprocess.run([sys.executable, "-c", CODE, str(REPO), sf], cwd=tmp_path, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr[-2000:]
    assert len(out.stdout.split("\n")) == 11
