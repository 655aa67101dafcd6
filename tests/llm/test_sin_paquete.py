"""All training-data queries on executors that cannot import the package."""

import os
import subprocess
import sys
from pathlib import Path

GUION = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local-cluster[1,2,1024]").config("spark.executor.memory", "1g").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").config("spark.checkpoint.dir", {carpeta!r}).config("spark.sql.session.timeZone", "UTC").getOrCreate()
s.sparkContext.setLogLevel("ERROR")
try:
    s.range(1).rdd.map(lambda x: __import__("legajo")).collect()
    print("IMPORTS")
except Exception:
    pass
from legajo.llm import consultas
for n, f in consultas.queries().items():
    if n.endswith(("_found", "_ids")):
        print("ROWS", n, f(s, "/root/testdata/sf0.001").count())
"""


def test_queries_without_the_package_on_executors(tmp_path):
    guion = tmp_path / "guion.py"
    guion.write_text(GUION.format(repo=str(Path(__file__).resolve().parents[2]), carpeta=str(tmp_path / "ck")))
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")} | {"PYSPARK_PYTHON": sys.executable, "SPARK_SCALA_VERSION": "2.13"}
    r = subprocess.run([sys.executable, str(guion)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    filas = [x.split() for x in r.stdout.splitlines() if x.startswith("ROWS")]
    assert "IMPORTS" not in r.stdout and len(filas) == 9, r.stderr[-2000:]
    assert sum(int(x[2]) > 0 for x in filas) >= 7
