"""The library without the training-data subpackage, and with workers that have no copy of the package."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]


def test_rest_runs_without_the_subpackage_and_without_the_package_on_workers(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "*.pyc"))
    script = tmp_path / "driver.py"
    script.write_text(f"""
import sys
sys.path.insert(0, {str(copy)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
seen = spark.range(1).mapInPandas(lambda batches: ((lambda: __import__("pandas").DataFrame({{"x": [__import__("importlib.util").util.find_spec("tessera") is not None]}}))() for _ in batches), "x boolean").first().x
assert not seen
import __spark_entry__
queries = __spark_entry__.queries()
assert not any(name.startswith("op") or name == "pipeline" for name in queries)
assert __spark_entry__.entry(spark).count()
for name, query in queries.items():
    df = query(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().toString()
    if any(x in plan for x in ("Python", "Pandas", "Arrow")):
        print(name, df.count())
""")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONPATH": os.pathsep.join(p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and Path(p).resolve() != REPO)}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-3000:]
    assert "g19_locate_quote_whole" in done.stdout
