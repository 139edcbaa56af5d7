"""The driver may run from anywhere, and executors have no copy of the package."""

import subprocess
import sys
from pathlib import Path

SCRIPT = """
import importlib.util, sys
spec = importlib.util.spec_from_file_location("entry", sys.argv[1])
driver = importlib.util.module_from_spec(spec)
spec.loader.exec_module(driver)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config(
    "spark.sql.shuffle.partitions", "2").getOrCreate()
for name in ("flowcell_completions", "flowcell_ready_stream"):
    print(name, driver.queries()[name](spark, sys.argv[2]).count())
"""


def test_python_tasks_run_from_another_folder(tmp_path, sf_dir):
    entry = Path(__file__).resolve().parents[1] / "__spark_entry__.py"
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT, str(entry), sf_dir],
        cwd=tmp_path,
        capture_output=True,
        text=True,
        timeout=300,
    )
    counts = dict(line.split() for line in done.stdout.splitlines() if line.startswith("flowcell"))
    assert len(counts) == 2, done.stderr[-2000:]
    assert counts["flowcell_completions"] == counts["flowcell_ready_stream"] != "0"
