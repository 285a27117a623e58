"""Every operator on executors that have no copy of the package."""

import os
import subprocess
import sys

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {shared!r})
         .config("spark.sql.warehouse.dir", {shared!r} + "/warehouse").getOrCreate())
spark.sparkContext.setLogLevel("ERROR")
def there(_):
    try:
        import tracelode
    except ModuleNotFoundError:
        return [0]
    return [1]
assert sum(spark.sparkContext.parallelize(range(2), 2).mapPartitions(there).collect()) == 0, "the workers have the package"
from tracelode.llm import queries
for name, query in queries.QUERIES.items():
    assert query(spark, {sf!r}).count() > 0, name
print("all", len(queries.QUERIES))
"""


def test_no_package_on_executors(tmp_path, sf):
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=repo, shared=str(tmp_path), sf=sf)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0 and "all 13" in done.stdout, done.stderr[-3000:]
