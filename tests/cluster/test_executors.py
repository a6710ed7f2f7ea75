"""Jobs on several executors, before the session of the other tests starts."""

import os
import subprocess
import sys

SEVERAL_EXECUTORS = """
from pyspark.sql import SparkSession, functions as F
from arealoom.operators import breaks
breaks.SORTED = 1000
conf = {"spark.master": "local-cluster[2,1,700]", "spark.executor.memory": "700m", "spark.driver.memory": "700m", "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.checkpoint.dir": FOLDER}
conf |= {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
spark = SparkSession.builder.config(map=conf).getOrCreate()
n = 300_007
rows = spark.range(n).select(F.lit(1).alias("g"), (F.col("id") * 7919 % n).cast("double").alias("v"))
print("BREAKS", breaks.group_breaks(rows, ["g"], "v").first().breaks == [float((i + 1) * n // 4) for i in range(3)])
"""


def test_breaks_on_several_executors(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = f"FOLDER = 'file://{tmp_path}'{SEVERAL_EXECUTORS}"
    env = {k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK_GATEWAY", "SPARK_"))} | {"PYTHONPATH": f"{root}:{os.environ.get('PYTHONPATH', '')}"}
    done = subprocess.run([sys.executable, "-c", code], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=600)
    crashes = [f.read_text()[:3000] for f in tmp_path.glob("hs_err*")]
    assert "BREAKS True" in done.stdout, f"exit {done.returncode}\n{done.stdout}\n{done.stderr}\n{crashes}"
