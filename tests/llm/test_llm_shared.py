import subprocess
import sys
import time

CODE = """
import os, sys
from pyspark.sql import SparkSession
from tidewatch.llm.shared import stored

spark = SparkSession.builder.master("local[1]").config(map={"spark.checkpoint.dir": "file://" + sys.argv[1], "spark.ui.enabled": "false"}).getOrCreate()
print("rows", stored(spark.range(3), "t").count(), "folders", sum(x.startswith("t-") for x in os.listdir(sys.argv[1])))
"""


def test_stored_tables_end_with_the_driver(tmp_path):
    done = subprocess.run([sys.executable, "-c", CODE, tmp_path], capture_output=True, text=True, timeout=120)
    assert "rows 3 folders 1" in done.stdout, done.stderr
    for _ in range(100):  # the JVM ends after Python
        left = list(tmp_path.glob("t-*"))
        if not left:
            break
        time.sleep(0.2)
    assert not left
