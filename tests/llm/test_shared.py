"""Operators in a session that names no checkpoint folder, as a fresh driver with empty settings has it."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

from arraymill.llm import shared

SCRIPT = """
from pyspark.sql import SparkSession
from arraymill.llm import fingerprints, line_dedup
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
line = "a line of well over fifty characters that two documents have in common"
docs = spark.createDataFrame([(1, f"{line}\\none"), (2, f"two\\n{line}")], "doc_id long, text string")
print({r["doc_id"]: r["n_removed"] for r in line_dedup.deduplicated(docs).collect()}, fingerprints.compared(docs).count())
"""


def test_operators_run_where_no_checkpoint_folder_is_set(tmp_path):
    here = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    (tmp_path / "conf").mkdir()
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path / "conf"), "PYTHONPATH": os.pathsep.join(filter(None, [here, os.environ.get("PYTHONPATH")]))}
    done = subprocess.run([sys.executable, "-c", SCRIPT], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300, check=False)
    assert done.returncode == 0, done.stderr[-2000:]
    assert done.stdout.split("\n")[-2:] == ["{1: 0, 2: 1} 2", ""]


def test_written_tables_return_native_memory_of_the_driver(spark):
    jvm = spark.sparkContext._jvm
    pid = jvm.java.lang.ProcessHandle.current().pid()
    if "System.trim_native_heap" not in subprocess.run(["jcmd", str(pid), "help"], capture_output=True, text=True, check=False).stdout:
        pytest.skip("this JVM can't return native memory")
    held = lambda: int(Path(f"/proc/{pid}/statm").read_text().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 1e6
    shared.written(spark.range(10).toDF("id"), "warm")
    before = held()
    taken = [jvm.java.util.zip.Deflater() for _ in range(800)]
    full = held()
    for x in taken[:-1]:  # the last one stands above the gaps
        x.end()
    shared.written(spark.range(10).toDF("id"), "after")
    left = held()
    taken[-1].end()
    assert full - before > 40 and full - left > (full - before) / 2
