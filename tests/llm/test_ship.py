"""Python workers get the package wherever the session runs, also where neither PYTHONPATH nor the working folder has it."""

import os
import subprocess
import sys
from pathlib import Path
from unittest.mock import Mock

import pytest

from quarry.llm.common import shared_dir

ROOT = Path(__file__).resolve().parents[2]
SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
make = SparkSession.builder.master(sys.argv[2]).config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "2g")
if sys.argv[3]:
    make = make.config("spark.checkpoint.dir", sys.argv[3])
spark = make.getOrCreate()
import __spark_entry__ as entry
for name in sys.argv[4:]:
    print("rows", name, entry.queries()[name](spark, "/root/testdata/sf0.001").count(), flush=True)
spark.stop()
"""


@pytest.mark.parametrize("master, names", [("local-cluster[2,1,1024]", "op1_near_dedup op2_language op4_lm_scoring op7_license_scan op8_toxicity op9_packing op10_quality_classifier"), ("local[4]", "op7_license_scan op9_packing")])
def test_workers_get_the_package(tmp_path, master, names):
    shared = str(tmp_path / "shared") if "cluster" in master else ""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT, str(ROOT), master, shared, *names.split()], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
    assert [line.split()[1] for line in done.stdout.splitlines() if line.startswith("rows")] == names.split()
    if shared:  # nothing stays behind
        assert not [p for p in Path(shared).rglob("*") if p.is_file()]


@pytest.mark.parametrize("master, refused", [("yarn", True), ("local-cluster[2,1,1024]", True), ("spark://host:7077", True), ("local", False), ("local[8]", False)])
def test_a_cluster_without_a_shared_folder_is_refused(master, refused):
    context = Mock(master=master, getCheckpointDir=Mock(side_effect=[None, "file:/set/here"]))
    session = Mock(sparkContext=context, conf=Mock(get=lambda key, default: default))
    if refused:
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_dir(session)
    else:
        assert shared_dir(session) == "file:/set/here"
