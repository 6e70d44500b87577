from __future__ import annotations

import os
import subprocess
import sys


def test_intermediate_data_goes_with_the_process(tmp_path):
    """Everything below the shared folder is removed when the driver ends, and nothing else in it."""
    (tmp_path / "other").mkdir()
    code = f"""
from airlake.session import build_session, cut_lineage, new_dir
spark = build_session("gone", "local[2]", 2)
path = new_dir(spark, "step")
assert path != new_dir(spark, "step") and path.startswith({str(tmp_path)!r})
spark.range(5).write.parquet(path)
assert cut_lineage(spark.range(3)).count() == 3
import os
assert os.path.isdir(path)
spark.stop()
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", code], cwd=root, env=os.environ | {"PYTHONPATH": root, "PYSPARK_SUBMIT_ARGS": f"--conf spark.checkpoint.dir={tmp_path} pyspark-shell"}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    # Spark's own checkpoint folder stays with the cluster that named it
    assert "other" in os.listdir(tmp_path) and not [d for d in os.listdir(tmp_path) if d.startswith("airlake-")]
