"""The queries run in a local session whose defaults name no shared folder."""

import os
import subprocess
import sys

NAMES = ["op1_decontaminate", "op2_token_store", "op5_mix", "op9_window_index", "op11_manifest", "op12_stream_dedup", "op13_spelling"]


def test_without_checkpoint_dir(sf_dir, tmp_path):
    code = (
        "from pyspark.sql import SparkSession\nimport __spark_entry__ as e\n"
        "s = SparkSession.builder.master('local[4]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '4').getOrCreate()\n"
        "assert s.conf.get('spark.checkpoint.dir', None) is None\n"
        f"print([e.queries()[n](s, '{sf_dir}').count() for n in {NAMES}])"
    )
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": f"{root}:{os.environ.get('PYTHONPATH', '')}"}
    done = subprocess.run([sys.executable, "-c", code], env=env, cwd=root, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    counts = eval(done.stdout.strip().splitlines()[-1])
    assert counts[1:6] == [200] * 5 and all(counts)
