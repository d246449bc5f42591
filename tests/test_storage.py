"""A session that names no shared folder works and leaves nothing behind; runs in a process of its own."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
import __spark_entry__
from quantloom import storage
kept = storage.materialise(spark.range(10), "kept")
gone = storage.materialise(spark.range(10), "gone")
storage.discard(gone)
assert kept.count() == 10
print("ROWS", __spark_entry__.entry(spark).count())
print("FOLDER", storage.shared_folder(spark))
"""


def test_plain_local_session_leaves_no_files(tmp_path):
    env = {k: v for k, v in os.environ.items() if k not in ("PYSPARK_SUBMIT_ARGS", "SPARK_CONF_DIR")}
    conf = tmp_path / "conf"
    conf.mkdir()
    env["SPARK_CONF_DIR"] = str(conf)
    env["TMPDIR"] = str(tmp_path)
    repo = str(Path(__file__).resolve().parents[1])
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT.format(repo=repo)], env=env, capture_output=True, text=True, timeout=300
    )
    assert done.returncode == 0, done.stderr[-2000:]
    said = dict(line.split(maxsplit=1) for line in done.stdout.splitlines() if line.startswith(("ROWS", "FOLDER")))
    assert int(said["ROWS"]) > 0
    assert not Path(said["FOLDER"]).exists()
