"""What workers need from the session: the package, and a folder that all of them share."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


#: Environment of Python workers: arrays of 256 KB or more are mapped on their own and unmapped when freed.
WORKER_MEMORY = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_MMAP_THRESHOLD_": str(256 << 10), "MALLOC_ARENA_MAX": "2"}


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, whatever their working folder is.

    On a cluster whose nodes don't have that folder, ship the package with --py-files as usual.  Workers also get
    settings of the C library's allocator under which large arrays leave no holes behind, unless they are set.
    """
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    have = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in have:
        env["PYTHONPATH"] = os.pathsep.join([root, *have])
    for name, value in WORKER_MEMORY.items():
        if name not in os.environ:
            env.setdefault(name, value)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir.  Where that is unset, a temporary one, in local mode only: executors on
    other machines couldn't read it."""
    sc = spark.sparkContext
    where = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidespan-"))
        where = sc.getCheckpointDir()
    return where.rstrip("/")
