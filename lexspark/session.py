"""Session helpers."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, app: str = "lexspark", **conf: str) -> SparkSession:
    """A local session as the tests and the benchmark use it."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    defaults = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: the one the cluster names in ``spark.checkpoint.dir``, else the one set for the session.

    RuntimeError where there is none: a folder of one machine would not do, so none is made up. A local session
    (``local[...]``, ``local-cluster[...]``: tests and benchmarks) is one machine; it gets a folder that is removed when
    Python ends.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None) or current
    if not named:
        if not context.master.startswith(("local[", "local-cluster[")) and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="lexspark-checkpoint-")
        atexit.register(shutil.rmtree, named, True)
    if current is None:
        context.setCheckpointDir(named)
    return named
