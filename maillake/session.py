"""Session helpers.

Library code never creates its own cluster settings: it reads what the
session already has.  ``local_session`` exists for tests, benches and the
command line; it sets the knobs a local run needs (UTC, AQE, few shuffle
partitions, no UI) and a checkpoint folder only when none is configured.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

UTC = "UTC"


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "maillake") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", UTC)
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("MAILLAKE_DRIVER_MEMORY", "8g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    On a cluster ``spark.checkpoint.dir`` names a shared (HDFS/S3/ABFS)
    folder and is used as is.  Only when it is unset -- a local test run --
    do we create one under the system temp folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors "
                               "(e.g. on HDFS or object storage); maillake checkpoints ordered "
                               "scans and stream state there")
        conf_dir = tempfile.mkdtemp(prefix="maillake-ckpt-")   # local mode only (tests)
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
