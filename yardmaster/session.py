"""A session for tests, benches and notebooks; clusters bring their own."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", memory: str = "8g", shuffle_partitions: int = 8) -> SparkSession:
    """Local Spark in UTC with adaptive execution; its checkpoint folder is new."""
    checkpoints = os.environ.get("SPARK_CHECKPOINTS") or tempfile.mkdtemp(prefix="spark-")
    conf = {
        "spark.driver.memory": memory,
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": f"file://{checkpoints}",
        "spark.sql.warehouse.dir": f"file://{checkpoints}/warehouse",
    }
    return SparkSession.builder.master(f"local[{cpus}]").appName("yardmaster").config(map=conf).getOrCreate()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share, spark.checkpoint.dir."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
