"""Where checkpoints go."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def prepared(spark: SparkSession) -> SparkSession:
    """Uses the checkpoint folder that the cluster names; one of this machine only where all executors are its threads."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir")
        if shared is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoints"))
    return spark
