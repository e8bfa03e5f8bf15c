"""Folders that driver and executors share, for what is written and read again."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession, label: str) -> str:
    """A new, unused path in the folder that spark.checkpoint.dir names.

    Where that is unset, a session on this machine alone (master local[...])
    gets a local folder; on a cluster its absence is an error.
    """
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not at and (java := sc._jsc.sc().getCheckpointDir()).isDefined():
        at = java.get()
    if not at:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = f"file:///tmp/lodestrand-{os.getpid()}"
    return f"{at.rstrip('/')}/lodestrand-{sc.applicationId}/{label}-{uuid.uuid4().hex}"
