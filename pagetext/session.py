"""Spark session defaults and shared-storage helpers.

Lineage cuts and versioned tables go below ``spark.checkpoint.dir`` (the shared
folder the cluster names); a cluster session without it is refused. Only plain
local runs fall back to a scratch folder.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job relies on (UTC so date formatting matches the oracle;
# AQE so shuffle partition counts and join strategies adapt at run time).
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "pagetext", driver_memory: str = "8g") -> SparkSession:
    builder = (SparkSession.builder.master(master).appName(app_name)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", driver_memory))
    for key, value in SESSION_DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder shared by all executors: ``spark.checkpoint.dir``.

    Where the session has none, a plain local run gets a scratch folder of its
    own, registered so that later calls agree; on a cluster that is an error,
    since executors do not see each other's folders.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if conf_dir:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(conf_dir)
        return conf_dir.rstrip("/")
    if sc.getCheckpointDir():
        return sc.getCheckpointDir().rstrip("/")
    if not re.match(r"local(\[|$)", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="pagetext-ckpt-")
    spark.conf.set("spark.checkpoint.dir", local)
    sc.setCheckpointDir(local)
    return local


def new_table_path(spark: SparkSession, name: str) -> str:
    """A never-before-used path under the shared folder (versioned writes)."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


SPREAD_CONF = "spark.pagetext.inputPartitions"


def spread(df):
    """``df`` dealt round-robin over as many partitions as the setting
    ``spark.pagetext.inputPartitions`` names; as it was scanned where that is unset.
    For small inputs in one row group and CPU-heavy work per row."""
    n = df.sparkSession.conf.get(SPREAD_CONF, None)
    return df.repartition(int(n)) if n else df
