"""Session construction and shared-storage helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "ledgerlens", extra: dict | None = None) -> SparkSession:
    """A session with AQE on, UI off and UTC time.

    On a cluster ``master`` is None and the launcher decides. AQE merges
    shuffle partitions but never adds any, so ``shuffle_partitions`` is the
    most a shuffle can have: unset, a local master gets 8 and a cluster keeps
    its own setting, which should be several times its task slots.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # broadcast only what is provably small; the planner falls back to
        # sort-merge / shuffle-hash beyond this size
        "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
        "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
    }
    if master and master.startswith("local"):
        cores = master.removeprefix("local").strip("[]")
        shuffle_partitions = shuffle_partitions or 8
        conf["spark.ledgerlens.inputPartitions"] = cores if cores.isdigit() else str(os.cpu_count())
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if extra:
        conf.update(extra)
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_PRIVATE_DIR: str | None = None


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster.

    Reads ``spark.checkpoint.dir`` from the session. Only on a local master
    (tests) may it be unset: a private scratch folder is then created once
    per process. On any other master executors would each write to their own
    disk, so a missing setting is an error there. The RDD checkpoint
    directory (used by ``DataFrame.checkpoint``) is registered once."""
    global _PRIVATE_DIR
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if _PRIVATE_DIR is None:
            _PRIVATE_DIR = tempfile.mkdtemp(prefix="ledgerlens-ckpt-")
        d = _PRIVATE_DIR
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A table location under the shared checkpoint folder, unique per call,
    so that two runs or two jobs never write to the same place."""
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


def materialize(df):
    """Reliable checkpoint into the shared checkpoint folder: a DataFrame
    that feeds several branches of a plan is computed once, and the lineage
    is cut (a lost executor re-reads the files instead of recomputing)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
