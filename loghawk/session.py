"""Session helpers: sensible defaults for tests and a checkpoint folder.

On a cluster the session is built by the platform; ``ensure_checkpoint_dir``
reads ``spark.checkpoint.dir`` from it and only falls back to a private
scratch folder when the setting is absent (local tests).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # runtime (post-shuffle) size check before a join is turned into a broadcast
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64MB",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # streaming state (e.g. one row per IP) kept in RocksDB off-heap, not the JVM heap
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "loghawk", extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.master(master).appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, setting one only when unset.

    The cluster names a shared folder in ``spark.checkpoint.dir``; we use it
    as is.  Only in local mode, when it is missing (tests), do we create a
    private scratch folder; on a cluster a missing setting is an error, never
    a machine-local folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster (e.g. on HDFS or an "
                               "object store); lineage cuts and model state are written there")
        configured = tempfile.mkdtemp(prefix="loghawk-ckpt-")   # local runs and tests only
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def cut_lineage(df: DataFrame, name: str = "cut", row_group_bytes: int | None = None) -> DataFrame:
    """Cut the lineage with a written Parquet table in the shared checkpoint
    folder (survives executor loss; never a local checkpoint).  Unlike an
    eager ``checkpoint()`` of an unpersisted plan, the plan runs once, and
    the read-back table prunes columns like any Parquet source.
    ``row_group_bytes``: what a task holds while it writes, for very wide rows."""
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    options = {"parquet.block.size": str(row_group_bytes)} if row_group_bytes else {}
    df.write.mode("overwrite").options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)     # known schema: no footer-reading job


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the checkpoint folder for written intermediate tables."""
    return os.path.join(ensure_checkpoint_dir(spark), name)


def size_for_input(spark: SparkSession, input_bytes: int, target_partition_bytes: int = 200 * 1024 ** 2,
                   file_split_bytes: int = 256 * 1024 ** 2) -> dict[str, str]:
    """Shuffle and scan sizing for a job over ``input_bytes`` of Parquet:
    about one shuffle partition per 200 MB (AQE coalesces small ones and
    splits skewed ones at run time) and 256 MB file splits.  Only settings
    the session does not carry already are set; returns what was set."""
    wanted = {
        "spark.sql.shuffle.partitions": str(max(int(input_bytes // target_partition_bytes), 8)),
        "spark.sql.files.maxPartitionBytes": str(file_split_bytes),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 * 1024 ** 2),
    }
    spark_defaults = {"spark.sql.shuffle.partitions": {"200"},
                      "spark.sql.files.maxPartitionBytes": {"128MB", "134217728", "128m"},
                      "spark.sql.adaptive.advisoryPartitionSizeInBytes": {"64MB", "67108864", "64m"}}
    done = {}
    for k, v in wanted.items():
        current = spark.conf.get(k, None)
        if current in (None, "") or current in spark_defaults[k]:
            spark.conf.set(k, v)
            done[k] = v
    return done
