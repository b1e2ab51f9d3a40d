"""SparkSession settings the operators are designed around."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that matter at cluster scale as well as locally:
#  * AQE re-plans joins at runtime (a semi-join build side that turns out
#    small becomes a broadcast, measured rather than guessed) and splits
#    skewed shuffle partitions of a hot phone or contestant key.
#  * RocksDB keeps per-phone quota state off the JVM heap.
#  * UTC so that TIMESTAMP values print as UTC wall-clock times (the
#    operators' own time arithmetic does not depend on the session zone).
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # quotas up to this many calls keep their limit before the shuffle
    "spark.sql.optimizer.windowGroupLimitThreshold": "100000",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "tallyline", extra: dict | None = None) -> SparkSession:
    """Get or create a session with :data:`DEFAULT_CONF` applied.

    On a cluster the master and memory come from ``spark-submit``; ``master``
    is only for local runs and tests.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    checkpoint_root(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    Uses the cluster's ``spark.checkpoint.dir``. Only in a local run (one
    process, as in tests) a fresh scratch folder is made where it is unset; on
    a cluster a folder of one machine would lose data, so that raises.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None)
    if root:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(root)
        return root
    current = sc.getCheckpointDir()
    if current:
        # setCheckpointDir adds a per-application subfolder; report its parent.
        return os.path.dirname(current.rstrip("/"))
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    root = tempfile.mkdtemp(prefix="run-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(root)
    return root


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once as parquet under the shared checkpoint folder and
    return a DataFrame reading it, cutting its lineage.

    For small derived tables (one row per batch, say) that later steps read
    several times: the source is scanned once instead of once per use, a lost
    executor does not send the job back to the source, and the planner sees
    the table's real size. (``checkpoint()`` would compute the plan twice,
    once to count and once to write, unless it were cached first.)
    """
    spark = df.sparkSession
    path = os.path.join(tables_root(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.parquet(path)


def tables_root(spark: SparkSession) -> str:
    """Folder of this application's materialized tables."""
    return os.path.join(checkpoint_root(spark), "tables", spark.sparkContext.applicationId)


def drop_tables(spark: SparkSession) -> bool:
    """Delete the tables this application materialized; call it when no
    DataFrame made from them is needed any more. Returns whether there were any."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(tables_root(spark))
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return store.delete(path, True)


def drop_table(df: DataFrame) -> None:
    """Delete the table that ``df``, made by :func:`materialize`, reads; call it when
    nothing made from it will be read again."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cluster_conf(input_bytes: int, executors: int, cores_per_executor: int,
                 split_bytes: int = 512 << 20, shuffle_bytes: int = 256 << 20,
                 widest_shuffle_bytes: int | None = None) -> dict:
    """Settings sized for a cluster run over ``input_bytes`` of parquet.

    * scan splits of ``split_bytes`` (512 MB): 100 TB gives ~200k scan tasks,
      ~25 waves on 1000 executors x 8 cores;
    * one initial shuffle partition per ``shuffle_bytes`` (256 MB) of the widest
      shuffle, at least two per task slot. ``widest_shuffle_bytes`` is the
      input unless given: word counts and calls joined with their running
      counts move about as much as they read. AQE merges small partitions up
      to ``shuffle_bytes`` at runtime;
    * skewed join partitions are split when 5x the median and over 512 MB;
    * the streaming state store uses changelog checkpoints and bounded memory.
    """
    slots = executors * cores_per_executor
    partitions = max(2 * slots, -(-(widest_shuffle_bytes or input_bytes) // shuffle_bytes))
    return {
        "spark.sql.files.maxPartitionBytes": str(split_bytes),
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(shuffle_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(512 << 20),
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        # one phone's quota state is a single BIGINT, but there are many phones
        # per executor: cap RocksDB's native memory instead of letting it grow
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    }
