"""Session construction and shared-storage helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import SparkConf
from pyspark.sql import SparkSession

# Settings every job relies on. AQE re-plans joins at runtime: a side is
# broadcast only when its *measured* size is under the threshold, otherwise
# the sort-merge / shuffled-hash join stays; skewed partitions are split.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.compression.codec": "snappy",
    "spark.ui.enabled": "false",
    "spark.driver.memory": "16g",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[8]", app: str = "faresight",
                  shuffle_partitions: int = 8, extra: dict | None = None) -> SparkSession:
    """Create (or fetch) a session with the defaults above.

    On a cluster the master, the partition counts and the checkpoint folder
    come from ``spark-submit`` or the cluster's own configuration; this helper
    only fills what is unset (``extra`` is the caller's explicit choice).
    """
    submitted = _submitted_conf()
    conf = {"spark.master": master, **DEFAULT_CONF,
            "spark.sql.shuffle.partitions": str(shuffle_partitions)}
    conf = {k: v for k, v in conf.items() if k not in submitted}
    conf.update(extra or {})
    b = SparkSession.builder.appName(app)
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def _submitted_conf() -> set[str]:
    """Settings already given by the launcher (spark-submit, spark-defaults) or a live session."""
    live = SparkSession.getActiveSession()
    if live is not None:
        return {k for k, _ in live.sparkContext.getConf().getAll()}
    if "PYSPARK_GATEWAY_PORT" in os.environ:  # launched by spark-submit: its JVM holds the settings
        return {k for k, _ in SparkConf().getAll()}
    return set()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a local one only if unset.

    On a cluster ``spark.checkpoint.dir`` names a folder every executor can
    reach (HDFS / object store); it is used as-is. Only a local session that
    has none (tests, local runs) gets a fresh scratch folder; a cluster
    session without one is refused, as executors could not share it.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        master = sc.master or ""
        if not (master.startswith("local[") or master == "local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="faresight-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return sc.getCheckpointDir() or current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path (URI scheme kept) under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What is written in here gives back the disk of its shuffles as each write ends.

    Otherwise Spark keeps them until the driver collects garbage, beside all that follows. For writes only, which plan
    anew and share no shuffle with another execution; a table written so is read from its files."""
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREE_SHUFFLES) if before is None else spark.conf.set(FREE_SHUFFLES, before)


def sizing_conf(input_bytes: int, total_cores: int, target_shuffle_bytes: int = 128 * 1024 * 1024,
                scan_split_bytes: int = 256 * 1024 * 1024) -> dict[str, str]:
    """Partition sizing for a given input size and cluster.

    Shuffle partitions are sized so that a full shuffle of the input lands
    near ``target_shuffle_bytes`` per partition (and at least two waves of
    the cluster's cores); AQE then coalesces small ones and splits skewed
    ones at runtime. Scans split files at ``scan_split_bytes``. Example:
    100 TB on 1000 executors x 8 cores -> ~800k shuffle partitions, 256 MB
    scan splits.
    """
    parts = max(2 * total_cores, -(-int(input_bytes) // int(target_shuffle_bytes)))
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_shuffle_bytes),
        "spark.sql.files.maxPartitionBytes": str(scan_split_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * target_shuffle_bytes),
    }
