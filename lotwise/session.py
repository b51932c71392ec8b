"""Session defaults and the one place that decides where lineage is cut."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(app: str = "lotwise", cores: str | None = None, shuffle: int | None = None) -> SparkSession:
    """A local session for tests and the bench; on a cluster use the session spark-submit gives you."""
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    n = shuffle or (int(cores) if cores.isdigit() else 8)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``. Only a local master may fall back to a temporary
    folder, because there every task sees the same disk."""
    sc = spark.sparkContext
    have = sc._jsc.sc().getCheckpointDir()
    folder = spark.conf.get(CHECKPOINT_CONF, None) or (have.get() if have.isDefined() else None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="spark-ckpt-")
    if have.isEmpty():
        sc.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of ``df``: survives lost executors, stops plans growing with every round."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
