"""Session construction and shared-folder handling."""

from __future__ import annotations

import atexit
import tempfile

from pyspark.sql import SparkSession

# Settings the library relies on, all defaults of current Spark: AQE re-plans
# joins from measured sizes (a side only becomes a broadcast when its runtime
# size is under the threshold), coalesces small shuffle partitions and splits
# skewed join partitions.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}


def build_session(
    master: str = "local[*]",
    shuffle_partitions: int = 8,
    app_name: str = "funnelwise",
    extra_conf: dict[str, str] | None = None,
) -> SparkSession:
    """A session for tests, the bench and local runs.

    On a cluster, create the session with the cluster's own settings and
    pass it in instead; nothing in the library needs this function.
    """
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    The cluster's setting always wins.  Only when it is unset (local tests)
    is a fresh scratch folder created and registered.
    """
    configured = spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
        configured = tempfile.mkdtemp(prefix="funnelwise-ckpt-")
    spark.sparkContext.setCheckpointDir(configured)
    return spark.sparkContext.getCheckpointDir() or configured


def remove(spark: SparkSession, folder: str) -> None:
    """Remove a folder that this library wrote, through Hadoop's file system."""
    sc = spark.sparkContext
    if sc._jsc is None or sc._jsc.sc().isStopped():
        return
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def remove_at_exit(spark: SparkSession, folder: str) -> None:
    """Remove a scratch folder when the Python driver ends (if Spark still runs then)."""
    atexit.register(remove, spark, folder)
