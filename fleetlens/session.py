"""Spark session helpers: one place for the configuration every job relies on."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Settings every plan in the library assumes: UTC dates, ANSI arithmetic
# (divides are always guarded), adaptive execution for skew and partition
# coalescing, no web UI.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # task-sized inputs and post-shuffle partitions; AQE coalesces small
    # shuffle partitions up to the advisory size and splits skewed ones
    "spark.sql.files.maxPartitionBytes": str(256 * 1024 * 1024),
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 * 1024 * 1024),
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # a batch of wide rows is held by the JVM and by the worker at once
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 * 1024 * 1024),
    "spark.ui.enabled": "false",
    # reliable checkpoints are deleted once their DataFrame is unreachable
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app: str = "fleetlens",
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the library's base configuration."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


#: sized for the cluster: what the cluster sets wins over the library's values
CLUSTER_SIZED = ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes")


def apply_session_conf(spark: SparkSession) -> None:
    """Prepare an existing session: SQL-level settings, and the package on the workers."""
    given = spark.sparkContext.getConf()
    for k, v in BASE_CONF.items():
        if k.startswith("spark.sql.") and not (k in CLUSTER_SIZED and given.contains(k)):
            spark.conf.set(k, v)
    ship_package(spark)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the workers, once per application: Python functions in
    plans import it there, wherever the driver was started from."""
    sc = spark.sparkContext
    if getattr(sc, "_fleetlens_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder = os.path.realpath(tempfile.mkdtemp(prefix="fleetlens-py-"))
    path = os.path.join(folder, "fleetlens.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for top, _, names in os.walk(here):
            for name in sorted(n for n in names if n.endswith(".py")):
                full = os.path.join(top, name)
                z.write(full, os.path.join("fleetlens", os.path.relpath(full, here)))
    sc.addPyFile(path)
    sc._fleetlens_shipped = True


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    The cluster's ``spark.checkpoint.dir`` wins.  Only a local-mode session
    without one (tests) gets a private scratch folder; on a cluster a missing
    setting is an error, because a machine-local folder would not survive the
    loss of the executor that wrote it.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="fleetlens-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the reliable checkpoint folder (survives executor loss)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scalars(df: DataFrame):
    """All columns of a one-row DataFrame as one struct-valued scalar subquery.

    Index the result by field name; every field then comes from a single
    evaluation of ``df`` instead of one subquery (one pass) per field.
    """
    from pyspark.sql import functions as F
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_s")).scalar()
