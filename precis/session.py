"""Session helpers.

On a cluster the session is created by the platform; these helpers only
fill in settings that are unset (local runs and tests).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every plan in this package is written for. AQE re-plans joins and
# coalesces small shuffle partitions; skew-join splits hot join keys.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def _driver_memory() -> str:
    """Local runs only: about 60 % of the machine's RAM, at most 16 GiB."""
    try:
        total = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES")
        return f"{max(1, min(16, int(total * 0.6 / 2 ** 30)))}g"
    except (ValueError, OSError, AttributeError):
        return "4g"


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "precis") -> SparkSession:
    """Return the active session, or build a local one with sane defaults."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    cpus = os.environ.get("BENCH_CPUS", "8")
    from pyspark import SparkConf
    builder = SparkSession.builder.appName(app_name)
    if master or not SparkConf().get("spark.master", None):       # spark-submit --master stays in force
        builder = builder.master(master or f"local[{cpus}]")
    builder = (builder
               .config("spark.driver.memory", os.environ.get("PRECIS_DRIVER_MEMORY", _driver_memory()))
               .config("spark.sql.shuffle.partitions",
                       str(shuffle_partitions or int(cpus) * 2)))
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark, create=True)
    return spark


def checkpoint_dir(spark: SparkSession, create: bool = False) -> str | None:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    Read from the session. Only with ``create=True`` and a local master is a
    scratch folder registered when none is set; on a cluster a missing name
    is an error, since executors and driver share no local folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf and create:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        conf = tempfile.mkdtemp(prefix="precis-ckpt-")
    if not conf:
        return None
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


def materialize(df):
    """Cut the lineage of ``df``: ``checkpoint()`` into the shared checkpoint
    folder (never localCheckpoint, nothing left in executor caches)."""
    checkpoint_dir(df.sparkSession, create=True)
    return df.checkpoint(eager=True)


def written(df):
    """Write ``df`` as Parquet into the checkpoint folder and read it again.

    For loops: unlike a checkpointed frame, which keeps the size that was estimated for its plan (a product over its
    joins, which grows from round to round), the table read again has its real size.
    """
    import uuid
    path = f"{checkpoint_dir(df.sparkSession, create=True)}/written-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers (once per session), wherever the driver imported it from."""
    import shutil
    sc = spark.sparkContext
    if getattr(sc, "_precis_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    where = tempfile.mkdtemp(prefix="precis-pkg-")
    sc.addPyFile(shutil.make_archive(os.path.join(where, "precis_package"), "zip", os.path.dirname(here),
                                     os.path.basename(here)))
    sc._precis_shipped = True
