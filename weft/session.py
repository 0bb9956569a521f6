"""SparkSession construction and the shared checkpoint folder."""

from __future__ import annotations

import contextlib
import os
import shutil
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every weft job relies on.  AQE re-plans joins and coalesces small
# shuffle outputs at runtime; skew-join splitting handles hot keys that slip
# past the salting done by the operators themselves.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app: str = "weft", shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Return (or create) a session with weft's defaults.

    On a cluster the master, memory and ``spark.checkpoint.dir`` come from the
    submit configuration; ``master`` is only used for local runs and tests.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if master and master.startswith("local"):
        conf.setdefault("spark.driver.memory", os.environ.get("WEFT_DRIVER_MEMORY", "16g"))
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if spark.sparkContext.master.startswith("local"):
        # workers of this machine find the package wherever the program was started
        env = spark.sparkContext.environment
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        env["PYTHONPATH"] = os.pathsep.join(dict.fromkeys([root, *filter(None, env.get("PYTHONPATH", "").split(os.pathsep))]))
    else:
        ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> str:
    """Send this package to the executors, whose Python functions import it; returns the archive.

    Not needed where weft is installed on all machines or on their PYTHONPATH."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="weft-pkg-"), "weft"), "zip", root, "weft")
    spark.sparkContext.addPyFile(archive)
    return archive


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts and written intermediate tables.

    Read from the session (``spark.checkpoint.dir``, set by the cluster).  Only a local
    run may leave it unset and gets a fresh scratch folder; elsewhere that is an error, as
    a folder of the driver's machine would not be seen by the executors.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="weft-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet below the shared folder and read back: a lineage cut that
    later branches share, and of which they read only the columns they use."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/stage/{name}-{uuid.uuid4().hex}"
    if opened := getattr(_STAGED, "paths", None):
        opened[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: The tables staged in each open :func:`staged_until` of a thread.
_STAGED = threading.local()


@contextlib.contextmanager
def staged_until(spark: SparkSession):
    """The tables that are staged inside the ``with`` block are deleted at its end.

    For steps that end with all their results written or collected: no frame that reads one of those
    tables may be evaluated later.  A block inside another deletes its own tables only."""
    opened = _STAGED.paths = getattr(_STAGED, "paths", None) or []
    opened.append([])
    try:
        yield
    finally:
        for path in opened.pop():
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
