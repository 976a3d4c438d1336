"""Session construction and cluster-shared locations."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

# Settings every job relies on. Time zone is fixed so hour/day extraction on
# TIMESTAMP (LTZ) columns is reproducible; fact tables are TIMESTAMP_NTZ anyway.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "larder") -> SparkSession:
    """Build (or reuse) a session. On a cluster ``master`` stays None and the
    submit configuration wins; locally tests pass ``local[N]``."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by the cluster in ``spark.checkpoint.dir``.

    The setting is read, never changed (it is static). The SparkContext
    checkpoint folder already in force wins; only when neither exists in a
    local test session do we create a folder of our own. On a cluster a
    missing setting is an error: a folder of one machine is not shared.
    """
    jsc = spark.sparkContext._jsc.sc()
    current = jsc.getCheckpointDir()
    if current.isDefined():
        return current.get()
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="larder-ckpt-")
    spark.sparkContext.setCheckpointDir(d)
    return jsc.getCheckpointDir().get()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-path of the shared checkpoint folder for intermediate tables."""
    return os.path.join(checkpoint_dir(spark), name)


_SHIPPED: set[str] = set()
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that functions
    of its modules can run there from whatever folder the driver was started in.

    Batches of rows on their way to Python hold at most some MB, as texts may be long, unless
    the application sets another size itself.
    """
    if not spark.sparkContext.getConf().contains(BATCH_BYTES):
        spark.conf.set(BATCH_BYTES, "4m")
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="larder-package-"), "larder.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent).as_posix())
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)
