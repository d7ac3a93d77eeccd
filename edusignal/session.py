"""Session construction and cluster-safe settings."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession

# Settings every job relies on: UTC wall clock (the reference stores zone-less
# DATETIME), ANSI arithmetic with explicit try_* guards, AQE for runtime
# re-planning (coalesce small partitions, split skewed join partitions, and
# turn a shuffle join into a broadcast only when the *measured* side is under
# the threshold).
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
    "spark.sql.autoBroadcastJoinThreshold": "32MB",
    "spark.sql.optimizer.windowGroupLimitThreshold": "1000",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(app: str = "edusignal", master: str | None = None,
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Local/test session builder.  On a cluster, pass ``master=None`` and let
    spark-submit supply master and resources."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in BASE_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


HUGE_METHOD = "spark.sql.codegen.hugeMethodLimit"


@contextmanager
def compiled_methods(spark: SparkSession):
    """The JVM compiles no method of more than 8000 bytes: a projection as wide as the wide row's (52 KB in one method)
    is interpreted for ever.  Jobs planned in this block run such stages operator by operator, whose expressions
    Spark splits into small methods; the rows are the same.  The setting is put back afterwards."""
    before = spark.conf.get(HUGE_METHOD)
    spark.conf.set(HUGE_METHOD, str(min(int(before), 8000)))
    try:
        yield
    finally:
        spark.conf.set(HUGE_METHOD, before)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once an application (as ``--py-files`` does),
    so that Python workers can import it wherever the driver found it."""
    sc, package = spark.sparkContext, Path(__file__).resolve().parent
    if sc.applicationId in _SHIPPED or not package.is_dir():
        return
    _SHIPPED.add(sc.applicationId)
    path = Path(tempfile.mkdtemp(prefix="edusignal-code-")) / "edusignal-package.zip"  # Spark's file server hands it out
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(path))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The setting names shared storage and is respected as is; without it a
    cluster is refused.  Only a one-process ``local[...]`` master, whose driver is its
    executor, gets a scratch folder of its own where the setting is missing.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder (HDFS/object store) on a cluster")
        d = tempfile.mkdtemp(prefix="edusignal-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", d)
    if not spark.sparkContext.getCheckpointDir():  # Spark sets it itself from the setting
        spark.sparkContext.setCheckpointDir(d)
    return d
