"""Session settings the operators rely on.

The driver (or a cluster launcher) owns the SparkSession; we only set
runtime SQL options on it.  Nothing here creates a session except
``local_session`` which is for tests and the benchmark.
"""

from __future__ import annotations

import os
import re
import tempfile
import zipfile

from pyspark.sql import SparkSession

# Runtime options every relq job expects.
RUNTIME_CONF = {
    # Python's json keeps the last of duplicate keys; so does the variant parser with this on.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Adaptive execution: coalesce small shuffle partitions, split skewed join partitions,
    # and turn a join into a broadcast join only when the runtime size of a side is small.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}
SPLITS = "spark.sql.files.minPartitionNum"
# Not set: time zone (no timestamps here) and Arrow for toPandas (pandas UDFs use Arrow anyway);
# both would change how the caller's own session converts results.


def ship_package(spark: SparkSession) -> None:
    """Make ``relq`` importable in Python workers (pandas UDFs, mapInArrow) on every executor."""
    sc = spark.sparkContext
    if getattr(sc, "_relq_shipped", False):  # on the context itself: an id() can be reused after a stop
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    fd, path = tempfile.mkstemp(prefix="relq-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _dirs, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(path)
    sc._relq_shipped = True


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime options and ship the package; safe to call repeatedly."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)  # an option that cannot be set is an error: answers would change
    if not spark.conf.get(SPLITS, None):
        # how files are cut must not follow the number of executors: a line index holds for one cut
        spark.conf.set(SPLITS, str(max(1, spark.sparkContext.defaultParallelism)))
    ship_package(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    Only a local master without one (tests, single machine) gets a scratch folder; on a cluster
    the executors would write to their own disks, so a missing setting is an error there.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="relq-ckpt-")
        spark.sparkContext.setCheckpointDir(d)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "relq") -> SparkSession:
    """A local session for tests and the benchmark (UI off, no server opened)."""
    mem = os.environ.get("RELQ_DRIVER_MEMORY", "16g")
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", mem)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    checkpoint_dir(spark)
    return spark
