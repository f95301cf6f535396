"""Spark session helpers.

The library never creates a session behind the caller's back: every public
operator takes DataFrames (or a session) in and returns DataFrames.  This
module only offers a local builder for tests / the bench, and the
checkpoint-directory contract used by iterative operators.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# Settings that are correct at any scale.  Partition counts are *not* fixed
# here: on a cluster `spark.sql.shuffle.partitions` comes from the job config
# and AQE coalesces / splits partitions at runtime.
_SCALE_SAFE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "clientlens", extra: dict | None = None) -> SparkSession:
    """A local session for tests and the bench (UI off, UTC, AQE on)."""
    b = (SparkSession.builder.master(f"local[{cores}]").appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.driver.memory", os.environ.get("CLIENTLENS_DRIVER_MEM", "16g")))
    for k, v in {**_SCALE_SAFE_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def apply_scale_conf(spark: SparkSession) -> None:
    """Turn on the runtime settings the operators assume (idempotent)."""
    for k, v in _SCALE_SAFE_CONF.items():
        spark.conf.set(k, v)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint directory, wiring it into the context.

    On a cluster the directory is named by ``spark.checkpoint.dir`` (a shared
    file system path).  We read it from the session and never invent a
    machine-local one; a caller without it (tests) must set the conf first.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        raise RuntimeError(
            "spark.checkpoint.dir is not set; iterative operators need a shared "
            "checkpoint directory (set it in the job config, or in tests)")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def written(df):
    """``df`` as a Parquet table in the shared checkpoint folder, read again.

    Like a checkpoint it cuts the lineage, and unlike one it also gives the
    plan the true size: the size that Spark expects of a join is the product of
    its sides', so in a loop of joins over checkpoints it grows without bound."""
    return write_table(df)[0]


def write_table(df):
    """``df`` written as by :func:`written`, and the path for :func:`drop_table`."""
    import uuid
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop_table(spark: SparkSession, path: str) -> None:
    """Removes a table of :func:`write_table` that nothing will read again."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def spread(df, key=None):
    """``df`` dealt evenly, by ``key`` if given, to as many partitions as the
    session's shuffles have or the cluster can run at once."""
    spark = df.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, key) if key is not None else df.repartition(n)


_SHIPPED: set[int] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``clientlens`` importable by Python workers (what ``--py-files``
    does on a cluster): zip the package once and ``addPyFile`` it.  Needed by
    the operators that run pandas code in tasks when the package is not
    installed on the executors."""
    sc = spark.sparkContext
    if id(sc) in _SHIPPED:
        return
    import tempfile
    import zipfile
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="clientlens-pkg-"), "clientlens.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(out)
    _SHIPPED.add(id(sc))
