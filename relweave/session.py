"""Session construction and lineage management.

Cluster settings (shuffle partitions, checkpoint folder, memory) come from the
deployment; this module only fills in values that are unset, which is what
happens in local tests.
"""

from __future__ import annotations

import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on for deterministic, oracle-comparable output.
_REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
# A session that names no checkpoint folder deletes its scratch files as they go out of use.
_DEFAULTS = {"spark.cleaner.referenceTracking.cleanCheckpoints": "true"}


def build_session(master: str | None = None, app: str = "relweave",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Get or create a session. ``master`` is only applied when given (tests,
    bench); on a cluster the submitter decides."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = b.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    for k, v in {**_DEFAULTS, **_REQUIRED}.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    for k, v in _REQUIRED.items():
        spark.conf.set(k, v)
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared (HDFS/object-store) folder there; without one a
    cluster job is refused. Only a local session, as in tests, gets a scratch
    folder of its own.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="relweave-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(d)
    return d


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives the loss
    of the executors that computed ``df``)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def share_package(spark: SparkSession) -> SparkSession:
    """Lets Python workers on this machine find the package wherever the session was
    started; on a cluster it is shipped with ``--py-files``."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[1]))
    return spark


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by key over the session's number of shuffle partitions. Adaptive
    execution joins small partitions by their bytes; rows that are few but take long
    each are dealt out with this before the long work."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
