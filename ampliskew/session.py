"""Session settings and rows that are read several times."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, app: str = "ampliskew", **conf) -> SparkSession:
    """A session with the settings the operators are written for.

    On a cluster leave ``master`` unset and let spark-submit decide; partition counts are
    left to AQE there, tests pass ``spark.sql.shuffle.partitions`` explicitly.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**DEFAULTS, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def keep(df: DataFrame) -> DataFrame:
    """Cuts the lineage of rows that an operator reads several times.

    With a folder named in ``spark.checkpoint.dir`` they are checkpointed there, which runs when the operator is called:
    resamples read themselves several times over, and uncut their plans would multiply. Without one they are persisted;
    no folder is ever invented.
    """
    sc = df.sparkSession.sparkContext
    named = sc.getCheckpointDir() or df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not named:
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return df.checkpoint(eager=True)
