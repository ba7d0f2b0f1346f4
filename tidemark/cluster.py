"""Session settings, shared scratch space and size-checked joins."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROW_LIMIT = 100_000
JOIN_SALTS = 64
# Scratch folder of local sessions that name none; paths in it are never reused.
LOCAL_SCRATCH = os.path.join(tempfile.gettempdir(), "tidemark-scratch")


def build_session(app: str = "tidemark", master: str | None = None, realtime: bool = False,
                  conf: dict[str, str] | None = None) -> SparkSession:
    """Session with the settings the operators expect.

    AQE is on for the analytics and off for real-time queries, which do not support it.
    Memory, executor counts and shuffle partitions belong to ``spark-submit``; pass
    ``conf`` to override.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "false" if realtime else "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        **(conf or {}),
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local-mode session without the setting gets one: ``LOCAL_SCRATCH``, on this machine.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if current is None:
        if named is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            named = LOCAL_SCRATCH
        context.setCheckpointDir(named)
    return named or current


def scratch_path(spark: SparkSession, name: str) -> str:
    """New path for a written intermediate table; never reused."""
    return f"{shared_folder(spark).rstrip('/')}/tidemark/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage of a small result with a reliable checkpoint."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stable(df: DataFrame, name: str = "stable") -> DataFrame:
    """Return ``df`` itself, or a written copy if its plan is non-deterministic.

    Operators that read their input more than once would otherwise see different
    wall-clock stamps on each pass.
    """
    if df._jdf.queryExecution().analyzed().deterministic():
        return df
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def join_small(big: DataFrame, small: DataFrame, keys: Sequence[str], condition=None,
               max_rows: int = BROADCAST_ROW_LIMIT, salts: int = JOIN_SALTS,
               rows: int | None = None) -> DataFrame:
    """Inner join of a large side with a side that is expected to be small.

    ``small`` must be cheap to read twice (see ``settle``). Its size is checked first:
    up to ``max_rows`` it is broadcast, beyond that both sides are shuffled with a salt,
    so that a key holding much of ``big`` is spread over ``salts`` tasks. The salt is the
    partition number, which a retried task keeps.
    """
    keys = list(keys)
    if rows is None:
        rows = small.limit(max_rows + 1).count()
    if rows <= max_rows:
        right, left, on = F.broadcast(small), big, keys
    else:
        left = big.withColumn("__salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        right = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        on = keys + ["__salt"]
    joined = left.join(right, on, "inner")
    if condition is not None:
        joined = joined.filter(condition)
    return joined.drop("__salt")
