"""Session helpers: one place for session defaults and for the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "tidemark", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution on. On a cluster leave ``master`` unset (spark-submit decides)."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # A search generation compiles about 80 pieces of code; the default cache of 100 would forget them in between.
        .config("spark.sql.codegen.cache.maxEntries", "2000")
        # Recording the call site of every Column costs more than most plans here.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master).config("spark.driver.memory", os.environ.get("TIDEMARK_DRIVER_MEMORY", "8g"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local mode, where all tasks share a disk."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the result survives the loss of any executor and the plan starts afresh."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_plain(df: DataFrame) -> DataFrame:
    """As ``cut``, planned once and run as one job: for loops over small aggregates, where adaptive execution would plan what is left
    anew after each exchange, all of it on the driver."""
    conf, name = df.sparkSession.conf, "spark.sql.adaptive.enabled"
    before = conf.get(name, None)
    try:
        conf.set(name, "false")
        return cut(df)
    finally:
        conf.unset(name) if before is None else conf.set(name, before)


def cut_by(df: DataFrame, key: str) -> DataFrame:
    """As ``cut``, dealt by ``key``: later joins and groupings by it leave the rows where they are.

    Only for the plan made here adaptive execution is off, as it forgets how its result is dealt, and a join inside ``df`` whose keys
    include ``key`` takes inputs that are dealt by it alone.
    """
    conf = df.sparkSession.conf
    parts = int(conf.get("spark.sql.shuffle.partitions"))
    names = ("spark.sql.adaptive.enabled", "spark.sql.requireAllClusterKeysForCoPartition")
    before = {name: conf.get(name, None) for name in names}
    try:
        for name in names:
            conf.set(name, "false")
        return cut(df.repartition(parts, key))
    finally:
        for name, value in before.items():
            conf.unset(name) if value is None else conf.set(name, value)


@contextmanager
def few_listing_tasks(spark: SparkSession) -> Iterator[None]:
    """Inside, a table of many folders is listed by a few tasks a core; by default each folder gets a task of its own, and starting
    tasks takes longer than listing."""
    conf, name = spark.conf, "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = conf.get(name, None)
    try:
        conf.set(name, str(4 * spark.sparkContext.defaultParallelism))
        yield
    finally:
        conf.unset(name) if before is None else conf.set(name, before)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder for a table that one job writes and another reads."""
    return f"{shared_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
