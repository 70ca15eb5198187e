"""Session and table helpers shared by every operator."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("citaria")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.python.filterPushdown.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def is_local(master: str) -> bool:
    """Whether the workers run in the driver's machine and process tree (not so a local-cluster)."""
    return re.fullmatch(r"local(\[.*\])?", master) is not None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_checkpoints(spark: SparkSession) -> None:
    """Point checkpoint() at the folder the cluster names in spark.checkpoint.dir.

    Only where neither the setting nor a folder exists (tests, local runs) is a
    temporary folder taken, and only for a local master, and deleted at the end: a
    cluster without a shared folder is an error, not a reason to write to one machine's disk.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not is_local(sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="citaria-checkpoints-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    sc.setCheckpointDir(named)


def shared_folder(spark: SparkSession, what: str) -> str:
    """The path of a new folder in the one that all executors share."""
    shared_checkpoints(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/citaria-{what}-{uuid.uuid4().hex}"


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers of a cluster this package, once a session.

    The driver serves it as a zip; workers that run inside the driver's machine and
    process tree (a plain local master) import it from its place.
    """
    sc = spark.sparkContext
    if getattr(sc, "_citaria_shipped", False) or is_local(sc.master):
        return
    root = Path(__file__).resolve().parent
    made = shutil.make_archive(f"{sc._temp_dir}/citaria-{os.getpid()}", "zip", root.parent, root.name)
    sc.addPyFile(made)
    sc._citaria_shipped = True


#: Bytes of a table up to which it may be spread over the cores by a shuffle.
SPREAD_BYTES = 256 << 20


def scanned(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table for work that costs much a row: a small one of fewer splits than cores is spread over them.

    Size and splits are known from the scan's metadata; a large table is never shuffled for this.
    """
    df = table(spark, sf_dir, name)
    plan, cores = df._jdf.queryExecution(), spark.sparkContext.defaultParallelism
    if int(str(plan.optimizedPlan().stats().sizeInBytes())) > SPREAD_BYTES:
        return df
    return df.repartition(cores) if plan.toRdd().getNumPartitions() < cores else df
