"""Intermediate tables in the folder that driver and executors share.

The folder is the one named by ``spark.checkpoint.dir``; only where that is
unset (tests, one machine) is a temporary folder made.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder, also set as checkpoint folder if none is set."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not named:
        app = sc.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="tessera-")
            atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
        named = _own[app]
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(named)
    return named


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage, so that what follows neither recomputes ``df`` nor is
    lost with an executor. Unlike checkpoint() the copy is compressed and columns
    can be pruned from it.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}"
    df.write.parquet(f"{folder}/{label}")
    _written[folder] = spark
    return spark.read.schema(df.schema).parquet(f"{folder}/{label}")


def release(folders: list[str] | None = None) -> int:
    """Remove the named tables, or all that ``materialize`` has written; for when their results have been written or collected. Returns how many.

    Runs by itself when the program ends.
    """
    n = 0
    for folder in list(_written) if folders is None else folders:
        spark = _written.pop(folder)
        try:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            n += path.getFileSystem(spark._jvm.org.apache.hadoop.conf.Configuration()).delete(path, True)
        except Exception:  # the session's Java side has gone; nothing can be done from here
            continue
    return n


atexit.register(release)


def checkpointed(df: DataFrame) -> DataFrame:
    """An eager reliable checkpoint in the shared folder; it stays there, unless spark.cleaner.referenceTracking.cleanCheckpoints is set."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
