"""Intermediate tables: written once in the folder that the driver and all executors share.

Later reads do not depend on the executors that computed a table, and its lineage ends there.
"""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: The scratch folders that are open, of each thread by itself.
_OPEN = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.

    Where it is unset, one is made and set on a single machine (tests); on a cluster a folder of
    the driver's is out of the executors' sight, and the missing setting is an error."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="matricula-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str = "") -> str:
    """A new path for a table; within `scratch` it goes with that scratch."""
    own = getattr(_OPEN, "folders", None)
    folder = own[-1] if own else f"{shared_dir(spark)}/matricula"
    return f"{folder}/{name}{uuid.uuid4().hex}"


def materialize(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write `df` once as Parquet, at `path` or a new one, and return it as read back."""
    path = path or new_path(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are written inside are deleted at the end: results that are still wanted must
    have been written elsewhere (`materialize(df, path)`) by then."""
    folder = new_path(spark, "scratch-")
    if not hasattr(_OPEN, "folders"):
        _OPEN.folders = []
    _OPEN.folders.append(folder)
    try:
        yield
    finally:
        _OPEN.folders.remove(folder)
        target = spark._jvm.org.apache.hadoop.fs.Path(folder)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
