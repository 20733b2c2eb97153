"""Written intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
from uuid import uuid4

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder on whatever file system it lies."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """What lies in a folder; none if there is no such folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []


def publish(spark: SparkSession, path: str, target: str) -> bool:
    """Rename a written folder to ``target`` unless that exists: of several who try, one gets True. The rename is
    the file system's own, in which a look and the rename are one."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    source, to = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(target)
    to.getFileSystem(conf).mkdirs(to.getParent())
    none = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.getFileSystem(conf).getUri(), conf).rename(source, to, none)
    except Py4JJavaError as e:
        if "AlreadyExists" not in str(e.java_exception):
            raise
        return False
    return True


def _at_exit(path: str) -> None:
    jvm = SparkContext._jvm
    if jvm is not None:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(p, True)


def scratch(spark: SparkSession) -> str:
    """A new path under ``spark.checkpoint.dir``, deleted when the driver ends.
    Only a session on a single machine may leave that unset; it gets a temporary folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if app not in _own:
        if not shared:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            shared = f"file://{tempfile.mkdtemp(prefix='moraine-')}"
        _own[app] = f"{shared.rstrip('/')}/tables-{app}"
        atexit.register(_at_exit, _own[app])
    return f"{_own[app]}/{uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` written and read back: its plan runs once, and lost executors don't matter."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
