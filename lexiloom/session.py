"""Sessions and the code that travels with them."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once an application.

    Functions given to mapInArrow and the like are pickled by reference, so workers must be able to import the
    package even where it isn't installed. Spark's file server hands out the archive.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="lexiloom-code-"), "lexiloom.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(top)))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names; a temporary one only where it is unset and all runs in this process.

    On a cluster without the setting there is no folder that all machines see, so that raises.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if sc.getCheckpointDir() is None:
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = named or tempfile.mkdtemp(prefix="lexiloom-")
        sc.setCheckpointDir(named)
    return named


def kept(df: DataFrame, label: str) -> DataFrame:
    """The frame written as compressed Parquet in the shared folder and read back, where a checkpoint would be stored plain. The folder goes when the session ends.

    Then the driver's garbage is collected, so that Spark's cleaner drops the shuffles that led there.
    """
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    path = f"{checkpoint_folder(spark).rstrip('/')}/lexiloom/{label}-{uuid.uuid4().hex}"
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    df.write.option("compression", "zstd").parquet(path)
    jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)
