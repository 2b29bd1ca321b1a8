"""Fresh paths in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path below spark.checkpoint.dir that is deleted when the driver ends; a local one only where Spark is one process."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir")
    if folder is None and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    parent = f"{(folder or tempfile.gettempdir()).rstrip('/')}/glimmer-{uuid.uuid4().hex}"
    jvm, conf = sc._jvm, sc._jsc.hadoopConfiguration()

    def remove() -> None:
        try:
            place = jvm.org.apache.hadoop.fs.Path(parent)
            place.getFileSystem(conf).delete(place, True)
        except Exception:  # noqa: BLE001  the JVM may be gone by now
            pass

    atexit.register(remove)
    return f"{parent}/{name}"
