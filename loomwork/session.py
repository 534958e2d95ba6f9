"""Session factory with the settings that the operators rely on."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(
    cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g", **settings: str
) -> SparkSession:
    """A local session: UTC, adaptive execution, few shuffle partitions. On a cluster the launcher's settings hold."""
    conf = {
        "spark.master": f"local[{cpus}]", "spark.driver.memory": memory, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC", "spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.sql.adaptive.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    spark = SparkSession.builder.appName("loomwork").config(map=conf | settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession, folder: str | None = None) -> str:
    """The folder that driver and executors share: the given one, or that of spark.checkpoint.dir.

    Where there is none, a local session gets one of its own; on a cluster that is an error, since executors on other
    hosts could not read it.
    """
    found = folder or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="loomwork-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, folder: str | None = None) -> DataFrame:
    """df as Parquet in the shared folder, read back: cuts the lineage and survives lost executors."""
    path = f"{shared_folder(df.sparkSession, folder)}/t-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of written() that nothing reads any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.written_at)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
