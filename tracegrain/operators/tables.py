"""Tables in the folder that all executors share: they cut lineage, so a lost executor costs one step."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where none is set and all of Spark runs in this one process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir isn't set: on a cluster tables are written to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tracegrain-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def cut(df: DataFrame, codec: str | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back: any executor can be lost afterwards.

    The table goes when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tracegrain-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._table = where
    return out


def discard(table: DataFrame) -> None:
    """Deletes a table that cut() wrote; only once everything made from it is written too."""
    table._table.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(table._table, True)
