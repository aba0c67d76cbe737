"""Tables in the folder that driver and executors share; they cut the lineage of iterated jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a session on this machine alone
    gets a temporary one; on a cluster that is an error, as every executor would write to a disk of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="pixelweave-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the shared folder, and the table that reads it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made and that nothing reads any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._written_to)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


SMALL_ROWS = 200_000


def small(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """``df`` written and counted; marked for broadcast if it has at most ``most`` rows, else left to a shuffled join. For
    tables that are small by contract (a rate table has at most 65,535 rows) but whose size Spark estimates from pixels."""
    t = written(df)
    return F.broadcast(t) if t.limit(most + 1).count() <= most else t
