"""SparkSession set-up and the one place that decides where lineage is cut."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Settings every session needs for right results, and the ones that make the
# physical plans adapt to size and skew at run time.
CORE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Recording the Python call site of every column costs more than the column.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def local_session(cores: int | str = "*", app: str = "spendloom", **extra: str) -> SparkSession:
    """A session for tests and the benchmark. A cluster passes its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    conf = dict(CORE_CONF)
    conf["spark.ui.enabled"] = "false"
    conf["spark.sql.shuffle.partitions"] = "8" if cores == "*" else str(cores)
    conf["spark.driver.memory"] = os.environ.get("SPENDLOOM_DRIVER_MEMORY", "8g")
    conf.update({k.replace("__", "."): v for k, v in extra.items()})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session with neither that setting nor a checkpoint folder gets
    one of its own.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
            folder = tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def no_rows(spark: SparkSession, schema: str) -> DataFrame:
    """An empty table. Its plan is known to be empty, so no task reads it and joins and unions with it go away."""
    columns = [F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schema).fields]
    return spark.range(1).filter(F.lit(False)).select(*columns)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
