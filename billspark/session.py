"""Session settings and lineage cuts."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.icu.caseMappings.enabled": "false",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def local_session(
    cores: int | str = 8, shuffle_partitions: int = 8, shared_folder: str | None = None
) -> SparkSession:
    """Session for tests and benches; a cluster brings its own.

    ``shared_folder`` is where checkpoints, stream state and tables go; a new temporary one by
    default, which on one machine everything sees.
    """
    folder = shared_folder or tempfile.mkdtemp(prefix="billspark-")
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("billspark")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.checkpoint.dir", f"{folder}/checkpoints")
        .config("spark.sql.warehouse.dir", f"{folder}/warehouse")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Longest method, in bytes of bytecode, that the JVM compiles; a longer one is interpreted for ever.
COMPILED_METHOD_BYTES = 8000
_METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"
_SPARK_METHOD_LIMIT = "65535"


def keep_methods_compiled(spark: SparkSession) -> None:
    """Let Spark leave whole-stage code that the JVM would not compile.

    The projections that read a bill are wide; fused into one method they pass the limit and run
    interpreted. Left apart, their code is split. A limit that the session's owner set stands.
    """
    if spark.conf.get(_METHOD_LIMIT, _SPARK_METHOD_LIMIT) == _SPARK_METHOD_LIMIT:
        spark.conf.set(_METHOD_LIMIT, str(COMPILED_METHOD_BYTES))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Where the setting is missing, a temporary folder serves a session on one machine; on a
    cluster that would lose what executors write, so it is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="billspark-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and read it back."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()
