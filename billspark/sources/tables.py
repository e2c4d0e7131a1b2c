"""Other inputs, and the sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from billspark.functions.scalar import parse_bill_date
from billspark.operators.outputs import is_complete


def read_bill_texts(
    spark: SparkSession, path: str, fmt: str = "parquet", max_chars: int | None = None
) -> DataFrame:
    """Document text layers: ``doc_id, account_id, service_type, text``."""
    reader = spark.read
    if fmt == "json":
        reader = reader.schema(
            "doc_id string, account_id string, service_type string, text string"
        )
    df = reader.format(fmt).load(path)
    return df if max_chars is None else df.withColumn("text", F.substring("text", 1, max_chars))


def write_bills(
    bills: DataFrame, path: str, key: str = "document_key", newest: str = "emission_date"
) -> None:
    """Add the bills whose key is not stored yet, by service type and month.

    A key is stored once, whatever month a later batch gives it. Of several rows of a batch with one
    key, the one with the latest ``newest`` date is taken, ties by content, so running a
    batch again adds nothing. Of the store only the keys are read.
    """
    spark = bills.sparkSession
    month = F.coalesce(
        F.date_format(parse_bill_date(F.col("billing_period_start")), "yyyy-MM"),
        F.date_format(parse_bill_date(F.col("emission_date")), "yyyy-MM"),
        F.lit("unknown"),
    )
    row = F.struct(*bills.columns)
    order = F.struct(parse_bill_date(F.col(newest)), F.xxhash64(row))
    fresh = (
        bills.groupBy(F.col(key).alias("_key"))
        .agg(F.max_by(row, order).alias("_row"))
        .select("_row.*")
        .withColumn("bill_month", month)
    )
    if _exists(spark, path):
        fresh = fresh.join(spark.read.parquet(path).select(key), key, "left_anti")
    fresh.write.mode("append").partitionBy("service_type", "bill_month").parquet(path)


def save_state(state: DataFrame, path: str, snapshot: int) -> None:
    """One complete snapshot of the account state; rewriting it gives the same files."""
    state.write.mode("overwrite").parquet(f"{path}/snapshot={snapshot}")


def restore_state(spark: SparkSession, path: str, snapshot: int) -> DataFrame:
    """Accounts of a snapshot that hold everything their type requires."""
    return spark.read.parquet(f"{path}/snapshot={snapshot}").filter(is_complete())


def archive_ocr(responses: DataFrame, path: str, run: str) -> None:
    """Raw OCR responses (``mailbox_id, stem, json, mtime``) of one run, newest of each stem.

    A run has a folder of its own: it never touches what others stored, and writing it again
    replaces only itself.
    """
    responses.groupBy("mailbox_id", "stem").agg(
        F.max_by("json", "mtime").alias("json"), F.max("mtime").alias("mtime")
    ).write.mode("overwrite").parquet(f"{path}/run={run}")


def read_archive(spark: SparkSession, path: str, since: Column | None = None) -> DataFrame:
    """The newest response of each stem over all runs, of those not older than ``since``."""
    stored = spark.read.parquet(path)
    if since is not None:
        stored = stored.filter(F.col("mtime") >= since)
    last = stored.groupBy("mailbox_id", "stem").agg(
        F.max_by(F.struct("json", "mtime"), F.struct("mtime", F.col("run").cast("string"))).alias("last")
    )
    return last.select("mailbox_id", "stem", "last.*")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none if it is not there."""
    target, files = _file_system(spark, path)
    return [f.getPath().getName() for f in files.listStatus(target)] if files.exists(target) else []


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote."""
    target, files = _file_system(spark, path)
    files.delete(target, True)
