"""What the operators of this folder share."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from billspark.session import ensure_checkpoint_dir

#: The white space of the contracts: space, tab, line feed, vertical tab, form feed, return.
BLANKS = " \t\n\x0b\f\r"
BLANK_RUN = "[ \\t\\n\\x0B\\f\\r]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Stands for a missing id wherever rows are matched by id; smaller than any other.
NO_ID = -(2**63)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case; other letters as they are."""
    return F.translate(text, UPPER, UPPER.lower())


def row_key(id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """``_id`` and ``_hash``, by which a document's rows meet again.

    Rows with the same id and text share a key, and all operators give them the
    same result; rows with one id and different texts stay apart.
    """
    return [
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_id"),
        F.xxhash64(text_or_empty(text_col)).alias("_hash"),
    ]


KEY = ["_id", "_hash"]


def remainder(id_col: str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; a missing id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors see."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder; its lineage ends there."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Whole texts that an Arrow batch holds where ``rows_at_once`` is asked for them: tasks keep several
#: copies of a batch.
TEXTS_AT_ONCE = 1000


@contextmanager
def rows_at_once(spark: SparkSession, n: int) -> Iterator[None]:
    """Arrow batches of at most ``n`` rows for jobs that run meanwhile: for tables of large rows.

    A smaller number that the session has stands.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if not 0 < int(before) <= n:
        spark.conf.set(name, str(n))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def worker_memo(key: str, make: Callable, alone: bool = False):
    """What ``make`` gives, made once in each Python worker: a worker serves many tasks.

    With ``alone`` the worker first lets go of all else that was made so: a worker lives through the
    stages of a pipeline, and what one stage remembers is of no use to the next.
    """
    memo = sys.modules.setdefault("_llm_worker_memo", types.ModuleType("_llm_worker_memo")).__dict__
    made = memo.setdefault("made", {})
    if key not in made:
        if alone:
            made.clear()
        made[key] = make()
    return made[key]
