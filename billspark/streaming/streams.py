"""The same operators over streams of messages.

State that must survive lives in Spark's state store or in tables written per
batch; a batch that is run again rewrites its own folder, so results stay exact
when executors or the driver are lost.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from billspark.operators.detect import detect_services, new_services
from billspark.operators.ocr_layout import drift_alerts, drift_report
from billspark.operators.outputs import cycle_summary, problem_status
from billspark.sources.messages import eml_files, parse_messages
from billspark.sources.tables import _exists as exists
from billspark.sources.tables import names_in, remove

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def message_stream(spark: SparkSession, path: str, max_files: int = 10_000) -> DataFrame:
    """Messages of new ``<mailbox>/<sequence>.eml`` files as they arrive."""
    files = (
        spark.readStream.format("binaryFile")
        .schema(FILE_SCHEMA)
        .option("pathGlobFilter", "*.eml")
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", max_files)
        .load(path)
    )
    return parse_messages(eml_files(files))


def without_duplicates(
    messages: DataFrame, time: str = "received_ts", delay: str = "1 day"
) -> DataFrame:
    """First arrival of each message id per mailbox, remembered for ``delay``."""
    return messages.withWatermark(time, delay).dropDuplicatesWithinWatermark(
        ["mailbox_id", "message_id"]
    )


# ------------------------------------------------------------------ latest bills
def latest_state(
    bills: DataFrame, fields: Sequence[str], carried: Sequence[str] = ()
) -> DataFrame:
    """Newest bill per account; a ``carried`` field keeps its last known value.

    Both are maxima by ``msg_seq``, so a late older bill changes nothing, partial
    results combine before the shuffle, and the same code serves batch and stream.
    """
    seq = F.col("msg_seq")
    newest = [F.max_by(f, seq).alias(f) for f in fields if f not in carried]
    known = [F.max_by(f, F.when(F.col(f).isNotNull(), seq)).alias(f) for f in carried]
    return bills.groupBy("account_id").agg(F.max("msg_seq").alias("msg_seq"), *newest, *known)


def write_batches(path: str) -> Callable[[DataFrame, int], None]:
    """Sink that keeps every batch in a folder of its own."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def keep_latest(path: str, key: str = "account_id") -> Callable[[DataFrame, int], None]:
    """Sink that keeps one compacted state: each batch writes the last row of every key.

    A batch reads the state before it, never older batches, so its work grows with the number of
    keys and not with the history. Run again, it writes the same state again. Only the new state
    and the one before it are kept; a state counts once its folder is complete.
    """

    def keep(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = _state_before(spark, path, batch_id)
        values = [c for c in batch.columns if c != key]
        rows = batch.select(key, F.lit(1).alias("_turn"), F.struct(*values).alias("v"))
        if before is not None:
            rows = rows.unionByName(before.select(key, F.lit(0).alias("_turn"), F.struct(*values).alias("v")))
        last = rows.groupBy(key).agg(F.max_by("v", "_turn").alias("v"))
        last.select(key, "v.*").write.mode("overwrite").parquet(f"{path}/state={batch_id}")
        # a batch that is run again needs the state before it, and nothing older
        older = [n for n in complete_states(spark, path) if n < batch_id]
        for number in older[:-1]:
            remove(spark, f"{path}/state={number}")

    return keep


def complete_states(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the states in a folder, ascending, from the names of its folders alone."""
    states = [name for name in names_in(spark, path) if name.startswith("state=")]
    done = [n for n in states if exists(spark, f"{path}/{n}/_SUCCESS")]
    return sorted(int(name.removeprefix("state=")) for name in done)


def _state_before(spark: SparkSession, path: str, batch_id: int | None) -> DataFrame | None:
    """The newest state in a folder, or the newest before a batch."""
    states = [n for n in complete_states(spark, path) if batch_id is None or n < batch_id]
    return spark.read.parquet(f"{path}/state={states[-1]}") if states else None


def read_latest(spark: SparkSession, path: str, key: str = "account_id") -> DataFrame:
    """The last row written per key: the newest state of ``keep_latest``.

    Batches kept one by one with ``write_batches`` are read whole.
    """
    state = _state_before(spark, path, None)
    if state is not None:
        return state
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in (key, "batch_id")]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*values), "batch_id").alias("v"))
    return last.select(key, "v.*")


def start(
    frame: DataFrame,
    sink: Callable[[DataFrame, int], None],
    checkpoint: str,
    mode: str = "append",
    every: str | None = None,
) -> StreamingQuery:
    """Run a stream into a batch sink: every ``every``, or once over what is there."""
    writer = frame.writeStream.outputMode(mode).foreachBatch(sink).option(
        "checkpointLocation", checkpoint
    )
    return (
        writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    ).start()


# ----------------------------------------------------------------------- overdue
def overdue_transitions(
    state: DataFrame, accounts: DataFrame, last: DataFrame, now: Column
) -> DataFrame:
    """Accounts whose problem flag differs from the one last reported.

    A bill becomes overdue by the passing of time alone, without any message, so
    the rule is evaluated over the state table at each trigger; ``last`` holds
    ``account_id, problem`` as written by the triggers before.
    """
    current = problem_status(state, accounts, now).select("account_id", "problem")
    before = last.select("account_id", F.col("problem").alias("before"))
    return (
        current.join(before, "account_id", "left")
        .filter(~F.col("problem").eqNullSafe(F.col("before")))
        .drop("before")
    )


def report_overdue(
    accounts: DataFrame, state_path: str, path: str, now: Column
) -> Callable[[DataFrame, int], None]:
    """Sink for a clock stream: stores the changes of the problem flags per trigger."""

    def report(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        state = read_latest(spark, state_path)
        last = _state_before(spark, f"{path}/flags", batch_id)
        if last is None:
            last = spark.createDataFrame([], "account_id bigint, problem boolean")
        changes = overdue_transitions(state, accounts, last, now)
        changes.write.mode("overwrite").parquet(f"{path}/changes/batch_id={batch_id}")
        keep_latest(f"{path}/flags")(changes.select("account_id", "problem"), batch_id)

    return report


# -------------------------------------------------------- discovery, drift, events
def offer_services(accounts: DataFrame, path: str) -> Callable[[DataFrame, int], None]:
    """Sink that detects services in a batch and stores those never offered before.

    A batch that is run again first looks past its own earlier output.
    """

    def offer(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        offered = None
        if exists(spark, path):
            offered = spark.read.parquet(path).filter(F.col("batch_id") != batch_id)
        fresh = new_services(detect_services(batch), accounts, offered)
        fresh.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return offer


def alert_drift(accounts: DataFrame, path: str) -> Callable[[DataFrame, int], None]:
    """Sink that stores drift reports of mailboxes whose fingerprint changed.

    A mailbox without reports is not alerted; its last fingerprint is dropped by
    a row with a NULL fingerprint, so the same drift alerts again when it returns.
    """

    def alert(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        report = drift_report(batch, accounts)
        seen = batch.join(accounts.select("account_id", "mailbox_id"), "account_id")
        quiet = seen.select("mailbox_id").distinct().join(
            report.select("mailbox_id"), "mailbox_id", "left_anti"
        )
        fresh = report
        last = _state_before(spark, f"{path}/fingerprints", batch_id)
        if last is not None:
            fresh = drift_alerts(report, last.filter(F.col("fingerprint").isNotNull()))
        cleared = quiet.select(
            "mailbox_id",
            *[F.lit(None).cast(f.dataType).alias(f.name) for f in report.schema if f.name != "mailbox_id"],
        )
        fresh.unionByName(cleared).write.mode("overwrite").parquet(f"{path}/alerts/batch_id={batch_id}")
        prints = report.select("mailbox_id", "fingerprint").distinct().unionByName(
            cleared.select("mailbox_id", "fingerprint")
        )
        keep_latest(f"{path}/fingerprints", "mailbox_id")(prints, batch_id)

    return alert


def cycle_events(accounts: DataFrame, state: DataFrame) -> DataFrame:
    """Timeline entry of a finished cycle: ``event, services, without_match``."""
    return cycle_summary(accounts, state).select(F.lit("cycle completed").alias("event"), "*")


def log_cycles(
    accounts: DataFrame, cycle: Callable[[DataFrame], DataFrame], path: str
) -> Callable[[DataFrame, int], None]:
    """Sink that runs ``cycle`` on each batch (messages to account state) and keeps a timeline.

    An entry says that a cycle started with so many messages, and one that it was completed, with
    the number of services and of those without a match, or that it failed, and why. A
    failure is entered and raised: the stream ends, and when it is started again the same batch is read
    again. Its entry stays beside that of the later success.
    """

    def log(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession

        def enter(entry: DataFrame, step: str) -> None:
            entry.withColumn("ts", F.current_timestamp()).write.mode("overwrite").parquet(
                f"{path}/batch_id={batch_id}/step={step}"
            )

        none = F.lit(None)
        started = batch.agg(F.count(F.lit(1)).alias("messages")).select(
            F.lit("cycle started").alias("event"), "messages",
            none.cast("bigint").alias("services"), none.cast("bigint").alias("without_match"),
            none.cast("string").alias("fault"),
        )
        enter(started, "started")
        try:
            done = cycle_events(accounts, cycle(batch)).select(
                "event", none.cast("bigint").alias("messages"), "services", "without_match",
                none.cast("string").alias("fault"),
            )
            enter(done, "done")
        except Exception as fault:  # entered in the timeline, then left to the stream
            failed = spark.range(1).select(
                F.lit("cycle failed").alias("event"), none.cast("bigint").alias("messages"),
                none.cast("bigint").alias("services"), none.cast("bigint").alias("without_match"),
                F.lit(type(fault).__name__).alias("fault"),
            )
            enter(failed, "failed")
            raise

    return log
