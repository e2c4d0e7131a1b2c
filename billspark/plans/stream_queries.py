"""Queries that run a stream over a base table until it is used up."""

from __future__ import annotations

import uuid
from contextlib import suppress

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from billspark import rules
from billspark.plans import render as R
from billspark.plans.registry import query, table
from billspark.session import ensure_checkpoint_dir
from billspark.sources.messages import parse_messages
from billspark.sources.tables import (
    archive_ocr,
    read_archive,
    read_bill_texts,
    restore_state,
    save_state,
    write_bills,
)
from billspark.streaming.streams import (
    alert_drift,
    keep_latest,
    latest_state,
    log_cycles,
    offer_services,
    read_latest,
    report_overdue,
    start,
    without_duplicates,
    write_batches,
)


def _folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    )


def _finish(frame: DataFrame, sink, folder: str, mode: str) -> None:
    start(frame, sink, f"{folder}/checkpoint", mode).awaitTermination()


@query(
    "stream_latest",
    """SELECT user_id AS account_id, max(event_id) AS msg_seq, arg_max(event_type, event_id) AS event_type,
      arg_max(value, event_id) FILTER (event_type = 'purchase') AS purchase, arg_max(value, event_id) FILTER (event_type = 'view') AS view
      FROM events GROUP BY 1""",
)
def stream_latest(spark: SparkSession, folder: str) -> DataFrame:
    """Latest event per account, each kind's last value carried forward."""
    out = _folder(spark, "latest")
    kind = F.col("event_type")
    bills = _stream(spark, folder, "events").select(
        F.col("user_id").alias("account_id"),
        F.col("event_id").alias("msg_seq"),
        "event_type",
        F.when(kind == "purchase", F.col("value")).alias("purchase"),
        F.when(kind == "view", F.col("value")).alias("view"),
    )
    state = latest_state(bills, ["event_type", "purchase", "view"], ["purchase", "view"])
    _finish(state, keep_latest(f"{out}/rows"), out, "update")
    return read_latest(spark, f"{out}/rows")


@query(
    "stream_deduplicated",
    "SELECT CAST(user_id % 10 AS VARCHAR) AS mailbox_id, count(DISTINCT event_id // 3) AS messages FROM events GROUP BY 1",
)
def stream_deduplicated(spark: SparkSession, folder: str) -> DataFrame:
    """Messages that arrive up to three times are kept once per mailbox."""
    out = _folder(spark, "distinct")
    messages = _stream(spark, folder, "events").select(
        (F.col("user_id") % 10).cast("string").alias("mailbox_id"),
        F.floor(F.col("event_id") / 3).cast("string").alias("message_id"),
        F.col("ts").cast("timestamp").alias("received_ts"),
    )
    _finish(without_duplicates(messages, delay="40 days"), write_batches(f"{out}/rows"), out, "append")
    rows = spark.read.parquet(f"{out}/rows")
    return rows.groupBy("mailbox_id").agg(F.count(F.lit(1)).alias("messages"))


@query(
    "stream_overdue",
    """WITH s AS (SELECT user_id AS account_id, max(ts) AS ts FROM events GROUP BY 1)
      SELECT account_id, ts + to_months(CAST(1 + account_id % 2 AS INTEGER)) < TIMESTAMP '2024-03-15 00:00:00' AS problem FROM s""",
)
def stream_overdue(spark: SparkSession, folder: str) -> DataFrame:
    """Problem flags from a stream's state, then the accounts that time alone made overdue."""
    out = _folder(spark, "overdue")
    bills = _stream(spark, folder, "events").select(
        F.col("user_id").alias("account_id"),
        F.col("event_id").alias("msg_seq"),
        F.col("ts").cast("timestamp").alias("last_updated"),
    )
    _finish(latest_state(bills, ["last_updated"]), keep_latest(f"{out}/state"), out, "update")
    accounts = read_latest(spark, f"{out}/state").select(
        "account_id", F.lit("gas").alias("service_type"),
        (1 + F.col("account_id") % 2).cast("int").alias("billing_interval_months"),
    )
    for batch, moment in enumerate(("2024-02-10 00:00:00", "2024-03-15 00:00:00")):
        report = report_overdue(
            accounts, f"{out}/state", f"{out}/flags", F.lit(moment).cast("timestamp")
        )
        report(accounts, batch)
    return read_latest(spark, f"{out}/flags/flags").select("account_id", "problem")


@query(
    "stream_discovery",
    """WITH m AS (SELECT DISTINCT CAST(o_custkey % 10 AS VARCHAR) AS mailbox_id, o_orderkey % 8 AS kind FROM orders)
      SELECT DISTINCT mailbox_id, ['water','electricity','gas','hot_water','common_expenses','patagonia','constructora_del_sur'][kind + 1] AS service_id
      FROM m WHERE kind < 7 AND kind <> 0 UNION SELECT DISTINCT mailbox_id, 'common_expenses' FROM m WHERE kind = 3""",
)
def stream_discovery(spark: SparkSession, folder: str) -> DataFrame:
    """Services offered from a stream of messages; water is configured everywhere."""
    out = _folder(spark, "offers")
    orders = _stream(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", F.floor("o_totalprice").alias("total")
    )
    accounts = table(spark, folder, "customer").select(
        (F.col("c_custkey") % 10).cast("string").alias("mailbox_id"), F.lit("agua").alias("service_id")
    ).distinct()
    _finish(R.provider_mail(orders), offer_services(accounts, f"{out}/rows"), out, "append")
    return spark.read.parquet(f"{out}/rows").select("mailbox_id", "service_id")


@query(
    "stream_events",
    "SELECT event_type AS event, count(*) AS rows FROM events GROUP BY 1",
)
def stream_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events counted over a stream, batch by batch."""
    out = _folder(spark, "events")
    events = _stream(spark, folder, "events").select(F.col("event_type").alias("event"))
    _finish(events, write_batches(f"{out}/rows"), out, "append")
    return spark.read.parquet(f"{out}/rows").groupBy("event").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "stream_messages",
    """SELECT CAST(o_custkey % 10 AS VARCHAR) AS mailbox_id, count(DISTINCT o_orderkey // 2) AS messages,
      max(o_orderkey // 2 * 2)::BIGINT AS newest FROM orders GROUP BY 1""",
)
def stream_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Raw messages parsed from a stream, each delivered up to twice, kept once."""
    out = _folder(spark, "messages")
    pair = (F.floor(R.key() / 2) * 2).cast("bigint")
    content = R.joined([
        "From: a@b.cl\r\nMessage-ID: <", pair.cast("string"), "@mail>\r\nDate: Mon, 02 Feb 2026 10:00:00 +0000\r\n\r\nBoleta ", pair.cast("string"),
    ])
    files = _stream(spark, folder, "orders").select(
        (F.col("o_custkey") % 10).cast("string").alias("mailbox_id"), pair.alias("msg_seq"),
        F.encode(content, "utf-8").alias("content"),
    )
    _finish(without_duplicates(parse_messages(files)), write_batches(f"{out}/rows"), out, "append")
    rows = spark.read.parquet(f"{out}/rows")
    return rows.groupBy("mailbox_id").agg(
        F.count(F.lit(1)).alias("messages"), F.max("msg_seq").alias("newest")
    )


@query(
    "stream_drift",
    """WITH a AS (SELECT CAST(mod(o_orderkey, 10) AS VARCHAR) AS mailbox_id, count(*) AS accounts FROM orders GROUP BY 1)
      SELECT mailbox_id, 0 AS batch_id, accounts AS reports, false AS cleared FROM a
      UNION ALL SELECT mailbox_id, 2, 1, true FROM a WHERE mailbox_id = '1'
      UNION ALL SELECT mailbox_id, 3, accounts, false FROM a WHERE mailbox_id = '1'""",
)
def stream_drift(spark: SparkSession, folder: str) -> DataFrame:
    """Alerts over four batches: new drift, the same again, cleared in one mailbox, and back."""
    out = _folder(spark, "drift")
    accounts = R.orders(spark, folder).select(
        R.key().alias("account_id"), (R.key() % 10).cast("string").alias("mailbox_id"),
        F.lit(rules.COMMON_EXPENSES).alias("service_type"), F.lit("Gastos").alias("service_name"),
    )
    none = F.array().cast("array<string>")

    def batch(significant: Column) -> DataFrame:
        return accounts.select(
            "account_id", significant.alias("is_significant"), F.lit(50.0).alias("anchor_coverage_pct"),
            none.alias("missing_anchor_keys"), none.alias("value_gap_keys"), none.alias("unexpected_lines"),
            none.alias("excerpt"),
        )

    sink = alert_drift(accounts, out)
    for number, significant in enumerate(
        (F.lit(True), F.lit(True), F.col("mailbox_id") != "1", F.lit(True))
    ):
        sink(batch(significant), number)
    alerts = spark.read.parquet(f"{out}/alerts")
    cleared = F.col("fingerprint").isNull()
    return alerts.groupBy("mailbox_id", F.col("batch_id").cast("int").alias("batch_id"), cleared.alias("cleared")).agg(
        F.count(F.lit(1)).alias("reports")
    )


@query(
    "stream_timeline",
    """WITH n AS (SELECT count(*) AS m FROM orders), s AS (SELECT count(*) AS c FROM customer)
      SELECT 'cycle started' AS event, m AS messages, NULL::BIGINT AS services, NULL::BIGINT AS without_match, NULL::VARCHAR AS fault FROM n
      UNION ALL SELECT 'cycle completed', NULL, c, c - (SELECT count(DISTINCT o_custkey) FROM orders), NULL FROM s
      UNION ALL SELECT 'cycle started', 0, NULL, NULL, NULL UNION ALL SELECT 'cycle failed', NULL, NULL, NULL, 'ValueError'""",
)
def stream_timeline(spark: SparkSession, folder: str) -> DataFrame:
    """A cycle that succeeds over a stream of messages, then one that fails."""
    out = _folder(spark, "timeline")
    accounts = table(spark, folder, "customer").select(F.col("c_custkey").alias("account_id"))

    def cycle(messages: DataFrame) -> DataFrame:
        return messages.groupBy("account_id").agg(F.max("day").cast("timestamp").alias("last_updated"))

    def broken(messages: DataFrame) -> DataFrame:
        raise ValueError("no connection")

    messages = _stream(spark, folder, "orders").select(
        F.col("o_custkey").alias("account_id"), F.to_date("o_orderdate").alias("day")
    )
    _finish(messages, log_cycles(accounts, cycle, f"{out}/rows"), out, "append")
    nothing = R.orders(spark, folder).limit(0)
    with suppress(ValueError):  # entered, and raised so that the stream reads the batch again
        log_cycles(accounts, broken, f"{out}/rows")(nothing, 1)
    return spark.read.parquet(f"{out}/rows").select("event", "messages", "services", "without_match", "fault")


# ------------------------------------------------------------------------- sinks
@query(
    "stored_bills",
    """SELECT 'gas' AS service_type, strftime(CAST(o_orderdate AS DATE), '%Y-%m') AS bill_month, count(*) AS bills,
      sum(CAST(floor(o_totalprice) AS BIGINT))::BIGINT AS total_amount FROM orders GROUP BY 2""",
)
def stored_bills(spark: SparkSession, folder: str) -> DataFrame:
    """Bills stored by month; keys that come again under another month are stored once."""
    out = _folder(spark, "bills")
    bills = R.orders(spark, folder).select(
        R.text("gas_", R.key().cast("string"), ".pdf").alias("document_key"),
        F.lit("gas").alias("service_type"),
        R.dmy(F.col("day")).alias("emission_date"),
        F.lit(None).cast("string").alias("billing_period_start"),
        F.col("total").alias("total_amount"),
    )
    write_bills(bills, out)
    # the same keys under another month
    later = F.date_format(F.add_months(F.col("day"), 1), "dd-MM-yyyy")
    again = R.orders(spark, folder).select(
        R.text("gas_", R.key().cast("string"), ".pdf").alias("document_key"),
        F.lit("gas").alias("service_type"),
        later.alias("emission_date"),
        F.lit(None).cast("string").alias("billing_period_start"),
        (F.col("total") + 1).alias("total_amount"),
    )
    write_bills(again, out)
    stored = read_bill_texts(spark, out)
    return stored.groupBy("service_type", F.col("bill_month").cast("string").alias("bill_month")).agg(
        F.count(F.lit(1)).alias("bills"), F.sum("total_amount").alias("total_amount")
    )


@query(
    "archived_responses",
    """SELECT CAST(o_custkey % 10 AS VARCHAR) AS mailbox_id, count(*) AS stems, sum(CASE WHEN o_custkey % 10 = 1 THEN 2 ELSE 1 END)::BIGINT AS versions
      FROM orders GROUP BY 1""",
)
def archived_responses(spark: SparkSession, folder: str) -> DataFrame:
    """Two runs into one archive, the second with one mailbox only: newest of each stem."""
    out = _folder(spark, "archive")

    def run(version: int) -> DataFrame:
        return R.orders(spark, folder).select(
            (F.col("o_custkey") % 10).cast("string").alias("mailbox_id"),
            R.key().cast("string").alias("stem"),
            F.lit(f'{{"version":{version}}}').alias("json"),
            F.date_add("day", version).cast("timestamp").alias("mtime"),
        )

    archive_ocr(run(1), out, "first")
    archive_ocr(run(2).filter(F.col("mailbox_id") == "1"), out, "second")
    version = F.get_json_object("json", "$.version").cast("bigint")
    return read_archive(spark, out).groupBy("mailbox_id").agg(
        F.count(F.lit(1)).alias("stems"), F.sum(version).alias("versions")
    )


@query(
    "restored_state",
    "SELECT o_orderkey AS account_id, CAST(floor(o_totalprice) AS BIGINT) AS total_amount FROM orders WHERE o_orderkey % 3 <> 0",
)
def restored_state(spark: SparkSession, folder: str) -> DataFrame:
    """A state snapshot read back: accounts without a required reading stay out."""
    from billspark.operators.confidence import with_fields
    from billspark.schema import ATTRS

    out = _folder(spark, "state")
    state = R.orders(spark, folder).select(
        R.key().alias("account_id"),
        F.lit("gas").alias("service_type"),
        F.col("day").cast("timestamp").alias("last_updated"),
        F.col("total").alias("total_amount"),
        F.lit(1.5).alias("consumption"),
        F.when(R.key() % 3 != 0, F.lit(2.5)).alias("cost_per_m3s"),
    )
    save_state(with_fields(state, ATTRS), out, 1)
    return restore_state(spark, out, 1).select("account_id", "total_amount")
