"""Files that arrive in several batches, and states that survive being written again."""

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from billspark.streaming.streams import (
    complete_states,
    keep_latest,
    latest_state,
    log_cycles,
    message_stream,
    read_latest,
    start,
    without_duplicates,
    write_batches,
)


def test_message_files_in_batches(spark, tmp_path):
    inbox = tmp_path / "inbox"
    for box in ("m1", "m2"):
        (inbox / box).mkdir(parents=True)
        for k in range(4):
            # the third is delivered again as the fourth
            text = f"Message-ID: <{min(k, 2)}@{box}>\nDate: Mon, 0{k + 1} Jun 2026 10:00:00 +0000\n\nBoleta {k}"
            (inbox / box / f"{k}.eml").write_text(text)
    messages = without_duplicates(message_stream(spark, str(inbox), max_files=3), delay="10 days")
    start(messages, write_batches(str(tmp_path / "rows")), str(tmp_path / "checkpoint")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "rows"))
    assert rows.select("batch_id").distinct().count() > 1
    assert sorted((r.mailbox_id, r.message_id) for r in rows.collect()) == [
        (box, f"<{k}@{box}>") for box in ("m1", "m2") for k in range(3)
    ]


def test_compacted_state(spark, tmp_path):
    path = str(tmp_path / "state")

    def batch(*rows):
        df = spark.createDataFrame([(a, m, v) for a, m, v in rows], "account_id long, msg_seq long, v string")
        return latest_state(df, ["v"])

    sink = keep_latest(path)
    sink(batch((1, 1, "a"), (2, 1, "b")), 0)
    sink(batch((1, 2, "c")), 1)
    sink(batch((1, 2, "c")), 1)  # run again
    assert sorted((r.account_id, r.v) for r in read_latest(spark, path).collect()) == [(1, "c"), (2, "b")]
    assert spark.read.parquet(f"{path}/state=1").count() == 2


def test_states_do_not_pile_up(spark, tmp_path):
    path = str(tmp_path / "state")
    sink = keep_latest(path)
    for k in range(8):
        sink(spark.createDataFrame([(k % 3, k)], "account_id long, v long"), k)
        assert complete_states(spark, path) == [n for n in (k - 1, k) if n >= 0]
    assert sorted((r.account_id, r.v) for r in read_latest(spark, path).collect()) == [(0, 6), (1, 7), (2, 5)]
    (tmp_path / "state" / "state=8").mkdir()  # a state that was never finished
    assert complete_states(spark, path) == [6, 7]
    sink(spark.createDataFrame([(0, 100)], "account_id long, v long"), 7)  # the last batch again
    assert sorted((r.account_id, r.v) for r in read_latest(spark, path).collect()) == [(0, 100), (1, 4), (2, 5)]


def test_failed_cycles_are_read_again(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(3):
        spark.createDataFrame([(k, k)], "account_id long, day long").coalesce(1).write.mode("append").parquet(source)
    accounts = spark.createDataFrame([(k,) for k in range(3)], "account_id long")
    seen: list[list[int]] = []

    def cycle(messages):
        seen.append(sorted(r.account_id for r in messages.collect()))
        if len(seen) == 2:
            raise ValueError("no connection")
        return messages.select("account_id", F.lit(None).cast("timestamp").alias("last_updated"))

    def run():
        stream = spark.readStream.schema("account_id long, day long").option("maxFilesPerTrigger", 1).parquet(source)
        start(stream, log_cycles(accounts, cycle, out), str(tmp_path / "checkpoint")).awaitTermination()

    with pytest.raises(StreamingQueryException):
        run()
    run()
    assert len(seen) == 4 and seen[1] == seen[2] and sorted(sum(seen[1:], [])) == sorted(seen[1] * 2 + seen[3])
    events = [r.event for r in spark.read.parquet(out).collect()]
    assert (events.count("cycle completed"), events.count("cycle failed"), events.count("cycle started")) == (3, 1, 3)
