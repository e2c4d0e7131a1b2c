"""What Python workers keep from one task to the next."""

import sys
import tracemalloc

from billspark.llm import neardup, packing
from billspark.llm.common import rows_at_once, worker_memo
from billspark.llm.queries import vocabulary


def kept_mb(work) -> float:
    """MB that are still held when ``work`` has ended."""
    tracemalloc.start()
    try:
        held = work()
        found = tracemalloc.get_traced_memory()[0] / 1e6
        del held
    finally:
        tracemalloc.stop()
    return found


def test_a_stage_drops_what_the_one_before_it_remembered(monkeypatch):
    monkeypatch.delitem(sys.modules, "_llm_worker_memo", raising=False)
    hashes = worker_memo("hashes", dict, alone=True)
    hashes["word"] = 1
    assert worker_memo("hashes", dict, alone=True) is hashes
    first = worker_memo("first", dict)
    assert worker_memo("second", dict) is not first
    assert worker_memo("hashes", dict, alone=True) is hashes
    ids = worker_memo("ids", dict, alone=True)
    assert worker_memo("ids", dict, alone=True) is ids
    assert worker_memo("hashes", dict, alone=True) == {}


def test_word_memory_is_bounded():
    hashes = neardup._WordHashes()
    for k in range(250_000):
        assert hashes[b"w%d" % k] is not None
    assert len(hashes) <= 100_000


def test_encoder_remembers_a_bounded_number_of_chunks(monkeypatch):
    """Within one text too, and a part of a chunk is not remembered twice."""
    monkeypatch.setattr(packing, "REMEMBERED", 1000)
    encode = packing.encoder(vocabulary(), 1)
    text = " ".join(f"({chr(97 + k % 26) * (1 + k % 7)}{k}x" for k in range(30_000))

    def work():
        encode(text)

    assert kept_mb(work) < 2
    whole = packing.encoder(vocabulary(), 1)
    monkeypatch.setattr(packing, "REMEMBERED", 10**9)
    assert encode(text) == whole(text)


def test_parts_are_remembered_as_chunks():
    """Ids do not depend on what was read before."""
    odd = ["it's", "''s", "'", "('", "a'b", "'ll", "x9y", "99", "ÀÉ", "é'd", "naïve-ßtraße", "×÷", "Ω1", "__", "a_b"]
    text = " ".join(odd)
    forward, backward = packing.encoder(vocabulary(), 1), packing.encoder(vocabulary(), 1)
    apart = {x: forward(x) for x in odd}
    assert {x: backward(x) for x in reversed(odd)} == apart
    assert forward(text) == backward(text) == b"".join(apart[x][:-4] for x in odd) + apart["x9y"][-4:]


def test_batches_are_never_made_larger(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        for owner, inside in (("10000", "1000"), ("50", "50"), ("0", "1000")):
            spark.conf.set(name, owner)
            with rows_at_once(spark, 1000):
                assert spark.conf.get(name) == inside
            assert spark.conf.get(name) == owner
    finally:
        spark.conf.set(name, before)
