"""Memory of a scoring worker, hashes of repeats, and lists of links that are worked out once."""

import numpy as np
from pyspark.sql import functions as F

from billspark.functions.scalar import once
from billspark.llm import scoring, substrings
from billspark.operators.links import redirect_target, text_link_list
from billspark.sources import messages


def test_rare_words_take_bounded_memory():
    settings = scoring.Settings()
    model = scoring.fresh_model(settings, {scoring.END: 0, b"a": 1}, np.ones(settings.classes))
    model.known = {b"a": 5, b"b": 2}
    lexicon, numbers = scoring.Lexicon(model), scoring._Numbers(model)
    for k in range(200_000):
        word = b"w%d" % k
        ending = settings.outputs + scoring._ending(word, settings.endings)
        assert lexicon[word] == -1 - ending and numbers[word] == ending
    assert max(len(lexicon), len(numbers)) <= 60_000
    assert lexicon[b"a"] == 0 and numbers[b"a"] == 1


def test_hashes_in_blocks_are_those_of_the_whole():
    data = np.random.default_rng(3).integers(97, 100, 3 * substrings._BLOCK + 17).astype(np.uint8)
    whole = substrings._block_hashes(data, 50, 1)
    assert np.array_equal(substrings.string_hashes(data, 50, 1), whole)
    assert len(substrings.string_hashes(data[:49], 50)) == 0


def test_samples_cover_every_string_of_a_document_once():
    rng = np.random.default_rng(4)
    settings = substrings.Settings()
    for n in (49, 50, 51, 700, 150_000):
        data = rng.integers(97, 99, n).astype(np.uint8)
        ends = np.append(np.sort(rng.integers(0, n + 1, 9)), n)
        key, doc, first, last = substrings.sampled(data, ends, settings)
        starts = np.concatenate(([0], ends[:-1]))
        held = [x for a, b in zip(first.tolist(), last.tolist()) for x in range(a, b + 1)]
        assert held == [x for a, b in zip(starts, ends) for x in range(a, b - 49)]
        assert (starts[doc] <= first).all() and (last + 50 <= ends[doc]).all() and len(key) == len(first)


def test_own_least_with_equal_first_hashes():
    texts = [b"x" * 60, b"y" * 50, b"x" * 50]
    array = substrings.SuffixArray([substrings._span_body([0, 1, 2], [9, 8, 7], texts)], 50)
    by_text = {0: 7, 1: 8, 2: 7}
    assert array.own_least().tolist() == [by_text[s] for s in array.span.tolist()]
    array.first = np.zeros_like(array.first)  # collisions: only the second hash tells strings apart
    assert array.own_least().tolist() == [by_text[s] for s in array.span.tolist()]


def test_a_list_is_worked_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<int>")
    def made(n):
        seen.add(1)
        return [n, n + 1]

    row = spark.range(1).select(once(made("id"), lambda x: F.concat(x, x, x)).alias("x")).first()
    assert row.x == [0, 1] * 3 and seen.value == 1


def test_links_of_a_text_and_redirects(spark):
    given = ["VER BOLETA\n<http://a.cl/1>\n<http://a.cl/2>\nsee http://b.cl/x. end", "no address", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "i int, t string")
    found = {r.i: r.x for r in rows.select("i", text_link_list(F.col("t")).alias("x")).collect()}
    assert [(x.url, x.label) for x in found[0]] == [("http://a.cl/1", "VER BOLETA"), ("http://a.cl/2", ""), ("http://b.cl/x", "")]
    assert found[1] == [] and found[2] is None
    pages = {
        "<META http-equiv=refresh content='0; url=http://m.cl/\x01b'>": "http://m.cl/\x01b",
        "<meta content='5;URL=/local' http-equiv=refresh><script>location.href='http://s.cl/'</script>": "http://s.cl/",
        "<p>": None,
        None: None,
    }
    rows = spark.createDataFrame([(p,) for p in pages], "h string")
    assert {r.h: r.t for r in rows.select("h", redirect_target(F.col("h")).alias("t")).collect()} == pages


def test_a_part_is_decoded_once(monkeypatch):
    calls = []
    decode = messages._decode
    monkeypatch.setattr(messages, "_decode", lambda *a: calls.append(a) or decode(*a))
    mail = (
        b"From: a@b.cl\r\nMIME-Version: 1.0\r\nContent-Type: multipart/alternative; boundary=b\r\n\r\n"
        b"--b\r\nContent-Type: text/plain; charset=iso-8859-1\r\n\r\nA\xf1o\r\n"
        b"--b\r\nContent-Type: text/html\r\n\r\n<p>so=\r\nft</p>\r\n--b--\r\n"
    )
    read = messages._parse(mail, None)
    assert read["parse_error"] is None and read["body"] == "A\xf1o"
    assert read["plain_text"] == "A\xf1o" and read["html"] == "<p>soft</p>"
    assert read["detect_text"] == "A\xf1o <p>so=\r\nft</p> "
    assert len(calls) == 3  # one each, and the repaired text of the softly broken one
