import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from billspark.llm import decontam, neardup, packing, substrings
from billspark.llm.queries import vocabulary
from tests.llm.conftest import collected, sentence

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def hits(docs, items):
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        for s in range(max(0, len(w) - 12) or bool(w)):
            windows[tuple(w[s : s + 13])].add(i)
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for window, names in windows.items():
            n = len(window)
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) == window:
                    hit.update(range(s, s + n))
                    found |= names
        out.append((i, len(w), len(hit), tuple(sorted(str(n) for n in found if n is not None))))
    return out


@pytest.mark.parametrize("max_terms", [1000, 3])
def test_phrases_match_brute_force(spark, odd, plain, max_terms):
    items = [(1, sentence(0, 40)), (2, "one two"), (3, None), (4, "!!"), (None, sentence(1, 20)), (5, sentence(2, 13)), (5, sentence(2, 13)), (6, "end")]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.phrase_hits(odd, table, max_terms=max_terms).collect()
    by_key = {(r["_id"], r["_hash"]): r for r in got}
    assert len(by_key) == len(got) == len(set(plain))
    want = set(hits(plain, items))
    mine = {
        (None if r["_id"] == -(2**63) else r["_id"], r["n_words"], r["n_hit"], tuple(r["items"] or ())) for r in got
    }
    assert mine == want
    for r in got:
        assert sum(s["end"] - s["start"] for s in r["spans"] or ()) == r["n_hit"]


def test_phrases_of_empty_tables(spark, odd):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r["n_hit"] for r in decontam.phrase_hits(odd, none).collect()} == {0}
    assert decontam.phrase_hits(odd.limit(0), none).count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a x x b"), (2, "b a"), (3, "a x x x x b")], "doc_id long, text string")
    queries = spark.createDataFrame([("q", bytearray(b"a"), bytearray(b"b"), 3)], "query string, left_term binary, right_term binary, distance int")
    got = decontam.proximity_matches(decontam.index_documents(docs), queries)
    assert sorted(r["_id"] for r in got.collect()) == [1, 2]


def test_prob_minhash_estimates_the_probability_jaccard():
    rng = np.random.default_rng(1)
    hashes = rng.integers(1, 2**63, 300).astype(np.uint64)
    a = (np.sort(hashes[:200]), rng.uniform(1, 5, 200))
    b = (np.sort(hashes[40:260]), rng.uniform(1, 5, 220))
    exact, _ = neardup.probability_jaccard(a, b)
    mine, other = neardup.prob_minhash(*a, 4096), neardup.prob_minhash(*b, 4096)
    assert (mine == other).mean() == pytest.approx(exact, abs=0.03)
    # the definition, term by term
    x, y = dict(zip(a[0].tolist(), a[1])), dict(zip(b[0].tolist(), b[1]))
    slow = sum(
        1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in x.keys() | y.keys()) for i in x.keys() & y.keys()
    )
    assert exact == pytest.approx(slow)


def classes_by_force(rows):
    hashes = neardup._WordHashes()
    sets = [neardup.weighted_shingles(neardup.words_of(t or ""), 5, hashes) for _, t in rows]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a][0]) and len(sets[b][0]) and max(neardup.probability_jaccard(sets[a], sets[b])) >= 0.8:
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        r = root(k)
        least[r] = min(least.get(r, 2**63), -(2**63) if i is None else i)
    return sorted((-(2**63) if i is None else i, least[root(k)]) for k, (i, _) in enumerate(rows))


def test_classes_match_brute_force(spark, odd, plain):
    got = collected(neardup.classes(odd))
    assert sorted((r["_id"], -(2**63) if r["class_id"] is None else r["class_id"]) for r in got) == classes_by_force(plain)
    assert len(collected(neardup.keep_one(odd))) == len({c for _, c in classes_by_force(plain)} | set()) + 0


def test_classes_of_a_family_of_edits(spark):
    rng = random.Random(5)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(60):  # each edits the base on its own: near the base, not near one another
        w = list(base)
        for _ in range(2):
            w[rng.randrange(120)] = f"e{i}x{rng.random()}"
        rows.append((i, " ".join(w)))
    rows.append((99, " ".join(base)))
    rows += [(200 + i, " ".join(f"other{i}y{k}" for k in range(60))) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["_id"], r["class_id"]) for r in collected(neardup.classes(df)))
    assert got == classes_by_force(rows)


def test_classes_of_nothing(odd):
    assert neardup.classes(odd.limit(0)).count() == 0
    assert neardup.keep_one(odd.limit(0)).count() == 0


def removed(rows, length=50):
    least = {}
    for i, t in rows:
        data = (t or "").encode()
        for p in range(len(data) - length + 1):
            key = data[p : p + length]
            least[key] = min(least.get(key, 2**63), -(2**63) if i is None else i)
    out = []
    for i, t in rows:
        data = (t or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            if least[data[p : p + length]] < (-(2**63) if i is None else i):
                gone[p : p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(data, gone) if not g)
        spans = sum(1 for p, g in enumerate(gone) if g and (p == 0 or not gone[p - 1]))
        out.append((i, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("batches", [1, 5])
def test_repeats_match_brute_force(spark, odd, plain, batches):
    settings = substrings.Settings(batches=batches, chunk=3000, part=200)
    got = collected(substrings.remove_repeats(odd, settings=settings).drop("kept"))
    assert sorted((tuple(r.values()) for r in got), key=repr) == removed(plain)


def test_repeats_across_blocks_and_of_nothing(spark, odd):
    rng = random.Random(2)
    long = "".join(rng.choice("abcdefghij") for _ in range(1_200_000))
    rows = [(1, long), (2, "x" + long[1_048_000:1_049_200] + "y"), (3, "a" * 500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in collected(substrings.remove_repeats(df).drop("kept"))}
    assert got == {1: 0, 2: 1200, 3: 0}
    assert substrings.remove_repeats(odd.limit(0)).count() == 0


def test_encoding_is_the_tokenizers(plain):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(vocabulary())
    whole.encode_special_tokens = True
    encode = packing.encoder(vocabulary(), 1)
    odd = ["It's 3½ €5 naïve ÇA café İstanbul ΑΣ <|endoftext|> \x1c\x85x y é don'T I'LL 中文 \U0001f600!"]
    for text in [*odd, *[t or "" for _, t in plain], "".join(map(chr, range(1, 700)))]:
        want = [*whole.encode(text, add_special_tokens=False).ids, 1]
        assert np.frombuffer(encode(text), "<u4").tolist() == want


def test_packing_gives_the_ids_of_an_unchanged_tokenizer(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(vocabulary())
    encode = packing.encoder(vocabulary(), 1, added_tokens=True)
    texts = [
        "a <|endoftext|> b", "a<|endoftext|>b", "<|startoftext|>It's\n\n one<|endoftext|> ", "<|ENDOFTEXT|> x",
        "<|endoftext|><|endoftext|>", "<|endof text|> <|endoftext| > |>", "no token <|here|>", "\ud800<|endoftext|>",
    ]
    for text in texts:
        sound = text.encode("utf-8", "replace").decode()
        assert np.frombuffer(encode(text), "<u4").tolist() == [*whole.encode(sound, add_special_tokens=False).ids, 1]
    df = spark.createDataFrame(list(enumerate(texts[:-1])), "doc_id long, text string")
    got = {r["doc_id"]: (r["ids_crc32"], r["doc_tokens"]) for r in collected(packing.pieces(df, vocabulary()))}
    for i, text in enumerate(texts[:-1]):
        ids = np.array([*whole.encode(text, add_special_tokens=False).ids, 1], "<u4")
        assert got[i] == (zlib.crc32(ids.tobytes()), len(ids))


def test_packing_round_trip(odd, plain):
    encode = packing.encoder(vocabulary(), 1)
    got = collected(packing.pack(packing.pieces(odd, vocabulary(), capacity=256, tail=64), capacity=256, together=32))
    ids = defaultdict(list)
    for i, t in set(plain):
        ids[i].append(np.frombuffer(encode(t or ""), "<u4"))
    pieces_of = defaultdict(list)
    windows = defaultdict(list)
    for r in got:
        pieces_of[r["doc_id"]].append(r)
        windows[r["sequence_id"]].append(r)
        assert any(
            zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] and len(x) == r["doc_tokens"]
            for x in ids[r["doc_id"]]
        )
    for i, found in pieces_of.items():
        assert sum(r["length"] for r in found) == sum(len(packing_ids) for packing_ids in ids[i]) * (2 if i == 30 else 1)
    for found in windows.values():
        at = 0
        for r in sorted(found, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 256
    assert packing.pack(packing.pieces(odd.limit(0), vocabulary())).count() == 0


def test_differencing_is_near_equal_and_raises_the_count():
    rng = random.Random(1)
    sizes = [rng.randrange(1, 513) for _ in range(600)]
    found = packing.near_equal_windows(sizes, 2048)
    sums = [sum(sizes[i] for i in w) for w in found]
    assert sorted(i for w in found for i in w) == list(range(600))
    assert max(sums) <= 2048 and len(found) <= -(-sum(sizes) // 2048) + 2 and max(sums) - min(sums) < 200
    assert len(packing.near_equal_windows([1500, 1500, 1000], 2048)) == 3
    assert packing.near_equal_windows([], 2048) == []
