"""Alignment of two vocabularies against whole texts read at once and counts in plain dictionaries."""

import hashlib
import random
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest
from billspark.llm import alignment
from billspark.llm.queries import vocabulary
from tests.llm.conftest import collected

A, B = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")


@lru_cache(maxsize=1)
def vocabularies():
    import sentencepiece
    from tokenizers import Tokenizer

    ours = Tokenizer.from_file(A)
    ours.encode_special_tokens = True
    return ours, sentencepiece.SentencePieceProcessor(model_file=B)


def token_bytes(text):
    """Ids and bytes of all tokens of A and B, from the whole text at once."""
    ours, theirs = vocabularies()
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    a = ours.encode(" " + text, add_special_tokens=False).ids
    b = theirs.encode(text)
    a_bytes = [bytes(byte_of[c] for c in ours.id_to_token(i)) for i in a]
    b_bytes = [
        bytes([int(theirs.id_to_piece(i)[3:5], 16)]) if theirs.is_byte(i)
        else theirs.id_to_piece(i).replace("▁", " ").encode()
        for i in b
    ]
    return a, a_bytes, b, b_bytes


def grouped(text):
    """``[(ids of A, ids of B), ...]`` by the offsets where both end."""
    if not text:
        return []
    a, a_bytes, b, b_bytes = token_bytes(text)
    whole = (" " + text).encode()
    if b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
        return []
    a_ends, b_ends = np.cumsum([len(x) for x in a_bytes]), np.cumsum([len(x) for x in b_bytes])
    out, i, j = [], 0, 0
    for end in sorted(set(a_ends.tolist()) & set(b_ends.tolist())):
        k, m = np.searchsorted(a_ends, end, "right"), np.searchsorted(b_ends, end, "right")
        out.append((a[i:k], b[j:m]))
        i, j = k, m
    return out


def by_force(docs):
    texts = [grouped(t) for _, t in docs]
    links = [[(x, y) for g in groups for x in g[0] for y in g[1]] for groups in texts]
    counts = Counter(p for found in links for p in set(found))
    best: dict = {}
    for (x, _), n in counts.items():
        best[x] = max(best.get(x, 0), n)
    rows = []
    for (doc, _), groups, found in zip(docs, texts, links):
        spelled = ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in groups)
        rows.append(
            (
                doc, sum(len(g) for g, _ in groups), sum(len(h) for _, h in groups), len(groups), len(found),
                sum(counts[p] == best[p[0]] for p in found), sum(counts[p] for p in found),
                hashlib.sha256(spelled.encode()).hexdigest() if groups else "",
            )
        )
    return sorted(rows, key=str)


def strange_texts(n=300):
    draw = random.Random(11)
    letters = "ab é\n\n  \t\x1c\x85▁'sX1<|endoftext|>.,!?):;²_-日本\x00́\r"
    words = "the quick brown fox jumps over it's naïve co-operation résumé 12,345.6 e.g. (see) ".split()
    return ["".join(draw.choice(letters) for _ in range(draw.randint(1, 14))) for _ in range(n)] + [
        " ".join(draw.choice(words) for _ in range(draw.randint(1, 60))) for _ in range(n // 4)
    ]


def result(df):
    names = ["doc_id", *alignment.RESULT_NAMES]
    return sorted([tuple(r[n] for n in names) for r in collected(df)], key=str)


def test_chunks_give_what_the_whole_text_gives():
    known = alignment.Vocabularies(A, B)
    assert known.cuttable
    for text in strange_texts():
        chunks = known.chunks(text)
        assert "".join(chunks) == " " + text
        found = known.tokens(chunks)
        a, a_bytes, b, b_bytes = token_bytes(text)
        whole = (" " + text).encode()
        if None in found:
            assert b"".join(a_bytes) != whole or b"".join(b_bytes) != whole
        else:
            assert np.frombuffer(b"".join(f[0] for f in found), known.packed).tolist() == a
            assert np.frombuffer(b"".join(f[1] for f in found), known.packed).tolist() == b


def test_slices_are_cut_where_both_end():
    known = alignment.Vocabularies(A, B)
    text = " ".join(t for t in strange_texts(400) if grouped(t)) + " " + "x" * 400
    a, _, b, _ = token_bytes(text)
    a, b = np.array(a), np.array(b)
    whole = alignment.Aligned(known, [(a, b)])
    for most in (1, 7, 100):
        slices = list(alignment.stretches_of(known, a, b, most))
        assert len(slices) > 1
        assert np.concatenate([x for x, _ in slices]).tolist() == a.tolist()
        assert np.concatenate([y for _, y in slices]).tolist() == b.tolist()
        cut = alignment.Aligned(known, slices)
        assert ";".join(cut.texts()) == whole.texts()[0]
        assert (cut.codes() == whole.codes()).all()


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100, 8300])
def test_hash_is_perfect_and_minimal(n):
    codes = np.unique(np.random.default_rng(n).integers(0, 50257 * 32000, n))
    turns, shifts = alignment.perfect_hash(codes)
    assert sorted(alignment.places(codes, turns, shifts, len(codes))) == list(range(len(codes)))


def test_repeated_codes_are_refused():
    with pytest.raises(ValueError):
        alignment.perfect_hash(np.array([5, 5, 6]))


def test_strangers_are_not_counted():
    codes = np.arange(0, 3000, 3)
    turns, shifts = alignment.perfect_hash(codes)
    keys = np.zeros(len(codes), np.int64)
    keys[alignment.places(codes, turns, shifts, len(codes))] = codes
    rows = [(0, keys.tobytes(), turns.tobytes(), shifts.tobytes(), (keys + 1).tobytes())]
    table = alignment.PairTable(1, rows)
    asked = np.arange(3000)
    assert (table.look_up(asked) == np.where(asked % 3 == 0, asked + 1, 0)).all()


def test_recent_chunks_stay_remembered():
    calls = []
    memory = alignment.Remembered(lambda chunks: calls.extend(chunks) or [c.upper() for c in chunks], size=3)
    for k in range(20):
        assert memory.of({"often", f"rare{k}"}) == {"often": "OFTEN", f"rare{k}": f"RARE{k}".upper()}
    assert calls.count("often") == 1 and len(memory.lately) <= 4


@pytest.mark.parametrize("limits", [{}, {"max_pairs": 300, "segment": 50}])
def test_documents_match_brute_force(spark, limits, monkeypatch):
    if limits:  # long texts come in slices
        monkeypatch.setattr(alignment._together, "__defaults__", (40,))
    docs = list(enumerate(strange_texts(120)))
    docs += [(900, None), (901, ""), (None, "no id"), (902, "twice"), (902, "twice"), (903, "word " * 5000)]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(40)
    assert result(alignment.align_documents(table, A, B, **limits)) == by_force(docs)


def test_odd_rows(spark, odd, plain):
    assert result(alignment.align_documents(odd, A, B)) == by_force(plain)
    assert alignment.align_documents(odd.limit(0), A, B).count() == 0
