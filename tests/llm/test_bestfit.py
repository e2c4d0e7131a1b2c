"""Best-fit packing against brute force: exact optima, whole documents, room in every sequence."""

import random
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pytest
from billspark.llm import bestfit
from billspark.llm.queries import vocabulary

WORDS = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor".split()


def fewest(sizes: list[int], capacity: int) -> int:
    """Bins of a best packing, by trying every place for every item."""
    best = len(sizes)

    def place(i: int, free: list[int]) -> None:
        nonlocal best
        if len(free) >= best:
            return
        if i == len(sizes):
            best = len(free)
            return
        for space in {f for f in free if f >= sizes[i]}:
            k = free.index(space)
            place(i + 1, [*free[:k], space - sizes[i], *free[k + 1 :]])
        place(i + 1, [*free, capacity - sizes[i]])

    sizes = sorted(sizes, reverse=True)
    place(0, [])
    return best


def test_bound_and_best_fit_enclose_the_optimum():
    draw = random.Random(5)
    tight = 0
    for _ in range(300):
        capacity = draw.choice([10, 17, 64])
        sizes = sorted((draw.randint(1, capacity) for _ in range(draw.randint(0, 9))), reverse=True)
        best = fewest(sizes, capacity)
        bound = bestfit.lower_bound(np.bincount(sizes or [0], minlength=capacity + 1) * (np.arange(capacity + 1) > 0), capacity)
        bins, offsets = bestfit.best_fit_decreasing(sizes, capacity)
        assert bound <= best <= len(set(bins))
        tight += bound == best
        inside = defaultdict(list)
        for b, o, s in zip(bins, offsets, sizes):
            inside[b].append((o, s))
        for held in inside.values():
            held.sort()
            assert held[0][0] == 0 and sum(s for _, s in held) <= capacity
            assert all(a + s == b for (a, s), (b, _) in zip(held, held[1:]))
    assert tight > 250


def test_bound_sees_more_than_the_sum():
    # three items of 0.4 a bin cannot stand together, nor any two of 0.6
    counts = np.zeros(11, int)
    counts[6] = 7
    assert bestfit.lower_bound(counts, 10) == 7
    counts[:] = 0
    counts[4] = 7
    assert bestfit.lower_bound(counts, 10) == 4


@lru_cache(maxsize=1)
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


def ids_of(text, end=1):
    return [*tokenizer().encode(text or "", add_special_tokens=False).ids, end]


def verify(rows, docs, capacity):
    """Each id of each document stands once, in pieces cut as promised, and sequences hold them gaplessly."""
    expected = []
    for doc, text in docs:
        ids = ids_of(text)
        for piece, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            packed = b"".join(i.to_bytes(4, "little") for i in part)
            expected.append((doc is None, doc or 0, piece, at, len(part), zlib.crc32(packed)))
    got = [(r.doc_id is None, r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in rows]
    assert sorted(got) == sorted(expected)
    inside = defaultdict(list)
    for r in rows:
        inside[r.sequence_id].append((r.offset, r.length))
    for held in inside.values():
        held.sort()
        assert held[0][0] == 0 and sum(n for _, n in held) <= capacity
        assert all(a + n == b for (a, n), (b, _) in zip(held, held[1:]))
    return len(inside)


def many_documents(n=900):
    draw = random.Random(3)
    return [(i, " ".join(draw.choice(WORDS) for _ in range(draw.choice([0, 1, 5, 20, 45, 70, 150])))) for i in range(n)]


@pytest.mark.parametrize("part_tokens", [2**23, 1500])
def test_rows_are_whole_and_near_the_bound(spark, part_tokens):
    docs = many_documents()
    table = spark.createDataFrame(docs, "doc_id long, text string")
    cut = bestfit.whole_pieces(table, vocabulary(), capacity=64)
    packed = bestfit.pack_best_fit(cut, capacity=64, part_tokens=part_tokens)
    rows = packed.collect()
    used = verify(rows, docs, 64)
    bound = bestfit.corpus_bound(cut, 64)
    assert bound <= used <= bound * 1.01 + 1
    if part_tokens == 2**23:
        assert used == bound and all(r.certified for r in rows)


def test_rounds_save_sequences(spark):
    cut = bestfit.whole_pieces(
        spark.createDataFrame(many_documents(), "doc_id long, text string"), vocabulary(), capacity=64
    )
    count = lambda rounds: (
        bestfit.pack_best_fit(cut, 64, part_tokens=700, rounds=rounds).select("sequence_id").distinct().count()
    )
    assert count(8) < count(1)


def test_odd_rows(spark, odd, plain):
    for together in (2**23, 8192):
        cut = bestfit.whole_pieces(odd, vocabulary())
        verify(bestfit.pack_best_fit(cut, part_tokens=together).collect(), plain, 4096)
    assert bestfit.pack_best_fit(bestfit.whole_pieces(odd.limit(0), vocabulary())).count() == 0


def test_rows_that_all_repeat_are_spread(spark):
    docs = [(7, "the same row")] * 500
    cut = bestfit.whole_pieces(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), vocabulary())
    packed = bestfit.pack_best_fit(cut, capacity=64, part_rows=50)
    assert verify(packed.collect(), docs, 64) <= 500 // 16 + 2
