"""Few sequences for whole documents: best-fit packing, certified by lower bounds and repacked in rounds.

Every part of the pieces is packed by best-fit decreasing. Dual feasible functions give a number of
sequences that the part needs at least; a part that reaches it is certified. Parts with a gap give up
their sequences that have free space, certified ones their emptiest (rounding the bound up can hide
one), and what is given up is dealt out anew and packed again. Rounds go on for as long as they save
sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billspark.llm.common import worker_memo, written
from billspark.llm.packing import encoder

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32"]
#: ``deal`` spreads pieces over parts: a number that even repeated rows do not share.
CUT = f"{PIECE}, deal long"
PLACED = f"{CUT}, part long, bin int, offset long, bins int, bound int, open boolean"


# ------------------------------------------------------------------------- one part
def lower_bound(counts: np.ndarray, capacity: int, enough: int | None = None) -> int:
    """Bins of ``capacity`` that ``counts[s]`` items of each size ``s`` need at least.

    The largest of what three families of dual feasible functions prove: sizes near the capacity
    rounded up and small ones to nothing, sizes rounded to fractions of the bin, and large sizes
    against the small ones that fit beside them. A bound that reaches ``enough``, the number
    of bins used, is not looked at further.
    """
    sizes = np.flatnonzero(counts)
    if not len(sizes):
        return 0
    n = counts[sizes].astype(np.int64)
    half = capacity // 2

    # all thresholds e at once, from running sums over the sizes
    many = np.zeros(capacity + 2, np.int64)
    many[sizes + 1] = n
    weight = np.zeros(capacity + 2, np.int64)
    weight[sizes + 1] = n * sizes
    many, weight = np.cumsum(many), np.cumsum(weight)  # of sizes below the index
    e = np.arange(half + 1)
    large = many[-1] - many[capacity - e + 1]
    between = weight[capacity - e + 1] - weight[e]
    best = int((-(-(capacity * large + between) // capacity)).max())

    if enough is not None and best >= enough:
        return best
    for k in range(1, 65):
        scaled = (k + 1) * sizes
        value = np.where(scaled % capacity == 0, k * sizes, scaled // capacity * capacity)
        best = max(best, -(-int((n * value).sum()) // (capacity * k)))

    if enough is not None and best >= enough:
        return best
    big = sizes > half
    for step in range(1, half + 1):
        whole = capacity // step
        value = int((n[big] * (whole - (capacity - sizes[big]) // step)).sum())
        value += int(n[~big & (sizes >= step)].sum())
        best = max(best, -(-value // whole))
    return best


def best_fit_decreasing(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """The bin and the offset of each item of ``sizes``, which descend.

    An item goes to the fullest bin that has room for it. Bins are kept by their free space,
    and the spaces that occur are bits of one number, so the best bin is its lowest
    bit from the item's size on.
    """
    by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
    spaces = 0
    bins: list[int] = []
    offsets: list[int] = []
    used = 0
    for size in sizes:
        fitting = spaces >> size
        if fitting:
            space = size + (fitting & -fitting).bit_length() - 1
            here = by_space[space].pop()
            if not by_space[space]:
                spaces ^= 1 << space
        else:
            space, here = capacity, used
            used += 1
        left = space - size
        if left:
            by_space[left].append(here)
            spaces |= 1 << left
        bins.append(here)
        offsets.append(capacity - space)
    return bins, offsets


def _packed_part(capacity: int, alone: bool):
    """A function from the pieces of one part to their places; ``alone`` if there is no other part."""

    def pack_part(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by(
            [("length", "descending"), *[(c, "ascending") for c in ("doc_id", "start", "ids_crc32", "deal")]]
        )
        sizes = table.column("length").to_numpy()
        bins, offsets = best_fit_decreasing(sizes.tolist(), capacity)
        bins = np.array(bins, np.int32)
        fill = np.bincount(bins, weights=sizes).astype(np.int64)
        used = len(fill)
        bound = lower_bound(np.bincount(sizes, minlength=capacity + 1), capacity, used)
        if used > bound:
            opened = fill < capacity
        else:
            opened = np.zeros(used, bool)
            if not alone:
                opened[fill.argmin()] = fill.min() < capacity
        n = len(sizes)
        columns = [table.column(c).combine_chunks() for c in [*COLUMNS, "deal", "part"]]
        columns += [
            pa.array(bins), pa.array(offsets, pa.int64()),
            pa.array(np.full(n, used, np.int32)), pa.array(np.full(n, bound, np.int32)),
            pa.array(opened[bins]),
        ]
        return pa.Table.from_arrays(
            columns, [*COLUMNS, "deal", "part", "bin", "offset", "bins", "bound", "open"]
        )

    return pack_part


# --------------------------------------------------------------------------- pieces
def whole_pieces(
    docs: DataFrame,
    vocabulary: str,
    capacity: int = 4096,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Tokenise documents; only those of more than ``capacity`` ids are cut, into windows of it.

    Returns ``doc_id, piece, start, length, ids_crc32, deal``. A NULL or empty text is the end id
    alone; repeated rows give repeated pieces; a missing id stays missing. Texts of any length are
    encoded whole, one at a time.
    """

    def cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = worker_memo(f"ids of {vocabulary} {end_id} added", lambda: encoder(vocabulary, end_id, True), alone=True)
        seen = 0
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py() or "")
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    seen += 1
                    rows.append((doc, piece, at // 4, len(part) // 4, zlib.crc32(part), seen))
            types = [pa.int64(), pa.int32(), *[pa.int64()] * 4]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*rows), types)], [*COLUMNS, "deal"]
                )

    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    ).mapInArrow(cut_batches, CUT)


# --------------------------------------------------------------------------- rounds
def _bins(condition: Column) -> Column:
    """Number of bins whose pieces fulfil the condition: each has one piece at offset 0."""
    return F.coalesce(F.sum((condition & (F.col("offset") == 0)).cast("long")), F.lit(0))


def pack_best_fit(
    cut_pieces: DataFrame,
    capacity: int = 4096,
    part_tokens: int = 2**23,
    part_rows: int = 2**17,
    rounds: int = 8,
) -> DataFrame:
    """Give each piece a sequence of at most ``capacity`` tokens and its offset there.

    Returns the columns of ``whole_pieces`` without ``deal``, then ``sequence_id, offset`` and
    ``certified``: whether the part that the sequence was packed in uses as few as its bound proves.

    Pieces of full length are sequences of their own. The others are dealt out to parts of about
    ``part_tokens`` tokens and at most about ``part_rows`` pieces by a number that no two share, so
    neither a document, a source nor a text that many rows repeat weighs on one task. Each round
    packs what the one before it gave up, in fewer parts, and is taken only if it needs fewer
    sequences; the last round's places stay otherwise. Every round is a written table: a lost
    executor repeats its own parts and gets the same places. What reaches the driver are counts of
    pieces and bins. An empty table gives an empty table.
    """
    pieces = written(cut_pieces.select(*COLUMNS, "deal"), "pieces")
    short = pieces.filter(F.col("length") < capacity)
    todo = short.withColumn("deal", F.xxhash64("deal", "ids_crc32", "doc_id"))
    settled: list[tuple[int, DataFrame]] = []
    given_up: tuple[int, DataFrame, int] | None = None  # round, its pieces, its bins

    for round_ in range(rounds):
        size = todo.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
        if not size[0]:
            break
        parts = max(-(-size[1] // part_tokens), -(-size[0] // part_rows))
        dealt = todo.withColumn("part", F.pmod(F.xxhash64("deal", F.lit(round_)), F.lit(parts).cast("long")))
        packed = written(
            dealt.groupBy("part").applyInArrow(_packed_part(capacity, parts == 1), PLACED), f"packed-{round_}"
        )
        all_bins, open_bins = packed.agg(_bins(F.lit(True)), _bins(F.col("open"))).first()
        if given_up is not None and all_bins >= given_up[2]:
            break  # the earlier places are as good
        given_up = (round_, packed.filter("open"), open_bins)
        settled.append((round_, packed.filter("not open")))
        if parts == 1:
            # nothing to exchange with: another deal of one part would pack the same pieces alike
            break
        todo = given_up[1].select(*COLUMNS, "deal")
    if given_up is not None:
        settled.append((given_up[0], given_up[1]))

    number = F.shiftleft(F.col("part"), 24) + F.col("bin")
    placed = [
        table.select(
            *COLUMNS,
            (F.lit(round_ << 56).cast("long") + number).alias("sequence_id"),
            "offset",
            (F.col("bins") == F.col("bound")).alias("certified"),
        )
        for round_, table in settled
    ]
    full = pieces.filter(F.col("length") == capacity).select(
        *COLUMNS,
        (-1 - F.monotonically_increasing_id()).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
        F.lit(True).alias("certified"),
    )
    return reduce(DataFrame.unionByName, placed, full)


def corpus_bound(cut_pieces: DataFrame, capacity: int = 4096) -> int:
    """Sequences that all pieces need at least; at most ``capacity`` counts reach the driver."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in cut_pieces.groupBy("length").count().collect():
        counts[length] = n
    return lower_bound(counts, capacity)
