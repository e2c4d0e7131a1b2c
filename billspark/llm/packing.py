"""Packing tokenised documents into fixed windows by Karmarkar-Karp differencing."""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billspark.llm.common import TEXTS_AT_ONCE, rows_at_once, worker_memo, written

#: Distinct chunks and parts of chunks whose ids a Python worker remembers at most; the memory is
#: then emptied.
REMEMBERED = 250_000

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
)
PLACED = f"{PIECES}, bin int, offset long"


#: Chunks of these characters can be cut without the tokenizer: normalisation leaves them as they
#: are, but for case, and their classes are known.
_PLAIN = re.compile("[\x21-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
#: The tokenizer's own cut, written for those characters.
_CUT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^a-z0-9\xdf-\xf6\xf8-\xff]+")


def encoder(path: str, end_id: int, added_tokens: bool = False) -> Callable[[str], bytes]:
    """A function from a text to its ids and ``end_id``, as little-endian 32-bit integers.

    With ``added_tokens`` the tokenizer's own added tokens are one id each where a text spells them,
    as in a tokenizer as it is loaded; else they are letters like others.

    The tokenizer never joins anything across white space, so texts are read chunk by chunk
    between ASCII blanks, and each chunk is encoded once and remembered. Chunks of
    plain letters are cut here and only their merges asked for; all others go
    through the whole tokenizer.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = not added_tokens
    tokenizer.no_padding()
    tokenizer.no_truncation()
    merges = tokenizer.model.tokenize
    spelled = [_byte_letter(b) for b in range(256)]
    packed = [i.to_bytes(4, "little") for i in range(tokenizer.get_vocab_size())]
    end = int(end_id).to_bytes(4, "little")

    def word(text: str) -> bytes:
        letters = text if text.isascii() else text.encode().decode("latin-1").translate(spelled)
        return b"".join([packed[t.id] for t in merges(letters)])

    class Known(dict):
        def __missing__(self, chunk: bytes) -> bytes:
            if len(self) >= REMEMBERED:
                self.clear()
            text = chunk.decode("utf-8", "replace")
            if chunk.isalpha():
                coded = word(text)
            elif _PLAIN.fullmatch(text):
                parts = _CUT.findall(text.lower())
                # a part is cut into itself, so it is remembered as the chunk that it could be
                coded = word(parts[0]) if len(parts) == 1 else b"".join([self[p.encode()] for p in parts])
            else:
                coded = b"".join(
                    [packed[i] for i in tokenizer.encode(text, add_special_tokens=False).ids]
                )
            self[chunk] = coded
            return coded

    known = Known()
    added = [t.content.lower() for t in tokenizer.get_added_tokens_decoder().values()]

    def encode(text: str) -> bytes:
        # an added token splits a chunk, so a text that may hold one is read by the tokenizer itself
        if added_tokens and any(t in text.lower() for t in added):
            text = text.encode("utf-8", "replace").decode()
            ids = tokenizer.encode(text, add_special_tokens=False).ids
            return b"".join([packed[i] for i in ids]) + end
        chunks = text.encode("utf-8", "replace").lower().split()
        return b"".join([known[x] for x in chunks]) + end

    return encode


def _byte_letter(byte: int) -> str:
    """The letter that byte-level vocabularies write for a byte: printable ones stand for themselves."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    if byte in printable:
        return chr(byte)
    return chr(0x100 + sum(b not in printable for b in range(byte)))


def pieces(
    docs: DataFrame,
    vocabulary: str,
    capacity: int = 2048,
    tail: int = 512,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Tokenise documents and cut them: windows of ``capacity``, then tails of at most ``tail``.

    Returns ``doc_id, start, length, ids_crc32, doc_tokens``. A NULL or empty text is the end id
    alone. Texts of any length are encoded whole, one document at a time.
    """

    def cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = worker_memo(f"ids of {vocabulary} {end_id} added", lambda: encoder(vocabulary, end_id, True), alone=True)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py() or "")
                n = len(ids) // 4
                at = 0
                while at < n:
                    left = n - at
                    size = capacity if left >= capacity else min(tail, left)
                    crc = zlib.crc32(ids[4 * at : 4 * (at + size)])
                    rows.append((doc, at, size, crc, n))
                    at += size
            if rows:
                columns = [pa.array(x, pa.int64()) for x in zip(*rows)]
                yield pa.RecordBatch.from_arrays(
                    columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                )

    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    ).mapInArrow(cut_batches, PIECES)


def differencing(sizes: list[int], windows: int) -> list[list[int]]:
    """Split item numbers over ``windows`` with near-equal sums, by multiway differencing.

    Each item starts as a partial partition with one filled window. The two partitions with
    the largest spread are merged, the fullest windows of one onto the emptiest
    of the other, until one partition is left. Only filled windows are
    stored; a partition with fewer than ``windows`` of them has empty ones.
    """
    if not sizes:
        return [[] for _ in range(windows)]
    heap: list[tuple] = []
    for i, size in enumerate(sizes):
        # spread, tie breaker, sums in descending order, item numbers of each window
        spread = size if windows > 1 else 0
        heap.append((-spread, i, [size], [[i]]))
    heapq.heapify(heap)
    ticket = len(heap)
    while len(heap) > 1:
        _, _, a_sums, a_items = heapq.heappop(heap)
        _, _, b_sums, b_items = heapq.heappop(heap)
        if len(a_sums) < len(b_sums):
            a_sums, a_items, b_sums, b_items = b_sums, b_items, a_sums, a_items
        free = windows - len(a_sums)
        apart = min(free, len(b_sums))
        sums, items = a_sums + b_sums[:apart], a_items + b_items[:apart]
        # a's windows are all in use: its emptiest take what is left of b, fullest first
        for k in range(apart, len(b_sums)):
            at = len(a_sums) - 1 - (k - apart)
            sums[at] += b_sums[k]
            items[at] = items[at] + b_items[k]
        order = sorted(range(len(sums)), key=sums.__getitem__, reverse=True)
        sums, items = [sums[k] for k in order], [items[k] for k in order]
        least = sums[-1] if len(sums) == windows else 0
        heapq.heappush(heap, (least - sums[0], ticket, sums, items))
        ticket += 1
    return heap[0][3] + [[] for _ in range(windows - len(heap[0][3]))]


def near_equal_windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """``differencing`` with the fewest windows that it can fill without exceeding ``capacity``."""
    if not sizes:
        return []
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        found = differencing(sizes, windows)
        if max(sum(sizes[i] for i in w) for w in found) <= capacity:
            return [w for w in found if w]
        windows += 1


def pack(
    cut_pieces: DataFrame,
    capacity: int = 2048,
    together: int = 2048,
    parts: int | None = None,
) -> DataFrame:
    """Give each piece a sequence of at most ``capacity`` tokens and its offset there.

    Adds ``sequence_id`` and ``offset`` to the columns of ``pieces``. Pieces of full length are
    sequences of their own. The others are dealt out evenly by a hash of the
    piece, so no document or source weighs on one task, sorted, and packed ``together``
    at a time: memory is bounded by that number, and a task that is run again
    gives the same sequences. An empty table gives an empty table.
    """

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bin_id = 0

        def close(rows: list[tuple]) -> pa.RecordBatch:
            nonlocal bin_id
            out: list[tuple] = []
            for window in near_equal_windows([r[2] for r in rows], capacity):
                offset = 0
                for i in window:
                    out.append((*rows[i], bin_id, offset))
                    offset += rows[i][2]
                bin_id += 1
            types = [pa.int64()] * 5 + [pa.int32(), pa.int64()]
            return pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*out), types)],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "bin", "offset"],
            )

        held: list[tuple] = []
        for batch in batches:
            held.extend(zip(*(c.to_pylist() for c in batch.columns)))
            while len(held) >= together:
                yield close(held[:together])
                held = held[together:]
        if held:
            yield close(held)

    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    with rows_at_once(cut_pieces.sparkSession, TEXTS_AT_ONCE):
        cut_pieces = written(cut_pieces.select(*columns), "pieces")  # tokenised once, used twice
    by = [F.xxhash64(*columns), *columns]
    short = cut_pieces.filter(F.col("length") < capacity)
    dealt = short.repartition(parts, by[0]) if parts else short.repartition(by[0])
    packed = (
        dealt.sortWithinPartitions(*by)
        .mapInArrow(place, PLACED)
        .select(
            *columns,
            # partition and window of the partition; full pieces count on the other side of 0
            (
                F.shiftleft(F.spark_partition_id().cast("long"), 31) + F.col("bin")
            ).alias("sequence_id"),
            "offset",
        )
    )
    full = (
        cut_pieces.filter(F.col("length") == capacity)
        .select(
            *columns,
            (-1 - F.monotonically_increasing_id()).alias("sequence_id"),
            F.lit(0).cast("long").alias("offset"),
        )
    )
    return packed.unionByName(full)
