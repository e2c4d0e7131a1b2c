"""Byte strings repeated across documents, found through a logarithmic family of suffix arrays."""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billspark.llm.common import (
    NO_ID,
    row_key,
    rows_at_once,
    shared_folder,
    text_or_empty,
    written,
)


@dataclass(frozen=True)
class Settings:
    """Strings of ``length`` bytes; suffixes are sampled by grams of ``gram`` bytes.

    ``batches`` is how many batches, by growing id, go through the index; ``chunk`` how many bytes of
    text a row of the work tables holds, and ``part`` about how many sampled suffixes a
    partition of the index gets.
    """

    length: int = 50
    gram: int = 24
    batches: int = 3
    chunk: int = 4_000_000
    part: int = 1_000_000


_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xD6E8FEB86659FD93)
#: Bits of a sampling value that hold the place in its block.
_PLACE = 16
_BLOCK = 1 << _PLACE


def string_hashes(data: np.ndarray, length: int, salt: int = 0) -> np.ndarray:
    """64-bit hashes of all strings of ``length`` bytes, a block at a time that fits a processor's cache."""
    n = max(0, len(data) - length + 1)
    total = np.empty(n, np.uint64)
    for at in range(0, n, _BLOCK):
        stop = min(at + _BLOCK, n)
        total[at:stop] = _block_hashes(data[at : stop + length - 1], length, salt)
    return total


def _block_hashes(data: np.ndarray, length: int, salt: int) -> np.ndarray:
    """Hashes built by doubling; the array holds a string at least."""
    p = _P + np.uint64(2 * salt)
    h, size, done, total, left = data.astype(np.uint64) * _Q + p, 1, 0, None, length
    n = len(data) - length + 1
    while True:
        if left & 1:
            piece = h[done : done + n]
            if total is None:
                total = piece.copy()
            else:
                total ^= total >> np.uint64(31)
                total *= p
                total += piece
            done += size
        left >>= 1
        if not left:
            break
        longer = h[:-size] * p
        longer ^= longer >> np.uint64(29)
        longer += h[size:] * _Q
        h, size = longer, size * 2
    total ^= total >> np.uint64(32)
    total *= _Q
    total ^= total >> np.uint64(29)
    return total


def _lowest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    size, v = 1, values
    while size * 2 <= width:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    n = len(values) - width + 1
    return np.minimum(v[:n], v[width - size : width - size + n])


def sampled(
    data: np.ndarray, ends: np.ndarray, settings: Settings
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sampled suffixes of documents that lie one after another: ``key, doc, first, last``.

    Every string of ``length`` bytes inside a document is stood for by one of its grams, the one
    with the smallest hash, so equal strings are stood for by equal grams at equal offsets.
    ``first`` and ``last`` are the starts of the strings that a gram stands for.
    """
    length = settings.length
    n = len(data) - length + 1
    empty = np.empty(0, np.int64)
    if n <= 0:
        return empty.astype(np.uint64), empty, empty, empty
    starts = np.concatenate(([0], ends[:-1]))
    # a run of strings with one gram also ends where a document begins or has no more strings
    borders = np.unique(np.concatenate((starts, np.maximum(starts, ends - length + 1))))
    found, keys, before = [], [], -1
    for at in range(0, n, _BLOCK - length):
        block = data[at : min(at + _BLOCK - 1, n - 1 + length)]
        h = _block_hashes(block, settings.gram, 0)
        ranked = (h >> np.uint64(_PLACE) << np.uint64(_PLACE)) | np.arange(len(h), dtype=np.uint64)
        low = _lowest(ranked, length - settings.gram + 1)
        size = min(len(low), _BLOCK - length, n - at)
        where = (low[:size] & np.uint64(_BLOCK - 1)).astype(np.int64)
        change = np.empty(size, bool)
        change[0] = where[0] + at != before
        change[1:] = where[1:] != where[:-1]
        low_border, high_border = np.searchsorted(borders, (at, at + size))
        change[borders[low_border:high_border] - at] = True
        begin = np.flatnonzero(change)
        found.append(begin + at)
        keys.append(h[where[begin]])
        before = where[-1] + at
    first, key = np.concatenate(found), np.concatenate(keys)
    last = np.concatenate((first[1:], [n])) - 1
    doc = np.searchsorted(ends, first, side="right")
    good = first + length <= ends[doc]
    return _spread(key[good]), doc[good], first[good], last[good]


def _spread(h: np.ndarray) -> np.ndarray:
    """Hashes mixed once more: sampled ones are small, and their first bits choose a partition."""
    h = (h ^ (h >> np.uint64(31))) * _P
    h = (h ^ (h >> np.uint64(29))) * _Q
    return h ^ (h >> np.uint64(32))


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value."""
    head = np.array([len(a.tobytes()) for a in arrays], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(
        head + b"".join(a.tobytes() for a in arrays)
    )


def _unpack(blob: bytes, *kinds) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    sizes = np.frombuffer(raw, np.int64, len(kinds))
    out, at = [], 8 * len(kinds)
    for size, kind in zip(sizes.tolist(), kinds):
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def _rows(names: list[str], rows: list[tuple], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def chunks(
    docs: DataFrame, id_col: str, text_col: str, borders: list[int], settings: Settings
) -> DataFrame:
    """Documents put together: ``chunk, band, n_bytes, body``; a band holds a range of ids."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made = TaskContext.get().partitionId(), 0
        held: dict[int, list] = {}
        sizes: dict[int, int] = {}

        def close(band: int) -> pa.RecordBatch:
            nonlocal made
            ids, hashes, texts = zip(*held.pop(band))
            size = sizes.pop(band)
            body = _pack(
                np.array(ids, np.int64),
                np.array(hashes, np.int64),
                np.cumsum([len(t) for t in texts], dtype=np.int64),
                np.frombuffer(b"".join(texts), np.uint8),
            )
            made += 1
            types = [pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            return _rows(
                ["chunk", "band", "n_bytes", "body"], [((task << 32) + made, band, size, body)], types
            )

        for batch in batches:
            for i, h, text in zip(*(c.to_pylist() for c in batch.columns)):
                band = int(np.searchsorted(borders, i, side="right"))
                data = text.encode("utf-8", "replace")
                held.setdefault(band, []).append((i, h, data))
                sizes[band] = sizes.get(band, 0) + len(data)
                if sizes[band] >= settings.chunk or len(held[band]) >= 100_000:
                    yield close(band)
        for band in sorted(held):
            yield close(band)

    return docs.select(*row_key(id_col, text_col), text_or_empty(text_col).alias("text")).mapInArrow(
        gather, "chunk long, band int, n_bytes long, body binary"
    )


def _body(blob: bytes) -> list[np.ndarray]:
    return _unpack(blob, np.int64, np.int64, np.int64, np.uint8)


def _split(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of keys by partition, the partitions met, and the borders between them."""
    part = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    order = np.argsort(part, kind="stable")
    met, first = np.unique(part[order], return_index=True)
    return order, met, np.append(first, len(keys))


def _tag(keys: np.ndarray, bits: int, width: int) -> np.ndarray:
    """The bits of keys that tell them apart inside a partition, in 4 or 8 bytes."""
    rest = keys << np.uint64(bits) if bits else keys
    return (rest >> np.uint64(32)).astype(np.uint32) if width == 4 else rest


def _shared_keys(table: DataFrame, bits: int, width: int, parts: int, settings: Settings) -> DataFrame:
    """``chunk, part, tags``: sampled grams that some other document has as well.

    A chunk names each of its grams once, whatever the number of its documents that hold it, and
    marks those that several do.
    """
    kind = np.uint32 if width == 4 else np.uint64

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids, _, ends, data = _body(blob.as_py())
                key, doc, _, _ = sampled(data, ends, settings)
                if not len(key):
                    continue
                order = np.argsort(key)
                key, holder = key[order], ids[doc][order]
                new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
                many = np.maximum.reduceat(holder, new) != np.minimum.reduceat(holder, new)
                key = key[new]
                order, met, edge = _split(key, bits)
                tags, many = _tag(key, bits, width)[order], many[order]
                rows = [
                    (int(p), chunk, tags[a:b].tobytes(), np.packbits(many[a:b]).tobytes())
                    for p, a, b in zip(met, edge[:-1], edge[1:])
                ]
                yield _rows(
                    ["part", "chunk", "tags", "many"],
                    rows,
                    [pa.int64(), pa.int64(), pa.binary(), pa.binary()],
                )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _grouped(batches):
            tags = [np.frombuffer(r[2], kind) for r in rows]
            many = [np.unpackbits(np.frombuffer(r[3], np.uint8), count=len(t)) for r, t in zip(rows, tags)]
            every, counts = np.unique(np.concatenate(tags), return_counts=True)
            shared = counts > 1
            shared[np.searchsorted(every, np.concatenate([t[m == 1] for t, m in zip(tags, many)]))] = True
            shared = every[shared]
            out = []
            for r, t in zip(rows, tags):
                at = np.searchsorted(shared, t)
                mine = t[(at < len(shared)) & (shared[np.minimum(at, len(shared) - 1)] == t)] if len(shared) else t[:0]
                if len(mine):
                    out.append((r[1], part, mine.tobytes()))
            if out:
                yield _rows(["chunk", "part", "tags"], out, [pa.int64(), pa.int64(), pa.binary()])

    named = table.select("chunk", "body").mapInArrow(
        name, "part long, chunk long, tags binary, many binary"
    )
    return (
        named.repartition(parts, "part")
        .sortWithinPartitions("part")
        .mapInArrow(meet, "chunk long, part long, tags binary")
    )


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows that follow one another with the same first column."""
    part, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[0] != part:
                if rows:
                    yield part, rows
                part, rows = row[0], []
            rows.append(row)
    if rows:
        yield part, rows


def _spans_of(blob: bytes, replies: list, bits: int, width: int, settings: Settings):
    """The spans of a chunk whose grams are shared: all their text, and where each occurs."""
    kind = np.uint32 if width == 4 else np.uint64
    ids, hashes, ends, data = _body(blob)
    key, doc, first, last = sampled(data, ends, settings)
    part = (key >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(key), np.int64)
    tag = _tag(key, bits, width)
    shared = np.zeros(len(key), bool)
    order = np.argsort(key)  # by partition, then by tag
    edges = np.searchsorted(part[order], [r["part"] for r in replies])
    stops = np.searchsorted(part[order], [r["part"] for r in replies], side="right")
    for r, a, b in zip(replies, edges, stops):
        wanted = np.frombuffer(r["tags"], kind)
        mine = tag[order[a:b]]
        at = np.minimum(np.searchsorted(wanted, mine), len(wanted) - 1)
        shared[order[a:b]] = wanted[at] == mine
    raw = data.tobytes()
    number: dict[bytes, int] = {}
    which, places = [], np.flatnonzero(shared)
    a, b = first[places].tolist(), (last[places] + settings.length).tolist()
    for x, y in zip(a, b):
        which.append(number.setdefault(raw[x:y], len(number)))
    return ids, hashes, ends, data, part[places], doc[places], first[places], np.array(which, np.int64), list(number)


SPANS = "part long, level int, chunk long, body binary"


def _spans(chunked: DataFrame, bits: int, width: int, settings: Settings) -> DataFrame:
    """Spans by partition: ``part, level, chunk, body``, distinct in their chunk."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob, replies in zip(*(c.to_pylist() for c in batch.columns)):
                ids, _, _, _, part, doc, _, which, spans = _spans_of(blob, replies, bits, width, settings)
                if not spans:
                    continue
                least = np.full(len(spans), np.iinfo(np.int64).max)
                np.minimum.at(least, which, ids[doc])
                home = np.zeros(len(spans), np.int64)
                home[which] = part
                order = np.argsort(home, kind="stable")
                met, begin = np.unique(home[order], return_index=True)
                rows = []
                for p, a, b in zip(met, begin, np.append(begin[1:], len(order))):
                    mine = order[a:b]
                    texts = [spans[i] for i in mine]
                    rows.append((int(p), -1, chunk, _span_body(mine, least[mine], texts)))
                yield _rows(
                    ["part", "level", "chunk", "body"],
                    rows,
                    [pa.int64(), pa.int32(), pa.int64(), pa.binary()],
                )

    return chunked.select("chunk", "body", "replies").mapInArrow(cut, SPANS)


def _span_body(number, least, texts: list[bytes]) -> bytes:
    """Numbers and ids rise slowly, so their differences are kept, which compress well."""
    return _pack(
        np.diff(np.asarray(number, np.int64), prepend=0),
        np.diff(np.asarray(least, np.int64), prepend=0),
        np.array([len(t) for t in texts], np.int32),
        np.frombuffer(b"".join(texts), np.uint8),
    )


def _read_span_body(body: bytes) -> list[np.ndarray]:
    number, least, sizes, data = _unpack(body, np.int64, np.int64, np.int32, np.uint8)
    return [np.cumsum(number), np.cumsum(least), sizes, data]


class SuffixArray:
    """The strings of ``length`` bytes in spans, in the order of their 128-bit hashes.

    Matches have a fixed length, so suffixes are compared by that much of them only, and any
    order that brings equal strings together serves a merge scan; this one sorts numbers.
    """

    def __init__(self, bodies: list[bytes], length: int) -> None:
        read = [_read_span_body(b) for b in bodies]
        self.number = np.concatenate([r[0] for r in read])
        self.source = np.repeat(np.arange(len(read)), [len(r[0]) for r in read])
        least = np.concatenate([r[1] for r in read])
        sizes = np.concatenate([r[2] for r in read]).astype(np.int64)
        data = np.concatenate([r[3] for r in read])
        windows = sizes - length + 1
        span = np.repeat(np.arange(len(sizes)), windows)
        begin = np.cumsum(sizes) - sizes
        offset = np.arange(len(span)) - np.repeat(np.cumsum(windows) - windows, windows)
        at = begin[span] + offset
        first = string_hashes(data, length)[at]
        second = string_hashes(data, length, salt=1)[at]
        order = np.argsort(first)
        self.first, self.second = first[order], second[order]
        self.span, self.offset, self.least = span[order], offset[order], least[span[order]]
        self.begin, self.sizes, self.data = begin, sizes, data

    def own_least(self) -> np.ndarray:
        """For each string, the smallest id that holds it in this array."""
        f, s = self.first, self.second
        other = s[1:] != s[:-1]
        if not np.any((f[1:] == f[:-1]) & other):
            # no two strings share a first hash: equal ones already follow one another
            new = np.flatnonzero(np.concatenate(([True], f[1:] != f[:-1])))
            return np.repeat(np.minimum.reduceat(self.least, new), np.diff(np.append(new, len(f))))
        order = np.lexsort((s, f))
        f, s = f[order], s[order]
        new = np.concatenate(([True], (f[1:] != f[:-1]) | (s[1:] != s[:-1])))
        group = np.cumsum(new) - 1
        lowest = np.minimum.reduceat(self.least[order], np.flatnonzero(new))
        out = np.empty(len(f), np.int64)
        out[order] = lowest[group]
        return out

    def found_in(self, level: SuffixArray) -> np.ndarray:
        """Merge scan: which strings also stand in ``level``."""
        at = np.searchsorted(level.first, self.first)
        hit = np.zeros(len(self.first), bool)
        open_ = np.arange(len(self.first))
        while len(open_):
            inside = at[open_] < len(level.first)
            open_ = open_[inside]
            same = level.first[at[open_]] == self.first[open_]
            open_ = open_[same]
            good = level.second[at[open_]] == self.second[open_]
            hit[open_[good]] = True
            open_ = open_[~good]
            at[open_] += 1
        return hit


def merged(bodies: list[bytes]) -> bytes:
    """Spans of several tables as one, each once; a level needs no ids, all of its own are smaller."""
    texts: dict[bytes, None] = {}
    for body in bodies:
        _, _, sizes, data = _read_span_body(body)
        raw, at = data.tobytes(), 0
        for size in sizes.tolist():
            texts[raw[at : at + size]] = None
            at += size
    ordered = sorted(texts)
    return _span_body(np.zeros(len(ordered)), np.full(len(ordered), NO_ID), ordered)


class IndexFamily:
    """Levels of suffix arrays; one of level k holds 2^k batches.

    A batch is scanned against every level, then becomes level 0; two arrays of a level merge into
    one of the next, so there are never more than log2(batches) + 1 of them. Scan and merge
    are one pass over the batch and the levels, brought together by sampled gram. Levels
    are tables in the shared folder.
    """

    def __init__(self, parts: int, length: int) -> None:
        self.parts, self.length = parts, length
        self.levels: dict[int, DataFrame] = {}

    def take(self, batch: DataFrame, last: bool = False) -> DataFrame:
        """``chunk, told``: for spans of the batch, which of their strings a smaller document has.

        The family then holds the batch as well, unless it is the ``last``.
        """
        target = 0
        while target in self.levels:
            target += 1
        together = batch
        for level in self.levels.values():
            together = together.unionByName(level)
        path = shared_folder(batch.sparkSession, "level")
        (
            together.repartition(self.parts, "part")
            .sortWithinPartitions("part", "level", "chunk")
            .mapInArrow(_scan_and_merge(self.length, None if last else target), SPANS)
            .write.partitionBy("level")
            .parquet(path)
        )
        made = batch.sparkSession.read.schema(batch.schema).parquet(path)
        for level in range(target):
            del self.levels[level]
        if not last:
            self.levels[target] = made.filter(F.col("level") == target)
        return made.filter(F.col("level") == -1).select("chunk", F.col("body").alias("told"))


def _scan_and_merge(length: int, target: int | None):
    """Per partition: answers for the batch (level -1) and the merged level ``target``."""
    types = [pa.int64(), pa.int32(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _grouped(batches):
            fresh = [r for r in rows if r[1] < 0]
            levels = [r for r in rows if r[1] >= 0]
            out = [(part, -1, chunk, told) for chunk, told in _answers(fresh, levels, length)]
            if target is not None:
                merging = fresh + [r for r in levels if r[1] < target]
                if merging:
                    out.append((part, target, 0, merged([r[3] for r in merging])))
            if out:
                yield _rows(["part", "level", "chunk", "body"], out, types)

    return run


def _answers(fresh: list[tuple], levels: list[tuple], length: int) -> Iterator[tuple[int, bytes]]:
    """For each chunk, runs of strings as span, first and last offset, smallest id that has them."""
    if not fresh:
        return
    mine = SuffixArray([r[3] for r in fresh], length)
    least = mine.own_least()
    for level in levels:
        least[mine.found_in(SuffixArray([level[3]], length))] = NO_ID
    told = np.flatnonzero(least < mine.least)
    told = told[np.lexsort((mine.offset[told], mine.span[told]))]
    if not len(told):
        return
    span, offset, value = mine.span[told], mine.offset[told], least[told]
    new = (span[1:] != span[:-1]) | (offset[1:] != offset[:-1] + 1) | (value[1:] != value[:-1])
    begin = np.flatnonzero(np.concatenate(([True], new)))
    stop = np.append(begin[1:], len(told)) - 1
    source = mine.source[span[begin]]
    for k in np.unique(source):
        run = source == k
        yield fresh[k][2], _pack(
            mine.number[span[begin[run]]],
            offset[begin[run]].astype(np.int32),
            offset[stop[run]].astype(np.int32),
            value[begin[run]],
        )


def _covered(blob: bytes, replies: list, told: list[bytes], bits: int, width: int, settings: Settings):
    """``id, hash, removed byte mask, text`` of each document of a chunk."""
    ids, hashes, ends, data, _, doc, first, which, spans = _spans_of(blob, replies or [], bits, width, settings)
    delta = np.zeros(len(data) + 1, np.int64)
    if len(which):
        least = np.full(len(spans), np.iinfo(np.int64).max)
        np.minimum.at(least, which, ids[doc])
        sizes = np.array([len(s) for s in spans], np.int64)
        whole = ids[doc] > least[which]  # a smaller document of this chunk has all of it
        np.add.at(delta, first[whole], 1)
        np.add.at(delta, first[whole] + sizes[which[whole]], -1)
        order = np.argsort(which, kind="stable")
        begin = np.searchsorted(which[order], np.arange(len(spans) + 1))
        for body in told or []:
            number, low, high, value = _unpack(body, np.int64, np.int32, np.int32, np.int64)
            count = begin[number + 1] - begin[number]
            run = np.repeat(np.arange(len(number)), count)
            place = order[np.repeat(begin[number] - (np.cumsum(count) - count), count) + np.arange(len(run))]
            good = value[run] < ids[doc[place]]
            run, place = run[good], place[good]
            np.add.at(delta, first[place] + low[run], 1)
            np.add.at(delta, first[place] + high[run] + settings.length, -1)
    gone = np.cumsum(delta[:-1]) > 0
    at = 0
    for i, h, end in zip(ids.tolist(), hashes.tolist(), ends.tolist()):
        yield i, h, gone[at:end], data[at:end]
        at = end


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    settings: Settings = Settings(),
) -> DataFrame:
    """Remove bytes covered by a string of ``length`` bytes that also starts in a smaller document.

    Returns ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` for every row of ``docs``; ``kept`` is
    the remaining bytes. Strings are judged on the input and never cross documents. A NULL
    text is empty; texts shorter than ``length`` lose nothing. A NULL id is smaller than any other;
    rows of one id do not count as smaller than one another. An empty table gives no rows.

    Suffixes are sampled by content, so that equal strings meet under the same gram. Grams that
    no other document has are put aside first; the spans around the rest go through
    the index family, batch by batch in the order of ids. A chunk of
    documents speaks for its documents: what many of them hold is sent and answered once.
    """
    spark = docs.sparkSession
    keyed = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("i"))
    shares = [k / settings.batches for k in range(1, settings.batches)]
    borders = sorted(set(keyed.approxQuantile("i", shares, 0.01))) if shares else []
    borders = [int(b) for b in borders]
    name = f"chunks_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = chunks(docs, id_col, text_col, borders, settings).repartition(parts, "chunk")
    # a bucketed table: two joins by chunk find the texts in place
    made.write.bucketBy(parts, "chunk").saveAsTable(name)
    table = spark.table(name)
    n_bytes = table.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    n_sampled = max(1, 2 * n_bytes // (settings.length - settings.gram + 2))
    bits = max(4, math.ceil(math.log2(n_sampled / settings.part + 1)))
    width = 4 if math.log2(n_sampled) + 8 - bits <= 32 else 8
    with rows_at_once(spark, 200):
        shared = written(
            _shared_keys(table, bits, width, parts, settings)
            .groupBy("chunk")
            .agg(F.collect_list(F.struct("part", "tags")).alias("replies")),
            "shared",
        )
        family, answers = IndexFamily(parts, settings.length), []
        for band in range(len(borders) + 1):
            chunked = table.filter(F.col("band") == band).join(shared, "chunk")
            batch = _spans(chunked, bits, width, settings)
            answers.append(family.take(batch, last=band == len(borders)))
    told = answers[0]
    for more in answers[1:]:
        told = told.unionByName(more)
    told = told.groupBy("chunk").agg(F.collect_list("told").alias("told"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        for batch in batches:
            for blob, replies, answer in zip(*(c.to_pylist() for c in batch.columns)):
                rows = []
                for i, _, gone, data in _covered(blob, replies, answer, bits, width, settings):
                    kept = data[~gone].tobytes()
                    runs = int(np.count_nonzero(np.diff(np.concatenate(([0], gone.view(np.int8)))) == 1))
                    rows.append(
                        (
                            None if i == NO_ID else i,
                            len(data),
                            int(gone.sum()),
                            runs,
                            hashlib.sha256(kept).hexdigest(),
                            kept,
                        )
                    )
                yield _rows(names, rows, types)

    return (
        table.join(shared, "chunk", "left")
        .join(told, "chunk", "left")
        .select("body", "replies", "told")
        .mapInArrow(
            finish,
            "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary",
        )
    )
