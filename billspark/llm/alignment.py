"""Where two tokenizers cut a text alike, and how usual their ids are side by side.

A text is read by a byte-level vocabulary (A) and a piece vocabulary (B). Where tokens of both end at the
same byte, a group ends; within a group every token of A is linked with every token of B. An id pair
is counted by the documents that have it linked.

The first pass reads the texts and writes their tokens, aligns them, and counts pairs. The distinct pairs
of the corpus get numbers without gaps from a minimal perfect hash, built segment by segment in tasks.
Counts of the parts of the corpus are dense vectors over these numbers, added up in a tree. A second
pass aligns the documents again, from their tokens, and reads the counts at the pairs' numbers,
after comparing the pair that the number was given to.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billspark.llm.common import worker_memo, written
from billspark.llm.packing import _byte_letter

#: Chunks that a worker remembers: as many used lately, and as many from before that.
REMEMBERED = 150_000
#: Longer chunks are worked out each time.
LONGEST = 64
#: Tokens that are aligned at once, about; longer texts are aligned in slices.
TOGETHER = 2**17
#: Pairs of a segment of the hash, about.
SEGMENT = 8192
#: Pairs of a bucket within a segment, about.
BUCKET = 4
#: Vectors that are added up at once.
FAN_IN = 32

# A chunk starts where neither vocabulary has a token that goes on: at a single blank or line feed
# between other characters, and at a mark after a letter. The last line takes whatever is not plain,
# with runs of white space and other white space inside.
_LETTERS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]"
_CHUNK = re.compile(
    rf"[ \n]?{_LETTERS}+(?=[ \n]\S|[.,;:!?)])"
    r"|[.,;:!?)]+(?=[ \n]\S)"
    r"|\s*\S+(?:(?:[^\S \n]|\s{2,})\S+)*(?:\s+\Z)?|\s+\Z"
)
_PLAIN = re.compile(rf"[ \n]{_LETTERS}+")
_JOINED = re.compile(rf"[^ ] |.\n|\n.|{_LETTERS}[.,;:!?)]", re.S)


# ------------------------------------------------------------------------------ tokens
class Vocabularies:
    """Two vocabularies that read the same texts, chunk by chunk."""

    def __init__(self, bytes_path: str, pieces_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(bytes_path)
        tokenizer.encode_special_tokens = True  # their strings are letters like others
        tokenizer.no_padding()
        tokenizer.no_truncation()
        letter = [_byte_letter(b) for b in range(256)]
        line_feed = [tokenizer.token_to_id(letter[10])]
        merged = tokenizer.model.tokenize

        def one_word(chunk: str) -> list[int]:
            # only its merges are asked for; a line feed before it is a token of its own
            if chunk[0] == " ":
                return [t.id for t in merged(chunk.encode().decode("latin-1").translate(letter))]
            return line_feed + [t.id for t in merged(chunk[1:].encode().decode("latin-1").translate(letter))]

        self.one_word = one_word
        self.encode_a = lambda chunk: tokenizer.encode(chunk, add_special_tokens=False).ids
        byte_of = {x: b for b, x in enumerate(letter)}
        special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
        self.bytes_a = [b""] * tokenizer.get_vocab_size()
        for token, i in tokenizer.get_vocab().items():
            self.bytes_a[i] = token.encode() if token in special else bytes(byte_of[c] for c in token)
        pieces = sentencepiece.SentencePieceProcessor(model_file=pieces_path)
        self.encode_b = lambda texts: pieces.encode(texts, num_threads=1)
        self.width = pieces.get_piece_size()
        spelled = [pieces.id_to_piece(i).replace("▁", " ") for i in range(self.width)]
        is_byte = [pieces.is_byte(i) for i in range(self.width)]
        self.bytes_b = [
            bytes([int(x[3:5], 16)]) if single else x.encode() for x, single in zip(spelled, is_byte)
        ]
        self.sizes_a, self.sizes_b = (
            np.array([len(x) for x in spelled], np.int64) for spelled in (self.bytes_a, self.bytes_b)
        )
        # ids are kept in as few bytes as they need
        self.packed = "H" if max(len(self.bytes_a), self.width) <= 2**16 else "I"
        # how a token is written in the list of groups: before another of its side, and as the last
        self.written_a = [x for i in range(len(self.bytes_a)) for x in (f"{i},", f"{i}|")]
        self.written_b = [x for i in range(self.width) for x in (f"{i},", f"{i};")]
        # what is put before a chunk that does not start with a blank, so that none is added to it
        self.before = self.encode_b(["\n"])[0]
        # chunks may be read alone only if no piece joins what they are cut between
        self.cuttable = len(self.before) == 2 and not any(
            _JOINED.search(x) for x, single in zip(spelled, is_byte) if not single
        )

    def chunks(self, text: str) -> list[str]:
        """Parts of a blank and the text that can be read alone."""
        whole = " " + text
        return _CHUNK.findall(whole) if self.cuttable else [whole]

    def tokens(self, chunks: list[str]) -> list[tuple[bytes, bytes] | None]:
        """Ids of A and of B of each chunk, as packed integers; None if they do not spell it."""
        out: list[tuple[bytes, bytes] | None] = []
        read = self.encode_b([c[1:] if c[0] == " " else "\n" + c for c in chunks])
        for chunk, b in zip(chunks, read):
            if chunk[0] != " ":
                b = b[2:] if b[:2] == self.before else []
            if _PLAIN.fullmatch(chunk):
                a = self.one_word(chunk)  # both vocabularies spell all letters, by bytes if need be
            else:
                a = self.encode_a(chunk)
                spelled = chunk.encode()
                if (
                    b"".join([self.bytes_a[i] for i in a]) != spelled
                    or b"".join([self.bytes_b[i] for i in b]) != spelled
                ):
                    out.append(None)
                    continue
            out.append((array(self.packed, a).tobytes(), array(self.packed, b).tobytes()))
        return out


class Remembered:
    """What ``make`` gives for chunks, remembered for those used lately."""

    def __init__(self, make: Callable[[list[str]], list], size: int = REMEMBERED):
        self.make, self.size = make, size
        self.lately: dict[str, object] = {}
        self.earlier: dict[str, object] = {}

    def of(self, chunks: set[str]) -> dict:
        found: dict = {}
        missing: list[str] = []
        lately, earlier = self.lately, self.earlier
        unknown = self  # no result
        for chunk in chunks:
            known = lately.get(chunk, unknown)
            if known is unknown:
                known = earlier.get(chunk, unknown)
                if known is unknown:
                    missing.append(chunk)
                    continue
                lately[chunk] = known
            found[chunk] = known
        if missing:
            for chunk, made in zip(missing, self.make(missing)):
                found[chunk] = made
                if len(chunk) <= LONGEST:
                    lately[chunk] = made
        if len(lately) > self.size:
            self.earlier, self.lately = lately, {}
        return found


def align(
    a: list[int], b: list[int], sizes_a: list[int], sizes_b: list[int], width: int, spell: bool = True
) -> tuple:
    """Numbers of tokens, groups and links, the groups as text, and ``id of A * width + id of B`` of each link.

    ``sizes_a`` and ``sizes_b`` are the bytes of every id; both lists of ids spell the same bytes.
    """
    groups: list[str] = []
    codes: list[int] = []
    i = j = count = 0
    n, m = len(a), len(b)
    while i < n:
        first, other = i, j
        x, y = a[i], b[j]
        ahead = sizes_a[x] - sizes_b[y]
        i, j, count = i + 1, j + 1, count + 1
        if not ahead:
            codes.append(x * width + y)
            if spell:
                groups.append(f"{x}|{y}")
            continue
        while ahead:
            if ahead < 0:
                ahead += sizes_a[a[i]]
                i += 1
            else:
                ahead -= sizes_b[b[j]]
                j += 1
        ours, theirs = a[first:i], b[other:j]
        codes += [x * width + y for x in ours for y in theirs]
        if spell:
            groups.append(f"{','.join(map(str, ours))}|{','.join(map(str, theirs))}")
    return n, m, count, len(codes), ";".join(groups), codes


def vocabularies(bytes_path: str, pieces_path: str) -> Vocabularies:
    """The vocabularies of a worker, made once."""
    return worker_memo(f"vocabularies {bytes_path} {pieces_path}", lambda: Vocabularies(bytes_path, pieces_path))


def document_tokens(texts: DataFrame, bytes_path: str, pieces_path: str) -> DataFrame:
    """``doc_id, a, b``: ids of both vocabularies as packed integers; none where they do not spell the text."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = vocabularies(bytes_path, pieces_path)
        memory = worker_memo(f"chunks {bytes_path} {pieces_path}", lambda: Remembered(both.tokens))
        for batch in batches:
            ids, ours, theirs, size = [], [], [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                chunks = both.chunks(text) if text else []
                found = memory.of(set(chunks))
                spelled = None not in found.values()
                parts = [found[c] for c in chunks] if spelled else []
                ids.append(doc)
                ours.append(b"".join([p[0] for p in parts]))
                theirs.append(b"".join([p[1] for p in parts]))
                size += len(ours[-1]) + len(theirs[-1])
                if size > 2**24:
                    yield _token_rows(ids, ours, theirs)
                    ids, ours, theirs, size = [], [], [], 0
            if ids:
                yield _token_rows(ids, ours, theirs)

    return texts.select("doc_id", "text").mapInArrow(read, "doc_id long, a binary, b binary")


def _token_rows(ids: list, ours: list[bytes], theirs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(ours, pa.binary()), pa.array(theirs, pa.binary())], ["doc_id", "a", "b"]
    )


# ------------------------------------------------------------------------------ aligning
class Aligned:
    """Groups and links of several stretches of tokens, worked out together.

    A stretch starts and ends at a common border, so borders are looked for in all of them
    at once. ``groups`` and ``links`` say where each stretch's groups and links begin and end.
    """

    def __init__(self, both: Vocabularies, stretches: list[tuple[np.ndarray, np.ndarray]]):
        self.both = both
        self.a = a = np.concatenate([x for x, _ in stretches]).astype(np.int64)
        self.b = b = np.concatenate([y for _, y in stretches]).astype(np.int64)
        ends_a, ends_b = np.cumsum(both.sizes_a[a]), np.cumsum(both.sizes_b[b])
        at = np.searchsorted(ends_b, ends_a)
        common = np.flatnonzero(ends_b[np.minimum(at, len(ends_b) - 1)] == ends_a) if len(ends_b) else np.zeros(0, np.int64)
        self.stop_a, self.stop_b = common + 1, at[common] + 1
        self.start_a, self.start_b = (np.concatenate([[0], x[:-1]]) if len(x) else x for x in (self.stop_a, self.stop_b))
        self.n_a, self.n_b = self.stop_a - self.start_a, self.stop_b - self.start_b
        self.tokens_a, self.tokens_b = (
            np.concatenate([[0], np.cumsum([len(s[k]) for s in stretches])]) for k in (0, 1)
        )
        self.groups = np.searchsorted(self.stop_a, self.tokens_a, side="right")
        self.links = np.concatenate([[0], np.cumsum(self.n_a * self.n_b)])[self.groups]

    def codes(self) -> np.ndarray:
        """``id of A * width + id of B`` of every link."""
        group = np.repeat(np.arange(len(self.n_a)), self.n_a)
        times = self.n_b[group]
        first = np.cumsum(times) - times
        other = np.arange(int(times.sum())) - np.repeat(first - self.start_b[group], times)
        return np.repeat(self.a, times) * self.both.width + self.b[other]

    def texts(self) -> list[str]:
        """The groups of each stretch, written out."""
        a, b = self.a, self.b
        group_a = np.repeat(np.arange(len(self.n_a)), self.n_a)
        group_b = np.repeat(np.arange(len(self.n_b)), self.n_b)
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[self.stop_a - 1] = 1
        last_b[self.stop_b - 1] = 1
        keys = np.zeros(len(a) + len(b), np.int64)
        keys[np.arange(len(a)) + self.start_b[group_a]] = 2 * a + last_a
        keys[np.arange(len(b)) + self.stop_a[group_b]] = 2 * b + last_b + len(self.both.written_a)
        written = worker_memo(f"written {id(self.both)}", lambda: [*self.both.written_a, *self.both.written_b])
        borders = (self.tokens_a + self.tokens_b).tolist()
        keys = keys.tolist()
        return [
            "".join([written[k] for k in keys[low:high]])[:-1] for low, high in zip(borders, borders[1:])
        ]


def stretches_of(both: Vocabularies, a: np.ndarray, b: np.ndarray, most: int = TOGETHER):
    """A text's tokens in slices of about ``most`` of A, cut at common borders; usually one."""
    if len(a) <= most:
        yield a, b
        return
    ends_a, ends_b = np.cumsum(both.sizes_a[a]), np.cumsum(both.sizes_b[b])
    i = j = 0
    while i < len(a):
        reach = most
        while True:
            stop = min(len(a), i + reach)
            window = ends_a[i:stop]
            at = np.searchsorted(ends_b, window)
            common = np.flatnonzero(ends_b[np.minimum(at, len(b) - 1)] == window)
            if len(common):
                break
            reach *= 2  # one group as long as the slice
        k, m = i + int(common[-1]) + 1, int(at[common[-1]]) + 1
        yield a[i:k], b[j:m]
        i, j = k, m


def _together(both: Vocabularies, batch: pa.RecordBatch, most: int = TOGETHER):
    """``(row numbers, Aligned)`` of about ``most`` tokens at a time; a row's slices come in order."""
    rows, held, size = [], [], 0
    for row, (ours, theirs) in enumerate(zip(batch.column("a"), batch.column("b"))):
        a, b = (np.frombuffer(x.as_buffer(), both.packed) for x in (ours, theirs))
        for stretch in stretches_of(both, a, b, most):
            rows.append(row)
            held.append(stretch)
            size += len(stretch[0])
            if size >= most:
                yield rows, Aligned(both, held)
                rows, held, size = [], [], 0
    if rows:
        yield rows, Aligned(both, held)


def lately_made(kind: str, name: str, make: Callable):
    """The one thing of its kind that a worker keeps; another name takes its place."""
    place = worker_memo(f"lately made {kind}", dict)
    if name not in place:
        place.clear()
        place[name] = make()
    return place[name]


def document_pairs(tokens: DataFrame, bytes_path: str, pieces_path: str, at_once: int = 1_000_000) -> DataFrame:
    """``code, n``: pairs and the documents that have them linked, summed over stretches of a task.

    A task holds at most about ``at_once`` distinct pairs (and those of one document) before it gives them on.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = vocabularies(bytes_path, pieces_path)
        held: dict[int, int] = {}

        def given() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.int64()), pa.array(list(held.values()), pa.int64())], ["code", "n"]
            )
            held.clear()
            return out

        def add(codes: np.ndarray) -> None:
            for code, n in zip(*(x.tolist() for x in np.unique(codes, return_counts=True))):
                held[code] = held.get(code, 0) + n

        for batch in batches:
            long_row, pairs = -1, np.zeros(0, np.int64)  # a row that has come in slices, and its pairs so far
            for rows, aligned in _together(both, batch):
                codes = aligned.codes()
                row = np.repeat(rows, np.diff(aligned.links))
                order = np.lexsort((codes, row))
                row, codes = row[order], codes[order]
                new = np.ones(len(codes), bool)
                new[1:] = (codes[1:] != codes[:-1]) | (row[1:] != row[:-1])
                row, codes = row[new], codes[new]
                if long_row != -1 and (not len(row) or row[0] != long_row):
                    add(pairs)
                elif long_row != -1:
                    mine = row == long_row
                    pairs = np.union1d(pairs, codes[mine])
                    row, codes = row[~mine], codes[~mine]
                    if len(row) or rows[-1] != long_row:
                        add(pairs)
                    else:
                        continue
                # the last row may go on in the next slices
                long_row = rows[-1]
                pairs = codes[row == long_row]
                add(codes[row != long_row])
                if len(held) > at_once:
                    yield given()
            if long_row != -1:
                add(pairs)
        if held:
            yield given()

    return tokens.select("a", "b").mapInArrow(count, "code long, n long")


# ------------------------------------------------------------------ minimal perfect hash
def mixed(codes: np.ndarray, seed: int | np.ndarray) -> np.ndarray:
    """A 64-bit hash of each code, with one seed or a seed for each."""
    seed = np.asarray(seed, np.uint64)
    with np.errstate(over="ignore"):
        x = codes.astype(np.uint64) + (seed + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def segment_of(codes: np.ndarray, segments: int) -> np.ndarray:
    return (mixed(codes, 0) % np.uint64(segments)).astype(np.int64)


def _bucket(codes: np.ndarray, buckets: int | np.ndarray) -> np.ndarray:
    return (mixed(codes, 1) % np.asarray(buckets, np.uint64)).astype(np.int64)


def _start(codes: np.ndarray, turn: int | np.ndarray, slots: int | np.ndarray) -> np.ndarray:
    return (mixed(codes, np.asarray(turn, np.uint64) + np.uint64(2)) % np.asarray(slots, np.uint64)).astype(np.int64)


def buckets_of(slots: int) -> int:
    return max(1, -(-slots // BUCKET))


def perfect_hash(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two displacements for each bucket that send distinct codes to the places 0 to n-1, one each.

    The first chooses a hash of the code, the second is added to it, modulo n. Buckets are placed from
    the largest on; a bucket of one code takes any place that is left.
    """
    n = len(codes)
    buckets = buckets_of(n)
    bucket = _bucket(codes, buckets)
    order = np.argsort(bucket, kind="stable")
    sizes = np.bincount(bucket, minlength=buckets)
    firsts = np.concatenate([[0], np.cumsum(sizes)])
    turns = np.zeros(buckets, np.int32)
    shifts = np.zeros(buckets, np.int32)
    taken = np.zeros(n, bool)
    lone: list[int] = []
    for b in np.argsort(-sizes, kind="stable"):
        size = sizes[b]
        if size == 0:
            break
        if size == 1:
            lone.append(int(b))
            continue
        members = codes[order[firsts[b] : firsts[b + 1]]]
        if len(np.unique(members)) < size:
            raise ValueError("codes must be distinct")
        turn = 0
        while True:
            at = _start(members, turn, n)
            if len(set(at.tolist())) == size:
                shift = _free_shift(at, taken, n)
                if shift is not None:
                    break
            turn += 1
        taken[(at + shift) % n] = True
        turns[b], shifts[b] = turn, shift
    places = np.flatnonzero(~taken)
    for b, place in zip(lone, places):
        shifts[b] = (place - _start(codes[order[firsts[b] : firsts[b] + 1]], 0, n)[0]) % n
    return turns, shifts


def _free_shift(at: np.ndarray, taken: np.ndarray, n: int, together: int = 512) -> int | None:
    """The least shift that moves all places of ``at`` to free ones."""
    for low in range(0, n, together):
        shifts = np.arange(low, min(n, low + together))
        free = ~taken[(at[:, None] + shifts) % n].any(axis=0)
        if free.any():
            return int(shifts[free.argmax()])
    return None


def places(codes: np.ndarray, turns: np.ndarray, shifts: np.ndarray, slots: int) -> np.ndarray:
    """Places of codes of one segment."""
    bucket = _bucket(codes, len(turns))
    return (_start(codes, turns[bucket], slots) + shifts[bucket]) % slots


class PairTable:
    """Segments of the hash side by side: numbers, verified keys and counts of pairs."""

    def __init__(self, segments: int, rows: list):
        self.segments = segments
        slots = np.zeros(segments, np.int64)
        parts: dict[int, tuple] = {}
        for segment, keys, turns, shifts, counts in rows:
            keys = np.frombuffer(keys, np.int64)
            slots[segment] = len(keys)
            parts[segment] = (keys, np.frombuffer(turns, np.int32), np.frombuffer(shifts, np.int32), np.frombuffer(counts, np.int64))
        self.slots = slots
        self.first = np.concatenate([[0], np.cumsum(slots)])
        self.buckets = np.array([buckets_of(s) if s else 0 for s in slots.tolist()], np.int64)
        self.first_bucket = np.concatenate([[0], np.cumsum(self.buckets)])
        empty = [np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int64)]
        columns = [[parts[s][k] for s in sorted(parts)] or [empty[k]] for k in range(4)]
        self.keys, self.turns, self.shifts, self.counts = (np.concatenate(c) for c in columns)

    def look_up(self, codes: np.ndarray) -> np.ndarray:
        """Counts of pairs; 0 for pairs that the table does not have."""
        segment = segment_of(codes, self.segments)
        slots = self.slots[segment]
        out = np.zeros(len(codes), np.int64)
        held = slots > 0
        codes, segment, slots = codes[held], segment[held], slots[held]
        bucket = _bucket(codes, self.buckets[segment]) + self.first_bucket[segment]
        place = (_start(codes, self.turns[bucket], slots) + self.shifts[bucket]) % slots
        place += self.first[segment]
        out[held] = np.where(self.keys[place] == codes, self.counts[place], 0)
        return out


def hash_segments(codes: DataFrame, segments: int) -> DataFrame:
    """``segment, keys, turns, shifts``: the hash of distinct codes, a row for each segment."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(segment_of(codes, segments))], ["code", "segment"]
            )

    def build(key: tuple, table: pa.Table) -> pa.Table:
        codes = np.sort(table.column("code").to_numpy())
        turns, shifts = perfect_hash(codes)
        keys = np.zeros(len(codes), np.int64)
        keys[places(codes, turns, shifts, len(codes))] = codes
        return pa.table(
            {
                "segment": pa.array([key[0].as_py()], pa.int64()),
                "keys": [keys.tobytes()],
                "turns": [turns.tobytes()],
                "shifts": [shifts.tobytes()],
            }
        )

    return (
        codes.select("code")
        .mapInArrow(number, "code long, segment long")
        .groupBy("segment")
        .applyInArrow(build, "segment long, keys binary, turns binary, shifts binary")
    )


def _dense(key: tuple, counts: pa.Table, hashes: pa.Table) -> pa.Table:
    """A node's counts of a segment as a dense vector over the segment's hash."""
    turns = np.frombuffer(hashes.column("turns")[0].as_py(), np.int32)
    shifts = np.frombuffer(hashes.column("shifts")[0].as_py(), np.int32)
    vector = np.zeros(len(hashes.column("keys")[0].as_py()) // 8, np.int64)
    at = places(counts.column("code").to_numpy(), turns, shifts, len(vector))
    np.add.at(vector, at, counts.column("n").to_numpy())
    return pa.table(
        {
            "segment": pa.array([key[0].as_py()], pa.int64()),
            "node": pa.array([key[1].as_py()], pa.int64()),
            "counts": [vector.tobytes()],
        }
    )


def _added(key: tuple, table: pa.Table) -> pa.Table:
    vectors = [np.frombuffer(v.as_py(), np.int64) for v in table.column("counts")]
    return pa.table(
        {
            "segment": pa.array([key[0].as_py()], pa.int64()),
            "node": pa.array([key[1].as_py()], pa.int64()),
            "counts": [np.add.reduce(vectors).tobytes()],
        }
    )


VECTORS = "segment long, node long, counts binary"


def pair_counts(partial: DataFrame, segments: int, nodes: int) -> DataFrame:
    """``segment, keys, turns, shifts, counts``: dense counts of all pairs over their hash.

    ``partial`` holds ``code, n, node``; the pairs of a node fall into dense vectors, which are added up
    ``FAN_IN`` at a time until each segment has one. Every step is written: a lost executor repeats
    its own segments.
    """
    hashes = written(hash_segments(partial.select("code").distinct(), segments), "pair-hash")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(segment_of(batch.column(0).to_numpy(), segments))],
                ["code", "n", "node", "segment"],
            )

    # leaves: the counts of a node and segment come to where the segment's hash is sent as well
    leaves = partial.select("code", "n", "node").mapInArrow(number, "code long, n long, node long, segment long")
    shape = hashes.select("segment", "keys", "turns", "shifts")
    shape = shape.join(
        leaves.select(*[F.col(c).alias(c) for c in ("segment", "node")]).distinct(), "segment"
    )
    summed = (
        leaves.groupBy("segment", "node").cogroup(shape.groupBy("segment", "node")).applyInArrow(_dense, VECTORS)
    )
    while nodes > 1:
        nodes = -(-nodes // FAN_IN)
        parents = F.floor(F.col("node") / FAN_IN).cast("long").alias("node")
        summed = summed.select("segment", parents, "counts").groupBy("segment", "node").applyInArrow(_added, VECTORS)
    return hashes.join(summed.select("segment", "counts"), "segment")


# ------------------------------------------------------------------------------ documents
RESULT = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
RESULT_NAMES = [c.split()[0] for c in RESULT.split(", ")]


def _looked_up(bytes_path: str, pieces_path: str, table, best, share: int):
    """A function from tokens to results with the counts of one share of the pairs.

    ``table`` and ``best`` are broadcast: the segments of the share, and the highest count of each id of A.
    """
    name = uuid.uuid4().hex

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = vocabularies(bytes_path, pieces_path)
        pairs = lately_made("pairs", name, lambda: PairTable(*table.value))
        highest = np.frombuffer(best.value, np.int64)
        for batch in batches:
            n = batch.num_rows
            numbers = np.zeros((6, n), np.int64)
            digests: list = [None] * n
            for rows, aligned in _together(both, batch):
                codes = aligned.codes()
                counts = pairs.look_up(codes)
                top = (counts > 0) & (counts == highest[codes // both.width])
                tops, sums = (np.concatenate([[0], np.cumsum(x)])[aligned.links] for x in (top, counts))
                measured = (aligned.tokens_a, aligned.tokens_b, aligned.groups, aligned.links, tops, sums)
                np.add.at(numbers, (slice(None), rows), np.stack([np.diff(x) for x in measured]))
                for row, text in zip(rows, aligned.texts() if not share else ()):
                    if text:
                        if digests[row] is None:
                            digests[row] = hashlib.sha256()
                        else:
                            digests[row].update(b";")
                        digests[row].update(text.encode())
            made = [pa.array(x) for x in numbers]
            if share:
                # counts of the earlier shares; the other columns are the same each time
                made = [batch.column(c) for c in RESULT_NAMES[:4]] + [
                    pc.add(made[k], batch.column(RESULT_NAMES[k])) for k in (4, 5)
                ]
            hashes = batch.column(RESULT_NAMES[6]) if share else pa.array([d.hexdigest() if d else "" for d in digests], pa.string())
            first = [batch.column(c) for c in ("doc_id", "a", "b")]
            yield pa.RecordBatch.from_arrays([*first, *made, hashes], ["doc_id", "a", "b", *RESULT_NAMES])

    return results


def align_documents(
    docs: DataFrame,
    bytes_path: str,
    pieces_path: str,
    max_pairs: int = 4_000_000,
    segment: int = SEGMENT,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id`` and the alignment of each row's text: tokens, groups, links, and how usual the links are.

    ``n_best`` is the number of links whose count is the highest of their id of A, ``count_sum`` the sum of
    the counts of all links, ``groups_sha256`` the hash of the groups. Missing and empty texts, and
    texts that the tokens of A or B do not spell, have zeros and an empty hash, and count nowhere. Repeated
    rows are documents of their own; ties are all highest; an empty table gives an empty table; other
    columns are not looked at.

    At most ``max_pairs`` distinct pairs (24 bytes each) are sent to tasks at a time. With more, the
    second pass goes over the tokens once for each such share of the pairs and adds up, so results do
    not depend on the limit. Texts of any length are read whole; chunks between single blanks
    are read once in a worker and remembered, and tokens are aligned in bounded slices.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    tokens = written(document_tokens(texts, bytes_path, pieces_path), "tokens")
    node = F.spark_partition_id().cast("long").alias("node")
    partial = written(document_pairs(tokens, bytes_path, pieces_path).select("code", "n", node), "pairs")
    distinct, nodes = partial.agg(
        F.approx_count_distinct("code"), F.coalesce(F.max("node"), F.lit(0)) + 1
    ).first()
    segments = max(1, -(-distinct // segment))
    table = written(pair_counts(partial, segments, nodes), "pair-counts")

    both = vocabularies(bytes_path, pieces_path)
    best = spark.sparkContext.broadcast(_best_counts(table, both.width, len(both.bytes_a)).tobytes())
    shares = max(1, -(-distinct // max_pairs))
    looked_up = tokens
    for share in range(shares):
        rows = table.filter(F.col("segment") % shares == share).collect() if distinct else []
        sent = spark.sparkContext.broadcast((segments, [tuple(r) for r in rows]))
        if share:
            looked_up = written(looked_up, f"shares-{share}")
        looked_up = looked_up.mapInArrow(
            _looked_up(bytes_path, pieces_path, sent, best, share), f"doc_id long, a binary, b binary, {RESULT}"
        )
    return looked_up.drop("a", "b")


def _best_counts(table: DataFrame, width: int, height: int) -> np.ndarray:
    """The highest count of each id of A: at most as many numbers as A has ids reach the driver."""

    def highest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros(height, np.int64)
        for batch in batches:
            for keys, counts in zip(batch.column(0), batch.column(1)):
                ids = np.frombuffer(keys.as_py(), np.int64) // width
                np.maximum.at(best, ids, np.frombuffer(counts.as_py(), np.int64))
        ids = np.flatnonzero(best)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(best[ids])], ["id", "n"])

    best = np.zeros(height, np.int64)
    found = table.select("keys", "counts").mapInArrow(highest, "id long, n long").groupBy("id").agg(F.max("n"))
    for i, n in found.collect():
        best[i] = n
    return best
