"""Benchmark passages in documents, found through a positional inverted index."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billspark.llm.common import KEY, TEXTS_AT_ONCE, row_key, rows_at_once, text_or_empty, written

#: A-Z lowered, other letters, digits and all bytes from 0x80 kept, the rest a blank.
_LETTERS = bytes(
    b + 32
    if 0x41 <= b <= 0x5A
    else b
    if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A
    else 0x20
    for b in range(256)
)

#: Most test terms that are sent to the tasks; with more of them, all tokens are counted and
#: indexed, and joins pick the terms that are asked for.
MAX_TERMS = 200_000

#: Terms a task counts before it passes its counts on.
_COUNTED = 500_000


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words, as UTF-8."""
    return (text or "").encode("utf-8", "replace").translate(_LETTERS).split()


def _batch(names: list[str], columns: list[list], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def _shipped(terms: DataFrame, limit: int):
    """The distinct ``term`` values as a broadcast set, or None if there are more than ``limit``."""
    found = [bytes(r[0]) for r in terms.select("term").distinct().limit(limit + 1).collect()]
    if len(found) > limit:
        return None
    return terms.sparkSession.sparkContext.broadcast(frozenset(found))


def term_counts(docs: DataFrame, text_col: str, terms=None) -> DataFrame:
    """``term, n``: occurrences over all documents, summed in the tasks before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if terms is None else terms.value
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = _batch(["term", "n"], [list(seen), list(seen.values())], [pa.binary(), pa.int64()])
            seen.clear()
            return out

        for batch in batches:
            for text in batch.column(0):
                words = words_of(text.as_py())
                seen.update(words if wanted is None else filter(wanted.__contains__, words))
                if len(seen) > _COUNTED:
                    yield flush()
        if seen:
            yield flush()

    counted = docs.select(text_or_empty(text_col).alias("text")).mapInArrow(
        count, "term binary, n long"
    )
    return counted.groupBy("term").agg(F.sum("n").alias("n"))


def index_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", terms=None
) -> DataFrame:
    """The index: ``_id, _hash, term, positions``, a row for each term of a document.

    ``terms`` (a broadcast set) restricts it to these terms. A row with a NULL term
    holds a document's number of words, also of one that has none.
    """

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if terms is None else terms.value
        types = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32())]
        names = ["_id", "_hash", "term", "positions"]
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for i, h, text in zip(*(c.to_pylist() for c in batch.columns)):
                words = words_of(text)
                at: dict[bytes, list[int]] = {}
                if wanted is None:
                    for p, w in enumerate(words):
                        at.setdefault(w, []).append(p)
                elif not wanted.isdisjoint(words):
                    for p, w in enumerate(words):
                        if w in wanted:
                            at.setdefault(w, []).append(p)
                rows.append((i, h, None, [len(words)]))
                rows.extend((i, h, w, p) for w, p in at.items())
                size += len(words)
                if size > 1_000_000 or len(rows) > 50_000:
                    yield _batch(names, list(zip(*rows)), types)
                    rows, size = [], 0
        if rows:
            yield _batch(names, list(zip(*rows)), types)

    return docs.select(*row_key(id_col, text_col), text_or_empty(text_col).alias("text")).mapInArrow(
        post, "_id long, _hash long, term binary, positions array<int>"
    )


def _test_words(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """``item, item_hash, words`` of the test items that have words."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, h, texts = (c.to_pylist() for c in batch.columns)
            words = [words_of(t) for t in texts]
            yield _batch(
                ["item", "item_hash", "words"],
                [i, h, words],
                [pa.string(), pa.int64(), pa.list_(pa.binary())],
            )

    keyed = items.select(
        F.col(item_col).cast("string").alias("item"),
        F.xxhash64(F.coalesce(F.col(item_col).cast("string"), F.lit("")), text_or_empty(text_col))
        .alias("item_hash"),
        text_or_empty(text_col).alias("text"),
    ).distinct()
    return keyed.mapInArrow(split, "item string, item_hash long, words array<binary>").filter(
        F.size("words") > 0
    )


def _anchor_pairs(counts: list[int], window: int) -> set[tuple[int, int]]:
    """For each window, the positions of its rarest and second rarest word; ties go left."""
    n = len(counts)
    found = set()
    for start in range(max(1, n - window + 1)):
        span = sorted(range(start, min(start + window, n)), key=lambda p: (counts[p], p))
        found.add((span[0], span[min(1, len(span) - 1)]))
    return found


def anchors(tests: DataFrame, counts: DataFrame, window: int) -> DataFrame:
    """``item_hash, pair, first, at, term``: where each window's rarest words stand.

    Rarity is the number of occurrences in the training documents; a term that is missing there
    has none, so its windows find nothing, which is right.
    """
    placed = tests.select("item_hash", F.posexplode("words").alias("at", "term"))
    weighed = (
        placed.join(counts, "term", "left")
        .groupBy("item_hash")
        .agg(
            F.sort_array(
                F.collect_list(F.struct("at", "term", F.coalesce("n", F.lit(0)).alias("n")))
            ).alias("ws")
        )
    )

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for h, ws in zip(*(c.to_pylist() for c in batch.columns)):
                for first, second in _anchor_pairs([w["n"] for w in ws], window):
                    if ws[first]["n"]:
                        rows.append((h, first, second, ws[first]["term"], ws[second]["term"]))
            if rows:
                yield _batch(
                    ["item_hash", "first", "second", "first_term", "second_term"],
                    list(zip(*rows)),
                    [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()],
                )

    return weighed.mapInArrow(
        choose, "item_hash long, first int, second int, first_term binary, second_term binary"
    )


def _diagonals(index: DataFrame, wanted: DataFrame, role: str) -> DataFrame:
    """Places of anchor terms, moved back by their offset in the item."""
    at = wanted.select("item_hash", F.col(role).alias("at"), F.col(f"{role}_term").alias("term"))
    return index.join(at.distinct(), "term").select(
        *KEY, "item_hash", "at", F.explode("positions").alias("p")
    ).select(*KEY, "item_hash", (F.col("p") - F.col("at")).alias("diagonal"), "at")


def phrase_hits(
    docs: DataFrame,
    items: DataFrame,
    window: int = 13,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    max_terms: int = MAX_TERMS,
) -> DataFrame:
    """Document words inside any occurrence of ``window`` consecutive words of a test item.

    Returns ``_id, _hash, n_words, n_hit, items, spans`` for each distinct (id, text) of
    ``docs``: ``items`` are the sorted ids of items with an occurring window, ``spans``
    the maximal runs of hit words as ``start, end`` (end exclusive). An item of fewer words is
    one window; one without words is none. NULL texts have no words; a NULL item id is hit
    but not listed; repeated items count once. Empty tables give no hits.

    The training tokens are counted, then indexed with positions for the terms that are
    rarest in some window. A window's two rarest lists are moved by their offsets and
    intersected; what survives is compared word by word in the text. An item that many
    documents hold makes a few anchor rows for each, never a row for each window.
    """
    tests = written(_test_words(items, item_col, item_text_col), "test-items")
    vocabulary = _shipped(tests.select(F.explode("words").alias("term")), max_terms)
    spark = docs.sparkSession
    with rows_at_once(spark, TEXTS_AT_ONCE):
        pairs = written(anchors(tests, term_counts(docs, text_col, vocabulary), window), "anchors")
    asked = pairs.select(F.col("first_term").alias("term")).unionByName(
        pairs.select(F.col("second_term").alias("term"))
    )
    wanted = _shipped(asked, max_terms)
    with rows_at_once(spark, TEXTS_AT_ONCE):
        index = written(index_documents(docs, id_col, text_col, wanted), "positions")
    sizes = (
        index.filter(F.col("term").isNull())
        .groupBy(*KEY)
        .agg(F.max(F.get("positions", F.lit(0))).cast("long").alias("n_words"))
    )
    posted = index.filter(F.col("term").isNotNull())
    first, second = _diagonals(posted, pairs, "first"), _diagonals(posted, pairs, "second")
    both = (
        first.withColumnRenamed("at", "first")
        .join(pairs.select("item_hash", "first", "second"), ["item_hash", "first"])
        .join(
            second.withColumnRenamed("at", "second"),
            [*KEY, "item_hash", "diagonal", "second"],
        )
    )
    candidates = (
        both.groupBy(*KEY, "item_hash")
        .agg(F.collect_set("diagonal").alias("diagonals"))
        .join(tests, "item_hash")
        .groupBy(*KEY)
        .agg(F.collect_list(F.struct("item", "words", "diagonals")).alias("candidates"))
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, h, text, found in zip(*(c.to_pylist() for c in batch.columns)):
                hit, names = _verified(words_of(text), found, window)
                if not names and not hit.any():
                    continue
                edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
                spans = [{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2])]
                rows.append((i, h, int(hit.sum()), sorted(n for n in names if n is not None), spans))
            if rows:
                span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                yield _batch(
                    [*KEY, "n_hit", "items", "spans"],
                    list(zip(*rows)),
                    [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), span],
                )

    texts = docs.select(*row_key(id_col, text_col), text_or_empty(text_col).alias("text"))
    hits = (
        texts.join(candidates, KEY)
        .select(*KEY, "text", "candidates")
        .mapInArrow(
            verify,
            "_id long, _hash long, n_hit long, items array<string>,"
            "spans array<struct<start:int,end:int>>",
        )
        .groupBy(*KEY)
        .agg(*[F.any_value(c).alias(c) for c in ("n_hit", "items", "spans")])
    )
    return sizes.join(hits, KEY, "left").withColumn("n_hit", F.coalesce("n_hit", F.lit(0)))


def _verified(words: list[bytes], found: list[dict], window: int) -> tuple[np.ndarray, set]:
    """Hit words and the items hit, by comparing each candidate place word by word."""
    numbers: dict[bytes, int] = {}
    text = np.array([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.int64)
    hit = np.zeros(len(words), dtype=bool)
    names = set()
    for candidate in found:
        item = np.array([numbers.get(w, -1) for w in candidate["words"]], dtype=np.int64)
        least = min(window, len(item))
        for diagonal in candidate["diagonals"]:
            a, b = max(0, diagonal), min(len(text), diagonal + len(item))
            if b - a < least:
                continue
            same = text[a:b] == item[a - diagonal : b - diagonal]
            edges = np.flatnonzero(np.diff(np.concatenate(([0], same.view(np.int8), [0]))))
            for start, end in zip(edges[::2], edges[1::2]):
                if end - start >= least:
                    hit[a + start : a + end] = True
                    names.add(candidate["item"])
    return hit, names


def contaminated(n_hit, n_words, share: int = 20):
    """The rule: some word is hit, and at least one word in ``share``."""
    return (n_hit > 0) & (n_hit * share >= n_words)


def proximity_matches(index: DataFrame, queries: DataFrame) -> DataFrame:
    """Documents where two terms stand near each other.

    ``queries`` has ``query, left_term, right_term`` (lower-cased UTF-8) ``, distance``. Returns
    ``_id, _hash, query, n``: the number of places of the left term with the right one at most
    ``distance`` words away, in either direction.
    """
    posted = index.filter(F.col("term").isNotNull())
    left = queries.join(posted.withColumnRenamed("term", "left_term"), "left_term").select(
        "query", "right_term", "distance", *KEY, F.col("positions").alias("lefts")
    )
    both = left.join(
        posted.select(*KEY, F.col("term").alias("right_term"), F.col("positions").alias("rights")),
        [*KEY, "right_term"],
    )
    near = F.filter(
        "lefts",
        lambda p: F.exists(
            "rights", lambda q: (F.abs(p - q) <= F.col("distance")) & (p != q)
        ),
    )
    return both.select(*KEY, "query", F.size(near).alias("n")).filter(F.col("n") > 0)
