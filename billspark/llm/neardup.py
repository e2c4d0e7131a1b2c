"""Near-duplicate documents by ProbMinHash over weighted word shingles."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billspark.llm.common import (
    KEY,
    NO_ID,
    TEXTS_AT_ONCE,
    cut,
    row_key,
    rows_at_once,
    text_or_empty,
    worker_memo,
    written,
)

#: Words whose hashes a Python worker remembers at most; the memory is then emptied. A hash is
#: quickly had, so this need not hold the rare ones.
REMEMBERED = 100_000

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)
_TIMES = np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class Settings:
    """Shingles of ``words``; links at ``similarity``; ``bands`` of ``rows`` components each.

    A pair of similarity 0.8 shares a band with probability 0.9998. ``block`` is how many texts of a
    bucket are compared with one another in one piece of work.
    """

    words: int = 5
    similarity: float = 0.8
    bands: int = 16
    rows: int = 4
    block: int = 2048

    @property
    def components(self) -> int:
        return self.bands * self.rows


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def words_of(text: str) -> list[bytes]:
    """Words between ASCII blanks, A-Z lowered."""
    return text.encode("utf-8", "replace").lower().split()


def weighted_shingles(
    words: list[bytes], length: int, hashes: dict[bytes, int]
) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles as sorted hashes, and their weights, 1 + ln(occurrences).

    A text of fewer words is one shingle, one without words has none.
    """
    if not words:
        return np.empty(0, np.uint64), np.empty(0)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - length + 1)
    total = np.zeros(n, np.uint64)
    for k in range(min(length, len(h))):
        total = total * _TIMES + h[k : k + n]
    found, counts = np.unique(_mixed(total), return_counts=True)
    return found, 1 + np.log(counts)


def prob_minhash(shingles: np.ndarray, weights: np.ndarray, components: int) -> np.ndarray:
    """For each component, the shingle that arrives first.

    Each shingle is a Poisson process whose rate is its weight, and each of its arrivals falls to
    a component drawn at random; times and components come from the shingle's hash alone. Two
    texts have the same shingle in a component with their probability Jaccard. A
    shingle is left as soon as its next arrival is later than all components' first ones.
    """
    first = np.full(components, np.inf)
    winner = np.zeros(components, np.uint64)
    active, rates = shingles, weights
    times = np.zeros(len(active))
    step = 0
    # enough arrivals at once that few texts need a second round
    at_once = max(1, math.ceil(components * (math.log(components) + 1) / max(1, len(active))))
    while len(active):
        numbers = np.arange(step + 1, step + 1 + at_once, dtype=np.uint64) * _GOLDEN
        random = _mixed(active[:, None] + numbers[None, :])
        uniform = ((random >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
        arrivals = times[:, None] + np.cumsum(-np.log(uniform), axis=1) / rates[:, None]
        slots = (random % np.uint64(components)).astype(np.int64)
        order = np.argsort(arrivals, axis=None)[::-1]
        # written from late to early, so the earliest of a component stays
        flat, who = slots.ravel()[order], order // at_once
        early = np.full(components, np.inf)
        early[flat] = arrivals.ravel()[order]
        name = np.zeros(components, np.uint64)
        name[flat] = active[who]
        better = early < first
        first[better], winner[better] = early[better], name[better]
        step += at_once
        going = arrivals[:, -1] < first.max()
        active, rates, times = active[going], rates[going], arrivals[going, -1]
        at_once = 4
    return winner


def probability_jaccard(
    a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]
) -> tuple[float, float]:
    """The probability Jaccard and the plain Jaccard of two weighted sets, exactly."""
    (xs, xw), (ys, yw) = a, b
    if not len(xs) or not len(ys):
        return 0.0, 0.0
    every = np.union1d(xs, ys)
    x, y = np.zeros(len(every)), np.zeros(len(every))
    x[np.searchsorted(every, xs)] = xw
    y[np.searchsorted(every, ys)] = yw
    both = (x > 0) & (y > 0)
    plain = both.sum() / len(every)
    with np.errstate(divide="ignore"):
        ratio = np.where(y > 0, x / np.where(y > 0, y, 1), np.inf)
    order = np.argsort(ratio, kind="stable")
    ratio, x, y, both = ratio[order], x[order], y[order], both[order]
    # sum over j of max(x_j / x_i, y_j / y_i): the x side where j's ratio is not below i's
    below = np.searchsorted(ratio, ratio, side="left")
    x_sums, y_sums = np.concatenate(([0], np.cumsum(x))), np.concatenate(([0], np.cumsum(y)))
    total = (x_sums[-1] - x_sums[below])[both] / x[both] + y_sums[below][both] / y[both]
    return float((1 / total).sum()), float(plain)


def sketches(docs: DataFrame, id_col: str, text_col: str, settings: Settings) -> DataFrame:
    """``_id, _hash, node, weight, bands`` of every row; texts without words have no node.

    ``node`` is a digest of the words, so copies share it.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = worker_memo("hashes of words", _WordHashes, alone=True)
        for batch in batches:
            rows = []
            for i, h, text in zip(*(c.to_pylist() for c in batch.columns)):
                words = words_of(text)
                if not words:
                    rows.append((i, h, None, 0.0, None))
                    continue
                node = hashlib.blake2b(b" ".join(words), digest_size=16).digest()
                found, weights = weighted_shingles(words, settings.words, hashes)
                winner = prob_minhash(found, weights, settings.components)
                parts = winner.reshape(settings.bands, settings.rows)
                band = np.arange(settings.bands, dtype=np.uint64)
                for k in range(settings.rows):
                    band = _mixed(band * _TIMES + parts[:, k])
                rows.append((i, h, node, float(len(found)), band.view(np.int64).tolist()))
            if rows:
                types = [pa.int64(), pa.int64(), pa.binary(), pa.float64(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), types)],
                    [*KEY, "node", "size", "bands"],
                )

    return docs.select(*row_key(id_col, text_col), text_or_empty(text_col).alias("text")).mapInArrow(
        sketch, "_id long, _hash long, node binary, size double, bands array<long>"
    )


def linked(pairs: DataFrame, texts: DataFrame, settings: Settings) -> DataFrame:
    """The ``pairs`` (``left, right``) whose texts are similar enough, by exact comparison."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = worker_memo("hashes of words", _WordHashes, alone=True)
        last: tuple = (None, None)
        for batch in batches:
            rows = []
            for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns)):
                if last[0] != b:
                    last = (b, weighted_shingles(words_of(y), settings.words, hashes))
                mine = weighted_shingles(words_of(x), settings.words, hashes)
                if max(probability_jaccard(mine, last[1])) >= settings.similarity:
                    rows.append((a, b))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.binary()) for c in zip(*rows)], ["left", "right"]
                )

    x = texts.select(F.col("node").alias("left"), F.col("text").alias("x"))
    y = texts.select(F.col("node").alias("right"), F.col("text").alias("y"))
    return (
        pairs.join(x, "left")
        .join(y, "right")
        .select("left", "right", "x", "y")
        .mapInArrow(compare, "left binary, right binary")
    )


def _across(labelled: DataFrame, texts: DataFrame, settings: Settings) -> DataFrame:
    """Links between members of a bucket that are in different components.

    ``labelled`` has ``band, bucket, node, label``. The members outside a bucket's largest component
    are compared with all its members. Both are dealt into blocks, and each block of the
    ones meets each block of the others in a group of its own.
    """
    counted = labelled.groupBy("band", "bucket", "label").agg(F.count("*").alias("n"))
    buckets = (
        counted.groupBy("band", "bucket")
        .agg(
            F.sum("n").alias("n"),
            F.max("n").alias("most"),
            F.max_by("label", F.struct("n", "label")).alias("main"),
        )
        .filter(F.col("n") > F.col("most"))
        .select(
            "band",
            "bucket",
            "main",
            F.ceil(F.col("n") / settings.block).alias("blocks"),
            F.ceil((F.col("n") - F.col("most")) / settings.block).alias("odd_blocks"),
        )
    )
    members = labelled.select("band", "bucket", "node", "label").join(buckets, ["band", "bucket"])
    home = F.xxhash64("node")

    def placed(odd: bool) -> DataFrame:
        mine, facing = ("odd_blocks", "blocks") if odd else ("blocks", "odd_blocks")
        rows = members.filter(F.col("label") != F.col("main")) if odd else members
        own, other = F.pmod(home, F.col(mine)), F.col("_other")
        pair = (other, own) if odd else (own, other)
        return rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col(facing) - 1))).select(
            F.xxhash64("band", "bucket", *pair).alias("block"),
            F.lit(int(odd)).alias("odd"),
            "node",
            "label",
            "band",
        )

    rows = placed(False).unionByName(placed(True)).join(texts, "node")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = worker_memo("hashes of words", _WordHashes, alone=True)
        for block in _blocks(batches):
            found = _links_in_block(block, settings, hashes)
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.binary()) for c in zip(*found)], ["left", "right"]
                )

    return (
        rows.select("block", "odd", "node", "label", "band", "bands", "text")
        .repartition("block")
        .sortWithinPartitions("block", "odd", "node")
        .mapInArrow(compare, "left binary, right binary")
        .distinct()
    )


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    block, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[0] != block:
                if rows:
                    yield rows
                block, rows = row[0], []
            rows.append(row)
    if rows:
        yield rows


def _links_in_block(rows: list[tuple], settings: Settings, hashes) -> list[tuple[bytes, bytes]]:
    """Links of the odd members with all members of a block, through an index of shingles.

    Pairs that meet in an earlier band are left to it.
    """
    sets = [weighted_shingles(words_of(r[6]), settings.words, hashes) for r in rows]
    members = [k for k, r in enumerate(rows) if not r[1]]
    odd = [k for k, r in enumerate(rows) if r[1]]
    if not members or not odd:
        return []
    sizes = np.array([len(sets[k][0]) for k in members])
    plain = np.array([bool((sets[k][1] == 1).all()) for k in members])
    labels = {label: i for i, label in enumerate(sorted({r[3] for r in rows}))}
    label = np.array([labels[rows[k][3]] for k in members])
    bands = np.array([rows[k][5] for k in members], np.int64)
    shingles = np.concatenate([sets[k][0] for k in members])
    holder = np.repeat(np.arange(len(members)), sizes)
    order = np.argsort(shingles, kind="stable")
    shingles, holder = shingles[order], holder[order]
    found = []
    for k in odd:
        mine, weights = sets[k]
        first = np.searchsorted(shingles, mine)
        count = np.searchsorted(shingles, mine, side="right") - first
        places = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
        common = np.bincount(holder[places], minlength=len(members))
        similar = common / (len(mine) + sizes - common)
        band = rows[k][4]
        earlier = (bands[:, :band] == np.array(rows[k][5][:band], np.int64)).any(axis=1)
        fresh = (label != labels[rows[k][3]]) & ~earlier
        linked_ = fresh & (similar >= settings.similarity)
        if not (weights == 1).all() or not plain.all():
            unsure = fresh & ~linked_ & (common > 0) & ~(plain & bool((weights == 1).all()))
            for j in np.flatnonzero(unsure):
                if probability_jaccard(sets[k], sets[members[j]])[0] >= settings.similarity:
                    linked_[j] = True
        found += [(rows[k][2], rows[members[j]][2]) for j in np.flatnonzero(linked_)]
    return found


def components(links: DataFrame) -> DataFrame:
    """``node, label``: the smallest node of each node's connected component.

    Labels are passed along links and then looked up once more at the node that they name,
    until none changes. Every round is a join and an aggregation with map-side combining,
    so a hub with many links is no burden.
    """
    both = cut(
        links.select("left", "right")
        .unionByName(links.select(F.col("right").alias("left"), F.col("left").alias("right")))
        .distinct()
    )
    labels = cut(both.groupBy("left").agg(F.min("right").alias("m")).select(
        F.col("left").alias("node"), F.least("left", "m").alias("label")
    ))
    while True:
        passed = (
            both.join(labels.withColumnRenamed("node", "right"), "right")
            .groupBy(F.col("left").alias("node"))
            .agg(F.min("label").alias("heard"))
        )
        better = labels.join(passed, "node").select(
            "node", F.least("label", "heard").alias("near"), F.col("label").alias("was")
        )
        jumped = better.join(
            labels.select(F.col("node").alias("near"), F.col("label").alias("far")), "near", "left"
        ).select("node", F.least("near", F.coalesce("far", "near")).alias("label"), "was")
        next_labels = cut(jumped)
        changed = next_labels.filter(F.col("label") != F.col("was")).limit(1).count()
        labels = next_labels.drop("was")
        if not changed:
            return labels


def classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    settings: Settings = Settings(),
) -> DataFrame:
    """``_id, _hash, class_id, keeper``: the class of every row of ``docs``.

    Two documents are linked if their weighted shingles have a probability Jaccard of at least
    ``similarity``, or their plain shingle sets a Jaccard of it; classes are
    what links connect. ``class_id`` is the smallest id of the class, ``keeper`` marks its rows.
    Copies (the same words) are one node. A text without words is alone in its class. A NULL
    id is smaller than any other, and its class has a NULL id. An empty table gives no rows.

    Each bucket of a band is first compared with one member only, the one with the most
    neighbours over all bands, which joins most groups of near copies. Members that this leaves in
    different components are then compared block by block, so no link between candidates
    is lost, no pair becomes a row unless it is a link, and a task holds two blocks at most.
    """
    spark = docs.sparkSession
    with rows_at_once(spark, TEXTS_AT_ONCE):
        sketched = written(sketches(docs, id_col, text_col, settings), "sketches")
    nodes = (
        sketched.filter(F.col("node").isNotNull())
        .groupBy("node")
        .agg(
            F.min(F.struct(*KEY)).alias("place"),
            F.any_value("size").alias("size"),
            F.any_value("bands").alias("bands"),
        )
    )
    banded = nodes.select(
        "node", "size", F.col("place._id").alias("_id"), F.posexplode("bands").alias("band", "bucket")
    )
    full = (
        banded.groupBy("band", "bucket").agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    )
    shared = written(banded.join(full, ["band", "bucket"]), "buckets")
    degrees = shared.groupBy("node").agg(F.sum("n").alias("degree"))
    ranked = shared.join(degrees, "node")
    hubs = ranked.groupBy("band", "bucket").agg(
        F.max_by("node", F.struct("degree", -F.col("_id"), "node")).alias("hub")
    )
    stars = cut(
        shared.join(hubs, ["band", "bucket"])
        .filter(F.col("node") != F.col("hub"))
        .select(F.col("node").alias("left"), F.col("hub").alias("right"))
        .distinct()
    )
    involved = shared.select("node").distinct().join(
        nodes.select("node", "bands", "place.*"), "node"
    )
    keyed = docs.select(*row_key(id_col, text_col), text_or_empty(text_col).alias("text"))
    texts = written(
        keyed.join(involved, KEY)
        .groupBy("node")
        .agg(F.any_value("text").alias("text"), F.any_value("bands").alias("bands")),
        "texts",
    )
    with rows_at_once(spark, TEXTS_AT_ONCE):
        links = cut(linked(stars, texts, settings))
    labels = components(links)
    labelled = shared.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    with rows_at_once(spark, TEXTS_AT_ONCE):
        more = cut(_across(labelled, texts, settings))
    if more.limit(1).count():
        labels = components(links.unionByName(more))
    grouped = sketched.join(labels, "node", "left").select(
        *KEY,
        # a text without words is named by its place, which no digest looks like
        F.coalesce(
            "label", "node", F.concat_ws(":", "_id", "_hash").cast("binary")
        ).alias("label"),
    )
    least = grouped.groupBy("label").agg(F.min(F.struct(*KEY)).alias("first"))
    return grouped.join(least, "label").select(
        *KEY,
        F.when(F.col("first._id") != NO_ID, F.col("first._id")).alias("class_id"),
        ((F.col("first._id") == F.col("_id")) & (F.col("first._hash") == F.col("_hash"))).alias("keeper"),
    )


def keep_one(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    settings: Settings = Settings(),
) -> DataFrame:
    """``docs`` with one document of each class, the one with the smallest id.

    All columns are kept. Of rows that repeat one another (same id and text) one stays.
    """
    keepers = classes(docs, id_col, text_col, settings).filter("keeper").select(*KEY).distinct()
    held = docs.select(F.struct(*docs.columns).alias("_row"), *row_key(id_col, text_col))
    first = held.groupBy(*KEY).agg(F.any_value("_row").alias("_row"))
    return first.join(keepers, KEY, "left_semi").select("_row.*")
