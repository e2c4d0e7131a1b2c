"""How the sources of a language differ in their words.

Terms are counted in tasks by packing them into machine words: a term of up to eight bytes is one
unsigned 64-bit number, one of up to sixteen bytes two, and these are radix-sorted and their runs
counted. Longer terms stand in buckets of similar length and are sorted by their bytes. Spark adds the
counts up, keeps the terms that enough documents of a language have, and compares the sources.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from billspark.llm.common import written

COUNTED = "lang string, source string, term string, n long, docs long"
#: Widths of the buckets for long terms; a term that exceeds them all is sorted as it is.
WIDTHS = (32, 64, 128, 256)
#: Languages and groups are joined with their totals in so many shares, as one of them may hold most rows.
SHARES = 128

# Letters of terms by byte: A-Z and a-z, and all bytes of characters outside ASCII.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_TERM = np.zeros(256, bool)
_IN_TERM[65:91] = _IN_TERM[97:123] = _IN_TERM[128:] = True
# the first k bytes of a big-endian word
_FIRST = np.array([0, *[(2**64 - 1) ^ (2 ** (64 - 8 * k) - 1) for k in range(1, 9)]], dtype=np.uint64)


# ------------------------------------------------------------------ sorting and counting
def radix_order(words: list[np.ndarray]) -> np.ndarray:
    """A stable order by unsigned 64-bit words, most significant word first.

    Sixteen bits at a time from the least significant on; digits that all rows share are passed over.
    """
    order = np.arange(len(words[0]))
    for word in reversed(words):
        spread = np.bitwise_or.reduce(word ^ word[0]) if len(word) else np.uint64(0)
        for shift in (0, 16, 32, 48):
            if not (int(spread) >> shift) & 0xFFFF:
                continue
            digit = ((word >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16)
            order = order[np.argsort(digit[order], kind="stable")]
    return order


def _runs(words: list[np.ndarray], doc: np.ndarray, n: np.ndarray):
    """Rows ``words, n, docs`` of each distinct key: occurrences and distinct documents.

    ``doc`` ascends wherever rows are equal, because rows come in the order of their documents.
    """
    order = radix_order(words)
    words = [w[order] for w in words]
    doc, n = doc[order], n[order]
    new = np.zeros(len(order), bool)
    new[:1] = True
    for w in words:
        new[1:] |= w[1:] != w[:-1]
    first = np.flatnonzero(new)
    other = new.copy()
    other[1:] |= doc[1:] != doc[:-1]
    return first, words, np.add.reduceat(n, first), np.add.reduceat(other.astype(np.int64), first)


def _byte_runs(group: np.ndarray, terms: np.ndarray, doc: np.ndarray):
    """The same for long terms of one bucket: groups and padded bytes."""
    order = np.argsort(terms, kind="stable")
    order = order[np.argsort(group[order], kind="stable")]
    group, terms, doc = group[order], terms[order], doc[order]
    new = np.ones(len(order), bool)
    new[1:] = (terms[1:] != terms[:-1]) | (group[1:] != group[:-1])
    first = np.flatnonzero(new)
    other = new.copy()
    other[1:] |= doc[1:] != doc[:-1]
    sizes = np.diff(np.append(first, len(order)))
    return group[first], terms[first], sizes, np.add.reduceat(other.astype(np.int64), first)


def _text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and where each text starts and the last ends."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def _terms(raw: np.ndarray, ends: np.ndarray):
    """Starts, lengths and documents of all terms; ``ends`` are the borders of the texts."""
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = _IN_TERM[raw]
    begins = inside[1:-1] & ~inside[:-2]
    stops = inside[1:-1] & ~inside[2:]
    filled = ends[:-1][np.diff(ends) > 0]
    begins[filled] = inside[1:-1][filled]  # no term goes on over the border of a text
    after = filled[filled > 0] - 1
    stops[after] = inside[1:-1][after]
    at = np.flatnonzero(begins)
    lengths = np.flatnonzero(stops) + 1 - at
    doc = np.searchsorted(ends, at, side="right") - 1
    return at, lengths, doc


def count_terms(raw: np.ndarray, ends: np.ndarray, group: np.ndarray) -> Iterator[tuple]:
    """``group numbers, terms as bytes, occurrences, documents`` of texts, one bucket of lengths at a time.

    ``group`` has the group of each text. A group and a term occur once in what is given.
    """
    lowered = np.zeros(len(raw) + 16, np.uint8)
    lowered[: len(raw)] = _LOWER[raw]
    word_at = np.ndarray((len(raw) + 9,), ">u8", lowered, 0, (1,))
    at, lengths, doc = _terms(raw, ends)

    for least, most in ((1, 8), (9, 16)):
        chosen = (lengths >= least) & (lengths <= most)
        if not chosen.any():
            continue
        a, k, d = at[chosen], lengths[chosen], doc[chosen]
        words = [word_at[a].astype(np.uint64) & _FIRST[np.minimum(k, 8)]]
        if most > 8:
            words.append(word_at[a + 8].astype(np.uint64) & _FIRST[k - 8])
        g = group[d]
        first, words, n, docs = _runs([g.astype(np.uint64), *words], d, np.ones(len(a), np.int64))
        packed = np.stack([w[first] for w in words[1:]], axis=1).astype(">u8")
        yield words[0][first].astype(np.int64), packed.view(f"S{most}").ravel().tolist(), n, docs

    least = 17
    for width in WIDTHS:
        chosen = (lengths >= least) & (lengths <= width)
        least = width + 1
        if not chosen.any():
            continue
        a, k, d = at[chosen], lengths[chosen], doc[chosen]
        padded = np.zeros((len(a), width), np.uint8)
        for j in range(width):
            padded[:, j] = np.where(j < k, lowered[np.minimum(a + j, len(raw))], 0)
        g, terms, n, docs = _byte_runs(group[d], padded.view(f"S{width}").ravel(), d)
        yield g, terms.tolist(), n, docs
    chosen = np.flatnonzero(lengths >= least)
    if len(chosen):
        rows = sorted(
            (int(group[doc[i]]), lowered[at[i] : at[i] + lengths[i]].tobytes(), int(doc[i])) for i in chosen
        )
        g, terms, n, docs = [], [], [], []
        previous: tuple = ()
        for row in rows:
            if row[:2] != previous[:2]:
                g.append(row[0]), terms.append(row[1]), n.append(0), docs.append(0)
                previous = ()
            n[-1] += 1
            docs[-1] += row != previous
            previous = row
        yield np.array(g), terms, np.array(n), np.array(docs)


def _one_text(raw: np.ndarray, slice_bytes: int) -> Iterator[tuple]:
    """The same for one long text, cut between terms into slices whose counts are added up."""
    total: dict[bytes, int] = {}
    outside = np.flatnonzero(~_IN_TERM[raw])
    start = 0
    while start < len(raw):
        k = np.searchsorted(outside, start + slice_bytes)
        stop = int(outside[k]) + 1 if k < len(outside) else len(raw)
        part = raw[start:stop]
        for _, terms, n, _ in count_terms(part, np.array([0, len(part)]), np.zeros(1, np.int64)):
            for term, times in zip(terms, n.tolist()):
                total[term] = total.get(term, 0) + times
        start = stop
    yield np.zeros(len(total), np.int64), list(total), list(total.values()), np.ones(len(total), np.int64)


def term_counts(docs: DataFrame, batch_bytes: int = 2**23) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and documents of each term in each group, in parts.

    Texts are taken together up to ``batch_bytes`` and counted at once, whole texts always; a group and
    a term come once for each such batch. Missing texts, languages and sources are empty.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            keys: dict[tuple, int] = {}
            pairs = list(zip(table.column(0).to_pylist(), table.column(1).to_pylist()))
            group = np.array([keys.setdefault(p, len(keys)) for p in pairs], np.int64)
            known = list(keys)
            langs = pa.array([k[0] for k in known], pa.string())
            sources = pa.array([k[1] for k in known], pa.string())
            raw, ends = _text_buffer(table.column(2).combine_chunks())
            counted = count_terms(raw, ends, group) if len(raw) <= batch_bytes else _one_text(raw, batch_bytes)
            for g, terms, n, found in counted:
                g = pa.array(g, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        langs.take(g), sources.take(g), pa.array(terms, pa.binary()).cast(pa.string()),
                        pa.array(n, pa.int64()), pa.array(found, pa.int64()),
                    ],
                    ["lang", "source", "term", "n", "docs"],
                )

        for batch in batches:
            # a batch may hold large texts: take as many rows as fit, one at least
            lengths = pc.binary_length(batch.column(2)).to_pylist()
            start = 0
            for i, length in enumerate(lengths):
                if size and size + length > batch_bytes:
                    held.append(batch.slice(start, i - start))
                    yield from flush()
                    held.clear()
                    start, size = i, 0
                size += length
            held.append(batch.slice(start))
        if held:
            yield from flush()

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return docs.select(text("lang"), text("source"), text("text")).mapInArrow(count, COUNTED)


# ------------------------------------------------------------------------ comparing sources
def _whole(number: Column) -> Column:
    return number.cast("decimal(38,0)")


def share(n: Column, total: Column, kept: Column) -> Column:
    """``1 + floor(10^9 (n + 2) / (total + 2 kept))``, exact for any count."""
    above = _whole(F.lit(1_000_000_000)) * (n.cast("decimal(22,0)") + F.lit(2).cast("decimal(1,0)"))
    below = total.cast("decimal(22,0)") + kept.cast("decimal(20,0)") * F.lit(2).cast("decimal(1,0)")
    return F.lit(1).cast("long") + F.call_function("div", _whole(above), _whole(below))


def distance(p: Column, q: Column) -> Column:
    """``floor((p - q)^2 / (p + q))``: the square of a difference up to 10^9 fits a long."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _with_totals(rows: DataFrame, totals: DataFrame, on: list[str], by: Column) -> DataFrame:
    """``rows`` with the columns of their totals; each total is sent to ``SHARES`` places, rows to one."""
    spread = totals.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    placed = rows.withColumn("_share", F.pmod(F.xxhash64(by), F.lit(SHARES)).cast("int"))
    return placed.join(spread, [*on, "_share"]).drop("_share")


def _pair_sums(size: int):
    """A function from one cell (two blocks of sources, one block of terms) to sums over its pairs.

    Rows with a term hold the share of the term in a source; rows without one name a source and the
    share of a term that it lacks.
    """

    def add_up(key: tuple, table: pa.Table) -> pa.Table:
        lang, left, right = (k.as_py() for k in key[:3])
        terms = table.column("term")
        named = pc.is_null(terms)
        heads = table.filter(named)
        rows = table.filter(pc.invert(named))
        sources = heads.column("source").to_pylist()
        blocks = np.array(heads.column("block").to_pylist(), np.int64)
        default = heads.column("p").to_numpy().astype(np.int64)
        at = {s: i for i, s in enumerate(sources)}
        code = rows.column("term").combine_chunks().dictionary_encode()
        column = code.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.array([at[s] for s in rows.column("source").to_pylist()], np.int64)
        p = rows.column("p").to_numpy().astype(np.int64)
        order = np.argsort(column, kind="stable")
        row, column, p = row[order], column[order], p[order]
        width = len(code.dictionary)
        sums = np.zeros((len(sources), len(sources)), np.int64)
        for low in range(0, width, size):
            a, b = np.searchsorted(column, [low, min(low + size, width)])
            dense = np.repeat(default[:, None], min(size, width - low), axis=1)
            dense[row[a:b], column[a:b] - low] = p[a:b]
            for i in range(len(sources)):
                gap = dense - dense[i]
                sums[i] += (gap * gap // (dense + dense[i])).sum(axis=1)
        mine, others = np.nonzero(
            ~np.eye(len(sources), dtype=bool)
            & (
                ((blocks[:, None] == left) & (blocks[None, :] == right))
                | ((blocks[:, None] == right) & (blocks[None, :] == left))
            )
        )
        return pa.table(
            {
                "lang": pa.array([lang] * len(mine), pa.string()),
                "source": pa.array([sources[i] for i in mine], pa.string()),
                "item": pa.array([sources[i] for i in others], pa.string()),
                "value": pa.array(sums[mine, others], pa.int64()),
            }
        )

    return add_up


def audit_sources(
    docs: DataFrame,
    least_docs: int = 10,
    top: int = 10,
    source_block: int = 64,
    term_block: int = 4096,
) -> DataFrame:
    """``lang, source, part, item, value, rank``: how far apart the sources of a language are, and by what.

    Part ``pair`` has every other source of the language with the sum of the distances over all kept
    terms; part ``term`` the ``top`` terms that a source has more of than its language. Kept terms
    stand in at least ``least_docs`` documents of the language; repeated rows are documents of their
    own. A source without terms is compared like any other; a language without kept terms has pairs of
    value 0; one source alone has no pair; ties go to the smaller item by its UTF-8 bytes; an empty table gives
    an empty table. Other columns of ``docs`` are not looked at.

    Sums over pairs are made in cells of two blocks of about ``source_block`` sources and a block of
    about ``term_block`` terms, so a task holds no more than that, whatever the number of
    sources, terms or rows. The counts are written to the shared folder once, before they are used
    several times.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    groups = docs.select(text("lang"), text("source")).distinct()
    counted = written(
        term_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")),
        "term-counts",
    )
    kept = written(
        counted.groupBy("lang", "term")
        .agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("_docs"))
        .filter(F.col("_docs") >= least_docs)
        .drop("_docs"),
        "kept-terms",
    )
    lang_totals = kept.groupBy("lang").agg(
        F.sum(F.col("lang_n").cast("decimal(28,0)")).cast("long").alias("lang_total"),
        F.count(F.lit(1)).alias("kept"),
    )
    with_q = _with_totals(kept, lang_totals, ["lang"], F.col("term")).select(
        "lang", "term", "kept", share(F.col("lang_n"), F.col("lang_total"), F.col("kept")).alias("q")
    )
    own = written(
        counted.select("lang", "source", "term", "n").join(with_q, ["lang", "term"]), "kept-counts"
    )
    blocks = F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / F.lit(source_block))).cast("int")
    per_lang = groups.groupBy("lang").agg(blocks.alias("blocks"))
    sums = own.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    totals = written(
        groups.join(sums, ["lang", "source"], "left")
        .join(per_lang, "lang")
        .join(lang_totals.select("lang", "kept"), "lang", "left")
        .select(
            "lang", "source", F.coalesce("total", F.lit(0)).alias("total"),
            F.coalesce("kept", F.lit(0)).alias("kept"), "blocks",
            F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int").alias("block"),
            F.greatest(F.lit(1), F.ceil(F.coalesce("kept", F.lit(0)) / F.lit(term_block))).cast("int").alias("slices"),
        ),
        "source-totals",
    )
    shares = _with_totals(own.drop("kept"), totals, ["lang", "source"], F.col("term")).withColumn(
        "p", share(F.col("n"), F.col("total"), F.col("kept"))
    )

    # every row goes to the cells of its block with each block; a source's own row to all slices of terms
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    cells = [
        F.least("block", "_other").alias("left"), F.greatest("block", "_other").alias("right"),
    ]
    rows = shares.withColumn("_other", other).select(
        "lang", *cells, F.pmod(F.xxhash64("term"), F.col("slices")).cast("int").alias("slice"),
        "source", "block", "term", "p",
    )
    absent = F.when(
        F.col("total") + F.col("kept") > 0, share(F.lit(0), F.col("total"), F.col("kept"))
    ).otherwise(F.lit(1).cast("long"))
    heads = (
        totals.withColumn("_other", other)
        .withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
        .select("lang", *cells, "slice", "source", "block", F.lit(None).cast("string").alias("term"), absent.alias("p"))
    )
    pairs = (
        rows.unionByName(heads)
        .groupBy("lang", "left", "right", "slice")
        .applyInArrow(_pair_sums(term_block), "lang string, source string, item string, value long")
        .groupBy("lang", "source", "item")
        .agg(F.sum("value").alias("value"))
        .withColumn("part", F.lit("pair"))
    )
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    more = (
        shares.filter((F.col("n") > 0) & (F.col("p") > F.col("q")))
        .select(
            "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
            distance(F.col("p"), F.col("q")).alias("value"),
        )
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= top)
    )
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(*columns).unionByName(more.select(*columns))


def _letter_sql() -> str:
    return r"'[^\x00-\x40\x5B-\x60\x7B-\x7F]+'"


def audit_sql(least_docs: int = 10, top: int = 10) -> str:
    """The same rows in SQL over ``documents``."""
    p = "1 + ((n + 2)::HUGEINT * 1000000000) // (total + 2 * v)::HUGEINT"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                      coalesce(text, '') AS t FROM documents),
    w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                 'abcdefghijklmnopqrstuvwxyz'), {_letter_sql()})) AS term FROM d),
    k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= {least_docs}),
    l AS (SELECT lang, sum(n) AS total, count(*) AS v FROM k GROUP BY lang),
    q AS (SELECT k.lang, k.term, {p} AS q FROM k JOIN l ON k.lang = l.lang),
    g AS (SELECT DISTINCT lang, source FROM d),
    c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN k ON k.lang = w.lang AND k.term = w.term
          GROUP BY ALL),
    s AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
    gt AS (SELECT g.lang, g.source, coalesce(s.total, 0) AS total, l.v
           FROM g JOIN l ON l.lang = g.lang LEFT JOIN s ON s.lang = g.lang AND s.source = g.source),
    full_rows AS (SELECT gt.lang, gt.source, q.term, q.q, coalesce(c.n, 0) AS n, gt.total, gt.v
                  FROM gt JOIN q ON q.lang = gt.lang
                  LEFT JOIN c ON c.lang = gt.lang AND c.source = gt.source AND c.term = q.term),
    ps AS (SELECT lang, source, term, n, q, {p} AS p FROM full_rows),
    pv AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
           FROM ps a JOIN ps b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    pa AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(pv.value, 0) AS value
           FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
           LEFT JOIN pv ON pv.lang = x.lang AND pv.source = x.source AND pv.item = y.source),
    te AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value
           FROM ps WHERE n > 0 AND p > q),
    u AS (SELECT * FROM pa UNION ALL SELECT * FROM te),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part
               ORDER BY value DESC, encode(item)) AS rank FROM u)
    SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
    FROM ranked WHERE part = 'pair' OR rank <= {top}
    """
