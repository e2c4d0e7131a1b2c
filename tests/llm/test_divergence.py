"""Source divergence against the same counts in plain Python and in SQL."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from billspark.llm import divergence
from tests.llm.conftest import collected

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_force(rows, least=10, top=10):
    """``rows`` are ``(text, lang, source)``."""
    rows = [tuple(x or "" for x in r) for r in rows]
    found, groups = defaultdict(Counter), set()
    documents = defaultdict(Counter)
    for text, lang, source in rows:
        groups.add((lang, source))
        terms = TERM.findall(text.translate(LOWER))
        found[lang, source].update(terms)
        documents[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in documents[lang].items() if n >= least)
        sources = sorted(s for a, s in groups if a == lang)

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (count[t] + 2) // (total + 2 * len(kept)) for t in kept}

        whole = shares(sum((found[lang, s] for s in sources), Counter()))
        each = {s: shares(found[lang, s]) for s in sources}

        def apart(p, q):
            return (p - q) * (p - q) // (p + q)

        for s in sources:
            p = each[s]
            pairs = [(x, sum(apart(p[t], each[x][t]) for t in kept)) for x in sources if x != s]
            terms = [(t, apart(p[t], whole[t])) for t in kept if found[lang, s][t] and p[t] > whole[t]]
            for part, items, limit in (("pair", pairs, None), ("term", terms, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, k) for k, (i, v) in enumerate(items[:limit], 1)]
    return sorted(out)


def texts(n=240):
    draw = random.Random(4)
    words = "The quick brown fox JUMPS naïve straße данные 日本語 abcdefgh abcdefghi abcdefghijklmnop".split()
    words += ["q" * 17, "r" * 40, "Z" * 100, "y" * 200, "é" * 300, "é" * 301]
    rows = []
    for i in range(n):
        lang, source = draw.choice(["en", "de"]), draw.choice(["a", "b", "B", "ä", None])
        some = words[: 6 + len(source or "") + i % 7] + words[-6:]
        rows.append((draw.choice([" ", "\n", "1", "[", "`"]).join(draw.choice(some) for _ in range(draw.randint(0, 30))), lang, source))
    rows += [(None, "en", "silent"), ("", "fr", "one"), ("few words", "fr", "two"), ("alone", None, None)]
    return rows


def result(df):
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in collected(df))


SCHEMA = "text string, lang string, source string"


@pytest.mark.parametrize("limits", [{}, {"source_block": 2, "term_block": 3}])
def test_rows_match_brute_force(spark, limits):
    rows = texts()
    table = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert result(divergence.audit_sources(table, **limits)) == by_force(rows)


def test_sql_gives_the_same_rows(spark):
    rows = texts()
    documents = spark.createDataFrame(rows, SCHEMA).toArrow()  # noqa: F841
    got = duckdb.sql(divergence.audit_sql()).fetchall()
    assert sorted(got) == by_force(rows)


def test_odd_and_empty_tables(spark, odd):
    rows = [(r["text"], r["lang"], r["source"]) for r in collected(odd)]
    assert result(divergence.audit_sources(odd, least_docs=3)) == by_force(rows, 3)
    assert divergence.audit_sources(odd.limit(0)).count() == 0


def test_batches_and_long_texts_count_alike(spark):
    rows = [(" ".join(t or "" for t, _, _ in texts(80)) * 3, "en", "long"), *texts(60)]
    table = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    wanted = Counter()
    for text, lang, source in rows:
        for term, n in Counter(TERM.findall((text or "").translate(LOWER))).items():
            wanted[lang or "", source or "", term, "n"] += n
            wanted[lang or "", source or "", term, "docs"] += 1
    for size in (200, 2**24):
        got = Counter()
        for r in collected(divergence.term_counts(table, batch_bytes=size)):
            got[r["lang"], r["source"], r["term"], "n"] += r["n"]
            got[r["lang"], r["source"], r["term"], "docs"] += r["docs"]
        assert got == wanted


def test_radix_order_is_stable_and_sorted():
    draw = np.random.default_rng(1)
    words = [draw.integers(0, 2**63, 500).astype(np.uint64) >> np.uint64(k) for k in (40, 0)]
    words[0][::3] = words[0][0]
    words[1][::2] = words[1][0]
    order = divergence.radix_order(words)
    rows = list(zip(words[0].tolist(), words[1].tolist(), range(500)))
    assert [rows[i] for i in order] == sorted(rows)


def test_shares_of_large_counts_are_exact(spark):
    from pyspark.sql import functions as F

    n, total, kept = 10**12 + 7, 10**15 + 3, 10**7
    got = spark.range(1).select(divergence.share(F.lit(n), F.lit(total), F.lit(kept)).alias("p")).first().p
    assert got == 1 + 10**9 * (n + 2) // (total + 2 * kept)
