"""The secret query's base columns against the plain patterns, on texts full of near misses."""

import hashlib
import random
import re

from billspark.llm.queries import QUERIES
from tests.llm.conftest import collected

PATTERNS = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile("[0-9a-f]+"), 0, 24),
]


def base(text):
    spans = [
        (m.start(), order, kind, m.end())
        for order, (kind, pattern, group, least) in enumerate(PATTERNS)
        for m in pattern.finditer(text or "")
        if len(m.group(group)) >= least
    ]
    return [f"{kind}:{start}:{end}" for start, _, kind, end in sorted(spans)]


def texts(n=250):
    draw = random.Random(8)
    pieces = [
        "password", "PassWd", "Secret", "tokeN", "api_key", "APIKEY", "paſſword", "toKen", '"', "'", " ", "  ", ":", "=",
        "\n", "\t", "é", "abcdef", "abcde", "x+/_.=-9", "AKIA", "AKIA" + "B" * 15, "AKIA" + "B" * 16, "0123456789abcdef" * 2,
        "deadbeef" * 3, "deadbee", "g", "日本", "",
    ]
    return ["".join(draw.choice(pieces) for _ in range(draw.randint(0, 14))) for _ in range(n)]


def test_base_columns_match_the_patterns(spark, tmp_path):
    rows = [*enumerate(texts()), (900, None), (901, ""), (None, "token=abcdefgh"), (902, "twice secret: abcdefg"), (902, "twice secret: abcdefg")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = collected(QUERIES["op9_secret_scan"](spark, str(tmp_path)))
    key = lambda r: (str(r[0]), r[1:])
    want = []
    for doc, text in rows:
        spans = base(text)
        counts = [sum(s.startswith(f"{kind}:") for s in spans) for kind, *_ in PATTERNS]
        want.append((doc, *counts, hashlib.sha256(",".join(spans).encode()).hexdigest()))
    assert sorted([(r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in got], key=key) == sorted(want, key=key)
    everything = {r["doc_id"]: r["spans"].split(",") for r in got}
    assert all(set(base(text)) <= set(everything[doc]) for doc, text in rows)
    assert sum(w[1] for w in want) > 10 and sum(w[2] for w in want) > 10 and sum(w[3] for w in want) > 10
