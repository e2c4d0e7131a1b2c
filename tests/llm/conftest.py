"""Small tables with everything that real ones hold by accident."""

import pytest
from pyspark.sql import functions as F

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho".split()

#: Columns named like those that the operators make for themselves.
CLASHING = ("_id", "_hash", "_row", "n_words", "n_lines", "n_dropped", "score", "word", "node", "class_id", "kept")


def sentence(k: int, n: int = 12) -> str:
    return " ".join(WORDS[(k * 7 + i * (k % 5 + 1)) % len(WORDS)] + str((k + i) % 9) for i in range(n))


def rows() -> list[tuple]:
    """``doc_id, text``: missing, empty, blank, short, long, tied, repeated and near texts."""
    long = "\n".join(sentence(k) for k in range(400))
    shared = "This very line is shared by several of the documents."
    near = [sentence(k, 40) for k in range(3)]
    out = [(0, None), (1, ""), (2, " \t\n\r "), (3, "one two"), (4, long), (5, long), (None, "no id at all")]
    out += [(10 + k, f"{sentence(k)}\n{shared}\n{sentence(k + 50)}") for k in range(5)]
    out += [(20, near[0]), (21, near[0]), (22, near[0].replace("alpha", "changed", 1)), (23, near[1])]
    out += [(30, "repeated row"), (30, "repeated row"), (31, "Ünïcode Wörter " * 8 + "\x1c\x85 end")]
    return out


@pytest.fixture(scope="session")
def odd(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string")
    for name in CLASHING:
        df = df.withColumn(name, F.lit("clash"))
    return df.withColumn("lang", F.lit("en")).withColumn("source", F.lit(None).cast("string"))


@pytest.fixture(scope="session")
def plain():
    return rows()


def collected(df) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]
