"""Wide projections run in methods that the JVM compiles; cheaper OCR steps give the same values."""

import pytest
from pyspark.sql import functions as F

from billspark.functions.scalar import norm_text
from billspark.operators import ocr_layout
from billspark.operators.email_fields import extract_email
from billspark.operators.ocr_layout import anchor_values
from billspark.operators.text_fields import extract_bills
from billspark.session import COMPILED_METHOD_BYTES

LIMIT = "spark.sql.codegen.hugeMethodLimit"


@pytest.fixture
def limit(spark):
    before = spark.conf.get(LIMIT, None)
    spark.conf.unset(LIMIT)
    yield lambda: spark.conf.get(LIMIT)
    spark.conf.unset(LIMIT)
    if before is not None:
        spark.conf.set(LIMIT, before)


def _texts(spark):
    return spark.createDataFrame([(1, "water", "CARGO FIJO 710")], "doc_id long, service_type string, text string")


def test_long_methods_are_not_fused(spark, limit):
    extract_bills(_texts(spark), types=["gas"])
    assert int(limit()) == COMPILED_METHOD_BYTES
    spark.conf.unset(LIMIT)
    extract_email(spark.createDataFrame([("water", "a", "b")], "service_type string, subject string, body string"))
    assert int(limit()) == COMPILED_METHOD_BYTES
    spark.conf.unset(LIMIT)
    lines = ", ".join(f"{f} {t}" for f, t in [
        ("doc_id", "long"), ("page_idx", "int"), ("line_idx", "int"), ("text", "string"), ("norm", "string"),
        ("left", "double"), ("top", "double"), ("right", "double"), ("bottom", "double"),
    ])
    anchor_values(spark.createDataFrame([], lines))
    assert int(limit()) == COMPILED_METHOD_BYTES


def test_a_limit_of_the_owner_stands(spark, limit):
    spark.conf.set(LIMIT, "12345")
    extract_bills(_texts(spark))
    assert limit() == "12345"


def test_norms_of_plain_and_marked_text(spark):
    given = {
        "Total del MES: 5": "total del mes 5", "  ": "", "": "", None: None, "Alícuota\u00a0Nº": "alicuota no",
        "a\u0301b": "ab", "\u00d1AND\u00da": "nandu", "x\u007fy": "x y", "\uff21b": "ab",
    }
    rows = spark.createDataFrame([(k,) for k in given], "t string").select("t", norm_text(F.col("t")).alias("n"))
    assert {r.t: r.n for r in rows.collect()} == given


def test_token_bits(spark):
    tokens = ocr_layout._TOKENS
    given = ["", "zzz", tokens[0], tokens[-1], " ".join(tokens), f"{tokens[1]} {tokens[-1]}"]
    rows = spark.createDataFrame([(t,) for t in given], "t string")
    found = {r.t: r.b for r in rows.select("t", ocr_layout._tokens_held(F.col("t")).alias("b")).collect()}
    assert found == {t: sum(1 << i for i, k in enumerate(tokens) if k in t) for t in given}
