"""The registered queries of this folder and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from billspark.llm.alignment import align_documents
from billspark.llm.bestfit import pack_best_fit, whole_pieces
from billspark.llm.common import KEY, NO_ID, documents, remainder, row_key
from billspark.llm.decontam import contaminated, phrase_hits
from billspark.llm.divergence import audit_sources, audit_sql
from billspark.llm.licenses import license_sql, scan_licenses
from billspark.llm.lines import drop_repeated_lines
from billspark.llm.neardup import classes
from billspark.llm.packing import pack, pieces
from billspark.llm.quality import judge
from billspark.llm.scoring import score_documents
from billspark.llm.secrets import find_secrets
from billspark.llm.substrings import remove_repeats
from billspark.llm.toxicity import score_documents as toxicity_scores

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Place of a public vocabulary file; the same on all machines."""
    import public_tokenizers

    return public_tokenizers.path(name)


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return keep


@register("op1_lm_scoring")
def lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir), remainder() == 1)


@register("op2_license_scan", license_sql())
def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir))


@register("op3_quality_rules")
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@register("op4_toxicity")
def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = remainder() == 0
    scored = toxicity_scores(documents(spark, sf_dir), labels, held_out)
    return scored.select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@register("op5_decontamination")
def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    hits = phrase_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return (
        docs.select("doc_id", *row_key())
        .join(hits.drop("spans"), KEY)
        .select(
            "doc_id",
            "n_words",
            "n_hit",
            F.size(items).cast("long").alias("n_items"),
            F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
            contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
        )
    )


@register("op6_near_duplicates")
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(documents(spark, sf_dir)).select(
        F.when(F.col("_id") != NO_ID, F.col("_id")).alias("doc_id"), "class_id"
    )


@register("op7_suffix_dedup")
def suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).drop("kept")


@register("op8_packing")
def packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(documents(spark, sf_dir), vocabulary()))


@register("op9_secret_scan")
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(documents(spark, sf_dir))
    of = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    kinds = {k: of(k) for k in ("assign", "access", "hex")}
    joined = lambda spans: F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )
    base = joined(F.filter("spans", lambda s: s["kind"].isin(*kinds)))
    return found.select(
        "doc_id",
        *[F.size(v).cast("long").alias(f"n_{k}") for k, v in kinds.items()],
        F.sha2(base.cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


BLANKS_SQL = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
UPPER_SQL = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


@register(
    "op10_line_dedup",
    f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
    a AS (SELECT r, doc_id, string_split(t, chr(10)) AS ls FROM d),
    l AS (SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM a),
    k AS (SELECT r, doc_id, pos, line, translate(trim(line, {BLANKS_SQL}), {UPPER_SQL}) AS key FROM l),
    g AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20
          GROUP BY key HAVING count(DISTINCT r) >= 3),
    m AS (SELECT k.*, coalesce(g.keeper <> k.doc_id, false) AS gone FROM k LEFT JOIN g ON g.key = k.key)
    SELECT any_value(doc_id) AS doc_id, CAST(count(*) AS BIGINT) AS n_lines,
           CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
    FROM m GROUP BY r
    """,
)
def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_repeated_lines(documents(spark, sf_dir))
    return kept.select(
        "doc_id", "n_lines", "n_dropped",
        F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"),
    )


@register("op11_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_best_fit(whole_pieces(documents(spark, sf_dir), vocabulary()))


@register("op12_source_divergence", audit_sql())
def source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(documents(spark, sf_dir))


@register("op13_cross_tokenizer_alignment")
def cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_documents(
        documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
    )
