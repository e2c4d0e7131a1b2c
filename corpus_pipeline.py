"""From raw documents to packed training sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)``, works on all rows that the one before it kept, and returns
the columns of ``docs``; the last returns the pieces of the packed sequences. ``run`` writes what a
stage returns as Parquet in the shared folder and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from billspark.llm.common import KEY, documents, remainder, row_key, written
from billspark.llm.decontam import contaminated, phrase_hits
from billspark.llm.lines import drop_repeated_lines
from billspark.llm.neardup import keep_one
from billspark.llm.packing import pack, pieces
from billspark.llm.queries import vocabulary
from billspark.llm.toxicity import score_documents


def _packed(docs: DataFrame) -> DataFrame:
    """Id and text, and all other columns as one, which no operator's own columns can meet."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rest = F.struct(*others) if others else F.lit(None)
    return docs.select("doc_id", "text", rest.alias("_others"))


def _unpacked(packed: DataFrame, docs: DataFrame) -> DataFrame:
    own = ("doc_id", "text")
    return packed.select(*[F.col(c) if c in own else F.col(f"_others.{c}").alias(c) for c in docs.columns])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below 0.5."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score_documents(_packed(docs), labels, remainder() == 0)
    return _unpacked(scored.filter(F.col("score") < 0.5), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that many of them repeat; ``n_chars`` follows the text."""
    kept = _unpacked(drop_repeated_lines(_packed(docs)), docs)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each near-duplicate class."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    hits = phrase_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = hits.filter(contaminated(F.col("n_hit"), F.col("n_words"))).select(*KEY)
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), *row_key())
    return keyed.join(bad, KEY, "left_anti").select("_row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences."""
    return pack(pieces(docs, vocabulary()))


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Scores, sketches and token ids cannot be had in SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
