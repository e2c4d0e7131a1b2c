"""Quality rules whose cutoffs keep false rejections below a risk, in DataFrame operations only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billspark.llm.common import BLANK_RUN, BLANKS, UPPER, cut, text_or_empty

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"

#: What is measured of a text; a larger value is worse in each.
MEASURES = (
    "symbol_share",
    "dup_line_share",
    "repeat_share",
    "upper_share",
    "exclaim_share",
    "long_words",
    "few_types",
    "shortness",
)


@dataclass(frozen=True)
class Risk:
    """At most ``share`` of a stratum's good documents may be rejected by its cutoffs together, but
    for a chance of ``chance`` over all strata. ``steps`` cutoffs of each measure are tried."""

    share: float = 0.05
    chance: float = 0.05
    steps: int = 50


def _gone(text: Column, letters: str) -> Column:
    """How many characters of ``letters`` a text has."""
    return F.length(text) - F.length(F.translate(text, letters, ""))


def measured(docs: DataFrame, text_col: str = "text", window: int = 5) -> DataFrame:
    """Counts and measures of every text, computed inside its row.

    Adds ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` (long) and ``MEASURES``
    (double), replacing columns of these names; NULL and empty texts have zeros. A
    word in a repeated window is found by sorting the hashes of a text's own windows, and only in
    texts that have any window twice.
    """
    text = text_or_empty(text_col)
    words = F.filter(F.split(F.btrim(text, F.lit(BLANKS)), BLANK_RUN), lambda w: w != "")
    n = F.col("_n")
    hashes = F.transform(F.col("_words"), lambda w: F.xxhash64(w))
    windows = F.when(
        n >= window,
        F.transform(
            F.sequence(F.lit(0), n - window),
            lambda i: F.xxhash64(*[F.get(F.col("_hashes"), i + k) for k in range(window)]),
        ),
    )
    repeated = F.size(F.array_distinct("_windows")) < F.size("_windows")
    placed = F.when(
        F.col("_repeated"),
        F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    )
    same = lambda i, j: F.get("_placed", i)["h"] == F.get("_placed", j)["h"]
    starts = F.sort_array(
        F.filter(
            F.transform(
                F.col("_placed"),
                lambda x, i: F.when(
                    F.coalesce(same(i, i + 1), F.lit(False))
                    | F.when(i > 0, F.coalesce(same(i, i - 1), F.lit(False))).otherwise(False),
                    x["i"],
                ),
            ),
            lambda x: x.isNotNull(),
        )
    )
    # each repeated window covers the words up to the next one's start, five at most
    covered = F.aggregate(
        F.sequence(F.lit(0), F.size("_starts") - 1),
        F.lit(0),
        lambda total, i: total
        + F.least(
            F.lit(window),
            F.coalesce(
                F.get(F.col("_starts"), i + 1) - F.get(F.col("_starts"), i), F.lit(window)
            ),
        ),
    )
    lines = F.filter(
        F.split(text, "\n", -1), lambda x: F.length(F.translate(x, BLANKS, "")) > 0
    )
    names = [c for c in docs.columns if c not in {*COUNTS, *MEASURES}]
    chars, types = F.col("word_chars"), F.col("_types")
    per = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    counted = (
        docs.select(*names, words.alias("_words"), lines.alias("_lines"), text.alias("_text"))
        .withColumn("_n", F.size("_words"))
        .withColumn("_hashes", hashes)
        .withColumn("_windows", windows)
        .withColumn("_repeated", repeated)
        .withColumn("_placed", placed)
        .withColumn("_starts", F.when(F.col("_repeated"), starts))
        .select(
            *names,
            n.cast("long").alias("n_words"),
            F.length(F.translate("_text", BLANKS, "")).cast("long").alias("word_chars"),
            _gone(F.col("_text"), SYMBOLS).cast("long").alias("n_symbols"),
            (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
            F.when(F.col("_repeated"), covered).otherwise(0).cast("long").alias("n_repeat_words"),
            F.size("_lines").alias("_n_lines"),
            F.size(F.array_distinct("_hashes")).alias("_types"),
            _gone(F.col("_text"), UPPER).alias("_upper"),
            _gone(F.col("_text"), "!").alias("_exclaims"),
        )
    )
    words_n = F.col("n_words")
    return counted.select(
        *names,
        *COUNTS,
        per(F.col("n_symbols"), chars).alias("symbol_share"),
        per(F.col("n_dup_lines"), F.col("_n_lines")).alias("dup_line_share"),
        per(F.col("n_repeat_words"), words_n).alias("repeat_share"),
        per(F.col("_upper"), chars).alias("upper_share"),
        per(F.col("_exclaims"), words_n).alias("exclaim_share"),
        F.when(words_n > 0, F.least(chars / words_n / 50, F.lit(1.0))).otherwise(0.0).alias("long_words"),
        (1 - per(types, F.least(words_n, F.lit(200)))).alias("few_types"),
        (1 / (1 + words_n)).alias("shortness"),
    )


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_failed() -> Column:
    """Too short, or more than a fifth of the words in repeated windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """log P(X <= k) for X binomial (n, p), exactly, term by term in logarithms."""
    ratio = math.log(p / (1 - p))
    log = F.log
    first = n * math.log1p(-p)
    start = F.struct(first.alias("term"), first.alias("total"))

    def add(acc: Column, i: Column) -> Column:
        term = acc["term"] + log((n - i + 1) / i) + ratio
        high, low = F.greatest(acc["total"], term), F.least(acc["total"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("total"))

    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k.cast("long"))).otherwise(
        F.array().cast("array<bigint>")
    )
    return F.aggregate(steps, start, add, lambda acc: acc["total"])


def cutoffs(labelled: DataFrame, stratum: str, risk: Risk = Risk()) -> DataFrame:
    """``stratum, measure, cutoff, n_good, n_rejected`` chosen on labelled rows.

    ``labelled`` has ``doc_id``, the stratum, ``quality`` and ``MEASURES``. One half of the rows, by a
    hash of the id, puts cutoffs in order: those that reject fewer good rows first, then those
    that reject more bad ones, without those that add no bad row. On the other half the rules made
    of the first one, two, three and more of them are tested in that order, each with all of
    ``share`` and the stratum's part of ``chance``: were the rule's true false rejection rate above
    the share, as few rejections as were seen would have at most that chance. The tests end at the
    first rule that fails, so the number of rules costs nothing (fixed sequence), and a rule is
    bounded as a whole, not measure by measure. The last rule that holds is taken.

    ``n_good`` and ``n_rejected`` are counts of the tested half, for the whole rule. Strata in which
    no rule holds have no row: with no false rejection it takes log(chance / strata) / log(1 -
    share) good rows in the tested half.
    """
    steps = risk.steps
    rows = labelled.filter(F.col("quality").isNotNull()).select(
        F.col(stratum).alias("stratum"),
        (F.col("quality") == 1).alias("good"),
        (F.pmod(F.xxhash64(F.lit("half"), F.col("doc_id")), F.lit(2)) == 0).alias("tested"),
        F.array(
            *[F.ceil(F.least(F.col(m), F.lit(1.0)) * steps).cast("int") for m in MEASURES]
        ).alias("bins"),
    )
    rows = cut(rows)
    learnt = rows.filter(~F.col("tested"))
    # step s rejects values above s / steps, that is bins above s; bins are a fixed number
    counted = (
        learnt.select("stratum", "good", F.posexplode("bins").alias("measure", "bin"))
        .groupBy("stratum", "measure", "bin")
        .agg(
            F.sum(F.col("good").cast("long")).alias("good"),
            F.sum((~F.col("good")).cast("long")).alias("bad"),
        )
        .groupBy("stratum", "measure")
        .agg(F.collect_list(F.struct("bin", "good", "bad")).alias("counts"))
        .select("*", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("step"))
    )
    above = lambda name: F.aggregate(
        "counts",
        F.lit(0).cast("long"),
        lambda acc, b: acc + F.when(b["bin"] > F.col("step"), b[name]).otherwise(0),
    )
    # of neighbouring steps with the same counts the middle one: between good and bad rows
    tried = (
        counted.select("stratum", "measure", "step", above("good").alias("good"), above("bad").alias("bad"))
        .filter("bad > 0")
        .groupBy("stratum", "measure", "good", "bad")
        .agg(F.floor((F.min("step") + F.max("step")) / 2).cast("int").alias("step"))
        .groupBy("stratum")
        .agg(
            F.transform(
                F.sort_array(F.collect_list(F.struct("good", (-F.col("bad")).alias("bad"), "measure", "step"))),
                lambda x: F.struct(x["measure"].alias("measure"), x["step"].alias("step")),
            ).alias("order")
        )
    )
    # the place of the first cutoff that rejects a row; 0 if none does
    first = F.array_position(
        F.transform("order", lambda c: F.get("bins", c["measure"]) > c["step"]), True
    ).cast("int")
    useful = (
        learnt.filter(~F.col("good"))
        .join(tried, "stratum")
        .select("stratum", "order", first.alias("at"))
        .filter("at > 0")
        .groupBy("stratum")
        .agg(F.first("order").alias("order"), F.sort_array(F.collect_set("at")).alias("used"))
        .select("stratum", F.transform("used", lambda i: F.get("order", i - 1)).alias("order"))
    )
    tests = (
        rows.filter(F.col("tested") & F.col("good"))
        .join(useful, "stratum")
        .select("stratum", "order", first.alias("at"))
        .groupBy("stratum", "at")
        .agg(F.first("order").alias("order"), F.count(F.lit(1)).alias("n"))
        .groupBy("stratum")
        .agg(
            F.first("order").alias("order"),
            F.collect_list(F.struct("at", "n")).alias("counts"),
            F.sum("n").alias("n_good"),
        )
        .select("*", F.explode(F.sequence(F.lit(1), F.size("order"))).alias("length"))
        .withColumn(
            "n_rejected",
            F.aggregate(
                "counts",
                F.lit(0).cast("long"),
                lambda acc, c: acc + F.when(c["at"].between(1, F.col("length")), c["n"]).otherwise(0),
            ),
        )
    )
    n_strata = labelled.select(F.countDistinct(stratum)).first()[0]
    level = math.log(risk.chance / max(n_strata, 1))
    few = F.col("n_rejected") <= F.col("n_good") * risk.share
    safe = few & (
        binomial_tail(F.when(few, F.col("n_rejected")).otherwise(0), F.col("n_good"), risk.share)
        <= level
    )
    # rejections only grow along the order, so the rules that hold are the first ones
    return (
        tests.filter(safe)
        .groupBy("stratum")
        .agg(F.max_by(F.struct("order", "length", "n_good", "n_rejected"), "length").alias("best"))
        .select(
            "stratum",
            F.explode(F.slice("best.order", F.lit(1), F.col("best.length"))).alias("taken"),
            "best.n_good",
            "best.n_rejected",
        )
        .groupBy("stratum", "taken.measure")
        .agg(
            (F.min("taken.step") / steps).alias("cutoff"),
            F.first("n_good").alias("n_good"),
            F.first("n_rejected").alias("n_rejected"),
        )
        .withColumn("measure", F.element_at(F.array(*map(F.lit, MEASURES)), F.col("measure") + 1))
    )


def judge(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    stratum: str = "lang",
    risk: Risk = Risk(),
) -> DataFrame:
    """Counts, ``base_failed`` and ``kept`` for every row of ``docs``.

    A document is kept if it passes the base rule and no measure exceeds its stratum's cutoff. The
    risk is that of all cutoffs of a stratum together. Strata that labels say too little about have
    no cutoffs, so nothing but the base rule rejects there.
    A NULL stratum is one of its own; a NULL or empty text fails the base rule. With no
    labels only the base rule holds. Repeated labels of an id count once, as bad if any is.
    """
    keyed = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("_stratum"),
        F.col(text_col).alias("text"),
    )
    table = cut(measured(keyed).drop("text"))
    known = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
    )
    passing = table.filter(~base_failed())
    limits = (
        cutoffs(passing.join(known, "doc_id"), "_stratum", risk)
        .groupBy(F.col("stratum").alias("_stratum"))
        .agg(F.map_from_entries(F.collect_list(F.struct("measure", "cutoff"))).alias("_cutoffs"))
    )
    over = [
        F.coalesce(F.col(m) > F.col("_cutoffs")[m], F.lit(False)) for m in MEASURES
    ]
    rejected = over[0]
    for o in over[1:]:
        rejected = rejected | o
    return table.join(limits, "_stratum", "left").select(
        "doc_id",
        *COUNTS,
        base_failed().alias("base_failed"),
        (~base_failed() & ~rejected).alias("kept"),
    )
