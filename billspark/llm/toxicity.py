"""Toxicity of clauses, by weighted transducers whose weights are learnt from labels."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billspark.llm.common import NO_ID, TEXTS_AT_ONCE, row_key, rows_at_once, text_or_empty, written

#: Closed classes of the grammar, in English, French, German and Spanish.
TARGETS = frozenset(
    "you your yours yourself u ur he she they him her them he's she's they're you're"
    " tu te toi vous il elle ils elles lui leur ton ta tes votre vos"
    " du dich dir dein deine deiner ihr euch euer sie er ihn ihm ihnen"
    " tú ti usted ustedes vosotros él ella ellos ellas tus vuestro vuestra".split()
)
NEGATIONS = frozenset(
    "not no never nobody nothing neither nor isn't aren't wasn't weren't don't doesn't didn't"
    " ne pas jamais aucun aucune ni nicht kein keine keinen nie niemals ningún ninguno ninguna"
    " nunca jamás tampoco".split()
)
REPORTS = frozenset(
    "said says say wrote writes claimed claims called calls alleged alleges quoted quotes"
    " accused reported reportedly according dit disait écrit affirme sagte sagt schrieb behauptet"
    " nannte dijo dice escribió afirma llamó".split()
)
THREATS = frozenset(
    "kill hurt destroy burn beat shoot stab smash murder die dead tuer frapper détruire mourir"
    " töten schlagen vernichten sterben matar golpear destruir morir".split()
)
#: Ends of clauses.
CLAUSE = re.compile(r"[.!?;:\n]+")
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")

#: Longest stem that is learnt; longer words are met through their stems.
STEM = 8


@dataclass(frozen=True)
class Grammar:
    """Weights of the transducers and of the output.

    ``stems`` map the beginnings of words to weights (log odds that a text with such a word is
    toxic), each with how much of a word has to match. The other weights scale an
    insult where the clause's state says so.
    """

    stems: dict[str, float]
    addressed: float = 1.25
    threatened: float = 1.5
    negated: float = 0.5
    reported: float = 0.7
    bias: float = -3.0
    slope: float = 1.0


def longest_stem(word: str, stems: dict[str, float]) -> float:
    """The insult transducer: the weight of the longest known beginning, with $ as the word's end."""
    found = stems.get(word + "$")
    if found is not None:
        return found
    for n in range(min(STEM, len(word)), 2, -1):
        found = stems.get(word[:n])
        if found is not None:
            return found
    return 0.0


def clause_weight(words: list[str], grammar: Grammar, memo: _Weights) -> float:
    """Run the composed transducers over a clause.

    The state is (addressed, threatened, negated, reported). A target, threat, negation or report
    word changes it; an insult adds its weight, scaled by the state in which it is first
    read. A negation holds for the next three words, the others to the clause's end.
    """
    weights = [memo[w] for w in words]
    if not any(weights):
        return 0.0
    total, negated_left = 0.0, 0
    seen: set[str] = set()
    addressed = threatened = reported = False
    for word, weight in zip(words, weights):
        if weight > 0 and word not in seen:
            seen.add(word)
            scale = 1.0
            if addressed:
                scale *= grammar.addressed
            if threatened:
                scale *= grammar.threatened
            if negated_left:
                scale *= grammar.negated
            if reported:
                scale *= grammar.reported
            total += weight * scale
        if negated_left:
            negated_left -= 1
        if word in NEGATIONS:
            negated_left = 3
        elif word in TARGETS:
            addressed = True
        elif word in REPORTS:
            reported = True
        elif word in THREATS:
            threatened = True
    return total


def text_weight(text: str, grammar: Grammar, memo: _Weights) -> float:
    """The weight of a text: its heaviest clause and, halved each time, the next ones."""
    weights = []
    for clause in CLAUSE.split(text.lower()):
        weight = clause_weight(WORD.findall(clause), grammar, memo)
        if weight:
            weights.append(weight)
    weights.sort(reverse=True)
    return sum(w * 0.5**i for i, w in enumerate(weights[:32]))


def probability(weight: float, grammar: Grammar) -> float:
    z = grammar.bias + grammar.slope * weight
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


class _Weights(dict):
    """Weight of a word, worked out once; emptied when it has grown."""

    def __init__(self, stems: dict[str, float]) -> None:
        super().__init__()
        self.stems = stems

    def __missing__(self, word: str) -> float:
        if len(self) > 500_000:
            self.clear()
        found = self[word] = longest_stem(word, self.stems)
        return found


def features_of(text: str) -> set[str]:
    """The distinct words of a text, each as a whole (with $) and by its beginnings."""
    found = set()
    for word in set(WORD.findall(text.lower())):
        found.add(word + "$")
        for n in range(3, min(STEM, len(word)) + 1):
            found.add(word[:n])
    return found


def labelled_sample(
    docs: DataFrame, labels: DataFrame, bound: int
) -> DataFrame:
    """``text, toxic`` of at most ``bound`` labelled documents, chosen by a hash of their ids.

    Of rows with the same text one is kept, toxic if any of them is, so that copies weigh once.
    """
    chosen = (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("_toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(bound)
        .withColumnRenamed("doc_id", "_doc")
    )
    # At most ``bound`` rows of two numbers, so they may go to every task.
    return (
        docs.join(F.broadcast(chosen), F.col("_id") == F.col("_doc"))
        .groupBy(F.xxhash64("text").alias("h"))
        .agg(F.min("text").alias("text"), F.max("_toxic").alias("toxic"))
        .drop("h")
    )


def learn(
    sample: DataFrame, shortlist: int = 2000, chance: float = 0.05, least_weight: float = 4.0
) -> Grammar:
    """Fit stems, weights and the output on a sample of bounded size.

    Beginnings of words are counted by label; the ``shortlist`` most telling are tried in
    turn. One is kept if it tells more than chance would over all candidates, and if
    it is not confined to a small part of the toxic texts of one kept before it, as
    words are that merely recur in near copies of a toxic text.
    """
    sizes = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return Grammar({}, bias=math.log((toxic + 0.5) / (clean + 0.5)) if sizes else -3.0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            names = list(seen[0].keys() | seen[1].keys())
            columns = [pa.array(names), *(pa.array([s[n] for n in names], pa.int64()) for s in seen)]
            seen[0].clear()
            seen[1].clear()
            return pa.RecordBatch.from_arrays(columns, ["feature", "clean", "toxic"])

        for batch in batches:
            for text, label in zip(*(c.to_pylist() for c in batch.columns)):
                seen[1 if label == 1 else 0].update(features_of(text))
                if len(seen[0]) > 400_000:
                    yield flush()
        if seen[0] or seen[1]:
            yield flush()

    counted = (
        sample.select("text", "toxic")
        .mapInArrow(count, "feature string, clean long, toxic long")
        .groupBy("feature")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    )
    n_features = counted.filter(F.col("toxic") + F.col("clean") >= 3).count()
    weight = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    best = (
        counted.filter((F.col("toxic") >= 3) & (weight >= least_weight))
        .orderBy(F.desc(F.col("toxic") * weight), F.length("feature"), "feature")
        .limit(shortlist)
        .collect()
    )
    wanted = frozenset(r["feature"] for r in best)

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, labels = (c.to_pylist() for c in batch.columns)
            held = [sorted(features_of(t) & wanted) for t in texts]
            rows = [(h, l) for h, l in zip(held, labels) if h and l == 1]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.list_(pa.string()))], ["features"]
                )

    holders: dict[str, set[int]] = {}
    for i, row in enumerate(
        sample.select("text", "toxic").mapInArrow(present, "features array<string>").toLocalIterator()
    ):
        for feature in row[0]:
            holders.setdefault(feature, set()).add(i)
    share = toxic / (toxic + clean)
    need = math.log(max(n_features, 1) / chance)

    def gain(a: int, b: int) -> float:
        p = min(max(a / (a + b), 1e-9), 1 - 1e-9)
        if p <= share:
            return 0.0
        return a * math.log(p / share) + b * math.log((1 - p) / (1 - share))

    ranked = sorted(
        ((gain(r["toxic"], r["clean"]), r["feature"], r["clean"]) for r in best),
        key=lambda x: (-x[0], len(x[1]), x[1]),
    )
    stems: dict[str, float] = {}
    for value, feature, b in ranked:
        held = holders.get(feature, set())
        if value < need or feature.startswith(tuple(stems)):
            continue
        # a small part of one stem's texts: words that merely recur in near copies
        part_of = (h for h in map(holders.get, stems) if len(held & h) >= 0.9 * len(held))
        if any(len(held) < 0.5 * len(h) for h in part_of):
            continue
        # a beginning of stems that are known has to tell something without them
        alone = held.difference(*(holders[s] for s in stems if s.startswith(feature)))
        if not alone or gain(len(alone), b) < need:
            continue
        # as much of the word as nearly all of these texts share
        longer = [
            f
            for f, h in holders.items()
            if f.startswith(feature) and not f.endswith("$") and len(h & held) >= 0.95 * len(held)
        ]
        stem = max([feature, *longer], key=lambda f: (len(f), f))
        stems[stem] = math.log((len(held) + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (clean + 1))
    grammar = Grammar(stems)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Weights(stems)
        for batch in batches:
            texts, labels = (c.to_pylist() for c in batch.columns)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([text_weight(t, grammar, memo) for t in texts], pa.float64()),
                    pa.array([int(x == 1) for x in labels], pa.int64()),
                ],
                ["weight", "toxic"],
            )

    weighed = sample.select("text", "toxic").mapInArrow(weigh, "weight double, toxic long").toPandas()
    bias, slope = _logistic_fit(weighed["weight"].to_numpy(), weighed["toxic"].to_numpy())
    return Grammar(stems, bias=bias, slope=slope)


def _logistic_fit(x, y, ridge: float = 1e-2) -> tuple[float, float]:
    """Intercept and non-negative slope of a logistic regression on one variable."""
    design = np.stack((np.ones_like(x), x), axis=1)
    beta = np.array([math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)), 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (y - p) - ridge * beta
        hessian = (design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(2)
        move = np.linalg.solve(hessian, gradient)
        beta = beta + np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-8:
            break
    return float(beta[0]), float(max(beta[1], 0.0))


def score_documents(
    docs: DataFrame,
    labels: DataFrame,
    held_out: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    bound: int = 20_000,
) -> DataFrame:
    """``score`` of every row of ``docs``, learnt from labelled rows that are not ``held_out``.

    Returns all columns of ``docs`` plus ``score`` (0 to 1), replacing one of that name. Only the
    text is read. A NULL or empty text has no clause and gets the score of a text without
    insults. ``bound`` limits the labelled rows that are learnt from, not what is
    scored. Without labels of both kinds all texts get the same score.
    """
    training = docs.select(
        *row_key(id_col, text_col), text_or_empty(text_col).alias("text"), held_out.alias("_out")
    ).filter((F.col("_id") != NO_ID) & ~F.coalesce(F.col("_out"), F.lit(False)))
    sample = written(
        labelled_sample(training, labels, bound), "labelled-sample"
    )
    with rows_at_once(docs.sparkSession, TEXTS_AT_ONCE):
        grammar = learn(sample)
    return with_scores(docs, grammar, text_col)


def with_scores(docs: DataFrame, grammar: Grammar, text_col: str = "text") -> DataFrame:
    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo = _Weights(grammar.stems)
        for batch in texts:
            yield batch.map(
                lambda t: probability(text_weight(t, grammar, memo), grammar)
            ).astype("float64")

    return docs.withColumn("score", score(text_or_empty(text_col)))


def matched_clauses(text: str, grammar: Grammar) -> list[dict]:
    """Clauses of a text that hold an insult, with their place and weight, for review."""
    found, at, memo = [], 0, _Weights(grammar.stems)
    for gap in [*CLAUSE.finditer(text), None]:
        end = gap.start() if gap else len(text)
        weight = clause_weight(WORD.findall(text[at:end].lower()), grammar, memo)
        if weight:
            found.append({"start": at, "end": end, "weight": weight})
        at = gap.end() if gap else end
    return found
