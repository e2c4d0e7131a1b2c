"""Language-model scores: a log-bilinear model trained with noise-contrastive estimation."""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from billspark.llm.common import KEY, NO_ID, row_key, text_or_empty, worker_memo, written

#: Stands for the end of a document; no word is empty.
END = b""
#: Types a task counts before it passes its counts on.
_COUNTED = 200_000
#: Rare words that a worker keeps beside the frequent ones. Most are met once, and a class is worked
#: out faster than a large memo pays for its memory.
_REMEMBERED_RARE = 50_000
#: Absolute discount of words outside the model's vocabulary; it goes to unseen words.
DISCOUNT = 0.5


@dataclass(frozen=True)
class Settings:
    """Sizes of the model. All of them are fixed; none grows with the corpus.

    ``outputs`` most frequent tokens are outcomes of their own, all others fall into ``endings``
    classes by their last two bytes. ``remembered`` most frequent tokens have their counts
    sent to the tasks; the counts of the rest are joined.
    """

    outputs: int = 1024
    endings: int = 64
    remembered: int = 200_000
    width: int = 32
    noise: int = 32
    batch: int = 4096
    rate: float = 0.05
    seed: int = 7

    @property
    def classes(self) -> int:
        return self.outputs + self.endings


def tokens_of(text: str | None) -> list[bytes]:
    """Words between ASCII blanks with A-Z lowered, then the end."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    words.append(END)
    return words


def _classes_from(first: int, n: int, sign: int = 1) -> list[int]:
    return [sign * (first + k) for k in range(n)]


def _ending(word: bytes, endings: int) -> int:
    return zlib.crc32(word[-2:]) % endings


@dataclass
class Model:
    """Parameters, and what is needed to turn tokens into classes."""

    settings: Settings
    ids: dict[bytes, int]
    unigram: np.ndarray
    context: np.ndarray
    weight: np.ndarray
    target: np.ndarray
    bias: np.ndarray
    known: dict[bytes, int] = field(default_factory=dict)
    ending_total: np.ndarray | None = None
    ending_types: np.ndarray | None = None

    def numbers(self, tokens: list[bytes]) -> np.ndarray:
        found = self.__dict__.setdefault("_numbers", _Numbers(self))
        return np.fromiter(map(found.__getitem__, tokens), np.int64, len(tokens))

    def contexts(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The classes of the two tokens before each; documents begin after an end."""
        end = self.ids[END]
        before = np.concatenate(([end], numbers[:-1]))
        return before, np.concatenate(([end], before[:-1]))

    def query(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return self.context[one] * self.weight[0] + self.context[two] * self.weight[1]

    def shipped(self, spark: SparkSession):
        """Broadcast without classes of this package, which workers need not have."""
        plain = {k: v for k, v in self.__dict__.items() if not k.startswith("_")}
        return spark.sparkContext.broadcast(plain | {"settings": asdict(self.settings)})

    @classmethod
    def received(cls, plain: dict) -> Model:
        """A model of a task's own, made from the broadcast; its arrays are copies."""
        copied = {k: v.copy() if isinstance(v, np.ndarray) else v for k, v in plain.items()}
        return cls(**copied | {"settings": Settings(**plain["settings"])})


class _Numbers(dict):
    """Class of a token, worked out once; emptied when it has grown."""

    def __init__(self, model: Model) -> None:
        super().__init__(model.ids)
        self.ids = model.ids
        self.full = len(model.ids) + _REMEMBERED_RARE
        settings = model.settings
        # one number a class, which all its words share
        self.endings = settings.endings
        self.classes = _classes_from(settings.outputs, settings.endings)

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.full:
            self.clear()
            self.update(self.ids)
        found = self[word] = self.classes[_ending(word, self.endings)]
        return found


def fresh_model(settings: Settings, ids: dict[bytes, int], class_counts: np.ndarray) -> Model:
    """A model that gives unigram probabilities until it is trained."""
    rng = np.random.default_rng(settings.seed)
    share = class_counts + 0.5
    unigram = (share / share.sum()).astype(np.float32)
    shape = (settings.classes, settings.width)
    return Model(
        settings,
        ids,
        unigram,
        (rng.standard_normal(shape) * 0.1).astype(np.float32),
        np.ones((2, settings.width), np.float32),
        (rng.standard_normal(shape) * 0.1).astype(np.float32),
        np.log(unigram),
    )


def _summed(rows: np.ndarray, values: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """``values`` added up by row number."""
    flat = (rows[:, None] * shape[1] + np.arange(shape[1])).ravel()
    return np.bincount(flat, values.ravel(), shape[0] * shape[1]).astype(np.float32).reshape(shape)


class Trainer:
    """Noise-contrastive steps with Adagrad; a minibatch shares its noise words."""

    def __init__(self, model: Model) -> None:
        self.model = model
        s = model.settings
        self.rng = np.random.default_rng(s.seed + 1)
        self.names = ("context", "weight", "target", "bias")
        self.squares = {n: np.full_like(getattr(model, n), 0.1) for n in self.names}
        self.log_noise = np.log(s.noise * model.unigram)
        self.cumulated = np.cumsum(model.unigram.astype(np.float64))

    def step(self, words: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        m, s = self.model, self.model.settings
        noise = np.searchsorted(self.cumulated, self.rng.random(s.noise) * self.cumulated[-1])
        a, b = m.context[one], m.context[two]
        q = a * m.weight[0] + b * m.weight[1]
        t = m.target[words]
        real = np.einsum("ij,ij->i", q, t) + m.bias[words] - self.log_noise[words]
        fake = q @ m.target[noise].T + m.bias[noise] - self.log_noise[noise]
        up = _logistic(-real)
        down = -_logistic(fake)
        dq = up[:, None] * t + down @ m.target[noise]
        shape = m.context.shape
        d_target = _summed(words, up[:, None] * q, shape)
        np.add.at(d_target, noise, down.T @ q)
        d_bias = np.bincount(words, up, s.classes).astype(np.float32)
        np.add.at(d_bias, noise, down.sum(axis=0))
        d_context = _summed(
            np.concatenate((one, two)),
            np.concatenate((dq * m.weight[0], dq * m.weight[1])),
            shape,
        )
        d_weight = np.stack(((dq * a).sum(axis=0), (dq * b).sum(axis=0)))
        for name, grad in zip(self.names, (d_context, d_weight, d_target, d_bias)):
            grad /= len(words)
            squares = self.squares[name]
            squares += (grad * 100) ** 2
            getattr(m, name).__iadd__(s.rate * 100 * grad / np.sqrt(squares))


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def normalisers(model: Model, spark: SparkSession, firsts: int = 16) -> np.ndarray:
    """Logarithms of the normalisers of all pairs of context classes, one row a first class.

    A job over first classes makes them once, by matrix products over all outcomes; the table has a fixed
    size, whatever the corpus.
    """
    shipped = model.shipped(spark)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model.received(shipped.value)
        every = np.arange(m.settings.classes)
        for batch in batches:
            for one in batch.column(0).to_pylist():
                scores = m.query(np.full(len(every), one), every) @ m.target.T + m.bias
                top = scores.max(axis=1, keepdims=True)
                row = (top[:, 0] + np.log(np.exp(scores - top).sum(axis=1))).astype(np.float32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([one], pa.int64()), pa.array([row.tobytes()], pa.binary())], ["one", "row"]
                )

    classes = model.settings.classes
    table = spark.range(0, classes, 1, -(-classes // firsts)).mapInArrow(rows, "one long, row binary")
    return np.stack([np.frombuffer(r, np.float32) for _, r in sorted((x.one, bytes(x.row)) for x in table.collect())])


class Scorer:
    """Normalised log10 probabilities, by the table of ``normalisers``."""

    def __init__(self, model: Model, normaliser: np.ndarray) -> None:
        self.model = model
        self.normaliser = normaliser

    def token_scores(self, numbers: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        m = self.model
        score = np.einsum("ij,ij->i", m.query(one, two), m.target[numbers]) + m.bias[numbers]
        return (score - self.normaliser[one, two]).astype(np.float64) / np.log(10)


class Lexicon(dict):
    """One look-up for a token: its row among the remembered ones, or its class as ``-1 - class``.

    Rows lead to the class, the logarithm of the count and the share in the class.
    """

    def __init__(self, model: Model) -> None:
        super().__init__(zip(model.known, range(len(model.known))))
        self.settings = model.settings
        self.remembered = len(self)
        counts = np.fromiter(model.known.values(), np.float64, len(model.known))
        outputs = self.settings.outputs
        self.classes = np.array(
            [model.ids[w] if w in model.ids else outputs + _ending(w, self.settings.endings) for w in model.known],
            np.int64,
        )
        self.log_count = np.log10(counts + 0.5)
        self.share = np.where(self.classes < outputs, 0.0, np.log10(counts - DISCOUNT))
        # outcomes that the counts do not have, as the end where nothing was learnt
        self.others = {w: -1 - i for w, i in model.ids.items() if w not in model.known}
        self.update(self.others)
        self.endings, self.full = self.settings.endings, len(self) + _REMEMBERED_RARE
        # one number a class, which all its words share
        self.unseen = _classes_from(outputs + 1, self.endings, -1)

    def __missing__(self, word: bytes) -> int:
        found = self.unseen[_ending(word, self.endings)]
        if len(self) < self.full:
            self[word] = found
        return found

    def rows(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))


def token_counts(docs: DataFrame) -> DataFrame:
    """``word, c`` of ``docs`` (a ``text`` column), summed in the tasks before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            columns = [pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())]
            seen.clear()
            return pa.RecordBatch.from_arrays(columns, ["word", "c"])

        for batch in batches:
            for text in batch.column(0):
                seen.update(tokens_of(text.as_py()))
                if len(seen) > _COUNTED:
                    yield flush()
        if seen:
            yield flush()

    counted = docs.select("text").mapInArrow(count, "word binary, c long")
    return counted.groupBy("word").agg(F.sum("c").alias("c"))


def train(docs: DataFrame, counts: DataFrame, settings: Settings = Settings()) -> Model:
    """Fit the model on all of ``docs`` (a ``text`` column), whose token counts are ``counts``.

    Every task takes one pass over its documents, starting from the same parameters; the
    results are averaged by number of tokens. Only vocabularies and parameters of fixed
    size come to the driver.
    """
    v = counts.count()
    rank = 1 - settings.remembered / max(v, settings.remembered)
    floor = counts.agg(
        F.percentile_approx("c", F.lit(rank), F.lit(max(10_000, 20 * v // settings.remembered)))
    ).first()[0]
    frequent = counts.filter(F.col("c") > (floor if v > settings.remembered else 0)).toPandas()
    ranked = sorted(zip(frequent["c"].tolist(), map(bytes, frequent["word"])), key=lambda x: (-x[0], x[1]))
    known = {w: c for c, w in ranked}
    top = [w for _, w in ranked[: settings.outputs] if w != END][: settings.outputs - 1]
    ids = {w: i for i, w in enumerate([END, *top])}
    total, types = np.zeros(settings.classes), np.zeros(settings.endings)
    ending = F.crc32(F.expr("substring(word, -2, 2)")) % settings.endings
    by_ending = counts.groupBy(ending.alias("ending")).agg(F.sum("c"), F.count("*"))
    for e, c, t in by_ending.collect():
        total[settings.outputs + e], types[e] = c, t
    for w, i in ids.items():
        if w in known:
            total[i] = known[w]
            total[settings.outputs + _ending(w, settings.endings)] -= known[w]
            types[_ending(w, settings.endings)] -= 1
    start = fresh_model(settings, ids, total)
    shipped = start.shipped(docs.sparkSession)
    names = Trainer(start).names
    shapes = [getattr(start, n).shape for n in names]

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.received(shipped.value)
        trainer, held, tokens = Trainer(model), [], 0
        size = 0

        def take() -> None:
            nonlocal held, size
            w, a, b = (np.concatenate(x) for x in zip(*held))
            for at in range(0, len(w), settings.batch):
                part = slice(at, at + settings.batch)
                trainer.step(w[part], a[part], b[part])
            held, size = [], 0

        for batch in batches:
            for text in batch.column(0):
                numbers = model.numbers(tokens_of(text.as_py()))
                held.append((numbers, *model.contexts(numbers)))
                size += len(numbers)
                tokens += len(numbers)
                if size >= 16 * settings.batch:
                    take()
        if held:
            take()
        if tokens:
            flat = np.concatenate([getattr(model, n).ravel() for n in names]).astype(np.float64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(len(flat)), pa.int32()),
                    pa.array(np.full(len(flat), float(tokens))),
                    pa.array(flat * tokens),
                ],
                ["place", "tokens", "value"],
            )

    learnt = docs.select("text").mapInArrow(learn, "place int, tokens double, value double")
    averaged = (
        learnt.groupBy("place")
        .agg((F.sum("value") / F.sum("tokens")).alias("value"))
        .toPandas()
        .sort_values("place")
    )
    if len(averaged):
        flat, at = averaged["value"].to_numpy(), 0
        for name, shape in zip(names, shapes):
            size = int(np.prod(shape))
            setattr(start, name, flat[at : at + size].reshape(shape).astype(np.float32))
            at += size
    start.known, start.ending_total, start.ending_types = known, total[settings.outputs :], types
    return start


def score_documents(
    docs: DataFrame,
    held_out: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    settings: Settings = Settings(),
) -> DataFrame:
    """Score every document with a model learnt from those that are not ``held_out``.

    Returns ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for each row of
    ``docs``. A NULL text is empty and has one token, the end. Scores are log10 of
    the probability of all tokens. Without training documents all words are unseen.

    The outcomes of the model are the training types and one unseen type for each ending: a
    frequent token has its own outcome; another one is its ending's class times its
    discounted share of that class, the discount going to unseen words. Counts of
    all types stay distributed; tokens that are not among the remembered are joined with
    them, summed by word and document.
    """
    marked = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        *row_key(id_col, text_col),
        text_or_empty(text_col).alias("text"),
    )
    training = marked.filter(~F.col("held_out"))
    counts = written(token_counts(training), "token-counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    model = train(training, counts, settings)
    shipped = model.shipped(docs.sparkSession)
    table = docs.sparkSession.sparkContext.broadcast(normalisers(model, docs.sparkSession))
    name = f"scorer {uuid.uuid4().hex}"
    outputs, endings = settings.outputs, settings.endings

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = worker_memo(name, lambda: Scorer(Model.received(shipped.value), table.value))
        m = scorer.model
        lexicon = worker_memo(f"{name} lexicon", lambda: Lexicon(m))
        log_total = np.zeros(m.settings.classes)
        with np.errstate(divide="ignore"):
            log_total[outputs:] = np.log10(np.maximum(m.ending_total, 1.0))
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            keys = zip(*(c.to_pylist() for c in batch.columns[:3]))
            for (i, h, out), text in zip(keys, batch.column(3)):
                tokens = tokens_of(text.as_py())
                at = lexicon.rows(tokens)
                held = at >= 0
                met = at[held]
                numbers = -1 - at
                numbers[held] = lexicon.classes[met]
                by_model = scorer.token_scores(numbers, *m.contexts(numbers)) - log_total[numbers]
                base, within = float(lexicon.log_count[met].sum()), float(lexicon.share[met].sum())
                # No word has a blank, so this one meets nothing in the join below.
                own = b" %d %d" % (i, h)
                rows.append(
                    (i, h, out, own, 1, len(tokens), len(met), base, float(by_model.sum()) + within)
                )
                rest = Counter([tokens[j] for j in np.flatnonzero(~held).tolist()])
                rows.extend((i, h, out, w, k, 0, 0, 0.0, 0.0) for w, k in rest.items())
                size += len(tokens)
                if size > 100_000:
                    yield _scored(rows)
                    rows, size = [], 0
        if rows:
            yield _scored(rows)

    scored = marked.select(*KEY, "held_out", "text").mapInArrow(
        score,
        "_id long, _hash long, held_out boolean, word binary, k long, n_tokens long,"
        " n_known long, base double, by_model double",
    )
    unseen = F.array(*[F.lit(float(max(1.0, DISCOUNT * t))) for t in model.ending_types])
    ending = F.crc32(F.expr("substring(word, -2, 2)")) % endings
    own = F.col("n_tokens") > 0
    c = F.col("c")
    base = F.when(own, F.col("base")).otherwise(
        F.col("k") * F.log10(F.coalesce(c, F.lit(0)) + 0.5)
    )
    by_model = F.when(own, F.col("by_model")).otherwise(
        F.col("k")
        * F.log10(F.coalesce(c - DISCOUNT, F.get(unseen, ending.cast("int"))))
    )
    known = F.when(own, F.col("n_known")).when(c.isNotNull(), F.col("k")).otherwise(0)
    copies = F.col("copies")
    per_type = float(np.log10(n + 0.5 * (v + 1)))
    return (
        scored.join(counts, "word", "left")
        .groupBy(*KEY, "held_out")
        .agg(
            F.sum(own.cast("long")).alias("copies"),
            F.sum("n_tokens").alias("n_tokens"),
            F.sum(known).alias("n_known"),
            F.sum(base).alias("base"),
            F.sum(by_model).alias("by_model"),
        )
        .select(
            F.when(F.col("_id") != NO_ID, F.col("_id")).alias("doc_id"),
            "held_out",
            (F.col("n_tokens") / copies).cast("long").alias("n_tokens"),
            (F.col("n_known") / copies).cast("long").alias("n_known"),
            F.lit(n).cast("long").alias("train_tokens"),
            ((F.col("base") - F.col("n_tokens") * per_type) / copies).alias("base_score"),
            (F.col("by_model") / copies).alias("score"),
            # rows that repeat one another were summed as one
            F.explode(F.array_repeat(F.lit(0), copies.cast("int"))).alias("_copy"),
        )
        .drop("_copy")
    )


def _scored(rows: list[tuple]) -> pa.RecordBatch:
    types = [
        pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int64(), pa.int64(), pa.int64(),
        pa.float64(), pa.float64(),
    ]
    names = ["_id", "_hash", "held_out", "word", "k", "n_tokens", "n_known", "base", "by_model"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
