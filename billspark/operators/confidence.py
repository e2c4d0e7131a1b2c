"""Per-field confidence scores.

A bill row carries ``confidence MAP<STRING,DOUBLE>``. While fields are being
derived the scores of the fields at hand live in plain columns, so every step
is an ordinary projection.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billspark import rules
from billspark.schema import ATTRS
from billspark.session import keep_methods_compiled

EMPTY_MAP = "cast(map() as map<string,double>)"


def score_name(field: str) -> str:
    return f"_score_{field}"


def score(field: str) -> Column:
    return F.col(score_name(field))


def score_map(scores: Mapping[str, Column]) -> Column:
    """Map of the non-NULL scores."""
    keys, values = F.array(*map(F.lit, scores)), F.array(*scores.values())
    return F.map_filter(F.map_from_arrays(keys, values), lambda k, v: v.isNotNull())


def default_scores(fields: Iterable[str], level: float) -> Column:
    """The same score for every field that has a value."""
    return score_map({f: F.when(F.col(f).isNotNull(), F.lit(level)) for f in fields})


def with_fields(df: DataFrame, fields: Iterable[str]) -> DataFrame:
    """Add attribute columns that are not there yet, as NULL."""
    missing = [f for f in fields if f not in df.columns]
    return df.withColumns({f: F.lit(None).cast(ATTRS[f]) for f in missing}) if missing else df


def _owned_name(field: str) -> str:
    return f"_owned_{field}"


def boundary(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Let ``columns`` leave through a generator of exactly one row.

    Values that build on each other over many projections would otherwise be
    written out into one expression, which grows exponentially, as soon as a
    filter on one of them is pushed down.
    """
    keep_methods_compiled(df.sparkSession)
    columns = list(columns)
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.inline(F.array(F.struct(*columns)))).select(*df.columns)


def open_scores(df: DataFrame, fields: Iterable[str]) -> DataFrame:
    """Spread the scores of ``fields`` into columns."""
    fields = list(fields)
    df = with_fields(df, fields)
    if "confidence" not in df.columns:
        df = df.withColumn("confidence", F.expr(EMPTY_MAP))
    df = df.withColumns(
        {score_name(f): F.try_element_at("confidence", F.lit(f)) for f in fields}
    )
    return mark_owned(df, fields)


def mark_owned(df: DataFrame, fields: Iterable[str]) -> DataFrame:
    """Note which values a person set. Derivation never changes that."""
    return df.withColumns(
        {
            _owned_name(f): F.coalesce(score(f) >= rules.CONF_OVERRIDE, F.lit(False))
            for f in fields
        }
    )


def close_scores(df: DataFrame, fields: Iterable[str]) -> DataFrame:
    """Fold the score columns back into the map."""
    fields = list(fields)
    others = F.map_filter(F.coalesce("confidence", F.expr(EMPTY_MAP)), lambda k, v: ~k.isin(fields))
    scores = F.map_concat(others, score_map({f: score(f) for f in fields}))
    df = df.withColumn("confidence", scores).drop(
        *map(score_name, fields), *map(_owned_name, fields)
    )
    return boundary(df, [*fields, "confidence"])


def owned(field: str) -> Column:
    """True when a person set the value; nothing derived may replace it."""
    return F.col(_owned_name(field))


def derive(
    df: DataFrame, updates: Mapping[str, Column], only: Column | None = None
) -> DataFrame:
    """Write derived values (where not NULL and not owned) with the derived score."""
    changed: dict[str, Column] = {}
    for field, value in updates.items():
        value = value.cast(ATTRS[field])
        write = ~owned(field) if only is None else only & ~owned(field)
        changed[field] = F.when(write, F.coalesce(value, F.col(field))).otherwise(F.col(field))
        changed[score_name(field)] = F.when(
            write & value.isNotNull(), F.lit(rules.CONF_DERIVED)
        ).otherwise(score(field))
    return df.withColumns(changed)


def copy_field(
    df: DataFrame,
    copies: Mapping[str, tuple[str, Column | None]],
    default: float,
    only: Column | None = None,
) -> DataFrame:
    """Copy ``source`` into ``target`` with its score: ``{target: (source, condition)}``."""
    changed: dict[str, Column] = {}
    for target, (source, condition) in copies.items():
        write = F.col(source).isNotNull()
        for extra in (condition, only):
            if extra is not None:
                write = write & extra
        changed[target] = F.when(write, F.col(source).cast(ATTRS[target])).otherwise(F.col(target))
        changed[score_name(target)] = F.when(
            write, F.coalesce(score(source), F.lit(default))
        ).otherwise(score(target))
    return df.withColumns(changed)
