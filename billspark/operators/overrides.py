"""Values set by a person: an append-only log, applied over extracted state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billspark import rules
from billspark.operators.confidence import EMPTY_MAP, with_fields
from billspark.operators.derive import recompute
from billspark.schema import ATTRS


_NUMBERS = ("bigint", "int", "double")


def canonical_value(value: Column, attr: Column) -> Column:
    """Numbers for numeric attributes, whole ones without a fraction; texts stay as given.

    Numbers go through decimals, so long ones keep all digits. NULL where a numeric attribute gets
    something else.
    """
    number = F.trim(value).try_cast("decimal(38,9)")
    whole = number.cast("decimal(29,0)")
    short = F.when(number == whole, whole.cast("string")).otherwise(
        F.regexp_replace(number.cast("string"), r"0+$", "")
    )
    numeric = attr.isin(*[a for a, kind in ATTRS.items() if kind in _NUMBERS])
    return F.when(numeric, short).otherwise(value)


def attr_of_suffix(suffix: Column, service_type: Column) -> Column:
    """Attribute behind the suffix of a reading; the total depends on the service type."""
    table = F.create_map(*[F.lit(x) for kv in rules.BREAKDOWN_SUFFIXES.items() for x in kv])
    totals = F.create_map(*[F.lit(x) for kv in rules.TOTAL_FIELD.items() for x in kv])
    total = F.coalesce(F.try_element_at(totals, service_type), F.lit("total_amount"))
    return F.coalesce(
        F.try_element_at(table, suffix), F.when(suffix == "total_amount", total), suffix
    )


def checked_values(requests: DataFrame, accounts: DataFrame) -> DataFrame:
    """Requests ``targets ARRAY, attr, suffix, value, ts`` with the reason for which one is refused.

    A request names exactly one account; without an attribute it is taken from the suffix of the
    reading. ``reason`` is NULL for those that hold.
    """
    one = requests.withColumn("account_id", F.get("targets", F.lit(0)))
    known = one.join(
        accounts.select("account_id", F.col("service_type"), F.lit(True).alias("_known")), "account_id", "left"
    ).withColumn("attr", F.coalesce("attr", attr_of_suffix(F.col("suffix"), F.col("service_type"))))
    settable = [a for a, kind in ATTRS.items() if not kind.startswith("array")]
    value = canonical_value(F.col("value"), F.col("attr"))
    reason = (
        F.when(F.coalesce(F.size("targets"), F.lit(0)) != 1, "not one account")
        .when(F.col("_known").isNull(), "unknown account")
        .when(F.col("attr").isNull(), "no attribute")
        .when(~F.col("attr").isin(*settable), "unknown attribute")
        .when(F.col("value").isNull() | value.isNull(), "unreadable value")
    )
    return known.select("account_id", "attr", F.coalesce(value, "value").alias("value"), "ts", reason.alias("reason"))


def set_values(requests: DataFrame, accounts: DataFrame) -> DataFrame:
    """The override rows of requests that hold."""
    return checked_values(requests, accounts).filter(F.col("reason").isNull()).drop("reason")


def latest_overrides(overrides: DataFrame) -> DataFrame:
    """Latest value per account and attribute, as one map per account.

    Attributes are those of ``ATTRS``, so the map is bounded by their number.
    """
    last = overrides.filter(F.col("attr").isin(*ATTRS)).groupBy("account_id", "attr").agg(
        F.max(F.struct("ts", "value")).alias("last")
    )
    return last.groupBy("account_id").agg(
        F.map_from_entries(F.collect_list(F.struct("attr", "last"))).alias("overrides")
    )


def apply_overrides(
    state: DataFrame, overrides: DataFrame, extracted_at: str | None = None
) -> DataFrame:
    """State with the latest overrides in place (score 100), everything derived again.

    With ``extracted_at`` (a column of ``state``) only later overrides count: a
    fresh extraction replaces what was set before it.
    """
    df = with_fields(state, ATTRS).join(latest_overrides(overrides), "account_id", "left")
    if "confidence" not in df.columns:
        df = df.withColumn("confidence", F.expr(EMPTY_MAP))
    valid = F.coalesce(F.col("overrides"), F.expr("cast(map() as map<string,struct<ts:timestamp,value:string>>)"))
    if extracted_at is not None:
        valid = F.map_filter(valid, lambda k, v: v["ts"] > F.col(extracted_at))
    df = df.withColumn(
        "_set", F.transform_values(valid, lambda k, v: v["value"])
    )
    changed: dict[str, Column] = {}
    read: list[Column] = []
    for field, kind in ATTRS.items():
        if kind.startswith("array"):
            continue
        value = F.try_element_at("_set", F.lit(field)).try_cast(kind)
        changed[field] = F.coalesce(value, F.col(field))
        read.append(F.when(value.isNotNull(), F.lit(field)))
    # only what could be read is settled; any other entry leaves its field as it was
    settled = F.array_compact(F.array(*read))
    scores = F.map_from_arrays(
        settled, F.transform(settled, lambda f: F.lit(rules.CONF_OVERRIDE).cast("double"))
    )
    others = F.map_filter(
        F.coalesce("confidence", F.expr(EMPTY_MAP)), lambda k, v: ~F.array_contains(settled, k)
    )
    df = df.withColumns(changed | {"confidence": F.map_concat(others, scores)})
    return recompute(df.drop("_set", "overrides"))
