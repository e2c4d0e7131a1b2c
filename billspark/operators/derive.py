"""Derived amounts: unit costs, aliases and the arithmetic printed on a bill.

Steps that read a value written by an earlier step are separate projections,
in the order the arithmetic requires. No step shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billspark import rules
from billspark.functions.scalar import percent_of, rate
from billspark.operators.confidence import (
    close_scores,
    copy_field,
    derive,
    mark_owned,
    open_scores,
    owned,
    score,
    score_name,
)
from billspark.schema import ATTRS

WATER_FIELDS = [
    "consumption", "water_consumption", "water_consumption_non_peak", "water_consumption_peak",
    "water_consumption_non_peak_m3", "water_consumption_peak_m3", "wastewater_recolection",
    "wastewater_treatment", "fixed_charge", "other_charges", "subtotal", "total_amount",
    "cost_per_unit_non_peak", "cost_per_unit_peak", "cubic_meter_collection",
    "cubic_meter_treatment",
]
RECONCILED_FIELDS = [
    "gastos_comunes_amount", "fondos_amount", "funds_provision", "subtotal",
    "subtotal_departamento", "fixed_charge", "cargo_fijo", "gc_total",
]
RECONCILE_INPUTS = [
    "building_total_expense", "alicuota", "fondos_pct", "total_amount", "hot_water_amount",
    "subtotal_consumo",
]
FINAL_FIELDS = [
    *RECONCILED_FIELDS, *RECONCILE_INPUTS, "address", "building_name", "apartment",
    "gross_common_expenses", "gross_common_expenses_percentage", "previous_measure",
    "actual_measure", "hot_water_reading_prev", "hot_water_reading_curr",
    "funds_provision_percentage", "subtotal_recargos",
]


def _nonzero(column: Column) -> Column:
    return column.isNotNull() & (column != 0)


# ------------------------------------------------------------------------ water
def derive_water(
    bills: DataFrame, recompute: bool = False, only: Column | None = None
) -> DataFrame:
    """Unit costs, subtotal and total of water bills.

    At extraction time a published tariff (a unit cost that is already there)
    stands; on ``recompute`` everything derived follows the current charges.
    """
    df = open_scores(bills, WATER_FIELDS)
    non_peak, peak = F.col("water_consumption_non_peak"), F.col("water_consumption_peak")
    used = F.col("consumption")

    def unset(field: str) -> Column:
        return F.lit(True) if recompute else F.col(field).isNull()

    def unit_cost(charge: Column, volume: Column, field: str) -> Column:
        return F.when(_nonzero(volume) & unset(field), rate(charge, volume))

    df = derive(
        df,
        {
            "cost_per_unit_non_peak": unit_cost(
                non_peak, F.col("water_consumption_non_peak_m3"), "cost_per_unit_non_peak"
            ),
            "cost_per_unit_peak": unit_cost(
                peak, F.col("water_consumption_peak_m3"), "cost_per_unit_peak"
            ),
            "water_consumption": F.when(unset("water_consumption"), non_peak + peak),
            "cubic_meter_collection": F.when(
                _nonzero(used), rate(F.col("wastewater_recolection"), used)
            ),
            "cubic_meter_treatment": F.when(
                _nonzero(used), rate(F.col("wastewater_treatment"), used)
            ),
        },
        only,
    )
    subtotal = (
        F.col("water_consumption")
        + F.col("wastewater_recolection")
        + F.col("wastewater_treatment")
        + F.col("fixed_charge")
    )
    total = F.when(~owned("subtotal"), subtotal + F.col("other_charges"))
    df = derive(df, {"subtotal": subtotal, "total_amount": total}, only)
    return close_scores(df, WATER_FIELDS)


def unit_cost(amount: Column, quantity: Column) -> Column:
    """Amount per unit, only when both are known and the quantity is positive."""
    return F.when(_nonzero(amount) & (quantity > 0), rate(amount, quantity))


# -------------------------------------------------------------- common expenses
def _reconcile_steps(df: DataFrame, only: Column | None = None) -> DataFrame:
    bill, funds = F.col("gastos_comunes_amount"), F.col("fondos_amount")
    apartment = F.coalesce("subtotal_departamento", "subtotal")
    expected = percent_of(F.col("building_total_expense"), F.col("alicuota"))
    df = derive(
        df,
        {
            "gastos_comunes_amount": F.when(expected > 0, expected),
            "cargo_fijo": F.col("fixed_charge"),
            "fixed_charge": F.when(F.col("fixed_charge").isNull(), F.col("cargo_fijo")),
        },
        only,
    )
    share = percent_of(bill, F.col("fondos_pct"))
    df = derive(
        df,
        {
            "fondos_amount": F.when(
                F.col("fondos_pct").isNotNull(), F.when(share >= 0, share)
            ).when(apartment >= bill, apartment - bill)
        },
        only,
    )
    subtotal = F.coalesce(bill + funds, apartment)
    df = derive(
        df,
        {"funds_provision": funds, "subtotal_departamento": subtotal, "subtotal": subtotal},
        only,
    )
    zero = F.lit(0).cast("bigint")
    computed = (
        F.col("subtotal")
        + F.coalesce(F.col("hot_water_amount"), F.col("subtotal_consumo"), zero)
        + F.coalesce(F.col("fixed_charge"), F.col("cargo_fijo"), zero)
    )
    return derive(df, {"gc_total": F.coalesce(F.col("total_amount"), computed)}, only)


def reconcile_common(bills: DataFrame, only: Column | None = None) -> DataFrame:
    """Make bill, funds, subtotal and total agree; values set by a person stand."""
    fields = [*RECONCILED_FIELDS, *RECONCILE_INPUTS]
    return close_scores(_reconcile_steps(open_scores(bills, fields), only), fields)


def finalize_common(bills: DataFrame, only: Column | None = None) -> DataFrame:
    """Compose the address, fill aliases, derive what is missing, then reconcile."""
    df = open_scores(bills, FINAL_FIELDS)
    street = F.trim(F.regexp_extract("address", r"(?s)^(.*?)(?: - |$)", 1))
    city = F.trim(F.regexp_extract("address", r"(?s)^.*? - (.*)$", 1))
    with_flat = F.concat(street, F.coalesce(F.concat(F.lit(" Depto."), F.col("apartment")), F.lit("")))
    composed = F.concat_ws(
        ", ", "building_name", F.nullif(with_flat, F.lit("")), F.nullif(city, F.lit(""))
    )
    whole = F.col("building_name").isNotNull() & F.col("address").isNotNull()
    if only is not None:
        whole = whole & only
    df = df.withColumn("address", F.when(whole, composed).otherwise(F.col("address")))

    ocr = rules.CONF_OCR
    no_charge = F.col("cargo_fijo").isNull()
    df = copy_field(
        df,
        {
            "gross_common_expenses": ("building_total_expense", None),
            "gross_common_expenses_percentage": ("alicuota", None),
            "previous_measure": ("hot_water_reading_prev", None),
            "actual_measure": ("hot_water_reading_curr", None),
            "funds_provision_percentage": ("fondos_pct", None),
            "funds_provision": ("fondos_amount", None),
            "subtotal": ("subtotal_departamento", None),
            "cargo_fijo": ("subtotal_recargos", no_charge),
        },
        ocr,
        only,
    )
    apartment, funds = F.col("subtotal_departamento"), F.col("fondos_amount")
    bill, charge, total = F.col("gastos_comunes_amount"), F.col("cargo_fijo"), F.col("total_amount")
    df = copy_field(df, {"fixed_charge": ("cargo_fijo", None)}, ocr, only)
    df = derive(df, {"gastos_comunes_amount": F.when(bill.isNull(), apartment - funds)}, only)
    difference = F.when(
        (apartment >= bill) & (funds.isNull() | (funds != apartment - bill)), apartment - bill
    )
    df = derive(
        df,
        {
            "fondos_amount": difference,
            "funds_provision": F.when(F.col("funds_provision").isNotNull(), difference),
        },
        only,
    )
    rest = total - apartment - F.coalesce(charge, F.lit(0).cast("bigint"))
    hot_water = F.when(F.col("subtotal_consumo").isNull() & (rest > 0), rest)
    df = derive(
        df,
        {
            "subtotal_consumo": hot_water,
            "hot_water_amount": F.when(F.col("hot_water_amount").isNull(), hot_water),
        },
        only,
    )
    df = derive(df, {"gc_total": _provisional_total()}, only)
    return close_scores(_reconcile_steps(df, only), FINAL_FIELDS)


def _provisional_total() -> Column:
    apartment = F.coalesce("subtotal_departamento", "subtotal")
    charge = F.coalesce("cargo_fijo", "fixed_charge")
    total, hot_water = F.col("total_amount"), F.col("subtotal_consumo")
    return F.coalesce(apartment + charge, apartment, total - hot_water, total)


# -------------------------------------------------------------------- recompute
ALIASES = [
    ("fixed_charge", "cargo_fijo"),
    ("subtotal", "subtotal_departamento"),
    ("funds_provision", "fondos_amount"),
]


def recompute(state: DataFrame) -> DataFrame:
    """Re-derive every formula field of an account state, by service type."""
    kind = F.col("service_type")
    water = kind == rules.WATER
    common = kind.isin(rules.COMMON_EXPENSES, rules.HOT_WATER)
    df = derive_water(state, recompute=True, only=water)

    fields = [*RECONCILED_FIELDS, *RECONCILE_INPUTS]
    df = open_scores(df, fields)
    synced: dict[str, Column] = {}
    for a, b in ALIASES:
        to_b = common & F.col(a).isNotNull() & ~owned(b)
        to_a = common & ~to_b & F.col(b).isNotNull() & ~owned(a)
        for source, target, write in ((a, b, to_b), (b, a, to_a)):
            synced[target] = F.when(write, F.col(source)).otherwise(F.col(target))
            synced[score_name(target)] = F.when(
                write, F.coalesce(score(source), F.lit(rules.CONF_DERIVED))
            ).otherwise(score(target))
    df = mark_owned(df.withColumns(synced), fields)
    df = derive(df, {"gc_total": _provisional_total()}, common)
    return close_scores(_reconcile_steps(df, common), fields)


def changed_fields(before: DataFrame, after: DataFrame, key: str = "account_id") -> DataFrame:
    """One row per (key, attribute) whose value differs: ``attr, old_value, new_value``.

    One wide join on the key; the fields are compared inside the row, so only
    differences are ever expanded.
    """
    fields = [f for f in ATTRS if f in after.columns]
    known = [f for f in fields if f in before.columns]
    old = before.select(key, F.struct(*[F.col(f).cast("string").alias(f) for f in known]).alias("_old"))
    pairs = F.array(
        *[
            F.struct(
                F.lit(f).alias("attr"),
                (F.col(f"_old.{f}") if f in known else F.lit(None).cast("string")).alias("old_value"),
                F.col(f).cast("string").alias("new_value"),
            )
            for f in fields
        ]
    )
    differing = F.filter(
        pairs, lambda p: p["new_value"].isNotNull() & ~p["new_value"].eqNullSafe(p["old_value"])
    )
    return after.join(old, key, "left").select(key, F.inline(differing))
