"""Known values of the parsers, the date rules and the derivations."""

import datetime as dt

from pyspark.sql import functions as F

from billspark.functions import scalar as S
from billspark.operators.derive import reconcile_common
from billspark.operators.merge import carry_forward, needs_fallback, with_diagnostics
from billspark.operators.outputs import is_overdue, problem_status


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(v,) for v in values], f"s {kind}")
    return [r[0] for r in df.select(expression(F.col("s"))).collect()]


def test_amounts(spark):
    printed = ["12.013", "122.060", "1.234,56", "12,013", "1,234.56", "$ 122.060", "abc", None, "1.2.34"]
    assert column(spark, printed, S.parse_amount) == [
        12013, 122060, 1234, 12013, 1234, 122060, 0, None, 0
    ]


def test_quantities(spark):
    assert column(spark, ["12.5", "12,5", "1.500", "150", "x", None], S.parse_decimal) == [
        12.5, 12.5, 1500.0, 150.0, 0.0, None
    ]
    meters = ["410,254000", "410254000", "3,257000", "413.511000", "3257000"]
    assert column(spark, meters, S.parse_meter) == [410.254, 410.254, 3.257, 413.511, 3.257]


def test_dates(spark):
    printed = ["20-07-2026", "20/07/2026", "02-JUL-2026", "20 de julio de 2026", "31-02-2026",
               "correo recibido ayer", None]
    july = dt.date(2026, 7, 20)
    assert column(spark, printed, S.parse_bill_date) == [
        july, july, dt.date(2026, 7, 2), july, None, None, None
    ]


def test_may_has_a_billing_period(spark):
    month = column(spark, ["Nota de Cobro Mayo 2026"], S.billing_month)[0]
    assert (month.first_day, month.last_day) == ("01-05-2026", "31-05-2026")


def test_year_repair_only_goes_back_a_little(spark):
    fixed = column(spark, ["01-03-2028", "01-03-2031", "01-03-2020"], lambda c: S.fix_year(c, F.lit("2026")))
    assert fixed == ["01-03-2026", "01-03-2031", "01-03-2020"]


def test_overdue_is_strict_and_clamps_to_the_month_end(spark):
    rows = [
        (dt.datetime(2026, 1, 15), dt.datetime(2026, 2, 16), 1, True),
        (dt.datetime(2026, 1, 15), dt.datetime(2026, 3, 15), 2, False),
        (dt.datetime(2026, 1, 15), dt.datetime(2026, 3, 16), 2, True),
        (dt.datetime(2026, 1, 31), dt.datetime(2026, 2, 28), 1, False),
    ]
    df = spark.createDataFrame(rows, "u timestamp, n timestamp, m int, want boolean")
    assert all(
        r.got == r.want
        for r in df.select(is_overdue(F.col("u"), F.col("n"), F.col("m")).alias("got"), "want").collect()
    )


def test_accounts_without_bill_are_problems(spark):
    accounts = spark.createDataFrame([(1, "gas", 1), (2, "gas", 1)], "account_id long, service_type string, billing_interval_months int")
    state = spark.createDataFrame([(1, dt.datetime(2026, 1, 1))], "account_id long, last_updated timestamp")
    now = F.lit("2026-01-10 00:00:00").cast("timestamp")
    got = {r.account_id: r.problem for r in problem_status(state, accounts, now).collect()}
    assert got == {1: False, 2: True}


RECONCILE = (
    "building_total_expense long, alicuota double, fondos_pct int, gastos_comunes_amount long, "
    "fondos_amount long, funds_provision long, subtotal long, hot_water_amount long, "
    "fixed_charge long, gc_total long, confidence map<string,double>"
)


def test_reconciliation(spark):
    rows = [
        (14171762, 0.9511, 5, 999999, 88888, 88888, 1088887, 32812, 16136, 1093887, {}),
        (10000000, 1.25, None, 130000, None, None, None, None, None, None, {"gastos_comunes_amount": 100.0}),
    ]
    first, second = reconcile_common(spark.createDataFrame(rows, RECONCILE)).collect()
    assert (first.gastos_comunes_amount, first.funds_provision, first.subtotal, first.gc_total) == (
        134788, 6739, 141527, 190475
    )
    assert first.confidence["gc_total"] == 60.0
    assert second.gastos_comunes_amount == 130000
    assert second.confidence["gastos_comunes_amount"] == 100.0


def test_filter_on_a_derived_value_stays_cheap_to_plan(spark):
    bills = reconcile_common(spark.createDataFrame([(100, 110)], "gastos_comunes_amount long, subtotal long"))
    assert bills.filter("gc_total > 0 and fondos_amount = 10").count() == 1


def test_diagnostics(spark):
    df = spark.createDataFrame([(1, None, None, None)], "gastos_comunes_amount long, subtotal long, fixed_charge long, gc_total long")
    row = with_diagnostics(df, F.lit("internal")).first()
    assert row.extraction_status == "partial"
    assert row.extraction_error == "missing_required_fields:subtotal,fixed_charge,gc_total"


def test_carry_forward_keeps_only_what_is_missing(spark):
    current = spark.createDataFrame(
        [(1, "common_expenses", 20, {"fixed_charge": 80.0})],
        "account_id long, service_type string, fixed_charge long, confidence map<string,double>",
    )
    previous = spark.createDataFrame(
        [(1, 100, 10, 30, {"gastos_comunes_amount": 75.0, "fixed_charge": 75.0, "hot_water_amount": 75.0})],
        "account_id long, gastos_comunes_amount long, fixed_charge long, hot_water_amount long, confidence map<string,double>",
    )
    row = carry_forward(current, previous).withColumn("more", needs_fallback()).first()
    assert row.copied == ["gastos_comunes_amount", "hot_water_amount"]
    assert (row.fixed_charge, row.gastos_comunes_amount) == (20, 100)
    assert row.confidence["hot_water_amount"] == 75.0 and row.confidence["fixed_charge"] == 80.0
    assert row.more
