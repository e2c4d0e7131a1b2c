"""Queries over rendered messages and text layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from billspark import rules
from billspark.functions import scalar as S
from billspark.functions.python_udfs import html_to_text
from billspark.operators.derive import finalize_common
from billspark.operators.email_fields import extract_email
from billspark.operators.merge import with_diagnostics
from billspark.operators.outputs import last_update, bill_problem
from billspark.operators.text_fields import extract_bills
from billspark.plans import render as R
from billspark.plans.registry import half_even, query, table

SQL_MONTHS = "['enero','febrero','marzo','abril','mayo','junio','julio','agosto','septiembre','octubre','noviembre','diciembre']"
SQL_SHORT = "['Ene','Feb','Mar','Abr','May','Jun','Jul','Ago','Sep','Oct','Nov','Dic']"
ORDERS = """o AS (SELECT o_orderkey, o_custkey, CAST(floor(o_totalprice) AS BIGINT) AS total,
  CAST(o_orderdate AS DATE) AS day FROM orders)"""
SUMS = ORDERS + """, s AS (SELECT l_orderkey, sum(CAST(l_quantity AS BIGINT))::BIGINT AS quantity,
  sum(CAST(floor(l_extendedprice) AS BIGINT))::BIGINT AS price, sum(CAST(l_linenumber AS BIGINT))::BIGINT AS numbers
  FROM lineitem GROUP BY l_orderkey), b AS (SELECT o.*, quantity, price, numbers FROM o JOIN s ON l_orderkey = o_orderkey)"""


# --------------------------------------------------------------------- messages
@query(
    "gas_bill_totals",
    f"""WITH {ORDERS} SELECT o_orderkey,
      CASE WHEN o_orderkey % 5 < 4 THEN lpad(CAST(o_orderkey AS VARCHAR), 10, '0') END AS folio,
      lpad(CAST(o_custkey AS VARCHAR), 8, '0') || '-' || CAST(o_custkey % 10 AS VARCHAR) AS customer_number,
      'Calle ' || CAST(o_custkey AS VARCHAR) || ' Norte' AS address,
      CASE WHEN o_orderkey % 7 <> 3 THEN total END AS total_amount,
      strftime(day + 15, '%d-%m-%Y') AS due_date,
      CASE WHEN o_orderkey % 3 = 1 THEN CAST(day(day) AS VARCHAR) || ' de ' || {SQL_MONTHS}[month(day)] || ' de ' || CAST(year(day) AS VARCHAR)
           ELSE strftime(day, '%d-%m-%Y') END AS emission_date,
      day AS emission_day FROM o""",
)
def gas_bill_totals(spark: SparkSession, folder: str) -> DataFrame:
    bills = extract_email(R.general_mail(R.orders(spark, folder)))
    return bills.select(
        "o_orderkey", "folio", "customer_number", "address", "total_amount", "due_date",
        "emission_date", S.parse_bill_date(F.col("emission_date")).alias("emission_day"),
    )


@query(
    "overdue_by_segment",
    f"""WITH {ORDERS} SELECT c_mktsegment,
      (day::TIMESTAMP + INTERVAL 12 HOUR + to_months(CAST(1 + o_orderkey % 12 AS INTEGER))) < TIMESTAMP '1998-09-02 00:00:00' AS problem,
      count(*) AS accounts, sum(CASE WHEN o_orderkey % 7 <> 3 THEN total END)::BIGINT AS total_amount
      FROM o JOIN customer ON c_custkey = o_custkey GROUP BY ALL""",
)
def overdue_by_segment(spark: SparkSession, folder: str) -> DataFrame:
    """Bills read from messages, judged at a fixed moment, counted by segment."""
    mail = R.general_mail(R.orders(spark, folder))
    months = (1 + F.col("o_orderkey") % 12).cast("int")
    now = F.lit("1998-09-02 00:00:00").cast("timestamp")
    problem = bill_problem(last_update(F.col("emission_date")), now, months, F.lit(False))
    bills = extract_email(mail).select("o_custkey", "total_amount", problem.alias("problem"))
    customers = table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    return (
        bills.join(customers, F.col("c_custkey") == F.col("o_custkey"))
        .groupBy("c_mktsegment", "problem")
        .agg(F.count(F.lit(1)).alias("accounts"), F.sum("total_amount").alias("total_amount"))
    )


@query(
    "email_periods",
    f"""WITH {ORDERS} SELECT o_orderkey,
      CASE o_orderkey % 3 WHEN 2 THEN NULL ELSE strftime(day, '%d-%m-%Y') END AS billing_period_start,
      CASE o_orderkey % 3 WHEN 0 THEN strftime(day + 30, '%d/%m/%Y') WHEN 1 THEN strftime(day + 30, '%d')
        || ' de ' || {SQL_MONTHS}[month(day + 30)] || ' ' || CAST(year(day + 30) AS VARCHAR) END AS billing_period_end,
      CASE o_orderkey % 3 WHEN 2 THEN NULL ELSE day END AS start_day,
      CASE o_orderkey % 3 WHEN 2 THEN NULL ELSE day + 30 END AS end_day FROM o""",
)
def email_periods(spark: SparkSession, folder: str) -> DataFrame:
    """Period dates; start and end may come from different spellings."""
    end = F.date_add("day", 30)
    spelled = R.text(F.date_format(end, "dd"), " de ", R.month_word(end), " ", F.year(end).cast("string"))
    body = R.choose(
        R.key() % 3,
        R.text("Periodo ", R.dmy(F.col("day")), " al ", R.dmy(end, "/")),
        R.text("Hasta: 3 de enero 1990, ", "desde ", R.dmy(F.col("day")), " hasta ", spelled),
        "Sin periodo",
    )
    mail = R.orders(spark, folder).select(
        "o_orderkey", F.lit("Aviso").alias("subject"), body.alias("body"), F.lit(rules.TELECOM).alias("service_type")
    )
    bills = extract_email(mail)
    return bills.select(
        "o_orderkey", "billing_period_start", "billing_period_end",
        S.parse_bill_date(F.col("billing_period_start")).alias("start_day"),
        S.parse_bill_date(F.col("billing_period_end")).alias("end_day"),
    )


@query(
    "gas_email",
    f"""WITH {SUMS} SELECT o_orderkey, total AS total_amount,
      CASE WHEN o_orderkey % 3 < 2 THEN quantity + 0.25 END::DOUBLE AS consumption,
      CASE o_orderkey % 3 WHEN 0 THEN 'm3' WHEN 1 THEN 'm3s' END AS consumption_unit,
      CASE WHEN o_orderkey % 3 < 2 AND total > 0 THEN {half_even('total * 10000', 'quantity * 100 + 25')} / 100.0 END::DOUBLE AS cost_per_m3s FROM b""",
)
def gas_email(spark: SparkSession, folder: str) -> DataFrame:
    volume = R.plain_decimals(F.col("quantity") + 0.25)
    mail = R.order_sums(spark, folder).select(
        "o_orderkey",
        F.lit("Metrogas").alias("subject"),
        R.lines(
            R.text("Total a pagar: ", R.clp(F.col("total"))),
            R.choose(R.key() % 3, R.text("Consumo de gas: ", volume, " m3"), R.text("Volumen consumido: ", volume, " M3S"), ""),
        ).alias("body"),
        F.lit(rules.GAS).alias("service_type"),
    )
    return extract_email(mail).select(
        "o_orderkey", "total_amount", "consumption", "consumption_unit", "cost_per_m3s"
    )


@query(
    "electricity_email",
    f"""WITH {SUMS} SELECT o_orderkey, CAST(o_orderkey + 100000 AS VARCHAR) AS folio, quantity::DOUBLE AS consumption, total AS total_amount,
      'AV SUR ' || CAST(o_custkey AS VARCHAR) || ' CASA 1' AS address,
      CASE WHEN o_orderkey % 2 = 1 THEN strftime(day, '%d-%m-%Y') END AS billing_period_start,
      strftime(day, '%d-%m-%Y') AS emission_date FROM b""",
)
def electricity_email(spark: SparkSession, folder: str) -> DataFrame:
    mail = R.order_sums(spark, folder).select(
        "o_orderkey",
        F.lit("Tu cuenta").alias("subject"),
        R.lines(
            R.text("Tu boleta del suministro ubicado en AV SUR\n", F.col("o_custkey").cast("string"), "  CASA 1 ya está disponible"),
            R.text("¿Cuánto debo pagar? $ ", R.clp(F.col("total"))),
            R.text("N° Boleta ", (R.key() + 100000).cast("string"), " del ", R.dmy(F.col("day"))),
            R.text(F.col("quantity").cast("string"), " kWh\nConsumo real"),
            F.when(R.key() % 2 == 0, R.text("Próximo periodo de facturación\n", R.dmy(F.date_add("day", 1)), " - ", R.dmy(F.date_add("day", 30)))),
        ).alias("body"),
        F.lit(rules.ELECTRICITY).alias("service_type"),
    )
    return extract_email(mail).select(
        "o_orderkey", "folio", "consumption", "total_amount", "address", "billing_period_start", "emission_date"
    )


@query(
    "water_email",
    f"""WITH {SUMS} SELECT o_orderkey, 'PASAJE 12-' || CAST(o_custkey AS VARCHAR) || ', SANTIAGO' AS address,
      lpad(CAST(o_custkey AS VARCHAR), 7, '0') || '-' || CAST(o_custkey % 10 AS VARCHAR) AS customer_number,
      CASE WHEN o_orderkey % 2 = 0 THEN quantity + 0.5 END::DOUBLE AS consumption,
      CASE WHEN o_orderkey % 3 = 0 THEN CAST(price AS VARCHAR) || ';' || CAST(total AS VARCHAR) WHEN o_orderkey % 3 = 1 THEN CAST(price AS VARCHAR) END AS meter_reading,
      CASE WHEN o_orderkey % 5 = 0 THEN 'MX-' || CAST(o_orderkey AS VARCHAR) END AS meter_number FROM b""",
)
def water_email(spark: SparkSession, folder: str) -> DataFrame:
    mail = R.order_sums(spark, folder).select(
        "o_orderkey",
        F.lit("Aviso").alias("subject"),
        R.lines(
            R.text("Pasaje:\nPASAJE 12-", F.col("o_custkey").cast("string"), ", SANTIAGO    ",
                   F.lpad(F.col("o_custkey").cast("string"), 7, "0"), "-", (F.col("o_custkey") % 10).cast("string"), "    al"),
            F.when(R.key() % 2 == 0, R.text(R.plain_decimals(F.col("quantity") + 0.5), " m³")),
            F.when(R.key() % 3 < 2, R.text("Lectura anterior: ", F.col("price").cast("string"))),
            F.when(R.key() % 3 == 0, R.text("Lectura actual: ", F.col("total").cast("string"))),
            F.when(R.key() % 5 == 0, R.text("Número de medidor: MX-", R.key().cast("string"))),
        ).alias("body"),
        F.lit(rules.WATER).alias("service_type"),
    )
    return extract_email(mail).select(
        "o_orderkey", "address", "customer_number", "consumption",
        F.nullif(F.concat_ws(";", "meter_reading"), F.lit("")).alias("meter_reading"), "meter_number",
    )


# ------------------------------------------------------------------ text layers
@query(
    "gas_unit_cost",
    f"""WITH {SUMS} SELECT o_orderkey, total AS total_amount, (quantity + 0.25)::DOUBLE AS consumption,
      'm3s' AS consumption_unit, {half_even('total * 10000', 'quantity * 100 + 25')} / 100.0 AS cost_per_m3s,
      strftime(day, '%d-%m-%Y') AS emission_date FROM b""",
)
def gas_unit_cost(spark: SparkSession, folder: str) -> DataFrame:
    bills = extract_bills(R.gas_text(R.order_sums(spark, folder)), types=[rules.GAS])
    return bills.select(
        "o_orderkey", "total_amount", "consumption", "consumption_unit", "cost_per_m3s", "emission_date"
    )


@query(
    "electricity_breakdown",
    f"""WITH {SUMS} SELECT o_orderkey, quantity::DOUBLE AS consumption, 'kWh' AS consumption_unit, numbers + 700 AS service_administration,
      price AS electricity_consumption, total AS electricity_transport,
      CASE WHEN o_orderkey % 2 = 0 THEN quantity + 1000 ELSE 0 END AS stabilization_fund, price + total AS total_amount,
      {half_even('price * 100', 'quantity')} / 100.0 AS cost_per_kwh,
      strftime(day, '%d-%m-%Y') AS billing_period_start, strftime(day + 28, '%d-%m-%Y') AS billing_period_end,
      'BT1-T' || CAST(o_orderkey % 4 AS VARCHAR) AS tariff_code, (o_orderkey % 9 + 1) * 1000 + 500 AS connected_power,
      (o_orderkey % 9 + 1 + 0.5)::DOUBLE AS connected_power_kw, 'kW' AS connected_power_unit,
      'AREA 1 S Caso 3 (a)' AS area, 'SUB ' || CAST(o_custkey % 50 AS VARCHAR) AS substation FROM b""",
)
def electricity_breakdown(spark: SparkSession, folder: str) -> DataFrame:
    bills = extract_bills(R.electricity_text(R.order_sums(spark, folder)), types=[rules.ELECTRICITY])
    return bills.select(
        "o_orderkey", "consumption", "consumption_unit", "service_administration",
        "electricity_consumption", "electricity_transport", "stabilization_fund", "total_amount",
        "cost_per_kwh", "billing_period_start", "billing_period_end", "tariff_code",
        "connected_power", "connected_power_kw", "connected_power_unit", "area", "substation",
    )


@query(
    "water_breakdown",
    f"""WITH {SUMS}, w AS (SELECT *, o_orderkey % 4 AS k, quantity * 100 + 50 AS v, quantity * 25 AS h,
        numbers + 900 AS fixed, quantity + 40 AS peak, quantity * 3 + 100 AS treat, numbers + 10 AS late FROM b),
      c AS (SELECT *, CASE k WHEN 0 THEN price WHEN 1 THEN price ELSE price + peak END AS wc,
        CASE k WHEN 0 THEN -1 WHEN 1 THEN late - 3 WHEN 2 THEN -8 ELSE late - 2 END AS other FROM w)
      SELECT o_orderkey, 'CALLE ' || CAST(o_custkey AS VARCHAR) || ' SANTIAGO' AS address,
      lpad(CAST(o_custkey AS VARCHAR), 7, '0') || '-' || CAST(o_custkey % 10 AS VARCHAR) AS customer_number,
      strftime(day, '%d') || '-' || upper({SQL_SHORT}[month(day)]) || '-' || CAST(year(day) AS VARCHAR) AS due_date,
      v / 100.0 AS consumption, fixed AS fixed_charge, wc AS water_consumption,
      CASE WHEN k <> 1 THEN v / 100.0 END AS water_consumption_non_peak_m3,
      CASE WHEN k <> 1 THEN price END AS water_consumption_non_peak,
      CASE WHEN k = 0 THEN 0 WHEN k > 1 THEN h / 100.0 END::DOUBLE AS water_consumption_peak_m3,
      CASE WHEN k = 0 THEN 0 WHEN k > 1 THEN peak END AS water_consumption_peak,
      total AS wastewater_recolection, treat AS wastewater_treatment, other AS other_charges,
      CASE WHEN o_orderkey % 8 = 0 THEN 611.48 WHEN k <> 1 THEN {half_even('price * 10000', 'v')} / 100.0 END::DOUBLE AS cost_per_unit_non_peak,
      CASE WHEN o_orderkey % 8 = 0 THEN 1605.25 WHEN k > 1 THEN {half_even('peak * 10000', 'h')} / 100.0 END::DOUBLE AS cost_per_unit_peak,
      {half_even('total * 10000', 'v')} / 100.0 AS cubic_meter_collection, {half_even('treat * 10000', 'v')} / 100.0 AS cubic_meter_treatment,
      wc + total + treat + fixed AS subtotal, wc + total + treat + fixed + other AS total_amount FROM c""",
)
def water_breakdown(spark: SparkSession, folder: str) -> DataFrame:
    bills = extract_bills(R.water_text(R.order_sums(spark, folder)), types=[rules.WATER])
    return bills.select(
        "o_orderkey", "address", "customer_number", "due_date", "consumption", "fixed_charge",
        "water_consumption", "water_consumption_non_peak_m3", "water_consumption_non_peak",
        "water_consumption_peak_m3", "water_consumption_peak", "wastewater_recolection",
        "wastewater_treatment", "other_charges", "cost_per_unit_non_peak", "cost_per_unit_peak",
        "cubic_meter_collection", "cubic_meter_treatment", "subtotal", "total_amount",
    )


# Building total x share (four decimals) / 100, funds share, then the sums.
NOTES = ORDERS + f""", n AS (SELECT o_orderkey, o_custkey, day, total, total * 100 AS building, o_custkey % 900 + 100 AS share,
      o_orderkey % 11 + 1 AS pct, total % 5000 + 1000 AS hot, total % 9000 + 2000 AS charge, total + 500000 AS printed FROM o),
    n1 AS (SELECT *, {half_even('share', '10')} AS ali FROM n),
    n2 AS (SELECT *, {half_even('building * ali', '1000000')} AS expected FROM n1)"""


@query(
    "common_expenses_reconcile",
    f"""WITH {NOTES},
      a AS (SELECT *, CASE WHEN expected > 0 THEN expected ELSE building % 977 + 1 END AS bill FROM n2),
      f AS (SELECT *, CASE WHEN o_orderkey % 4 <> 1 THEN {half_even('bill * pct', '100')}
            WHEN printed >= bill THEN printed - bill END AS funds FROM a),
      g AS (SELECT *, CASE WHEN funds IS NULL THEN printed ELSE bill + funds END AS sub FROM f)
      SELECT o_orderkey, ali / 10000.0 AS alicuota, building AS building_total_expense, bill AS gastos_comunes_amount,
      CASE WHEN o_orderkey % 4 <> 1 THEN pct END::INTEGER AS fondos_pct, funds AS funds_provision, sub AS subtotal,
      charge AS fixed_charge,
      hot AS hot_water_amount, printed * 3 AS total_amount, printed * 3 AS gc_total,
      strftime(day, '%d-%m-%Y') AS emission_date,
      strftime(day + 10, '%d-%m-') || CAST(year(day) AS VARCHAR) AS due_date,
      strftime(date_trunc('month', day), '%d-%m-%Y') AS billing_period_start, strftime(last_day(day), '%d-%m-%Y') AS billing_period_end,
      CASE WHEN o_orderkey % 3 = 2 THEN 'Edificio Los Alerces' ELSE 'Edificio Jose Miguel' END AS building_name,
      CASE WHEN o_orderkey % 3 = 2 THEN 'Edificio Los Alerces' ELSE 'Edificio Jose Miguel' END || ', Calle Norte ' || CAST(o_custkey AS VARCHAR)
        || ' Depto.' || CAST(o_custkey % 300 AS VARCHAR) || ', Santiago' AS address,
      'ANA PRUEBA' AS owner_name, CAST(o_orderkey % 90000 + 10000 AS VARCHAR) AS last_payment_folio,
      410.254::DOUBLE AS hot_water_reading_prev, 3.257::DOUBLE AS hot_water_consumption, 6120.45::DOUBLE AS hot_water_cost_per_m3,
      'success' AS extraction_status FROM g""",
)
def common_expenses_reconcile(spark: SparkSession, folder: str) -> DataFrame:
    notes = R.note_text(R.note_amounts(R.orders(spark, folder)))
    bills = extract_bills(notes, types=[rules.COMMON_EXPENSES])
    bills = with_diagnostics(bills, F.lit("internal"))
    return bills.select(
        "o_orderkey", "alicuota", "building_total_expense", "gastos_comunes_amount", "fondos_pct",
        "funds_provision", "subtotal", "fixed_charge", "hot_water_amount", "total_amount", "gc_total",
        "emission_date", "due_date", "billing_period_start", "billing_period_end", "building_name",
        "address", "owner_name", "last_payment_folio", "hot_water_reading_prev",
        "hot_water_consumption", "hot_water_cost_per_m3", "extraction_status",
    )


@query(
    "bills_by_type",
    f"""WITH {SUMS} SELECT CASE o_orderkey % 4 WHEN 0 THEN 'gas' WHEN 1 THEN 'electricity' WHEN 2 THEN 'water' ELSE 'telecom' END AS service_type,
      count(*) AS bills, sum(CASE o_orderkey % 4 WHEN 0 THEN total WHEN 1 THEN price + total
        WHEN 2 THEN price + quantity + 40 + total + quantity * 3 + 100 + numbers + 900 - 8 END)::BIGINT AS total_amount,
      count(CASE WHEN o_orderkey % 4 < 3 THEN 1 END) AS scored FROM b GROUP BY 1""",
)
def bills_by_type(spark: SparkSession, folder: str) -> DataFrame:
    """A mixed table of documents, each read with the patterns of its own type."""
    sums = R.order_sums(spark, folder)
    part = F.col("o_orderkey") % 4
    texts = R.gas_text(sums.filter(part == 0)).unionByName(R.electricity_text(sums.filter(part == 1)))
    texts = texts.unionByName(R.water_text(sums.filter(part == 2)))
    telecom = R.gas_text(sums.filter(part == 3)).withColumn("service_type", F.lit(rules.TELECOM))
    bills = extract_bills(texts.unionByName(telecom))
    return bills.groupBy("service_type").agg(
        F.count(F.lit(1)).alias("bills"),
        F.sum("total_amount").alias("total_amount"),
        F.count_if(F.map_contains_key("confidence", "total_amount")).alias("scored"),
    )


@query(
    "finalize_aliases",
    f"""WITH {ORDERS}, p AS (SELECT o_orderkey, total, total + 5000 AS apartment, total % 4000 + 500 AS charges, total % 700 + 1 AS hot FROM o)
      SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN total ELSE total END AS gastos_comunes_amount, 5000::BIGINT AS fondos_amount,
      5000::BIGINT AS funds_provision, apartment AS subtotal, CASE WHEN o_orderkey % 2 = 0 THEN charges END AS fixed_charge,
      CASE WHEN o_orderkey % 2 = 0 THEN hot ELSE hot + charges END AS subtotal_consumo,
      CASE WHEN o_orderkey % 2 = 0 THEN hot ELSE hot + charges END AS hot_water_amount,
      apartment + charges + hot AS gc_total FROM p""",
)
def finalize_aliases(spark: SparkSession, folder: str) -> DataFrame:
    """Missing parts of a note follow from the printed ones."""
    total = F.col("total")
    charges = total % 4000 + 500
    bills = R.orders(spark, folder).select(
        "o_orderkey",
        F.when(R.key() % 3 == 0, total).alias("gastos_comunes_amount"),
        F.when(R.key() % 3 != 0, F.lit(5000).cast("bigint")).alias("fondos_amount"),
        (total + 5000).alias("subtotal_departamento"),
        F.when(R.key() % 2 == 0, charges).alias("subtotal_recargos"),
        (total + 5000 + charges + total % 700 + 1).alias("total_amount"),
    )
    return finalize_common(bills).select(
        "o_orderkey", "gastos_comunes_amount", "fondos_amount", "funds_provision", "subtotal",
        "fixed_charge", "subtotal_consumo", "hot_water_amount", "gc_total",
    )


# ------------------------------------------------------------- scalar functions
@query(
    "amount_formats",
    f"""WITH {ORDERS} SELECT o_orderkey, total AS whole,
      CASE WHEN o_orderkey % 5 IN (1, 2) THEN total + 0.5 WHEN o_orderkey % 5 = 4 THEN 0 ELSE total END::DOUBLE AS number,
      CASE WHEN o_orderkey % 5 = 0 THEN total * 1000 ELSE 0 END::DOUBLE AS plain FROM o""",
)
def amount_formats(spark: SparkSession, folder: str) -> DataFrame:
    total = F.col("total")
    english = F.format_number(total + 0.5, 2)
    df = R.orders(spark, folder).select(
        "o_orderkey",
        R.choose(
            R.key() % 5, R.clp(total), R.decimals(total + 0.5), english, F.format_number(total, 0),
            R.text("$ ", R.clp(total)),
        ).alias("printed"),
        R.choose(
            R.key() % 5, R.text((total * 1000).cast("string"), f"{R.NBSP}").substr(F.lit(1), F.length((total * 1000).cast("string"))),
            "", "n/a", "1.2.3,4.5", "x1",
        ).alias("odd"),
    )
    return df.select(
        "o_orderkey", S.parse_amount(F.col("printed")).alias("whole"),
        S.parse_decimal(F.col("printed")).alias("number"), S.safe_float(F.col("odd")).alias("plain"),
    )


@query(
    "meter_readings",
    f"""WITH {ORDERS}, m AS (SELECT o_orderkey, total % 900 + 100 AS a, o_orderkey % 1000 AS b FROM o)
      SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN (a % 9 + 1) + b / 1000.0 ELSE a + b / 1000.0 END::DOUBLE AS reading FROM m""",
)
def meter_readings(spark: SparkSession, folder: str) -> DataFrame:
    whole = (F.col("total") % 900 + 100).cast("string")
    part = F.lpad((R.key() % 1000).cast("string"), 3, "0")
    small = ((F.col("total") % 900 + 100) % 9 + 1).cast("string")
    printed = R.choose(
        R.key() % 4, R.text(whole, ",", part, "000"), R.text(whole, part, "000"),
        R.text(" ", whole, ".", part, "000 "), R.text(small, part, "000"),
    )
    return R.orders(spark, folder).select("o_orderkey", S.parse_meter(printed).alias("reading"))


@query(
    "bill_dates",
    f"""WITH {ORDERS} SELECT o_orderkey, CASE WHEN o_orderkey % 9 < 8 THEN day END AS parsed,
      strftime(day, '%d-%m-%Y') AS rebuilt, strftime(day, '%d-%m-') || '1996' AS repaired FROM o""",
)
def bill_dates(spark: SparkSession, folder: str) -> DataFrame:
    """Every accepted spelling of a date, its rebuilt form and a repaired year."""
    d = F.col("day")
    n, y = F.dayofmonth(d).cast("string"), F.year(d).cast("string")
    printed = R.choose(
        R.key() % 9, R.dmy(d), R.dmy(d, "/"), F.date_format(d, "yyyy-MM-dd"), F.date_format(d, "dd-MM-yy"),
        F.date_format(d, "d/M/yy"), R.text(n, "-", F.upper(R.month_word(d, R.SHORT_MONTHS)), "-", y),
        R.text(" ", n, " de ", R.month_word(d), " de ", y), R.text(n, " ", F.upper(R.month_word(d)), " ", y),
        "correo recibido ayer",
    )
    misread = R.text(F.date_format(d, "dd-MM-"), (F.lit(1996) + R.key() % 5).cast("string"))
    return R.orders(spark, folder).select(
        "o_orderkey", S.parse_bill_date(printed).alias("parsed"),
        S.spanish_date(n, R.month_word(d), y).alias("rebuilt"),
        S.fix_year(misread, F.lit("1996")).alias("repaired"),
    )


@query(
    "billing_months",
    f"""WITH {ORDERS} SELECT o_orderkey, upper({SQL_MONTHS}[month(day)][1]) || {SQL_MONTHS}[month(day)][2:] AS label,
      CAST(year(day) AS VARCHAR) AS year, strftime(date_trunc('month', day), '%d-%m-%Y') AS first_day,
      strftime(last_day(day), '%d-%m-%Y') AS last_day, {half_even('(o_custkey % 900 + 100)', '10')} / 10000.0 AS share FROM o""",
)
def billing_months(spark: SparkSession, folder: str) -> DataFrame:
    d = F.col("day")
    heading = R.text("NOTA DE COBRO ", F.upper(R.month_word(d)), f"{R.NBSP}", F.year(d).cast("string"))
    share = R.text("Alícuota 0,", F.lpad((F.col("o_custkey") % 900 + 100).cast("string"), 5, "0"), " %")
    return R.orders(spark, folder).select(
        "o_orderkey", F.inline(F.array(S.billing_month(heading))), "o_custkey"
    ).select(
        "o_orderkey", "label", "year", "first_day", "last_day",
        S.parse_alicuota(R.text("Alícuota 0,", F.lpad((F.col("o_custkey") % 900 + 100).cast("string"), 5, "0"), " %")).alias("share"),
    )


@query(
    "normalized_documents",
    """WITH d AS (SELECT doc_id, trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', ' ', 'g')) AS norm, text FROM documents)
      SELECT doc_id, length(norm)::INTEGER AS norm_chars, md5(norm) AS norm_md5,
      md5(regexp_replace(lower(text), '[^a-z0-9]+', '_', 'g')) AS slug_md5 FROM d""",
)
def normalized_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Anchor normalisation of whole documents."""
    df = table(spark, folder, "documents").select("doc_id", "text", S.norm_text(F.col("text")).alias("norm"))
    return df.select(
        "doc_id", F.length("norm").alias("norm_chars"), F.md5("norm").alias("norm_md5"),
        F.md5(S.slug(F.col("text"))).alias("slug_md5"),
    )


@query(
    "line_skeletons",
    f"""WITH {ORDERS} SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'nota de cobro depto' ELSE 'total del a pagar' END AS skeleton FROM o""",
)
def line_skeletons(spark: SparkSession, folder: str) -> DataFrame:
    line = R.choose(
        R.key() % 2,
        R.text("Nota de Cobro ", R.month_word(F.col("day")), " ", F.year("day").cast("string"), " Depto. ", F.col("o_custkey").cast("string")),
        R.text("Total del MES a pagar ", F.col("total").cast("string")),
    )
    return R.orders(spark, folder).select("o_orderkey", S.line_skeleton(S.norm_text(line)).alias("skeleton"))


@query(
    "finite_values",
    """SELECT event_id, CASE WHEN event_id % 4 IN (0, 1) THEN value END AS finite FROM events""",
)
def finite_values(spark: SparkSession, folder: str) -> DataFrame:
    value = R.choose(
        F.col("event_id") % 4, F.col("value"), F.col("value"),
        F.lit(float("nan")), F.col("value") + F.lit(float("inf")),
    )
    return table(spark, folder, "events").select("event_id", S.finite(value).alias("finite"))


@query(
    "unit_rates",
    f"""WITH {SUMS} SELECT o_orderkey, {half_even('price * 100', 'quantity')} / 100.0 AS rate,
      {half_even('price * (o_custkey % 100)', '100')} AS part FROM b""",
)
def unit_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Rounding to an even neighbour on exact decimals."""
    return R.order_sums(spark, folder).select(
        "o_orderkey", S.rate(F.col("price"), F.col("quantity")).alias("rate"),
        S.percent_of(F.col("price"), F.col("o_custkey") % 100).alias("part"),
    )


@query(
    "page_text",
    """WITH t AS (SELECT page_id, regexp_replace(regexp_replace(replace(html, 't="</p>"', 't="(/p("'), '>[^<>]*&[^\\s;<>]{0,33}$', '>'), '<!--.*?-->|<[^>]*>', '', 'g') AS t FROM pages),
      d AS (SELECT page_id, regexp_replace(replace(replace(replace(regexp_replace(t, '<[^>]*$', ''), '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;?', '&', 'g') AS t FROM t)
      SELECT page_id, length(regexp_replace(t, '\\s+', '', 'g'))::INTEGER AS visible_chars FROM d""",
)
def page_text(spark: SparkSession, folder: str) -> DataFrame:
    text = html_to_text(F.col("html"))
    df = table(spark, folder, "pages").select("page_id", text.alias("text"))
    return df.select(
        "page_id", F.length(F.regexp_replace("text", rules.CS + r"\s+", "")).alias("visible_chars")
    )
