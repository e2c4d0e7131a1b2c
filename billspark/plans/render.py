"""Bills written out from the base tables, as inputs of the registered queries.

The base tables hold no bills. Each order, with its lines and its customer,
is printed here as a message, a text layer or an OCR response; the queries read
the values back, and the SQL they are checked against only looks at the base
columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from billspark import rules
from billspark.plans.registry import table



def key() -> Column:
    return F.col("o_orderkey")


MONTH_NAMES = [
    "enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre",
    "octubre", "noviembre", "diciembre",
]
SHORT_MONTHS = ["Ene", "Feb", "Mar", "Abr", "May", "Jun", "Jul", "Ago", "Sep", "Oct", "Nov", "Dic"]
NBSP = " "


def clp(amount: Column) -> Column:
    """1234567 -> 1.234.567"""
    return F.translate(F.format_number(amount, 0), ",", ".")


def decimals(number: Column, digits: int = 2) -> Column:
    """1234.5 -> 1.234,50"""
    return F.translate(F.format_number(number, digits), ",.", ".,")


def plain_decimals(number: Column, digits: int = 2) -> Column:
    """1234.5 -> 1234,50"""
    return F.translate(F.format_number(number, digits), ".,", ",")


def dmy(date: Column, separator: str = "-") -> Column:
    return F.date_format(date, f"dd{separator}MM{separator}yyyy")


def month_word(date: Column, names: list[str] = MONTH_NAMES) -> Column:
    return F.get(F.array(*[F.lit(m) for m in names]), F.month(date) - 1)


def lines(*parts: Column | str) -> Column:
    return F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def choose(selector: Column, *options: Column | str | None) -> Column:
    """The option whose position equals the selector."""
    chain = F.when(selector == 0, _lit(options[0]))
    for i, option in enumerate(options[1:], 1):
        chain = chain.when(selector == i, _lit(option))
    return chain


def _lit(option: Column | str | None) -> Column:
    return option if isinstance(option, Column) else F.lit(option)


def _dealt_out(df: DataFrame) -> DataFrame:
    """Rows dealt out by order: a bill takes far more work than the rows that it is rendered from."""
    spark = df.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(parts, "o_orderkey")


def _plain_orders(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        "o_orderkey",
        "o_custkey",
        F.floor("o_totalprice").alias("total"),
        F.to_date("o_orderdate").alias("day"),
        "o_orderpriority",
    )


def orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with a whole total and a plain date, dealt out by key."""
    return _dealt_out(_plain_orders(spark, folder))


def order_sums(spark: SparkSession, folder: str) -> DataFrame:
    """Orders that have lines, with whole sums over them (exact in integers), dealt out after the join."""
    sums = (
        table(spark, folder, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.sum(F.col("l_quantity").cast("bigint")).alias("quantity"),
            F.sum(F.floor("l_extendedprice")).alias("price"),
            F.sum(F.col("l_linenumber").cast("bigint")).alias("numbers"),
        )
    )
    joined = _plain_orders(spark, folder).join(sums, F.col("l_orderkey") == key()).drop("l_orderkey")
    return _dealt_out(joined)


# --------------------------------------------------------------------- messages
def general_mail(df: DataFrame) -> DataFrame:
    """Subject and body in several wordings, by key."""
    total = F.col("total")
    folio = F.lpad(key().cast("string"), 10, "0")
    customer = text(F.lpad(F.col("o_custkey").cast("string"), 8, "0"), "-", (F.col("o_custkey") % 10).cast("string"))
    subject = choose(
        key() % 5, text("Aviso folio: ", folio), text("Documento Nro. ", folio),
        text("Número: ", folio), text("Su boleta: ", folio), "Aviso mensual",
    )
    amount = choose(
        key() % 4, text("Total a pagar: $ ", clp(total)), text(f"MONTO TOTAL:{NBSP}$ ", clp(total)),
        text("Valor a pagar: ", clp(total), " CLP"), text("Total a pagar: $", total.cast("string")),
    )
    issued = choose(
        key() % 3, text("Fecha de emisión: ", dmy(F.col("day"), "/")),
        text("FECHA EMISIÓN: ", F.dayofmonth("day").cast("string"), " de ", month_word(F.col("day")), " de ",
             F.year("day").cast("string")),
        text("Boleta electrónica N° 77 del ", dmy(F.col("day"))),
    )
    body = lines(
        "Estimado cliente:",
        choose(key() % 3, text("Número de Cliente: ", customer), text(f"N° Cliente{NBSP}: ", customer),
               text("Customer number: ", customer)),
        text("Dirección de suministro: Calle   ", F.col("o_custkey").cast("string"), " Norte"),
        F.when(key() % 7 != 3, amount),
        issued,
        text("Fecha de vencimiento: ", dmy(F.date_add("day", 15))),
    )
    return df.withColumns({"subject": subject, "body": body, "service_type": F.lit(rules.TELECOM)})


def provider_mail(df: DataFrame) -> DataFrame:
    """Messages of several providers; every sixth kind names none of them."""
    kind = key() % 8
    sender = choose(
        kind, "boletas@aguasandinas.cl", "facturas@enel.cl", "no-reply@metrogas.cl",
        "avisos@correo.cl", "juan@gmail.com", "info-constructora-sur@dte-patagonia.cl",
        "x@abc.cl", "avisos@correo.cl",
    )
    subject = choose(
        kind, "Su boleta de Aguas Andinas", "Cuenta Enel disponible", "Boleta Metrogas",
        "Gastos Comunes y agua caliente", "Reenvio: nota de cobro", "Factura mensual",
        "Factura CONSTRUCTORA DEL SUR S.A.", "Saludos",
    )
    body = choose(
        kind, text("Total a pagar $ ", clp(F.col("total"))), "Consumo real", "Gas natural",
        "Administración Edificio Central", "Copropietarios", "Pago mensual", "Pago mensual", "Hola",
    )
    return df.select(
        "o_orderkey",
        (F.col("o_custkey") % 10).cast("string").alias("mailbox_id"),
        key().alias("msg_seq"),
        text("<", key().cast("string"), "@mail>").alias("message_id"),
        sender.alias("from_addr"),
        subject.alias("subject"),
        body.alias("body"),
        body.alias("detect_text"),
    )


# ---------------------------------------------------------------------- text layers
def gas_text(df: DataFrame) -> DataFrame:
    body = lines(
        text("Total a pagar $ ", clp(F.col("total"))),
        text("Gas consumido ( ", plain_decimals(F.col("quantity") + 0.25), " m3s )"),
        text("Fecha de emisión: ", dmy(F.col("day"))),
    )
    return df.select("o_orderkey", F.lit(rules.GAS).alias("service_type"), body.alias("text"))


def electricity_text(df: DataFrame) -> DataFrame:
    admin, energy = F.col("numbers") + 700, F.col("price")
    transport, fund = F.col("total"), F.col("quantity") + 1000
    with_fund = key() % 2 == 0
    end = F.date_add("day", 28)

    def spelled(d: Column) -> Column:
        return text(F.dayofmonth(d).cast("string"), " ", month_word(d, SHORT_MONTHS), " ", F.year(d).cast("string"))

    body = lines(
        "Total a pagar:",
        F.when(key() % 3 != 0, text("Monto del periodo ", spelled(F.col("day")), " - ", spelled(end))),
        "",
        text("$", clp(energy + transport)),
        "",
        "Administración del servicio",
        text("Electricidad Consumida (", F.col("quantity").cast("string"), "kWh)"),
        "Transporte de electricidad",
        F.when(with_fund, F.lit("Cargo Fondo de Estabilización Ley 21.472")),
        "",
        F.when(with_fund, F.lit("$\n$\n$\n$")).otherwise(F.lit("$\n$\n$")),
        "",
        clp(admin), clp(energy), clp(transport), F.when(with_fund, clp(fund)),
        "",
        text("Período de lectura: ", dmy(F.col("day"), "/"), " - ", dmy(end, "/")),
        text("Tipo de tarifa contratada: BT1-T", (key() % 4).cast("string")),
        text("Potencia conectada: ", (key() % 9 + 1).cast("string"), ",500 kW"),
        "Área Típica: AREA 1 S Caso 3 (a)",
        text("Subestación: SUB ", (F.col("o_custkey") % 50).cast("string")),
    )
    return df.select("o_orderkey", F.lit(rules.ELECTRICITY).alias("service_type"), body.alias("text"))


def water_text(df: DataFrame) -> DataFrame:
    """Four layouts by key: one row, with interest, peak split, a row per line."""
    volume, half = F.col("quantity") + 0.5, F.col("quantity") / 4
    fixed, water = F.col("numbers") + 900, F.col("price")
    peak, collect = F.col("quantity") + 40, F.col("total")
    treat, interest = F.col("quantity") * 3 + 100, F.col("numbers") + 10
    labels = ["CARGO FIJO", "RECOLECCION AGUAS SERVIDAS", "TRATAMIENTO AGUAS SERVIDAS",
              "SUBTOTAL SERVICIO", "INTERÉS DEUDA", "TOTAL VENTA", "DESCUENTO LEY REDONDEO"]
    one = "CONSUMO AGUA POTABLE"
    split = one + " NO PUNTA\n" + one + " PUNTA"
    v, h = plain_decimals(volume), plain_decimals(half)
    gap = "\nTOTAL A PAGAR\n"
    combined = lines(
        labels[0], one, *labels[1:4], *labels[5:], gap, v, v, v, "",
        clp(fixed), clp(water), clp(collect), clp(treat), clp(fixed + water), clp(fixed + water), "-1",
    )
    late = lines(
        labels[0], one, *labels[1:], gap, v, v, v, "", clp(fixed), clp(water), clp(collect), clp(treat),
        clp(fixed + water), clp(interest), clp(fixed + water), "-3",
    )
    peaks = lines(
        labels[0], split, *labels[1:4], *labels[5:], gap, v, h, v, v, "",
        clp(fixed), clp(water), clp(peak), clp(collect), clp(treat), clp(fixed), clp(fixed), "-8",
    )
    per_line = lines(
        text("CARGO FIJO ", clp(fixed)),
        text(one, " NO PUNTA ", v, " ", clp(water)),
        text(one, " PUNTA | ", h, " | ", clp(peak)),
        text("RECOLECCIÓN AGUAS SERVIDAS ", v, " ", clp(collect)),
        text("TRATAMIENTO AGUAS SERVIDAS ", v, " ", clp(treat)),
        text("INTERÉS DEUDA ", clp(interest)),
        "DESCUENTO LEY REDONDEO -2",
    )
    body = lines(
        text("SEÑOR RESIDENTE\nCALLE  ", F.col("o_custkey").cast("string"), "\nSANTIAGO"),
        text("VENCIMIENTO\n\n", F.date_format("day", "dd"), "-",
             F.upper(month_word(F.col("day"), SHORT_MONTHS)), "-", F.year("day").cast("string")),
        choose(key() % 4, combined, late, peaks, per_line),
        text("\nCONSUMO TOTAL\n1,00 m3\n", v, " m3\nMODALIDAD DE PRORRATEO"),
        text("Cargo fijo = $ ", clp(fixed)),
        F.when(key() % 8 == 0, F.lit("Metro cúbico agua potable punta = $ 1.605,25")),
        F.when(key() % 8 == 0, F.lit("Metro cúbico agua potable no punta = $ 611,48")),
        text("Nro de cuenta\n\n", F.lpad(F.col("o_custkey").cast("string"), 7, "0"), "-",
             (F.col("o_custkey") % 10).cast("string")),
    )
    return df.select("o_orderkey", F.lit(rules.WATER).alias("service_type"), body.alias("text"))


def note_amounts(df: DataFrame) -> DataFrame:
    """Amounts of a common-expenses note: building, share, funds, hot water and charge."""
    building = F.col("total") * 100
    share = F.lpad((F.col("o_custkey") % 900 + 100).cast("string"), 5, "0")
    return df.select(
        "o_orderkey", "o_custkey", "day",
        building.alias("building"),
        share.alias("share"),
        (key() % 11 + 1).alias("pct"),
        (F.col("total") % 5000 + 1000).alias("hot"),
        (F.col("total") % 9000 + 2000).alias("charge"),
        (F.col("total") + 500000).alias("printed"),
    )


def note_text(df: DataFrame) -> DataFrame:
    """A note's text layer; amounts that the arithmetic settles are printed wrong on purpose."""
    first = F.trunc("day", "month")
    body = lines(
        "Fecha Emisión: ", "Pagar Hasta: ", "", dmy(F.col("day")),
        text(F.date_format(F.date_add("day", 10), "dd-MM-"), (F.year(F.date_add("day", 10)) + F.when(key() % 5 == 0, 2).otherwise(0)).cast("string")),
        text("Edificio ", choose(key() % 3, "Jose Miguel", "Jon Miguel", "Los Alerces")),
        "RUT: 11222333-4",
        text("Calle Norte ", F.col("o_custkey").cast("string"), " - Santiago"),
        text("Nota de Cobro ", F.initcap(month_word(first)), " ", F.year("day").cast("string")),
        text("Depto. ", (F.col("o_custkey") % 300).cast("string")),
        "ANA PRUEBA",
        text("O ", F.col("share"), " % "),
        text("$ ", clp(F.col("building") % 977 + 1)),
        text("Gasto común a Prorratear\n$ ", clp(F.col("building"))),
        F.when(key() % 4 != 1, text("PROVISION DE FONDOS ", F.col("pct").cast("string"), "% DEL GASTO MENSUAL")),
        F.when(key() % 4 == 1, text("Subtotal Departamento $ ", clp(F.col("printed")))),
        text("Agua Caliente 410,254000 413,511000 3,257000 6.120,45 $ ", clp(F.col("hot"))),
        text("Subtotal Consumo $ ", clp(F.col("hot"))),
        F.when(key() % 6 != 2, text("Cargo Fijo $ ", clp(F.col("charge")))),
        text("Subtotal Recargos\nTotal del mes\n$ ", clp(F.col("charge")), "\n$ ", clp(F.col("printed") * 3)),
        text("Fecha ultimo Pago\nMonto ultimo Pago\nFolio ultimo Pago\n", dmy(F.col("day")),
             "\n$ ", clp(F.col("hot")), "\n", (key() % 90000 + 10000).cast("string")),
    )
    return df.select(
        "o_orderkey", F.lit(rules.COMMON_EXPENSES).alias("service_type"), body.alias("text")
    )


# --------------------------------------------------------------------- responses
def joined(pieces: list[Column | str | None]) -> Column:
    """Concatenation; neighbouring literals are merged, NULL pieces are left out."""
    merged: list[Column | str] = []
    for piece in pieces:
        if isinstance(piece, str) and merged and isinstance(merged[-1], str):
            merged[-1] += piece
        elif piece is not None:
            merged.append(piece)
    return F.concat_ws("", *[F.lit(p) if isinstance(p, str) else p for p in merged])


def _box(left: int, top: int, pieces: list[Column | str]) -> list[Column | str]:
    right, bottom = left + 80, top + 10
    corners = f"[[{left},{top}],[{right},{top}],[{right},{bottom}],[{left},{bottom}]]"
    return ['{"confidence":0.9,"box":' + corners + ',"text":"', *pieces, '"}']


def boxes_json(rows: list[list[tuple[int, list[Column | str]]]]) -> Column:
    """One page of positioned texts: rows of (left, text pieces)."""
    pieces: list[Column | str | None] = ['{"pages":[{"page":1,"lines":[']
    first = True
    for i, row in enumerate(rows):
        for left, words in row:
            pieces += ["" if first else ",", *_box(left, 20 + 25 * i, words)]
            first = False
    return joined([*pieces, "]}]}"])


def note_rows(values: bool = True) -> list[list[tuple[int, list[Column | str]]]]:
    """Rows of a common-expenses note as printed; ``values=False`` leaves only labels."""
    c = F.col

    def v(*words: Column | str) -> list[Column | str]:
        return list(words) if values else []

    rows: list[list[tuple[int, list[Column | str]]]] = [
        [(300, ["Fecha Emisión:"]), (450, v(dmy(c("day"))))],
        [(10, v("Edificio Los Alerces")), (300, ["Pagar Hasta:"]), (450, v(dmy(F.date_add("day", 5), "/")))],
        [(10, v("RUT: 11222333-4"))],
        [(10, v("Calle Norte ", c("o_custkey").cast("string"), " - Santiago"))],
        [(10, v("Nota de Cobro ", F.initcap(month_word(c("day"))), " ", F.year("day").cast("string"))),
         (300, v("Depto. ", (c("o_custkey") % 300).cast("string")))],
        [(10, ["Copropietario"]), (200, v("ANA PRUEBA")), (400, ["Fecha último Pago"]), (600, v(dmy(c("day"))))],
        [(10, ["Alícuota Total"]), (200, v("0,", c("share"), " %")), (400, ["Monto último Pago"]), (600, v("$ ", clp(c("hot"))))],
        [(10, ["Gasto común a Prorratear"]), (250, v("$ ", clp(c("building")))), (400, ["Folio último Pago"]),
         (600, v((key() % 90000 + 10000).cast("string")))],
        [(10, ["Concepto"]), (300, ["Detalle"]), (500, ["Monto a pagar"])],
        [(10, v("Gasto común")), (300, v("0,", c("share"), " %")), (500, v("$ ", clp(c("building") % 977 + 1)))],
        [(10, ["PROVISIÓN DE FONDOS", *v(" ", c("pct").cast("string"), "% DEL GASTO MENSUAL")]), (500, v("$ ", clp(c("hot"))))],
        [(300, ["Subtotal Departamento"]), (500, v("$ ", clp(c("printed"))))],
        [(200, ["Lectura Anterior"]), (300, ["Lectura Actual"]), (420, ["Consumos"]), (500, ["Valor"])],
        [(10, v("Agua Caliente")), (200, v("120,400000")), (300, v("124,900000")), (420, v("4,500000")),
         (500, v("8.215,32")), (600, v("$ ", clp(c("hot"))))],
        [(400, ["Subtotal Consumo"]), (600, v("$ ", clp(c("hot"))))],
        [(10, ["Cargo Fijo"]), (600, v("$ ", clp(c("charge"))))],
        [(10, ["Subtotal Recargos"]), (600, v("$ ", clp(c("charge"))))],
        [(10, ["Total del mes"]), (600, v("$ ", clp(c("printed") * 3)))],
    ]
    return [[cell for cell in row if cell[1]] for row in rows if any(cell[1] for cell in row)]


def structured_json() -> Column:
    """A template response in three shapes by key: machine keys, labelled rows, match details."""
    c = F.col
    note = (
        '"fechas_emision":{"fecha_emision":"', dmy(c("day"), "/"), '","pagar_hasta":"', dmy(F.date_add("day", 5)),
        '"},"tabla_nota_cobro":{"nota_cobro_mes_depto":"Nota de Cobro ', month_word(c("day")), " ", F.year("day").cast("string"),
        " Depto. ", (c("o_custkey") % 300).cast("string"), '","alicuota_total":"0,', c("share"),
        ' %","gasto_comun_a_prorratear":"$ ', clp(c("building")), '"}',
    )
    machine = joined([
        '{"sections":{', *note, ',"tabla_desglose_departamento":{"gasto_comun_monto":"$ ', clp(c("hot")),
        '","provision_fondos_porcentaje":"', c("pct").cast("string"), ' %","provision_fondos_monto":null},'
        '"tabla_consumos_generales":{"agua_caliente_lectura_anterior":"120,400000","agua_caliente_lectura_actual":"124,900000",'
        '"subtotal_consumo":"$ ', clp(c("hot")), '"},"tabla_gastos_por_unidad":{"cargo_fijo":"$ ', clp(c("charge")),
        '","total_del_mes":"$ ', clp(c("printed")), '"}}}',
    ])
    labelled = joined([
        '{"sections":{', *note, ',"tabla_desglose_departamento":{"rows":[{"Gasto común":{"Detalle":"0,95110 %","Monto a pagar":"$ ',
        clp(c("hot")), '"}},{"PROVISIÓN DE FONDOS ', c("pct").cast("string"), '% DEL GASTO MENSUAL":{"Detalle":"',
        c("pct").cast("string"), ',00 %","Monto a pagar":"$ 1"}}]},"tabla_consumos_generales":{"rows":[{"Agua Caliente":'
        '{"Lectura Anterior":"120,400000","Lectura Actual":"124,900000","Consumos":"4,500000","Valor":"8.215,32","Total":"$ ',
        clp(c("hot")), '"}}],"Subtotal Consumo":{"value":"$ ', clp(c("hot")), '"}},"tabla_gastos_por_unidad":{"Cargo Fijo":"$ ',
        clp(c("charge")), '","Total del mes":"$ ', clp(c("printed")), '"}}}',
    ])
    details = joined([
        '{"sections":{', *note, ',"tabla_gastos_por_unidad":{"cargo_fijo":null}},"meta":{"matched_sections":{'
        '"tabla_desglose_departamento":{"line_results":{"gasto_comun_monto":{"value":"$ ', clp(c("hot")),
        '"},"provision_fondos_porcentaje":{"value":"', c("pct").cast("string"), '"}}},"tabla_consumos_generales":{"line_results":{'
        '"subtotal_consumo":{"value":"$ ', clp(c("hot")), '"}}},"tabla_gastos_por_unidad":{"line_results":{"cargo_fijo":{"value":"$ ',
        clp(c("charge")), '"},"total_del_mes":{"value":"$ ', clp(c("printed")), '"}}}}}}',
    ])
    return choose(key() % 3, machine, labelled, details)
