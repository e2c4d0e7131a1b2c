"""Rule lists, word lists, patterns and constants.

Everything in this module is data. The values decide which text is recognised
as what, so they are stated literally and kept together; no logic lives here.

Patterns are written for Java's regex engine, which is the one Spark uses.
``CI`` and ``CS`` switch on Unicode character classes (so a non-breaking space
counts as white space and accented letters fold case) and make ``\\n`` the only
line terminator; ``CI`` also ignores case.
"""

from __future__ import annotations

CI = "(?iUd)"
CS = "(?Ud)"
CIM = "(?iUdm)"
CSM = "(?Udm)"

# ---------------------------------------------------------------- fixed values
# Service types.
WATER = "water"
GAS = "gas"
ELECTRICITY = "electricity"
TELECOM = "telecom"
COMMON_EXPENSES = "common_expenses"
HOT_WATER = "hot_water"
UNKNOWN = "unknown"

# Confidence per kind of source.
CONF_TEXT = 70.0
CONF_OCR = 85.0
CONF_DERIVED = 60.0
CONF_OVERRIDE = 100.0

# Operating values.
RECENT_MESSAGES = 100
DEFAULT_INTERVAL_MONTHS = 1
TEMPLATE_ID = "coe_administraciones"
MAX_YEAR_DRIFT = 4
KNOWN_BUILDING_NAME = "Edificio Jose Miguel"
BUILDING_NAME_SIMILARITY = 0.75

# ---------------------------------------------------------------- fixed values
# Words that mark a message as billing-related.
BILLING_INDICATORS = [
    r"factura|boleta|cuenta|cuota|pago|cobro|consumo",
    r"invoice|bill|payment|statement",
    r"folio|número de cuenta|nº de cliente",
    r"vencimiento|fecha de pago|total a pagar|monto",
    r"due date|amount due|total due",
    r"dte|documento tributario|electronica",
]

# Ordered provider rules: (pattern, display name, service type).
SERVICE_RULES = [
    (
        r"agua\s+caliente|agua\s+caliente\s+sanitaria|calefacci[oó]n\s+central",
        "Hot Water",
        HOT_WATER,
    ),
    (r"aguas?\s+andinas?", "Water", WATER),
    (r"essbio|esval|nuevo\s+sur", "Water", WATER),
    (r"enel|chilectra|cge\s+distribuci[oó]n", "Electricity", ELECTRICITY),
    (r"metrogas|lipigas|gasco", "Gas", GAS),
    (r"movistar|entel|claro|wom|vtr", "Telecom", TELECOM),
    (r"mundo.*pac[íi]fico|gtd|telefonica", "Telecom", TELECOM),
    (
        r"gastos?\s+comunes?|nota\s+de\s+cobro|administraci[oó]n\s+edificio|"
        r"administradora\s+(?:de\s+)?edificio|copropietarios?",
        "Common Expenses",
        COMMON_EXPENSES,
    ),
    (r"compa[ñn][íi]a\s+de\s+agua", "Water", WATER),
    (r"compa[ñn][íi]a\s+de\s+electricidad", "Electricity", ELECTRICITY),
    (r"compa[ñn][íi]a\s+de\s+gas", "Gas", GAS),
]

# Old service ids and the id used today.
LEGACY_SERVICE_IDS = {
    "aguas_andinas": "water",
    "agua_caliente": "hot_water",
    "agua": "water",
    "electricidad": "electricity",
    "telecomunicaciones": "telecom",
    "internet_tv": "telecom",
    "gastos_comunes": "common_expenses",
}

# Sender domains that say nothing about the provider.
GENERIC_WEBMAIL = ["gmail", "hotmail", "yahoo", "outlook", "live", "icloud", "protonmail"]

# Words of a subject that do not identify a provider.
SUBJECT_SKIP_WORDS = [
    "fwd", "cuenta", "factura", "boleta", "pago", "este", "esta",
    "mes", "del", "para", "con", "las", "los", "que", "reenvio",
    "enero", "febrero", "marzo", "abril", "mayo", "junio", "julio",
    "agosto", "septiembre", "octubre", "noviembre", "diciembre",
]

# Sender-domain and company-name patterns.
SENDER_DOMAIN = r"@([a-zA-Z0-9\-]+)\.[a-zA-Z]+"
DOMAIN_PREFIX = CI + r"^(admin|noreply|info|facturacion|dte|no-reply)"
DOMAIN_SUFFIX = CI + r"(admin|cl)$"
COMPANY_IN_SUBJECT = CS + r"\b[A-ZÁÉÍÓÚÑ]{2,}(?:\s+[A-ZÁÉÍÓÚÑ]{2,}){0,3}\s+S\.?A\.?"
COMPANY_SUFFIX = CS + r"\s+S\.?A\.?$"
SUBJECT_WORD = r"[a-zA-ZáéíóúñÁÉÍÓÚÑ]{4,}"

# ---------------------------------------------------------------- fixed values
# Spanish month names and abbreviations.
MONTHS = {
    "ene": 1, "enero": 1,
    "feb": 2, "febrero": 2,
    "mar": 3, "marzo": 3,
    "abr": 4, "abril": 4,
    "may": 5, "mayo": 5,
    "jun": 6, "junio": 6,
    "jul": 7, "julio": 7,
    "ago": 8, "agosto": 8,
    "sep": 9, "sept": 9, "septiembre": 9,
    "oct": 10, "octubre": 10,
    "nov": 11, "noviembre": 11,
    "dic": 12, "diciembre": 12,
}

# ---------------------------------------------------------------- fixed values
# Dates as they are printed, in order of preference.
DATE_PATTERNS = [
    CI + r"([0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4})",
    CI + r"([0-9]{1,2}-[A-Za-zÁÉÍÓÚÑáéíóúñ]{3,12}-[0-9]{4})",
    CI + r"([0-9]{1,2}\s+(?:de\s+)?[a-zA-ZáéíóúÁÉÍÓÚñÑ]+\s+(?:de\s+)?[0-9]{4})",
    CI + r"([A-Za-z]+\s+[0-9]{1,2},?\s+[0-9]{4})",
]

# Labels in front of general fields.
TOTAL_LABEL = CI + (
    r"(?:total\s+a\s+pagar|monto\s+total|total\s+factura|importe\s+total"
    r"|total\s+cuenta|valor\s+a\s+pagar|total)[:\s]+"
)
CUSTOMER_LABEL = CI + (
    r"(?:n[úu]mero\s+(?:de\s+)?(?:cuenta|cliente)|n[°º]\s*(?:cuenta|cliente)"
    r"|cuenta\s+n[°º]?|cliente\s+n[°º]?|customer\s+(?:number|no\.?)|account\s+(?:number|no\.?))"
    r"[:\s]+"
)
ADDRESS_LABEL = CI + r"(?:direcci[oó]n(?:\s+de\s+suministro)?|domicilio|address)[:\s]+"
DUE_LABEL = CI + r"fecha\s+de\s+vencimiento[:\s]+"
EMISSION_LABEL = CI + (
    r"(?:fecha\s+(?:de\s+)?(?:emisi[oó]n|la\s+boleta|boleta|documento|factura)"
    r"|emitid[ao]\s+el)[:\s]+"
)
BOLETA_ISSUED_ON = CI + (
    r"\b(?:n[°º.]?\s*)?boleta(?:\s+electr[oó]nica)?"
    r"(?:\s+n[°º.]?)?\s*\d*\s+del\s+"
    r"([0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4})"
)

# Amounts. Digit groups first; a plain digit run is accepted as well.
NUMBER = r"(?:[0-9]{1,3}(?:[.,][0-9]{3})+(?:[.,][0-9]{1,2})?|[0-9]+(?:[.,][0-9]{1,2})?)"
CURRENCY_AMOUNT = CI + r"(?:\$\s*" + NUMBER + r"|" + NUMBER + r"\s*(?:CLP|USD|EUR|pesos?))"
DOLLAR_AMOUNT = CI + r"\$\s*(" + NUMBER + r")"
PLAIN_AMOUNT = CI + r"(" + NUMBER + r")"
CUSTOMER_NUMBER = r"([0-9][0-9.\-]{0,19})"

# Folio in a subject line, in order of preference.
SUBJECT_FOLIO = [
    CI + r"folio[:\s]*([0-9]{6,})",
    CI + r"nro\.?\s+([0-9]{6,})",
    CI + r"n[úu]mero[:\s]*([0-9]{6,})",
    CI + r"boleta[:\s]*([0-9]{6,})",
    CI + r"factura[:\s]*([0-9]{6,})",
]

# ---------------------------------------------------------------- fixed values
# Water messages.
CUBIC_METRES = CI + r"([0-9]+(?:[.,][0-9]+)?)\s*m[³3]"
METER_READING_LABEL = CI + r"lectura\s+(?:anterior|actual|medidor)[:\s]+"
METER_NUMBER_LABEL = CI + r"(?:n[úu]mero\s+de\s+medidor|medidor\s+n[°º]?)[:\s]+"
METER_READING_VALUE = r"([0-9][0-9.,]{0,15})"
METER_NUMBER_VALUE = r"([A-Za-z0-9][-A-Za-z0-9]{1,19})"
WATER_PACKED = CS + r"([A-ZÁÉÍÓÚÑ][A-ZÁÉÍÓÚÑ0-9 ,\.\-/#]{5,}?)\s{2,}(\d{5,}-\d)\b"

# Water documents.
WATER_ADDRESS = CI + r"se[ñn]or\s+residente\s*[\r\n]+([^\r\n]+)[\r\n]+([^\r\n]+)"
WATER_ACCOUNT = CI + r"nro\s+de\s+cuenta\s+(\d{5,}-\d)\b"
WATER_DUE = CI + r"vencimiento\s+(\d{1,2}-[A-Z]{3}-\d{4})\b"
WATER_TOTAL_LABEL = r"consumo\s+total"
WATER_TOTAL_END = r"modalidad"
WATER_TOTAL_WINDOW = 200
TARIFF_AMOUNT = r"=\s*\$\s*([0-9]+(?:[.,][0-9]{3})*(?:[.,][0-9]{1,2})?)"
WATER_FIXED_TARIFF = CI + r"cargo\s+fijo\s*" + TARIFF_AMOUNT
WATER_NON_PEAK_TARIFF = (
    CI + r"metro\s+c[uú]bico\s+agua\s+potable\s+no\s+punta\s*" + TARIFF_AMOUNT
)
WATER_PEAK_TARIFF = CI + r"metro\s+c[uú]bico\s+agua\s+potable\s+punta\s*" + TARIFF_AMOUNT
WATER_FIXED_ROW = CIM + r"^CARGO\s+FIJO(?:\s*\|\s*|\s+)(-?[0-9][0-9.,]*)\s*$"

_VOLUME_LINE = r"\s*([0-9][0-9.,]*)\s*\n"
_FIRST_AMOUNT_LINE = r"\s*([0-9][0-9.,]+)\s*\n"
_AMOUNT_LINE = r"([0-9][0-9.,]+)\s*\n"
_LAST_AMOUNT = r"(-?[0-9][0-9.,]*)"
# Labels, then values: single potable-water row (10 groups).
WATER_TABLE_COMBINED = CI + (
    r"CARGO\s+FIJO\n"
    r"CONSUMO\s+AGUA\s+POTABLE\n"
    r"RECOLECCI[OÓ]N\s+AGUAS\s+SERVIDAS\n"
    r"TRATAMIENTO\s+AGUAS\s+SERVIDAS\n"
    r"SUBTOTAL\s+SERVICIO\n"
    r"TOTAL\s+VENTA\n"
    r"DESCUENTO\s+LEY\s+REDONDEO\n"
    r"\s*TOTAL\s+A\s+PAGAR\s*\n"
    + _VOLUME_LINE * 3
    + _FIRST_AMOUNT_LINE
    + _AMOUNT_LINE * 5
    + _LAST_AMOUNT
)
# Labels, then values: with an interest row (8 groups).
WATER_TABLE_INTEREST = CI + (
    r"CARGO\s+FIJO\n"
    r"CONSUMO\s+AGUA\s+POTABLE\n"
    r"RECOLECCION\s+AGUAS\s+SERVIDAS\n"
    r"TRATAMIENTO\s+AGUAS\s+SERVIDAS\n"
    r"SUBTOTAL\s+SERVICIO\n"
    r"INTER[EÉ]S\s+DEUDA\n"
    r"TOTAL\s+VENTA\n"
    r"DESCUENTO\s+LEY\s+REDONDEO\n"
    r"\s*TOTAL\s+A\s+PAGAR\s*\n"
    r"\s*(?:[0-9][0-9.,]*\s*\n)+"
    + _FIRST_AMOUNT_LINE
    + _AMOUNT_LINE * 6
    + _LAST_AMOUNT
)
# Labels, then values: peak and non-peak rows (12 groups).
WATER_TABLE_PEAK = CI + (
    r"CARGO\s+FIJO\n"
    r"CONSUMO\s+AGUA\s+POTABLE\s+NO\s+PUNTA\n"
    r"CONSUMO\s+AGUA\s+POTABLE\s+PUNTA\n"
    r"RECOLECCI[OÓ]N\s+AGUAS\s+SERVIDAS\n"
    r"TRATAMIENTO\s+AGUAS\s+SERVIDAS\n"
    r"SUBTOTAL\s+SERVICIO\n"
    r"TOTAL\s+VENTA\n"
    r"DESCUENTO\s+LEY\s+REDONDEO\n"
    r"\s*TOTAL\s+A\s+PAGAR\s*\n"
    + _VOLUME_LINE * 4
    + _FIRST_AMOUNT_LINE
    + _AMOUNT_LINE * 6
    + _LAST_AMOUNT
)
# One row per line.
WATER_ROW_NON_PEAK = CIM + (
    r"^CONSUMO\s+AGUA\s+POTABLE\s+NO\s+PUNTA(?:\s*\|\s*|\s+)"
    r"([0-9]+(?:[.,][0-9]+)?)(?:\s*\|\s*|\s+)(-?[0-9][0-9.,]*)\s*$"
)
WATER_ROW_PEAK = CIM + (
    r"^CONSUMO\s+AGUA\s+POTABLE\s+PUNTA(?:\s*\|\s*|\s+)"
    r"([0-9]+(?:[.,][0-9]+)?)(?:\s*\|\s*|\s+)(-?[0-9][0-9.,]*)\s*$"
)
WATER_ROW_COLLECTION = CIM + r"^RECOLECCI[OÓ]N\s+AGUAS\s+SERVIDAS[^\n]*?(-?[0-9][0-9.,]*)\s*$"
WATER_ROW_TREATMENT = CIM + r"^TRATAMIENTO\s+AGUAS\s+SERVIDAS[^\n]*?(-?[0-9][0-9.,]*)\s*$"
WATER_ROW_INTEREST = CIM + r"^INTER[EÉ]S\s+DEUDA[^\n]*?(-?[0-9][0-9.,]*)\s*$"
WATER_ROW_ROUNDING = CIM + r"^DESCUENTO\s+LEY\s+REDONDEO[^\n]*?(-?[0-9][0-9.,]*)\s*$"

# ---------------------------------------------------------------- fixed values
# Gas messages and documents.
GAS_VOLUME = CI + r"([0-9]+(?:[.,][0-9]+)?)\s*(m[³3]s?)"
GAS_MAIL_LABEL = CI + r"(?:consumo\s+(?:de\s+)?gas|consumo|volumen\s+consumido)[:\s]+"
GAS_TEXT_LABEL = CI + r"gas\s+consumido[:\s\(]+"

# ---------------------------------------------------------------- fixed values
# Electricity messages.
KWH = CI + r"([0-9]+(?:[.,][0-9]+)?)\s*kWh"
KWH_LABEL = CI + r"(?:consumo|energ[íi]a\s+consumida)[:\s]+"
ELECTRICITY_ADDRESS = CI + r"ubicado\s+en\s+([\s\S]{10,120}?)\s+ya\s+est[aá]"
ELECTRICITY_FOLIO = CI + r"n[°º]\s*boleta\s+(\d{5,})"
ELECTRICITY_NEXT_PERIOD = CI + (
    r"pr[oó]ximo\s+periodo\s+de\s+facturaci[oó]n\s+"
    r"(\d{1,2}-\d{1,2}-\d{4})\s*-\s*(\d{1,2}-\d{1,2}-\d{4})"
)

# Electricity documents.
ELECTRICITY_PERIOD = CI + (
    r"(\d{1,2})\s+(ene|feb|mar|abr|may|jun|jul|ago|sep|oct|nov|dic)[a-z]*\.?\s+(\d{4})"
    r"\s*[-–]\s*"
    r"(\d{1,2})\s+(ene|feb|mar|abr|may|jun|jul|ago|sep|oct|nov|dic)[a-z]*\.?\s+(\d{4})"
)
ELECTRICITY_READ_PERIOD = CI + (
    r"per[íi]odo\s+de\s+lectura[:\s]+(\d{1,2}/\d{1,2}/\d{4})\s*[-–]\s*(\d{1,2}/\d{1,2}/\d{4})"
)
_GROUPED = r"([0-9]{1,3}(?:[.,][0-9]{3})*)"
ELECTRICITY_TABLE_FUND = CI + (
    r"administraci[oó]n\s+del\s+servicio\s*\n"
    r"electricidad\s+consumida\s*\(([0-9]+(?:[.,][0-9]+)?)\s*(kWh)\)\s*\n"
    r"transporte\s+de\s+electricidad\s*\n"
    r"cargo\s+fondo\s+de\s+estabilizaci[oó]n[^\n]*\n"
    r"\s*\$\s*\n\$\s*\n\$\s*\n\$\s*\n\s*"
    + (_GROUPED + r"\s*\n") * 3
    + _GROUPED
)
ELECTRICITY_TABLE_PLAIN = CI + (
    r"administraci[oó]n\s+del\s+servicio\s*\n"
    r"electricidad\s+consumida\s*\(([0-9]+(?:[.,][0-9]+)?)\s*(kWh)\)\s*\n"
    r"transporte\s+de\s+electricidad\s*\n"
    r"\s*\$\s*\n\$\s*\n\$\s*\n\s*"
    + (_GROUPED + r"\s*\n") * 2
    + _GROUPED
)
TARIFF_CODE = CI + r"tipo\s+de\s+tarifa\s+contratada[:\s]+([^\n\r]+)"
CONNECTED_POWER = CI + r"potencia\s+conectada[:\s]+([0-9]+(?:[.,][0-9]+)?)\s*(kVA|kW|MW)"
AREA = CI + r"[áa]rea\s+t[íi]pica[:\s]+([^\n\r]+)"
SUBSTATION = CI + r"subestaci[oó]n[:\s]+([^\n\r]+)"

# ---------------------------------------------------------------- fixed values
# Common-expenses documents.
NOTE_PERIOD = CI + r"nota\s+d[eo]\s+cobro\s+([A-Za-záéíóúñÁÉÍÓÚÑ]+)\s+(\d{4})"
NOTE_DATES = CI + (
    r"fecha\s+em[^:\n]+[:\s]+pagar\s+[^:\n]+[:\s]+"
    r"[\s\S]{0,30}?(\d{2}[/-]\d{2}[/-]\d{4})"
    r"[\s\S]{0,20}?(\d{2}[/-]\d{2}[/-]\d{4})"
)
BUILDING_RUT = CI + r"rut[:\s]+(\d{7,9}-[\dkK])"
BUILDING_NAME = CI + r"edificio\s+([\w\s]{2,40}?)\s*\n"
BUILDING_ADDRESS = CI + r"rut:\s*\d[\d.-]+-[\dkK]\s*\n([^\n]{5,})"
APARTMENT = CI + r"d[oe]pto\.?\s*(\d+)"
OWNER = CSM + r"^([A-ZÀ-Ü]{2,}(?:\s+[A-ZÀ-Ü]{2,}){1,4})\s*$"
ALICUOTA_TEXT = CI + r"(?:al[íif]cuota\s+total\s*)?[O0]\s*[,.]?\s*(\d{4,6})\s*%"
BUILDING_TOTAL = CI + (
    r"(?:gasto\s+com[uú]n|outo\s+c:om[oó]n|prorratu?r)[^\n]*\n[^\n]*\$\s*([\d.]+)"
    r"|\$\s*(\d[\d.]{8,})"
)
BILL_AMOUNT = CI + r"[O0]\s*\d{4,6}\s*%\s*[\s\n]*\$\s*([\d.,]+)"
FUNDS_PCT = CI + r"fondos\s+(\d+)\s*%"
FUNDS_AMOUNT = CI + r"\d{1,2}[0,]\s*0\s*%\s*[\s\n]*\$\s*([\d.,]+)"
FIXED_CHARGE = CI + r"cargo\s+fijo[\s\S]{0,40}?\$\s*([\d.,]+)"
SUBTOTAL_APARTMENT = CI + r"subtotal\s+departamento[\s\S]{0,40}?\$\s*([\d.,]+)"
THREE_AMOUNTS = CS + r"\$\s*([\d.,]+)\s*\n\s*\$\s*([\d.,]+)\s*\n\s*\$\s*([\d.,]+)"
SUBTOTAL_CHARGES = CI + r"subtotal\s+recargos[\s\S]{0,60}?\$\s*([\d.,]+)"
TOTALS_SECTION = CI + r"subtotal\s+recargos[\s\S]{0,300}"
LAST_PAYMENT_DATE = CI + r"fecha\s+ult[il][lm][oi]\s+pago[\s\S]{0,100}?(\d{2}[/-]\d{2}[/-]\d{4})"
LAST_PAYMENT_AMOUNT = CI + r"monto\s+ult[il][lm][oi]\s+pago[\s\S]{0,100}?\$\s*([\d.,]+)"
LAST_PAYMENT_FOLIO = CI + r"fol[il][oi]\s+ulti[\s\S]{0,100}?(\d{5,6})"
HOT_WATER_ROW = CI + (
    r"agua\s+caliente[\s\S]{0,60}?"
    r"([\d,.]{6,}\d{3})[\s|]+"
    r"([\d,.]{6,}\d{3})[\s|]+"
    r"(?:([\d,.]+)[\s|]+)?"
    r"([\d.,]+)"
    r"(?:[\s\S]{0,20}?\$\s*([\d.,]+))?"
)
SUBTOTAL_HOT_WATER = CI + r"subtotal\s+consumo[\s\S]{0,60}?\$\s*([\d.,]+)"

# ---------------------------------------------------------------- fixed values
# Reference layout of a common-expenses note, used for OCR anchors and drift.
NOTE_LAYOUT = """\
Fecha Emisión:	dd-mm-aaaa
Pagar Hasta:	dd-mm-aaaa

Edificio Nombre Referencial
RUT: XX.XXX.XXX-X
Dirección Referencial 000 - Comuna
Fono: +56XXXXXXXXX

|| **Nota de Cobro Mes aaaa** | **Depto. 000** ||
|---|---|---|---|
| **Copropietario** | **NOMBRE APELLIDO REFERENCIAL** | **Fecha último Pago** | **dd-mm-aaaa** |
| **Alícuota Total** | **0,00000 %** | **Monto último Pago** | **$ 0.000.000** |
| **Gasto común a Prorratear** | **$ 0.000.000** | **Folio último Pago** | **00000** |

| Concepto | Detalle | Monto a pagar |
|---|---|---|
| Gasto común | 0,00000 % | $ 0.000.000 |
| PROVISIÓN DE FONDOS 0% DEL GASTO MENSUAL | 0,00 % | $ 0.000.000 |
|| **Subtotal Departamento** | $ 0.000.000 |

| **Consumos Generales** | **Lectura Anterior** | **Lectura Actual** | **Consumos** | **Valor **| **Total** |
|--|--|--|--|--|--|
| Agua Caliente | 000,000000 | 000,000000 | 0,000000 | 0.000,00 | $ 0.000.000 |
||||| **Subtotal Consumo** | $ 0.000.000 |

| Gastos por Unidad | Monto |
|---|---|
| Cargo Fijo | $ 0.000.000 |
|||
| **Subtotal Recargos** | $ 0.000.000 |
| **Total del mes** | **$ 0.000.000** |
|||
| **Total a pagar obligaciones económicas** | $ 0.000.000 |

Administración
"""

# Anchor -> (tokens its label must hold, output fields it feeds).
OCR_ANCHORS = {
    "emission_date": (["fecha", "emision"], ["emission_date"]),
    "due_date": (["pagar", "hasta"], ["due_date"]),
    "owner_name": (["copropietario"], ["owner_name"]),
    "alicuota": (["alicuota", "total"], ["alicuota"]),
    "building_total_expense": (["gasto", "comun", "prorratear"], ["building_total_expense"]),
    "concepto": (["concepto"], ["gastos_comunes_amount"]),
    "fondos_amount": (["provision", "fondos"], ["fondos_amount"]),
    "subtotal_departamento": (["subtotal", "departamento"], ["subtotal_departamento"]),
    "hot_water_prev": (["lectura", "anterior"], ["hot_water_reading_prev"]),
    "hot_water_curr": (["lectura", "actual"], ["hot_water_reading_curr"]),
    "hot_water_consumption": (["consumos"], ["hot_water_consumption"]),
    "hot_water_cost": (["valor"], ["hot_water_cost_per_m3"]),
    "hot_water_amount": (["subtotal", "consumo"], ["hot_water_amount", "subtotal_consumo"]),
    "cargo_fijo": (["cargo", "fijo"], ["cargo_fijo"]),
    "subtotal_recargos": (["subtotal", "recargos"], ["subtotal_recargos"]),
    "total_amount": (["total", "mes"], ["total_amount"]),
    "last_payment_date": (["fecha", "ultimo", "pago"], ["last_payment_date"]),
    "last_payment_amount": (["monto", "ultimo", "pago"], ["last_payment_amount"]),
    "last_payment_folio": (["folio", "ultimo", "pago"], ["last_payment_folio"]),
}
OCR_DATE = CS + r"(\d{2}[/-]\d{2}[/-]\d{4})"
OCR_ALICUOTA = CS + r"(?:^|[^0-9])0[,.](\d{4,6})\s*%"
OCR_PAYMENT_FOLIO = CS + r"(\d{5,6})"
OCR_FUNDS_PCT = r"fondos\s+(\d+)"
OCR_METER_VALUE = CS + r"(\d{1,3}[,.]\d{6})"
OCR_UNIT_COST = CS + r"([\d.]+,\d{2}|[\d,]+\.\d{2})(?!\d)"
STRUCTURED_ALICUOTA = CS + r"0[,.](\d{4,6})\s*%"
OCR_PHONE_LINE = CS + r"^[+\d().\-\s]{6,}$"

# OCR geometry and scoring.
OCR_MIN_DIMENSION = 1.0
OCR_CHAR_WIDTH = 8.0
OCR_ROW_FACTOR = 0.9
OCR_LEFT_TOLERANCE = 25.0
ANCHOR_TOKEN_WEIGHT = 10.0
ANCHOR_COMPLETE_BONUS = 10.0
ROW_LINES_DIVISOR = 10.0

# Layout drift.
DRIFT_MIN_MISSING = 4
DRIFT_MIN_MISSING_RATIO = 0.35
DRIFT_MIN_GAPS = 4
DRIFT_MIN_GAP_RATIO = 0.35
DRIFT_MIN_UNEXPECTED = 1
PLACEHOLDER_TOKENS = [
    "dd", "mm", "aaaa", "xx", "xxx", "xxxx", "xxxxxxxxx",
    "referencial", "nombre", "apellido", "mes",
]
OPTIONAL_LINE_TOKENS = [
    ["paga", "tu", "gasto", "comun"],
    ["ingresa", "a"],
    ["codigo", "cliente"],
    ["pagos", "kastor"],
]

# ---------------------------------------------------------------- fixed values
# Structured responses: output -> (section, accepted keys).
STRUCTURED_FIELDS = {
    "note": ("tabla_nota_cobro", ["nota_cobro_mes_depto"]),
    "emission": ("fechas_emision", ["fecha_emision"]),
    "due": ("fechas_emision", ["pagar_hasta"]),
    "building_name": ("datos_comunidad", ["nombre_edificio"]),
    "building_rut": ("datos_comunidad", ["rut"]),
    "street": ("datos_comunidad", ["direccion"]),
    "city": ("datos_comunidad", ["ciudad"]),
    "owner_name": ("tabla_nota_cobro", ["copropietario"]),
    "alicuota": ("tabla_nota_cobro", ["alicuota_total"]),
    "building_total_expense": ("tabla_nota_cobro", ["gasto_comun_a_prorratear"]),
    "gastos_comunes_amount": (
        "tabla_desglose_departamento", ["gasto_comun_monto", "gasto_comun", "monto_gasto_comun"],
    ),
    "fondos_pct": (
        "tabla_desglose_departamento",
        ["provision_fondos_porcentaje", "provision_de_fondos_porcentaje", "fondos_porcentaje"],
    ),
    "fondos_amount": (
        "tabla_desglose_departamento",
        ["provision_fondos_monto", "provision_de_fondos_monto", "fondos_monto"],
    ),
    "subtotal_departamento": ("tabla_desglose_departamento", ["subtotal_departamento"]),
    "hot_water_reading_prev": ("tabla_consumos_generales", ["agua_caliente_lectura_anterior"]),
    "hot_water_reading_curr": ("tabla_consumos_generales", ["agua_caliente_lectura_actual"]),
    "hot_water_consumption": ("tabla_consumos_generales", ["agua_caliente_consumos"]),
    "hot_water_cost_per_m3": ("tabla_consumos_generales", ["agua_caliente_valor"]),
    "hot_water_amount": ("tabla_consumos_generales", ["agua_caliente_total"]),
    "subtotal_consumo": ("tabla_consumos_generales", ["subtotal_consumo"]),
    "cargo_fijo": ("tabla_gastos_por_unidad", ["cargo_fijo"]),
    "subtotal_recargos": ("tabla_gastos_por_unidad", ["subtotal_recarga", "subtotal_recargos"]),
    "month_total": ("tabla_gastos_por_unidad", ["total_del_mes"]),
    "obligations_total": ("tabla_gastos_por_unidad", ["total_a_pagar_obligaciones_economicas"]),
    "last_payment_date": ("tabla_nota_cobro", ["fecha_ultimo_pago_tabla"]),
    "last_payment_amount": ("tabla_nota_cobro", ["monto_ultimo_pago"]),
    "last_payment_folio": ("tabla_nota_cobro", ["folio_ultimo_pago"]),
}
# Structured responses: output -> (section, row label tokens, column tokens).
# Column of a table that holds percentages, and a percentage printed in a row's label.
PERCENT_CELL = "porcentaje"
LABEL_PERCENT = CS + r"(\d+(?:[.,]\d+)?)\s*%"
STRUCTURED_CELLS = {
    "gastos_comunes_amount": (
        "tabla_desglose_departamento", ["gasto", "comun"], ["monto", "total", "valor"],
    ),
    "fondos_pct": (
        "tabla_desglose_departamento", ["provision", "fondos"], ["porcentaje", "detalle"],
    ),
    "fondos_amount": (
        "tabla_desglose_departamento", ["provision", "fondos"], ["monto", "total", "valor"],
    ),
    "hot_water_reading_prev": (
        "tabla_consumos_generales", ["agua", "caliente"], ["lectura anterior"],
    ),
    "hot_water_reading_curr": (
        "tabla_consumos_generales", ["agua", "caliente"], ["lectura actual"],
    ),
    "hot_water_consumption": (
        "tabla_consumos_generales", ["agua", "caliente"], ["consumos", "consumo"],
    ),
    "hot_water_cost_per_m3": ("tabla_consumos_generales", ["agua", "caliente"], ["valor"]),
    "hot_water_amount": ("tabla_consumos_generales", ["agua", "caliente"], ["total", "monto"]),
}

# ---------------------------------------------------------------- fixed values
# Fields that decide completeness of a common-expenses reading.
CORE_FIELDS = ["gastos_comunes_amount", "subtotal", "fixed_charge", "gc_total"]
HOT_WATER_FIELDS = [
    "hot_water_consumption", "hot_water_cost_per_m3", "hot_water_amount",
    "hot_water_reading_prev", "hot_water_reading_curr",
]
READING_FIELDS = [*CORE_FIELDS, "funds_provision", *HOT_WATER_FIELDS]

# Readings: service type -> [(attribute, label, unit, suffix)].
_WATER_READINGS = [
    ("fixed_charge", "Fixed Charge", "$", "water_fixed_charge"),
    ("cost_per_unit_non_peak", "Cost Per Unit Non Peak", "$/m³", "water_cost_per_unit_non_peak"),
    ("cost_per_unit_peak", "Cost Per Unit Peak", "$/m³", "water_cost_per_unit_peak"),
    ("cubic_meter_collection", "Cubic Meter Collection", "$/m³", "water_cubic_meter_collection"),
    ("cubic_meter_treatment", "Cubic Meter Treatment", "$/m³", "water_cubic_meter_treatment"),
    ("water_consumption_non_peak_m3", "Water Non Peak m³", "m³", "water_non_peak_m3"),
    ("water_consumption_non_peak", "Water Non Peak Charge", "$", "water_non_peak_charge"),
    ("water_consumption_peak_m3", "Water Peak m³", "m³", "water_peak_m3"),
    ("water_consumption_peak", "Water Peak Charge", "$", "water_peak_charge"),
    ("wastewater_recolection", "Wastewater Recolection", "$", "wastewater_recolection"),
    ("wastewater_treatment", "Wastewater Treatment", "$", "wastewater_treatment"),
    ("subtotal", "Subtotal", "$", "water_subtotal"),
    ("other_charges", "Other Charges", "$", "water_other_charges"),
]
_ELECTRICITY_READINGS = [
    ("service_administration", "Service Administration", "$", "electricity_service_administration"),
    ("electricity_transport", "Electricity Transport", "$", "electricity_transport"),
    ("stabilization_fund", "Stabilization Fund", "$", "electricity_stabilization_fund"),
    ("electricity_consumption", "Electricity Consumption", "$", "electricity_consumption_charge"),
]
_COMMON_READINGS = [
    ("gastos_comunes_amount", "Bill", "$", "gc_bill"),
    ("funds_provision", "Funds Provision", "$", "gc_funds_provision"),
    ("subtotal", "Subtotal", "$", "gc_subtotal"),
    ("fixed_charge", "Fixed Charge", "$", "gc_fixed_charge"),
    ("gc_total", "Total", "$", "gc_total"),
    ("hot_water_consumption", "Hot Water Consumption", "m³", "gc_hw_consumption"),
    ("hot_water_cost_per_m3", "Hot Water Cost Per Unit", "$/m³", "gc_hw_cost_per_m3"),
    ("hot_water_amount", "Hot Water Amount", "$", "gc_hw_amount"),
    ("hot_water_reading_prev", "Hot Water Prev Reading", "m³", "gc_hw_prev_reading"),
    ("hot_water_reading_curr", "Hot Water Curr Reading", "m³", "gc_hw_curr_reading"),
]
READING_DEFS = {
    WATER: [
        ("consumption", "Consumption", "m³", "consumption"),
        ("total_amount", "Total Amount", "$", "total_amount"),
        *_WATER_READINGS,
    ],
    GAS: [
        ("consumption", "Consumption", "m³", "consumption"),
        ("total_amount", "Total Amount", "$", "total_amount"),
        ("cost_per_m3s", "Cost Per Unit", "$/m³", "cost_per_unit"),
    ],
    ELECTRICITY: [
        ("consumption", "Consumption", "kWh", "consumption"),
        ("total_amount", "Total Amount", "$", "total_amount"),
        ("cost_per_kwh", "Cost Per Unit", "$/kWh", "cost_per_unit"),
        *_ELECTRICITY_READINGS,
    ],
    HOT_WATER: [
        ("hot_water_consumption", "Consumption", "m³", "consumption"),
        ("hot_water_amount", "Total Amount", "$", "total_amount"),
        ("hot_water_cost_per_m3", "Cost Per Unit", "$/m³", "cost_per_unit"),
    ],
    COMMON_EXPENSES: _COMMON_READINGS,
    TELECOM: [
        ("consumption", "Consumption", None, "consumption"),
        ("total_amount", "Total Amount", "$", "total_amount"),
    ],
    UNKNOWN: [
        ("consumption", "Consumption", None, "consumption"),
        ("total_amount", "Total Amount", "$", "total_amount"),
    ],
}
# Suffix -> attribute, for suffixes that mean the same on every service type.
BREAKDOWN_SUFFIXES = {
    suffix: attr
    for attr, _, _, suffix in [*_WATER_READINGS, *_ELECTRICITY_READINGS, *_COMMON_READINGS]
}
# Primary total where it is not total_amount.
TOTAL_FIELD = {COMMON_EXPENSES: "gc_total", HOT_WATER: "hot_water_amount"}

# Status details: attribute -> value shown when it is missing.
STATUS_COMMON = [
    "folio", "emission_date", "billing_period_start", "billing_period_end",
    "customer_number", "address", "due_date",
]
STATUS_DEFAULTS = {
    GAS: {"pdf_url": ""},
    ELECTRICITY: {
        "tariff_code": "0", "connected_power": 0, "connected_power_unit": "0",
        "area": "0", "substation": "0", "pdf_url": "",
    },
    WATER: {},
    COMMON_EXPENSES: {
        "gross_common_expenses": 0, "gross_common_expenses_percentage": 0.0,
        "funds_provision_percentage": 0, "hot_water_amount": 0, "subtotal_consumo": 0,
        "previous_measure": 0.0, "actual_measure": 0.0,
        "extraction_status": "failed", "extraction_source": "unknown",
    },
    HOT_WATER: {"previous_measure": 0.0, "actual_measure": 0.0},
}

# ---------------------------------------------------------------- fixed values
# Link labels that announce a bill.
LINK_LABEL = CI + (
    r"ver\s+boleta"
    r"|descarg(?:ar?|ue[ns]?)\s+(?:su\s+|tu\s+)?boleta"
    r"|revisa(?:r)?\s+(?:tu\s+|su\s+)?boleta"
    r"|ver\s+factura"
    r"|descarg(?:ar?|ue[ns]?)\s+(?:su\s+|tu\s+)?factura"
    r"|ver\s+(?:tu\s+|su\s+)?factura"
    r"|ver\s+cuenta"
    r"|ver\s+comprobante"
    r"|descarg(?:ar?|ue[ns]?)\s+comprobante"
    r"|ver\s+documento"
    r"|descarg(?:ar?|ue[ns]?)\s+(?:pdf|documento|archivo)"
    r"|descarg(?:ar?|ue[ns]?)\s+(?:el\s+|este\s+|un\s+|su\s+|tu\s+)?(?:pdf|documento|archivo)"
    r"|haga\s+clic(?:k)?\s+aqu[ií]\s+para\s+descargar"
    r"|click\s+here\s+to\s+download"
    r"|bajar\s+(?:pdf|boleta|factura)"
    r"|obtener\s+(?:pdf|boleta|factura)"
    r"|imprimir\s+boleta"
    r"|imprimir\s+factura"
    r"|visualizar\s+(?:boleta|factura|documento)"
    r"|ver\s+cobro"
    r"|download.*(?:invoice|bill|statement|pdf|receipt)"
    r"|view.*(?:invoice|bill|statement|receipt)"
    r"|get.*(?:invoice|bill|pdf)"
)
LINK_PDF = CI + r"\.pdf($|\?)"
LINK_HREF = CI + (
    r"[/=_-](?:pdf|boleta|factura|invoice|bill|comprobante|receipt|documento)"
    r"|(?:pdf|boleta|factura|invoice|bill|comprobante|receipt|documento)[/=_?&]"
    r"|descargar|download|visualizar|acepta\.com|fidelizador\.com"
)
URL_IN_TEXT = CI + r"https?://[^\s<>\"']+"
BRACKETED_URL = CS + r"^<(https?://[^\s<>\"']+)>$"
SCRIPT_BLOCK = r"(?iUds)<script\b[^>]*>(.*?)</script[^>]*>"
SCRIPT_CONTEXT_CHARS = 200
META_REFRESH = CI + (
    r"<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh[\"']?\b[^>]*"
    r"\bcontent\s*=\s*[\"'][^\"']*;\s*url\s*=\s*([^\"'>\s]+)[\"']"
    r"|<meta\b[^>]*\bcontent\s*=\s*[\"'][^\"']*;\s*url\s*=\s*([^\"'>\s]+)[\"']"
    r"[^>]*\bhttp-equiv\s*=\s*[\"']?refresh[\"']?"
)
JS_LOCATION = CI + (
    r"(?:window\.)?location(?:\.href)?\s*=\s*[\"']([^\"']+)[\"']"
    r"|location\.(?:replace|assign)\s*\(\s*[\"']([^\"']+)[\"']"
)
VIEWER_URL = CI + (
    r"[\"']([^\"'<>\s]*\?(?:[^\"'<>\s]*&)?url="
    r"(https?%3A%2F%2F[^\"'&\s<>]*)[^\"'<>\s]*)"
)
TRACKER_PREFIX = "https://trackercl1.fidelizador.com/"
TRACKER_URL = (
    rb"(?i)https://trackercl1\.fidelizador\.com/(?:[^\r\n\"'<>=\s]|=[0-9A-Fa-f]{2}|=\r?\n)+"
)
BILL_IMAGE_MARKER = r"\[image:\s*ver\s+boleta\s*\]"
# Attributes that may carry the real target of a placeholder link.
LINK_DATA_ATTRIBUTES = ["data-url", "data-href", "data-link", "data-target", "data-action"]
# Tags that bound the text belonging to a link.
CONTAINER_TAGS = [
    "td", "th", "tr", "div", "p", "li", "h1", "h2", "h3", "h4", "h5", "h6",
    "section", "article", "table", "tbody", "thead", "tfoot",
]
# Tags whose URL attribute embeds another document.
EMBED_ATTRIBUTES = {
    "iframe": "src", "frame": "src", "embed": "src", "object": "data", "form": "action",
}
PDF_MAGIC = b"%PDF"
# ------------------------------------------------------- end of fixed values
