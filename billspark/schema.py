"""Column names and types shared by extractors, merges and outputs."""

from __future__ import annotations

MONEY, REAL, TEXT, WHOLE = "bigint", "double", "string", "int"

ATTRS: dict[str, str] = {
    # every service
    "folio": TEXT, "emission_date": TEXT, "billing_period_start": TEXT,
    "billing_period_end": TEXT, "customer_number": TEXT, "address": TEXT, "due_date": TEXT,
    "total_amount": MONEY, "consumption": REAL, "consumption_unit": TEXT,
    "pdf_path": TEXT, "pdf_url": TEXT,
    # water
    "fixed_charge": MONEY, "water_consumption": MONEY, "water_consumption_non_peak": MONEY,
    "water_consumption_peak": MONEY, "water_consumption_non_peak_m3": REAL,
    "water_consumption_peak_m3": REAL, "wastewater_recolection": MONEY,
    "wastewater_treatment": MONEY, "other_charges": MONEY, "subtotal": MONEY,
    "cost_per_unit_non_peak": REAL, "cost_per_unit_peak": REAL,
    "cubic_meter_collection": REAL, "cubic_meter_treatment": REAL,
    "meter_reading": "array<string>", "meter_number": TEXT,
    # gas and electricity
    "cost_per_m3s": REAL, "service_administration": MONEY, "electricity_consumption": MONEY,
    "electricity_transport": MONEY, "stabilization_fund": MONEY, "cost_per_kwh": REAL,
    "tariff_code": TEXT, "connected_power": MONEY, "connected_power_kw": REAL,
    "connected_power_unit": TEXT, "area": TEXT, "substation": TEXT,
    # common expenses and hot water
    "billing_period_month": TEXT, "billing_period_year": TEXT, "building_name": TEXT,
    "building_rut": TEXT, "apartment": TEXT, "owner_name": TEXT, "alicuota": REAL,
    "building_total_expense": MONEY, "gastos_comunes_amount": MONEY, "fondos_pct": WHOLE,
    "fondos_amount": MONEY, "funds_provision": MONEY, "funds_provision_percentage": WHOLE,
    "subtotal_departamento": MONEY, "subtotal_recargos": MONEY, "cargo_fijo": MONEY,
    "gc_total": MONEY, "gross_common_expenses": MONEY,
    "gross_common_expenses_percentage": REAL, "last_payment_date": TEXT,
    "last_payment_amount": MONEY, "last_payment_folio": TEXT,
    "hot_water_reading_prev": REAL, "hot_water_reading_curr": REAL,
    "hot_water_consumption": REAL, "hot_water_consumption_unit": TEXT,
    "hot_water_cost_per_m3": REAL, "hot_water_amount": MONEY, "subtotal_consumo": MONEY,
    "previous_measure": REAL, "actual_measure": REAL,
}

MESSAGE_FIELDS: dict[str, str] = {
    "mailbox_id": TEXT, "msg_seq": MONEY, "message_id": TEXT, "from_addr": TEXT, "subject": TEXT,
    "date_header": TEXT, "body": TEXT, "detect_text": TEXT, "html": TEXT, "plain_text": TEXT,
    "plain_raw": TEXT,
    "attachments": "array<struct<filename:string,content_type:string,head:binary,size:bigint>>",
    "tracker_urls": "array<string>", "received_ts": "timestamp", "parse_error": TEXT,
}
MESSAGES = ", ".join(f"{name} {kind}" for name, kind in MESSAGE_FIELDS.items())
