"""Queries over messages, accounts and their state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from billspark import rules
from billspark.functions.scalar import parse_bill_date
from billspark.operators.accounts import (
    account_matches,
    changed_only,
    latest_bill,
    match_accounts,
    recent_messages,
)
from billspark.operators.confidence import EMPTY_MAP, with_fields
from billspark.operators.derive import changed_fields, recompute
from billspark.operators.detect import classify_type, detect_services, new_services
from billspark.operators.merge import (
    attempt_ocr,
    carry_forward,
    combine_sources,
    default_confidence,
    document_over_email,
    fill_missing,
    keep_previous,
    needs_fallback,
    template_offered,
    with_diagnostics,
)
from billspark.operators.outputs import (
    cycle_summary,
    is_complete,
    last_update,
    problem_status,
    readings,
    status_details,
)
from billspark.operators.overrides import apply_overrides, set_values
from billspark.operators.poll import refresh
from billspark.plans import render as R
from billspark.plans.registry import query, table
from billspark.schema import ATTRS
from billspark.sources.messages import parse_messages

ORDERS = """o AS (SELECT o_orderkey, o_custkey, CAST(floor(o_totalprice) AS BIGINT) AS total,
  CAST(o_orderdate AS DATE) AS day FROM orders)"""
MAIL = """m AS (SELECT o_orderkey AS k, CAST(o_custkey % 10 AS VARCHAR) AS mailbox_id, o_orderkey % 8 AS kind FROM orders)"""
SUBJECTS = """['Su boleta de Aguas Andinas','Cuenta Enel disponible','Boleta Metrogas','Gastos Comunes y agua caliente',
  'Reenvio: nota de cobro','Factura mensual','Factura CONSTRUCTORA DEL SUR S.A.','Saludos']"""
SENDERS = """['boletas@aguasandinas.cl','facturas@enel.cl','no-reply@metrogas.cl','avisos@correo.cl','juan@gmail.com',
  'info-constructora-sur@dte-patagonia.cl','x@abc.cl','avisos@correo.cl']"""
SERVICES = f"""{MAIL}, v(kind, service_name, service_id, service_type) AS (VALUES
  (0, 'Water', 'water', 'water'), (1, 'Electricity', 'electricity', 'electricity'), (2, 'Gas', 'gas', 'gas'),
  (3, 'Hot Water', 'hot_water', 'hot_water'), (3, 'Common Expenses', 'common_expenses', 'common_expenses'),
  (4, 'Common Expenses', 'common_expenses', 'common_expenses'), (5, 'Patagonia', 'patagonia', 'unknown'),
  (6, 'Constructora Del Sur', 'constructora_del_sur', 'unknown')),
  d AS (SELECT mailbox_id, service_id, any_value(service_name) AS service_name, any_value(service_type) AS service_type,
    arg_min(kind, k) AS first_kind, count(*) AS email_count FROM m JOIN v USING (kind) GROUP BY 1, 2)"""


def _mail(spark: SparkSession, folder: str) -> DataFrame:
    return R.provider_mail(R.orders(spark, folder))


# -------------------------------------------------------------------- detection
@query(
    "service_detection",
    f"""WITH {SERVICES} SELECT mailbox_id, service_id, service_name, service_type,
      {SUBJECTS}[first_kind + 1] AS sample_subject, {SENDERS}[first_kind + 1] AS sample_from, email_count FROM d""",
)
def service_detection(spark: SparkSession, folder: str) -> DataFrame:
    return detect_services(_mail(spark, folder))


@query(
    "new_services",
    f"""WITH {SERVICES}, known AS (SELECT DISTINCT CAST(c_custkey % 10 AS VARCHAR) AS mailbox_id,
        CASE c_custkey % 10 % 3 WHEN 0 THEN 'water' WHEN 1 THEN 'electricity' ELSE 'common_expenses' END AS service_id FROM customer
        UNION SELECT DISTINCT CAST(c_custkey % 10 AS VARCHAR), 'patagonia' FROM customer WHERE c_custkey % 5 = 0)
      SELECT mailbox_id, service_id, email_count FROM d WHERE NOT EXISTS
        (SELECT 1 FROM known WHERE known.mailbox_id = d.mailbox_id AND known.service_id = d.service_id)""",
)
def new_services_query(spark: SparkSession, folder: str) -> DataFrame:
    """Old ids of configured services count as configured."""
    customers = table(spark, folder, "customer")
    mailbox = (F.col("c_custkey") % 10).cast("string").alias("mailbox_id")
    accounts = customers.select(
        mailbox, R.choose(F.col("c_custkey") % 10 % 3, "agua", "electricidad", "gastos_comunes").alias("service_id")
    )
    offered = customers.filter(F.col("c_custkey") % 5 == 0).select(
        mailbox, F.lit("patagonia").alias("service_id")
    )
    fresh = new_services(detect_services(_mail(spark, folder)), accounts, offered)
    return fresh.select("mailbox_id", "service_id", "email_count")


@query(
    "service_types",
    f"""WITH {MAIL} SELECT ['water','electricity','gas','hot_water','common_expenses','unknown','unknown','unknown'][kind + 1] AS service_type,
      count(*) AS messages FROM m GROUP BY 1""",
)
def service_types(spark: SparkSession, folder: str) -> DataFrame:
    kind = classify_type(F.col("from_addr"), F.col("subject"))
    return _mail(spark, folder).groupBy(kind.alias("service_type")).agg(F.count(F.lit(1)).alias("messages"))


# ---------------------------------------------------------------------- matching
def _accounts(spark: SparkSession, folder: str) -> DataFrame:
    """One account per customer; its kind decides which strategy can find it."""
    key = F.col("c_custkey")
    kind = F.when(key % 7 == 0, F.lit(6)).otherwise((key % 6).cast("int"))
    return table(spark, folder, "customer").select(
        (key % 10).cast("string").alias("mailbox_id"),
        key.alias("account_id"),
        R.choose(kind, "zzz", "yyy", "gas", "nota_cobro", "qqq", "www", "nnn").alias("service_id"),
        R.choose(kind, "Zeta", "Edificio Central", "Gas", "Uno", "Dos", "Tres", "Nada").alias("service_name"),
        R.choose(kind, "", "", "", "", "", "electricity", "").alias("service_type"),
        R.choose(kind, "boletas@aguasandinas.cl", "", "", "ana@gmail.com", "", "", "").alias("sample_from"),
        R.choose(kind, "", "", "", "", "Fwd: factura Metrogas enero", "", "").alias("sample_subject"),
    )


ACCOUNTS = """a AS (SELECT c_custkey AS account_id, CAST(c_custkey % 10 AS VARCHAR) AS mailbox_id,
    CASE WHEN c_custkey % 7 = 0 THEN 6 ELSE c_custkey % 6 END AS akind FROM customer),
  r(akind, kind, strategy) AS (VALUES (0, 0, 'sender-domain'), (1, 3, 'service-name-keywords'), (2, 2, 'service-id-pattern'),
    (3, 4, 'service-id-pattern'), (4, 2, 'sample-subject-keywords'), (5, 1, 'service-type-pattern-fallback'))"""


@query(
    "match_strategy_counts",
    f"""WITH {MAIL}, {ACCOUNTS}, l AS (SELECT account_id, strategy, max(k) AS msg_seq FROM a JOIN r USING (akind)
        JOIN m ON m.mailbox_id = a.mailbox_id AND m.kind = r.kind GROUP BY ALL)
      SELECT coalesce(strategy, 'none') AS strategy, count(*) AS accounts, coalesce(sum(msg_seq), 0)::BIGINT AS newest
      FROM a LEFT JOIN l USING (account_id) GROUP BY 1""",
)
def match_strategy_counts(spark: SparkSession, folder: str) -> DataFrame:
    best = account_matches(_mail(spark, folder), _accounts(spark, folder))
    return best.groupBy(F.coalesce("strategy", F.lit("none")).alias("strategy")).agg(
        F.count(F.lit(1)).alias("accounts"), F.sum(F.coalesce("msg_seq", F.lit(0))).alias("newest")
    )


@query(
    "match_pairs",
    f"""WITH {MAIL}, {ACCOUNTS}, one AS (SELECT DISTINCT mailbox_id, akind FROM a)
      SELECT one.mailbox_id, one.akind::INTEGER AS account_kind, k AS msg_seq, strategy FROM one JOIN r USING (akind)
      JOIN m ON m.mailbox_id = one.mailbox_id AND m.kind = r.kind""",
)
def match_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Every message accepted by an account, for the distinct accounts of a mailbox."""
    fields = ["service_id", "service_name", "service_type", "sample_from", "sample_subject"]
    kinds = F.array(*[F.lit(x) for x in ("zzz", "yyy", "gas", "nota_cobro", "qqq", "www", "nnn")])
    accounts = (
        _accounts(spark, folder).select("mailbox_id", *fields).distinct()
        .withColumn("account_id", F.array_position(kinds, F.col("service_id")) - 1)
    )
    pairs = match_accounts(_mail(spark, folder), accounts)
    return pairs.select(
        "mailbox_id", F.col("account_id").cast("int").alias("account_kind"), "msg_seq", "strategy"
    )


@query(
    "recent_messages",
    f"""WITH {MAIL}, n AS (SELECT *, row_number() OVER (PARTITION BY mailbox_id ORDER BY k DESC) AS rn FROM m)
      SELECT mailbox_id, k AS msg_seq FROM n WHERE rn <= 100""",
)
def recent_messages_query(spark: SparkSession, folder: str) -> DataFrame:
    return recent_messages(_mail(spark, folder), rules.RECENT_MESSAGES).select("mailbox_id", "msg_seq")


@query(
    "latest_bill",
    f"""WITH {MAIL}, {ACCOUNTS}
      SELECT account_id, max(k) AS msg_seq, arg_max({SUBJECTS}[m.kind + 1], k) AS subject FROM a JOIN r USING (akind)
      JOIN m ON m.mailbox_id = a.mailbox_id AND m.kind = r.kind GROUP BY 1""",
)
def latest_bill_query(spark: SparkSession, folder: str) -> DataFrame:
    """Newest matching message per account, over all messages."""
    bills = latest_bill(_mail(spark, folder), _accounts(spark, folder))
    return bills.select("account_id", "msg_seq", "subject")


@query(
    "changed_only",
    """WITH l AS (SELECT o_custkey AS account_id, max(o_orderkey) AS msg_seq FROM orders GROUP BY 1)
      SELECT account_id, msg_seq FROM l WHERE NOT (account_id % 5 <> 4 AND account_id % 3 <> 0 AND account_id % 2 = 0)""",
)
def changed_only_query(spark: SparkSession, folder: str) -> DataFrame:
    """Latest bills against a stored state: new, different or incomplete ones remain."""
    latest = R.orders(spark, folder).groupBy(F.col("o_custkey").alias("account_id")).agg(
        F.max("o_orderkey").alias("msg_seq")
    )
    latest = latest.withColumn(
        "message_id", F.when(F.col("msg_seq") % 4 != 0, R.text("<", F.col("msg_seq").cast("string"), "@mail>"))
    )
    account, seq = F.col("account_id"), F.col("msg_seq").cast("string")
    mark = F.coalesce("message_id", seq)
    state = latest.filter(account % 5 != 4).select(
        "account_id",
        F.when(account % 3 == 0, F.lit("other")).otherwise(mark).alias("email_fingerprint"),
        F.lit(rules.GAS).alias("service_type"),
        F.current_timestamp().alias("last_updated"),
        F.lit(1.0).alias("consumption"),
        F.lit(1).cast("bigint").alias("total_amount"),
        F.when(account % 2 == 0, F.lit(2.0)).alias("cost_per_m3s"),
    )
    complete = with_fields(state, ATTRS).withColumn("is_complete", is_complete())
    return changed_only(latest, complete).select("account_id", "msg_seq")


# --------------------------------------------------------------------- overrides
def _common_state(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, folder, "customer").select(
        key.alias("account_id"),
        F.lit(rules.COMMON_EXPENSES).alias("service_type"),
        (key + 1000).alias("gastos_comunes_amount"),
        (key + 1500).alias("subtotal"),
        F.lit(200).cast("bigint").alias("cargo_fijo"),
        F.lit(300).cast("bigint").alias("hot_water_amount"),
        F.lit("2024-01-03 00:00:00").cast("timestamp").alias("extracted_at"),
    )


def _override_log(spark: SparkSession, folder: str) -> DataFrame:
    """Events as requests: some name the attribute, some only a reading's suffix."""
    kind = F.col("event_type")
    requests = table(spark, folder, "events").select(
        F.array("user_id").alias("targets"),
        F.when(kind == "signup", "gastos_comunes_amount").when(kind == "purchase", "total_amount").alias("attr"),
        F.when(kind == "click", "gc_fixed_charge").when(kind == "error", "gc_hw_amount")
        .when(kind == "view", "total_amount").alias("suffix"),
        F.floor("value").cast("double").cast("string").alias("value"),
        F.col("ts").cast("timestamp").alias("ts"),
    )
    accounts = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("account_id"), F.lit(rules.COMMON_EXPENSES).alias("service_type")
    )
    return set_values(requests, accounts)


OVERRIDES = """l AS (SELECT user_id, event_type, arg_max(CAST(floor(value) AS BIGINT), ts) AS v FROM events
    WHERE ts > TIMESTAMP '2024-01-03 00:00:00' GROUP BY 1, 2),
  p AS (SELECT c_custkey AS account_id, max(v) FILTER (event_type = 'signup') AS bill, max(v) FILTER (event_type = 'click') AS fixed,
    max(v) FILTER (event_type = 'error') AS hot, max(v) FILTER (event_type = 'purchase') AS total,
    max(v) FILTER (event_type = 'view') AS gc FROM customer LEFT JOIN l ON user_id = c_custkey GROUP BY 1),
  s AS (SELECT account_id, coalesce(bill, account_id + 1000) AS bill, coalesce(fixed, 200) AS fixed, coalesce(hot, 300) AS hot, total, gc,
    bill AS ob, fixed AS ofx, hot AS oh FROM p)"""


@query(
    "override_replay",
    f"""WITH {OVERRIDES} SELECT account_id, bill AS gastos_comunes_amount, account_id + 1500 - bill AS funds_provision,
      account_id + 1500 AS subtotal, fixed AS fixed_charge, fixed AS cargo_fijo, hot AS hot_water_amount,
      coalesce(gc, total, account_id + 1500 + hot + fixed) AS gc_total, CASE WHEN gc IS NULL THEN 60 ELSE 100 END::DOUBLE AS gc_score FROM s""",
)
def override_replay(spark: SparkSession, folder: str) -> DataFrame:
    state = apply_overrides(
        _common_state(spark, folder), _override_log(spark, folder), extracted_at="extracted_at"
    )
    return state.select(
        "account_id", "gastos_comunes_amount", "funds_provision", "subtotal", "fixed_charge",
        "cargo_fijo", "hot_water_amount", "gc_total",
        F.try_element_at("confidence", F.lit("gc_total")).alias("gc_score"),
    )


@query(
    "changed_fields",
    f"""WITH {OVERRIDES}, d AS (SELECT account_id, unnest([
        CASE WHEN ob IS NOT NULL AND ob <> account_id + 1000 THEN {{'attr': 'gastos_comunes_amount', 'new_value': bill}} END,
        CASE WHEN oh IS NOT NULL AND oh <> 300 THEN {{'attr': 'hot_water_amount', 'new_value': hot}} END,
        CASE WHEN total IS NOT NULL THEN {{'attr': 'total_amount', 'new_value': total}} END,
        CASE WHEN ofx IS NOT NULL AND ofx <> 200 THEN {{'attr': 'cargo_fijo', 'new_value': fixed}} END,
        {{'attr': 'fixed_charge', 'new_value': fixed}},
        {{'attr': 'subtotal_departamento', 'new_value': account_id + 1500}},
        {{'attr': 'fondos_amount', 'new_value': account_id + 1500 - bill}},
        {{'attr': 'funds_provision', 'new_value': account_id + 1500 - bill}},
        {{'attr': 'gc_total', 'new_value': coalesce(gc, total, account_id + 1500 + hot + fixed)}}]) AS c FROM s)
      SELECT c.attr AS attr, count(*) AS changes, sum(c.new_value)::BIGINT AS new_sum FROM d WHERE c IS NOT NULL GROUP BY 1""",
)
def changed_fields_query(spark: SparkSession, folder: str) -> DataFrame:
    """What an override replay changed, per attribute."""
    before = _common_state(spark, folder)
    after = apply_overrides(before, _override_log(spark, folder), extracted_at="extracted_at")
    changes = changed_fields(before, after)
    return changes.groupBy("attr").agg(
        F.count(F.lit(1)).alias("changes"), F.sum(F.col("new_value").cast("bigint")).alias("new_sum")
    )


@query(
    "recompute_water",
    f"""WITH {ORDERS} SELECT o_orderkey AS account_id, total + 400 AS water_consumption,
      CASE WHEN o_orderkey % 3 = 0 THEN 7 ELSE total + 400 + 900 + 300 + 100 END::BIGINT AS subtotal,
      CASE WHEN o_orderkey % 3 = 0 THEN 5 ELSE total + 400 + 900 + 300 + 100 - 3 END::BIGINT AS total_amount,
      18.0::DOUBLE AS cubic_meter_collection, 6.0::DOUBLE AS cubic_meter_treatment, 20.0::DOUBLE AS cost_per_unit_peak FROM o""",
)
def recompute_water(spark: SparkSession, folder: str) -> DataFrame:
    """Water formulas after an edit; a subtotal set by a person stands, and the total with it."""
    own = R.key() % 3 == 0
    state = R.orders(spark, folder).select(
        R.key().alias("account_id"),
        F.lit(rules.WATER).alias("service_type"),
        F.col("total").alias("water_consumption_non_peak"),
        F.lit(400).cast("bigint").alias("water_consumption_peak"),
        F.lit(20.0).alias("water_consumption_peak_m3"),
        F.lit(900).cast("bigint").alias("wastewater_recolection"),
        F.lit(300).cast("bigint").alias("wastewater_treatment"),
        F.lit(100).cast("bigint").alias("fixed_charge"),
        F.lit(-3).cast("bigint").alias("other_charges"),
        F.lit(50.0).alias("consumption"),
        F.lit(7).cast("bigint").alias("subtotal"),
        F.lit(5).cast("bigint").alias("total_amount"),
        F.when(own, F.create_map(F.lit("subtotal"), F.lit(100.0))).alias("confidence"),
    )
    return recompute(state).select(
        "account_id", "water_consumption", "subtotal", "total_amount", "cubic_meter_collection",
        "cubic_meter_treatment", "cost_per_unit_peak",
    )


# ------------------------------------------------------------------------ merges
def _readings_of(df: DataFrame, keep, base: int, key: str = "doc_id") -> DataFrame:
    """Ten readings per order, each missing where ``keep(position)`` says so."""
    columns = []
    for i, field in enumerate(rules.READING_FIELDS):
        kind = "double" if field in ("hot_water_consumption", "hot_water_cost_per_m3", "hot_water_reading_prev", "hot_water_reading_curr") else "bigint"
        columns.append(F.when(keep(i), F.lit(base + i)).cast(kind).alias(field))
    scores = F.create_map(F.lit("subtotal"), F.lit(float(base)))
    return df.select(R.key().alias(key), *columns, scores.alias("confidence"))


@query(
    "fill_missing",
    """SELECT o_orderkey AS account_id, CASE WHEN o_orderkey % 2 = 0 THEN 100 WHEN o_orderkey % 3 = 0 THEN 200 END::BIGINT AS gastos_comunes_amount,
      CASE WHEN o_orderkey % 2 = 1 THEN 101 WHEN o_orderkey % 3 = 0 THEN 201 END::BIGINT AS subtotal,
      CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 = 0 THEN 200 ELSE 100 END::DOUBLE AS subtotal_score,
      CASE WHEN o_orderkey % 3 = 0 THEN 5 ELSE 0 END::INTEGER AS copied FROM orders""",
)
def fill_missing_query(spark: SparkSession, folder: str) -> DataFrame:
    """Half of the readings are missing; the fallback exists for every third account."""
    df = R.orders(spark, folder)
    current = _readings_of(df, lambda i: (R.key() + i) % 2 == 0, 100, "account_id")
    fallback = _readings_of(df.filter(R.key() % 3 == 0), lambda i: F.lit(True), 200, "account_id")
    return fill_missing(current, fallback, "account_id").select(
        "account_id", "gastos_comunes_amount", "subtotal",
        F.try_element_at("confidence", F.lit("subtotal")).alias("subtotal_score"),
        F.size("copied").alias("copied"),
    )


@query(
    "carry_forward",
    """SELECT o_orderkey AS account_id, CASE WHEN o_orderkey % 2 = 0 THEN 100 WHEN o_orderkey % 5 <> 0 THEN 300 END::BIGINT AS gastos_comunes_amount,
      CASE WHEN o_orderkey % 2 = 1 THEN 104 WHEN o_orderkey % 5 <> 0 THEN 304 END::BIGINT AS funds_provision,
      (o_orderkey % 5 = 0) AS incomplete FROM orders""",
)
def carry_forward_query(spark: SparkSession, folder: str) -> DataFrame:
    """Readings of the previous state survive, on common-expenses accounts only."""
    df = R.orders(spark, folder)
    kind = F.when(F.col("account_id") % 5 == 0, rules.GAS).otherwise(rules.COMMON_EXPENSES)
    current = _readings_of(df, lambda i: (R.key() + i) % 2 == (0 if i != 4 else 1), 100, "account_id").withColumn("service_type", kind)
    previous = _readings_of(df, lambda i: F.lit(True), 300, "account_id")
    return carry_forward(current, previous).select(
        "account_id", "gastos_comunes_amount", "funds_provision", needs_fallback().alias("incomplete")
    )


@query(
    "combine_sources",
    """WITH x AS (SELECT o_orderkey AS doc_id, o_orderkey % 4 AS k, o_orderkey % 3 AS m, o_orderkey % 5 = 0 AS off FROM orders)
      SELECT doc_id, CASE WHEN off THEN 'internal' WHEN k = 0 THEN 'addon_template'
        WHEN k = 1 THEN 'addon_template+raw' WHEN k = 2 THEN 'addon_template+internal' ELSE 'addon_raw+internal' END AS source,
      CASE WHEN off THEN 300 WHEN k < 3 THEN 100 ELSE 200 END::BIGINT AS gastos_comunes_amount,
      CASE WHEN off THEN 301 WHEN k < 3 THEN 101 ELSE 201 END::BIGINT AS subtotal,
      CASE WHEN off THEN 308 WHEN k = 0 THEN 108 WHEN k = 1 THEN 208 ELSE 308 END::DOUBLE AS hot_water_reading_prev FROM x""",
)
def combine_sources_query(spark: SparkSession, folder: str) -> DataFrame:
    """Template, then OCR lines, then the text layer; each only where readings are missing."""
    df = R.orders(spark, folder)
    k = R.key() % 4
    # The last two readings are what the better sources leave out.
    template = _readings_of(df.filter(k < 3), lambda i: F.lit(i < 8) | (k == 0), 100)
    raw = _readings_of(df, lambda i: F.lit(i < 8) | (k == 1), 200)
    internal = _readings_of(df, lambda i: F.lit(True), 300)
    documents = df.select(
        R.key().alias("doc_id"),
        F.lit(rules.COMMON_EXPENSES).alias("service_type"),
        attempt_ocr(R.key() % 5 != 0, F.lit(False)).alias("ocr_attempted"),
        template_offered(
            F.when(k == 3, F.array(F.lit("other"))).when(k == 2, F.array(F.lit(rules.TEMPLATE_ID)))
        ).alias("template_offered"),
    )
    bills = combine_sources(documents, template, raw, internal)
    return bills.select(
        "doc_id", "source", "gastos_comunes_amount", "subtotal", "hot_water_reading_prev"
    )


@query(
    "document_over_email",
    f"""WITH {ORDERS} SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN total * 2 ELSE total END AS total_amount,
      'F' || CAST(o_orderkey AS VARCHAR) AS folio, CASE WHEN o_orderkey % 3 = 0 THEN 70 END::DOUBLE AS score FROM o""",
)
def document_over_email_query(spark: SparkSession, folder: str) -> DataFrame:
    df = R.orders(spark, folder)
    emails = df.select(
        "o_orderkey", F.col("total").alias("total_amount"), R.text("F", R.key().cast("string")).alias("folio")
    )
    documents = df.filter(R.key() % 3 == 0).select("o_orderkey", (F.col("total") * 2).alias("total_amount"))
    documents = default_confidence(documents, rules.CONF_TEXT)
    bills = document_over_email(emails, documents, "o_orderkey")
    return bills.select(
        "o_orderkey", "total_amount", "folio",
        F.try_element_at("confidence", F.lit("total_amount")).alias("score"),
    )


@query(
    "extraction_diagnostics",
    """WITH x AS (SELECT o_orderkey, o_orderkey % 4 AS k FROM orders) SELECT CASE k WHEN 0 THEN 'success' WHEN 3 THEN 'failed' ELSE 'partial' END AS extraction_status,
      CASE k WHEN 0 THEN NULL WHEN 1 THEN 'missing_required_fields:subtotal,fixed_charge,gc_total' WHEN 2 THEN 'missing_required_fields:gc_total'
        ELSE 'no_usable_common_expenses_attributes' END AS extraction_error, count(*) AS bills FROM x GROUP BY 1, 2""",
)
def extraction_diagnostics(spark: SparkSession, folder: str) -> DataFrame:
    k = R.key() % 4
    limit = R.choose(k, F.lit(4), F.lit(1), F.lit(3), F.lit(0))
    bills = _readings_of(R.orders(spark, folder), lambda i: F.lit(i) < limit, 1)
    return (
        with_diagnostics(bills, F.lit("internal"))
        .groupBy("extraction_status", "extraction_error")
        .agg(F.count(F.lit(1)).alias("bills"))
    )


@query(
    "keep_previous",
    """WITH x AS (SELECT o_orderkey AS account_id, o_orderkey % 4 AS k, CAST(o_orderdate AS TIMESTAMP) AS d FROM orders)
      SELECT account_id, CASE WHEN k IN (0, 1) THEN TIMESTAMP '1990-01-01 12:00:00' ELSE d END AS last_updated,
      CASE k WHEN 0 THEN 500 WHEN 1 THEN NULL ELSE 700 END::BIGINT AS subtotal FROM x""",
)
def keep_previous_query(spark: SparkSession, folder: str) -> DataFrame:
    """A refresh without a match keeps the old state, a failed one the old date."""
    k = R.key() % 4
    df = table(spark, folder, "orders")
    account = R.key().alias("account_id")
    from billspark.operators.confidence import with_fields

    refreshed = df.select(
        account,
        (k != 0).alias("matched"),
        F.when(k == 1, "failed").otherwise("success").alias("extraction_status"),
        F.when(k != 0, F.col("o_orderdate").cast("timestamp")).alias("last_updated"),
        F.when(k > 1, F.lit(700).cast("bigint")).alias("subtotal"),
    )
    previous = df.filter(k < 3).select(
        account,
        F.lit("success").alias("extraction_status"),
        F.lit("1990-01-01 12:00:00").cast("timestamp").alias("last_updated"),
        F.lit(500).cast("bigint").alias("subtotal"),
    )
    state = keep_previous(
        with_fields(refreshed, rules.READING_FIELDS), with_fields(previous, rules.READING_FIELDS)
    )
    return state.select("account_id", F.col("last_updated").cast("timestamp_ntz").alias("last_updated"), "subtotal")


# ----------------------------------------------------------------------- outputs
def _gas_and_power(spark: SparkSession, folder: str) -> DataFrame:
    gas = R.key() % 2 == 0
    df = R.orders(spark, folder).select(
        R.key().alias("account_id"),
        F.when(gas, rules.GAS).otherwise(rules.ELECTRICITY).alias("service_type"),
        F.when(R.key() % 3 != 0, F.col("total")).alias("total_amount"),
        F.lit(10.5).alias("consumption"),
        F.when(gas, F.lit(2.5)).alias("cost_per_m3s"),
        F.when(~gas, F.lit(3.5)).alias("cost_per_kwh"),
        F.when(~gas, F.lit(7)).cast("bigint").alias("service_administration"),
        F.when(~gas, F.lit("BT1")).alias("tariff_code"),
        F.when(R.key() % 5 == 0, R.text("N", R.key().cast("string"))).alias("folio"),
        R.dmy(F.col("day")).alias("emission_date"),
    )
    df = default_confidence(df, rules.CONF_TEXT)
    return df.withColumn("last_updated", last_update(F.col("emission_date")))


@query(
    "readings_long",
    f"""WITH {ORDERS}, r(g, attr, label, unit) AS (VALUES
      (0, 'consumption', 'Consumption', 'm³'), (0, 'total_amount', 'Total Amount', '$'), (0, 'cost_per_m3s', 'Cost Per Unit', '$/m³'),
      (1, 'consumption', 'Consumption', 'kWh'), (1, 'total_amount', 'Total Amount', '$'), (1, 'cost_per_kwh', 'Cost Per Unit', '$/kWh'),
      (1, 'service_administration', 'Service Administration', '$'), (1, 'electricity_transport', 'Electricity Transport', '$'),
      (1, 'stabilization_fund', 'Stabilization Fund', '$'), (1, 'electricity_consumption', 'Electricity Consumption', '$')),
      v AS (SELECT o_orderkey AS account_id, attr, label, unit, CASE attr WHEN 'consumption' THEN 10.5 WHEN 'total_amount' THEN
        CASE WHEN o_orderkey % 3 <> 0 THEN total END WHEN 'cost_per_m3s' THEN 2.5 WHEN 'cost_per_kwh' THEN 3.5 WHEN 'service_administration' THEN 7 END::DOUBLE AS value
        FROM o JOIN r ON g = o_orderkey % 2)
      SELECT account_id, attr, label, unit, value, CASE WHEN value IS NOT NULL THEN 70 END::DOUBLE AS confidence FROM v""",
)
def readings_long(spark: SparkSession, folder: str) -> DataFrame:
    return readings(_gas_and_power(spark, folder)).select(
        "account_id", "attr", "label", "unit", "value", "confidence"
    )


@query(
    "status_details",
    f"""WITH {ORDERS} SELECT o_orderkey AS account_id, CASE WHEN o_orderkey % 2 = 0 THEN 'gas' ELSE 'electricity' END AS service_type,
      CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 5 = 0 THEN 'N' || CAST(o_orderkey AS VARCHAR) ELSE '0' END AS folio,
      CASE WHEN o_orderkey % 7 <> 0 THEN strftime(day, '%d-%m-%Y') ELSE '0' END AS emission_date, '0' AS due_date,
      CASE WHEN o_orderkey % 2 = 1 THEN CASE WHEN o_orderkey % 7 <> 0 THEN 'BT1' ELSE '0' END END AS tariff_code,
      CASE WHEN o_orderkey % 2 = 1 THEN 0 END::BIGINT AS connected_power, '' AS pdf_url FROM o""",
)
def status_details_query(spark: SparkSession, folder: str) -> DataFrame:
    state = _gas_and_power(spark, folder).filter(F.col("account_id") % 7 != 0)
    accounts = _gas_and_power(spark, folder).select(
        "account_id", "service_type", F.lit(1).alias("billing_interval_months")
    )
    return status_details(state, accounts).select(
        "account_id", "service_type", "folio", "emission_date", "due_date", "tariff_code",
        "connected_power", "pdf_url",
    )


@query(
    "account_problems",
    f"""WITH {ORDERS}, c AS (SELECT c_custkey, max(day) AS day FROM customer LEFT JOIN o ON o_custkey = c_custkey GROUP BY 1)
      SELECT c_custkey AS account_id, coalesce(day::TIMESTAMP + INTERVAL 12 HOUR + to_months(CAST(1 + c_custkey % 24 AS INTEGER)) < TIMESTAMP '2002-01-31 12:00:00', true)
        OR c_custkey % 6 = 1 AS problem FROM c""",
)
def account_problems(spark: SparkSession, folder: str) -> DataFrame:
    """No bill, an old bill, or a common-expenses bill without values."""
    state = R.orders(spark, folder).groupBy(F.col("o_custkey").alias("account_id")).agg(F.max("day").alias("day"))
    state = state.select(
        "account_id", last_update(R.dmy(F.col("day"))).alias("last_updated"),
        F.when(F.col("account_id") % 6 != 1, F.lit(1)).cast("bigint").alias("subtotal"),
    )
    accounts = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("account_id"),
        F.when(F.col("c_custkey") % 2 == 1, rules.COMMON_EXPENSES).otherwise(rules.GAS).alias("service_type"),
        (1 + F.col("c_custkey") % 24).cast("int").alias("billing_interval_months"),
    )
    now = F.lit("2002-01-31 12:00:00").cast("timestamp")
    return problem_status(state, accounts, now).select("account_id", "problem")


@query(
    "cycle_summary",
    """SELECT count(*) AS services, count(*) FILTER (NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 9 = 0)) AS without_match FROM customer""",
)
def cycle_summary_query(spark: SparkSession, folder: str) -> DataFrame:
    accounts = table(spark, folder, "customer").select(F.col("c_custkey").alias("account_id"))
    state = (
        R.orders(spark, folder).filter(R.key() % 9 == 0)
        .groupBy(F.col("o_custkey").alias("account_id"))
        .agg(F.max(parse_bill_date(R.dmy(F.col("day")))).cast("timestamp").alias("last_updated"))
    )
    return cycle_summary(accounts, state)


# -------------------------------------------------------------------------- poll
@query(
    "poll_cycle",
    f"""WITH {ORDERS}, l AS (SELECT o_custkey % 10 AS box, max(o_orderkey) AS k, arg_max(total, o_orderkey) AS total, arg_max(day, o_orderkey) AS day FROM o GROUP BY 1),
      a AS (SELECT unnest(range(12)) AS account_id),
      s AS (SELECT account_id, k, account_id IN (3, 10) AS kept, total + CASE WHEN account_id % 2 = 0 THEN 1 ELSE 0 END AS total, day FROM a LEFT JOIN l ON box = account_id)
      SELECT account_id::BIGINT AS account_id, CASE WHEN kept THEN 7 ELSE total END::BIGINT AS total_amount,
        CASE WHEN kept THEN 2.0 WHEN k IS NOT NULL THEN 12.5 END::DOUBLE AS consumption,
        CASE WHEN kept THEN '2020-01-01 12:00:00' ELSE strftime(day, '%Y-%m-%d') || ' 12:00:00' END AS last_updated,
        coalesce(CASE WHEN kept THEN DATE '2020-01-01' ELSE day END + INTERVAL 1 MONTH < DATE '2001-07-01', true) AS problem FROM s""",
)
def poll_cycle(spark: SparkSession, folder: str) -> DataFrame:
    """Raw mail to account state: even mailboxes have a document, one is unchanged, two have no mail."""
    body = R.lines(
        R.text("Total a pagar $ ", R.clp(F.col("total"))), "Consumo de gas: 12,50 m3",
        R.text("Fecha de emisión: ", R.dmy(F.col("day"))),
    )
    box = (F.col("o_custkey") % 10).cast("bigint")
    key = R.key().cast("string")
    files = R.orders(spark, folder).select(
        box.cast("string").alias("mailbox_id"), R.key().alias("msg_seq"),
        F.encode(
            R.text("From: no-reply@metrogas.cl\r\nSubject: Boleta Metrogas\r\nMessage-ID: <", key,
                   "@m>\r\nContent-Type: text/plain; charset=utf-8\r\n\r\n", body),
            "utf-8",
        ).alias("content"),
    )
    messages = parse_messages(files)
    accounts = spark.range(12).select(
        F.col("id").alias("account_id"), F.col("id").cast("string").alias("mailbox_id"),
        F.lit("gas").alias("service_id"), F.lit("Gas").alias("service_name"), F.lit(rules.GAS).alias("service_type"),
        F.lit("no-reply@metrogas.cl").alias("sample_from"), F.lit("").alias("sample_subject"),
        F.lit(1).alias("billing_interval_months"),
    )
    document = R.lines(R.text("Total a pagar $ ", R.clp(F.col("total") + 1)), "Gas consumido ( 12,50 m3s )")
    texts = R.orders(spark, folder).filter(box % 2 == 0).select(
        box.alias("account_id"), R.key().alias("msg_seq"), document.alias("text"), F.lit(None).cast("string").alias("fault")
    )
    newest = R.orders(spark, folder).filter(box == 3).agg(F.max(R.key()).alias("k"))
    before = newest.select(
        F.lit(3).cast("bigint").alias("account_id"), F.concat(F.lit("<"), F.col("k").cast("string"), F.lit("@m>")).alias("email_fingerprint")
    ).unionByName(spark.range(10, 11).select(F.col("id").alias("account_id"), F.lit("other").alias("email_fingerprint")))
    state = with_fields(
        before.select(
            "*", F.lit(rules.GAS).alias("service_type"), F.lit("2020-01-01 12:00:00").cast("timestamp").alias("last_updated"),
            F.lit(7).cast("bigint").alias("total_amount"), F.lit(2.0).alias("consumption"), F.lit(3.5).alias("cost_per_m3s"),
            F.lit(True).alias("is_complete"), F.expr(EMPTY_MAP).alias("confidence"),
            *[F.lit(None).cast("string").alias(c) for c in ("extraction_status", "extraction_source", "extraction_error")],
        ),
        ATTRS,
    )
    after = refresh(messages, accounts, texts, state)
    now = F.lit("2001-07-01 00:00:00").cast("timestamp")
    flags = problem_status(after, accounts, now).select("account_id", "problem")
    return after.join(flags, "account_id").select(
        "account_id", "total_amount", "consumption",
        F.date_format("last_updated", "yyyy-MM-dd HH:mm:ss").alias("last_updated"), "problem",
    )
