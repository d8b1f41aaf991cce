"""The engine's queries over the driver's tables, each with the SQL that must give the same rows in DuckDB."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import latin_digits, number_rules, number_text, parse_number, strip
from millrace.operators import metrics, rules
from millrace.operators.classify import classify
from millrace.operators.dedup import duplicate_groups, flag_duplicates, group_sizes
from millrace.operators.items import item_states
from millrace.operators.upsert import actions, merged, quarantine_documents, validated_documents
from millrace.plans.dirty import SQL_HEAD, UNKNOWN, dirty_orders, dirty_raw
from millrace.schema import QUARANTINED, RAW_COLUMNS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable:
    QUERIES[function.__name__] = function
    return function


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(flag_duplicates(dirty_raw(spark, sf_dir)), "is_duplicate")


# ---- DuckDB building blocks ----


def _num(text: str) -> str:
    plain = f"translate(trim({text}), '٠١٢٣٤٥٦٧٨٩٫٬', '0123456789.,')"
    return f"CASE trim({text}) WHEN 'ألفان' THEN 2000 WHEN 'خمسة آلاف' THEN 5000 ELSE TRY_CAST(replace(regexp_replace({plain}, '\\s*(YER|ريال يمني|ريال)\\s*$', '', 'i'), ',', '') AS DECIMAL(18,6)) END"


def _show(number: str) -> str:
    return f"regexp_replace(regexp_replace(CAST(CAST({number} AS DECIMAL(18,6)) AS VARCHAR), '0+$', ''), '\\.$', '')"


_ISO = "TRY_CAST(CASE WHEN regexp_matches(order_date, '^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}$') THEN order_date END AS TIMESTAMP)"
_DMY = "TRY_STRPTIME(CASE WHEN regexp_matches(order_date, '^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4} ') THEN order_date END, '%d-%m-%Y %H:%M:%S')"


def _valid_email(text: str) -> str:
    return f"(regexp_matches({text}, '^[^@ ]+@[^@ ]+$') AND NOT contains({text}, '..') AND NOT regexp_matches({text}, '^\\.|\\.@|@\\.|\\.$') AND regexp_matches({text}, '@[^@]*\\.'))"


_MENDED = "regexp_replace(regexp_replace(customer_email, '@{2,}', '@', 'g'), '\\.{2,}', '.', 'g')"
_NATIONAL = "nullif(regexp_extract(regexp_replace(customer_phone, '[\\s\\-()]', '', 'g'), '^(?:\\+967)?([0-9]{9})$', 1), '')"
_PARSED = f"""{SQL_HEAD},
dup AS (SELECT trim(order_id) AS id FROM dirty WHERE trim(order_id) <> '' GROUP BY 1 HAVING count(*) > 1),
p AS (
  SELECT *, {_num("delivery_cost")} AS delivery, {_num("payment_amount")} AS payment, {_num("total_amount")} AS order_total, {_ISO} AS iso, {_DMY} AS dmy,
    {_valid_email("customer_email")} AS email_ok, {_MENDED} AS mended, {_NATIONAL} AS national, trim(order_id) IN (SELECT id FROM dup) AS duplicate,
    json_valid(items_json) AS is_json, CASE WHEN json_valid(items_json) THEN CAST(json_array_length(items_json) AS BIGINT) ELSE 0 END AS n_items
  FROM dirty),
it0 AS (SELECT o_orderkey, delivery, payment, order_total, i, json_extract(items_json, '$[' || i || ']') AS e FROM (SELECT *, unnest(range(0, n_items)) AS i FROM p WHERE n_items > 0)),
it1 AS (SELECT *, {_num("json_extract_string(e, '$.qty')")} AS qty0, {_num("json_extract_string(e, '$.unit_price')")} AS price0, {_num("json_extract_string(e, '$.total')")} AS total0 FROM it0),
it2 AS (SELECT *, coalesce(bool_and(coalesce(total0 >= 0, false)) OVER o AND delivery >= 0 AND sum(total0) OVER o + delivery = order_total, false) AS backed FROM it1 WINDOW o AS (PARTITION BY o_orderkey)),
it3 AS (SELECT *, coalesce(qty0 < 0 AND backed AND price0 > 0 AND total0 >= 0 AND total0 % price0 = 0 AND total0 > 0, false) AS mends FROM it2),
it4 AS (SELECT *, CASE WHEN mends THEN CAST(total0 / price0 AS DECIMAL(18,6)) ELSE qty0 END AS qty FROM it3),
it5 AS (SELECT *, coalesce(total0 IS NULL AND qty > 0 AND qty = floor(qty) AND price0 >= 0, false) AS gets_total, coalesce(price0 IS NULL AND qty > 0 AND qty = floor(qty) AND total0 >= 0, false) AS gets_price FROM it4),
it6 AS (SELECT *, CASE WHEN gets_total THEN CAST(qty * price0 AS DECIMAL(18,6)) ELSE total0 END AS total1, CASE WHEN gets_price THEN CAST(total0 / qty AS DECIMAL(18,6)) ELSE price0 END AS price1 FROM it5),
it7 AS (SELECT *, coalesce(price1 IS NULL AND total1 IS NULL AND qty > 0 AND qty = floor(qty), false) AS open FROM it6),
it8 AS (SELECT *, count(*) FILTER (WHERE open) OVER o AS n_open, coalesce(bool_and(coalesce(total1 >= 0, false)) FILTER (WHERE NOT open) OVER o, true) AS others_known, order_total - delivery - coalesce(sum(total1) FILTER (WHERE NOT open) OVER o, 0) AS rest FROM it7 WINDOW o AS (PARTITION BY o_orderkey)),
it9 AS (SELECT *, coalesce(open AND n_open = 1 AND payment = order_total AND order_total >= 0 AND delivery >= 0 AND others_known AND rest >= 0, false) AS residual FROM it8),
it AS (SELECT *, CASE WHEN residual THEN CAST(rest AS DECIMAL(18,6)) ELSE total1 END AS total, CASE WHEN residual THEN CAST(rest / qty AS DECIMAL(18,6)) ELSE price1 END AS price FROM it9),
per AS (SELECT o_orderkey, bool_and(coalesce(total >= 0, false)) AS known, sum(total) AS goods,
    '[' || string_agg('{{"sku":"' || json_extract_string(e, '$.sku') || '","name":"' || json_extract_string(e, '$.name') || '","qty":' || {_show("qty")} || ',"unit_price":' || coalesce({_show("price")}, '"{UNKNOWN}"') || ',"total":' || coalesce({_show("total")}, '"{UNKNOWN}"') || '}}', ',' ORDER BY i) || ']' AS written
  FROM it GROUP BY o_orderkey),
r0 AS (SELECT p.*, per.written, per.known, CASE WHEN per.o_orderkey IS NOT NULL AND delivery >= 0 AND known THEN CAST(goods + delivery AS DECIMAL(18,6)) END AS expected FROM p LEFT JOIN per USING (o_orderkey)),
made AS (
  SELECT o_orderkey, 1 AS pos, 'WHITESPACE_TRIMMED' AS rule FROM r0 WHERE status <> trim(status)
  UNION ALL SELECT o_orderkey, 2, 'DATE_NORMALIZED' FROM r0 WHERE iso IS NULL AND dmy IS NOT NULL
  UNION ALL SELECT o_orderkey, 3, 'EMAIL_REPEATED_SYMBOLS' FROM r0 WHERE NOT email_ok AND mended <> customer_email AND {_valid_email("mended")}
  UNION ALL SELECT o_orderkey, 4, 'PHONE_NORMALIZED_YE' FROM r0 WHERE national <> customer_phone
  UNION ALL SELECT o_orderkey, 5, 'CURRENCY_NORMALIZED_YER' FROM r0 WHERE currency IN ('ريال يمني', 'ريال')
  UNION ALL SELECT o_orderkey, 6, 'STATUS_SYNONYM_NORMALIZED' FROM r0 WHERE payment_status = 'مدفوع'
  UNION ALL SELECT o_orderkey, 10, 'KNOWN_PRICE_WORD_TO_NUMBER' FROM r0 WHERE delivery_cost IN ('ألفان', 'خمسة آلاف')
  UNION ALL SELECT o_orderkey, 21, 'ARABIC_DIGITS_TO_LATIN' FROM r0 WHERE order_total IS NOT NULL AND regexp_matches(total_amount, '[٠-٩]')
  UNION ALL SELECT o_orderkey, 22, 'ARABIC_DECIMAL_SEPARATOR_NORMALIZED' FROM r0 WHERE order_total IS NOT NULL AND contains(total_amount, '٫')
  UNION ALL SELECT o_orderkey, 23, 'THOUSANDS_SEPARATOR_NORMALIZED' FROM r0 WHERE order_total IS NOT NULL AND contains(total_amount, ',')
  UNION ALL SELECT o_orderkey, 24, 'CURRENCY_SUFFIX_REMOVED' FROM r0 WHERE order_total IS NOT NULL AND regexp_matches(total_amount, 'ريال$')
  UNION ALL SELECT o_orderkey, 100 + i, 'NEGATIVE_QTY_DERIVED' FROM it WHERE mends
  UNION ALL SELECT o_orderkey, 10000 + 2 * i, 'ITEM_TOTAL_DERIVED' FROM it WHERE gets_total
  UNION ALL SELECT o_orderkey, 10001 + 2 * i, 'ITEM_PRICE_DIRECT_DERIVED' FROM it WHERE gets_price
  UNION ALL SELECT o_orderkey, 100000, 'ITEM_TOTAL_RESIDUAL_DERIVED' FROM it WHERE residual
  UNION ALL SELECT o_orderkey, 100001, 'ITEM_PRICE_RESIDUAL_DERIVED' FROM it WHERE residual
  UNION ALL SELECT o_orderkey, 900000, CASE WHEN order_total IS NULL THEN 'ORDER_TOTAL_DERIVED' ELSE 'ORDER_TOTAL_RECALCULATED' END FROM r0 WHERE expected IS NOT NULL AND (order_total IS NULL OR order_total <> expected)),
found AS (
  SELECT o_orderkey, 1 AS pos, 'MISSING_ORDER_ID' AS code FROM r0 WHERE trim(order_id) = ''
  UNION ALL SELECT o_orderkey, 2, 'MISSING_CUSTOMER_ID' FROM r0 WHERE trim(customer_id) = ''
  UNION ALL SELECT o_orderkey, 3, 'DUPLICATE_ORDER_ID' FROM r0 WHERE duplicate
  UNION ALL SELECT o_orderkey, 4, 'INVALID_IMPOSSIBLE_DATE' FROM r0 WHERE iso IS NULL AND dmy IS NULL
  UNION ALL SELECT o_orderkey, 5, 'EMAIL_INVALID_UNRECOVERABLE' FROM r0 WHERE NOT email_ok AND NOT (mended <> customer_email AND {_valid_email("mended")})
  UNION ALL SELECT o_orderkey, 6, 'PHONE_INVALID_UNRECOVERABLE' FROM r0 WHERE national IS NULL
  UNION ALL SELECT o_orderkey, 7, 'CURRENCY_UNKNOWN' FROM r0 WHERE currency NOT IN ('YER', 'ريال يمني', 'ريال')
  UNION ALL SELECT o_orderkey, 8, 'STATUS_UNKNOWN' FROM r0 WHERE trim(status) NOT IN ('مؤكد', 'قيد الانتظار', 'مرتجع', 'قيد الشحن', 'تم التسليم', 'ملغي')
  UNION ALL SELECT o_orderkey, 9, CASE WHEN is_json THEN 'EMPTY_ITEMS' ELSE 'CORRUPTED_ITEMS_JSON' END FROM r0 WHERE n_items = 0
  UNION ALL SELECT o_orderkey, 101 + 4 * i, 'AMBIGUOUS_NEGATIVE_VALUE' FROM it WHERE qty0 < 0 AND NOT mends
  UNION ALL SELECT o_orderkey, 102 + 4 * i, 'ITEM_QUANTITY_INVALID' FROM it WHERE qty IS NULL OR qty = 0
  UNION ALL SELECT o_orderkey, 103 + 4 * i, 'AMBIGUOUS_NEGATIVE_VALUE' FROM it WHERE price0 < 0
  UNION ALL SELECT o_orderkey, 104 + 4 * i, 'AMBIGUOUS_NEGATIVE_VALUE' FROM it WHERE total0 < 0
  UNION ALL SELECT o_orderkey, 100000 + i, 'UNKNOWN_PRICE' FROM it WHERE price IS NULL OR total IS NULL
  UNION ALL SELECT o_orderkey, 100000 + i, 'ITEM_COMPONENTS_CONFLICT' FROM it WHERE qty > 0 AND price >= 0 AND total >= 0 AND qty * price <> total
  UNION ALL SELECT o_orderkey, 900000, 'TOTAL_UNKNOWN_UNRECOVERABLE' FROM r0 WHERE order_total IS NULL AND expected IS NULL),
code AS (SELECT o_orderkey, code, min(pos) AS pos FROM found GROUP BY ALL),
codes AS (SELECT o_orderkey, string_agg(code, '+' ORDER BY pos) || CASE WHEN count(*) > 1 THEN '+MULTIPLE_CONFLICTING_ERRORS' ELSE '' END AS codes, count(*) + CASE WHEN count(*) > 1 THEN 1 ELSE 0 END AS n_codes FROM code GROUP BY 1),
ruled AS (SELECT o_orderkey, string_agg(rule, '+' ORDER BY pos) AS rules, count(*) AS n_rules FROM made GROUP BY 1),
rec AS (
  SELECT r0.*, coalesce(codes, '') AS codes, coalesce(rules, '') AS rules, coalesce(n_codes, 0) AS n_codes, coalesce(n_rules, 0) AS n_rules,
    CASE WHEN codes IS NOT NULL THEN 'quarantined' WHEN rules IS NOT NULL THEN 'corrected' ELSE 'valid' END AS quality_status
  FROM r0 LEFT JOIN codes USING (o_orderkey) LEFT JOIN ruled USING (o_orderkey))
"""


# ---- raw side ----


@query
def raw_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dirty_raw(spark, sf_dir).select("run_id", "source_file", "source_path", "source_row_number", "source_row_number_available", "engine_used", *(F.col(f"raw_record.{c}").alias(c) for c in RAW_COLUMNS))


SQL["raw_projection"] = f"{SQL_HEAD} SELECT 'run-dirty' AS run_id, 'orders.csv' AS source_file, '/data/orders.csv' AS source_path, CAST(o_orderkey + 2 AS BIGINT) AS source_row_number, true AS source_row_number_available, 'pyspark' AS engine_used, * EXCLUDE (o_orderkey) FROM dirty"


@query
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as CSV, read back by the distributed scan, numbered: one row of counts."""
    from millrace.sources.csv import numbered, read_large

    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or f"file://{tempfile.gettempdir()}"
    folder = f"{named.rstrip('/')}/csv-{uuid.uuid4().hex}"
    dirty_orders(spark, sf_dir).select(*RAW_COLUMNS).write.options(header="true", quote='"', escape='"').csv(folder)
    found = numbered(read_large(spark, folder, places=True))
    return found.agg(F.count("*").alias("n_rows"), F.count_if(F.length(F.trim("_corrupt_record")) > 0).alias("corrupt"), F.min("source_row_number").alias("first_row"), F.max("source_row_number").alias("last_row"), F.sum(F.length("items_json")).alias("items_chars"))


SQL["csv_roundtrip"] = f"{SQL_HEAD} SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS corrupt, CAST(2 AS BIGINT) AS first_row, count(*) + 1 AS last_row, CAST(sum(length(items_json)) AS BIGINT) AS items_chars FROM dirty"


@query
def latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest event of each type, by time and id."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


SQL["latest_run"] = "SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1"


# ---- duplicates ----


@query
def dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_groups(dirty_raw(spark, sf_dir))


SQL["dup_groups"] = f"{SQL_HEAD} SELECT trim(order_id) AS order_id, count(*) AS record_count FROM dirty WHERE trim(order_id) <> '' GROUP BY 1 HAVING count(*) > 1"


@query
def dup_size_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_sizes(duplicate_groups(dirty_raw(spark, sf_dir)))


SQL["dup_size_hist"] = f"{SQL_HEAD} SELECT record_count, count(*) AS groups FROM (SELECT count(*) AS record_count FROM dirty WHERE trim(order_id) <> '' GROUP BY trim(order_id) HAVING count(*) > 1) GROUP BY 1"


@query
def dup_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flag_duplicates(dirty_raw(spark, sf_dir)).select("o_orderkey", "is_duplicate")


SQL["dup_members"] = f"{_PARSED} SELECT o_orderkey, duplicate AS is_duplicate FROM p"


# ---- fields ----


@query
def whitespace_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    trims = rules.trim_corrections({c: (F.col(c), strip(F.col(c))) for c in RAW_COLUMNS})
    return dirty_orders(spark, sf_dir).select("o_orderkey", F.explode(trims).alias("c")).select("o_orderkey", "c.field", "c.original_value", "c.corrected_value")


SQL["whitespace_audit"] = f"{SQL_HEAD} SELECT o_orderkey, 'status' AS field, status AS original_value, trim(status) AS corrected_value FROM dirty WHERE status <> trim(status)"


@query
def number_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = strip(F.col("total_amount"))
    return dirty_orders(spark, sf_dir).select("o_orderkey", latin_digits(text).alias("digits"), number_text(parse_number(text)).alias("shown"), F.array_join(number_rules(text), "+").alias("rules"), number_text(parse_number(strip(F.col("delivery_cost")))).alias("delivery"))


SQL["number_parse"] = f"""{_PARSED} SELECT o_orderkey, translate(total_amount, '٠١٢٣٤٥٦٧٨٩', '0123456789') AS digits, {_show("order_total")} AS shown, {_show("delivery")} AS delivery,
  concat_ws('+', CASE WHEN regexp_matches(total_amount, '[٠-٩]') THEN 'ARABIC_DIGITS_TO_LATIN' END, CASE WHEN contains(total_amount, '٫') THEN 'ARABIC_DECIMAL_SEPARATOR_NORMALIZED' END,
    CASE WHEN contains(total_amount, ',') THEN 'THOUSANDS_SEPARATOR_NORMALIZED' END, CASE WHEN regexp_matches(total_amount, 'ريال$') THEN 'CURRENCY_SUFFIX_REMOVED' END) AS rules FROM p"""


def _field(column: str, rule: Callable) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = rule(strip(F.col(column)))
        return dirty_orders(spark, sf_dir).select("o_orderkey", found.value.alias("value"), F.array_join(F.transform(found.corrections, lambda c: c["rule_code"]), "+").alias("rules"), F.array_join(F.transform(found.errors, lambda e: e["code"]), "+").alias("codes"))

    return run


def _field_sql(value: str, rule: str, rule_when: str, code: str, code_when: str) -> str:
    return f"{_PARSED} SELECT o_orderkey, {value} AS value, CASE WHEN {rule_when} THEN '{rule}' ELSE '' END AS rules, CASE WHEN {code_when} THEN '{code}' ELSE '' END AS codes FROM p"


_EMAIL_MENDS = f"NOT email_ok AND mended <> customer_email AND {_valid_email('mended')}"
QUERIES["date_norm"] = _field("order_date", rules.order_date)
SQL["date_norm"] = _field_sql("coalesce(strftime(coalesce(iso, dmy), '%Y-%m-%dT%H:%M:%S'), order_date)", "DATE_NORMALIZED", "iso IS NULL AND dmy IS NOT NULL", "INVALID_IMPOSSIBLE_DATE", "iso IS NULL AND dmy IS NULL")
QUERIES["email_norm"] = _field("customer_email", rules.email)
SQL["email_norm"] = _field_sql(f"CASE WHEN {_EMAIL_MENDS} THEN mended ELSE customer_email END", "EMAIL_REPEATED_SYMBOLS", _EMAIL_MENDS, "EMAIL_INVALID_UNRECOVERABLE", f"NOT email_ok AND NOT ({_EMAIL_MENDS})")
QUERIES["phone_norm"] = _field("customer_phone", rules.phone)
SQL["phone_norm"] = _field_sql("coalesce(national, customer_phone)", "PHONE_NORMALIZED_YE", "national <> customer_phone", "PHONE_INVALID_UNRECOVERABLE", "national IS NULL")
QUERIES["currency_norm"] = _field("currency", rules.currency)
SQL["currency_norm"] = _field_sql("CASE WHEN currency IN ('ريال يمني', 'ريال') THEN 'YER' ELSE currency END", "CURRENCY_NORMALIZED_YER", "currency IN ('ريال يمني', 'ريال')", "CURRENCY_UNKNOWN", "currency NOT IN ('YER', 'ريال يمني', 'ريال')")
QUERIES["status_norm"] = _field("status", rules.order_status)
SQL["status_norm"] = _field_sql("trim(status)", "", "false", "STATUS_UNKNOWN", "trim(status) NOT IN ('مؤكد', 'قيد الانتظار', 'مرتجع', 'قيد الشحن', 'تم التسليم', 'ملغي')")
QUERIES["payment_status_norm"] = _field("payment_status", rules.payment_status)
SQL["payment_status_norm"] = _field_sql("CASE payment_status WHEN 'مدفوع' THEN 'تم الدفع' ELSE payment_status END", "STATUS_SYNONYM_NORMALIZED", "payment_status = 'مدفوع'", "", "false")


# ---- items ----


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dirty_orders(spark, sf_dir).select("o_orderkey", "items_json", *(parse_number(strip(F.col(c))).alias(n) for n, c in (("delivery", "delivery_cost"), ("payment", "payment_amount"), ("order_total", "total_amount"))))
    return item_states(rows)


@query
def items_parse_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.coalesce(F.get(F.transform(F.filter("items_found", lambda e: e["code"].isin("EMPTY_ITEMS", "CORRUPTED_ITEMS_JSON")), lambda e: e["code"]), F.lit(0)), F.lit("ok"))
    return _states(spark, sf_dir).groupBy(code.alias("parse_status")).agg(F.count("*").alias("n"), F.sum(F.coalesce(F.size("items"), F.lit(0))).alias("n_items"))


SQL["items_parse_status"] = f"{_PARSED} SELECT CASE WHEN NOT is_json THEN 'CORRUPTED_ITEMS_JSON' WHEN n_items = 0 THEN 'EMPTY_ITEMS' ELSE 'ok' END AS parse_status, count(*) AS n, CAST(sum(n_items) AS BIGINT) AS n_items FROM p GROUP BY 1"


@query
def item_final_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _states(spark, sf_dir).select("o_orderkey", F.posexplode("items").alias("i", "s"))
    return rows.select("o_orderkey", F.col("i").cast("long").alias("i"), *(number_text(F.col(f"s.{c}")).alias(c) for c in ("qty", "price", "total")))


SQL["item_final_states"] = f"{_PARSED} SELECT o_orderkey, i, {_show('qty')} AS qty, {_show('price')} AS price, {_show('total')} AS total FROM it"


@query
def item_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _states(spark, sf_dir).select("o_orderkey", F.explode("items_made").alias("c"))
    return rows.select("o_orderkey", "c.field", "c.original_value", "c.corrected_value", "c.rule_code")


SQL["item_audit"] = f"""{_PARSED}
SELECT o_orderkey, 'items_json[' || i || '].qty' AS field, {_show("qty0")} AS original_value, {_show("qty")} AS corrected_value, 'NEGATIVE_QTY_DERIVED' AS rule_code FROM it WHERE mends
UNION ALL SELECT o_orderkey, 'items_json[' || i || '].total', '{UNKNOWN}', {_show("total")}, 'ITEM_TOTAL_DERIVED' FROM it WHERE gets_total
UNION ALL SELECT o_orderkey, 'items_json[' || i || '].unit_price', '{UNKNOWN}', {_show("price")}, 'ITEM_PRICE_DIRECT_DERIVED' FROM it WHERE gets_price
UNION ALL SELECT o_orderkey, 'items_json[' || i || '].total', '{UNKNOWN}', {_show("total")}, 'ITEM_TOTAL_RESIDUAL_DERIVED' FROM it WHERE residual
UNION ALL SELECT o_orderkey, 'items_json[' || i || '].unit_price', '{UNKNOWN}', {_show("price")}, 'ITEM_PRICE_RESIDUAL_DERIVED' FROM it WHERE residual"""


# ---- records ----


def _record(df: DataFrame) -> DataFrame:
    return df.select(
        "o_orderkey", "quality_status", F.array_join("codes_error", "+").alias("codes"), F.array_join(F.transform("corrections", lambda c: c["rule_code"]), "+").alias("rules"),
        *(F.col(f"cleaned_record.{c}").alias(c) for c in ("order_date", "status", "customer_phone", "customer_email", "currency", "delivery_cost", "total_amount", "items_json")),
    )


@query
def classified_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _record(classified(spark, sf_dir))


_CLEANED = f"""coalesce(strftime(coalesce(iso, dmy), '%Y-%m-%dT%H:%M:%S'), order_date) AS order_date, trim(status) AS status, coalesce(national, customer_phone) AS customer_phone,
  CASE WHEN {_EMAIL_MENDS} THEN mended ELSE customer_email END AS customer_email, CASE WHEN currency IN ('ريال يمني', 'ريال') THEN 'YER' ELSE currency END AS currency, {_show("delivery")} AS delivery_cost,
  CASE WHEN expected IS NOT NULL THEN {_show("expected")} ELSE coalesce({_show("order_total")}, total_amount) END AS total_amount, coalesce(written, items_json) AS items_json"""
SQL["classified_records"] = f"{_PARSED} SELECT o_orderkey, quality_status, codes, rules, {_CLEANED} FROM rec"


@query
def order_total_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    mine = F.filter("corrections", lambda c: c["rule_code"].isin("ORDER_TOTAL_DERIVED", "ORDER_TOTAL_RECALCULATED"))
    return classified(spark, sf_dir).select("o_orderkey", F.explode(mine).alias("c")).select("o_orderkey", "c.rule_code", "c.original_value", "c.corrected_value")


SQL["order_total_rules"] = f"{_PARSED} SELECT o_orderkey, CASE WHEN order_total IS NULL THEN 'ORDER_TOTAL_DERIVED' ELSE 'ORDER_TOTAL_RECALCULATED' END AS rule_code, coalesce({_show('order_total')}, total_amount) AS original_value, {_show('expected')} AS corrected_value FROM rec WHERE expected IS NOT NULL AND (order_total IS NULL OR order_total <> expected)"


@query
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.status_counts(classified(spark, sf_dir))


SQL["status_counts"] = f"{_PARSED} SELECT quality_status, count(*) AS n FROM rec GROUP BY 1"


@query
def consistency_equation(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = {s: F.count_if(F.col("quality_status") == s) for s in ("valid", "corrected", "quarantined")}
    return classified(spark, sf_dir).agg(F.count("*").alias("raw"), *(e.alias(s) for s, e in n.items()), (F.count("*") == n["valid"] + n["corrected"] + n["quarantined"]).alias("holds"))


SQL["consistency_equation"] = f"{_PARSED} SELECT count(*) AS raw, count(*) FILTER (WHERE quality_status = 'valid') AS valid, count(*) FILTER (WHERE quality_status = 'corrected') AS corrected, count(*) FILTER (WHERE quality_status = 'quarantined') AS quarantined, true AS holds FROM rec"


@query
def rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.rule_counts(classified(spark, sf_dir))


SQL["rule_counts"] = f"{_PARSED} SELECT rule AS rule_code, count(*) AS n FROM made GROUP BY 1"


@query
def error_code_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.error_code_counts(classified(spark, sf_dir))


_CODE_COUNTS = "SELECT code, count(*) AS n FROM (SELECT unnest(string_split(codes, '+')) AS code FROM rec WHERE codes <> '') GROUP BY 1"
SQL["error_code_counts"] = f"{_PARSED} {_CODE_COUNTS}"


@query
def top_error_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.top(metrics.error_code_counts(classified(spark, sf_dir)), 15)


SQL["top_error_codes"] = f"{_PARSED} {_CODE_COUNTS} ORDER BY n DESC, code LIMIT 15"


@query
def error_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.error_combinations(classified(spark, sf_dir))


SQL["error_combinations"] = f"{_PARSED} SELECT array_to_string(list_sort(string_split(codes, '+')), ' + ') AS combination, count(*) AS n FROM rec WHERE codes <> '' GROUP BY 1"


@query
def corrections_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.corrections_histogram(classified(spark, sf_dir))


SQL["corrections_hist"] = f"{_PARSED} SELECT CAST(n_rules AS INTEGER) AS corrections, count(*) AS n FROM rec GROUP BY 1"


@query
def errors_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.errors_histogram(classified(spark, sf_dir))


SQL["errors_hist"] = f"{_PARSED} SELECT CAST(n_codes AS INTEGER) AS errors, count(*) AS n FROM rec GROUP BY 1"


@query
def status_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.status_samples(classified(spark, sf_dir), "o_orderkey").select("quality_status", "rank", "o_orderkey", F.size("corrections").alias("corrections"))


SQL["status_samples"] = f"{_PARSED} SELECT quality_status, CAST(k AS INTEGER) AS rank, o_orderkey, CAST(least(n_rules, 8) AS INTEGER) AS corrections FROM (SELECT *, row_number() OVER (PARTITION BY quality_status ORDER BY o_orderkey) AS k FROM rec) WHERE k <= 5"


# ---- upserts ----


def _changed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """This run's validated documents, and a table as an earlier run left it: even orders, every tenth of another city.

    Both are made in one pass over the orders. What is kept for the joins, which read it several times, are the columns that
    the queries show or compare: whole records would be some ten times as much."""
    earlier = F.col("_earlier")
    rows = classified(spark, sf_dir).where(F.col("quality_status") != QUARANTINED)
    rows = rows.withColumn("_earlier", F.explode(F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    city = F.when(earlier & (F.col("o_orderkey") % 10 == 0), F.lit("عدن")).otherwise(F.col("cleaned_record.city"))
    rows = rows.withColumn("cleaned_record", F.col("cleaned_record").withField("city", city))
    time = F.when(earlier, F.lit("2025-01-15 00:00:00").cast("timestamp")).otherwise(F.lit("2025-02-01 00:00:00").cast("timestamp"))
    documents = validated_documents(rows, F.when(earlier, "quality-1").otherwise("quality-2"), time)
    kept = documents.select("order_id", "quality_status", "city", "total_amount", "record_fingerprint", "last_processing_run_id", "first_processed_at", "last_updated_at").persist()
    return kept.where("last_processing_run_id = 'quality-2'"), kept.where("last_processing_run_id = 'quality-1'")


@query
def upsert_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    new, old = _changed(spark, sf_dir)
    return actions(new, old, "order_id").groupBy("action").agg(F.count("*").alias("n"))


_ACTION = "CASE WHEN o_orderkey % 2 = 1 THEN 'inserted' WHEN o_orderkey % 10 = 0 THEN 'updated' ELSE 'unchanged' END"
SQL["upsert_actions"] = f"{_PARSED} SELECT {_ACTION} AS action, count(*) AS n FROM rec WHERE quality_status <> 'quarantined' GROUP BY 1"


@query
def upsert_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    new, old = _changed(spark, sf_dir)
    return merged(actions(new, old, "order_id"), old, "order_id").select("order_id", "quality_status", "city", "total_amount", "last_processing_run_id", F.date_format("first_processed_at", "yyyy-MM-dd").alias("first_day"), F.date_format("last_updated_at", "yyyy-MM-dd").alias("last_day"))


SQL["upsert_snapshot"] = f"""{_PARSED} SELECT order_id, quality_status, 'صنعاء' AS city, {_show("coalesce(expected, order_total)")} AS total_amount, CASE WHEN {_ACTION} = 'unchanged' THEN 'quality-1' ELSE 'quality-2' END AS last_processing_run_id,
  CASE WHEN {_ACTION} = 'inserted' THEN '2025-02-01' ELSE '2025-01-15' END AS first_day, CASE WHEN {_ACTION} = 'unchanged' THEN '2025-01-15' ELSE '2025-02-01' END AS last_day FROM rec WHERE quality_status <> 'quarantined'"""


@query
def validated_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = validated_documents(classified(spark, sf_dir), "quality-1")
    return found.select(*RAW_COLUMNS, "quality_status", F.size("corrections").alias("corrections"), F.col("lineage.raw_run_id").alias("raw_run_id"), F.col("lineage.source_row_number").alias("source_row_number"))


SQL["validated_table"] = f"""{_PARSED} SELECT trim(order_id) AS order_id, customer_id, customer_name, city, district, delivery_type, payment_method, CASE payment_status WHEN 'مدفوع' THEN 'تم الدفع' ELSE payment_status END AS payment_status,
  {_show("payment")} AS payment_amount, {_CLEANED}, quality_status, CAST(n_rules AS INTEGER) AS corrections, 'run-dirty' AS raw_run_id, CAST(o_orderkey + 2 AS BIGINT) AS source_row_number FROM rec WHERE quality_status <> 'quarantined'"""


@query
def quarantine_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quarantine_documents(classified(spark, sf_dir), "quality-1")
    return found.select("quarantine_key", "order_id", "quality_status", F.array_join("error_codes", "+").alias("codes"), F.size("error_details").alias("details"), F.col("raw_record.items_json").alias("raw_items"), F.col("cleaned_preview.total_amount").alias("total_amount"), "source_run_id", "source_row_number")


SQL["quarantine_table"] = f"""{_PARSED} SELECT 'run-dirty:' || (o_orderkey + 2) AS quarantine_key, nullif(trim(order_id), '') AS order_id, quality_status, codes, CAST((SELECT count(*) FROM found f WHERE f.o_orderkey = rec.o_orderkey) + CASE WHEN n_codes > 1 THEN 1 ELSE 0 END AS INTEGER) AS details,
  items_json AS raw_items, CASE WHEN expected IS NOT NULL THEN {_show("expected")} ELSE coalesce({_show("order_total")}, total_amount) END AS total_amount, 'run-dirty' AS source_run_id, CAST(o_orderkey + 2 AS BIGINT) AS source_row_number FROM rec WHERE quality_status = 'quarantined'"""
