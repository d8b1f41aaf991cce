"""Schemas and closed vocabularies of the order data."""

from __future__ import annotations

from pyspark.sql import types as T

RAW_COLUMNS = (
    "order_id", "order_date", "status", "customer_id", "customer_name", "customer_phone", "customer_email", "city", "district",
    "delivery_type", "delivery_cost", "payment_method", "payment_status", "payment_amount", "currency", "total_amount", "items_json",
)
CORRUPT = "_corrupt_record"

VALID, CORRECTED, QUARANTINED = "valid", "corrected", "quarantined"

# fixed values: error codes
ERROR_CODES = (
    "MISSING_ORDER_ID", "MISSING_CUSTOMER_ID", "INVALID_IMPOSSIBLE_DATE", "CORRUPTED_ITEMS_JSON", "EMPTY_ITEMS", "UNKNOWN_PRICE",
    "AMBIGUOUS_NEGATIVE_VALUE", "DUPLICATE_ORDER_ID", "MULTIPLE_CONFLICTING_ERRORS", "EMAIL_INVALID_UNRECOVERABLE",
    "PHONE_INVALID_UNRECOVERABLE", "CURRENCY_UNKNOWN", "STATUS_UNKNOWN", "ITEM_QUANTITY_INVALID", "ITEM_COMPONENTS_CONFLICT",
    "TOTAL_UNKNOWN_UNRECOVERABLE",
)
# fixed values: rule codes
RULE_CODES = (
    "WHITESPACE_TRIMMED", "ARABIC_DIGITS_TO_LATIN", "ARABIC_DECIMAL_SEPARATOR_NORMALIZED", "THOUSANDS_SEPARATOR_NORMALIZED",
    "KNOWN_PRICE_WORD_TO_NUMBER", "CURRENCY_SUFFIX_REMOVED", "CURRENCY_NORMALIZED_YER", "PHONE_NORMALIZED_YE",
    "EMAIL_REPEATED_SYMBOLS", "DATE_NORMALIZED", "STATUS_SYNONYM_NORMALIZED", "NEGATIVE_QTY_DERIVED", "ITEM_TOTAL_DERIVED",
    "ITEM_PRICE_DIRECT_DERIVED", "ITEM_TOTAL_RESIDUAL_DERIVED", "ITEM_PRICE_RESIDUAL_DERIVED", "ORDER_TOTAL_DERIVED",
    "ORDER_TOTAL_RECALCULATED",
)
# fixed values: known price words, order statuses, payment statuses and their canonical forms
PRICE_WORDS = {"ألفان": 2000, "خمسة آلاف": 5000}
ORDER_STATUSES = ("مؤكد", "قيد الانتظار", "مرتجع", "قيد الشحن", "تم التسليم", "ملغي")
PAYMENT_STATUSES = {"تم الدفع": "تم الدفع", "بانتظار الدفع": "بانتظار الدفع", "مدفوع": "تم الدفع"}

CORRECTION = "struct<field: string, original_value: string, corrected_value: string, rule_code: string, details: string>"
ERROR = "struct<code: string, field: string, value: string, message: string>"


def csv_schema() -> T.StructType:
    """Every source column as a nullable string, and the corrupt record."""
    return T.StructType([T.StructField(c, T.StringType(), True) for c in (*RAW_COLUMNS, CORRUPT)])


#: The raw table, whichever profile loaded it.
RAW_SCHEMA = (
    "run_id string, source_file string, source_path string, source_row_number bigint, source_row_number_available boolean, ingested_at timestamp,"
    " engine_used string, spark_partition_id int, csv_corrupt_record string, extra_values array<string>, raw_record struct<" + ", ".join(f"{c}: string" for c in RAW_COLUMNS) + ">"
)
