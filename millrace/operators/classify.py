"""Record classification: every order is valid, corrected or quarantined, with an ordered audit trail."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.audit import computed_once, correction, correction_entries, error, error_entries, held, no_corrections, no_errors
from millrace.functions.text import WIDE, in_parts, number_text, parse_number, strip
from millrace.operators import rules
from millrace.operators.items import ORDER_SUM, item_states
from millrace.schema import CORRECTED, QUARANTINED, RAW_COLUMNS, VALID

OUTPUT = ("quality_status", "cleaned_record", "corrections", "codes_error", "details_error")


def classify(df: DataFrame, duplicate: str | None = None) -> DataFrame:
    """`df` (the 17 source columns in a struct raw_record, and whatever else) with the columns of OUTPUT.

    `duplicate` names a boolean column that marks members of a duplicate group. Rows are judged one by one: no shuffle.
    The stages are ordered as the audit trail lists them: trimming, ids, duplicates, date, e-mail, phone, currency,
    statuses, top-level numbers, items, order total, several errors at once.
    """
    keep = [c for c in df.columns if c not in OUTPUT and c != duplicate]
    flag = F.coalesce(F.col(duplicate), F.lit(False)) if duplicate else F.lit(False)
    df = df.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("_row"), flag.alias("_duplicate")).select("_row", in_parts(F.col("_duplicate")).alias("_duplicate"), *held(_trimmed))
    df = item_states(df.withColumns(held(_facts)).withColumns(held(_fields)))
    for stage in held(_record):
        df = df.withColumns(stage)
    return df.select(*(F.col(f"_row.`{c}`").alias(c) for c in keep), *held(_outputs))


NUMERIC = {"delivery": "delivery_cost", "payment": "payment_amount", "order_total": "total_amount"}
_COLUMNS = {"date": "order_date", "email": "customer_email", "phone": "customer_phone", "currency": "currency", "status": "status", "payment_status": "payment_status", **NUMERIC}


def _trimmed() -> list[F.Column]:
    return [strip(_raw(c)).alias(c) for c in RAW_COLUMNS]


def _raw(column: str) -> F.Column:
    return F.col(f"_row.raw_record.{column}")


def _facts() -> dict[str, F.Column]:
    """The numbers, and whether no field rule has anything to say of the row: two thirds of the rows, even of dirty ones,
    for which none is evaluated."""
    as_it_was = reduce(lambda a, b: a & b, (_raw(c).eqNullSafe(F.col(c)) for c in RAW_COLUMNS))
    fine = ~F.col("_duplicate") & as_it_was & rules.nothing_to_do({c: F.col(c) for c in RAW_COLUMNS})
    return {"_fine": fine} | {n: parse_number(F.col(c), WIDE) for n, c in NUMERIC.items()}


def _fields() -> dict[str, F.Column]:
    """The cleaned fields, and the corrections and errors so far."""
    col = F.col
    steps = {
        "date": rules.order_date(col("order_date")), "email": rules.email(col("customer_email")), "phone": rules.phone(col("customer_phone")),
        "currency": rules.currency(col("currency")), "status": rules.order_status(col("status")), "payment_status": rules.payment_status(col("payment_status")),
        **{n: rules.number(c, col(c), col(n)) for n, c in NUMERIC.items()},
    }
    trims = rules.trim_corrections({c: (_raw(c), col(c)) for c in RAW_COLUMNS})
    ids = F.concat(
        rules.required("order_id", col("order_id"), "MISSING_ORDER_ID", "Order ID"),
        rules.required("customer_id", col("customer_id"), "MISSING_CUSTOMER_ID", "Customer ID"),
        error_entries((col("_duplicate"), error("DUPLICATE_ORDER_ID", "order_id", col("order_id"), "other rows of the run carry the same order id"))),
    )
    judged = ("date", "email", "phone", "currency", "status")
    made, found = F.concat(trims, *(s.corrections for s in steps.values())), F.concat(ids, *(steps[f].errors for f in judged))
    values = {_COLUMNS[f]: s.value for f, s in steps.items()}
    return {
        "_made": F.when(col("_fine"), no_corrections()).otherwise(made), "_found": F.when(col("_fine"), no_errors()).otherwise(found),
        **{f"_clean_{c}": F.when(col("_fine"), col(c)).otherwise(value) for c, value in values.items()},
    }


def _record() -> list[dict[str, F.Column]]:
    """Stages after the items: the order's total, codes, several errors at once."""
    col = F.col
    several = F.size("_codes") > 1
    message = error("MULTIPLE_CONFLICTING_ERRORS", "_record", None, "more than one kind of error")
    return [
        *_order_total(),
        {"_codes": F.when(F.size("_found") == 0, F.expr("cast(array() as array<string>)")).otherwise(F.array_distinct(F.transform("_found", lambda e: e["code"])))},
        {"codes_error": F.when(several, F.array_append("_codes", "MULTIPLE_CONFLICTING_ERRORS")).otherwise(col("_codes")), "details_error": F.when(several, F.array_append("_found", message)).otherwise(col("_found"))},
    ]


def _outputs() -> list[F.Column]:
    col = F.col
    status = F.when(F.size("codes_error") > 0, QUARANTINED).when(F.size("_made") > 0, CORRECTED).otherwise(VALID)
    clean = {c: col(f"_clean_{c}") for c in _COLUMNS.values()} | {"items_json": col("items_text"), "total_amount": col("_final_total")}
    cleaned = F.struct(*(clean.get(c, col(c)).alias(c) for c in RAW_COLUMNS))
    outputs = {"quality_status": status, "cleaned_record": cleaned, "corrections": col("_made"), "codes_error": col("codes_error"), "details_error": col("details_error")}
    return [computed_once(e).alias(c) for c, e in outputs.items()]


def _order_total() -> list[dict[str, F.Column]]:
    """Derives or recalculates the order's total from its items and delivery, or reports it unknown."""
    col = F.col
    usable = col("items_read") & (col("delivery") >= 0)
    expected = F.when(usable, (col("items_goods") + col("delivery")).cast(ORDER_SUM))
    derived = col("_expected").isNotNull() & col("order_total").isNull()
    changed = F.coalesce(col("_expected") != col("order_total"), F.lit(False))
    made = correction_entries(
        (derived, correction("total_amount", _raw("total_amount"), number_text(col("_expected")), "ORDER_TOTAL_DERIVED", "item totals and delivery added up")),
        (changed, correction("total_amount", col("_clean_total_amount"), number_text(col("_expected")), "ORDER_TOTAL_RECALCULATED", "stated total replaced by item totals and delivery added up")),
    )
    unknown = col("order_total").isNull() & col("_expected").isNull()
    message = F.when(F.coalesce(usable, F.lit(False)), "no total, and an item's total is open").otherwise("no total, and items or delivery cannot be used")
    found = error_entries((unknown, error("TOTAL_UNKNOWN_UNRECOVERABLE", "total_amount", _raw("total_amount"), message)))
    final = F.when(derived | changed, number_text(col("_expected"))).otherwise(col("_clean_total_amount"))
    return [{"_expected": expected}, {"_final_total": final, "_made": _joined("_made", "items_made", made), "_found": _joined("_found", "items_found", found)}]


def _joined(fields: str, items: str, order: F.Column) -> F.Column:
    """The entries of the fields, the items and the order's total, one after the other."""
    return F.when((F.size(items) == 0) & (F.size(order) == 0), F.col(fields)).otherwise(F.concat(fields, items, order))


__all__ = ["OUTPUT", "classify"]
