"""Each rule and error, one changed record each, in one DataFrame."""

import json

import pytest
from pyspark.sql import functions as F

from millrace.operators.classify import classify
from millrace.schema import RAW_COLUMNS

BASE = {
    "order_id": "طلب-1", "order_date": "2025-01-31T12:00:00", "status": "مؤكد", "customer_id": "عميل-1", "customer_name": "محمد", "customer_phone": "777123456",
    "customer_email": "user@example.com", "city": "صنعاء", "district": "التحرير", "delivery_type": "توصيل", "delivery_cost": "2000", "payment_method": "نقدي",
    "payment_status": "تم الدفع", "payment_amount": "12000", "currency": "YER", "total_amount": "12000",
}
ITEM = {"sku": "SKU-1", "name": "منتج", "qty": 2, "unit_price": 5000, "total": 10000}
UNKNOWN = "غير معروف"


def items(*changes):
    return json.dumps([ITEM | c for c in changes], ensure_ascii=False)


def one(qty, total, **rest):
    """One item without a price."""
    return {"items_json": items({"qty": qty, "unit_price": UNKNOWN, "total": total}), "delivery_cost": "0", "total_amount": str(total), "payment_amount": str(total)} | rest


# name: (changes, duplicate, status, rules expected, errors expected, cleaned values expected)
CASES = {
    "base": ({}, False, "valid", [], [], {"items_json": items({}).replace(": ", ":").replace(", ", ",")}),
    "arabic total": ({"total_amount": "١٢٠٠٠٫٠"}, False, "corrected", ["ARABIC_DIGITS_TO_LATIN", "ARABIC_DECIMAL_SEPARATOR_NORMALIZED"], [], {"total_amount": "12000"}),
    "price word": ({"delivery_cost": "ألفان"}, False, "corrected", ["KNOWN_PRICE_WORD_TO_NUMBER"], [], {"delivery_cost": "2000"}),
    "phone": ({"customer_phone": "+967 777123456"}, False, "corrected", ["PHONE_NORMALIZED_YE"], [], {"customer_phone": "777123456"}),
    "email": ({"customer_email": "user@@mail..com"}, False, "corrected", ["EMAIL_REPEATED_SYMBOLS"], [], {"customer_email": "user@mail.com"}),
    "email dots": ({"customer_email": "user@mail..com"}, False, "corrected", ["EMAIL_REPEATED_SYMBOLS"], [], {"customer_email": "user@mail.com"}),
    "date": ({"order_date": "17-01-2025 04:50:00"}, False, "corrected", ["DATE_NORMALIZED"], [], {"order_date": "2025-01-17T04:50:00"}),
    "date slashes": ({"order_date": "2025/04/11 13:41:00"}, False, "corrected", ["DATE_NORMALIZED"], [], {"order_date": "2025-04-11T13:41:00"}),
    "date single digits": ({"order_date": "7/1/2025"}, False, "corrected", ["DATE_NORMALIZED"], [], {"order_date": "2025-01-07T00:00:00"}),
    "iso offset": ({"order_date": "2025-01-31T12:00:00.25+03:00"}, False, "valid", [], [], {"order_date": "2025-01-31T12:00:00"}),
    "iso z": ({"order_date": "2025-01-31T12:00Z"}, False, "valid", [], [], {"order_date": "2025-01-31T12:00:00"}),
    "iso day": ({"order_date": "٢٠٢٥-01-31"}, False, "valid", [], [], {"order_date": "2025-01-31T00:00:00"}),
    "negative qty": ({"items_json": items({"qty": -2, "total": 15000}), "total_amount": "17000", "payment_amount": "17000"}, False, "corrected", ["NEGATIVE_QTY_DERIVED"], [], {"items_json": items({"qty": 3, "total": 15000}).replace(": ", ":").replace(", ", ",")}),
    "residual": ({"items_json": items({}, {"unit_price": UNKNOWN, "total": UNKNOWN}), "total_amount": "22000", "payment_amount": "22000"}, False, "corrected", ["ITEM_TOTAL_RESIDUAL_DERIVED", "ITEM_PRICE_RESIDUAL_DERIVED"], [], {"items_json": items({}, {}).replace(": ", ":").replace(", ", ",")}),
    "recalculated": ({"total_amount": "9999"}, False, "corrected", ["ORDER_TOTAL_RECALCULATED"], [], {"total_amount": "12000"}),
    "impossible date": ({"order_date": "2025-19-45 99:70:00"}, False, "quarantined", [], ["INVALID_IMPOSSIBLE_DATE"], {}),
    "february": ({"order_date": "31-02-2025"}, False, "quarantined", [], ["INVALID_IMPOSSIBLE_DATE"], {}),
    "not json": ({"items_json": "not-json"}, False, "quarantined", [], ["CORRUPTED_ITEMS_JSON"], {}),
    "not a list": ({"items_json": "{}"}, False, "quarantined", [], ["CORRUPTED_ITEMS_JSON"], {}),
    "a null item": ({"items_json": "[null]"}, False, "quarantined", [], ["CORRUPTED_ITEMS_JSON"], {}),
    "a number item": ({"items_json": "[1]"}, False, "quarantined", [], ["CORRUPTED_ITEMS_JSON"], {}),
    "junk after": ({"items_json": "[{}] junk"}, False, "quarantined", [], ["CORRUPTED_ITEMS_JSON"], {}),
    "currency": ({"currency": "عملة غير معروفة"}, False, "quarantined", [], ["CURRENCY_UNKNOWN"], {}),
    "email lost": ({"customer_email": "user-without-domain"}, False, "quarantined", [], ["EMAIL_INVALID_UNRECOVERABLE"], {}),
    "thousands": ({"delivery_cost": "2,000"}, False, "corrected", ["THOUSANDS_SEPARATOR_NORMALIZED"], [], {"delivery_cost": "2000"}),
    "arabic payment": ({"payment_amount": "١٢٠٠٠٫٠"}, False, "corrected", ["ARABIC_DIGITS_TO_LATIN", "ARABIC_DECIMAL_SEPARATOR_NORMALIZED"], [], {"payment_amount": "12000"}),
    "suffix": ({"delivery_cost": "2000 ريال"}, False, "corrected", ["CURRENCY_SUFFIX_REMOVED"], [], {"delivery_cost": "2000"}),
    "silent suffix": ({"delivery_cost": "2000 YER"}, False, "valid", [], [], {"delivery_cost": "2000"}),
    "currency name": ({"currency": "ريال يمني"}, False, "corrected", ["CURRENCY_NORMALIZED_YER"], [], {"currency": "YER"}),
    "padded status": ({"status": "  مؤكد  "}, False, "corrected", ["WHITESPACE_TRIMMED"], [], {"status": "مؤكد"}),
    "no-break space": ({"city": " صنعاء "}, False, "corrected", ["WHITESPACE_TRIMMED"], [], {"city": "صنعاء"}),
    "paid": ({"payment_status": "مدفوع"}, False, "corrected", ["STATUS_SYNONYM_NORMALIZED"], [], {"payment_status": "تم الدفع"}),
    "payment status unknown": ({"payment_status": "x"}, False, "valid", [], [], {"payment_status": "x"}),
    "item total": ({"items_json": items({"total": UNKNOWN})}, False, "corrected", ["ITEM_TOTAL_DERIVED"], [], {}),
    "item price": ({"items_json": items({"unit_price": UNKNOWN})}, False, "corrected", ["ITEM_PRICE_DIRECT_DERIVED"], [], {}),
    "order total": ({"total_amount": "???"}, False, "corrected", ["ORDER_TOTAL_DERIVED"], [], {"total_amount": "12000"}),
    "no order id": ({"order_id": ""}, False, "quarantined", [], ["MISSING_ORDER_ID"], {}),
    "null order id": ({"order_id": None}, False, "quarantined", [], ["MISSING_ORDER_ID"], {}),
    "no customer": ({"customer_id": " "}, False, "quarantined", ["WHITESPACE_TRIMMED"], ["MISSING_CUSTOMER_ID"], {}),
    "short phone": ({"customer_phone": "12345"}, False, "quarantined", [], ["PHONE_INVALID_UNRECOVERABLE"], {}),
    "phone without plus": ({"customer_phone": "967777123456"}, False, "quarantined", [], ["PHONE_INVALID_UNRECOVERABLE"], {}),
    "no items": ({"items_json": "[]"}, False, "quarantined", [], ["EMPTY_ITEMS"], {}),
    "null items": ({"items_json": None}, False, "quarantined", [], ["EMPTY_ITEMS"], {}),
    "status": ({"status": "حالة غير معروفة تمامًا"}, False, "quarantined", [], ["STATUS_UNKNOWN"], {}),
    "ambiguous": ({"items_json": items({"qty": -2, "total": 14000}), "total_amount": "16000", "payment_amount": "16000"}, False, "quarantined", [], ["AMBIGUOUS_NEGATIVE_VALUE"], {}),
    "conflict": ({"items_json": items({"total": 9000})}, False, "quarantined", ["ORDER_TOTAL_RECALCULATED"], ["ITEM_COMPONENTS_CONFLICT"], {}),
    "unknown price": ({"items_json": items({"unit_price": UNKNOWN, "total": UNKNOWN}), "payment_amount": "11000"}, False, "quarantined", [], ["UNKNOWN_PRICE"], {}),
    "duplicate": ({}, True, "quarantined", [], ["DUPLICATE_ORDER_ID"], {}),
    "several": ({"order_id": "", "order_date": "2025-19-45 99:70:00"}, False, "quarantined", [], ["MISSING_ORDER_ID", "INVALID_IMPOSSIBLE_DATE", "MULTIPLE_CONFLICTING_ERRORS"], {}),
    "five": ({"customer_id": "", "customer_email": "a@@b", "items_json": "not-json", "total_amount": "???"}, False, "quarantined", [], ["MISSING_CUSTOMER_ID", "EMAIL_INVALID_UNRECOVERABLE", "CORRUPTED_ITEMS_JSON", "TOTAL_UNKNOWN_UNRECOVERABLE", "MULTIPLE_CONFLICTING_ERRORS"], {}),
    "qty zero": ({"items_json": items({"qty": 0, "total": 0}), "total_amount": "2000"}, False, "quarantined", [], ["ITEM_QUANTITY_INVALID"], {}),
    "negative price": ({"items_json": items({"unit_price": -5000})}, False, "quarantined", [], ["AMBIGUOUS_NEGATIVE_VALUE"], {}),
    "negative total": ({"items_json": items({"total": -10000})}, False, "quarantined", [], ["AMBIGUOUS_NEGATIVE_VALUE"], {}),
    "fractional qty": ({"items_json": items({"qty": 2.5, "total": 12500}), "total_amount": "14500"}, False, "valid", [], [], {}),
    "two open items": ({"items_json": items({"unit_price": UNKNOWN, "total": UNKNOWN}, {"unit_price": UNKNOWN, "total": UNKNOWN})}, False, "quarantined", [], ["UNKNOWN_PRICE"], {}),
    "delivery bad, total known": ({"delivery_cost": "x"}, False, "valid", [], [], {"delivery_cost": "x"}),
    "comma as thousands": ({"delivery_cost": "1,5", "total_amount": "10015", "payment_amount": "10015"}, False, "corrected", ["THOUSANDS_SEPARATOR_NORMALIZED"], [], {"delivery_cost": "15"}),
    "underscore": ({"delivery_cost": "2_000"}, False, "valid", [], [], {"delivery_cost": "2000"}),
    "item text trimmed": ({"items_json": items({"name": " منتج ", "qty": "2"})}, False, "corrected", ["WHITESPACE_TRIMMED"], [], {}),
    "item arabic qty": ({"items_json": items({"qty": "٢"})}, False, "corrected", ["ARABIC_DIGITS_TO_LATIN"], [], {}),
    "numbers written back": ({"items_json": items({"unit_price": 5000.0, "total": 10000.0, "note": None, "gift": True})}, False, "valid", [], [], {"items_json": '[{"sku":"SKU-1","name":"منتج","qty":2,"unit_price":5000,"total":10000,"note":null,"gift":true}]'}),
    "key twice": ({"items_json": '[{"qty":9,"unit_price":5000,"total":10000,"qty":2}]'}, False, "valid", [], [], {"items_json": '[{"qty":2,"unit_price":5000,"total":10000}]'}),
    "ratio 10/3": (one(3, 10), False, "quarantined", ["ITEM_PRICE_DIRECT_DERIVED"], ["ITEM_COMPONENTS_CONFLICT"], {}),
    "ratio 1/3": (one(3, 1), False, "quarantined", ["ITEM_PRICE_DIRECT_DERIVED"], ["ITEM_COMPONENTS_CONFLICT"], {}),
    "ratio 2/3": (one(3, 2), False, "corrected", ["ITEM_PRICE_DIRECT_DERIVED"], [], {}),
    "ratio 10/6": (one(6, 10), False, "corrected", ["ITEM_PRICE_DIRECT_DERIVED"], [], {}),
    "ratio 20/3": (one(3, 20), False, "corrected", ["ITEM_PRICE_DIRECT_DERIVED"], [], {}),
    "ratio 100/7": (one(7, 100), False, "corrected", ["ITEM_PRICE_DIRECT_DERIVED"], [], {}),
    "ratio 5/4": (one(4, 5), False, "corrected", ["ITEM_PRICE_DIRECT_DERIVED"], [], {"items_json": '[{"sku":"SKU-1","name":"منتج","qty":4,"unit_price":1.25,"total":5}]'}),
}


@pytest.fixture(scope="module")
def results(spark):
    rows = [(name, duplicate, *({**BASE, "items_json": items({}), **changes}[c] for c in RAW_COLUMNS)) for name, (changes, duplicate, *_) in CASES.items()]
    df = spark.createDataFrame(rows, "name string, dup boolean, " + ", ".join(f"{c} string" for c in RAW_COLUMNS))
    df = df.select("name", "dup", F.struct(*RAW_COLUMNS).alias("raw_record"))
    return {r["name"]: r for r in classify(df, "dup").collect()}


@pytest.mark.parametrize("name", list(CASES))
def test_case(results, name):
    _, _, status, rules, errors, cleaned = CASES[name]
    row = results[name]
    assert [e for e in row["codes_error"]] == errors, row["details_error"]
    assert [c["rule_code"] for c in row["corrections"]] == rules
    assert row["quality_status"] == status
    for column, value in cleaned.items():
        assert row["cleaned_record"][column] == value


def test_ratios_agree_with_28_digit_arithmetic(spark):
    from decimal import Decimal

    from millrace.functions.text import NUMBER, ratio_conflicts

    pairs = [(t, q) for q in range(1, 60) for t in (*range(1, 60), 100, 1000, 10**6, 123457, 0.1, 2.5, 999.999)]
    df = spark.createDataFrame([(float(t), float(q)) for t, q in pairs], "t double, q double").select("t", "q", ratio_conflicts(F.col("t").cast(NUMBER), F.col("q").cast(NUMBER)).alias("c"))
    for r in df.collect():
        t, q = Decimal(str(r["t"])), Decimal(str(r["q"]))
        assert r["c"] == (q * (t / q) != t), (t, q)


ISO_FORMS = [
    "2025-01-31", "20250131", "2025-W05-5", "2025W055", "2025-W05", "2025W05", "2025-01-31T12", "2025-01-31x12:00", "20250131T120000", "2025-01-31T1200", "2025-01-31 12:00:01.5+03:30", "2025-01-31T12:00:00,123456",
    "2025-01-31T12:00Z", "2020-W53-7", "2025-W53-1", "2025-W00-1", "2025-W05-8", "2025-02-29", "2024-02-29", "2025-13-01", "2025-01-31T24:00", "2025-01-31T12:60", "2025-1-31", "2025-01-31T", "2025-0131", "2025-01-31T12:00+25:00", "20250131T12:00", "x",
]


def test_iso_forms_are_those_of_the_standard_library(spark):
    from datetime import datetime

    from millrace.operators.rules import iso_date

    def want(text):
        try:
            return datetime.fromisoformat(text.replace("Z", "+00:00")).strftime("%Y-%m-%dT%H:%M:%S")
        except ValueError:
            return None

    rows = spark.createDataFrame([(t,) for t in ISO_FORMS], "t string").select("t", iso_date(F.col("t")).alias("d")).collect()
    assert {r["t"]: r["d"] for r in rows} == {t: want(t) for t in ISO_FORMS}


PLAIN = '{"sku":"SKU-1","name":"منتج","qty":2,"unit_price":5000,"total":10000}'


@pytest.mark.parametrize(("text", "plain"), [
    (f"[{PLAIN}]", True), (f"[{PLAIN},{PLAIN}]", True), (f"[{PLAIN.replace('2,', '2.0,')}]", True), (f"[{PLAIN};{PLAIN}]", False), (f"[{PLAIN}{PLAIN}]", False), (f"[{PLAIN}],", False), (f"[{PLAIN},]", False),
    (f"[{PLAIN.replace('10000', '9000')}]", False), (f"[{PLAIN.replace('منتج', ' منتج')}]", False), (f"[{PLAIN.replace('منتج', 'a,{x 1.0,')}]", True), (f"[{PLAIN.replace('SKU-1', '')}]", True), (f"[{PLAIN.replace('2,', '-2,')}]", False), (PLAIN, False), (None, False),
])
def test_plain_items_end_as_the_stages_would_have_them(spark, monkeypatch, text, plain):
    from millrace.functions import audit
    from millrace.operators import items as module

    df = spark.createDataFrame([(text, "2000", "12000", "12000")], "items_json string, a string, b string, c string").select("items_json", *(F.col(x).cast("decimal(18,6)").alias(y) for x, y in zip("abc", ("delivery", "order_total", "payment"), strict=True)))
    assert (df.select(module.plain_items(F.col("items_json")).alias("p")).first()["p"] is not None) == plain
    pick = lambda x: x.selectExpr("transform(items, s -> struct(s.qty, s.price, s.total, s.derived, s.shown_price))", "items_made", "items_found", "items_text").first()
    short = pick(module.item_states(df))
    monkeypatch.setattr(module, "plain_items", lambda text: F.lit(None).cast("array<struct<q: decimal(18,0), p: decimal(18,0), t: decimal(18,0)>>"))
    monkeypatch.setattr(audit, "_HELD", {})
    assert pick(module.item_states(df)) == short


def test_an_orders_own_numbers_are_wide(spark):
    from millrace.functions.text import WIDE, number_text, parse_number

    shown = {
        "12345678901234567890": "12345678901234567890", "1234567890123": "1234567890123", "0.1234567": "0.1234567", "-1234567890123.5000": "-1234567890123.5", "1e15": "1000000000000000",
        "1,234,567,890,123 YER": "1234567890123", "123456789012345678901": None, "0.12345678901": None, "ألفان": "2000", "": None,
    }
    rows = spark.createDataFrame(list(shown.items()), "text string, want string").select("want", number_text(parse_number(F.col("text"), WIDE)).alias("got"))
    assert all(r["got"] == r["want"] for r in rows.collect())


def test_wide_totals_are_recalculated(spark):
    records = [BASE | {"items_json": items({})} | c for c in ({"total_amount": "1234567890123"}, {"payment_amount": "0.1234567"}, {"delivery_cost": "12345678901234567890"})]
    rows = spark.createDataFrame([(k, tuple(r[c] for c in RAW_COLUMNS)) for k, r in enumerate(records)], "k int, raw_record struct<" + ", ".join(f"{c}: string" for c in RAW_COLUMNS) + ">")
    a, b, c = classify(rows).orderBy("k").collect()
    assert [(x["rule_code"], x["original_value"], x["corrected_value"]) for x in a["corrections"]] == [("ORDER_TOTAL_RECALCULATED", "1234567890123", "12000")]
    assert b["quality_status"] == "valid" and b["cleaned_record"]["payment_amount"] == "0.1234567"
    assert c["cleaned_record"]["total_amount"] == "12345678901234577890" and c["quality_status"] == "corrected"


FIELDS = [
    {}, {"order_id": ""}, {"customer_id": " "}, {"currency": "yEr"}, {"currency": "ريال"}, {"currency": "عملة"}, {"status": " مؤكد"}, {"status": "x"}, {"status": None}, {"payment_status": "مدفوع"}, {"payment_status": "x"},
    {"payment_status": None}, {"delivery_cost": "02000"}, {"delivery_cost": "2000.0"}, {"payment_amount": "١٢"}, {"total_amount": ""}, {"total_amount": "123456789012345678901"}, {"total_amount": None},
    {"customer_phone": "+967 700000000"}, {"customer_phone": "70000000"}, {"customer_phone": None}, {"customer_email": "a..b@@c.com"}, {"customer_email": "a@b"}, {"customer_email": "a.@b.c"}, {"customer_email": "é@b.c"},
    {"order_date": "2025-02-30T10:00:00"}, {"order_date": "31-01-2025"}, {"order_date": "2025-W05-5"}, {"order_date": None}, {"city": " x "}, {"city": ""}, {"city": "　"}, {"district": "x "}, {"district": "\x1cx"},
    {"customer_name": "​x"}, {"items_json": "[]"}, {"items_json": "x"}, {"items_json": None}, {"items_json": items({})[:-1] + " ]"},
]


def test_fine_rows_end_as_the_field_rules_would_have_them(spark, monkeypatch):
    from millrace.functions import audit
    from millrace.operators import rules

    records = [BASE | {"items_json": items({})} | change for change in FIELDS]
    df = spark.createDataFrame([(k, k == 1, tuple(r[c] for c in RAW_COLUMNS)) for k, r in enumerate(records)], "k int, again boolean, raw_record struct<" + ", ".join(f"{c}: string" for c in RAW_COLUMNS) + ">")
    fine = df.select("k", rules.nothing_to_do({c: F.col(f"raw_record.{c}") for c in RAW_COLUMNS}).alias("fine")).where("fine").collect()
    assert 0 in {r["k"] for r in fine} and not {r["k"] for r in fine} & {1, *range(3, 10)}  # blanks are trimmed before
    short = classify(df, "again").orderBy("k").collect()
    monkeypatch.setattr(rules, "nothing_to_do", lambda columns: F.lit(False))
    monkeypatch.setattr(audit, "_HELD", {})
    assert classify(df, "again").orderBy("k").collect() == short
