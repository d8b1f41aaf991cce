"""Scalar expressions over text: white space, digits, numbers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.schema import PRICE_WORDS

#: White space as Unicode has it (what a text editor would call blank), not ASCII blanks alone.
WHITE = r"\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
ARABIC = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹"
LATIN = "01234567890123456789"
#: Numbers of items, and of an order's own fields: twenty digits before the point and ten after.
NUMBER, WIDE = "decimal(18,6)", "decimal(30,10)"
_SUFFIX = rf"(?iu)[{WHITE}]*(YER|ريال يمني|ريال)[{WHITE}]*$"
_AUDITED_SUFFIX = rf"(ريال يمني|ريال)[{WHITE}]*$"


def strip(text: Column) -> Column:
    """`text` without white space at either end. Texts that neither start nor end with any, nearly all, are not searched:
    those whose ends lie between the blanks, in ASCII or in the scripts before Ogham, are told by comparison."""
    inner = lambda c: (c >= "!") & (c <= "~") | (c >= "\u00a1") & (c < "\u1680")
    first, last = F.substring(text, 1, 1), F.substring(text, -1, 1)
    blank = F.concat(first, last).rlike(f"[{WHITE}]")
    return F.when(inner(first) & inner(last), text).when(blank, F.regexp_replace(text, f"^[{WHITE}]+|[{WHITE}]+$", "")).otherwise(text)


def is_blank(text: Column) -> Column:
    return text.isNull() | text.rlike(f"^[{WHITE}]*$")


def latin_digits(text: Column) -> Column:
    """Arabic-Indic and extended Arabic-Indic digits as ASCII digits."""
    return F.translate(text, ARABIC, LATIN)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, also within the lambdas of higher-order functions."""
    return F.transform(F.array(value), body).getItem(0)


def in_parts(value: Column) -> Column:
    """`value`, by an expression that whole-stage code generation leaves alone. The other columns of its projection are then
    generated as small methods: as one method of more than 8000 bytes the JVM would never compile them."""
    return let(value, lambda x: x)


def parse_number(text: Column, kind: str = NUMBER) -> Column:
    """The number a stripped text stands for, as `kind` (NUMBER or WIDE); null if it is none or does not fit exactly.

    Known price words; digits of either script; either decimal separator; thousands separators anywhere; a currency
    suffix; an underscore between digits; an exponent. Texts such as NaN or Infinity are no numbers. Plain digits, which
    nearly all values are, take a short way.
    """
    before, after = {NUMBER: (12, 6), WIDE: (20, 10)}[kind]
    exactly = f"decimal(38,{after + 6})"
    grammar = rf"^[+-]?([0-9]{{1,{before}}}\.?[0-9]{{0,{after}}}0*|\.[0-9]{{1,{after}}}0*)([eE][+-]?[0-9]{{1,2}})?$"

    def plain(text: Column) -> Column:
        bare = F.regexp_replace(F.translate(latin_digits(text), "٫٬", ".,"), _SUFFIX, "")
        return F.regexp_replace(F.translate(strip(bare), ",", ""), "(?<=[0-9])_(?=[0-9])", "")

    def read(bare: Column) -> Column:
        return let(F.when(bare.rlike(grammar), bare.try_cast(exactly)), lambda exact: F.when(exact.try_cast(kind).try_cast(exactly) == exact, exact.try_cast(kind)))

    parsed = let(plain(text), read)
    for word, value in PRICE_WORDS.items():
        parsed = F.when(text == word, F.lit(value).cast(kind)).otherwise(parsed)
    return F.when(text.rlike(f"^[0-9]{{1,{before}}}$"), text.try_cast(kind)).otherwise(parsed)


def number_rules(text: Column) -> Column:
    """The rule codes, in order, by which a stripped text that is a number was read as one."""
    codes = [
        (text.isin(*PRICE_WORDS), "KNOWN_PRICE_WORD_TO_NUMBER"),
        (text.rlike(f"[{ARABIC}]"), "ARABIC_DIGITS_TO_LATIN"),
        (text.contains("٫"), "ARABIC_DECIMAL_SEPARATOR_NORMALIZED"),
        (text.rlike("[,٬]"), "THOUSANDS_SEPARATOR_NORMALIZED"),
        (text.rlike(_AUDITED_SUFFIX), "CURRENCY_SUFFIX_REMOVED"),
    ]
    found = F.array_compact(F.array(*(F.when(when, F.lit(code)) for when, code in codes)))
    return F.when(text.rlike("^-?[0-9]+(\\.[0-9]+)?$"), F.expr("cast(array() as array<string>)")).otherwise(found)


def number_text(value: Column) -> Column:
    """A decimal as the shortest plain digits: 12000, 10.5."""
    whole = value.cast("decimal(24,0)")
    short = F.regexp_replace(F.regexp_replace(value.cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return F.when(whole == value, whole.cast("string")).otherwise(short)


def ratio_text(total: Column, by: Column) -> Column:
    """total / by as plain digits where it ends within six places, else as the nearest double."""
    return let(F.try_divide(total, by).try_cast(NUMBER), lambda exact: F.when((exact * by) == total, number_text(exact)).otherwise(F.try_divide(total, by).cast("double").cast("string")))


def positive_integer(value: Column) -> Column:
    return value.isNotNull() & (value > 0) & (value == F.floor(value))


def ratio_conflicts(total: Column, by: Column) -> Column:
    """Whether total / by, rounded to 28 significant digits (half to even), times `by`, so rounded again, is not `total`.

    In integers: with k = 28 - (digits of the quotient before the point), r = total * 10^k mod by is what rounding
    leaves. The product misses the total by min(r, by - r) / 10^k, and rounds back to it unless that is more than half
    a unit of the total's last digit - a tenth of it just below a power of ten.
    """
    whole = "decimal(38,0)"
    million = F.lit(1_000_000).cast("decimal(7,0)")
    quotient_digits = F.floor(F.log10(F.try_divide(total, by).cast("double")) + 1e-12).cast("int") + 1
    total_digits = F.floor(F.log10(total.cast("double")) + 1e-12).cast("int") + 1
    power = lambda n: F.rpad(F.lit("1"), n + 1, "0").cast(whole)
    shift = 22 - quotient_digits  # the total is counted in millionths
    first = F.least(shift, F.lit(12))
    units, b = (total * million).cast(whole), by.cast(whole)
    step = ((units % b) * power(first).cast("decimal(13,0)")) % b
    step = (step.cast("decimal(19,0)") * power(F.least(shift - first, F.lit(12))).cast("decimal(13,0)")) % b
    step = (step.cast("decimal(19,0)") * power(F.greatest(shift - first - 12, F.lit(0))).cast("decimal(13,0)")) % b
    down = step * 2 < b
    left = F.when(down, step).otherwise(b - step).cast("double")
    below = down & (total.cast("double") == F.pow(F.lit(10.0), (total_digits - 1).cast("double")))
    unit = F.pow(F.lit(10.0), (total_digits - F.when(below, 1).otherwise(0) - quotient_digits).cast("double"))
    return F.coalesce((total > 0) & (step != 0) & (left > unit / 2), F.lit(False))
