"""Prices as shops write them. All expressions stay in the JVM and inside code generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases that mean "sold out".
SOLD_OUT_WORDS = ("agotado", "sin stock", "out of stock", "fuera de stock", "no disponible")


def parse_price(text: Column) -> Column:
    """The first number of a text as double; null if there is none or it is malformed.

    With both separators the later one is decimal. With one kind, exactly three digits after the
    last mean thousands, anything else a decimal part.
    """
    return _number(F.regexp_extract(text, r"[\d.,]+", 0))


def _number(run: Column) -> Column:
    """The number that a run of digits and separators writes."""
    both = run.contains(".") & run.contains(",")
    thousands = run.rlike(r"[.,]\d{3}$")
    plain = (
        F.when(both & run.rlike(r",[^.]*$"), F.replace(F.replace(run, F.lit(".")), F.lit(","), F.lit(".")))
        .when(both, F.replace(run, F.lit(",")))
        .when(thousands, F.regexp_replace(run, "[.,]", ""))
        .otherwise(F.replace(run, F.lit(","), F.lit(".")))
    )
    return F.when(run.rlike(r"\d"), plain).try_cast("double")


def add_prices(offers: DataFrame) -> DataFrame:
    """offers with _o and _c, original and current price as numbers, and _pct, the percent off.
    Each step is a column of its own: sorting and formatting then read numbers."""
    runs = offers.withColumns({"_ro": F.regexp_extract("original_price", r"[\d.,]+", 0), "_rc": F.regexp_extract("current_price", r"[\d.,]+", 0)})
    numbers = runs.withColumns({"_o": _number(F.col("_ro")), "_c": _number(F.col("_rc"))}).drop("_ro", "_rc")
    return numbers.withColumn("_pct", discount_pct(F.col("_o"), F.col("_c")))


def filter_price(text: Column) -> Column:
    """The price that range filters compare: separators dropped, then the first run of digits."""
    digits = F.regexp_extract(F.regexp_replace(text, "[.,]", ""), r"(\d+)", 1)
    return F.when(digits != "", digits).try_cast("double")


def discount_pct(original: Column, current: Column) -> Column:
    """Percent off with one decimal, half to even; null unless 0 < current < original."""
    valid = (original > 0) & (current > 0) & (current < original)
    return F.when(valid, F.bround((1 - current / original) * 100, 1))


def format_discount(original: Column, current: Column) -> Column:
    return show_pct(discount_pct(original, current))


def show_pct(pct: Column) -> Column:
    return F.coalesce(F.concat(F.lit("-"), F.format_number(pct, 0), F.lit("%")), F.lit("-"))


def price_pair(original: Column, current: Column) -> tuple[Column, Column]:
    """A lone current price becomes the original; equal texts are no offer."""
    return F.coalesce(original, current), F.when(original.isNotNull() & (original != current), current)


def sold_out(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit(""))).rlike("|".join(SOLD_OUT_WORDS))


def nonzero(number: Column) -> Column:
    """A missing or zero number is missing."""
    return F.nullif(number, F.lit(0.0))
