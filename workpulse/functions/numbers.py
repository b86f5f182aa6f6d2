"""Text to number, and numbers to shown text."""

from decimal import Decimal

from pyspark.sql import Column, functions as F

from workpulse.functions.text import strip

# Only plain decimal numbers are read: engines disagree on suffixes, underscores, hex and special words.
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def number_or_null(text: Column) -> Column:
    """A number. The guard runs first, since a failing cast costs an exception per row, and only text
    that fails it is stripped and tried again."""
    bare = strip(text)
    return F.when(text.rlike(NUMBER), text.try_cast("double")).when(bare.rlike(NUMBER), bare.try_cast("double"))


def number_or_zero(text: Column) -> Column:
    return F.coalesce(number_or_null(text), F.lit(0.0))


def loss_amount(text: Column) -> Column:
    """Loss text without its commas; zero counts as not given."""
    return F.nullif(number_or_null(F.replace(text, F.lit(","), F.lit(""))), F.lit(0.0))


def money_text(amount: Column) -> Column:
    return F.concat(F.lit("R$"), F.coalesce(F.format_number(amount, 2), F.lit("nan")))


def fixed_text(value: Column, places: int) -> Column:
    """Number with a fixed count of decimals and no separators; the exact value is rounded, ties to even.

    Below one unit of the last place the formatter goes by the shortest text of the number, which may lie on a tie that
    the number itself does not, so these are told by comparison.
    """
    unit = Decimal(1).scaleb(-places)
    tie, size = float(unit / 2), F.abs(value)
    up = size >= tie if Decimal(tie) > unit / 2 else size > tie
    one = F.concat(F.when(value < 0, "-").otherwise(""), F.lit(f"{unit:f}"))
    shown = F.replace(F.format_number(value, places), F.lit(","), F.lit(""))
    return F.coalesce(F.when((size < float(unit)) & up, one).otherwise(shown), F.lit("nan"))


def round_half_even(value: Column, places: int) -> Column:
    """Scale, round to the even neighbour, scale back."""
    scale = float(10**places)
    return F.rint(value * scale) / scale
