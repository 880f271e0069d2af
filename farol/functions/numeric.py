"""Number parsing and ratios. ANSI mode stays on, so every coercion is a ``try_`` form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from farol.functions.text import strip_space


def to_number(c: Column) -> Column:
    """Double, or null where the text is not a plain number.

    The cast alone would also take ``12d``, ``NaN``, ``Infinity`` and hexadecimal text; testing
    single characters is far cheaper per row than a pattern for the whole number.
    """
    text = strip_space(c.cast("string"))
    plain = F.substring(text, -1, 1).between(".", "9") & (F.instr(F.lower(text), "x") == 0)
    return F.when(plain, text.try_cast("double"))


def int_or_zero(c: Column) -> Column:
    """Integer cut toward zero; bad or missing text gives 0."""
    return F.coalesce(to_number(c).try_cast("int"), F.lit(0))


def comma_number(c: Column) -> Column:
    """Number with a decimal comma, null where it is none."""
    return to_number(F.replace(c, F.lit(","), F.lit(".")))


def comma_int(c: Column) -> Column:
    """Nullable integer cut toward zero from text with a decimal comma or point."""
    return comma_number(c).try_cast("int")


def loses_fraction(c: Column) -> Column:
    """True where ``comma_int`` drops a fraction."""
    number = comma_number(c)
    text = c.cast("string")
    # up to 18 characters without a point, a comma or an exponent are a whole number or none, which costs no parse
    whole = (F.length(text) <= 18) & (F.translate(text, ".,eE", "") == text)
    return F.when(whole, F.lit(False)).otherwise(F.coalesce(number != F.floor(number), F.lit(False)))


def comma_decimal(c: Column, precision: int = 20, scale: int = 4) -> Column:
    """Decimal from text with a decimal comma; thousands points are not expected."""
    return F.replace(strip_space(c), F.lit(","), F.lit(".")).try_cast(f"decimal({precision},{scale})")


def point_style_hint(c: Column) -> Column:
    """Aggregate: true when a whole column writes decimals with a point.

    A comma anywhere, or only groups of three digits after points, means the Brazilian style; a number that
    starts with a zero before its point has no thousands.
    """
    has_comma = F.bool_or(F.contains(c, F.lit(",")))
    has_point_fraction = F.bool_or(c.rlike(r"\.(\d{1,2}|\d{4,})\s*$|^\D*0+\.\d"))
    return F.coalesce(has_point_fraction, F.lit(False)) & ~F.coalesce(has_comma, F.lit(False))


def br_decimal(c: Column, precision: int = 20, scale: int = 4, point_style: Column | bool | None = None) -> Column:
    """Decimal from ``1.234,56``, keeping the sign.

    ``point_style`` says that the column writes ``1234.56``. When it is not given, a value
    without comma whose point is not followed by exactly three digits is read that way.
    """
    text = F.regexp_replace(c, r"[^0-9.,\-]", "")
    if point_style is None:
        one_point = F.length(text) - F.length(F.replace(text, F.lit("."), F.lit(""))) == 1
        fraction = F.length(F.substring_index(text, ".", -1))
        pointed = (F.instr(text, ",") == 0) & one_point & ~fraction.isin(0, 3)
    else:
        pointed = F.lit(point_style) if isinstance(point_style, bool) else point_style
    brazilian = F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    plain = F.replace(text, F.lit(","), F.lit(""))
    return F.when(pointed, plain).otherwise(brazilian).try_cast(f"decimal({precision},{scale})")


def mean_of(c: Column) -> Column:
    """Mean as sum over non-null count; exact and order-free for decimals and integers."""
    return F.try_divide(F.sum(c).cast("double"), F.count(c))


def ratio(a: Column, b: Column) -> Column:
    """a / b as double; null where b is 0 or missing."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def percent_of(a: Column, b: Column) -> Column:
    return ratio(a, b) * 100.0


def percent_gap(a: Column, b: Column) -> Column:
    """(a - b) as percent of a."""
    return F.try_divide((a - b).cast("double") * 100.0, a.cast("double"))


def per_thousand(a: Column, people: Column) -> Column:
    return ratio(a, people) * 1000.0


def filled_total(total: Column, quantity: Column, price: Column) -> Column:
    """Total price; where it is missing or 0, quantity times unit price with nulls as 0."""
    product = F.coalesce(quantity, F.lit(0)) * F.coalesce(price, F.lit(0))
    return F.when(total.isNull() | (total == 0), product.cast("decimal(20,4)")).otherwise(total)
