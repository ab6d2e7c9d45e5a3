"""Text-to-number conversion that keeps track of what it had to drop."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DECIMAL = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_INFINITE = r"(?i)^[+-]?inf(inity)?$"
_FLOAT_MAX = 3.4028234663852886e38


_NUMERIC = ["tinyint", "smallint", "int", "bigint", "float", "double"]


def _by_type(raw: Column, number: Column, text: Column) -> Column:
    """`number` for a numeric column, else `text`; the choice is folded away when the query is planned."""
    return F.when(F.typeof(raw).isin(_NUMERIC), number).otherwise(text)


def _text(raw: Column) -> Column:
    return F.trim(raw.cast("string"))


def parsed_cell(raw: Column) -> Column:
    """A cell as one double that tells its kind: null is missing (NaN of a numeric column included), NaN is text that is
    no number, an infinity stands for itself. Reads text once; the tests below are cheap on its result."""
    number = raw.try_cast("double")
    text = _text(raw)
    read = (
        F.when(text.rlike(_DECIMAL), text.try_cast("double")).when(text.rlike(_INFINITE), F.lit(float("inf")))
        .when(raw.isNotNull(), F.lit(float("nan")))
    )
    return _by_type(raw, F.when(~F.isnan(number), number), read)


def cell_is_infinite(cell: Column) -> Column:
    return F.coalesce(~F.isnan(cell) & (F.abs(cell) > _FLOAT_MAX), F.lit(False))


def cell_is_coerced(cell: Column) -> Column:
    return F.coalesce(F.isnan(cell), F.lit(False))


def cell_value(cell: Column) -> Column:
    return F.when(~F.isnan(cell) & (F.abs(cell) <= _FLOAT_MAX), cell).cast("float")


def parsed_double(raw: Column) -> Column:
    """Number in the cell, or null; may be infinite when text overflows a double."""
    number, text = raw.try_cast("double"), _text(raw)
    return _by_type(raw, F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number),
                    F.when(text.rlike(_DECIMAL), text.try_cast("double")))


def is_infinite(raw: Column) -> Column:
    """True for an infinity, an infinity token or a number beyond the feature type's range."""
    return cell_is_infinite(parsed_cell(raw))


def is_coerced(raw: Column) -> Column:
    """True for text that is present, not infinite and not a number."""
    return cell_is_coerced(parsed_cell(raw))


def feature_value(raw: Column) -> Column:
    """Finite number as a feature value; missing, infinite and unparseable cells are null."""
    return cell_value(parsed_cell(raw))


def finite(value: Column) -> Column:
    """Null out NaN and infinities of a numeric column."""
    number = value.cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)


def ratio(numerator: Column, denominator: Column, empty: float | None = None) -> Column:
    """Quotient with a stated value (null by default) for an empty denominator."""
    result = F.when(denominator != 0, numerator.cast("double") / denominator.cast("double"))
    return result if empty is None else F.coalesce(result, F.lit(float(empty)))
