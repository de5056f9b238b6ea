"""Column expressions for text-typed table cells."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Words read as booleans.
BOOLEAN_WORDS = ("true", "false", "yes", "no", "y", "n", "0", "1")

# A number as users type it: optional sign, digits with an optional comma or dot, optional exponent.
NUMBER_PATTERN = r"^[+-]?(([0-9]+([.,][0-9]*)?|[.,][0-9]+)([eE][+-]?[0-9]+)?|(?i:nan|inf(inity)?))$"
INTEGER_PATTERN = r"^[+-]?[0-9]+$"
DATE_PATTERN = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}([ T].*)?$"


def data_type(df: DataFrame, column: str) -> T.DataType:
    return df.schema[column].dataType


def is_text(df: DataFrame, column: str) -> bool:
    return isinstance(data_type(df, column), T.StringType)


# What counts as white space around a cell.
WHITE_SPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\u00a0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))


def stripped(text: Column) -> Column:
    """Text without white space at its ends, '' for null."""
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE_SPACE))


def plain_number(number: Column) -> Column:
    """A double's shortest exact text in plain digits: the exponent is written out, a bare ``.0`` dropped."""
    text = number.cast("string")
    part = lambda i: F.regexp_extract(text, r"^-?([0-9])\.([0-9]+?)0*E(-?[0-9]+)$", i)
    frac = F.when(part(2) == "0", "").otherwise(part(2))
    power = part(3).cast("int")
    digits = F.concat(part(1), frac)
    large = F.when(F.length(frac) <= power, F.concat(digits, F.repeat(F.lit("0"), power - F.length(frac)))).otherwise(
        F.concat(F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, F.length(digits)))
    )
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    sign = F.when(F.startswith(text, F.lit("-")), "-").otherwise("")
    spelled = F.concat(sign, F.when(power >= 0, large).otherwise(small))
    bare = F.when(F.endswith(text, F.lit(".0")), F.substring(text, F.lit(1), F.length(text) - 2)).otherwise(text)
    return F.when(F.contains(text, F.lit("E")), spelled).otherwise(bare)


def cell_text(df: DataFrame, column: str) -> Column:
    """Trimmed text of a cell, '' for null."""
    c = F.col(column)
    dtype = data_type(df, column)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.coalesce(plain_number(c), F.lit(""))
    if isinstance(dtype, (T.IntegralType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.coalesce(c.cast("string"), F.lit(""))  # no white space to strip
    return stripped(c.cast("string"))


def folded_cell(df: DataFrame, column: str) -> Column:
    return F.lower(cell_text(df, column))


def non_empty(df: DataFrame, column: str) -> Column:
    """Typed columns stay a plain null test, which reaches the Parquet scan."""
    if is_text(df, column):
        return stripped(F.col(column)) != ""
    return F.col(column).isNotNull()


def number_text(text: Column) -> Column:
    return F.replace(F.nullif(stripped(text), F.lit("")), F.lit(","), F.lit("."))


def strict_number(df: DataFrame, column: str) -> Column:
    """Aggregates use this: text that is no number raises."""
    if is_text(df, column):
        return number_text(F.col(column)).cast("double")
    return F.col(column).cast("double")


def tolerant_number(df: DataFrame, column: str) -> Column:
    """Filters and profiles use this: text that is no number becomes null."""
    if is_text(df, column):
        return number_text(F.col(column)).try_cast("double")
    if isinstance(data_type(df, column), (T.NumericType,)):
        return F.col(column).cast("double")
    return F.lit(None).cast("double")


def tolerant_timestamp(df: DataFrame, column: str) -> Column:
    """A time from a typed column or date-shaped text; anything else is null."""
    dtype = data_type(df, column)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.col(column).cast("timestamp_ntz")
    text = F.trim(F.col(column).cast("string"))
    return F.when(text.rlike(DATE_PATTERN), text.try_cast("timestamp_ntz"))


def cents(value: Column, scale: int = 2) -> Column:
    """Money as an exact decimal, so a sum does not depend on the order of addition."""
    return value.cast(f"decimal(18,{scale})")


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def folded_words(text: Column) -> Column:
    """Lower case, runs of anything but letters and digits become one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
