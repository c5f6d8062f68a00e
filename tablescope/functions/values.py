"""Missing values, coercion and canonical text shared by every operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Texts that read as a number. Checked before the cast: Java also accepts "1d" and "2f",
# and a failing cast costs an exception per row.
_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
_INFINITE = r"^\s*[+-]?(inf|infinity|Infinity|INF)\s*$"
_FLOAT_TYPES = (T.FloatType, T.DoubleType)
_FLOAT_NAMES = ("double", "float")


def is_numeric(data_type: T.DataType) -> bool:
    """Numeric columns include booleans."""
    return isinstance(data_type, (T.NumericType, T.BooleanType))


def column_kinds(df: DataFrame, cols: list[str] | None = None) -> tuple[list[str], list[str]]:
    """(numeric, categorical) column names, in the given order."""
    names = cols or df.columns
    numeric = [c for c in names if is_numeric(df.schema[c].dataType)]
    return numeric, [c for c in names if c not in numeric]


def missing(df: DataFrame, name: str) -> Column:
    """NULL and NaN are one notion of missing."""
    c = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, _FLOAT_TYPES):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN turned into NULL."""
    return F.when(~missing(df, name), F.col(f"`{name}`"))


def _parsed(c: Column, infinite: bool) -> Column:
    """Double value; text only where it reads as a number. ``typeof`` folds away at planning."""
    text = c.cast("string")
    ok = text.rlike(_NUMBER) | text.rlike(_INFINITE) if infinite else text.rlike(_NUMBER)
    return F.when((F.typeof(c) != "string") | ok, c.try_cast("double"))


def to_numeric(c: Column) -> Column:
    """Double value, NULL where the text is no number."""
    parsed = _parsed(c, True)
    return F.when(~F.isnan(parsed), parsed)


def numeric_of(df: DataFrame, name: str) -> Column:
    """``to_numeric`` picked by schema, so numeric columns pay no text check."""
    c = F.col(f"`{name}`")
    data_type = df.schema[name].dataType
    if isinstance(data_type, _FLOAT_TYPES):
        return F.when(~F.isnan(c), c.cast("double"))
    if is_numeric(data_type):
        return c.cast("double")
    return to_numeric(c)


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def num(c: Column) -> Column:
    """Formula number: blank, text and non-finite values count as 0."""
    parsed = _parsed(c, False)
    return F.when(finite(parsed), parsed).otherwise(F.lit(0.0))


def _plain_digits(text: Column) -> Column:
    """``d.dddE+-x`` written out between 1e-6 and 1e21, else as ``d.ddde+x``; other text without a final ``.0``."""
    sign = F.when(text.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    mantissa = F.regexp_replace(F.substring_index(text, "E", 1), r"^-|\.0$", "")
    exponent = F.substring_index(text, "E", -1).try_cast("int")
    digits = F.replace(mantissa, F.lit("."), F.lit(""))
    size = F.length(digits)
    large = F.when(size <= exponent + 1, F.concat(digits, F.repeat(F.lit("0"), exponent + 1 - size))).otherwise(
        F.concat(F.substring(digits, F.lit(1), exponent + 1), F.lit("."), F.substring(digits, exponent + 2, size)))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
    written = F.when(exponent.between(0, 20), large).when(exponent.between(-6, -1), small).otherwise(
        F.concat(mantissa, F.when(exponent > 0, F.lit("e+")).otherwise(F.lit("e")), exponent.cast("string")))
    return F.when(text.contains("E"), F.concat(sign, written)).otherwise(F.regexp_replace(text, r"\.0$", ""))


def canon_str(c: Column) -> Column:
    """Text used for lookup equality: NULL is "", 1.0 reads as "1", numbers in plain digits.

    Plain digits from 1e-6 up to 1e21, with an exponent outside: 12345678.9, 0.0001, 1e+21.
    """
    as_double = c.try_cast("double")
    floating = F.typeof(c).isin(*_FLOAT_NAMES)
    whole = floating & (F.abs(as_double) < F.lit(1e15)) & (F.floor(as_double) == as_double)
    return F.coalesce(
        F.when(whole, as_double.try_cast("bigint").cast("string"))
        .when(floating, _plain_digits(c.cast("string"))).otherwise(c.cast("string")),
        F.lit(""),
    )


def json_safe(df: DataFrame) -> DataFrame:
    """NaN and infinities become NULL in every floating-point column."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, _FLOAT_TYPES):
            c = F.when(finite(c), c).alias(field.name)
        out.append(c)
    return df.select(*out)


def row_key(df: DataFrame, cols: list[str]) -> Column:
    """256-bit key of a row's values: equal rows, equal key; long text is hashed, not shuffled."""
    parts = []
    for name in cols:
        c = F.col(f"`{name}`")
        data_type = df.schema[name].dataType
        if isinstance(data_type, _FLOAT_TYPES):
            c = F.when(~F.isnan(c), c + F.lit(0.0))
        elif isinstance(data_type, (T.ArrayType, T.StructType, T.MapType)):
            c = F.to_json(c) if not isinstance(data_type, T.ArrayType) else F.to_json(F.struct(c))
        text = c.cast("string")
        parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts) if len(parts) > 1 else parts[0], 256)
