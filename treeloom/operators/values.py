"""Typed values: conversions with two modes, struct building with defaults.

SAFE converts without loss only; ALL converts what it can and else gives the zero value.  Nothing raises.  A value is
a pair of columns: its kind (null, bool, int, double, string, cardinality, array, map) and its text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"\A-?[0-9]+(\.[0-9]*)?([eE][+-]?[0-9]+)?\z"
HEXADECIMAL = r"\A-?0x[0-9A-Fa-f]+\z"


def kind_of(text: Column) -> Column:
    """Kind of a literal."""
    return (
        F.when(text.isNull() | (text == "null"), "null")
        .when(text.isin("true", "false"), "bool")
        .when(text.rlike(r"\A-?[0-9]+\z") | text.rlike(HEXADECIMAL), "int")
        .when(text.rlike(NUMBER), "double")
        .when(text.rlike(r"(?s)\A\{.*\}\z"), "cardinality")
        .when(text.rlike(r"(?s)\A\[.*=.*\]\z"), "map")
        .when(text.rlike(r"(?s)\A\[.*\]\z"), "array")
        .otherwise("string")
    )


def number(text: Column) -> Column:
    """Value of a decimal, exponent or hexadecimal literal as double; null if it is none."""
    sign = F.when(text.startswith("-"), -1.0).otherwise(1.0)
    hexadecimal = sign * F.conv(F.regexp_extract(text, r"0x([0-9A-Fa-f]+)\z", 1), 16, 10).try_cast("double")
    return F.when(text.rlike(HEXADECIMAL), hexadecimal).when(text.rlike(NUMBER), text.try_cast("double"))


def to_int(kind: Column, text: Column, mode: str = "SAFE") -> Column:
    exact = F.when((kind == "int") & number(text).between(-(2**31), 2**31 - 1), number(text).cast("int"))
    if mode == "SAFE":
        return exact
    truncated = F.when(number(text).between(-(2**31), 2**31 - 1), number(text).cast("int"))
    flag = F.when(kind == "bool", (text == "true").cast("int"))
    return F.coalesce(exact, flag, F.when(kind.isin("double", "string"), truncated), F.lit(0))


def to_double(kind: Column, text: Column, mode: str = "SAFE") -> Column:
    exact = F.when(kind.isin("int", "double"), number(text))
    if mode == "SAFE":
        return exact
    flag = F.when(kind == "bool", (text == "true").cast("double"))
    return F.coalesce(exact, flag, F.when(kind == "string", number(text)), F.lit(0.0))


def to_bool(kind: Column, text: Column, mode: str = "SAFE") -> Column:
    exact = F.when(kind == "bool", text == "true")
    if mode == "SAFE":
        return exact
    return F.when(kind == "null", False).when(kind == "bool", text == "true").when(kind.isin("int", "double"), number(text) != 0).otherwise(True)


def to_string(kind: Column, text: Column, mode: str = "SAFE") -> Column:
    """Null, bool, int and double convert in both modes (the reader warns); collections in ALL mode only."""
    plain = F.when(kind == "null", "null").when(kind.isin("bool", "int", "double", "string"), text)
    return plain if mode == "SAFE" else F.coalesce(plain, text)


def build_struct(given: Column, attributes: list[tuple[str, str, str | None]]) -> Column:
    """struct(value, errors) of a map of texts: keys are names or #i; attributes: (name, type, default or None).

    A missing attribute takes its default; without one, or with a text of the wrong type, the zero value and an error.
    """
    zero = {"int": F.lit(0), "double": F.lit(0.0), "bool": F.lit(False), "string": F.lit("")}
    convert = {"int": to_int, "double": to_double, "bool": to_bool, "string": to_string}
    fields, errors, known = [], [], []
    for i, (name, kind, default) in enumerate(attributes):
        raw = F.coalesce(F.try_element_at(given, F.lit(name)), F.try_element_at(given, F.lit(f"#{i}")))
        known += [name, f"#{i}"]
        text = F.coalesce(raw, F.lit(default)) if default is not None else raw
        value = F.when(text.isNotNull(), convert[kind](kind_of(text), text))
        fields.append(F.coalesce(value, zero[kind]).alias(name))
        errors.append(F.when(text.isNull(), F.lit(f"missing {name}")).when(value.isNull(), F.lit(f"{name} is no {kind}")))
    unknown = F.transform(F.array_sort(F.array_except(F.map_keys(given), F.array(*map(F.lit, known)))), lambda k: F.concat(F.lit("unknown "), k))
    listed = F.concat(F.filter(F.array(*errors), lambda e: e.isNotNull()), F.coalesce(unknown, F.array().cast("array<string>")))
    return F.struct(F.struct(*fields).alias("value"), listed.alias("errors"))
