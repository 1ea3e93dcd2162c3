"""Structured metadata filters compiled to Columns, and the capability gate.

A filter is a conjunction over keys. A value is either plain (equality; on an array column any element may be equal) or a
mapping whose keys all begin with ``$``. A comparison of different types is false, a missing value equals nothing but null.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engram.errors import unsupported

OPERATORS = ("$exists", "$eq", "$ne", "$in", "$nin", "$gt", "$gte", "$lt", "$lte", "$prefix", "$contains", "$all")
_FALSE = F.lit


def _kind(value) -> str:
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, (int, float)):
        return "num"
    if isinstance(value, str):
        return "str"
    return "null" if value is None else "other"


def _type_kind(t: T.DataType) -> str:
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, T.NumericType):
        return "num"
    if isinstance(t, (T.StringType, T.TimestampType, T.DateType)):
        return "str"
    return "array" if isinstance(t, T.ArrayType) else "other"


def _same(col: Column, kind: str, value) -> Column:
    """Strict equality; values of another type than the column's are never equal."""
    if value is None:
        return col.isNull()
    if isinstance(value, (list, tuple)):
        return F.coalesce(col == F.array(*map(F.lit, value)), F.lit(False)) if kind == "array" else F.lit(False)
    if _kind(value) != kind:
        return F.lit(False)
    return F.coalesce(col == F.lit(value), F.lit(False))


def _holds(col: Column, element: T.DataType, value) -> Column:
    if value is None:
        return F.coalesce(F.exists(col, lambda x: x.isNull()), F.lit(False))
    if _kind(value) != _type_kind(element):
        return F.lit(False)
    return F.coalesce(F.array_contains(col, value), F.lit(False))


def validate(where: Mapping) -> None:
    for key, condition in where.items():
        if isinstance(condition, Mapping) and any(str(op).startswith("$") for op in condition):
            for op in condition:
                if op not in OPERATORS:
                    raise unsupported(f"unknown operator {op} for key {key}", operator=op, key=key)


def compile_filter(where: Mapping | None, schema: T.StructType) -> Column:
    """Boolean Column of a filter over the columns of ``schema``; a key that is no column is a missing value."""
    where = where or {}
    validate(where)
    result = F.lit(True)
    for key, condition in where.items():
        known = key in schema.names
        dtype = schema[key].dataType if known else T.NullType()
        col = F.col(f"`{key}`") if known else F.lit(None)
        kind = _type_kind(dtype)
        element = dtype.elementType if kind == "array" else None

        def any_element(value, col=col, kind=kind, element=element) -> Column:
            if kind == "array" and not isinstance(value, (list, tuple)):
                return _holds(col, element, value)
            return _same(col, kind, value)

        def one(op: str, value, col=col, kind=kind, element=element, any_element=any_element) -> Column:
            if op == "$exists":
                return col.isNotNull() if value else col.isNull()
            if op == "$eq":
                return _same(col, kind, value)
            if op == "$ne":
                return ~_same(col, kind, value)
            if op in ("$in", "$nin"):
                found = F.lit(False)
                for v in value:
                    found = found | any_element(v)
                return found if op == "$in" else ~found
            if op in ("$gt", "$gte", "$lt", "$lte"):
                if _kind(value) != kind or kind not in ("num", "str"):
                    return F.lit(False)
                test = {"$gt": col > value, "$gte": col >= value, "$lt": col < value, "$lte": col <= value}[op]
                return F.coalesce(test, F.lit(False))
            if op == "$prefix":
                return F.coalesce(col.startswith(value), F.lit(False)) if kind == "str" else F.lit(False)
            if op == "$contains":
                return _holds(col, element, value) if kind == "array" else F.lit(False)
            held = col.isNotNull() if kind == "array" else F.lit(False)  # $all
            for v in value:
                held = held & _holds(col, element, v) if kind == "array" else held
            return held

        if isinstance(condition, Mapping) and condition and all(str(op).startswith("$") for op in condition):
            for op, value in condition.items():
                result = result & one(op, value)
        else:
            result = result & any_element(condition)
    return result


def capability_gate(required: Column, held: int | None) -> Column:
    """Rows whose required bits are all held; a row without a requirement is visible to everyone."""
    if held is None:
        return F.coalesce(required == 0, F.lit(True))
    return F.coalesce(required.bitwiseAND(F.lit(held)) == required, F.lit(True))


def equality_terms(where: Mapping) -> dict[str, Sequence]:
    """The part of a filter that names the values a key may have."""
    terms: dict[str, Sequence] = {}
    for key, condition in where.items():
        if isinstance(condition, Mapping):
            if "$eq" in condition:
                terms[key] = [condition["$eq"]]
            elif "$in" in condition:
                terms[key] = list(condition["$in"])
        elif _kind(condition) in ("num", "str", "bool"):
            terms[key] = [condition]
    return terms
