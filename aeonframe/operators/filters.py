"""The payload filter algebra: a tree of conditions on tagged properties, compiled to one column.

Logic is two-valued: a condition on a missing property is false (but for ``exists``), and ``not`` of it true. Equality is
of tag and value. Ranges compare integers (of either sign tag) with integers, decimals with decimals, digit for digit
whatever their precision, and strings with strings; else they are false.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

DEPTH, NODES = 32, 4096
_NUMBERS = ("integer", "unsigned", "decimal")


@dataclass(frozen=True)
class Value:
    type: str
    value: object

    def text(self) -> str | None:
        if self.type == "null":
            return None
        return str(self.value).lower() if self.type == "bool" else str(self.value)


def value_of(x: object) -> Value:
    if isinstance(x, Value):
        return x
    if x is None:
        return Value("null", None)
    if isinstance(x, bool):
        return Value("bool", x)
    if isinstance(x, int):
        return Value("unsigned" if x >= 0 else "integer", x)
    if isinstance(x, Decimal):
        return Value("decimal", x)
    if isinstance(x, str):
        return Value("string", x)
    raise TypeError(f"no property value: {x!r}")


class Filter:
    def column(self, properties: str = "properties") -> Column:
        raise NotImplementedError

    def walk(self, depth: int = 1) -> Iterable[tuple[int, Filter]]:
        yield depth, self
        for c in getattr(self, "children", ()):
            yield from c.walk(depth + 1)

    def names(self) -> list[str]:
        return sorted({f.name for _, f in self.walk() if hasattr(f, "name")})

    def validate(self) -> Filter:
        seen = list(self.walk())
        if max(d for d, _ in seen) > DEPTH:
            raise ValueError(f"a filter is nested at most {DEPTH} deep")
        if len(seen) > NODES:
            raise ValueError(f"a filter has at most {NODES} nodes")
        for _, f in seen:
            f.check()
        return self

    def check(self) -> None:
        pass


def _get(properties: str, name: str) -> Column:
    return F.element_at(F.col(properties), F.lit(name))


def _same(found: Column, value: Value) -> Column:
    return F.coalesce((found["type"] == value.type) & found["value"].eqNullSafe(F.lit(value.text())), F.lit(False))


@dataclass(frozen=True)
class Equals(Filter):
    name: str
    value: object

    def column(self, properties: str = "properties") -> Column:
        return _same(_get(properties, self.name), value_of(self.value))


@dataclass(frozen=True)
class NotEquals(Filter):
    name: str
    value: object

    def column(self, properties: str = "properties") -> Column:
        return F.map_contains_key(properties, self.name) & ~_same(_get(properties, self.name), value_of(self.value))


@dataclass(frozen=True)
class In(Filter):
    name: str
    values: tuple

    def column(self, properties: str = "properties") -> Column:
        out = F.lit(False)
        for v in self.values:
            out = out | _same(_get(properties, self.name), value_of(v))
        return out

    def check(self) -> None:
        if not self.values:
            raise ValueError("an empty list matches nothing")


@dataclass(frozen=True)
class Exists(Filter):
    name: str
    present: bool = True

    def column(self, properties: str = "properties") -> Column:
        return F.map_contains_key(properties, self.name) == self.present


@dataclass(frozen=True)
class Range(Filter):
    name: str
    gt: object = None
    gte: object = None
    lt: object = None
    lte: object = None

    def _bounds(self) -> list[tuple[str, Value]]:
        return [(k, value_of(v)) for k, v in (("gt", self.gt), ("gte", self.gte), ("lt", self.lt), ("lte", self.lte)) if v is not None]

    def check(self) -> None:
        bounds = dict(self._bounds())
        if not bounds:
            raise ValueError("a range needs a bound")
        if {"gt", "gte"} <= set(bounds) or {"lt", "lte"} <= set(bounds):
            raise ValueError("one bound at each end")
        if len({v.type in _NUMBERS for v in bounds.values()}) > 1 or any(v.type in ("null", "bool") for v in bounds.values()):
            raise ValueError("bounds are numbers, or strings")

    def column(self, properties: str = "properties") -> Column:
        found, out = _get(properties, self.name), F.lit(True)
        for k, v in self._bounds():
            if v.type == "decimal":
                order = F.when(found["type"] == "decimal", decimal_order(found["value"], str(v.value)))
            elif v.type in _NUMBERS:
                left, right = found["value"].try_cast("decimal(38,0)"), F.lit(Decimal(v.value)).cast("decimal(38,0)")
                order = F.when(found["type"].isin("integer", "unsigned"), F.when(left > right, 1).when(left < right, -1).when(left == right, 0))
            else:
                left, right = found["value"], F.lit(v.text())
                order = F.when(found["type"] == v.type, F.when(left > right, 1).when(left < right, -1).otherwise(0))
            test = {"gt": order > 0, "gte": order >= 0, "lt": order < 0, "lte": order <= 0}[k]
            out = out & F.coalesce(test, F.lit(False))
        return out


_DECIMAL = r"^([+-]?)(?=[.]?[0-9])([0-9]*)(?:[.]([0-9]*))?(?:[eE]([+-]?[0-9]{1,7}))?$"


def decimal_order(text: Column, bound: str) -> Column:
    """-1, 0 or 1 as decimal text lies under, at or over a bound, exactly; null where the text is no decimal.

    A decimal is a sign, the place of its first digit that isn't zero, and the digits from there without zeros at the
    end, which compare in this order (digits as text).
    """
    if not re.match(_DECIMAL, bound):
        raise ValueError(f"no decimal: {bound}")
    sign, whole, part, power = re.match(_DECIMAL, bound).groups()
    digits = (whole + (part or "")).lstrip("0")
    place = len(whole) - (len(whole + (part or "")) - len(digits)) + int(power or 0)
    b_digits, b_sign = digits.rstrip("0"), (0 if not digits else -1 if sign == "-" else 1)

    group = lambda k: F.regexp_extract(text, _DECIMAL, k)
    every = F.concat(group(2), group(3))
    bare = F.regexp_replace(every, "^0+", "")
    own_place = F.length(group(2)) - (F.length(every) - F.length(bare)) + F.coalesce(group(4).try_cast("int"), F.lit(0))
    own_digits = F.regexp_replace(bare, "0+$", "")
    own_sign = F.when(bare == "", 0).when(group(1) == "-", -1).otherwise(1)
    size = F.when(own_place > place, 1).when(own_place < place, -1).when(own_digits > b_digits, 1).when(own_digits < b_digits, -1).otherwise(0)
    order = F.when(own_sign > b_sign, 1).when(own_sign < b_sign, -1).when(own_sign == 0, 0).otherwise(size * b_sign)
    return F.when(text.rlike(_DECIMAL), order)


@dataclass(frozen=True)
class All(Filter):
    children: tuple

    def column(self, properties: str = "properties") -> Column:
        out = F.lit(True)
        for c in self.children:
            out = out & c.column(properties)
        return out

    def check(self) -> None:
        if not self.children:
            raise ValueError("no conditions")


@dataclass(frozen=True)
class Any(Filter):
    children: tuple

    def column(self, properties: str = "properties") -> Column:
        out = F.lit(False)
        for c in self.children:
            out = out | c.column(properties)
        return out

    def check(self) -> None:
        if not self.children:
            raise ValueError("no conditions")


class Not(Filter):
    def __init__(self, child: Filter):
        self.children = (child,)

    def column(self, properties: str = "properties") -> Column:
        return ~F.coalesce(self.children[0].column(properties), F.lit(False))


def decimal_compare(a: str, b: str) -> int:
    """Of decimals of any precision: -1, 0 or 1."""
    x, y = Decimal(a), Decimal(b)
    return (x > y) - (x < y)


def decimal_compare_column(a: Column, b: Column) -> Column:
    """decimal_compare for columns whose digits exceed DECIMAL(38)."""
    import pandas as pd

    def compare(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if u is None or v is None else decimal_compare(u, v) for u, v in zip(x, y)], dtype="Int32")

    compare.__annotations__ = {"x": pd.Series, "y": pd.Series, "return": pd.Series}  # annotations are text in this module
    return F.pandas_udf(compare, "int")(a, b)
