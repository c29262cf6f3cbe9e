"""SQL expressions put together as text: array functions nest deeply, and a session takes one text faster than thousands of
column objects. Names and meanings are those of ``pyspark.sql.functions``; ``put`` adds expressions to a table."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_names = count()


class Sql:
    """The text of an expression."""

    def __init__(self, text: str, name: str | None = None):
        self.text, self.name = text, name

    def __str__(self) -> str:
        return self.text

    def __getitem__(self, key) -> Sql:
        return Sql(f"{self.text}.{key}") if isinstance(key, str) else Sql(f"{self.text}[{of(key)}]")

    def alias(self, name: str) -> Sql:
        return Sql(self.text, name)

    def cast(self, kind: str) -> Sql:
        return Sql(f"CAST({self.text} AS {kind})")

    def isNull(self) -> Sql:
        return Sql(f"({self.text} IS NULL)")

    def isNotNull(self) -> Sql:
        return Sql(f"({self.text} IS NOT NULL)")

    def isin(self, *values) -> Sql:
        return Sql(f"({self.text} IN ({', '.join(map(of, values))}))")

    def __invert__(self) -> Sql:
        return Sql(f"(NOT {self.text})")

    def __neg__(self) -> Sql:
        return Sql(f"(- {self.text})")

    def when(self, condition, value) -> Sql:
        return Sql(f"{self.text[:-4]} WHEN {of(condition)} THEN {of(value)} END")

    def otherwise(self, value) -> Sql:
        return Sql(f"{self.text[:-4]} ELSE {of(value)} END")

    __hash__ = None


def of(value) -> str:
    """The text of an expression or a constant."""
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return f"{value!r}D"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return str(value)


def _infix(sign: str) -> tuple[Callable, Callable]:
    return (lambda a, b: Sql(f"({of(a)} {sign} {of(b)})")), (lambda a, b: Sql(f"({of(b)} {sign} {of(a)})"))


for _name, _sign in (("add", "+"), ("sub", "-"), ("mul", "*"), ("truediv", "/"), ("mod", "%"), ("and", "AND"), ("or", "OR")):
    _ahead, _back = _infix(_sign)
    setattr(Sql, f"__{_name}__", _ahead)
    setattr(Sql, f"__r{_name}__", _back)
for _name, _sign in (("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">="), ("eq", "="), ("ne", "<>")):
    setattr(Sql, f"__{_name}__", _infix(_sign)[0])


def col(name: str) -> Sql:
    return Sql(name)


def lit(value) -> Sql:
    return Sql("NULL" if value is None else of(value))


def expr(text: str) -> Sql:
    return Sql(f"({text})")


def when(condition, value) -> Sql:
    return Sql(f"CASE WHEN {of(condition)} THEN {of(value)} END")


def struct(*fields) -> Sql:
    return Sql("named_struct(" + ", ".join(f"'{f.name or f.text.rsplit('.', 1)[-1]}', {f}" for f in map(_column, fields)) + ")")


def _column(value) -> Sql:
    return Sql(value) if isinstance(value, str) else value


def _lambda(body: Callable, most: int = 2) -> str:
    given = [p for p in inspect.signature(body).parameters.values() if p.default is p.empty][:most]
    names = [f"v{next(_names)}" for _ in given]
    head = names[0] if len(names) == 1 else f"({', '.join(names)})"
    return f"{head} -> {of(body(*map(Sql, names)))}"


def transform(rows, body: Callable) -> Sql:
    return Sql(f"transform({rows}, {_lambda(body)})")


def filter(rows, body: Callable) -> Sql:  # noqa: A001
    return Sql(f"filter({rows}, {_lambda(body)})")


def aggregate(rows, zero, merge: Callable) -> Sql:
    return Sql(f"aggregate({rows}, {of(zero)}, {_lambda(merge)})")


def _function(name: str) -> Callable:
    return lambda *args: Sql(f"{name}({', '.join(str(_column(a)) if isinstance(a, str) else of(a) for a in args)})")


array, size, get, slice, coalesce, sort_array, flatten, sequence, greatest, least = map(_function, "array size get slice coalesce sort_array flatten sequence greatest least".split())  # noqa: A001
sqrt, pow, abs, acos, asin, cos, tan, radians, degrees, floor, ceil, round = map(_function, "sqrt pow abs acos asin cos tan radians degrees floor ceil round".split())  # noqa: A001
try_divide, array_min, array_max, element_at, array_distinct, array_position, concat, reverse, explode, array_sort, count_if, inline = map(_function, "try_divide array_min array_max element_at array_distinct array_position concat reverse explode array_sort count_if inline".split())


def format_string(pattern: str, *args) -> Sql:
    return Sql(f"format_string('{pattern}', {', '.join(str(_column(a)) if isinstance(a, str) else of(a) for a in args)})")


def named(columns: list[str | Sql]) -> list[Column]:
    """Names and named expressions, for ``select``."""
    return [F.col(c) if isinstance(c, str) else F.expr(c.text).alias(c.name) for c in columns]


def put(rows: DataFrame, columns: dict[str, Sql]) -> DataFrame:
    """``rows`` with these columns."""
    return rows.withColumns({n: c if isinstance(c, Column) else F.expr(of(c)) for n, c in columns.items()})
