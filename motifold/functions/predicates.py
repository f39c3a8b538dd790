"""Property predicates: operators, conditions, their plain evaluation, and their compilation to columns.

A property of a node can have a string, a number, or an array of either. Tests are two-valued: a missing value makes an atom false, and
its negation true. A scalar test on an array holds if any element passes. IN means that the value, or every element of a non-empty array,
is in the list.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from enum import Enum
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from motifold.functions import boolexpr as bx


class Op(Enum):
    """Fixed names of the operators."""

    EQ = "="
    NE = "!="
    GT = ">"
    GE = ">="
    LT = "<"
    LE = "<="
    IN = "IN"
    NOT_IN = "NOT IN"
    IS_NULL = "IS NULL"
    IS_NOT_NULL = "IS NOT NULL"
    CONTAINS = "CONTAINS"
    NOT_CONTAINS = "NOT CONTAINS"
    STARTS_WITH = "STARTS WITH"
    ENDS_WITH = "ENDS WITH"
    SOME_IN = "SOME IN"
    IS_EMPTY = "IS EMPTY"
    IS_NOT_EMPTY = "IS NOT EMPTY"

    @property
    def compares(self) -> bool:
        return self in _COMPARE


_COMPARE: dict[Op, Callable[[Any, Any], Any]] = {Op.EQ: operator.eq, Op.NE: operator.ne, Op.GT: operator.gt, Op.GE: operator.ge, Op.LT: operator.lt, Op.LE: operator.le}
_TEXT = (Op.CONTAINS, Op.STARTS_WITH, Op.ENDS_WITH)


class Kind(Enum):
    STRING = "string"
    INTEGER = "integer"
    DOUBLE = "double"
    STRINGS = "strings"
    INTEGERS = "integers"
    DOUBLES = "doubles"

    @property
    def is_array(self) -> bool:
        return self.value.endswith("s")

    @property
    def is_text(self) -> bool:
        return self.value.startswith("string")


def kind_of(value: Any) -> Kind:
    if isinstance(value, list | tuple):
        kinds = {kind_of(x) for x in value}
        return Kind.STRINGS if Kind.STRING in kinds else Kind.DOUBLES if Kind.DOUBLE in kinds else Kind.INTEGERS
    if isinstance(value, str):
        return Kind.STRING
    if isinstance(value, float):
        return Kind.DOUBLE
    if isinstance(value, int) and not isinstance(value, bool):
        return Kind.INTEGER
    raise TypeError(f"no property value: {value!r}")


@dataclass(frozen=True)
class Property:
    """A test of one property. The value is a scalar, a tuple for list operators, or None for presence tests."""

    name: str
    op: Op
    value: Any = None
    kind: Kind | None = None

    def type_of(self) -> Kind | None:
        return self.kind or (None if self.value is None else kind_of(self.value))

    def evaluate(self, stored: Any) -> bool:
        """The test on a plain stored value (None, string, number or list of them)."""
        if self.op is Op.IS_NULL or self.op is Op.IS_NOT_NULL:
            return (stored is None) == (self.op is Op.IS_NULL)
        if stored is None:
            return False
        items = list(stored) if isinstance(stored, list | tuple) else [stored]
        if self.op in (Op.IS_EMPTY, Op.IS_NOT_EMPTY):
            return (not items) == (self.op is Op.IS_EMPTY)
        if isinstance(self.value, tuple):
            want = [x for x in self.value if isinstance(x, str) == self.type_of().is_text]
            match self.op:
                case Op.IN:
                    return bool(items) and all(x in want for x in items)
                case Op.NOT_IN:
                    return bool(items) and not all(x in want for x in items)
                case Op.SOME_IN:
                    return any(x in want for x in items)
                case Op.CONTAINS:
                    return all(x in items for x in want)
                case Op.NOT_CONTAINS:
                    return not all(x in items for x in want)
                case Op.EQ:
                    return items == list(self.value)
                case Op.NE:
                    return items != list(self.value)
            raise ValueError(f"{self.op.value} takes no list")
        same = [x for x in items if isinstance(x, str) == isinstance(self.value, str)]
        if self.op is Op.NOT_CONTAINS:
            return not any(self.value in x if isinstance(x, str) else x == self.value for x in same)
        return any(self._one(x) for x in same)

    def _one(self, x: Any) -> bool:
        match self.op:
            case Op.CONTAINS:
                return self.value in x
            case Op.STARTS_WITH:
                return x.startswith(self.value)
            case Op.ENDS_WITH:
                return x.endswith(self.value)
        return bool(_COMPARE[self.op](x, self.value))


def is_in(name: str, *values: Any) -> Property:
    return Property(name, Op.IN, values)


def not_in(name: str, *values: Any) -> Property:
    return Property(name, Op.NOT_IN, values)


def some_in(name: str, *values: Any) -> Property:
    return Property(name, Op.SOME_IN, values)


def contains(name: str, value: Any) -> Property:
    return Property(name, Op.CONTAINS, tuple(value) if isinstance(value, list) else value)


def is_null(name: str) -> Property:
    return Property(name, Op.IS_NULL)


def is_not_null(name: str) -> Property:
    return Property(name, Op.IS_NOT_NULL)


def is_empty(name: str) -> Property:
    return Property(name, Op.IS_EMPTY)


def is_not_empty(name: str) -> Property:
    return Property(name, Op.IS_NOT_EMPTY)


def compare(name: str, op: str | Op, value: Any) -> Property:
    return Property(name, Op(op), value)


@dataclass(frozen=True)
class LiteralCondition:
    variable: str
    property: Property


@dataclass(frozen=True)
class VariableCondition:
    left: str
    left_property: str
    op: Op
    right: str
    right_property: str


Condition = LiteralCondition | VariableCondition

_PREDICATE = re.compile(r"\s*(?:(?P<var>\w+)\.)?(?P<name>\w+)\s*(?P<op>" + "|".join(sorted((re.escape(o.value).replace(r"\ ", r"\s+") for o in Op), key=len, reverse=True)) + r"|<>)\s*(?P<value>.*?)\s*$", re.I | re.S)


def _value(text: str) -> Any:
    """A list in brackets, an integer, a double, a quoted string, or else the text itself."""
    if text.startswith("[") and text.endswith("]"):
        inner = text[1:-1].strip()
        return tuple(_value(x.strip()) for x in re.findall(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|[^,]+", inner))
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text[1:-1] if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"" else text


def parse_predicate(text: str, kinds: dict[str, Kind] | None = None) -> LiteralCondition:
    """`n.name OP value`. The value has the declared kind of the property, or the first that it can be read as."""
    m = _PREDICATE.match(text)
    if not m:
        raise ValueError(f"no predicate: {text!r}")
    op = Op(re.sub(r"\s+", " ", m["op"]).upper().replace("<>", "!="))
    if op in (Op.IS_NULL, Op.IS_NOT_NULL, Op.IS_EMPTY, Op.IS_NOT_EMPTY):
        if m["value"]:
            raise ValueError(f"{op.value} takes no value")
        return LiteralCondition(m["var"] or "", Property(m["name"], op))
    value = _value(m["value"])
    kind = (kinds or {}).get(m["name"])
    if kind is not None:
        to = str if kind.is_text else int if "integer" in kind.value else float
        try:
            value = tuple(map(to, value if isinstance(value, tuple) else (value,))) if kind.is_array else to(value)
        except (TypeError, ValueError) as error:
            raise ValueError(f"{m['value']!r} is no {kind.value}") from error
    return LiteralCondition(m["var"] or "", Property(m["name"], op, value, kind))


# compilation


@dataclass(frozen=True)
class Stored:
    """Where a property's values are: columns for a string, a number, and arrays of them; None where it can't have such a value."""

    string: Column | None = None
    number: Column | None = None
    strings: Column | None = None
    numbers: Column | None = None

    def columns(self) -> list[Column]:
        return [c for c in (self.string, self.number, self.strings, self.numbers) if c is not None]

    def of(self, text: bool) -> tuple[Column | None, Column | None]:
        return (self.string, self.strings) if text else (self.number, self.numbers)


def _or_false(*xs: Column | None) -> Column:
    """The first that is not null, else false."""
    return F.coalesce(*[x for x in xs if x is not None], F.lit(False))


def _array(scalar: Column | None, array: Column | None) -> Column | None:
    one = None if scalar is None else F.when(scalar.isNotNull(), F.array(scalar))
    return one if array is None else array if one is None else F.coalesce(array, one)


def compile_property(p: Property, stored: Stored) -> Column:
    """A column that is true or false, never null."""
    if p.op in (Op.IS_NULL, Op.IS_NOT_NULL):
        absent = reduce(operator.and_, [c.isNull() for c in stored.columns()], F.lit(True))
        return absent if p.op is Op.IS_NULL else ~absent
    if p.op in (Op.IS_EMPTY, Op.IS_NOT_EMPTY):
        sizes = [F.size(a) for a in (stored.strings, stored.numbers) if a is not None]
        scalars = [F.when(c.isNotNull(), F.lit(1)) for c in (stored.string, stored.number) if c is not None]
        known = [F.when(s >= 0, s) for s in sizes] + scalars
        return _or_false((F.coalesce(*known) == 0) if p.op is Op.IS_EMPTY else (F.coalesce(*known) > 0)) if known else F.lit(False)
    text = p.type_of().is_text
    scalar, array = stored.of(text)
    if isinstance(p.value, tuple):
        whole = _array(scalar, array)
        values = [x for x in p.value if isinstance(x, str) == text]
        listed = F.array(*[F.lit(x if text else float(x)) for x in values]).cast("array<string>" if text else "array<double>")
        if whole is None:
            return F.lit(False)
        if not text:
            whole = whole.cast("array<double>")
        inside = F.forall(whole, lambda x: x.isin([x_ if text else float(x_) for x_ in values]) if values else F.lit(False))
        match p.op:
            case Op.IN:
                return _or_false((F.size(whole) > 0) & inside)
            case Op.NOT_IN:
                return _or_false((F.size(whole) > 0) & ~inside)
            case Op.SOME_IN:
                return _or_false(F.exists(whole, lambda x: x.isin([x_ if text else float(x_) for x_ in values]) if values else F.lit(False)))
            case Op.CONTAINS:
                return _or_false(F.size(F.array_except(listed, whole)) == 0)
            case Op.NOT_CONTAINS:
                return _or_false(F.size(F.array_except(listed, whole)) > 0)
            case Op.EQ:
                return _or_false(whole == listed)
            case Op.NE:
                return _or_false(whole != listed)
        raise ValueError(f"{p.op.value} takes no list")
    literal = F.lit(p.value if text else float(p.value))

    def one(x: Column) -> Column:
        match p.op:
            case Op.CONTAINS | Op.NOT_CONTAINS:
                return F.contains(x, literal) if text else x == literal
            case Op.STARTS_WITH:
                return F.startswith(x, literal)
            case Op.ENDS_WITH:
                return F.endswith(x, literal)
        return _COMPARE[p.op](x, literal)

    found = [None if scalar is None else one(scalar), None if array is None else F.exists(array, one)]
    if p.op is Op.NOT_CONTAINS:
        present = reduce(operator.or_, [c.isNotNull() for c in (scalar, array) if c is not None], F.lit(False))
        return present & ~_or_false(*found)
    return _or_false(*found)


def compile_comparison(op: Op, left: Stored, right: Stored) -> Column:
    """Numbers are compared if both have one, else strings if both have one, else the atom is false. Arrays are not compared."""
    compare_ = _COMPARE[op]
    pairs = [(a, b) for a, b in ((left.number, right.number), (left.string, right.string)) if a is not None and b is not None]
    return _or_false(*[F.when(a.isNotNull() & b.isNotNull(), compare_(a, b)) for a, b in pairs])


def compile_where(e: bx.Expr, atom: Callable[[str], Column]) -> Column:
    match e:
        case bx.Const(v):
            return F.lit(v)
        case bx.Var(name):
            return atom(name)
        case bx.Not(x):
            return ~compile_where(x, atom)
        case bx.And(a, b):
            return compile_where(a, atom) & compile_where(b, atom)
        case bx.Or(a, b):
            return compile_where(a, atom) | compile_where(b, atom)
    raise TypeError(e)


def hoistable(e: bx.Expr, conditions: dict[str, Condition], cap: int = 512) -> dict[str, list[Property]]:
    """Tests of one variable that every way to satisfy the expression requires, by variable. IS NULL is never among them."""
    try:
        ways = bx.clauses(e, cap)
    except bx.TooManyClauses:
        return {}
    always = set.intersection(*map(set, ways)) if ways else set()
    out: dict[str, list[Property]] = {}
    for name, positive in sorted(always):
        c = conditions[name]
        if positive and isinstance(c, LiteralCondition) and c.property.op is not Op.IS_NULL:
            out.setdefault(c.variable, []).append(c.property)
    return out


def residual(e: bx.Expr, conditions: dict[str, Condition], hoisted: dict[str, list[Property]]) -> bx.Expr:
    """What is left to test once the hoisted tests are known to hold."""
    done = {name for name, c in conditions.items() if isinstance(c, LiteralCondition) and c.property in hoisted.get(c.variable, ())}

    def walk(x: bx.Expr) -> bx.Expr:
        match x:
            case bx.Var(n):
                return bx.TRUE if n in done else x
            case bx.Not(y):
                return bx.Not(walk(y))
            case bx.And(a, b):
                return bx.And(walk(a), walk(b))
            case bx.Or(a, b):
                return bx.Or(walk(a), walk(b))
        return x

    return bx.simplify(walk(e))


def conjuncts(properties: Sequence[Property], stored: Callable[[str], Stored]) -> Column:
    return reduce(operator.and_, [compile_property(p, stored(p.name)) for p in properties], F.lit(True))
