"""The logical algebra of queries: patterns, expressions and solution modifiers."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..terms import Const


@dataclass(frozen=True)
class Var:
    name: str


# ---- property paths


@dataclass(frozen=True)
class Link:
    iri: str


@dataclass(frozen=True)
class Inverse:
    path: object


@dataclass(frozen=True)
class Seq:
    left: object
    right: object


@dataclass(frozen=True)
class Alt:
    left: object
    right: object


@dataclass(frozen=True)
class Repeat:
    """low 0 or 1; many: without an upper bound, else at most once."""

    path: object
    low: int
    many: bool


@dataclass(frozen=True)
class Negated:
    forward: tuple[str, ...]
    backward: tuple[str, ...]


@dataclass(frozen=True)
class Triple:
    """s and o are Var or Const; p is a Var or a path."""

    s: object
    p: object
    o: object


# ---- expressions


@dataclass(frozen=True)
class Call:
    """A built-in, an operator or a function IRI, in upper case unless an IRI."""

    name: str
    args: tuple


@dataclass(frozen=True)
class Exists:
    pattern: object
    negated: bool = False


@dataclass(frozen=True)
class Aggregate:
    name: str
    arg: object  # None: *
    distinct: bool = False
    separator: str = " "


# ---- patterns


@dataclass
class Unit:
    """One solution without bindings."""


@dataclass
class Bgp:
    triples: list[Triple]


@dataclass
class Join:
    left: object
    right: object


@dataclass
class LeftJoin:
    left: object
    right: object
    condition: object = None


@dataclass
class Filter:
    child: object
    condition: object


@dataclass
class Union:
    left: object
    right: object


@dataclass
class Minus:
    left: object
    right: object


@dataclass
class Extend:
    child: object
    name: str
    expression: object


@dataclass
class Values:
    names: list[str]
    rows: list[tuple[Const | None, ...]]


@dataclass
class Labels:
    """The label service over child: explicit (variable, property, target) or, without any, implicit targets."""

    child: object
    languages: list[str]
    explicit: list[tuple[str, str, str]] = field(default_factory=list)


@dataclass
class Group:
    """Aggregates (name, Aggregate) by keys (name, expression)."""

    child: object
    keys: list[tuple[str, object]]
    aggregates: list[tuple[str, Aggregate]]


@dataclass
class Project:
    child: object
    names: list[str] | None  # None: all visible variables


@dataclass
class Distinct:
    child: object


@dataclass
class Reduced:
    child: object


@dataclass
class OrderBy:
    child: object
    keys: list[tuple[object, bool]]  # (expression, descending)


@dataclass
class Slice:
    child: object
    offset: int
    limit: int | None


@dataclass
class Query:
    form: str  # SELECT or ASK
    plan: object


def variables(node: object) -> set[str]:
    """Names of all variables that occur in an expression, pattern or path."""
    if isinstance(node, Var):
        return {node.name}
    out: set[str] = set()
    if isinstance(node, (list, tuple)):
        for x in node:
            out |= variables(x)
    elif hasattr(node, "__dataclass_fields__") and not isinstance(node, Const):
        for name in node.__dataclass_fields__:
            value = getattr(node, name)
            if name in ("name", "names") and not isinstance(node, (Call, Aggregate, Var)):
                out |= {value} if isinstance(value, str) else set(value or ())
            elif not isinstance(value, str):
                out |= variables(value)
    return out
