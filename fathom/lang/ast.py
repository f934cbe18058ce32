"""The syntax tree."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


class Enum(str):
    """A bare word in the place of a value."""

    __slots__ = ()


@dataclass(frozen=True)
class Var:
    name: str


# ---------------------------------------------------------------- expressions


@dataclass(frozen=True)
class Lit:
    value: Any


@dataclass(frozen=True)
class Path:
    parts: tuple[str, ...]


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


@dataclass(frozen=True)
class Binary:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Unary:
    op: str
    operand: Any


@dataclass(frozen=True)
class Ternary:
    test: Any
    yes: Any
    no: Any


@dataclass(frozen=True)
class Template:
    text: str


@dataclass(frozen=True)
class Sql:
    text: str


# ---------------------------------------------------------------- selections and operations


@dataclass
class Directive:
    name: str
    args: dict[str, Any]


@dataclass
class Field:
    name: str
    alias: str | None = None
    args: dict[str, Any] = field(default_factory=dict)
    directives: list[Directive] = field(default_factory=list)
    selections: list | None = None
    expr: Any = None
    place: tuple[int, int] = (0, 0)

    @property
    def out(self) -> str:
        return self.alias or self.name


@dataclass
class Spread:
    name: str
    directives: list[Directive]


@dataclass
class Inline:
    on: str
    selections: list
    directives: list[Directive]


@dataclass
class Fragment:
    name: str
    on: str
    selections: list


@dataclass
class VarDef:
    name: str
    type: str
    required: bool
    default: Any = None
    has_default: bool = False


@dataclass
class Operation:
    #: query, mutation or subscription.
    kind: str
    name: str | None
    variables: list[VarDef]
    directives: list[Directive]
    selections: list


@dataclass
class FieldDef:
    name: str
    type: str
    required: bool = False
    directives: list[Directive] = field(default_factory=list)
    default: Any = None
    has_default: bool = False


@dataclass
class Define:
    collection: str
    fields: list[FieldDef]
    if_not_exists: bool = False


@dataclass
class Alter:
    collection: str
    #: ("add", FieldDef), ("drop", name), ("rename", old, new), ("modify", FieldDef)
    actions: list[tuple]


@dataclass
class Drop:
    collection: str
    if_exists: bool = False


@dataclass
class DataMigration:
    collection: str
    #: (field, expression, filter or None)
    sets: list[tuple[str, Any, dict | None]]


@dataclass
class Schema:
    definitions: list


@dataclass
class Migration:
    #: (version, actions)
    steps: list[tuple[str, list]]


@dataclass
class Introspection:
    fields: list[str]


@dataclass
class Handler:
    name: str
    on: str
    action: Field


@dataclass
class Document:
    operations: list
    fragments: dict[str, Fragment]
