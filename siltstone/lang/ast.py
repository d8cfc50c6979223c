"""Nodes of a boolean query and their text form."""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Node:
    pass


@dataclass(frozen=True)
class Lit(Node):
    value: object  # str, int, float, bool or None

    def __str__(self) -> str:
        if isinstance(self.value, str):
            return "'" + re.sub(r"\\(?=[\\'\"]|$)", r"\\\\", self.value).replace("'", "\\'") + "'"
        return "null" if self.value is None else str(self.value).lower() if isinstance(self.value, bool) else str(self.value)


@dataclass(frozen=True)
class Ident(Node):
    name: str

    def __str__(self) -> str:
        return self.name


@dataclass(frozen=True)
class Cmp(Node):
    """Comparison: == != < <= > >= =~ !~, or = for a marker."""

    op: str
    left: Node
    right: Node

    def __str__(self) -> str:
        return f"{self.left} {self.op} {self.right}"


@dataclass(frozen=True)
class Arith(Node):
    op: str
    left: Node
    right: Node

    def __str__(self) -> str:
        return f"({self.left} {self.op} {self.right})"


@dataclass(frozen=True)
class And(Node):
    parts: tuple[Node, ...]

    def __str__(self) -> str:
        return " && ".join(f"({p})" if isinstance(p, (Or, And)) else str(p) for p in self.parts)


@dataclass(frozen=True)
class Or(Node):
    parts: tuple[Node, ...]

    def __str__(self) -> str:
        return " || ".join(f"({p})" if isinstance(p, (Or, And)) else str(p) for p in self.parts)


@dataclass(frozen=True)
class Not(Node):
    part: Node

    def __str__(self) -> str:
        return f"!({self.part})"


@dataclass(frozen=True)
class Call(Node):
    space: str
    name: str
    args: tuple[Node, ...]

    def __str__(self) -> str:
        return f"{self.space}:{self.name}({', '.join(map(str, self.args))})"


@dataclass(frozen=True)
class Method(Node):
    target: Node
    name: str
    args: tuple[Node, ...]

    def __str__(self) -> str:
        return f"{self.target}.{self.name}({', '.join(map(str, self.args))})"


@dataclass(frozen=True)
class Marker(Node):
    """A part whose handling is prescribed: Bounded, Delayed, Eval, Drop, Lenient, Strict, Hole, List, Term, Value."""

    name: str
    part: Node

    def __str__(self) -> str:
        return f"((_{self.name}_ = true) && ({self.part}))"


def conjunction(parts: list[Node]) -> Node | None:
    """And of the parts, flattened; None for none."""
    flat: list[Node] = []
    for p in parts:
        flat += p.parts if isinstance(p, And) else (p,)
    return None if not flat else flat[0] if len(flat) == 1 else And(tuple(flat))


def disjunction(parts: list[Node]) -> Node | None:
    flat: list[Node] = []
    for p in parts:
        flat += p.parts if isinstance(p, Or) else (p,)
    return None if not flat else flat[0] if len(flat) == 1 else Or(tuple(flat))


def fields(node: Node | None) -> set[str]:
    """Names of all identifiers."""
    if isinstance(node, Ident):
        return {node.name}
    out: set[str] = set()
    for v in vars(node).values() if node is not None else ():
        for x in v if isinstance(v, tuple) else (v,):
            if isinstance(x, Node):
                out |= fields(x)
    return out
