"""Queries as values: a seed and the steps that it goes through. All front-ends build these; one lowering reads them."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any, Union

#: Kinds of seeds: ids, keys, all, frame (a DataFrame with ``id``, and ``seed`` for batches), param (the name of one).
SEEDS = ("ids", "keys", "all", "frame", "param")
REDUCTIONS = ("sum", "max", "min", "argmax", "argmin", "avg", "first", "count")
FORMS = ("set", "list", "keys", "count", "exists", "first", "map")


@dataclass(frozen=True)
class Seed:
    kind: str
    values: Any = ()


@dataclass(frozen=True)
class Walk:
    """Along ``relation``; ``where`` is an expression over each edge, ``project`` the state that goes along."""

    relation: str
    direction: str = "out"  # out, in or auto
    where: str | None = None
    project: str | None = None
    reducer: str = "OR"  # OR: some source leads there; AND: every one does


@dataclass(frozen=True)
class Walk2:
    """Two walks without the set in between."""

    first: str
    second: str


@dataclass(frozen=True)
class VarWalk:
    """``low`` to ``high`` walks, all ends together."""

    relation: str
    low: int
    high: int
    direction: str = "out"


@dataclass(frozen=True)
class Filter:
    where: str


@dataclass(frozen=True)
class Label:
    """A predicate registered under a name, on nodes or on the edges of ``relation``."""

    name: str
    relation: str | None = None


@dataclass(frozen=True)
class Project:
    project: str


@dataclass(frozen=True)
class Attribute:
    """The attribute as ``value`` of every node of the frontier; nodes without one keep a null."""

    name: str


@dataclass(frozen=True)
class EdgeValues:
    """Per edge from the frontier: node attribute ``op`` edge attribute, as (id of the target, value)."""

    relation: str
    node_attribute: str
    op: str
    edge_attribute: str


@dataclass(frozen=True)
class Repeat:
    n: int
    steps: tuple[Step, ...]
    emit: str = "last"  # last: after exactly n; all: after 1 to n


@dataclass(frozen=True)
class Stable:
    """Until no step finds a new node."""

    steps: tuple[Step, ...]
    include_seed: bool = True


@dataclass(frozen=True)
class Combine:
    op: str  # union, intersect, difference
    other: Query


@dataclass(frozen=True)
class Reduce:
    kind: str
    of: str = "value"


@dataclass(frozen=True)
class Collect:
    form: str = "set"


Step = Union[Walk, Walk2, VarWalk, Filter, Label, Project, Attribute, EdgeValues, Repeat, Stable, Combine, Reduce, Collect]


@dataclass(frozen=True)
class Query:
    domain: str | None
    seed: Seed
    steps: tuple[Step, ...] = ()
    params: tuple[tuple[str, Any], ...] = field(default=())

    def then(self, step: Step) -> Query:
        return replace(self, steps=(*self.steps, step))

    def bind(self, **params: Any) -> Query:
        return replace(self, params=tuple({**dict(self.params), **params}.items()))

    def relations(self) -> set[str]:
        """Names of the relations that the query walks."""

        def of(steps: tuple[Step, ...]) -> set[str]:
            out: set[str] = set()
            for s in steps:
                if isinstance(s, (Walk, VarWalk, EdgeValues)):
                    out.add(s.relation)
                elif isinstance(s, Walk2):
                    out |= {s.first, s.second}
                elif isinstance(s, (Repeat, Stable)):
                    out |= of(s.steps)
                elif isinstance(s, Combine):
                    out |= s.other.relations()
            return out

        return of(self.steps)
