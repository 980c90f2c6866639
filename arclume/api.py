"""Traversals, builders, statements and the registry of queries."""

from __future__ import annotations

import re
import threading
import time
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from arclume.functions import cel, math
from arclume.plans import ast, cypher, rewrite, sexpr
from arclume.plans.lower import Lowerer, compile_query
from arclume.sources.snapshot import GraphSnapshot

_FUNCTIONS: dict[str, Callable[..., Column]] = {}


def register_function(name: str, f: Callable[..., Column]) -> None:
    """Add a function of columns to the expression language."""
    _FUNCTIONS[name] = f


@dataclass(frozen=True)
class Traversal:
    """An immutable pipeline. Steps return a new one; nothing runs before a terminal."""

    snap: GraphSnapshot | None
    query: ast.Query

    def _then(self, step: ast.Step) -> Traversal:
        return Traversal(self.snap, self.query.then(step))

    # steps
    def out(self, relation: str, where: str | None = None, reducer: str = "OR") -> Traversal:
        return self._then(ast.Walk(relation, "out", where, None, reducer))

    def in_(self, relation: str, where: str | None = None, reducer: str = "OR") -> Traversal:
        return self._then(ast.Walk(relation, "in", where, None, reducer))

    def walk(self, relation: str) -> Traversal:
        return self._then(ast.Walk(relation, "auto"))

    walk_edge = walk_target = out

    def out_with_state(self, relation: str, project: str, where: str | None = None) -> Traversal:
        return self._then(ast.Walk(relation, "out", where, project))

    def in_with_state(self, relation: str, project: str, where: str | None = None) -> Traversal:
        return self._then(ast.Walk(relation, "in", where, project))

    def out2(self, first: str, second: str) -> Traversal:
        return self._then(ast.Walk2(first, second))

    def out_between(self, relation: str, low: int, high: int, direction: str = "out") -> Traversal:
        return self._then(ast.VarWalk(relation, low, high, direction))

    def out_attribute(self, relation: str, attribute: str, op: str, value: float) -> Traversal:
        return self.out(relation, f"edge.{attribute} {op} {value!r}")

    def filter(self, where: str) -> Traversal:
        return self._then(ast.Filter(where))

    def filter_attribute(self, attribute: str, op: str, value: float) -> Traversal:
        return self.filter(f"node.{attribute} {op} {value!r}")

    def label(self, name: str, relation: str | None = None) -> Traversal:
        return self._then(ast.Label(name, relation))

    def project(self, project: str) -> Traversal:
        return self._then(ast.Project(project))

    def attribute(self, name: str) -> Traversal:
        return self._then(ast.Attribute(name))

    def edge_values(self, relation: str, node_attribute: str, op: str, edge_attribute: str) -> Traversal:
        return self._then(ast.EdgeValues(relation, node_attribute, op, edge_attribute))

    def repeat(self, n: int, step: Callable[[Traversal], Traversal], emit: str = "last") -> Traversal:
        return self._then(ast.Repeat(n, self._inner(step), emit))

    def repeat_until_stable(self, step: Callable[[Traversal], Traversal], include_seed: bool = True) -> Traversal:
        return self._then(ast.Stable(self._inner(step), include_seed))

    def _inner(self, step: Callable[[Traversal], Traversal]) -> tuple[ast.Step, ...]:
        return step(Traversal(self.snap, ast.Query(self.query.domain, ast.Seed("ids")))).query.steps

    def union(self, other: Traversal) -> Traversal:
        return self._then(ast.Combine("union", other.query))

    def intersect(self, other: Traversal) -> Traversal:
        return self._then(ast.Combine("intersect", other.query))

    def difference(self, other: Traversal) -> Traversal:
        return self._then(ast.Combine("difference", other.query))

    def with_param(self, name: str, value: Any) -> Traversal:  # noqa: ANN401
        return Traversal(self.snap, self.query.bind(**{name: value}))

    def rebac_check(self, member_of: str, permission: str, revoked: Traversal | None = None) -> Traversal:
        """What the seeds may reach: through all groups they are in, by ``permission``, without what is revoked."""
        t = self.repeat_until_stable(lambda s: s.out(member_of)).out(permission)
        return t.difference(revoked) if revoked else t

    # terminals
    def df(self, **params: Any) -> DataFrame:  # noqa: ANN401
        if self.snap is None:
            raise ValueError("the query has no snapshot; use run(query, snapshot)")
        return compile_query(self.query, self.snap, params, _FUNCTIONS)

    def collect(self, form: str = "set") -> DataFrame:
        return self._then(ast.Collect(form)).df()

    def reduce(self, kind: str, of: str = "value", positive: bool = False) -> DataFrame:
        """One value of the frontier: ``of`` is a state column (default the loaded attribute) or an expression over each node. A max or min moves
        inside of monotonic functions (``positive``: of logarithms and roots too, whose arguments are promised to be above 0)."""
        if of.isidentifier():
            return self._then(ast.Reduce(kind, of)).df()
        outside, inner, tree = rewrite.hoist(kind, cel.parse(of), positive)
        step = ast.Project(f"state.value:ANY = {cel.text(tree)}")
        df = self._then(step)._then(ast.Reduce(inner, "value")).df()
        col, kind_of = df[inner], cel.kind_of(df.schema[inner].dataType)
        for name in reversed(outside):
            col, kind_of = (-col, kind_of) if name == "-" else math.call(name, [(col, kind_of)], cel.ExpressionError)
        return df.select(*[c for c in df.columns if c != inner], col.alias(kind))

    def with_attributes(self, *names: str) -> DataFrame:
        """The frontier with attributes of its nodes, joined at the end so that walks carry ids only."""
        low = Lowerer(self.snap, dict(self.query.params), _FUNCTIONS)
        f = low.frontier(self.query)
        return f.df.join(low.node_columns(f.domain, set(names)).withColumnRenamed("id", "_id"), f.df["id"] == F.col("_id"), "left").select(*f.df.columns, *names)

    def count(self) -> int:
        return self.collect("count").first()[0]

    def exists(self) -> bool:
        return self.collect("exists").first()[0]

    def to_list(self) -> list[int]:
        return [r["id"] for r in self.collect("list").toLocalIterator()]

    def to_set(self) -> set[int]:
        return set(self.to_list())

    def to_key_list(self) -> list[str]:
        return [r["key"] for r in self.collect("keys").orderBy("id").toLocalIterator()]

    def to_key_set(self) -> set[str]:
        return set(self.to_key_list())

    def explain(self, physical: bool = False) -> str:
        """The plan as an S-expression, which parses back; ``physical``: the plan that runs."""
        if not physical:
            return sexpr.show(self.query)
        df = self.df()
        return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@dataclass(frozen=True)
class DomainView:
    snap: GraphSnapshot
    name: str

    def node_count(self) -> int:
        return self.snap.domain_of(self.name).count()

    def all(self) -> Traversal:
        return Traversal(self.snap, ast.Query(self.name, ast.Seed("all")))

    def from_(self, *ids: int | Iterable[int] | DataFrame) -> Traversal:
        """Start at ids, an iterable of ids or a DataFrame with ``id`` (and ``seed``: then each seed has its own frontier)."""
        if len(ids) == 1 and isinstance(ids[0], DataFrame):
            return Traversal(self.snap, ast.Query(self.name, ast.Seed("frame", ids[0])))
        flat: list[int] = []
        for i in ids:
            flat += [i] if isinstance(i, int) else list(i)
        return Traversal(self.snap, ast.Query(self.name, ast.Seed("ids", tuple(flat))))

    def from_param(self, name: str) -> Traversal:
        return Traversal(self.snap, ast.Query(self.name, ast.Seed("param", name)))

    def from_key(self, *keys: str) -> Traversal:
        return Traversal(self.snap, ast.Query(self.name, ast.Seed("keys", keys)))

    from_keys = from_key

    def batch(self, ids: DataFrame, column: str = "id") -> Traversal:
        """All ids as seeds of their own, in one plan."""
        return self.from_(ids.select(ids[column].alias("seed"), ids[column].alias("id")))

    def to_dense_id(self, key: str) -> int:
        """The id of ``key``, -1 if there is none."""
        keys = self.snap.spark.createDataFrame([(key,)], "key string")
        found = self.snap.key_to_id(self.name, keys, strict=False).first()["id"]
        return -1 if found is None else found

    def to_key(self, id: int) -> str:  # noqa: A002
        return self.snap.id_to_key(self.name, self.snap.spark.createDataFrame([(id,)], "id long")).first()["key"]


class RowReader:
    """A cursor over the rows of a result. Columns go by number or name; ``alias`` is the name under which the column id is listed."""

    def __init__(self, df: DataFrame, alias: str = "id") -> None:
        self.rows: Iterator[Row] = df.toLocalIterator()
        self.names = [alias if c == "id" else c for c in df.columns]
        self.places = {**{n: i for i, n in enumerate(self.names)}, **{n: i for i, n in enumerate(df.columns)}}
        self.row = None

    def next(self) -> bool:
        self.row = next(self.rows, None)
        return self.row is not None

    def value(self, column: int | str = 0) -> Any:  # noqa: ANN401
        if self.row is None:
            raise LookupError("no row; next() comes first")
        if isinstance(column, int):
            return self.row[column]
        if column not in self.places:
            raise KeyError(f"no column {column}; there are {', '.join(self.names)}")
        return self.row[self.places[column]]

    def get_long(self, column: int | str = 0) -> int | None:
        v = self.value(column)
        return None if v is None else int(v)

    get_node_id = get_long

    def get_double(self, column: int | str = 0) -> float | None:
        v = self.value(column)
        return None if v is None else float(v)

    def get_string(self, column: int | str = 0) -> str | None:
        v = self.value(column)
        return None if v is None else str(v)

    def is_null(self, column: int | str = 0) -> bool:
        return self.value(column) is None


ARROW = re.compile(r"\s*(?:(?:FROM\s+)?(\w+)\s+WHERE\s+(\w+)\s*(?:=|IN)\s*([$@]\w+|\d+|'[^']*')|FROM\s+(\w+)|[$@](\w+))\s*", re.I)


def parse_statement(text: str) -> ast.Query:
    """A statement: openCypher, an S-expression, or ``FROM Domain WHERE id = $x -> out('rel') -> in('rel') -> filter('...')``."""
    body = text.strip()
    if body.startswith("("):
        return sexpr.parse(body)
    if re.match(r"(?is)(//[^\n]*\n\s*)*match\b", body):
        return cypher.compile_cypher(body)
    head, *segments = re.split(r"->", body)
    m = ARROW.fullmatch(head)
    if not m:
        raise ValueError(f"no statement: {head.strip()!r}")
    value = m[3] or (f"${m[5]}" if m[5] else None)
    if value is None:
        seed = ast.Seed("all")
    elif value[0] in "$@":
        seed = ast.Seed("param", value[1:])
    else:
        seed = ast.Seed("keys", (value[1:-1],)) if value[0] == "'" else ast.Seed("ids", (int(value),))
    query = ast.Query(m[1] or m[4], seed)
    for s in segments:
        part = re.fullmatch(r"\s*(?:(out|in|walk|filter|count|repeat)\s*\(\s*(?:'([^']*)'|\"([^\"]*)\")?(?:\s*,\s*(?:'([^']*)'|\"([^\"]*)\"))?\s*\)|(\w+))\s*", s)
        if not part:
            raise ValueError(f"no segment: {s.strip()!r}")
        verb, arg, extra = part[1], part[2] or part[3], part[4] or part[5]
        if part[6]:
            query = query.then(ast.Walk(part[6]))
        elif verb in ("out", "in", "walk"):
            query = query.then(ast.Walk(arg, {"walk": "auto"}.get(verb, verb), extra))
        elif verb == "filter":
            query = query.then(ast.Filter(arg))
        else:
            query = query.then(ast.Collect("count"))
    return query


@dataclass
class Statement:
    """A prepared query with bindings."""

    snap: GraphSnapshot
    query: ast.Query
    bindings: dict[str, Any] = field(default_factory=dict)

    def bind(self, name: str, value: Any) -> Statement:  # noqa: ANN401
        self.bindings[name.lstrip("$@")] = value
        return self

    bind_node = bind_nodes = bind_long = bind_double = bind_string = bind_bitset = bind

    def clear_bindings(self) -> Statement:
        self.bindings.clear()
        return self

    def df(self) -> DataFrame:
        return compile_query(self.query, self.snap, self.bindings, _FUNCTIONS)

    def execute(self) -> RowReader:
        df = self.df()
        return RowReader(df.orderBy("id") if "id" in df.columns else df, f"{(self.query.domain or 'node').lower()}_id")

    def execute_scalar(self) -> int:
        df = self.df()
        return df.first()[0] if df.columns != ["id"] else df.distinct().count()

    count = execute_scalar

    def close(self) -> None:
        self.clear_bindings()


def prepare(snap: GraphSnapshot, text: str) -> Statement:
    return Statement(snap, parse_statement(text))


def run(query: ast.Query, snap: GraphSnapshot, **params: Any) -> DataFrame:  # noqa: ANN401
    return compile_query(query, snap, params, _FUNCTIONS)


class TypedBuilder:
    """A builder with a method per relation and attribute of a snapshot: ``walk_<relation>()``, ``back_<relation>()``, ``filter_<attribute>(op, value)``."""

    def __init__(self, traversal: Traversal, domain: str) -> None:
        self.traversal, self.domain = traversal, domain

    def __getattr__(self, name: str) -> Callable[..., TypedBuilder]:
        snap: GraphSnapshot = self.traversal.snap
        verb, _, what = name.partition("_")
        if verb in ("walk", "back"):
            rel = next((r for r in snap.relations.values() if r.name.lower() == what.lower() and (r.source if verb == "walk" else r.target) == self.domain), None)
            if rel:
                return lambda where=None: TypedBuilder(self.traversal.out(rel.name, where) if verb == "walk" else self.traversal.in_(rel.name, where), rel.target if verb == "walk" else rel.source)
        if verb == "filter" and what in snap.domain_of(self.domain).nodes.columns:
            return lambda op, value: TypedBuilder(self.traversal.filter(f"node.{what} {op} " + (f"'{value}'" if isinstance(value, str) else repr(value))), self.domain)
        raise AttributeError(f"{self.domain} has no {name}")

    def __dir__(self) -> list[str]:
        snap: GraphSnapshot = self.traversal.snap
        return [*(f"walk_{r.name}" for r in snap.relations.values() if r.source == self.domain), *(f"back_{r.name}" for r in snap.relations.values() if r.target == self.domain), *(f"filter_{c}" for c in snap.domain_of(self.domain).nodes.columns), "traversal"]


@dataclass
class Metrics:
    """Counters, and latencies of compilations and of runs."""

    counts: Counter = field(default_factory=Counter)
    buckets: tuple[float, ...] = (0.001, 0.01, 0.1, 1, 10, 60, 600)
    latency: dict[str, Counter] = field(default_factory=lambda: {"compile": Counter(), "query": Counter()})
    seconds: Counter = field(default_factory=Counter)
    lock: threading.Lock = field(default_factory=threading.Lock)

    def count(self, name: str) -> None:
        with self.lock:
            self.counts[name] += 1

    def observe(self, what: str, seconds: float) -> None:
        with self.lock:
            self.latency[what][next((b for b in self.buckets if seconds <= b), float("inf"))] += 1
            self.seconds[what] += seconds

    def exposition(self) -> str:
        """The counters and histograms as Prometheus text."""
        with self.lock:
            lines = []
            for k, v in sorted(self.counts.items()):
                lines += [f"# TYPE arclume_{k}_total counter", f"arclume_{k}_total {v}"]
            for what, latency in self.latency.items():
                name, total = f"arclume_{what}_seconds", 0
                lines.append(f"# TYPE {name} histogram")
                for b in (*self.buckets, float("inf")):
                    total += latency[b]
                    lines.append(f'{name}_bucket{{le="{"+Inf" if b == float("inf") else b}"}} {total}')
                lines += [f"{name}_sum {self.seconds[what]:.6f}", f"{name}_count {total}"]
        return "\n".join(lines) + "\n"


def _texts(value: Any) -> Iterator[str]:  # noqa: ANN401
    """All texts in a query."""
    if isinstance(value, str):
        yield value
    elif is_dataclass(value):
        for f in fields(value):
            yield from _texts(getattr(value, f.name))
    elif isinstance(value, (list, tuple)):
        for v in value:
            yield from _texts(v)


def parameters(query: ast.Query) -> set[str]:
    """Names of the parameters that ``query`` may ask for."""
    found = {n for t in _texts(query.steps) for n in re.findall(r"[@$]([A-Za-z_]\w*)", t)}
    return found | ({str(query.seed.values)} if query.seed.kind == "param" else set())


class QueryRegistry:
    """Named queries, snapshots by version, and plans kept per query, parameters and snapshot.

    ``swap`` lets a snapshot in only if every registered query compiles against it; from then on all queries run on it, and DataFrames built
    before keep reading the old one. ``drain`` waits until no query that entered an old version is left.
    """

    def __init__(self, snap: GraphSnapshot) -> None:
        self.snap, self.queries, self.plans, self.metrics = snap, {}, {}, Metrics()
        self.serial = 0  # of the snapshot: versions may be equal
        self.entered: dict[int, int] = {0: snap.version}
        self.active: Counter = Counter()
        self.lock = threading.Condition()

    def register(self, name: str, query: ast.Query | str | Traversal) -> ast.Query:
        """Set the query of ``name``; plans of an earlier one go."""
        query = parse_statement(query) if isinstance(query, str) else query.query if isinstance(query, Traversal) else query
        with self.lock:
            self.queries[name] = query
            self.plans = {k: v for k, v in self.plans.items() if k[0] != name}
        return query

    def validate(self, snap: GraphSnapshot, params: Mapping[str, Mapping[str, Any]] | None = None) -> dict[str, str]:
        """The queries that ``snap`` can't answer, with the reasons. Every query is compiled; parameters that ``params`` doesn't give are tried as a
        number, a text and a list."""
        failed = {}
        for name, q in dict(self.queries).items():
            given = dict((params or {}).get(name) or {})
            missing = parameters(q) - set(given) - set(dict(q.params))
            own = q.seed.kind == "param" and str(q.seed.values) in missing
            tries = [{**dict.fromkeys(missing, v), **({str(q.seed.values): 0} if own else {}), **given} for v in ((0, "", [0]) if missing else (0,))]
            reasons = []
            for values in tries:
                try:
                    for r in q.relations():
                        snap.relation(r)
                    compile_query(q, snap, values, _FUNCTIONS)
                    break
                except Exception as e:  # noqa: BLE001
                    reasons.append(str(e))
            else:
                failed[name] = reasons[0]
        return failed

    def swap(self, snap: GraphSnapshot, params: Mapping[str, Mapping[str, Any]] | None = None) -> None:
        if failed := self.validate(snap, params):
            raise ValueError(f"snapshot {snap.version} is kept out: {failed}")
        with self.lock:
            self.snap, self.serial, self.plans = snap, self.serial + 1, {}
            self.entered[self.serial] = snap.version
        self.metrics.count("swaps")

    def _df(self, name: str, snap: GraphSnapshot, serial: int, params: Mapping[str, Any]) -> DataFrame:
        key = (name, repr(sorted(params.items())), serial)
        with self.lock:
            query, kept = self.queries[name], self.plans.get(key)
        if kept is not None:
            self.metrics.count("cache_hits")
            return kept
        self.metrics.count("cache_misses")
        began = time.perf_counter()
        df = compile_query(query, snap, params, _FUNCTIONS)
        self.metrics.observe("compile", time.perf_counter() - began)
        with self.lock:
            if serial == self.serial and self.queries.get(name) is query:
                self.plans[key] = df
        return df

    def df(self, name: str, **params: Any) -> DataFrame:  # noqa: ANN401
        with self.lock:
            snap, serial = self.snap, self.serial
        return self._df(name, snap, serial, params)

    def __call__(self, name: str, action: Callable[[DataFrame], Any], **params: Any) -> Any:  # noqa: ANN401
        """Run ``action`` on the query's DataFrame, counted as active on its snapshot and timed."""
        with self.lock:
            snap, serial = self.snap, self.serial
            self.active[serial] += 1
        began = time.perf_counter()
        try:
            return action(self._df(name, snap, serial, params))
        finally:
            self.metrics.count("queries")
            self.metrics.observe("query", time.perf_counter() - began)
            with self.lock:
                self.active[serial] -= 1
                self.lock.notify_all()

    def drain(self, version: int, timeout: float | None = None) -> bool:
        """Wait until no query runs on snapshots of ``version`` but the present one, if others had it, else on any."""
        with self.lock:
            old = [s for s, v in self.entered.items() if v == version and s != self.serial] or [s for s, v in self.entered.items() if v == version]
            return self.lock.wait_for(lambda: not any(self.active[s] for s in old), timeout)

    def health(self) -> dict[str, Any]:
        return {"version": self.snap.version, "relations": len(self.snap.relations), "queries": len(self.queries), "active": sum(self.active.values())}
