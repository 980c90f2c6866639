"""From a query and a snapshot to one DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arclume.functions import cel
from arclume.functions.projection import Projection, parse_projections
from arclume.plans import ast
from arclume.session import Rounds, materialize, reusable
from arclume.sources.snapshot import GraphSnapshot, Relation


@dataclass(frozen=True)
class Frontier:
    """The active nodes of one domain: ``df`` has ``id``, in batches ``seed``, and the state columns. One row per node (and seed)."""

    df: DataFrame
    domain: str | None
    batch: bool = False
    state: tuple[str, ...] = ()

    @property
    def keys(self) -> list[str]:
        return ["seed", "id"] if self.batch else ["id"]


@dataclass
class Lowerer:
    """Lowers steps against ``snap``. ``functions`` extends the functions of expressions."""

    snap: GraphSnapshot
    params: Mapping[str, Any] = field(default_factory=dict)
    functions: Mapping[str, Callable[..., Column]] = field(default_factory=dict)

    # seeds

    def seed(self, query: ast.Query) -> Frontier:
        spark, s = self.snap.spark, query.seed
        domain = query.domain
        if domain and domain.startswith("?"):  # the end of a relation
            end, name = domain[1:].split(":", 1)
            rel = self.snap.relation(name)
            query = replace(query, domain=rel.source if end == "out" else rel.target)
        domain = self.snap.domain_of(query.domain).name if query.domain else None
        values = s.values
        if s.kind == "param":
            name = str(values)
            found = cel.Lowering(lambda *_: (F.lit(None), T.NullType()), self.params).bound(name)
            values = found if isinstance(found, (list, tuple, set, range)) else (found,)
        if s.kind == "frame":
            df: DataFrame = s.values
            batch = "seed" in df.columns
            state = tuple(c for c in df.columns if c not in ("id", "seed"))
            own = df.select(*(["seed"] if batch else []), F.col("id").cast("long").alias("id"), *state)
            return Frontier(own if state else own.distinct(), domain, batch, state)
        if s.kind == "all":
            return Frontier(self.snap.domain_of(query.domain).nodes.select("id"), domain)
        if s.kind == "keys" or s.kind == "param" and any(isinstance(v, str) for v in values):
            keys = spark.createDataFrame([(str(v),) for v in values], "key string")
            return Frontier(self.snap.key_to_id(query.domain, keys).select("id").distinct(), domain)
        ids = sorted({int(v) for v in values})
        # contiguous ids are a range, others a small literal table
        if ids and len(ids) > 1000 and ids[-1] - ids[0] + 1 == len(ids):
            return Frontier(spark.range(ids[0], ids[-1] + 1), domain)
        return Frontier(spark.createDataFrame([(i,) for i in ids], "id long"), domain)

    # expressions

    def lowering(self, resolve: cel.Resolve) -> cel.Lowering:
        return cel.Lowering(resolve, self.params, self.functions)

    def node_columns(self, domain: str | None, wanted: set[str]) -> DataFrame:
        nodes = self.snap.domain_of(domain).nodes if domain else None
        if nodes is None:
            raise cel.ExpressionError("node attributes need a domain")
        lost = [w for w in wanted if w not in nodes.columns]
        if lost:
            raise cel.ExpressionError(f"no attribute {', '.join(sorted(lost))} in {domain}")
        return nodes.select("id", *[c for c in wanted if c != "id"])

    def where_nodes(self, f: Frontier, text: str) -> Frontier:
        """Frontier nodes for which the expression holds; names are node attributes, edges have no say here."""
        tree = cel.parse(text)
        own: set[str] = set()
        for n in cel.names(tree):
            if n.scope in ("node", "src", "dest", "dst") or not n.scope and n.field not in f.state:
                if n.field not in ("id", "_id"):
                    own.add(n.field)
            elif n.scope != "state" and n.scope:
                raise cel.ExpressionError(f"no {n.scope} at a node filter")
        df = f.df
        kinds = {}
        if own:
            nodes = self.node_columns(f.domain, own)
            kinds = {c.name: c.dataType for c in nodes.schema}
            nodes = nodes.select(F.col("id").alias("_id"), *[F.col(c).alias(f"_n_{c}") for c in own])

            def at(scope: str, name: str) -> tuple[Column, T.DataType]:
                if name in ("id", "_id"):
                    return F.col("_id"), T.LongType()
                if scope == "state" or not scope and name in f.state:
                    return F.col(name), f.df.schema[name].dataType
                return F.col(f"_n_{name}"), kinds[name]

            if any(n.scope == "state" or not n.scope and n.field in f.state for n in cel.names(tree)):
                joined = df.join(nodes, F.col("id") == F.col("_id")).filter(self.lowering(at)(tree).col)
                return Frontier(joined.select(*df.columns), f.domain, f.batch, f.state)
            return Frontier(df.join(nodes.filter(self.lowering(at)(tree).col), F.col("id") == F.col("_id"), "left_semi"), f.domain, f.batch, f.state)

        def state(scope: str, name: str) -> tuple[Column, T.DataType]:
            if name in ("id", "_id"):
                return F.col("id"), T.LongType()
            if name not in f.state:
                raise cel.ExpressionError(f"no state {name}")
            return F.col(name), f.df.schema[name].dataType

        return Frontier(df.filter(self.lowering(state)(tree).col), f.domain, f.batch, f.state)

    # walks

    def oriented(self, rel: Relation, direction: str) -> tuple[DataFrame, str, str]:
        """Edges as (_from, _to, _e_attributes) in the direction of the walk, and the domains of both ends."""
        a, b, s, t = ("src", "dst", rel.source, rel.target) if direction != "in" else ("dst", "src", rel.target, rel.source)
        edges = rel.transposed if direction == "in" and rel.transposed is not None else rel.edges
        return edges.select(F.col(a).alias("_from"), F.col(b).alias("_to"), *[F.col(c).alias(f"_e_{c}") for c in rel.attributes()]), s, t

    def enter(self, f: Frontier, source: str, what: str) -> None:
        if f.domain is not None and f.domain != source:
            raise ValueError(f"{what} starts at {source}, the frontier is in {f.domain}")

    def traverse(self, f: Frontier, rel: Relation, direction: str, trees: Sequence[cel.Node], need_state: bool) -> tuple[DataFrame, cel.Resolve, str]:
        """Rows of the traversed edges with all columns that ``trees`` name; frontier columns get _f_, ends' attributes _s_ and _d_."""
        edges, source, target = self.oriented(rel, direction)
        self.enter(f, source, rel.name)
        kinds: dict[str, T.DataType] = {f"_e_{c}": rel.edges.schema[c].dataType for c in rel.attributes()}
        kinds |= {f"_f_{c}": f.df.schema[c].dataType for c in f.state}
        src_nodes: set[str] = set()
        dst_nodes: set[str] = set()
        place: dict[tuple[str, str], str] = {}
        for n in set().union(*map(cel.names, trees)) if trees else set():
            place[n.scope, n.field] = at = self.place(n, f, rel, source, target)
            if at.startswith("_s_"):
                src_nodes.add(n.field)
            elif at.startswith("_d_"):
                dst_nodes.add(n.field)
        front = f.df.select(*([F.col("seed").alias("_seed")] if f.batch else []), F.col("id").alias("_fid"), *[F.col(c).alias(f"_f_{c}") for c in f.state])
        rows = edges.join(front, F.col("_from") == F.col("_fid"), "inner" if need_state or f.batch else "left_semi")
        for end, wanted, domain, mark in (("_from", src_nodes, source, "_s_"), ("_to", dst_nodes, target, "_d_")):
            if wanted:
                nodes = self.node_columns(domain, wanted)
                kinds |= {f"{mark}{c}": nodes.schema[c].dataType for c in wanted}
                rows = rows.join(nodes.select(F.col("id").alias(f"{mark}_key"), *[F.col(c).alias(f"{mark}{c}") for c in wanted]), F.col(end) == F.col(f"{mark}_key"))

        def resolve(scope: str, name: str) -> tuple[Column, T.DataType]:
            at = place[scope, name]
            return F.col(at), kinds.get(at, T.LongType())

        return rows, resolve, target

    def place(self, n: cel.Name, f: Frontier, rel: Relation, source: str, target: str) -> str:
        """The column that a name in an edge expression means."""
        nodes = lambda d: self.snap.domain_of(d).nodes.columns if d in self.snap.domains else []
        if n.field in ("id", "_id") and n.scope in ("", "node", "dest", "dst"):
            return "_to"
        if n.field in ("id", "_id") and n.scope == "src":
            return "_from"
        at = {"edge": [("e", n.field in rel.attributes())], "state": [("f", n.field in f.state)], "src": [("f", n.field in f.state), ("s", n.field in nodes(source))]}.get(n.scope)
        if at is None and n.scope in ("node", "dest", "dst"):
            at = [("d", n.field in nodes(target))]
        if at is None and not n.scope:
            at = [("d", n.field in nodes(target)), ("e", n.field in rel.attributes()), ("f", n.field in f.state)]
            if sum(x for _, x in at) > 1:
                raise cel.ExpressionError(f"{n.field} is in more than one of node, edge and state")
        for mark, there in at or []:
            if there:
                return f"_{mark}_{n.field}"
        raise cel.ExpressionError(f"no {n.scope + '.' if n.scope else ''}{n.field} on {rel.name}")

    def walk(self, f: Frontier, step: ast.Walk) -> Frontier:
        rel = self.snap.relation(step.relation)
        trees = [cel.parse(step.where)] if step.where else []
        projections = parse_projections(step.project) if step.project else ()
        scopes = set().union(*map(cel.names, [*trees, *[p.expr for p in projections]])) if trees or projections else set()
        need_state = bool(projections) or step.reducer == "AND" or any(n.scope == "state" or n.scope in ("", "src") and n.field in f.state for n in scopes)
        rows, resolve, target = self.traverse(f, rel, step.direction, [*trees, *[p.expr for p in projections]], need_state)
        lower = self.lowering(resolve)
        for t in trees:
            rows = rows.filter(lower(t).col)
        keys = [*([F.col("_seed").alias("seed")] if f.batch else []), F.col("_to").alias("id")]
        if projections:
            return Frontier(rows.groupBy(*keys).agg(*self.aggregates(projections, lower, rel)), target, f.batch, tuple(p.field for p in projections))
        if step.reducer == "AND":
            # every node of the frontier (of the seed) leads there
            per = rows.groupBy(*keys).agg(F.countDistinct("_from").alias("_n"))
            if f.batch:
                sizes = f.df.groupBy(F.col("seed").alias("_sd")).agg(F.countDistinct("id").alias("_all"))
                return Frontier(per.join(sizes, F.col("seed") == F.col("_sd")).filter("_n = _all").select("seed", "id"), target, True)
            sizes = f.df.agg(F.countDistinct("id").alias("_all"))
            return Frontier(per.join(F.broadcast(sizes), F.col("_n") == F.col("_all")).select("id"), target)
        if step.reducer != "OR":
            raise ValueError(f"a walk without a projection reduces by OR or AND, not {step.reducer}")
        out = rows.select(*keys)
        unique = rel.multiplicity == "1:1" or rel.multiplicity == ("N:1" if step.direction == "in" else "1:N")
        return Frontier(out if unique else out.distinct(), target, f.batch)

    def aggregates(self, projections: Sequence[Projection], lower: cel.Lowering, rel: Relation) -> list[Column]:
        """One aggregate per projection. ARGMIN and ARGMAX: ties go to the lowest source, then to the lowest payload."""
        exprs = {p.field: lower(p.expr).col for p in projections}
        out = []
        for p in projections:
            x = exprs[p.field]
            if p.reducer == "ARGMIN":
                col = F.min_by(x, F.struct(exprs[p.by], F.col("_from"), x))
            elif p.reducer == "ARGMAX":
                col = F.max_by(x, F.struct(exprs[p.by], -F.col("_from")))
            else:
                col = {"OR": F.bool_or, "AND": F.bool_and, "MIN": F.min, "MAX": F.max, "SUM": F.sum, "AVG": F.avg, "ANY": F.min, "COUNT": lambda _: F.count(F.lit(1))}[p.reducer](x)
            out.append(col.alias(p.field))
        return out

    def project(self, f: Frontier, step: ast.Project) -> Frontier:
        """Set state of the frontier in place: a node has one row, so reducers do nothing but COUNT, which is 1."""
        projections = parse_projections(step.project)
        own = {n.field for p in projections for n in cel.names(p.expr) if n.scope in ("node", "src", "") and n.field not in f.state and n.field not in ("id", "_id")}
        df, kinds = f.df, {}
        if own:
            nodes = self.node_columns(f.domain, own)
            kinds = {c.name: c.dataType for c in nodes.schema}
            df = df.join(nodes.select(F.col("id").alias("_id"), *[F.col(c).alias(f"_n_{c}") for c in own]), F.col("id") == F.col("_id"), "left").drop("_id")

        def resolve(scope: str, name: str) -> tuple[Column, T.DataType]:
            if name in ("id", "_id"):
                return F.col("id"), T.LongType()
            if name in f.state and scope != "node":
                return F.col(name), f.df.schema[name].dataType
            if scope == "state" or name not in kinds:
                raise cel.ExpressionError(f"no {scope or 'name'} {name}")
            return F.col(f"_n_{name}"), kinds[name]

        lower = self.lowering(resolve)
        new = {p.field: F.lit(1).cast("long") if p.reducer == "COUNT" else lower(p.expr).col for p in projections}
        keep = [c for c in f.state if c not in new]
        return Frontier(df.select(*f.keys, *keep, *[c.alias(n) for n, c in new.items()]), f.domain, f.batch, (*keep, *new))

    # loops

    def steps(self, f: Frontier, steps: Sequence[ast.Step]) -> Frontier:
        return reduce(self.step, steps, f)

    def repeat(self, f: Frontier, step: ast.Repeat) -> Frontier:
        if step.n < 0:
            raise ValueError("repeat takes 0 or more")
        seen = []
        for _ in range(step.n):
            f = self.steps(f, step.steps)
            seen.append(f)
        if step.emit == "last" or not seen:
            return f
        return Frontier(reduce(DataFrame.unionByName, [x.df.select(*x.keys) for x in seen]).distinct(), f.domain, f.batch)

    def stable(self, f: Frontier, step: ast.Stable, max_rounds: int = 100_000) -> Frontier:
        """Semi-naive closure: each round goes on from the nodes that the last one found, until it finds none."""
        keys = f.keys
        inner = ast.Query(None, ast.Seed("ids"), tuple(step.steps)).relations()
        for r in [self.snap.relation(n) for n in inner]:
            if (kept := reusable(r.edges, "loop")) is not r.edges:
                self.snap = replace(self.snap, relations={**self.snap.relations, r.name: replace(r, edges=kept)})
        start = materialize(f.df.select(*keys).distinct(), "closure")
        reached = Rounds("closure")
        reached.add(start, start.count())
        new = Frontier(start, f.domain, f.batch)
        for _ in range(max_rounds):
            nxt = self.steps(new, step.steps)
            if nxt.domain != f.domain and f.domain is not None:
                raise ValueError(f"a loop must end in {f.domain}, not in {nxt.domain}")
            fresh = materialize(nxt.df.select(*keys).join(reached.all(), keys, "left_anti").distinct(), "closure")
            if not (size := fresh.count()):
                break
            reached.add(fresh, size)
            new = Frontier(fresh, f.domain, f.batch)
        else:
            raise ValueError(f"not stable after {max_rounds} rounds")
        every = reached.all()
        if not step.include_seed:
            # a seed belongs to it only if some walk leads back to it
            again = self.steps(Frontier(every, f.domain, f.batch), step.steps).df.select(*keys).distinct()
            return Frontier(again, f.domain, f.batch)
        return Frontier(every, f.domain, f.batch)

    # all steps

    def step(self, f: Frontier, step: ast.Step) -> Frontier:
        if isinstance(step, ast.Walk):
            return self.walk(f, step)
        if isinstance(step, ast.Walk2):
            mid = self.snap.relation(step.first)
            edges = mid.edges.select(F.col("src").alias("_a"), F.col("dst").alias("_m"))
            last = self.snap.relation(step.second)
            self.enter(f, mid.source, mid.name)
            if mid.target != last.source:
                raise ValueError(f"{mid.name} ends at {mid.target}, {last.name} starts at {last.source}")
            rows = edges.join(f.df.select(*([F.col("seed")] if f.batch else []), F.col("id").alias("_f")), F.col("_a") == F.col("_f"), "inner" if f.batch else "left_semi")
            rows = last.edges.select(F.col("src").alias("_b"), F.col("dst").alias("id")).join(rows, F.col("_b") == F.col("_m"), "inner" if f.batch else "left_semi")
            return Frontier(rows.select(*f.keys).distinct(), last.target, f.batch)
        if isinstance(step, ast.VarWalk):
            if not 0 <= step.low <= step.high:
                raise ValueError("a walk of low to high hops needs 0 <= low <= high")
            parts = [f] if step.low == 0 else []
            at = f
            for n in range(1, step.high + 1):
                at = self.walk(at, ast.Walk(step.relation, step.direction))
                if n >= step.low:
                    parts.append(at)
            return Frontier(reduce(DataFrame.unionByName, [p.df.select(*f.keys) for p in parts]).distinct(), parts[-1].domain, f.batch)
        if isinstance(step, ast.Filter):
            return self.where_nodes(f, step.where)
        if isinstance(step, ast.Label):
            if step.name not in self.snap.labels:
                raise KeyError(f"no label {step.name}")
            where = self.snap.labels[step.name]
            return self.walk(f, ast.Walk(step.relation, where=where)) if step.relation else self.where_nodes(f, where)
        if isinstance(step, ast.Project):
            return self.project(f, step)
        if isinstance(step, ast.Attribute):
            nodes = self.node_columns(f.domain, {step.name}).select(F.col("id").alias("_id"), F.col(step.name).alias("value"))
            return Frontier(f.df.select(*f.keys).join(nodes, F.col("id") == F.col("_id"), "left").drop("_id"), f.domain, f.batch, ("value",))
        if isinstance(step, ast.EdgeValues):
            tree = cel.parse(f"src.{step.node_attribute} {step.op} edge.{step.edge_attribute}")
            rel = self.snap.relation(step.relation)
            rows, resolve, target = self.traverse(f, rel, "out", [tree], True)
            return Frontier(rows.select(*([F.col("_seed").alias("seed")] if f.batch else []), F.col("_to").alias("id"), self.lowering(resolve)(tree).col.alias("value")), target, f.batch, ("value",))
        if isinstance(step, ast.Repeat):
            return self.repeat(f, step)
        if isinstance(step, ast.Stable):
            return self.stable(f, step)
        if isinstance(step, ast.Combine):
            other = self.frontier(step.other)
            a, b = f.df.select(*f.keys), other.df.select(*f.keys)
            out = {"union": lambda: a.unionByName(b).distinct(), "intersect": lambda: a.join(b, f.keys, "left_semi").distinct(), "difference": lambda: a.join(b, f.keys, "left_anti").distinct()}
            return Frontier(out[step.op](), f.domain, f.batch)
        raise TypeError(f"no step {type(step).__name__}")

    def frontier(self, query: ast.Query) -> Frontier:
        own = Lowerer(self.snap, {**self.params, **dict(query.params)}, self.functions)
        return own.steps(own.seed(query), [s for s in query.steps if not isinstance(s, (ast.Collect, ast.Reduce))])


def reduced(f: Frontier, step: ast.Reduce) -> DataFrame:
    """The whole frontier as one value (in batches one per seed): NaN counts as missing, the first of equals in the order of ids wins, and an
    empty frontier has null (count 0)."""
    if step.kind not in ast.REDUCTIONS:
        raise ValueError(f"no reduction {step.kind}")
    of = step.of if step.of in f.df.columns else "id"
    kind = cel.kind_of(f.df.schema[of].dataType)
    v = F.when(~F.isnan(of), F.col(of)) if kind == "float" else F.col(of)
    tie = F.struct(v, -F.col("id"))
    agg = {
        "sum": lambda: F.sum(of), "max": lambda: F.max(v), "min": lambda: F.min(v), "avg": lambda: F.avg(of), "count": lambda: F.count(F.lit(1)), "first": lambda: F.min_by(of, "id"),
        "argmax": lambda: F.max_by(F.when(v.isNotNull(), F.col("id")), F.when(v.isNotNull(), tie)), "argmin": lambda: F.min_by(F.when(v.isNotNull(), F.col("id")), F.when(v.isNotNull(), F.struct(v, F.col("id")))),
    }[step.kind]()
    return (f.df.groupBy("seed") if f.batch else f.df.groupBy()).agg(agg.alias(step.kind))


def compile_query(query: ast.Query, snap: GraphSnapshot, params: Mapping[str, Any] | None = None, functions: Mapping[str, Callable[..., Column]] | None = None) -> DataFrame:
    """The DataFrame of ``query``. A missing relation, attribute or parameter raises here, before anything runs."""
    for name in query.relations():
        snap.relation(name)
    low = Lowerer(snap, {**dict(query.params), **(params or {})}, functions or {})
    f = low.frontier(query)
    for step in query.steps:
        if isinstance(step, ast.Reduce):
            return reduced(f, step)
        if isinstance(step, ast.Collect):
            return collected(f, step, snap)
    return f.df


def collected(f: Frontier, step: ast.Collect, snap: GraphSnapshot) -> DataFrame:
    ids = f.df.select(*f.keys)
    if step.form == "set":
        return ids.distinct()
    if step.form == "list":
        return ids.distinct().orderBy(*f.keys)
    if step.form == "keys":
        return snap.id_to_key(f.domain, ids.distinct())
    if step.form == "map":
        return f.df
    group = ids.distinct().groupBy("seed") if f.batch else ids.distinct().groupBy()
    if step.form == "count":
        return group.agg(F.count("id").alias("count"))
    if step.form == "exists":
        return group.agg((F.count("id") > 0).alias("exists")) if f.batch else ids.limit(1).groupBy().agg((F.count("id") > 0).alias("exists"))
    if step.form == "first":
        return group.agg(F.min("id").alias("id"))
    raise ValueError(f"no form {step.form}")
