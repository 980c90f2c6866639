"""Graph snapshots: typed node domains and edge relations as DataFrames, with manifest, import, writer and merge."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from functools import reduce
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arclume.session import materialize

# Spellings of the types of attributes and keys.
TYPES = {
    "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "float32": "float", "float64": "double", "float": "float", "double": "double",
    "varstring": "string", "string": "string", "fixedstring": "string", "varbytes": "binary", "bytes": "binary", "uuid": "string", "bool": "boolean", "boolean": "boolean",
    "timestampmicro": "timestamp", "timestamp": "timestamp", "timestampmilli": "timestamp",
}


def spark_type(name: str) -> str:
    """The Spark type of a declared one: vectors as ``float32[768]``, lengths as ``string(15)``."""
    text = name.strip().lower()
    if text.endswith("]"):
        return f"array<{spark_type(text[: text.index('[')])}>"
    base = text.split("(")[0].strip()
    if base not in TYPES:
        raise ValueError(f"no type {name}")
    return TYPES[base]


@dataclass(frozen=True)
class Domain:
    """Nodes of one type: ``nodes`` has ``id`` (0-based bigint), ``key`` and attributes."""

    name: str
    nodes: DataFrame
    key_type: str = "int64"

    def count(self) -> int:
        return self.nodes.count()


@dataclass(frozen=True)
class Relation:
    """Edges of one type: ``edges`` has ``src``, ``dst`` and attributes; parallel edges are edges.

    ``multiplicity`` (1:1, 1:N, N:1, M:N) is a promise: at 1:1 and 1:N no target has two sources, so walks of it need no distinct.
    ``transposed`` holds the same edges stored in the order of their targets, which walks against the edges read.
    """

    name: str
    source: str
    target: str
    edges: DataFrame
    multiplicity: str = "M:N"
    components: tuple[str, ...] = ()
    transposed: DataFrame | None = None

    def attributes(self) -> list[str]:
        return [c for c in self.edges.columns if c not in ("src", "dst")]


@dataclass(frozen=True)
class GraphSnapshot:
    """An immutable bundle of domains, relations and metadata. Names match exactly or, if only one does, without case."""

    spark: SparkSession
    domains: Mapping[str, Domain] = field(default_factory=dict)
    relations: Mapping[str, Relation] = field(default_factory=dict)
    metadata: Mapping[str, str] = field(default_factory=dict)
    labels: Mapping[str, str] = field(default_factory=dict)
    version: int = 0

    # building

    def with_domain(self, name: str, nodes: DataFrame, id: str = "id", key: str | None = None, key_type: str | None = None) -> GraphSnapshot:  # noqa: A002
        cols = [F.col(id).cast("long").alias("id"), (F.col(key) if key else F.col(id)).alias("key"), *[F.col(c) for c in nodes.columns if c not in (id, "key", "id") or c == id and c != "id"]]
        own = nodes.select(*cols)
        return replace(self, domains={**self.domains, name: Domain(name, own, key_type or dict(own.dtypes)["key"])})

    def with_relation(self, name: str, source: str, target: str, edges: DataFrame, src: str = "src", dst: str = "dst", multiplicity: str = "M:N") -> GraphSnapshot:
        for d in (source, target):
            if d not in self.domains:
                raise ValueError(f"relation {name}: no domain {d}")
        own = edges.select(F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst"), *[F.col(c) for c in edges.columns if c not in ("src", "dst")])
        return replace(self, relations={**self.relations, name: Relation(name, source, target, own, multiplicity)})

    def with_keyed_relation(self, name: str, source: str, target: str, edges: DataFrame, src: str, dst: str) -> GraphSnapshot:
        """Edges given by external keys; those with an unknown end are dropped."""
        a = self.domain_of(source).nodes.select(F.col("key").alias("_ka"), F.col("id").alias("_src"))
        b = self.domain_of(target).nodes.select(F.col("key").alias("_kb"), F.col("id").alias("_dst"))
        joined = edges.join(a, F.col(src) == F.col("_ka")).join(b, F.col(dst) == F.col("_kb"))
        rest = [c for c in edges.columns if c not in (src, dst, "src", "dst")]
        return self.with_relation(name, source, target, joined.select("_src", "_dst", *rest), "_src", "_dst")

    def with_virtual_relation(self, name: str, components: list[str]) -> GraphSnapshot:
        """The union of relations with equal ends, with the literal column ``component``: filters on it prune branches."""
        parts = [self.relation(c) for c in components]
        if len({(p.source, p.target) for p in parts}) != 1:
            raise ValueError(f"{name}: components with different ends")
        union = lambda frames: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [d.withColumn("component", F.lit(p.name)) for p, d in zip(parts, frames)])
        edges = union([p.edges for p in parts])
        back = union([p.transposed for p in parts]) if all(p.transposed is not None for p in parts) else None
        return replace(self, relations={**self.relations, name: Relation(name, parts[0].source, parts[0].target, edges, "M:N", tuple(components), back)})

    def with_prefix_relation(self, prefix: str) -> GraphSnapshot:
        """A virtual relation of all relations ``prefix_*``, asked for explicitly."""
        return self.with_virtual_relation(prefix, sorted(r for r in self.relations if r.startswith(prefix + "_")))

    def with_metadata(self, **values: str) -> GraphSnapshot:
        return replace(self, metadata={**self.metadata, **values})

    def with_label(self, name: str, where: str) -> GraphSnapshot:
        """Register the expression ``where`` as the predicate ``name``."""
        return replace(self, labels={**self.labels, name: where})

    # lookups

    def _find(self, names: Mapping[str, Any], name: str, what: str) -> Any:  # noqa: ANN401
        if name in names:
            return names[name]
        loose = [n for n in names if n.lower() == name.lower()]
        if len(loose) == 1:
            return names[loose[0]]
        raise KeyError(f"{'ambiguous' if loose else 'no'} {what} {name}; there are {', '.join(sorted(names)) or 'none'}")

    def domain_of(self, name: str) -> Domain:
        return self._find(self.domains, name, "domain")

    def relation(self, name: str) -> Relation:
        return self._find(self.relations, name, "relation")

    def domain(self, name: str):  # noqa: ANN201
        """A view of the domain to start traversals from."""
        from arclume.api import DomainView

        return DomainView(self, self.domain_of(name).name)

    def has(self, name: str) -> dict[str, bool]:
        """Catalog probes of a relation: edges, their transpose and keys are always at hand where the relation is."""
        there = any(n.lower() == name.lower() for n in self.relations)
        keys = there and dict(self.domain_of(self.relation(name).source).nodes.dtypes)["key"] is not None
        return {"csr": there, "csc": there, "coo": there, "key_catalog": keys}

    # keys

    def key_to_id(self, domain: str, keys: DataFrame, column: str = "key", strict: bool = True) -> DataFrame:
        """``keys`` with ``id``: by key, then as a number in range, then by the number behind the last _ or #. With ``strict``
        unknown keys raise, else they have a null."""
        nodes = self.domain_of(domain).nodes
        own = nodes.select(F.col("key").cast("string").alias("_key"), F.col("id").alias("_by_key"))
        text = F.col(column).cast("string")
        number = F.coalesce(text.try_cast("bigint"), F.regexp_extract(text, r"[_#](\d+)$", 1).try_cast("bigint"))
        found = keys.join(own, text == F.col("_key"), "left").withColumn("_number", F.when(F.col("_by_key").isNull(), number))
        found = found.join(nodes.select(F.col("id").alias("_id")), F.col("_number") == F.col("_id"), "left").withColumn("id", F.coalesce("_by_key", "_id")).drop("_key", "_by_key", "_number", "_id")
        if strict and (lost := [r[0] for r in found.filter("id IS NULL").select(column).limit(5).collect()]):
            raise KeyError(f"no {domain} with key {', '.join(map(str, lost))}")
        return found

    def id_to_key(self, domain: str, ids: DataFrame, column: str = "id") -> DataFrame:
        """``ids`` with ``key``; a node without one gets domain_id."""
        own = self.domain_of(domain).nodes.select(F.col("id").alias("_id"), F.col("key").cast("string").alias("_key"))
        named = F.coalesce(F.col("_key"), F.concat(F.lit(f"{domain}_"), F.col(column).cast("string")))
        return ids.join(own, F.col(column) == F.col("_id"), "left").withColumn("key", named).drop("_id", "_key")

    # catalog, files

    def inspect(self) -> DataFrame:
        """Relations with ends, multiplicity, edges and attributes."""
        kind = "relation string, source string, target string, multiplicity string, attributes string, edges long"
        own = lambda r: [F.lit(x).alias(n) for n, x in zip(kind.replace(" string", "").split(", "), (r.name, r.source, r.target, r.multiplicity, ",".join(r.attributes())))]
        rows = [r.edges.agg(F.count(F.lit(1)).alias("edges")).select(*own(r), "edges") for r in self.relations.values()]
        return reduce(DataFrame.unionByName, rows) if rows else self.spark.createDataFrame([], kind)

    def save(self, path: str, buckets: int | None = None) -> None:
        """Write the snapshot as a directory: parquet per domain and relation, sorted by source, a transposed copy sorted by target, and a catalog."""
        for d in self.domains.values():
            d.nodes.write.mode("overwrite").parquet(f"{path}/domains/{d.name}")
        for r in self.relations.values():
            if not r.components:
                n = buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
                r.edges.repartitionByRange(n, "src").sortWithinPartitions("src", "dst").write.mode("overwrite").parquet(f"{path}/relations/{r.name}/out")
                r.edges.repartitionByRange(n, "dst").sortWithinPartitions("dst", "src").write.mode("overwrite").parquet(f"{path}/relations/{r.name}/in")
        catalog = {
            "format": "arclume-1", "version": self.version, "metadata": dict(self.metadata), "labels": dict(self.labels),
            "domains": {d.name: {"key_type": d.key_type} for d in self.domains.values()},
            "relations": {r.name: {"source": r.source, "target": r.target, "multiplicity": r.multiplicity} for r in self.relations.values() if not r.components},
            "virtual_relations": {r.name: {"components": list(r.components)} for r in self.relations.values() if r.components},
        }
        self.spark.createDataFrame([(json.dumps(catalog),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/catalog")

    def merge(self, other: GraphSnapshot) -> GraphSnapshot:
        """Both snapshots in one: domains by key with new dense ids, relations as multisets of both."""
        out = GraphSnapshot(self.spark, metadata={**self.metadata, **other.metadata}, labels={**self.labels, **other.labels}, version=max(self.version, other.version) + 1)
        ids: dict[tuple[int, str], DataFrame] = {}
        for name in {**self.domains, **other.domains}:
            parts = [s.domains[name].nodes for s in (self, other) if name in s.domains]
            keys = parts[0].select(F.col("key").cast("string").alias("key"))
            for p in parts[1:]:
                keys = keys.union(p.select(F.col("key").cast("string")))
            dense = materialize(dense_ids(keys.distinct(), "key"), "merge")
            nodes = dense
            merged = parts[0].drop("id").withColumn("key", F.col("key").cast("string"))
            for p in parts[1:]:
                fresh = p.drop("id").withColumn("key", F.col("key").cast("string")).join(merged.select("key"), "key", "left_anti")
                merged = merged.unionByName(fresh, allowMissingColumns=True)
            nodes = dense.join(merged.dropDuplicates(["key"]), "key", "left")
            out = out.with_domain(name, nodes, key="key")
            for i, s in enumerate((self, other)):
                if name in s.domains:
                    ids[i, name] = s.domains[name].nodes.select(F.col("id").alias("_old"), F.col("key").cast("string").alias("_k")).join(dense, F.col("_k") == dense["key"]).select("_old", F.col("id").alias("_new"))
        for name in {**self.relations, **other.relations}:
            edges = None
            kept = (self.relations.get(name) or other.relations[name])
            if kept.components:
                continue
            for i, s in enumerate((self, other)):
                if r := s.relations.get(name):
                    a, b = ids[i, r.source].withColumnsRenamed({"_old": "_oa", "_new": "_na"}), ids[i, r.target].withColumnsRenamed({"_old": "_ob", "_new": "_nb"})
                    own = r.edges.join(a, F.col("src") == F.col("_oa")).join(b, F.col("dst") == F.col("_ob")).select(F.col("_na").alias("src"), F.col("_nb").alias("dst"), *r.attributes())
                    edges = own if edges is None else edges.unionByName(own, allowMissingColumns=True)
            out = out.with_relation(name, kept.source, kept.target, edges)
        for r in {**self.relations, **other.relations}.values():
            if r.components:
                out = out.with_virtual_relation(r.name, list(r.components))
        return out


def dense_ids(df: DataFrame, *by: str) -> DataFrame:
    """``df`` with ``id`` from 0 in the order of ``by``: ranges are sorted apart and numbered from their counts, no task sorts all."""
    parts = materialize(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_part", F.spark_partition_id()), "dense")
    at = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = parts.groupBy("_part").count().withColumn("_before", F.coalesce(F.sum("count").over(at), F.lit(0))).drop("count")  # a row per partition
    inside = Window.partitionBy("_part").orderBy(*by)
    return parts.withColumn("_n", F.row_number().over(inside)).join(F.broadcast(counts), "_part").withColumn("id", (F.col("_before") + F.col("_n") - 1).cast("long")).drop("_part", "_n", "_before")


def resolve_path(path: str, data_dirs: tuple[str, ...] = ("ARCLUME_DATA_DIR",)) -> str:
    """``path`` as it is if it is there or names a file system, else below the folders that the environment names."""
    if "://" in path or Path(path).exists():
        return path
    for name in data_dirs:
        root = os.environ.get(name)
        if root:
            for at in (Path(root, path), Path(root, Path(path).stem, Path(path).name)):
                if at.exists():
                    return str(at)
    raise FileNotFoundError(path)


def load_snapshot(spark: SparkSession, path: str) -> GraphSnapshot:
    """A snapshot that ``save`` wrote. A catalog that isn't one raises ValueError."""
    path = resolve_path(path)
    try:
        catalog = json.loads("\n".join(r[0] for r in spark.read.text(f"{path}/catalog").collect()))
    except json.JSONDecodeError as e:
        raise ValueError(f"{path}: no catalog") from e
    if catalog.get("format") != "arclume-1":
        raise ValueError(f"{path}: format {catalog.get('format')}")
    snap = GraphSnapshot(spark, metadata=catalog["metadata"], labels=catalog["labels"], version=catalog["version"])
    for name, d in catalog["domains"].items():
        snap = replace(snap, domains={**snap.domains, name: Domain(name, spark.read.parquet(f"{path}/domains/{name}"), d["key_type"])})
    for name, r in catalog["relations"].items():
        snap = snap.with_relation(name, r["source"], r["target"], spark.read.parquet(f"{path}/relations/{name}/out"), multiplicity=r["multiplicity"])
        back = spark.read.parquet(f"{path}/relations/{name}/in")
        snap = replace(snap, relations={**snap.relations, name: replace(snap.relations[name], transposed=back)})
    for name, r in catalog["virtual_relations"].items():
        snap = snap.with_virtual_relation(name, r["components"])
    return snap


def read_manifest(text: str) -> dict[str, Any]:
    """A YAML manifest in either dialect (``domains`` or ``nodes``) in one form; raises ValueError for what is missing."""
    import yaml

    raw = yaml.safe_load(text)
    if not isinstance(raw, dict):
        raise ValueError("a manifest is a mapping")
    name = raw.get("graphName") or raw.get("graph") or raw.get("name") or "graph"
    spaces = {n: {"file": (s or {}).get("file", n), "mode": (s or {}).get("mode", "read-write"), "description": (s or {}).get("description", "")} for n, s in (raw.get("tablespaces") or {}).items()}

    def entries(value: Any) -> dict[str, dict]:  # noqa: ANN401
        if isinstance(value, list):
            return {v["name"]: {k: x for k, x in v.items() if k != "name"} for v in value}
        return {k: dict(v or {}) for k, v in (value or {}).items()}

    def attributes(value: Any) -> dict[str, dict]:  # noqa: ANN401
        out = {}
        for k, v in entries(value if not isinstance(value, dict) else {a: (b if isinstance(b, dict) else {"type": b}) for a, b in value.items()}).items():
            kind = str(v.get("type", "string"))
            if v.get("dimension", 1) and int(v.get("dimension", 1)) > 1:
                kind = f"{kind}[{v['dimension']}]"
            out[k] = {"type": spark_type(kind), "nullable": v.get("nullable", True), "length": v.get("length")}
        return out

    domains = {n: {"tablespace": d.get("tablespace"), "file": d.get("file"), "key": d.get("key"), "attributes": attributes(d.get("attributes"))} for n, d in entries(raw.get("domains") or raw.get("nodes")).items()}
    relations = {}
    for n, r in entries(raw.get("relations")).items():
        src, tgt = r.get("source") or r.get("from"), r.get("target") or r.get("to")
        if src not in domains or tgt not in domains:
            raise ValueError(f"relation {n}: source {src} or target {tgt} is no domain")
        relations[n] = {"source": src, "target": tgt, "tablespace": r.get("tablespace"), "file": r.get("file"), "attributes": attributes(r.get("attributes")), "multiplicity": r.get("cardinality", "M:N"), "inverse": r.get("inverseAlias")}
    virtual = {n: list((v or {}).get("components", [])) for n, v in (raw.get("virtual_relations") or {}).items()}
    return {"name": name, "version": str(raw.get("version", "")), "tablespaces": spaces, "domains": domains, "relations": relations, "virtual_relations": virtual}


def load_manifest(spark: SparkSession, path: str) -> GraphSnapshot:
    """A graph whose manifest names parquet files per tablespace, domain or relation, beside the manifest.

    A domain's file is its ``file``, or domains/<name> in its tablespace's directory; relations alike. Declared types are cast to,
    lengths are checked in bytes, and virtual relations are built.
    """
    path = resolve_path(path)
    man = read_manifest(spark.read.text(path, wholetext=True).first()[0])
    root = path.rsplit("/", 1)[0] if "/" in path else "."

    def place(kind: str, name: str, entry: dict) -> str:
        if entry["file"]:
            return f"{root}/{entry['file']}"
        space = man["tablespaces"].get(entry["tablespace"], {"file": "."})
        return f"{root}/{space['file']}/{kind}/{name}"

    def typed(df: DataFrame, attributes: dict[str, dict]) -> DataFrame:
        for a, d in attributes.items():
            if a in df.columns:
                df = df.withColumn(a, F.col(a).cast(d["type"]))
                if d["length"] and d["type"] == "string":
                    df = df.withColumn(a, F.when(F.octet_length(a) <= int(d["length"]), F.col(a)).when(F.col(a).isNotNull(), F.raise_error(F.lit(f"{a} is longer than {d['length']} bytes"))))
        return df

    snap = GraphSnapshot(spark, metadata={"graph": man["name"], "version": man["version"]})
    for n, d in man["domains"].items():
        nodes = typed(spark.read.parquet(place("domains", n, d)), d["attributes"])
        snap = snap.with_domain(n, nodes, key="key" if "key" in nodes.columns else None)
    for n, r in man["relations"].items():
        snap = snap.with_relation(n, r["source"], r["target"], typed(spark.read.parquet(place("relations", n, r)), r["attributes"]), multiplicity=r["multiplicity"])
        if r["inverse"]:
            back = snap.relation(n)
            snap = snap.with_relation(r["inverse"], back.target, back.source, back.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *back.attributes()))
    for n, parts in man["virtual_relations"].items():
        snap = snap.with_virtual_relation(n, parts)
    return snap


def read_edge_lines(spark: SparkSession, path: str, default: str = "default") -> DataFrame:
    """(src, dst, relation) of a text file of edges: ``src dst [relation]`` between commas, tabs or blanks.

    Blank lines, comments (#) and lines without two whole numbers are left out.
    """
    parts = F.split(F.trim("value"), r"[,\t\s]+")
    lines = spark.read.text(path).filter(~F.trim("value").startswith("#")).select(parts.alias("p"))
    rows = lines.select(F.get("p", F.lit(0)).try_cast("bigint").alias("src"), F.get("p", F.lit(1)).try_cast("bigint").alias("dst"), F.coalesce(F.get("p", F.lit(2)), F.lit(default)).alias("relation"))
    return rows.filter("src >= 0 AND dst >= 0")


def import_edges(spark: SparkSession, path: str, domain: str = "Node", default: str = "default") -> GraphSnapshot:
    """A graph of the edges in a text file: one domain with the ids 0 to the largest, one relation per name in the third column."""
    edges = materialize(read_edge_lines(spark, path, default), "edges")
    last = edges.agg(F.max(F.greatest("src", "dst"))).first()[0]
    snap = GraphSnapshot(spark).with_domain(domain, spark.range(0 if last is None else last + 1))
    for (name,) in edges.select("relation").distinct().orderBy("relation").collect():  # names of relations
        snap = snap.with_relation(name, domain, domain, edges.filter(F.col("relation") == name).drop("relation"))
    return snap


def import_typed(spark: SparkSession, nodes: DataFrame, edges: DataFrame) -> GraphSnapshot:
    """A graph of ``nodes`` (key, name, kind) and ``edges`` (src, relation, dst) by keys: a domain per kind, a relation per label and pair of
    kinds. Edges with an unknown end are dropped; a label between several pairs of kinds is named label_source_target."""
    dense = []
    snap = GraphSnapshot(spark)
    for (kind,) in nodes.select("kind").distinct().orderBy("kind").collect():
        own = materialize(dense_ids(nodes.filter(F.col("kind") == kind).dropDuplicates(["key"]), "key"), "nodes")
        snap = snap.with_domain(kind, own.drop("kind"), key="key")
        dense.append(own.select("key", "kind", "id"))
    every = dense[0]
    for d in dense[1:]:
        every = every.unionByName(d)
    a, b = every.withColumnsRenamed({"key": "_ka", "kind": "_sk", "id": "_s"}), every.withColumnsRenamed({"key": "_kb", "kind": "_tk", "id": "_t"})
    rest = [c for c in edges.columns if c not in ("src", "dst", "relation")]
    found = materialize(edges.join(a, F.col("src") == F.col("_ka")).join(b, F.col("dst") == F.col("_kb")).select("relation", "_sk", "_tk", "_s", "_t", *rest), "typed")
    kinds = [tuple(r) for r in found.select("relation", "_sk", "_tk").distinct().orderBy("relation", "_sk", "_tk").collect()]  # names
    for label, s, t in kinds:
        many = sum(k[0] == label for k in kinds) > 1
        own: Column = (F.col("relation") == label) & (F.col("_sk") == s) & (F.col("_tk") == t)
        snap = snap.with_relation(f"{label}_{s}_{t}" if many else label, s, t, found.filter(own).drop("relation", "_sk", "_tk"), "_s", "_t")
    return snap
