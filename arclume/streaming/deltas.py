"""Mutations of a graph: folding, compaction to versions, and a streaming sink."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from arclume.functions.keys import canonical_key
from arclume.session import materialize
from arclume.sources.snapshot import GraphSnapshot, dense_ids, load_snapshot

DELTA_SCHEMA = "offset long, op string, kind string, name string, src_key string, dst_key string"


def fold(deltas: DataFrame, keys: Sequence[str], order: Sequence[str], op: str = "op") -> DataFrame:
    """The last delta of every key: (keys, op, the other columns), by ``order``. The last writer wins; of equals the delete.

    One aggregate with a combiner, so a key that changes all the time is folded before the shuffle.
    """
    rest = [c for c in deltas.columns if c not in keys]
    row = F.struct(*order, (F.col(op) == "D").alias("_delete"), *[c for c in rest if c not in order])
    return deltas.groupBy(*keys).agg(F.max(row).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def apply_deltas(edges: DataFrame, deltas: DataFrame, keys: Sequence[str] = ("src", "dst"), order: Sequence[str] = ("offset",), op: str = "op") -> DataFrame:
    """``edges`` after ``deltas`` (op I or D): a key with deltas has one edge if the last one inserts it and none if it deletes it; parallel
    edges of untouched keys stay. Columns that a delta lacks are null."""
    last = fold(deltas, keys, order, op)
    kept = edges.join(last.select(*keys), list(keys), "left_anti")
    new = last.filter(F.col(op) == "I").select(*[c for c in last.columns if c in edges.columns])
    return kept.unionByName(new, allowMissingColumns=True).select(*edges.columns)


class VersionStore:
    """Snapshots as directories of versions. A version is complete before the pointer file names it; the pointer is a file of its own
    for every version, so publishing is one write and readers take the highest."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):  # noqa: ANN202
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm

    def _numbers(self, kind: str) -> list[int]:
        fs, jvm = self._fs()
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        return sorted(int(n) for s in fs.listStatus(at) if (n := s.getPath().getName()).isdigit()) if fs.exists(at) else []

    def versions(self) -> list[int]:
        return self._numbers("published")

    def publish(self, snap: GraphSnapshot) -> int:
        """Write ``snap`` as the next version. Its number is taken first, by creating a file that nobody else can create, so writers at the same time
        write apart; a number whose writer failed stays unused."""
        fs, jvm = self._fs()
        version = max([0, *self._numbers("taken"), *self.versions()])
        while True:
            version += 1
            try:
                fs.create(jvm.org.apache.hadoop.fs.Path(f"{self.path}/taken/{version}"), False).close()
                break
            except Exception as e:  # noqa: BLE001
                if "exist" not in str(e).lower():
                    raise
        replace(snap, version=version).save(f"{self.path}/v{version}")
        fs.create(jvm.org.apache.hadoop.fs.Path(f"{self.path}/published/{version}"), False).close()
        return version

    # deltas beside a version

    def append(self, deltas: DataFrame, batch: int) -> None:
        """Keep the deltas of a batch beside the last version. The same batch again takes its own place."""
        deltas.write.mode("overwrite").parquet(f"{self.path}/pending/{self.versions()[-1]}/{batch}")

    def pending(self, version: int) -> list[int]:
        return self._numbers(f"pending/{version}")

    def deltas(self, version: int) -> DataFrame:
        return self.spark.read.schema(DELTA_SCHEMA).parquet(*[f"{self.path}/pending/{version}/{n}" for n in self.pending(version)])

    def load(self, version: int | None = None, overlay: bool = True) -> GraphSnapshot:
        """A version as it was published, the last one without a number. Deltas that wait beside the last version are laid over it (``overlay``)."""
        have = self.versions()
        if not have or version is not None and version not in have:
            raise FileNotFoundError(f"{self.path}: version {version if have else 'none published'}")
        at = version or have[-1]
        snap = load_snapshot(self.spark, f"{self.path}/v{at}")
        return compact(snap, self.deltas(at)) if overlay and at == have[-1] and self.pending(at) else snap

    def retain(self, keep: int) -> None:
        """Drop all but the last ``keep`` versions."""
        fs, jvm = self._fs()
        for v in self.versions()[:-keep]:
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/published/{v}"), False)
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/v{v}"), True)
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/pending/{v}"), True)


def _kind(key_type: str) -> str:
    """The key type of a domain as ``canonical_key`` names it."""
    return {"bigint": "int64", "long": "int64", "int": "int32", "integer": "int32", "smallint": "int32", "tinyint": "int32", "binary": "bytes"}.get(key_type, key_type)


def compact(snap: GraphSnapshot, deltas: DataFrame) -> GraphSnapshot:
    """``snap`` with node and edge deltas (DELTA_SCHEMA; kind node or edge, name of domain or relation) merged in.

    Keys are compared in their canonical form. New nodes get ids behind the present ones, in the order of their keys. A delete of a node takes
    all edges that it has at that offset, also if the node is inserted again later; edges inserted behind the delete stay if the node does.
    The deltas of all domains and relations are folded together; what each of them gets is then a filter of a written table.
    """
    spark = snap.spark
    real = [r for r in snap.relations.values() if not r.components]
    catalog = lambda rows, columns: F.broadcast(spark.createDataFrame(rows, columns))  # noqa: E731  a row per name
    domains = catalog([(d.name, _kind(d.key_type)) for d in snap.domains.values()], "name string, _type string")
    nodes = deltas.filter("kind = 'node'").join(domains, "name").withColumn("key", canonical_key(F.col("src_key"), F.col("_type"))).filter("key IS NOT NULL")
    cut = F.max(F.when(F.col("op") == "D", F.col("offset")))
    last = nodes.groupBy("name", "key").agg(F.max(F.struct("offset", (F.col("op") == "D").alias("gone"))).alias("_r"), cut.alias("_off"))
    last = materialize(last.select("name", "key", F.col("_r.gone").alias("gone"), "_off"), "nodes")
    present = reduce(DataFrame.unionByName, [d.nodes.select(F.lit(d.name).alias("name"), canonical_key(F.col("key").cast("string"), F.lit(_kind(d.key_type))).alias("key"), "id") for d in snap.domains.values()])
    present = materialize(present, "present")
    tops = {r[0]: r[1] for r in present.groupBy("name").agg(F.max("id")).collect()}  # a row per domain
    fresh = materialize(dense_ids(last.filter("NOT gone").select("name", "key").join(present, ["name", "key"], "left_anti"), "name", "key"), "fresh")
    starts = {r[0]: r[1] for r in fresh.groupBy("name").agg(F.min("id")).collect()}
    shift = catalog([(n, (tops[n] + 1 if n in tops else 0) - at) for n, at in starts.items()] or [("", 0)], "name string, _shift long")
    fresh = fresh.join(shift, "name").select("name", "key", (F.col("id") + F.col("_shift")).alias("id"))
    every = materialize(present.unionByName(fresh).join(last, ["name", "key"], "left").select("name", "key", "id", F.coalesce("gone", F.lit(False)).alias("gone"), "_off"), "ids")
    out = snap
    for name, d in snap.domains.items():
        mine = every.filter(F.col("name") == name)
        kept = d.nodes.withColumn("key", F.col("key").cast("string")).join(mine.filter("gone").select("id"), "id", "left_anti")
        added = fresh.filter(F.col("name") == name).select("id", "key")
        out = out.with_domain(name, kept.unionByName(added, allowMissingColumns=True), key="key", key_type=d.key_type)

    if not real:
        return out
    ends = catalog([(r.name, r.source, r.target, _kind(snap.domains[r.source].key_type), _kind(snap.domains[r.target].key_type)) for r in real], "name string, _sn string, _tn string, _st string, _tt string")
    edges = deltas.filter("kind = 'edge'").join(ends, "name").select("name", "offset", "op", "_sn", "_tn", canonical_key(F.col("src_key"), F.col("_st")).alias("_sk"), canonical_key(F.col("dst_key"), F.col("_tt")).alias("_tk"))
    edges = fold(edges.select("name", "_sn", "_tn", "_sk", "_tk", "offset", "op"), ["name", "_sn", "_tn", "_sk", "_tk"], ["offset"])
    side = lambda n, k, i, o: every.filter("NOT gone").select(F.col("name").alias(n), F.col("key").alias(k), F.col("id").alias(i), F.col("_off").alias(o))
    edges = edges.join(side("_sn", "_sk", "src", "_so"), ["_sn", "_sk"]).join(side("_tn", "_tk", "dst", "_to"), ["_tn", "_tk"])
    alive = F.col("offset") > F.greatest(F.coalesce("_so", F.lit(-1)), F.coalesce("_to", F.lit(-1)))
    edges = materialize(edges.filter((F.col("op") == "D") | alive).select("name", "offset", "op", "src", "dst"), "edges")
    for r in real:
        kept = r.edges
        for end, domain in (("src", r.source), ("dst", r.target)):
            kept = kept.join(every.filter((F.col("name") == domain) & F.col("_off").isNotNull()).select(F.col("id").alias(end)), end, "left_anti")
        out = out.with_relation(r.name, r.source, r.target, apply_deltas(kept.select(*r.edges.columns), edges.filter(F.col("name") == r.name).drop("name")), multiplicity=r.multiplicity)
    for name, r in snap.relations.items():
        if r.components:
            out = out.with_virtual_relation(name, list(r.components))
    return out


#: Deltas beside a version from which on they are written into the next.
COMPACT_ROWS = 1_000_000


def stream_to_versions(deltas: DataFrame, store: VersionStore, checkpoint: str, available_now: bool = True, interval: str = "1 minute", compact_rows: int = COMPACT_ROWS) -> StreamingQuery:
    """Take a stream of deltas into a store of versions. A micro-batch is written beside the last version, which readers lay over it; once ``compact_rows``
    deltas are there, they are merged into the next version, so that a batch costs its own size. The batch number is kept with both: a batch that
    comes again after a failure takes its own place or is left out."""

    def on_batch(batch: DataFrame, number: int) -> None:
        base = store.load(overlay=False)
        if int(base.metadata.get("batch", "-1")) >= number or batch.isEmpty():
            return
        version = store.versions()[-1]
        store.append(batch.select(*[f.split()[0] for f in DELTA_SCHEMA.split(", ")]), number)
        waiting = store.deltas(version)
        rows, last = waiting.agg(F.count(F.lit(1)), F.max("offset")).first()
        if rows >= compact_rows:
            store.publish(compact(base, waiting).with_metadata(batch=str(number), offset=str(last)))

    writer = deltas.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()


class DeltaConsumer:
    """Typed mutation callbacks, buffered and written as rows of DELTA_SCHEMA to a directory that a stream reads."""

    def __init__(self, spark: SparkSession, path: str, flush_rows: int = 100_000) -> None:
        self.spark, self.path, self.flush_rows, self.rows, self.offset = spark, path, flush_rows, [], 0

    def _add(self, op: str, kind: str, name: str, src: object, dst: object = None) -> None:
        text = lambda v: None if v is None else v.hex() if isinstance(v, (bytes, bytearray)) else str(v)
        self.rows.append((self.offset, op, kind, name, text(src), text(dst)))
        self.offset += 1
        if len(self.rows) >= self.flush_rows:
            self.flush()

    def insert_node(self, domain: str, key: int | str | bytes | uuid.UUID) -> None:
        self._add("I", "node", domain, key)

    def delete_node(self, domain: str, key: int | str | bytes | uuid.UUID) -> None:
        self._add("D", "node", domain, key)

    def insert_edge(self, relation: str, src: int | str | bytes | uuid.UUID, dst: int | str | bytes | uuid.UUID) -> None:
        self._add("I", "edge", relation, src, dst)

    def delete_edge(self, relation: str, src: int | str | bytes | uuid.UUID, dst: int | str | bytes | uuid.UUID) -> None:
        self._add("D", "edge", relation, src, dst)

    def on_checkpoint(self, offset: int) -> None:
        """All up to ``offset`` is in; what follows counts on from there."""
        self.flush()
        self.offset = offset + 1

    def flush(self) -> None:
        if self.rows:
            self.spark.createDataFrame(self.rows, DELTA_SCHEMA).coalesce(1).write.mode("append").parquet(self.path)
            self.rows.clear()


def metadata_json(snap: GraphSnapshot) -> str:
    return json.dumps(dict(snap.metadata), sort_keys=True)
