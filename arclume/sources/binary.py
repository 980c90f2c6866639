"""Binary snapshot files (layout 0.9): a reader that tasks share by ranges of edges, and a writer whose parts tasks write."""

from __future__ import annotations

import binascii
import os
import re
import shutil
import struct
import uuid
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from pathlib import Path
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from arclume.session import default_tasks
from arclume.sources.snapshot import GraphSnapshot, resolve_path

# Fixed values of the layout; all numbers are little-endian.
MAGIC, VERSION, PAGE, ALIGN = 0x494D5053, 9, 4096, 128
HEADER = struct.Struct("<IHIHHQQQQ16sH")  # magic, version, data offset, domains, relations, time, features, directory offset and bytes, uuid, checksum
DOMAIN = struct.Struct("<HBBIQ")  # id, key type, -, name, nodes
RELATION = struct.Struct("<HHHBBB3xIQQQQQQQQQQQH22x")  # id, source, target, encoding, node width, edge width, name, nodes, edges, features, four extents (row offsets and targets, both directions), attributes
ATTRIBUTE = struct.Struct("<IBBHIQQQQ")  # name, type, -, -, dimension, data offset and bytes, offsets offset and bytes
TRAILER = struct.Struct("<QII")  # footer length, version, magic
NULLABLE = 0x80

#: Edges that one task reads.
EDGES_PER_TASK = 4_000_000


@dataclass(frozen=True)
class BinaryAttribute:
    name: str
    code: int
    dimension: int
    offset: int
    bytes: int
    validity: int  # offset of the validity bits, 0 without


@dataclass(frozen=True)
class BinaryRelation:
    name: str
    source: int
    target: int
    node_width: int
    edge_width: int
    nodes: int
    edges: int
    rows_at: int
    targets_at: int
    attributes: tuple[BinaryAttribute, ...] = ()


@dataclass(frozen=True)
class Catalog:
    domains: Mapping[int, tuple[str, int, int]]  # id -> name, key type, nodes
    relations: Mapping[str, BinaryRelation]
    metadata: Mapping[str, str] = field(default_factory=dict)


def _padded(n: int, to: int = ALIGN) -> int:
    return -(-n // to) * to


def crc16(data: bytes) -> int:
    return binascii.crc_hqx(data, 0xFFFF)


def read_catalog(path: str, verify: bool = False) -> Catalog:
    """The catalog of a snapshot file; ValueError if it is none. ``verify`` checks the header's checksum."""
    size = Path(path).stat().st_size
    with open(path, "rb") as f:
        head = f.read(PAGE)
        if len(head) < HEADER.size - 2:
            raise ValueError(f"{size} bytes are less than a header")
        magic, version, data, n_domains, n_relations, _, _, directory, *_ = HEADER.unpack(head[: HEADER.size].ljust(HEADER.size, b"\0"))
        if magic != MAGIC:
            raise ValueError(f"magic {magic:#x}")
        if version != VERSION:
            raise ValueError(f"version {version}")
        if verify and crc16(head[:62]) != struct.unpack_from("<H", head, 62)[0]:
            raise ValueError("the header's checksum is wrong")
        at = directory if 0 < directory < size else max(data, 58)
        f.seek(at)
        (pool_bytes,) = struct.unpack("<i", f.read(4))
        if pool_bytes < 1 or at + 4 + pool_bytes > size:
            raise ValueError(f"string table of {pool_bytes} bytes")
        pool = f.read(pool_bytes)
        if pool[0]:
            raise ValueError("the string table doesn't begin with an empty string")

        def text(offset: int) -> str:
            end = pool.find(b"\0", offset) if offset < len(pool) else -1
            if end < 0:
                raise ValueError(f"no string at {offset}")
            return pool[offset:end].decode()

        f.seek(_padded(f.tell()))
        domains = {}
        for _ in range(n_domains):
            i, kind, _, name, nodes = DOMAIN.unpack(f.read(DOMAIN.size))
            domains[i] = (text(name) or f"dom_{i}", kind, nodes)
        f.seek(_padded(f.tell()))
        relations = {}
        for _ in range(n_relations):
            _, s, t, _, nw, ew, name, nodes, edges, _, rows_at, _, targets_at, _, *_, n_attributes = RELATION.unpack(f.read(RELATION.size))
            attributes = []
            for _ in range(n_attributes):
                a_name, code, _, _, dim, a_at, a_bytes, _, _ = ATTRIBUTE.unpack(f.read(ATTRIBUTE.size))
                bits = _padded(-(-(edges or nodes) // 64) * 8) if code & NULLABLE else 0
                attributes.append(BinaryAttribute(text(a_name), code & ~NULLABLE, dim, a_at + bits, a_bytes - bits, a_at if bits else 0))
            label = text(name) or f"rel_{s}_{t}"
            relations[label] = BinaryRelation(label, s, t, nw, ew, nodes, edges, rows_at, targets_at, tuple(attributes))
        return Catalog(domains, relations, _metadata(f, size))


#: Metadata of single nodes: domain.<name>.id.<n> and domain.<name>.key.<key>.
NODE_ENTRY = re.compile(r"domain\.(.+?)\.(?:id|key)\.(.*)", re.S)


def _entries(f: BinaryIO, size: int) -> Iterator[tuple[str, str]]:
    """The entries of the metadata footer, one after the other, however long it is; a footer cut short raises ValueError."""
    if size < TRAILER.size:
        return
    f.seek(size - TRAILER.size)
    length, _, magic = TRAILER.unpack(f.read(TRAILER.size))
    if magic != MAGIC or not TRAILER.size < length <= size:
        return  # no footer
    f.seek(size - length)
    (n,) = struct.unpack("<i", f.read(4))
    end = size - TRAILER.size

    def part(kind: str) -> str:
        head = f.read(struct.calcsize(kind))
        (m,) = struct.unpack(kind, head) if len(head) == struct.calcsize(kind) else (-1,)
        if m < 0 or f.tell() + m > end:
            raise ValueError("the metadata footer is cut short")
        return f.read(m).decode()

    for _ in range(n):
        yield part("<H"), part("<i")


def _metadata(f: BinaryIO, size: int) -> dict[str, str]:
    """The metadata of the graph; those of single nodes are left to ``arclume_snapshot_keys``."""
    return {k: v for k, v in _entries(f, size) if not NODE_ENTRY.fullmatch(k)}


class _Range(InputPartition):
    def __init__(self, first: int, last: int) -> None:
        self.first, self.last = first, last


class _EdgeReader(DataSourceReader):
    """Edges first to last of one relation: targets are read as they lie, sources follow from the row offsets around."""

    def __init__(self, path: str, relation: str, kinds: dict[str, str]) -> None:
        self.path, self.rel, self.kinds = path, read_catalog(path).relations[relation], kinds

    def partitions(self) -> list[_Range]:
        return [_Range(a, min(a + EDGES_PER_TASK, self.rel.edges)) for a in range(0, self.rel.edges, EDGES_PER_TASK)] or [_Range(0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        r = self.rel
        if not r.edges:
            return
        rows = np.memmap(self.path, dtype=f"<u{r.edge_width}", mode="r", offset=r.rows_at, shape=(r.nodes + 1,))
        low = int(np.searchsorted(rows, partition.first, side="right")) - 1
        for a in range(partition.first, partition.last, 200_000):
            b = min(a + 200_000, partition.last)
            high = int(np.searchsorted(rows, b, side="left"))
            ends = np.clip(rows[low : high + 1].astype(np.int64), a, b)
            src = np.repeat(np.arange(low, low + len(ends) - 1, dtype=np.int64), np.diff(ends))
            dst = np.fromfile(self.path, dtype=f"<u{r.node_width}", count=b - a, offset=r.targets_at + a * r.node_width).astype(np.int64)
            columns = [pa.array(src), pa.array(dst), pa.array(np.arange(a, b, dtype=np.int64))]
            for at in r.attributes:
                if at.name in self.kinds:
                    columns.append(self.attribute(at, a, b))
            yield pa.RecordBatch.from_arrays(columns, names=["src", "dst", "edge_id", *[x.name for x in r.attributes if x.name in self.kinds]])
            low = max(low, high - 1)

    def attribute(self, at: BinaryAttribute, a: int, b: int) -> pa.Array:
        dtype = np.dtype(self.kinds[at.name])
        dim = max(1, at.dimension)
        values = np.fromfile(self.path, dtype=dtype, count=(b - a) * dim, offset=at.offset + a * dim * dtype.itemsize)
        missing = None
        if at.validity:
            bits = np.unpackbits(np.fromfile(self.path, dtype=np.uint8, count=-(-b // 8) - a // 8, offset=at.validity + a // 8), bitorder="little")
            missing = bits[a % 8 : a % 8 + b - a] == 0
        if dim > 1:
            return pa.array([None if missing is not None and missing[i] else v for i, v in enumerate(values.reshape(-1, dim).tolist())], pa.list_(pa.from_numpy_dtype(dtype)))
        return pa.array(values, mask=missing)


class SnapshotSource(DataSource):
    """``spark.read.format("arclume_snapshot").option("path", ...).option("relation", ...)``: (src, dst, edge_id, attributes).

    The layout doesn't say what an attribute's type code means, so attributes are read whose type is given:
    ``option("types", "miles=<f4,year=<i4")``, as NumPy types.
    """

    @classmethod
    def name(cls) -> str:
        return "arclume_snapshot"

    def _kinds(self) -> dict[str, str]:
        return dict(p.split("=", 1) for p in (self.options.get("types") or "").split(",") if p)

    def schema(self) -> str:
        rel = read_catalog(self.options["path"]).relations[self.options["relation"]]
        sql = {"f4": "float", "f8": "double", "i1": "tinyint", "i2": "smallint", "i4": "int", "i8": "bigint", "u1": "smallint", "u4": "bigint"}
        kinds = self._kinds()
        more = []
        for a in rel.attributes:
            if a.name in kinds:
                t = sql[np.dtype(kinds[a.name]).str[1:]]
                more.append(f"`{a.name}` {f'array<{t}>' if a.dimension > 1 else t}")
        return ", ".join(["src bigint", "dst bigint", "edge_id bigint", *more])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _EdgeReader(self.options["path"], self.options["relation"], self._kinds())


class _KeyReader(DataSourceReader):
    """Ids and keys of a domain. Entries have no index, so one task passes the footer, holding a batch at a time."""

    def __init__(self, path: str, domain: str) -> None:
        self.path, self.prefix = path, f"domain.{domain}.id."

    def read(self, partition: InputPartition | None) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        keys: list[str] = []
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.string())], names=["_id", "_key"])
        with open(self.path, "rb") as f:
            for k, v in _entries(f, Path(self.path).stat().st_size):
                if k.startswith(self.prefix) and (n := k[len(self.prefix) :]).isdigit():
                    ids.append(int(n))
                    keys.append(v)
                    if len(ids) == 50_000:
                        yield batch()
                        ids, keys = [], []
        yield batch()


class SnapshotKeys(DataSource):
    """``spark.read.format("arclume_snapshot_keys").option("path", ...).option("domain", ...)``: (_id, _key)."""

    @classmethod
    def name(cls) -> str:
        return "arclume_snapshot_keys"

    def schema(self) -> str:
        return "_id bigint, _key string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _KeyReader(self.options["path"], self.options["domain"])


def load_binary(spark: SparkSession, path: str, types: Mapping[str, str] | None = None, verify: bool = False) -> GraphSnapshot:
    """The graph in a snapshot file on storage that all executors share. Keys come from the metadata (``domain.<name>.id.<n>``), else they are
    <domain>_<id>; ``types`` names the NumPy types of attributes to read."""
    path = resolve_path(path)
    cat = read_catalog(path, verify)
    spark.dataSource.register(SnapshotSource)
    spark.dataSource.register(SnapshotKeys)
    g = GraphSnapshot(spark, metadata=dict(cat.metadata))
    sizes = {i: n for i, (_, _, n) in cat.domains.items()}
    for r in cat.relations.values():
        sizes[r.source] = max(sizes.get(r.source, 0), r.nodes)
    edges = {n: spark.read.format("arclume_snapshot").option("path", path).option("relation", n).option("types", ",".join(f"{k}={v}" for k, v in (types or {}).items())).load() for n in cat.relations}
    for r in cat.relations.values():
        if not cat.domains.get(r.target, ("", 0, 0))[2]:
            last = edges[r.name].agg(F.max("dst")).first()[0]
            sizes[r.target] = max(sizes.get(r.target, 0), 0 if last is None else last + 1)
    names = {i: n for i, (n, _, _) in cat.domains.items()}
    for i, n in sizes.items():
        name = names.setdefault(i, f"dom_{i}")
        size = max(n, int(cat.metadata.get(f"domain.{name}.nodeCount", 0)))
        own = spark.read.format("arclume_snapshot_keys").option("path", path).option("domain", name).load().dropDuplicates(["_id"])
        nodes = spark.range(size).join(own, F.col("id") == F.col("_id"), "left").select("id", F.coalesce("_key", F.concat(F.lit(f"{name}_"), F.col("id").cast("string"))).alias("key"))
        g = g.with_domain(name, nodes, key="key")
    for n, r in cat.relations.items():
        g = g.with_relation(n, names[r.source], names[r.target], edges[n])
    return g


def _parts(df: DataFrame, folder: str, encode: Callable[[pa.RecordBatch], tuple[bytes, int]]) -> tuple[list[str], int]:
    """Write ``df``, partition by partition, as raw bytes below ``folder``: (files in the order of the partitions, entries in all). Each attempt of a task has
    a file of its own; only those of the attempts that count come back."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = f"{folder}/{uuid.uuid4().hex}"
        n = 0
        with open(at, "wb") as f:
            for b in batches:
                data, count = encode(b)
                f.write(data)
                n += count
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([at]), pa.array([n], pa.int64())], names=["part", "file", "n"])

    Path(folder).mkdir(parents=True, exist_ok=True)
    found = sorted(tuple(r) for r in df.mapInArrow(write, "part long, file string, n long").collect())  # a row per task
    return [f for _, f, _ in found], sum(n for *_, n in found)


def write_binary(snap: GraphSnapshot, path: str, transpose: bool = True, keys: bool = True, time_ms: int = 0) -> None:
    """Write ``snap`` as one snapshot file: domains, relations (edges by source, with ``transpose`` also by target) and metadata; attributes are
    left out, as the layout's type codes are not public.

    Tasks write the extents and the nodes' metadata as bytes beside ``path``, which must be on storage that all executors share; the driver joins
    the parts and adds up the row offsets, block by block, so its memory stays bounded.
    """
    pool, places = bytearray(b"\0"), {"": 0}
    folder = f"{path}.parts-{uuid.uuid4().hex}"
    tasks = default_tasks(snap.spark)

    def place(name: str) -> int:
        if name not in places:
            places[name] = len(pool)
            pool.extend(name.encode() + b"\0")
        return places[name]

    domains = sorted(snap.domains)
    sizes = {d: snap.domains[d].nodes.agg(F.coalesce(F.max("id") + 1, F.lit(0))).first()[0] for d in domains}
    relations = sorted(r.name for r in snap.relations.values() if not r.components)
    for n in (*domains, *relations):
        place(n)
    table = struct.pack("<i", len(pool)) + bytes(pool)
    table = table.ljust(_padded(PAGE + len(table)) - PAGE, b"\0") + b"".join(DOMAIN.pack(i, 1, 0, place(d), sizes[d]) for i, d in enumerate(domains))
    table = table.ljust(_padded(len(table)), b"\0")
    begin = PAGE + _padded(len(table) + RELATION.size * len(relations), PAGE)
    entries = []

    def numbers(b: pa.RecordBatch) -> tuple[bytes, int]:
        return b.column(0).to_numpy(zero_copy_only=False).astype("<u4").tobytes(), b.num_rows

    def node_entries(b: pa.RecordBatch) -> tuple[bytes, int]:
        out = []
        for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            k, v = k.encode(), v.encode()
            if len(k) >= 1 << 16:
                raise ValueError(f"a metadata key of {len(k)} bytes")
            out.append(struct.pack("<H", len(k)) + k + struct.pack("<i", len(v)) + v)
        return b"".join(out), len(out)

    try:
        with open(path, "wb") as f:
            f.seek(begin)

            def joined(files: list[str]) -> None:
                for name in files:
                    with open(name, "rb") as part:
                        shutil.copyfileobj(part, f, 1 << 20)
                    os.remove(name)

            for i, name in enumerate(relations):
                r = snap.relations[name]
                ends = r.edges.select("src", "dst")
                count = ends.count()
                if max(count, *sizes.values()) >= 1 << 32:
                    raise ValueError(f"{name}: more than 32 bits")
                extents: list[int] = []
                for a, b, n in [("src", "dst", sizes[r.source])] + [("dst", "src", sizes[r.target])] * transpose:
                    counted = snap.spark.range(0, n, 1, tasks).join(ends.groupBy(F.col(a).alias("_id")).count(), F.col("id") == F.col("_id"), "left")
                    files, _ = _parts(counted.repartitionByRange(tasks, "id").sortWithinPartitions("id").select(F.coalesce("count", F.lit(0)).alias("count")), folder, numbers)
                    at = _padded(f.tell())
                    f.seek(at)
                    f.write(bytes(4))  # the first row begins at 0
                    total = 0
                    for file in files:
                        for first in range(0, os.path.getsize(file), 1 << 22):
                            upto = total + np.cumsum(np.fromfile(file, "<u4", count=1 << 20, offset=first).astype(np.int64))
                            upto.astype("<u4").tofile(f)
                            total = int(upto[-1]) if len(upto) else total
                        os.remove(file)
                    extents += [at, f.tell() - at]
                    at = _padded(f.tell())
                    f.seek(at)
                    joined(_parts(ends.repartitionByRange(tasks, a, b).sortWithinPartitions(a, b).select(b), folder, numbers)[0])
                    extents += [at, f.tell() - at]
                extents += [0] * (8 - len(extents))
                entries.append(RELATION.pack(i, domains.index(r.source), domains.index(r.target), 0, 4, 4, place(name), sizes[r.source], count, int(transpose), *extents, 0))
            meta = {**snap.metadata, **{f"domain.{d}.nodeCount": str(sizes[d]) for d in domains}}
            f.seek(_padded(f.tell(), PAGE))
            footer = f.tell()
            f.write(bytes(4))
            n = len(meta)
            f.write(b"".join(struct.pack("<H", len(k.encode())) + k.encode() + struct.pack("<i", len(v.encode())) + v.encode() for k, v in meta.items()))
            for d in domains if keys else []:
                own = snap.domains[d].nodes.select(F.col("id").cast("string").alias("id"), F.col("key").cast("string").alias("key")).dropna()
                pairs = F.array(F.struct(F.concat(F.lit(f"domain.{d}.id."), "id").alias("k"), F.col("key").alias("v")), F.struct(F.concat(F.lit(f"domain.{d}.key."), "key").alias("k"), F.col("id").alias("v")))
                files, more = _parts(own.select(F.inline(pairs)), folder, node_entries)
                joined(files)
                n += more
            if n >= 1 << 31:
                raise ValueError(f"{n} metadata entries")
            f.write(TRAILER.pack(f.tell() - footer + TRAILER.size, VERSION, MAGIC))
            f.seek(footer)
            f.write(struct.pack("<i", n))
            f.seek(0)
            head = HEADER.pack(MAGIC, VERSION, PAGE, len(domains), len(relations), time_ms, 1, 0, 0, bytes(16), 0)[:62]
            f.write(head + struct.pack("<H", crc16(head)))
            f.seek(PAGE)
            f.write(table + b"".join(entries))
    finally:
        shutil.rmtree(folder, ignore_errors=True)
