"""Statistics of relations and attributes, exact and sketched."""

from __future__ import annotations

import json
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arclume.operators.walks import degree
from arclume.session import materialize

if TYPE_CHECKING:
    from arclume.sources.snapshot import GraphSnapshot


def relation_statistics(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: node_count, edge_count, unique_sources, max_degree, avg_degree, stddev_degree (population), p50, p90, p99 (the degree at place
    floor(N * p) in order), sparsity, max_in_degree, avg_in_degree and multiplicity. Degrees are over all ``nodes``.

    Percentiles come from the histogram of degrees, which is small however large the graph.
    """
    out = degree(edges, nodes)
    into = edges.groupBy("dst").agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n").alias("max_in"))
    hist = out.groupBy("degree").agg(F.count(F.lit(1)).alias("n"))
    upto = hist.withColumn("upto", F.sum("n").over(Window.orderBy("degree")))  # a row per distinct degree
    total = out.agg(
        F.count(F.lit(1)).alias("node_count"), F.coalesce(F.sum("degree"), F.lit(0)).alias("edge_count"), F.count_if(F.col("degree") > 0).alias("unique_sources"),
        F.max("degree").alias("max_degree"), F.avg("degree").alias("avg_degree"), F.stddev_pop("degree").alias("stddev_degree"),
    )
    one = total.join(F.broadcast(into), F.lit(True))
    at = lambda p: F.min(F.when(F.col("upto") > F.floor(F.col("node_count") * p), F.col("degree")))
    pct = upto.join(F.broadcast(total.select("node_count")), F.lit(True)).agg(at(0.5).alias("p50_degree"), at(0.9).alias("p90_degree"), at(0.99).alias("p99_degree"))
    kind = F.concat(F.when(F.col("max_in_degree") <= 1, "1").otherwise("M"), F.lit(":"), F.when(F.col("max_degree") <= 1, "1").otherwise("N"))
    kind = F.when(kind == "M:1", "N:1").otherwise(kind)
    joined = one.join(F.broadcast(pct), F.lit(True)).withColumn("max_in_degree", F.coalesce("max_in", F.lit(0)))
    return joined.select(
        "node_count", "edge_count", "unique_sources", "max_degree", "avg_degree", "stddev_degree", "p50_degree", "p90_degree", "p99_degree",
        (F.col("unique_sources") / F.col("node_count")).alias("sparsity"), "max_in_degree", kind.alias("multiplicity"),
    )


def supernodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, degree) of the nodes with degree at least max(mean + 3 standard deviations, 10)."""
    d = degree(edges, nodes)
    bound = d.agg(F.greatest(F.avg("degree") + 3 * F.stddev_pop("degree"), F.lit(10.0)).alias("_least"))
    return d.join(F.broadcast(bound), F.col("degree") >= F.col("_least")).select("id", "degree")


def attribute_statistics(df: DataFrame, attribute: str, order: str | None = None, distinct_cap: int = 10_000) -> DataFrame:
    """One row: rows, nulls, min_value, max_value, distinct_values (at most ``distinct_cap``), monotonic (NONE, INCREASING, DECREASING or
    CONSTANT in ``order``; null without one). NaN counts as null."""
    kind = dict(df.dtypes)[attribute]
    v = F.when(~F.isnan(attribute), F.col(attribute)) if kind in ("float", "double") else F.col(attribute)
    own = df.select(v.alias("v"), *([F.col(order).alias("o")] if order else []))
    few = own.filter("v IS NOT NULL").select("v").distinct().limit(distinct_cap).agg(F.count(F.lit(1)).alias("distinct_values"))
    base = own.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("v").isNull()).alias("nulls"), F.min("v").alias("min_value"), F.max("v").alias("max_value"))
    out = base.join(F.broadcast(few), F.lit(True))
    if not order:
        return out.withColumn("monotonic", F.lit(None).cast("string"))
    # blocks of the order, each summed up by its first, last and trend; then the blocks' borders: no task sorts all rows
    blocks = materialize(own.filter("v IS NOT NULL").repartitionByRange("o").sortWithinPartitions("o").withColumn("_p", F.spark_partition_id()), "blocks")
    before = F.lag("v").over(Window.partitionBy("_p").orderBy("o"))
    inner = blocks.withColumn("_b", before).groupBy("_p").agg(F.min_by("v", "o").alias("f"), F.max_by("v", "o").alias("l"), F.bool_or(F.col("v") > F.col("_b")).alias("up"), F.bool_or(F.col("v") < F.col("_b")).alias("down"))
    edge = F.lag("l").over(Window.orderBy("_p"))  # a row per block
    trend = inner.withColumn("_l", edge).agg(F.bool_or(F.coalesce(F.col("up"), F.lit(False)) | F.coalesce(F.col("f") > F.col("_l"), F.lit(False))).alias("up"), F.bool_or(F.coalesce(F.col("down"), F.lit(False)) | F.coalesce(F.col("f") < F.col("_l"), F.lit(False))).alias("down"))
    word = F.when(F.col("up") & F.col("down"), "NONE").when(F.col("up"), "INCREASING").when(F.col("down"), "DECREASING").otherwise("CONSTANT")
    return out.join(F.broadcast(trend), F.lit(True)).withColumn("monotonic", word).drop("up", "down")


def approximate_distinct(df: DataFrame, column: str, error: float = 0.02) -> DataFrame:
    """One row (distinct_values), by HyperLogLog."""
    return df.agg(F.approx_count_distinct(column, error).alias("distinct_values"))


def equi_depth(df: DataFrame, column: str, buckets: int = 20, accuracy: int = 10_000) -> DataFrame:
    """(bucket, upper): the values at the places ceil(p n) of the sorted column for p = 1/buckets ... 1, within n / accuracy places."""
    ps = [i / buckets for i in range(1, buckets + 1)]
    got = df.filter(F.col(column).isNotNull()).agg(F.percentile_approx(column, ps, accuracy).alias("u"))
    return got.select(F.posexplode("u").alias("bucket", "upper")).withColumn("bucket", F.col("bucket") + 1)


def equi_depth_exact(df: DataFrame, column: str, buckets: int = 20) -> DataFrame:
    """``equi_depth`` exactly, from the histogram of distinct values."""
    hist = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    # both branches must see the same ranges, so they are written
    parts = materialize(hist.repartitionByRange("v").withColumn("_p", F.spark_partition_id()), "ranges")
    sums = parts.groupBy("_p").agg(F.sum("n").alias("s")).withColumn("base", F.coalesce(F.sum("s").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row per range
    upto = parts.withColumn("inside", F.sum("n").over(Window.partitionBy("_p").orderBy("v"))).join(F.broadcast(sums.select("_p", "base")), "_p").withColumn("upto", F.col("base") + F.col("inside"))
    total = F.broadcast(hist.agg(F.sum("n").alias("_n")))
    # bucket b ends at place ceil(b n / buckets): a value ends those whose places lie among its own
    low, high = F.floor((F.col("upto") - F.col("n")) * buckets / F.col("_n")) + 1, F.floor(F.col("upto") * buckets / F.col("_n"))
    ends = upto.join(total, F.lit(True)).filter(high >= low).select("upto", "v", F.explode(F.sequence(low, high)).alias("bucket"))
    return ends.select(F.col("bucket").cast("int").alias("bucket"), F.col("v").alias("upper"))


def heavy_hitters(df: DataFrame, column: str, k: int) -> DataFrame:
    """(value, count) of the ``k`` most frequent values; ties by value."""
    return df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "value").limit(k)


def heavy_hitters_sketch(df: DataFrame, column: str, k: int, counters: int = 10_000) -> DataFrame:
    """(value, count) by a bounded sketch of ``counters`` counters: counts may be off by rows / counters."""
    got = df.filter(F.col(column).isNotNull()).agg(F.call_function("approx_top_k", F.col(column), F.lit(k), F.lit(counters)).alias("t"))
    return got.select(F.inline("t")).toDF("value", "count")


def degree_sketch(edges: DataFrame, nodes: DataFrame, accuracy: int = 10_000) -> DataFrame:
    """One row: min_degree, max_degree, zeros, p50, p90, p99 (approximate)."""
    d = degree(edges, nodes)
    p = F.percentile_approx("degree", [0.5, 0.9, 0.99], accuracy)
    return d.agg(F.min("degree").alias("min_degree"), F.max("degree").alias("max_degree"), F.count_if(F.col("degree") == 0).alias("zeros"), p.alias("p")).select("min_degree", "max_degree", "zeros", *[F.col("p")[i].alias(n) for i, n in enumerate(("p50", "p90", "p99"))])


def statistics_json(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row (json): the relation's statistics as a document, as a snapshot's metadata keep it."""
    return relation_statistics(edges, nodes).select(F.to_json(F.struct("*")).alias("json"))


def degree_percentile(metadata_json: str | None, p: int) -> int:
    """The degree percentile that such a document holds, -1 if it is unknown."""
    value = json.loads(metadata_json or "{}").get(f"p{p}_degree")
    return -1 if value is None else int(value)


def collect_statistics(snap: GraphSnapshot) -> DataFrame:
    """(kind relation, domain or attribute; name; json) of all that ``snap`` holds, an attribute as <domain or relation>.<attribute>. Domains and relations are
    read once each for all their attributes; distinct values are estimated by HyperLogLog."""
    out = []

    def entry(kind: str, name: str, one: DataFrame) -> None:
        out.append(one.select(F.lit(kind).alias("kind"), F.lit(name).alias("name"), F.to_json(F.struct("*")).alias("json")))

    def attributes(owner: str, df: DataFrame, names: list[str]) -> None:
        plain = [n for n in names if df.schema[n].dataType.typeName() not in ("array", "map", "struct", "variant", "binary")]
        if not plain:
            return
        aggregates = []
        for i, n in enumerate(plain):
            v = F.when(~F.isnan(n), F.col(n)) if dict(df.dtypes)[n] in ("float", "double") else F.col(n)
            aggregates.append(F.struct(F.lit(f"{owner}.{n}").alias("name"), F.struct(F.count(F.lit(1)).alias("rows"), F.count_if(v.isNull()).alias("nulls"), F.min(v).cast("string").alias("min_value"), F.max(v).cast("string").alias("max_value"), F.approx_count_distinct(v).alias("distinct_values")).alias("s")).alias(f"a{i}"))
        one = df.agg(*aggregates)
        found = one.select(F.inline(F.array(*[f"a{i}" for i in range(len(plain))])))
        out.append(found.select(F.lit("attribute").alias("kind"), "name", F.to_json("s").alias("json")))

    for d in snap.domains.values():
        entry("domain", d.name, d.nodes.agg(F.count(F.lit(1)).alias("node_count"), F.approx_count_distinct("key").alias("distinct_keys")))
        attributes(d.name, d.nodes, [c for c in d.nodes.columns if c not in ("id", "key")])
    for r in snap.relations.values():
        entry("relation", r.name, relation_statistics(r.edges, snap.domain_of(r.source).nodes))
        attributes(r.name, r.edges, r.attributes())
    return reduce(DataFrame.unionByName, out)


class GraphStatistics:
    """Collected statistics by name: as it is written, else in whatever case, else as what follows the last . or _ of a name. Several that fit raise
    KeyError, as does none."""

    def __init__(self, collected: DataFrame) -> None:
        self.by_kind: dict[str, dict[str, dict]] = {}
        for kind, name, text in collected.collect():  # a row per catalog entry
            self.by_kind.setdefault(kind, {})[name] = json.loads(text)

    def find(self, kind: str, name: str) -> dict:
        have = self.by_kind.get(kind, {})
        if name in have:
            return have[name]
        low = name.lower()
        for fits in ([n for n in have if n.lower() == low], [n for n in have if n.lower().endswith((f".{low}", f"_{low}"))]):
            if len(fits) > 1:
                raise KeyError(f"{kind} {name} may be {', '.join(sorted(fits))}")
            if fits:
                return have[fits[0]]
        raise KeyError(f"no statistics of the {kind} {name}")

    def relation(self, name: str) -> dict:
        return self.find("relation", name)

    def domain(self, name: str) -> dict:
        return self.find("domain", name)

    def attribute(self, name: str) -> dict:
        return self.find("attribute", name)
