"""The most frequent values of a column, by a three-phase threshold algorithm over the nodes' local counts."""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arclume.session import materialize

#: Values that one node counts at most; a node that meets more closes its counts and goes on as another node.
LOCAL_VALUES = 1 << 20


def local_counts(df: DataFrame, columns: Sequence[str], leaders: int, max_values: int = LOCAL_VALUES) -> DataFrame:
    """Counts of the values of ``columns`` on each node: (columns, n, node_rows, leader, below, first).

    A node is a part of the input that one task reads, or of it what fits ``max_values`` distinct values, so
    memory is bounded. ``leader`` marks the node's ``leaders`` most frequent values, and all that tie with the last; no other value of
    the node occurs more than ``below`` times there. ``first`` marks one row of each node.
    """
    columns = list(columns)
    schema = df.select(*columns).schema.add("n", "long").add("node_rows", "long").add("leader", "boolean").add("below", "long").add("first", "boolean")

    def count(batches):  # noqa: ANN001, ANN202
        import numpy as np
        import pyarrow.compute as pc

        held: list = []
        rows = kept = 0

        def fold() -> pa.Table:
            whole = pa.concat_tables(held)
            if whole.num_rows == 0:
                return whole
            return whole.group_by(columns).aggregate([("n", "sum")]).rename_columns([*columns, "n"])

        def close(whole: pa.Table):  # noqa: ANN202
            n = whole["n"].combine_chunks() if whole.num_rows else whole["n"]
            least = 0
            if whole.num_rows > leaders:
                least = int(np.partition(n.to_numpy(zero_copy_only=False), -leaders)[-leaders])
            size = whole.num_rows
            whole = whole.append_column("node_rows", pa.array(np.full(size, rows))).append_column("leader", pc.greater_equal(whole["n"], int(least)))
            whole = whole.append_column("below", pa.array(np.full(size, max(0, least - 1)))).append_column("first", pa.array(np.arange(size) == 0))
            return whole.combine_chunks().to_batches(max_chunksize=50_000)

        for b in batches:
            t = pa.Table.from_batches([b])
            t = t.append_column("n", pa.array([1] * t.num_rows, pa.int64())) if t.num_rows else t.append_column("n", pa.array([], pa.int64()))
            held.append(t.group_by(columns).aggregate([("n", "sum")]).rename_columns([*columns, "n"]))
            rows += b.num_rows
            kept += held[-1].num_rows
            if kept > max_values:
                held[:] = [fold()]
                kept = held[0].num_rows
                if kept > max_values // 2:
                    yield from close(held[0])
                    held.clear()
                    rows = kept = 0
        if held:
            yield from close(fold())

    return df.select(*columns).mapInArrow(count, schema)


def frequent_values(df: DataFrame, columns: Sequence[str], k: int | None = None, min_share: float | None = None) -> DataFrame:
    """The values of ``columns`` with their exact counts: (columns, n; n_ if one of them is called n).

    ``k``: the k most frequent (ties by the values' order); ``min_share``: all with at least this share of all rows;
    both: the k most frequent of those. Rows with a null in ``columns`` count for the base of ``min_share`` but
    are no values. An empty table has none.

    Phase 1: nodes count locally and send their leaders. A value's leading counts sum up to a lower bound of its count; with what a node's other
    values have at most, for the nodes that it does not lead, to an upper bound. The k-th largest lower bound, or the share, is the count t
    that a result needs. Phase 2: leaders whose upper bound reaches t are fetched. Others matter only if what the nodes' other values have at
    most sums up to t: then those are fetched that are above their node's share t * (node's rows / all rows), as any result is on some
    node. Phase 3: the counts of what was fetched are summed over all nodes. Rare values stay on their nodes, as local counts in the shared folder.
    """
    if k is None and min_share is None:
        raise ValueError("k or min_share is needed")
    names = list(columns)
    columns = [f"_c{i}" for i in range(len(names))]  # no clash with the columns added here
    df = df.select(*[F.col(n).alias(c) for n, c in zip(names, columns)])
    leaders = max(1, min(k or 1 << 30, int(1 / min_share) + 1 if min_share else 1 << 30))
    counts = materialize(local_counts(df, columns, leaders), "counts")
    full = F.lit(True)
    for c in columns:
        full = full & F.col(c).isNotNull()
    rows, others = counts.agg(F.sum("n"), F.sum(F.when(F.col("first"), F.col("below")))).first()
    total, others = rows or 0, others or 0
    values = counts.filter(full)
    leading = materialize(values.filter("leader").groupBy(*columns).agg(F.sum("n").alias("low"), (F.sum(F.col("n") - F.col("below")) + others).alias("high")), "leaders")
    least = max(1.0, min_share * total) if min_share else 1.0
    if k is not None:
        kth = leading.select("low").orderBy(F.desc("low")).limit(k).agg(F.min("low"), F.count("low")).first()
        if kth[1] == k:
            least = max(least, float(kth[0]))
    need = F.lit(least * (1 - 1e-12))
    fetched = leading.filter(F.col("high") >= need).select(*columns)
    if others >= least * (1 - 1e-12):
        above = F.col("n") * F.lit(float(max(total, 1))) >= need * F.col("node_rows")
        fetched = fetched.unionByName(values.filter(~F.col("leader") & above).select(*columns)).distinct()
    exact = values.join(fetched, columns, "left_semi").groupBy(*columns).agg(F.sum("n").alias("n"))
    if min_share:
        part = Fraction(min_share).limit_denominator(1_000_000)  # whole numbers: no rounding at the border
        exact = exact.filter(F.col("n") * part.denominator >= F.lit(part.numerator * total))
    if k is not None:
        exact = exact.orderBy(F.desc("n"), *columns).limit(k)
    return exact.select(*[F.col(c).alias(n) for n, c in zip(names, columns)], F.col("n").alias("n_" if "n" in names else "n"))


def edge_sources(spark: SparkSession, edges: DataFrame, relations: DataFrame, domains: DataFrame) -> DataFrame:
    """All delivered rows as (relation_id, src_key): canonical source keys of the catalog's relations, else nulls."""
    from arclume.functions.keys import with_canonical_edges

    rows = with_canonical_edges(edges.select("relation_id", "src_key"), relations, domains, ("src",), "left")
    known = F.col("src_domain").isNotNull()
    return rows.select(F.when(known, F.col("relation_id")).alias("relation_id"), F.when(known, F.col("src")).alias("src_key"))
