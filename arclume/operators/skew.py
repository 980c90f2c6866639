"""Per-key work without stragglers: keys are packed to tasks by load, large keys are split, and the matching side follows."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arclume.functions.keys import with_canonical_edges
from arclume.session import default_tasks, materialize


@dataclass(frozen=True)
class Plan:
    """Where the rows go: ``units`` (_unit, _task) for the light keys' hash units, ``large`` (key, _shards) for the
    split keys, ``shards`` (key, _shard, _task). All are bounded by the number of units and tasks, not by the data."""

    tasks: int
    n_units: int
    units: DataFrame
    large: DataFrame
    shards: DataFrame
    loads: list[float]
    n_large: int


def pack(loads: Sequence[tuple[object, float]], tasks: int) -> dict[object, int]:
    """Longest first, each to the task with the least load so far."""
    heap = [(0.0, t) for t in range(tasks)]
    out = {}
    for name, load in sorted(loads, key=lambda x: (-x[1], str(x[0]))):
        least, t = heapq.heappop(heap)
        out[name] = t
        heapq.heappush(heap, (least + load, t))
    return out


#: Hash units of the light keys: so many a task, but no more in all than MANY_UNITS or twice the tasks, whichever is more.
UNITS_PER_TASK, MANY_UNITS = 16, 1 << 20


def plan_fragments(left: DataFrame, key: Sequence[str], tasks: int | None = None) -> Plan:
    """Estimate the load of every key of ``left`` and pack the keys to tasks.

    Keys are hashed to units, whose rows are counted (one small row per unit reaches the driver). Only in units
    above the capacity of a task the keys themselves are counted, to find the large ones: those with more than half a task's
    share, at most ``2 * tasks`` of them. They become shards in proportion to their rows; the rest stays whole. Without ``tasks`` their number
    follows the rows, which are counted first.
    """
    spark, key = left.sparkSession, list(key)
    tasks = tasks or default_tasks(spark, left.count())
    n_units = max(2 * tasks, min(MANY_UNITS, tasks * UNITS_PER_TASK))
    unit = F.pmod(F.xxhash64(*key), F.lit(n_units)).cast("int")
    loads = {r[0]: r[1] for r in left.groupBy(unit.alias("_unit")).count().collect()}  # at most n_units rows
    total = sum(loads.values())
    share = max(1.0, total / tasks)
    full = [u for u, n in loads.items() if n > share / 2]
    large: list = []
    if full:
        counted = left.withColumn("_unit", unit).filter(F.col("_unit").isin(full)).groupBy("_unit", *key).count().filter(F.col("count") > share / 2)
        large = counted.collect()  # each has over half a share, so at most 2 * tasks rows
    work: list[tuple[object, float]] = []
    for r in large:
        n = -(-int(r["count"]) // max(1, int(share / 2)))
        loads[r["_unit"]] -= r["count"]
        work += [((tuple(r[k] for k in key), i), r["count"] / n) for i in range(n)]
    work += [(u, n) for u, n in loads.items() if n > 0]
    at = pack(work, tasks)
    per_task = [0.0] * tasks
    for name, load in work:
        per_task[at[name]] += load
    types = ", ".join(f"`{k}` {t}" for k, t in left.select(*key).dtypes)
    split: dict[tuple, int] = {}
    for name, _ in work:
        if isinstance(name, tuple):
            split[name[0]] = max(split.get(name[0], 0), name[1] + 1)
    return Plan(
        tasks,
        n_units,
        spark.createDataFrame([(u, t) for u, t in at.items() if not isinstance(u, tuple)], "_unit int, _task int"),
        spark.createDataFrame([(*k, n) for k, n in split.items()], f"{types}, _shards int"),
        spark.createDataFrame([(*u[0], u[1], t) for u, t in at.items() if isinstance(u, tuple)], f"{types}, _shard int, _task int"),
        per_task,
        len(split),
    )


def fragment(left: DataFrame, key: Sequence[str], spread: Sequence[str], plan: Plan) -> DataFrame:
    """``left`` with ``_task``, its rows at that task. Rows with equal ``key`` and ``spread`` stay together.

    The plan's tables are bounded (see there), so they are broadcast.
    """
    key = list(key)
    same = lambda a, b: [a[k].eqNullSafe(b[f"_k{i}"]) for i, k in enumerate(key)]
    named = lambda df: df.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(key)})
    unit = F.pmod(F.xxhash64(*key), F.lit(plan.n_units)).cast("int")
    large = named(plan.large)
    out = left.withColumn("_unit", unit).join(F.broadcast(large), same(left, large), "left")
    out = out.drop(*[f"_k{i}" for i in range(len(key))])
    out = out.withColumn("_shard", F.when(F.col("_shards").isNotNull(), F.pmod(F.xxhash64(*key, *spread), F.col("_shards")).cast("int")))
    units = plan.units.withColumnRenamed("_unit", "_u").withColumnRenamed("_task", "_ut")
    shards = named(plan.shards).withColumnRenamed("_shard", "_s").withColumnRenamed("_task", "_st")
    out = out.join(F.broadcast(units), F.col("_unit") == F.col("_u"), "left")
    out = out.join(F.broadcast(shards), [*[out[k].eqNullSafe(shards[f"_k{i}"]) for i, k in enumerate(key)], out["_shard"] == shards["_s"]], "left")
    out = out.withColumn("_task", F.coalesce("_st", "_ut", F.lit(0)))
    out = out.drop("_unit", "_u", "_ut", "_s", "_st", "_shards", *[f"_k{i}" for i in range(len(key))])
    return out.repartitionById(plan.tasks, F.col("_task"))


def replicate(right: DataFrame, targets: DataFrame, on: Sequence[str], plan: Plan) -> DataFrame:
    """``right``, each row at every task that ``targets`` (``on``, _task) names for its key and at no other."""
    return right.join(targets.select(*on, "_task").distinct(), list(on)).repartitionById(plan.tasks, F.col("_task"))


def live_degrees(edges: DataFrame, loaded: DataFrame, relations: DataFrame, domains: DataFrame, tasks: int | None = None) -> DataFrame:
    """Live out-degree of every (relation_id, src_key) against its relation's edge count.

    An edge is live if the last delta of (relation, source, target), in the order of the deltas' smallest offsets, is
    an insert. Comes out as (relation_id, src_key canonical, degree, edge_count, share); sources without live
    edges have degree 0; edge_count is the sum of the known counts, each snapshot once, and null where none is known.
    Rows without a known relation or without source key belong to no source; those without a target key are no edge.

    Load: sources are packed to tasks by their deltas; the deltas of a large source are split by target, and those of a large pair of source and
    target by delta, so a task gets at most about its share. What the tasks found of such a pair, a row each, is brought together
    afterwards. The edge counts go to the tasks that hold sources of the relation.
    """
    needed = edges.select("relation_id", "src_key", "tgt_key", "delta_id", "kafka_offset", "op")
    keyed = with_canonical_edges(needed, relations, domains).filter(F.col("src").isNotNull()).select("relation_id", "src", "tgt", "delta_id", "kafka_offset", F.when(F.col("op") == "I", 1).otherwise(0).alias("_on"))
    keyed = materialize(keyed, "keyed")
    source, pair = ["relation_id", "src"], ["relation_id", "src", "tgt"]
    plan = plan_fragments(keyed, source, tasks)
    # pairs with more than half a task's share: at most 2 * tasks of them, all of large sources
    share = max(1.0, sum(plan.loads) / plan.tasks)
    large = plan.large.select(*[F.col(c).alias(f"_{c}") for c in source])
    counted = keyed.join(F.broadcast(large), [F.col(c) == F.col(f"_{c}") for c in source], "left_semi").groupBy(*pair).count().filter(F.col("count") > share / 2)
    found = counted.select(*pair).collect() if plan.n_large else []
    if not found:
        spread = keyed.withColumn("_hot", F.lit(False))
    else:
        hot = keyed.sparkSession.createDataFrame(found, keyed.select(*pair).schema).withColumnsRenamed({c: f"_{c}" for c in pair})
        spread = keyed.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in pair], "left").drop(*[f"_{c}" for c in pair]).withColumn("_hot", F.coalesce("_hot", F.lit(False)))
    spread = spread.withColumn("_by", F.when(F.col("_hot"), F.xxhash64("tgt", "delta_id")).otherwise(F.xxhash64("tgt")))
    here = fragment(spread, source, ["_by"], plan)
    once = here.groupBy("_task", *pair, "_hot", "delta_id").agg(F.min(F.col("kafka_offset") * 2 + F.col("_on")).alias("_at"))
    last = once.groupBy("_task", *pair, "_hot").agg(F.max("_at").alias("_at"))
    if found:  # a hot pair has a row for each of its tasks; the last of them counts, at one of them
        last = materialize(last, "last")
        joined = last.filter("_hot").groupBy(*pair, "_hot").agg(F.min("_task").alias("_task"), F.max("_at").alias("_at"))
        last = last.filter("NOT _hot").unionByName(joined.select(*last.columns))
    part = last.groupBy("_task", *source).agg(F.sum(F.when(F.col("tgt").isNotNull() & (F.col("_at") % 2 == 1), 1).otherwise(0)).alias("degree"))
    counts = loaded.filter(F.col("edge_count") >= 0).groupBy("snapshot_id", "relation_id").agg(F.max("edge_count").alias("edge_count")).groupBy("relation_id").agg(F.sum("edge_count").alias("edge_count"))
    part = materialize(part, "degrees")
    sent = replicate(counts, part.select("relation_id", "_task"), ["relation_id"], plan)
    met = part.repartitionById(plan.tasks, F.col("_task")).join(sent.withColumnRenamed("relation_id", "_r").withColumnRenamed("_task", "_t"), (F.col("_task") == F.col("_t")) & (F.col("relation_id") == F.col("_r")), "left")
    whole = met.groupBy("relation_id", F.col("src").alias("src_key")).agg(F.sum("degree").alias("degree"), F.max("edge_count").alias("edge_count"))
    return whole.withColumn("share", F.col("degree") / F.when(F.col("edge_count") > 0, F.col("edge_count")))


def fragment_replicate_join(left: DataFrame, right: DataFrame, on: Sequence[str], spread: Sequence[str], tasks: int | None = None, how: str = "inner", each: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Equi-join of a skewed ``left`` with ``right`` (inner or left), by estimated load.

    A large key's rows are split by ``spread`` into shards; the right rows of that key go to its shards' tasks only,
    those of other keys to the one task of the key. Null keys match nothing (left rows of them stay in a left
    join). ``each`` is applied to the joined rows, which hold ``_task``; else that column is dropped. Columns of ``right``
    that clash with ``left`` other than ``on`` get the suffix ``_right``.
    """
    if how not in ("inner", "left"):
        raise ValueError("how is inner or left")
    on = list(on)
    plan = plan_fragments(left, on, tasks)
    here = fragment(left, on, spread, plan)
    clash = [c for c in right.columns if c in left.columns and c not in on]
    right = right.withColumnsRenamed({c: f"{c}_right" for c in clash})
    unit = F.pmod(F.xxhash64(*on), F.lit(plan.n_units)).cast("int")
    large = plan.shards.select(*on, F.col("_task").alias("_st")).distinct().withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(on)})
    sent = right.withColumn("_unit", unit).join(F.broadcast(plan.units.withColumnRenamed("_task", "_ut")), "_unit", "left")
    sent = sent.join(F.broadcast(large), [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(on)], "left")
    sent = sent.withColumn("_t", F.coalesce("_st", "_ut", F.lit(0))).drop("_unit", "_ut", "_st", *[f"_k{i}" for i in range(len(on))])
    sent = sent.withColumnsRenamed({k: f"_r{i}" for i, k in enumerate(on)}).repartitionById(plan.tasks, F.col("_t"))
    joined = here.join(sent, [here["_task"] == sent["_t"], *[here[k] == sent[f"_r{i}"] for i, k in enumerate(on)]], how)
    joined = joined.drop("_t", "_shard", *[f"_r{i}" for i in range(len(on))])
    return each(joined) if each else joined.drop("_task")
