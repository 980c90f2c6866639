"""Degrees, neighbours, products of relations with vectors, and sampling: operators on one edge table (src, dst, ...)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arclume.session import default_tasks, materialize

#: Modulus and multipliers of the linear congruential hash that sampling draws by; products stay within 64 bits.
LCG, LCG_A, LCG_B, LCG_C = 2_147_483_647, 48_271, 16_807, 69_621


def draw(a: Column, b: Column, seed: int) -> Column:
    """A whole number from 0 to LCG - 1, the same for the same numbers everywhere, in SQL too."""
    mixed = (F.pmod(a, F.lit(LCG)) * LCG_A + F.pmod(b, F.lit(LCG)) * LCG_B + seed) % LCG
    return mixed * LCG_C % LCG


def degree(edges: DataFrame, nodes: DataFrame, direction: str = "out") -> DataFrame:
    """(id, degree) of all ``nodes`` (id), 0 without edges; parallel edges count."""
    end = "src" if direction == "out" else "dst"
    counts = edges.groupBy(F.col(end).alias("_id")).agg(F.count(F.lit(1)).alias("_n"))
    return nodes.select("id").join(counts, F.col("id") == F.col("_id"), "left").select("id", F.coalesce("_n", F.lit(0)).alias("degree"))


def ranked(edges: DataFrame, key: str, by: str, name: str = "position", tasks: int | None = None) -> DataFrame:
    """``edges`` with the place (from 1) of every row among those of the same ``key`` in the order of ``by``.

    Rows are cut into ranges of (key, by), so a hub's rows lie in many tasks; each range is numbered on its own, and what a key has in the
    ranges before is added. Only the keys at the borders of ranges lie in several: one a range, which is broadcast.
    """
    n = tasks or default_tasks(edges.sparkSession)
    parts = materialize(edges.repartitionByRange(n, key, by).withColumn("_part", F.spark_partition_id()), "ranges")
    ends = parts.groupBy("_part").agg(F.min(key).alias("_a"), F.max(key).alias("_b"))
    border = ends.select(F.explode(F.array("_a", "_b")).alias("_key")).groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_key")
    held = parts.join(F.broadcast(border), F.col(key).eqNullSafe(F.col("_key"))).groupBy(F.col("_part").alias("_p"), "_key").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy("_key").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    held = held.select("_p", "_key", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part", key).orderBy(by))
    placed = parts.withColumn("_own", own).join(F.broadcast(held), (F.col("_part") == F.col("_p")) & F.col(key).eqNullSafe(F.col("_key")), "left")
    return placed.withColumn(name, F.col("_own") + F.coalesce("_before", F.lit(0)).cast("long")).drop("_part", "_own", "_p", "_key", "_before")


def neighbors(edges: DataFrame, direction: str = "out") -> DataFrame:
    """(id, position, neighbor): the neighbours of every node in ascending order, parallel edges kept. One row per edge, and a hub's edges are
    numbered by many tasks."""
    a, b = ("src", "dst") if direction == "out" else ("dst", "src")
    return ranked(edges.select(F.col(a).alias("id"), F.col(b).alias("neighbor")), "id", "neighbor").select("id", "position", "neighbor")


def pull(edges: DataFrame, frontier: DataFrame, unvisited: DataFrame) -> DataFrame:
    """Nodes of ``unvisited`` with an in-neighbour in ``frontier``: the bottom-up walk."""
    open_ = edges.join(unvisited.select(F.col("id").alias("_u")), F.col("dst") == F.col("_u"), "left_semi")
    return open_.join(frontier.select(F.col("id").alias("_f")), F.col("src") == F.col("_f"), "left_semi").select(F.col("dst").alias("id")).distinct()


def is_subset(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (stable boolean): whether every id of ``a`` is in ``b``."""
    return a.select("id").join(b.select("id"), "id", "left_anti").limit(1).groupBy().agg((F.count(F.lit(1)) == 0).alias("stable"))


#: Semirings: how an edge and a value meet, how the results of a node add up, what a node without edges has.
SEMIRINGS: dict[str, tuple[Callable[[Column, Column], Column], Callable[[Column], Column], Column | float | None]] = {
    "plus_times": (lambda w, x: w * x, F.sum, 0.0),
    "min_plus": (lambda w, x: w + x, F.min, None),
    "max_min": (lambda w, x: F.least(w, x), F.max, None),
    "or_and": (lambda w, x: (w != 0) & (x != 0), F.bool_or, None),
}


def semiring_product(edges: DataFrame, x: DataFrame, nodes: DataFrame, semiring: str = "plus_times", weight: str | None = None, transposed: bool = False) -> DataFrame:
    """(id, value): y[u] = add over the edges (u, v) of mul(weight, x[v]); transposed the other way round. Missing weights are 1."""
    mul, add, zero = SEMIRINGS[semiring]
    a, b = ("dst", "src") if transposed else ("src", "dst")
    w = F.coalesce(F.col(weight), F.lit(1.0)) if weight else F.lit(1.0)
    rows = edges.join(x.select(F.col("id").alias("_v"), F.col("value").alias("_x")), F.col(b) == F.col("_v"))
    sums = rows.groupBy(F.col(a).alias("_u")).agg(add(mul(w, F.col("_x"))).alias("_y"))
    y = F.col("_y") if zero is None else F.coalesce(F.col("_y"), F.lit(zero))
    return nodes.select("id").join(sums, F.col("id") == F.col("_u"), "left").select("id", y.alias("value"))


def elementwise(a: DataFrame, b: DataFrame, op: str, union: bool) -> DataFrame:
    """(id, value): ``op`` (add, mul, min, max, div) of two vectors, over the ids of either (``union``: the other is taken as it is) or of both."""
    f = {"add": lambda x, y: x + y, "mul": lambda x, y: x * y, "min": F.least, "max": F.greatest, "div": lambda x, y: F.when(y == 0, x).otherwise(F.try_divide(x, y))}[op]
    l, r = a.select("id", F.col("value").alias("_x")), b.select("id", F.col("value").alias("_y"))
    both = l.join(r, "id", "full_outer" if union else "inner")
    v = F.when(F.col("_x").isNull(), F.col("_y")).when(F.col("_y").isNull(), F.col("_x")).otherwise(f(F.col("_x"), F.col("_y"))) if union else f(F.col("_x"), F.col("_y"))
    return both.select("id", v.alias("value"))


def scale(a: DataFrame, by: float) -> DataFrame:
    return a.select("id", (F.col("value") * by).alias("value"))


def l1_distance(a: DataFrame, b: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """One row (distance, converged): the sum of the absolute differences."""
    both = a.select("id", F.col("value").alias("_x")).join(b.select("id", F.col("value").alias("_y")), "id", "full_outer")
    d = F.coalesce(F.sum(F.abs(F.coalesce("_x", F.lit(0.0)) - F.coalesce("_y", F.lit(0.0)))), F.lit(0.0))
    return both.agg(d.alias("distance")).withColumn("converged", F.col("distance") < tolerance)


def assert_finite(a: DataFrame, column: str = "value") -> DataFrame:
    """``a``, or an ArithmeticError that names the first id whose value is NaN or infinite."""
    bad = a.filter(F.isnan(column) | (F.abs(column) == float("inf"))).agg(F.min("id")).first()[0]
    if bad is not None:
        raise ArithmeticError(f"the value at {bad} is not finite")
    return a


def sample_neighbors(edges: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """Up to ``k`` edges (src, dst) of every source, the same for the same seed: those whose draw by seed and ends is least, then by dst. Each task keeps
    its ``k`` least of a source before the shuffle (the planner's group limit), so that a hub is no burden."""
    rn = F.row_number().over(Window.partitionBy("src").orderBy(draw(F.col("src"), F.col("dst"), seed), "dst"))
    return edges.withColumn("_rn", rn).filter(F.col("_rn") <= k).drop("_rn")


def random_walk(edges: DataFrame, starts: DataFrame, length: int, seed: int = 0) -> DataFrame:
    """(start, step, id): from every start a walk of up to ``length`` steps, each to a neighbour drawn by seed, start and step; a walk ends at a
    sink. The same seed gives the same walks; parallel edges count, repeated starts don't.

    The edges of every source are numbered once; a step draws a number up to the degree and joins on source and number, so a walker costs
    one row at a hub too.
    """
    placed = materialize(neighbors(edges), "places")
    degrees = materialize(placed.groupBy(F.col("id").alias("_d")).agg(F.max("position").alias("_n")), "degrees")
    at = materialize(starts.select(F.col("id").alias("start"), F.lit(0).alias("step"), F.col("id")).distinct(), "walk")
    out = [at]
    for n in range(1, length + 1):
        choice = at.join(degrees, F.col("id") == F.col("_d")).select("start", F.col("id").alias("_at"), (draw(F.col("start"), F.lit(n), seed) % F.col("_n") + 1).alias("_place"))
        nxt = choice.join(placed, (F.col("_at") == F.col("id")) & (F.col("_place") == F.col("position")))
        at = materialize(nxt.select("start", F.lit(n).alias("step"), F.col("neighbor").alias("id")), "walk")
        out.append(at)
    return reduce(DataFrame.unionByName, out)
