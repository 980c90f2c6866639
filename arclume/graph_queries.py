"""Queries of the graph operators over the test tables, and SQL for each."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arclume import api
from arclume.functions.keys import with_canonical_edges, with_canonical_nodes
from arclume.operators import algorithms, statistics, walks
from arclume.oracle import edges_sql, nodes_sql
from arclume.plans import sexpr
from arclume.session import materialize, reusable, shared_dir
from arclume.sources import binary
from arclume.sources.snapshot import GraphSnapshot, dense_ids, import_edges, import_typed, load_manifest, load_snapshot
from arclume.sources.tables import table, tables, write_text
from arclume.streaming import deltas

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def graph(spark: SparkSession, at: str) -> GraphSnapshot:
    """Customers, orders, parts, suppliers, nations, regions, users and events as domains; what links them as relations."""
    t = lru_cache(lambda n: table(spark, at, n))  # each table is looked at once
    users = t("events").select(F.col("user_id").alias("id")).distinct()
    g = GraphSnapshot(spark)
    for name, nodes, key in (
        ("Customer", t("customer"), "c_custkey"), ("Order", t("orders"), "o_orderkey"), ("Part", t("part"), "p_partkey"), ("Supplier", t("supplier"), "s_suppkey"),
        ("Nation", t("nation"), "n_nationkey"), ("Region", t("region"), "r_regionkey"), ("User", users, "id"), ("Event", t("events"), "event_id"),
    ):
        g = g.with_domain(name, nodes, key)
    line = t("lineitem")
    g = g.with_relation("PLACED", "Customer", "Order", t("orders"), "o_custkey", "o_orderkey", "1:N")
    g = g.with_relation("CONTAINS", "Order", "Part", line, "l_orderkey", "l_partkey")
    g = g.with_relation("SHIPPED_BY", "Order", "Supplier", line, "l_orderkey", "l_suppkey")
    g = g.with_relation("SUPPLIES", "Supplier", "Part", line, "l_suppkey", "l_partkey")
    g = g.with_relation("LIVES_IN", "Customer", "Nation", t("customer"), "c_custkey", "c_nationkey", "N:1")
    g = g.with_relation("BASED_IN", "Supplier", "Nation", t("supplier"), "s_suppkey", "s_nationkey", "N:1")
    g = g.with_relation("IN_REGION", "Nation", "Region", t("nation"), "n_nationkey", "n_regionkey", "N:1")
    kinds = ("click", "error", "purchase", "signup", "view")
    for k in kinds:
        g = g.with_relation(f"PERFORMED_{k}", "User", "Event", t("events").filter(F.col("event_type") == k), "user_id", "event_id", "1:N")
    return g.with_virtual_relation("PERFORMED", [f"PERFORMED_{k}" for k in kinds]).with_label("bulk", "edge.l_quantity > 40").with_label("cheap", "node.p_retailprice < 950")


def seeded(domain: str, sql: str) -> Callable:
    """Adds a query of a walk from all of ``domain`` with its SQL."""

    def add(f: Callable[..., DataFrame]) -> Callable:
        def whole(spark: SparkSession, at: str) -> DataFrame:
            g = graph(spark, at)
            return f(g, g.domain(domain).all())

        query(sql, f.__name__)(whole)
        return f

    return add


def links(spark: SparkSession, at: str) -> tuple[DataFrame, DataFrame]:
    """(src, dst, weight) from the part of each line of an order to that of the next, and all parts. Linear in lines, whichever way keys go: a graph with
    cycles and loops that grows with the tables."""
    line = table(spark, at, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("src"))
    follows = F.lead("src").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "src"))
    edges = line.withColumn("dst", follows).filter("src IS NOT NULL AND dst IS NOT NULL").groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return reusable(edges, "links"), table(spark, at, "part").select(F.col("p_partkey").alias("id"))


LINKS = """e AS MATERIALIZED (SELECT src, dst, CAST(count(*) AS DOUBLE) AS weight FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS dst FROM lineitem)
WHERE src IS NOT NULL AND dst IS NOT NULL GROUP BY ALL), v AS MATERIALIZED (SELECT p_partkey AS id FROM part), u AS MATERIALIZED (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e),
s AS MATERIALIZED (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e WHERE src <> dst)"""


def unrolled(name: str, first: str, step: str, rounds: int) -> str:
    """SQL of a loop that runs ``rounds`` times: ``step`` with {i}, its number, and {p}, the table before."""
    return ", ".join([f"{name}0 AS MATERIALIZED ({first})"] + [f"{name}{i} AS MATERIALIZED ({step.format(i=i, p=f'{name}{i - 1}')})" for i in range(1, rounds + 1)])


# walks


@query("SELECT DISTINCT l_partkey AS id FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = 7 AND l_quantity > 25")
def walk_2hop_filtered(spark: SparkSession, at: str) -> DataFrame:
    return graph(spark, at).domain("Customer").from_(7).out("PLACED").out("CONTAINS", "edge.l_quantity > 25").df()


@seeded("Customer", "SELECT DISTINCT l_partkey AS id FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def walk_fused_2hop(g: GraphSnapshot, start: api.Traversal) -> DataFrame:
    return start.out2("PLACED", "CONTAINS").df()


@query("SELECT DISTINCT o_custkey AS id FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_partkey = 11")
def walk_reverse(spark: SparkSession, at: str) -> DataFrame:
    return graph(spark, at).domain("Part").from_(11).in_("CONTAINS").in_("PLACED").df()


@query("""WITH p AS (SELECT DISTINCT l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = 7),
o AS (SELECT DISTINCT l_orderkey FROM lineitem JOIN p USING (l_partkey)) SELECT DISTINCT o_custkey AS id FROM orders JOIN o ON l_orderkey = o_orderkey""")
def walk_4hop_metapath(spark: SparkSession, at: str) -> DataFrame:
    return graph(spark, at).domain("Customer").from_(7).out("PLACED").out("CONTAINS").in_("CONTAINS").in_("PLACED").df()


@query("SELECT DISTINCT o_custkey AS seed, l_suppkey AS id FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_shipdate >= TIMESTAMP '1998-01-01'")
def screen_all_customers(spark: SparkSession, at: str) -> DataFrame:
    g = graph(spark, at)
    start = g.domain("Customer").batch(g.domain_of("Customer").nodes)
    return start.out("PLACED").out("SHIPPED_BY", "edge.l_shipdate >= 883612800000000").df()


@query("""WITH f AS (SELECT DISTINCT o_custkey AS seed, l_partkey AS p FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity >= 50),
b AS (SELECT DISTINCT seed, l_suppkey AS s FROM f JOIN lineitem ON l_partkey = p AND l_discount = 0.0), n AS (SELECT DISTINCT seed, s_nationkey AS n FROM b JOIN supplier ON s_suppkey = s)
SELECT DISTINCT seed, n_regionkey AS id FROM n JOIN nation ON n_nationkey = n""")
def screen_5hop_regions(spark: SparkSession, at: str) -> DataFrame:
    g = graph(spark, at)
    start = g.domain("Customer").batch(g.domain_of("Customer").nodes)
    return start.out("PLACED").out("CONTAINS", "edge.l_quantity >= 50").in_("SUPPLIES", "edge.l_discount == 0.0").out("BASED_IN").out("IN_REGION").df()


@seeded("Customer", "SELECT DISTINCT l_partkey AS id FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE l_quantity > 40 AND p_retailprice < 950")
def walk_labelled(g: GraphSnapshot, start: api.Traversal) -> DataFrame:
    return start.out("PLACED").label("bulk", "CONTAINS").label("cheap").df()


@query("SELECT o_orderkey AS id FROM orders WHERE o_custkey IN (3, 5, 8) UNION SELECT l_orderkey FROM lineitem WHERE l_partkey = 4")
def seeds_union(spark: SparkSession, at: str) -> DataFrame:
    g = graph(spark, at)
    return g.domain("Customer").from_(3, 5, 8).out("PLACED").union(g.domain("Part").from_(4).in_("CONTAINS")).df()


def _parts_of(g: GraphSnapshot, c: int) -> api.Traversal:
    return g.domain("Customer").from_(c).out("PLACED").out("CONTAINS")


_PARTS = "SELECT l_partkey AS id FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = {}"


@query(f"{_PARTS.format(7)} INTERSECT {_PARTS.format(11)}")
def mutual_intersect(spark: SparkSession, at: str) -> DataFrame:
    g = graph(spark, at)
    return _parts_of(g, 7).intersect(_parts_of(g, 11)).df()


@query(f"{_PARTS.format(7)} EXCEPT {_PARTS.format(11)}")
def exclusive_difference(spark: SparkSession, at: str) -> DataFrame:
    g = graph(spark, at)
    return _parts_of(g, 7).difference(_parts_of(g, 11)).df()


@query(f"SELECT NOT EXISTS ({_PARTS.format(7)} EXCEPT SELECT p_partkey FROM part) AS stable")
def subset_check(spark: SparkSession, at: str) -> DataFrame:
    g = graph(spark, at)
    return walks.is_subset(_parts_of(g, 7).df(), g.domain("Part").all().df())


@query("SELECT event_id AS id FROM events WHERE user_id = 5 AND value > 100")
def coproduct_walk(spark: SparkSession, at: str) -> DataFrame:
    return graph(spark, at).domain("User").from_(5).out("PERFORMED", "edge.value > 100").df()


@seeded("User", "SELECT event_id AS id FROM events WHERE event_type = 'click'")
def coproduct_pruned(g: GraphSnapshot, start: api.Traversal) -> DataFrame:
    return start.out("PERFORMED", "edge.component == 'PERFORMED_click'").df()


@query("SELECT c_custkey AS id, count(o_orderkey) AS degree FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def degree_out(spark: SparkSession, at: str) -> DataFrame:
    g = graph(spark, at)
    return walks.degree(g.relation("PLACED").edges, g.domain_of("Customer").nodes)


@query("SELECT p_partkey AS id, count(l_orderkey) AS degree FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1")
def degree_in(spark: SparkSession, at: str) -> DataFrame:
    g = graph(spark, at)
    return walks.degree(g.relation("CONTAINS").edges, g.domain_of("Part").nodes, "in")


@query("SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS position, l_partkey AS neighbor FROM lineitem")
def neighbor_list(spark: SparkSession, at: str) -> DataFrame:
    return walks.neighbors(graph(spark, at).relation("CONTAINS").edges)


@query(f"""WITH RECURSIVE {LINKS}, w AS (SELECT dst AS id, 1 AS n FROM e WHERE src = 1 UNION SELECT dst, n + 1 FROM w JOIN e ON src = id WHERE n < 3) SELECT DISTINCT id FROM w""")
def varlen_1_3(spark: SparkSession, at: str) -> DataFrame:
    return _homogeneous(spark, at).domain("P").from_(1).out_between("LINK", 1, 3).df()


def _homogeneous(spark: SparkSession, at: str) -> GraphSnapshot:
    edges, nodes = links(spark, at)
    return GraphSnapshot(spark).with_domain("P", nodes).with_relation("LINK", "P", "P", edges)


@query("SELECT s_suppkey AS id, s_name AS key FROM supplier")
def keys_roundtrip(spark: SparkSession, at: str) -> DataFrame:
    g = GraphSnapshot(spark).with_domain("S", table(spark, at, "supplier"), "s_suppkey", "s_name")
    return g.id_to_key("S", g.key_to_id("S", g.domain_of("S").nodes.select("key")).select("id"))


@query("SELECT count(DISTINCT l_partkey) AS count FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = 7")
def collect_count(spark: SparkSession, at: str) -> DataFrame:
    return _parts_of(graph(spark, at), 7).collect("count")


@query("SELECT count(*) > 0 AS \"exists\" FROM orders WHERE o_custkey = 7 AND o_totalprice > 1000")
def collect_exists(spark: SparkSession, at: str) -> DataFrame:
    return graph(spark, at).domain("Customer").from_(7).out("PLACED", "edge.o_totalprice > 1000").collect("exists")


@query(f"SELECT min(id) AS id FROM ({_PARTS.format(7)})")
def collect_first(spark: SparkSession, at: str) -> DataFrame:
    return _parts_of(graph(spark, at), 7).collect("first")


@query("SELECT p_partkey AS id FROM part WHERE p_retailprice < 1200 AND p_partkey IN (SELECT l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_totalprice > 400000)")
def pull_walk(spark: SparkSession, at: str) -> DataFrame:
    g = graph(spark, at)
    return walks.pull(g.relation("CONTAINS").edges, g.domain("Order").all().filter("node.o_totalprice > 400000").df(), g.domain("Part").all().filter("node.p_retailprice < 1200").df())


@query("SELECT l_partkey AS id FROM lineitem WHERE l_suppkey IN (1, 2) GROUP BY 1 HAVING count(DISTINCT l_suppkey) = 2")
def walk_universal(spark: SparkSession, at: str) -> DataFrame:
    return graph(spark, at).domain("Supplier").from_(1, 2).out("SUPPLIES", reducer="AND").df()


@query("SELECT DISTINCT l_partkey AS id FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_totalprice > 300000")
def walk_auto(spark: SparkSession, at: str) -> DataFrame:
    """Walks whose direction follows from the domain that they start in."""
    return graph(spark, at).domain("Order").all().filter("node.o_totalprice > 300000").walk("CONTAINS").df()


@query("SELECT DISTINCT l_suppkey AS id FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_discount >= 0.1 AND s_acctbal > 1000")
def attribute_filters(spark: SparkSession, at: str) -> DataFrame:
    return graph(spark, at).domain("Order").all().out_attribute("SHIPPED_BY", "l_discount", ">=", 0.1).filter_attribute("s_acctbal", ">", 1000.0).df()


@query("SELECT DISTINCT p_partkey AS id, p_name, p_retailprice FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE o_custkey = 7")
def late_attributes(spark: SparkSession, at: str) -> DataFrame:
    return _parts_of(graph(spark, at), 7).with_attributes("p_name", "p_retailprice")


@query("SELECT s_suppkey AS id, s_acctbal AS value FROM supplier")
def collect_map(spark: SparkSession, at: str) -> DataFrame:
    return graph(spark, at).domain("Supplier").all().attribute("s_acctbal").collect("map")


# expressions


@query("SELECT c_custkey AS id FROM customer WHERE c_acctbal > 5000 AND c_mktsegment <> 'BUILDING' OR c_nationkey = 3")
def cel_node_filter(spark: SparkSession, at: str) -> DataFrame:
    return graph(spark, at).domain("Customer").all().filter("node.c_acctbal > 5000 && node.c_mktsegment != 'BUILDING' || node.c_nationkey == 3").df()


@seeded("User", "SELECT event_id AS id FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-12 00:00:00'")
def cel_edge_time_window(g: GraphSnapshot, start: api.Traversal) -> DataFrame:
    return start.out("PERFORMED", "edge.ts >= 1704412800000000 && edge.ts < 1705017600000000").df()


@query("SELECT p_partkey AS id FROM part WHERE (CASE WHEN p_size > 25 THEN p_retailprice ELSE p_retailprice * 2 END) < 1000")
def cel_ternary(spark: SparkSession, at: str) -> DataFrame:
    return graph(spark, at).domain("Part").all().filter("(node.p_size > 25 ? node.p_retailprice : node.p_retailprice * 2) < 1000").df()


@query("SELECT s_suppkey AS id FROM supplier WHERE s_nationkey IN (1, 4, 9) AND s_name LIKE 'Supplier%'")
def cel_in_list(spark: SparkSession, at: str) -> DataFrame:
    return graph(spark, at).domain("Supplier").all().filter("node.s_nationkey in [1, 4, 9] && node.s_name.startsWith('Supplier')").df()


@query("SELECT DISTINCT l_partkey AS id FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = 12 AND l_discount <= 0.05 AND l_returnflag = 'R'")
def cel_params(spark: SparkSession, at: str) -> DataFrame:
    t = graph(spark, at).domain("Customer").from_param("who").out("PLACED").out("CONTAINS", "edge.l_discount <= @most && edge.l_returnflag == @flag")
    return t.with_param("most", 0.05).with_param("flag", "R").df(who=12)


@seeded("Customer", "SELECT DISTINCT l_partkey AS id FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey WHERE l_extendedprice > p_retailprice * 20 AND o_totalprice > 50000 AND p_size > l_linenumber")
def cel_all_scopes(g: GraphSnapshot, start: api.Traversal) -> DataFrame:
    return start.out("PLACED").out("CONTAINS", "edge.l_extendedprice > dest.p_retailprice * 20 && src.o_totalprice > 50000 && node.p_size > edge.l_linenumber").df()


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 7 = 3 AND CAST(trunc(o_orderkey / 10) AS BIGINT) % 2 = 0")
def cel_integer_math(spark: SparkSession, at: str) -> DataFrame:
    return graph(spark, at).domain("Order").all().filter("node.id % 7 == 3 && node.id / 10 % 2 == 0").df()


@query("SELECT p_partkey AS id FROM part WHERE NOT (p_size > 25) AND -p_size < -10")
def cel_unary_index(spark: SparkSession, at: str) -> DataFrame:
    return graph(spark, at).domain("Part").all().filter("!(node.p_size > 25) && -node.p_size < [-5, -10, -20][1]").df()


_MATH = {
    "abs(x - 25.0)": "abs(x - 25.0)", "sqrt(x)": "sqrt(x)", "rsqrt(x + 1.0)": "1 / sqrt(x + 1.0)", "cbrt(x)": "cbrt(x)", "pow(x, 1.5)": "pow(x, 1.5)", "hypot(x, 3.0)": "sqrt(x * x + 9)", "lerp(x, 10.0, 0.25)": "x + (10 - x) * 0.25",
    "exp(x / 50.0)": "exp(x / 50)", "exp2(x / 10.0)": "pow(2, x / 10)", "exp10(x / 50.0)": "pow(10, x / 50)", "expm1(x / 50.0)": "exp(x / 50) - 1", "log(x + 1.0)": "ln(x + 1)", "log2(x + 1.0)": "log2(x + 1)", "log10(x + 1.0)": "log10(x + 1)",
    "log1p(x)": "ln(1 + x)", "sin(x)": "sin(x)", "cos(x)": "cos(x)", "tan(x / 40.0)": "tan(x / 40)", "asin(x / 60.0)": "asin(x / 60)", "acos(x / 60.0)": "acos(x / 60)", "atan(x)": "atan(x)", "atan2(x, 2.0)": "atan2(x, 2)", "sinc(x)": "CASE WHEN x = 0 THEN 1 ELSE sin(x) / x END",
    "sinh(x / 20.0)": "sinh(x / 20)", "cosh(x / 20.0)": "cosh(x / 20)", "tanh(x / 20.0)": "tanh(x / 20)", "asinh(x)": "asinh(x)", "acosh(x + 1.0)": "acosh(x + 1)", "atanh(x / 60.0)": "atanh(x / 60)", "floor(x / 3.0)": "floor(x / 3)", "ceil(x / 3.0)": "ceil(x / 3)",
    "trunc(x / 3.0 - 8.0)": "trunc(x / 3 - 8)", "round(x / 4.0)": "floor(x / 4 + 0.5)", "clamp(x, 10.0, 20.0)": "least(greatest(x, 10), 20)", "copysign(x, x - 25.0)": "CASE WHEN x - 25 < 0 THEN -abs(x) ELSE abs(x) END", "fmod(x, 7.0)": "x - 7 * trunc(x / 7)",
    "relu(x - 25.0)": "greatest(x - 25, 0)", "leaky_relu(x - 25.0)": "CASE WHEN x > 25 THEN x - 25 ELSE 0.01 * (x - 25) END", "sigmoid(x - 25.0)": "1 / (1 + exp(25 - x))", "silu(x - 25.0)": "(x - 25) / (1 + exp(25 - x))", "softplus(x - 25.0)": "greatest(x - 25, 0) + ln(1 + exp(-abs(x - 25)))",
    "popcount(n)": "bit_count(n)", "clz(n)": "CASE WHEN n = 0 THEN 64 ELSE 63 - floor(log2(n)) END", "ctz(n)": "CASE WHEN n = 0 THEN 64 ELSE length(bin(n)) - length(rtrim(bin(n), '0')) END", "rotl(n, 3)": "n * 8", "rotr(rotl(n, 5), 2)": "n * 8",
    "safeDiv(x, x - 25.0)": "CASE WHEN x = 25 THEN 0 ELSE x / (x - 25) END", "isNan(sqrt(x - 25.0)) ? 1 : 0": "CASE WHEN x < 25 THEN 1 ELSE 0 END", "isInf(exp(x * 40.0)) ? 1 : 0": "CASE WHEN x * 40 > 709.9 THEN 1 ELSE 0 END", "isFinite(exp(x * 40.0)) ? 1 : 0": "CASE WHEN x * 40 > 709.9 THEN 0 ELSE 1 END",
}


def _math(part: list[tuple[str, str]]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, at: str) -> DataFrame:
        nodes = table(spark, at, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x"), F.col("p_size").cast("long").alias("n"))
        g = GraphSnapshot(spark).with_domain("P", nodes)
        done = g.domain("P").all().project(", ".join(f"state.f{i} = {c}" for i, (c, _) in enumerate(part))).df()
        return done.select("id", *[(F.round(F.col(f"f{i}").cast("double"), 6) + 0.0).alias(f"f{i}") for i in range(len(part))])

    return run


for _k in range(0, len(_MATH), 13):
    _part = list(_MATH.items())[_k : _k + 13]
    _cols = ", ".join(f"round(CAST({s} AS DOUBLE), 6) + 0.0 AS f{i}" for i, (_, s) in enumerate(_part))
    query(f"SELECT id, {_cols} FROM (SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS x, CAST(p_size AS BIGINT) AS n FROM part)", f"cel_math_{_k // 13 + 1}")(_math(_part))


@query(name="cel_math_special")
def cel_math_special(spark: SparkSession, at: str) -> DataFrame:
    nodes = table(spark, at, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") / 25.0).cast("double").alias("x"))
    return GraphSnapshot(spark).with_domain("P", nodes).domain("P").all().project("state.erf = erf(x), state.erfc = erfc(x), state.lgamma = lgamma(x + 1.0), state.gelu = gelu(x)").df()


# state and reducers

_STATE = "SELECT l_partkey AS id, {} FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1"
for _name, _cel, _sql in (
    ("state_min", "state.v:MIN = edge.l_extendedprice", "min(l_extendedprice) AS v"),
    ("state_max", "state.v:MAX = edge.l_extendedprice", "max(l_extendedprice) AS v"),
    ("state_sum", "state.v:SUM = edge.l_quantity", "sum(l_quantity) AS v"),
    ("state_count", "state.v:COUNT = edge.l_quantity", "count(*) AS v"),
    ("state_avg", "state.v:AVG = edge.l_quantity", "avg(l_quantity) AS v"),
    ("state_or", "state.v:OR = edge.l_returnflag == 'R'", "bool_or(l_returnflag = 'R') AS v"),
    ("state_and", "state.v:AND = edge.l_quantity > 10", "bool_and(l_quantity > 10) AS v"),
    ("state_any", "state.v:ANY = edge.l_shipdate", "min(epoch_us(l_shipdate)) AS v"),
    ("state_argmin", "state.cost:MIN = edge.l_extendedprice, state.via:ARGMIN(cost) = src.id", "min(l_extendedprice) AS cost, arg_min(o_orderkey, (l_extendedprice, o_orderkey)) AS via"),
    ("state_argmax", "state.cost:MAX = edge.l_extendedprice, state.via:ARGMAX(cost) = src.id", "max(l_extendedprice) AS cost, arg_max(o_orderkey, (l_extendedprice, -o_orderkey)) AS via"),
    ("state_source_attribute", "state.v:SUM = src.o_totalprice * edge.l_discount", "round(sum(o_totalprice * l_discount), 4) AS v"),
):

    def _run(g: GraphSnapshot, start: api.Traversal, _cel: str = _cel, _name: str = _name) -> DataFrame:
        df = start.out("PLACED").out_with_state("CONTAINS", _cel).df()
        return df.withColumn("v", F.round("v", 4)) if _name == "state_source_attribute" else df

    _run.__name__ = _name
    seeded("Customer", _STATE.format(_sql))(_run)


@seeded("Customer", "SELECT l_partkey AS id, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def two_hop_path_count(g: GraphSnapshot, start: api.Traversal) -> DataFrame:
    t = start.out_with_state("PLACED", "state.n:COUNT = 1").out_with_state("CONTAINS", "state.n:SUM = src.n")
    return t.df()


@seeded("Customer", "SELECT l_partkey AS id, min(o_totalprice + l_extendedprice) AS cost FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_totalprice > 1000 AND l_quantity < 30 GROUP BY 1 HAVING min(o_totalprice + l_extendedprice) < 100000")
def state_carried(g: GraphSnapshot, start: api.Traversal) -> DataFrame:
    t = start.out_with_state("PLACED", "state.cost:MIN = edge.o_totalprice", "edge.o_totalprice > 1000")
    return t.out_with_state("CONTAINS", "state.cost:MIN = state.cost + edge.l_extendedprice", "edge.l_quantity < 30").filter("state.cost < 100000").df()


@query("SELECT c_custkey AS id, c_acctbal * 2 AS twice, CAST(1 AS BIGINT) AS n FROM customer")
def project_in_place(spark: SparkSession, at: str) -> DataFrame:
    return graph(spark, at).domain("Customer").all().project("state.twice:SUM = node.c_acctbal * 2, state.n:COUNT = node.c_acctbal").df()


for _kind, _sql in (
    ("sum", "round(sum(c_acctbal), 4)"), ("max", "max(c_acctbal)"), ("min", "min(c_acctbal)"), ("avg", "round(avg(c_acctbal), 6)"), ("count", "count(*)"), ("first", "arg_min(c_acctbal, c_custkey)"),
    ("argmax", "arg_max(c_custkey, (c_acctbal, -c_custkey))"), ("argmin", "arg_min(c_custkey, (c_acctbal, c_custkey))"),
):

    def _reduce(spark: SparkSession, at: str, _kind: str = _kind) -> DataFrame:
        df = graph(spark, at).domain("Customer").all().attribute("c_acctbal").reduce(_kind)
        return df.withColumn(_kind, F.round(_kind, {"sum": 4, "avg": 6}[_kind])) if _kind in ("sum", "avg") else df

    query(f'SELECT {_sql} AS "{_kind}" FROM customer', f"reduce_{_kind}")(_reduce)


@seeded("Customer", "SELECT round(sum(o_totalprice * l_discount), 3) AS \"sum\" FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def reduce_edge_expression(g: GraphSnapshot, start: api.Traversal) -> DataFrame:
    df = start.out("PLACED").edge_values("CONTAINS", "o_totalprice", "*", "l_discount").reduce("sum")
    return df.withColumn("sum", F.round("sum", 3))


# front-ends


@query(SQL["walk_2hop_filtered"])
def cypher_2hop_filtered(spark: SparkSession, at: str) -> DataFrame:
    return api.prepare(graph(spark, at), "MATCH (c:Customer)-[:PLACED]->(o:Order)-[l:CONTAINS]->(p:Part) WHERE c.id = $who AND l.l_quantity > 25 RETURN p").bind("$who", 7).df()


@query(SQL["walk_4hop_metapath"])
def cypher_4hop_metapath(spark: SparkSession, at: str) -> DataFrame:
    return api.prepare(graph(spark, at), "MATCH (c:Customer {id: 7})-[:PLACED]->()-[:CONTAINS]->(:Part)<-[:CONTAINS]-(:Order)<-[:PLACED]-(d:Customer) RETURN DISTINCT d").df()


@query("SELECT count(DISTINCT c_custkey) AS count FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND l_partkey = 11")
def cypher_count_middle(spark: SparkSession, at: str) -> DataFrame:
    return api.prepare(graph(spark, at), "MATCH (p:Part {id: 11})<-[:CONTAINS]-(o)<-[:PLACED]-(c:Customer)-[:LIVES_IN]->(n) WHERE c.c_mktsegment = 'BUILDING' RETURN count(c)").df()


@query(SQL["varlen_1_3"])
def cypher_varlen(spark: SparkSession, at: str) -> DataFrame:
    return api.prepare(_homogeneous(spark, at), "MATCH (a:P)-[:LINK*1..3]->(b) WHERE id(a) = 1 RETURN b").df()


@query("SELECT DISTINCT l_partkey AS id FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = 9 AND l_tax > 0.04")
def statement_arrows(spark: SparkSession, at: str) -> DataFrame:
    return api.prepare(graph(spark, at), "FROM Customer WHERE id = $id -> out('PLACED') -> out('CONTAINS', 'edge.l_tax > 0.04')").bind("id", 9).df()


@query(SQL["walk_reverse"])
def sexpr_roundtrip(spark: SparkSession, at: str) -> DataFrame:
    text = graph(spark, at).domain("Part").from_(11).in_("CONTAINS").in_("PLACED").explain()
    return api.run(sexpr.parse(text), graph(spark, at))


@seeded("Customer", "SELECT DISTINCT l_suppkey AS id FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE s_acctbal > 2000")
def typed_builder(g: GraphSnapshot, start: api.Traversal) -> DataFrame:
    b = api.TypedBuilder(start, "Customer")
    return b.walk_placed().walk_shipped_by().filter_s_acctbal(">", 2000).traversal.df()


# loops and algorithms


@query(f"WITH RECURSIVE {LINKS}, w AS (SELECT CAST(1 AS BIGINT) AS id, 0 AS n UNION SELECT dst, n + 1 FROM w JOIN e ON src = id WHERE n < 3) SELECT DISTINCT id FROM w WHERE n = 3")
def repeat_3(spark: SparkSession, at: str) -> DataFrame:
    return _homogeneous(spark, at).domain("P").from_(1).repeat(3, lambda s: s.out("LINK")).df()


@query(f"WITH RECURSIVE {LINKS}, w AS (SELECT CAST(1 AS BIGINT) AS id UNION SELECT dst FROM w JOIN e ON src = id) SELECT id FROM w")
def closure(spark: SparkSession, at: str) -> DataFrame:
    return _homogeneous(spark, at).domain("P").from_(1).repeat_until_stable(lambda s: s.out("LINK")).df()


@query(f"WITH RECURSIVE {LINKS}, w AS (SELECT CAST(1 AS BIGINT) AS id, 0 AS level UNION SELECT b, level + 1 FROM w JOIN u ON a = id WHERE level < 12) SELECT id, min(level) AS level FROM w GROUP BY 1")
def bfs_levels(spark: SparkSession, at: str) -> DataFrame:
    edges, _ = links(spark, at)
    return algorithms.bfs_levels(edges, spark.createDataFrame([(1,)], "id long"), "both", 12)


_LABELS = unrolled("m", "SELECT id, id AS c FROM v", "SELECT m.id, least(m.c, coalesce(n.c, m.c)) AS c FROM {p} m LEFT JOIN (SELECT u.a AS id, min(q.c) AS c FROM u JOIN {p} q ON q.id = u.b GROUP BY 1) n USING (id)", 14)


@query(f"WITH {LINKS}, {_LABELS} SELECT id, c AS component FROM m14")
def cc_labels(spark: SparkSession, at: str) -> DataFrame:
    return algorithms.connected_components(*links(spark, at))


@query(f"WITH {LINKS} SELECT v.id, coalesce(sum(e.dst), 0) * 1.0 AS value FROM v LEFT JOIN e ON e.src = v.id GROUP BY 1")
def mxv(spark: SparkSession, at: str) -> DataFrame:
    edges, nodes = links(spark, at)
    return walks.semiring_product(edges, nodes.withColumn("value", F.col("id").cast("double")), nodes)


@query(f"WITH {LINKS} SELECT v.id, min(e.weight + e.src) AS value FROM v LEFT JOIN e ON e.dst = v.id GROUP BY 1")
def vxm_min_plus(spark: SparkSession, at: str) -> DataFrame:
    edges, nodes = links(spark, at)
    return walks.semiring_product(edges, nodes.withColumn("value", F.col("id").cast("double")), nodes, "min_plus", "weight", transposed=True)


_RANK = ["r0 AS (SELECT id, 1.0 / (SELECT count(*) FROM v) AS r FROM v)"] + [
    f"r{i} AS (SELECT v.id, 0.15 / (SELECT count(*) FROM v) + 0.85 * (coalesce(g.s, 0) + (SELECT coalesce(sum(r), 0) FROM r{i - 1} WHERE id NOT IN (SELECT src FROM e)) / (SELECT count(*) FROM v)) AS r "
    f"FROM v LEFT JOIN (SELECT e.dst, sum(r{i - 1}.r / o.n) AS s FROM e JOIN r{i - 1} ON r{i - 1}.id = e.src JOIN o ON o.src = e.src GROUP BY 1) g ON g.dst = v.id)"
    for i in range(1, 6)
]


@query(f"WITH {LINKS}, o AS (SELECT src, CAST(count(*) AS DOUBLE) AS n FROM e GROUP BY 1), {', '.join(_RANK)} SELECT id, round(CAST(r AS DOUBLE), 9) AS rank FROM r5")
def pagerank_5(spark: SparkSession, at: str) -> DataFrame:
    return algorithms.pagerank(*links(spark, at), iterations=5).withColumn("rank", F.round("rank", 9))


_DISTANCES = unrolled("d", "SELECT CAST(1 AS BIGINT) AS id, CAST(0 AS DOUBLE) AS d", "SELECT id, min(d) AS d FROM (SELECT * FROM {p} UNION ALL SELECT e.dst, q.d + e.weight FROM {p} q JOIN e ON e.src = q.id) GROUP BY 1", 14)


@query(f"WITH {LINKS}, {_DISTANCES} SELECT id, d AS distance FROM d14")
def sssp(spark: SparkSession, at: str) -> DataFrame:
    return algorithms.shortest_paths(links(spark, at)[0], spark.createDataFrame([(1,)], "id long"))


_TRIANGLES = "t AS (SELECT count(*) AS triangles FROM s x JOIN s y ON y.a = x.b JOIN s z ON z.a = x.a AND z.b = y.b)"


@query(f"WITH {LINKS}, {_TRIANGLES} SELECT triangles FROM t")
def triangles(spark: SparkSession, at: str) -> DataFrame:
    return algorithms.triangles(links(spark, at)[0])


@query(f"WITH {LINKS}, {_TRIANGLES}, d AS (SELECT a, count(*) AS n FROM (SELECT a FROM s UNION ALL SELECT b FROM s) GROUP BY 1) SELECT triangles, CAST((SELECT sum(n * (n - 1) // 2) FROM d) AS BIGINT) - 3 * triangles AS wedges FROM t")
def motifs3(spark: SparkSession, at: str) -> DataFrame:
    return algorithms.motifs3(links(spark, at)[0])


@query(f"WITH {LINKS} SELECT count(*) AS hits FROM e x JOIN e y ON y.src = x.src JOIN e z ON z.src = x.dst AND z.dst = y.dst WHERE x.dst > x.src")
def triangle_sweep(spark: SparkSession, at: str) -> DataFrame:
    return algorithms.triangle_sweep(*links(spark, at))


def _core(k: int, rounds: int) -> str:
    weak = "SELECT id FROM (SELECT a AS id FROM {p} UNION ALL SELECT b FROM {p}) GROUP BY 1 HAVING count(*) >= " + str(k)
    return unrolled("c", "SELECT a, b FROM s", f"SELECT a, b FROM {{p}} WHERE a IN ({weak}) AND b IN ({weak})", rounds) + f" SELECT DISTINCT id FROM (SELECT a AS id FROM c{rounds} UNION ALL SELECT b FROM c{rounds})"


@query(f"WITH {LINKS}, {_core(2, 6)}")
def k_core_2(spark: SparkSession, at: str) -> DataFrame:
    return algorithms.k_core(links(spark, at)[0], 2)


@query(f"WITH {LINKS}, {_core(32, 24)}")
def k_core_32(spark: SparkSession, at: str) -> DataFrame:
    """Deep enough to take several rounds at every size: a part has some 45 neighbours."""
    return algorithms.k_core(links(spark, at)[0], 32)


_PATHS = (
    "l0 AS MATERIALIZED (SELECT id AS s, id, 1.0::DOUBLE AS n FROM v WHERE id % 50 = 0), k0 AS MATERIALIZED (SELECT s, id FROM l0), "
    + ", ".join(
        f"l{i} AS MATERIALIZED (SELECT l.s, e.dst AS id, sum(l.n) AS n FROM l{i - 1} l JOIN e ON e.src = l.id WHERE NOT EXISTS (SELECT 1 FROM k{i - 1} k WHERE k.s = l.s AND k.id = e.dst) GROUP BY ALL), k{i} AS MATERIALIZED (SELECT * FROM k{i - 1} UNION ALL SELECT s, id FROM l{i})"
        for i in range(1, 9)
    )
    + ", b8 AS MATERIALIZED (SELECT s, id, n, 0.0::DOUBLE AS x FROM l8), "
    + ", ".join(
        f"b{i} AS MATERIALIZED (SELECT l.s, l.id, l.n, coalesce(sum(l.n / b.n * (1 + b.x)), 0.0) AS x FROM l{i} l LEFT JOIN (SELECT e.src, b.* FROM e JOIN b{i + 1} b ON b.id = e.dst) b ON b.s = l.s AND b.src = l.id GROUP BY ALL)"
        for i in range(7, 0, -1)
    )
)


@query(f"WITH {LINKS}, {_PATHS} SELECT id, round(sum(x), 6) AS score FROM ({' UNION ALL '.join(f'SELECT * FROM b{i}' for i in range(1, 9))}) GROUP BY 1")
def betweenness(spark: SparkSession, at: str) -> DataFrame:
    """By the shortest paths from the query set: the parts whose key is divisible by 50, over all links."""
    edges, nodes = links(spark, at)
    return algorithms.betweenness(edges, nodes.filter("id % 50 = 0")).withColumn("score", F.round("score", 6))


@query(f"""WITH RECURSIVE {LINKS}, m AS (SELECT id FROM v WHERE id = 1 UNION SELECT dst FROM m JOIN e ON src = id), r AS (SELECT l_suppkey AS id FROM lineitem JOIN m ON m.id = l_partkey EXCEPT SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) SELECT id FROM r""")
def rebac_allowed(spark: SparkSession, at: str) -> DataFrame:
    edges, nodes = links(spark, at)
    line, supp = table(spark, at, "lineitem"), table(spark, at, "supplier")
    g = GraphSnapshot(spark).with_domain("P", nodes).with_domain("S", supp, "s_suppkey").with_relation("IN", "P", "P", edges).with_relation("MAY", "P", "S", line, "l_partkey", "l_suppkey")
    return g.domain("P").from_(1).rebac_check("IN", "MAY", g.domain("S").all().filter("node.s_acctbal < 0")).df()


def _ring(spark: SparkSession, at: str) -> DataFrame:
    """Trade between nations: supplier's and customer's nation of all orders, as branches of a network (a branch for each pair of nations at most)."""
    line, orders = table(spark, at, "lineitem"), table(spark, at, "orders")
    rows = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, at, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, at, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    pairs = rows.filter("c_nationkey != s_nationkey").select(F.least("c_nationkey", "s_nationkey").cast("long").alias("src"), F.greatest("c_nationkey", "s_nationkey").cast("long").alias("dst")).distinct()
    return pairs.withColumn("branch_id", F.col("src") * 100 + F.col("dst"))


@query(name="islands_n1")
def islands_n1(spark: SparkSession, at: str) -> DataFrame:
    return algorithms.contingencies(_ring(spark, at))


@query(name="islands_n2")
def islands_n2(spark: SparkSession, at: str) -> DataFrame:
    return algorithms.contingencies(_ring(spark, at), order=2)


def grid(spark: SparkSession, at: str) -> DataFrame:
    """(src, dst, branch_id): the branches between buses that were ever inserted, keys canonical."""
    edges, relations, domains = tables(spark, at, "edge_deltas", "graph_relations", "graph_domains")
    rows = with_canonical_edges(edges.filter("op = 'I'").select("relation_id", "src_key", "tgt_key", "branch_id"), relations.filter("relation_name = 'Branch'"), domains)
    return rows.select("src", F.col("tgt").alias("dst"), "branch_id").dropna().distinct()


@query(name="grid_n1")
def grid_n1(spark: SparkSession, at: str) -> DataFrame:
    return algorithms.contingencies(grid(spark, at))


def _drawn(a: str, b: object) -> str:
    return f"((({a} % {walks.LCG}) * {walks.LCG_A} + ({b} % {walks.LCG}) * {walks.LCG_B}) % {walks.LCG} * {walks.LCG_C} % {walks.LCG})"


@query(f"SELECT src, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY {_drawn('src', 'dst')}, dst) AS rn FROM (SELECT l_orderkey AS src, l_partkey AS dst FROM lineitem)) WHERE rn <= 2")
def sampled_neighbors(spark: SparkSession, at: str) -> DataFrame:
    return walks.sample_neighbors(graph(spark, at).relation("CONTAINS").edges.select("src", "dst"), 2)


_WALKS = ", ".join(["w0 AS MATERIALIZED (SELECT id AS start, 0 AS step, id FROM v)"] + [f"w{i} AS MATERIALIZED (SELECT w.start, {i} AS step, p.dst AS id FROM w{i - 1} w JOIN p ON p.src = w.id AND p.k = {_drawn('w.start', i)} % p.n + 1)" for i in range(1, 5)])


@query(f"WITH {LINKS}, p AS MATERIALIZED (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS k, count(*) OVER (PARTITION BY src) AS n FROM e), {_WALKS} {' UNION ALL '.join(f'SELECT * FROM w{i}' for i in range(5))}")
def random_walks(spark: SparkSession, at: str) -> DataFrame:
    edges, nodes = links(spark, at)
    return walks.random_walk(edges, nodes, 4)


# products and vectors

_VECTORS = "o AS (SELECT id, CAST(count(e.src) AS DOUBLE) AS value FROM v LEFT JOIN e ON e.src = id GROUP BY 1), i AS (SELECT id, CAST(count(e.dst) AS DOUBLE) AS value FROM v LEFT JOIN e ON e.dst = id GROUP BY 1)"


def _degrees(spark: SparkSession, at: str) -> tuple[DataFrame, DataFrame]:
    edges, nodes = links(spark, at)
    return tuple(walks.degree(edges, nodes, d).select("id", F.col("degree").cast("double").alias("value")) for d in ("out", "in"))


@query(f"WITH {LINKS} SELECT v.id, max(least(e.weight, CAST(e.dst AS DOUBLE))) AS value FROM v LEFT JOIN e ON e.src = v.id GROUP BY 1")
def mxv_max_min(spark: SparkSession, at: str) -> DataFrame:
    edges, nodes = links(spark, at)
    return walks.semiring_product(edges, nodes.withColumn("value", F.col("id").cast("double")), nodes, "max_min", "weight")


@query(f"WITH {LINKS} SELECT v.id, bool_or(e.dst % 2 <> 0) AS value FROM v LEFT JOIN e ON e.src = v.id GROUP BY 1")
def mxv_or_and(spark: SparkSession, at: str) -> DataFrame:
    edges, nodes = links(spark, at)
    return walks.semiring_product(edges, nodes.withColumn("value", (F.col("id") % 2).cast("double")), nodes, "or_and")


@query(f"WITH {LINKS}, {_VECTORS} SELECT sum(abs(o.value - i.value)) AS distance, FALSE AS converged FROM o JOIN i USING (id)")
def vector_l1(spark: SparkSession, at: str) -> DataFrame:
    return walks.l1_distance(*_degrees(spark, at))


@query(f"WITH {LINKS}, {_VECTORS} SELECT id, CASE WHEN i.value = 0 THEN o.value * 0.5 ELSE o.value * 0.5 / i.value END AS value FROM o JOIN i USING (id)")
def vector_scale_divide(spark: SparkSession, at: str) -> DataFrame:
    out, into = _degrees(spark, at)
    return walks.elementwise(walks.scale(out, 0.5), into, "div", union=False)


@query(f"WITH {LINKS}, {_VECTORS}, a AS (SELECT * FROM o WHERE value > 20), b AS (SELECT * FROM i WHERE value > 20) SELECT id, CASE WHEN a.value IS NULL THEN b.value WHEN b.value IS NULL THEN a.value ELSE least(a.value, b.value) END AS value FROM a FULL JOIN b USING (id)")
def vector_union_min(spark: SparkSession, at: str) -> DataFrame:
    out, into = _degrees(spark, at)
    return walks.elementwise(out.filter("value > 20"), into.filter("value > 20"), "min", union=True)


# statistics

_DEGREES = "d AS (SELECT c_custkey AS id, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1), s AS (SELECT list(n ORDER BY n) AS l, count(*) AS v FROM d)"


@query(f"""WITH {_DEGREES} SELECT v AS node_count, CAST((SELECT sum(n) FROM d) AS BIGINT) AS edge_count, (SELECT count(*) FROM d WHERE n > 0) AS unique_sources, (SELECT max(n) FROM d) AS max_degree,
(SELECT avg(n) FROM d) AS avg_degree, round((SELECT stddev_pop(n) FROM d), 9) AS stddev_degree, l[CAST(floor(v * 0.5) AS INT) + 1] AS p50_degree, l[CAST(floor(v * 0.9) AS INT) + 1] AS p90_degree, l[CAST(floor(v * 0.99) AS INT) + 1] AS p99_degree,
(SELECT count(*) FROM d WHERE n > 0) / v AS sparsity, CAST(1 AS BIGINT) AS max_in_degree, '1:N' AS multiplicity FROM s""")
def relation_stats(spark: SparkSession, at: str) -> DataFrame:
    g = graph(spark, at)
    return statistics.relation_statistics(g.relation("PLACED").edges, g.domain_of("Customer").nodes).withColumn("stddev_degree", F.round("stddev_degree", 9))


@query(f"WITH {_DEGREES} SELECT id, n AS degree FROM d WHERE n >= (SELECT greatest(avg(n) + 3 * stddev_pop(n), 10) FROM d)")
def supernodes(spark: SparkSession, at: str) -> DataFrame:
    g = graph(spark, at)
    return statistics.supernodes(g.relation("PLACED").edges, g.domain_of("Customer").nodes)


@query("SELECT count(*) AS rows, CAST(0 AS BIGINT) AS nulls, min(o_totalprice) AS min_value, max(o_totalprice) AS max_value, least(count(DISTINCT o_totalprice), 10000) AS distinct_values, 'NONE' AS monotonic FROM orders")
def attribute_stats(spark: SparkSession, at: str) -> DataFrame:
    return statistics.attribute_statistics(table(spark, at, "orders"), "o_totalprice", "o_orderkey")


@query("SELECT l_partkey AS value, count(*) AS count FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25")
def heavy_hitters_exact(spark: SparkSession, at: str) -> DataFrame:
    return statistics.heavy_hitters(table(spark, at, "lineitem"), "l_partkey", 25)


@query(name="heavy_hitters_sketch")
def heavy_hitters_sketch(spark: SparkSession, at: str) -> DataFrame:
    return statistics.heavy_hitters_sketch(table(spark, at, "lineitem"), "l_partkey", 25)


@query("WITH s AS (SELECT list(l_extendedprice ORDER BY l_extendedprice) AS l, count(*) AS n FROM lineitem) SELECT CAST(b AS INT) AS bucket, l[CAST(ceil(b * n / 20.0) AS INT)] AS upper FROM s, range(1, 21) t(b)")
def equi_depth(spark: SparkSession, at: str) -> DataFrame:
    return statistics.equi_depth_exact(table(spark, at, "lineitem"), "l_extendedprice")


@query("SELECT row_number() OVER (ORDER BY n DESC) AS place, n FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_partkey ORDER BY 1 DESC LIMIT 25)")
def heavy_hitters_sketch_counts(spark: SparkSession, at: str) -> DataFrame:
    """The sketch's counts by place: exact as long as there are no more values than counters."""
    got = statistics.heavy_hitters_sketch(table(spark, at, "lineitem"), "l_partkey", 25)
    return got.select(F.row_number().over(Window.orderBy(F.desc("count"))).cast("long").alias("place"), F.col("count").alias("n"))  # 25 rows


@query("SELECT CAST(b AS INT) AS bucket, TRUE AS within FROM range(1, 21) t(b)")
def equi_depth_sketch(spark: SparkSession, at: str) -> DataFrame:
    """Whether the places of the sketch's bounds are those asked for, within its accuracy of a 10,000th of all rows."""
    line = table(spark, at, "lineitem").select(F.col("l_extendedprice").alias("v"))
    bounds = statistics.equi_depth(line, "v")
    total = F.broadcast(line.agg(F.count("v").alias("n")))
    places = line.join(F.broadcast(bounds), F.col("v") <= F.col("upper")).groupBy("bucket").agg(F.count(F.lit(1)).alias("upto"), F.count_if(F.col("v") == F.col("upper")).alias("same"))  # 20 bounds
    want, slack = F.col("bucket") * F.col("n") / 20, F.col("n") / 10_000 + 1
    return places.join(total, F.lit(True)).select("bucket", ((F.col("upto") >= want - slack) & (F.col("upto") - F.col("same") <= want + slack)).alias("within"))


@query("SELECT count(DISTINCT l_partkey) AS n, TRUE AS within FROM lineitem")
def distinct_sketch(spark: SparkSession, at: str) -> DataFrame:
    """The exact count and whether the sketch is within four of its standard errors."""
    line = table(spark, at, "lineitem")
    exact = line.agg(F.countDistinct("l_partkey").alias("n"))
    return exact.join(F.broadcast(statistics.approximate_distinct(line, "l_partkey")), F.lit(True)).select("n", (F.abs(F.col("distinct_values") - F.col("n")) <= 4 * 0.02 * F.col("n")).alias("within"))


@query("""WITH d AS (SELECT o_orderkey AS id, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
SELECT min(n) AS min_degree, max(n) AS max_degree, count(*) FILTER (WHERE n = 0) AS zeros, quantile_disc(n, 0.5) AS p50, quantile_disc(n, 0.9) AS p90, quantile_disc(n, 0.99) AS p99 FROM d""")
def degree_sketch(spark: SparkSession, at: str) -> DataFrame:
    g = graph(spark, at)
    return statistics.degree_sketch(g.relation("CONTAINS").edges, g.domain_of("Order").nodes)


@query("""SELECT 'PLACED' AS name, CAST(count(*) AS BIGINT) AS n, max(c) AS most FROM orders, (SELECT max(n) AS c FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)) GROUP BY 1
UNION ALL SELECT 'Supplier', count(*), NULL FROM supplier UNION ALL SELECT 'Supplier.s_acctbal', count(s_acctbal), CAST(floor(max(s_acctbal)) AS BIGINT) FROM supplier""")
def statistics_lookup(spark: SparkSession, at: str) -> DataFrame:
    """What the collector found on a relation, a domain and an attribute, looked up by names in another case and by a suffix."""
    g = graph(spark, at)
    own = GraphSnapshot(spark).with_domain("Customer", g.domain_of("Customer").nodes.select("id", "key"), key="key").with_domain("Order", g.domain_of("Order").nodes.select("id", "key"), key="key")
    own = own.with_domain("Supplier", g.domain_of("Supplier").nodes.select("id", "key", "s_acctbal"), key="key").with_relation("PLACED", "Customer", "Order", g.relation("PLACED").edges.select("src", "dst"))
    found = statistics.GraphStatistics(statistics.collect_statistics(own))
    placed, supplier, balance = found.relation("placed"), found.domain("SUPPLIER"), found.attribute("s_acctbal")
    rows = [("PLACED", placed["edge_count"], placed["max_degree"]), ("Supplier", supplier["node_count"], None), ("Supplier.s_acctbal", balance["rows"] - balance["nulls"], int(float(balance["max_value"]) // 1))]
    return spark.createDataFrame(rows, "name string, n long, most long")


# mutations


@query("""WITH d AS (SELECT user_id AS src, event_id % 50 AS dst, CASE WHEN event_type = 'error' THEN 'D' ELSE 'I' END AS op, row_number() OVER (PARTITION BY user_id, event_id % 50 ORDER BY ts DESC, event_id DESC) AS rn FROM events)
SELECT src, dst FROM d WHERE rn = 1 AND op = 'I'""")
def delta_fold(spark: SparkSession, at: str) -> DataFrame:
    """Events as a log: an error takes back what stood between its user and its page."""
    own = table(spark, at, "events").select(F.col("user_id").alias("src"), (F.col("event_id") % 50).alias("dst"), F.when(F.col("event_type") == "error", "D").otherwise("I").alias("op"), "ts", "event_id")
    return deltas.fold(own, ["src", "dst"], ["ts", "event_id"]).filter("op = 'I'").select("src", "dst")


@query("""WITH d AS (SELECT user_id AS src, event_id % 50 AS dst, event_type, row_number() OVER (PARTITION BY user_id, event_id % 50 ORDER BY event_id DESC) AS rn FROM events WHERE event_id % 2 = 1),
b AS (SELECT user_id AS src, event_id % 50 AS dst FROM events WHERE event_id % 2 = 0) SELECT src, dst FROM b WHERE (src, dst) NOT IN (SELECT (src, dst) FROM d) UNION ALL SELECT src, dst FROM d WHERE rn = 1 AND event_type <> 'error'""")
def delta_overlay(spark: SparkSession, at: str) -> DataFrame:
    ev = table(spark, at, "events").select(F.col("user_id").alias("src"), (F.col("event_id") % 50).alias("dst"), F.when(F.col("event_type") == "error", "D").otherwise("I").alias("op"), F.col("event_id").alias("offset"))
    return deltas.apply_deltas(ev.filter("offset % 2 = 0").select("src", "dst"), ev.filter("offset % 2 = 1"))


@query(f"""WITH n AS (SELECT domain_id, key, op, min(kafka_offset) AS pos FROM ({nodes_sql("node_deltas")}) WHERE key IS NOT NULL GROUP BY domain_id, key, op, delta_id),
l AS (SELECT domain_id, key, arg_max(op, pos) AS op, max(pos) FILTER (WHERE op = 'D') AS cut FROM n GROUP BY ALL),
live AS (SELECT domain_id, key FROM l WHERE op = 'I' UNION SELECT domain_id, key FROM ({nodes_sql("base_nodes")}) WHERE key IS NOT NULL AND (domain_id, key) NOT IN (SELECT (domain_id, key) FROM l)),
f AS (SELECT relation_id, src_domain, src, tgt_domain, tgt, op, min(kafka_offset) AS pos FROM ({edges_sql("e.src_key IS NOT NULL AND e.tgt_key IS NOT NULL")}) GROUP BY relation_id, src_domain, src, tgt_domain, tgt, op, delta_id),
k AS (SELECT f.* FROM f LEFT JOIN l a ON a.domain_id = src_domain AND a.key = src LEFT JOIN l b ON b.domain_id = tgt_domain AND b.key = tgt WHERE f.op = 'D' OR f.pos > coalesce(a.cut, -1) AND f.pos > coalesce(b.cut, -1)),
e AS (SELECT relation_id, src_domain, src, tgt_domain, tgt FROM k JOIN live a ON a.domain_id = src_domain AND a.key = src JOIN live b ON b.domain_id = tgt_domain AND b.key = tgt GROUP BY ALL HAVING arg_max(op, pos) = 'I')
SELECT relation_name AS name, count(e.src) AS edges FROM graph_relations LEFT JOIN e USING (relation_id) GROUP BY 1""")
def delta_compact(spark: SparkSession, at: str) -> DataFrame:
    """The whole log of nodes and edges merged into the snapshot that was loaded before it begins: edges per relation."""
    edges, nodes, base, relations, domains = tables(spark, at, "edge_deltas", "node_deltas", "base_nodes", "graph_relations", "graph_domains")
    kinds = {r["domain_id"]: (r["domain_name"], r["key_type"]) for r in domains.distinct().collect()}
    named = {r["relation_id"]: r for r in relations.distinct().collect()}
    g = GraphSnapshot(spark)
    keyed = with_canonical_nodes(base, domains).filter("key IS NOT NULL")
    for i, (name, kind) in kinds.items():
        g = g.with_domain(name, dense_ids(keyed.filter(F.col("domain_id") == i).select("key").distinct(), "key"), key="key", key_type=kind)
    none = spark.createDataFrame([], "src long, dst long")
    for r in named.values():
        g = g.with_relation(r["relation_name"], kinds[r["src_domain_id"]][0], kinds[r["tgt_domain_id"]][0], none)
    first = lambda df, *keys: df.groupBy(*keys, "op", "delta_id").agg(F.min("kafka_offset").alias("offset"))
    of = F.create_map(*[x for i, (n, _) in kinds.items() for x in (F.lit(i), F.lit(n))])
    to = F.create_map(*[x for i, r in named.items() for x in (F.lit(i), F.lit(r["relation_name"]))])
    # a delta counts once, however its keys are spelled
    n = first(with_canonical_nodes(nodes, domains).filter("key IS NOT NULL"), "domain_id", "key").select("offset", "op", F.lit("node").alias("kind"), of[F.col("domain_id")].alias("name"), F.col("key").alias("src_key"), F.lit(None).cast("string").alias("dst_key"))
    e = with_canonical_edges(edges, relations, domains).filter("src IS NOT NULL AND tgt IS NOT NULL")
    e = first(e, "relation_id", "src", "tgt").select("offset", "op", F.lit("edge").alias("kind"), to[F.col("relation_id")].alias("name"), F.col("src").alias("src_key"), F.col("tgt").alias("dst_key"))
    log = materialize(n.unionByName(e), "log")
    return deltas.compact(g, log).inspect().select(F.col("relation").alias("name"), "edges")


# files


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/arclume-{name}-{uuid.uuid4().hex}"


@query("SELECT DISTINCT l_orderkey AS id FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size > 45")
def saved_snapshot(spark: SparkSession, at: str) -> DataFrame:
    """A snapshot written and read again; the walk against the edges reads the copy in the order of targets."""
    g, folder = graph(spark, at), _folder(spark, "saved")
    own = GraphSnapshot(spark, domains={n: g.domains[n] for n in ("Order", "Part")}).with_relation("CONTAINS", "Order", "Part", g.relation("CONTAINS").edges.select("src", "dst", "l_quantity"))
    own.save(folder)
    return load_snapshot(spark, folder).domain("Part").all().filter("node.p_size > 45").in_("CONTAINS").df()


@query("SELECT n_name AS key, n_regionkey AS region FROM nation")
def manifest_graph(spark: SparkSession, at: str) -> DataFrame:
    """Files that a YAML manifest names, with declared types and an inverse relation."""
    folder = _folder(spark, "manifest")
    nation, region = tables(spark, at, "nation", "region")
    nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("key"), F.col("n_regionkey").cast("string").alias("region")).write.parquet(f"{folder}/data/domains/Nation")
    region.select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("key")).write.parquet(f"{folder}/data/domains/Region")
    nation.select(F.col("n_nationkey").alias("src"), F.col("n_regionkey").alias("dst")).write.parquet(f"{folder}/data/relations/IN")
    write_text(spark, f"{folder}/graph.yaml", "graphName: world\ntablespaces: {main: {file: data}}\ndomains:\n  Nation: {tablespace: main, attributes: {region: int32}}\n  Region: {tablespace: main}\nrelations:\n  IN: {source: Nation, target: Region, tablespace: main, inverseAlias: HAS}\n")
    g = load_manifest(spark, f"{folder}/graph.yaml")
    found = g.domain("Region").all().out("HAS").with_attributes("key", "region")
    return found.select("key", "region")


@query("SELECT l_returnflag AS relation, count(*) AS edges FROM lineitem GROUP BY 1")
def imported_edges(spark: SparkSession, at: str) -> DataFrame:
    """Edges of a text file, a relation for each name in the third column."""
    folder = _folder(spark, "edges")
    table(spark, at, "lineitem").select(F.concat_ws("\t", "l_orderkey", "l_partkey", "l_returnflag").alias("value")).write.text(folder)
    return import_edges(spark, folder).inspect().select("relation", "edges")


@query("""SELECT 'LIVES_IN' AS relation, 'Customer' AS source, 'Nation' AS target, count(*) AS edges FROM customer UNION ALL SELECT 'IN_Nation_Region', 'Nation', 'Region', count(*) FROM nation UNION ALL SELECT 'IN_Supplier_Nation', 'Supplier', 'Nation', count(*) FROM supplier""")
def imported_typed(spark: SparkSession, at: str) -> DataFrame:
    """Typed nodes and edges by key; a label between several pairs of kinds becomes several relations."""
    customer, supplier, nation, region = tables(spark, at, "customer", "supplier", "nation", "region")
    key = lambda mark, c: F.concat(F.lit(mark), F.col(c).cast("string"))
    node = lambda df, mark, c, name, kind: df.select(key(mark, c).alias("key"), F.col(name).alias("name"), F.lit(kind).alias("kind"))
    nodes = node(customer, "c", "c_custkey", "c_name", "Customer").unionByName(node(supplier, "s", "s_suppkey", "s_name", "Supplier")).unionByName(node(nation, "n", "n_nationkey", "n_name", "Nation")).unionByName(node(region, "r", "r_regionkey", "r_name", "Region"))
    edge = lambda df, a, x, label, b, y: df.select(key(a, x).alias("src"), F.lit(label).alias("relation"), key(b, y).alias("dst"))
    edges = edge(customer, "c", "c_custkey", "LIVES_IN", "n", "c_nationkey").unionByName(edge(supplier, "s", "s_suppkey", "IN", "n", "s_nationkey")).unionByName(edge(nation, "n", "n_nationkey", "IN", "r", "n_regionkey"))
    lost = spark.createDataFrame([("c1", "LIVES_IN", "nowhere")], "src string, relation string, dst string")
    return import_typed(spark, nodes, edges.unionByName(lost)).inspect().select("relation", "source", "target", "edges")


@query("SELECT c_name AS key, count(*) AS orders FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def merged_snapshots(spark: SparkSession, at: str) -> DataFrame:
    """Two snapshots, by price of the order, merged by key: all orders are there again."""
    customer, orders = tables(spark, at, "customer", "orders")

    def part(where: str) -> GraphSnapshot:
        own = orders.filter(where)
        g = GraphSnapshot(spark).with_domain("Customer", customer.join(own, F.col("c_custkey") == F.col("o_custkey"), "left_semi"), "c_custkey", "c_name")
        return g.with_domain("Order", own, "o_orderkey").with_relation("PLACED", "Customer", "Order", own.select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")

    g = part("o_totalprice < 150000").merge(part("NOT o_totalprice < 150000"))
    names = g.domain_of("Customer").nodes.select(F.col("id").alias("src"), "key")
    return g.relation("PLACED").edges.join(names, "src").groupBy("key").agg(F.count(F.lit(1)).alias("orders"))


@query("SELECT s_name AS key, count(*) AS n, CAST(sum(l_partkey) AS BIGINT) AS parts FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1")
def binary_snapshot(spark: SparkSession, at: str) -> DataFrame:
    """A binary snapshot file written by tasks and read by ranges of edges, with its keys."""
    line, supplier, part = tables(spark, at, "lineitem", "supplier", "part")
    g = GraphSnapshot(spark).with_domain("Supplier", supplier, "s_suppkey", "s_name").with_domain("Part", part.select("p_partkey"), "p_partkey").with_relation("SUPPLIES", "Supplier", "Part", line.select("l_suppkey", "l_partkey"), "l_suppkey", "l_partkey")
    file = _folder(spark, "binary").removeprefix("file://") + ".bin"
    binary.write_binary(g, file)
    back = binary.load_binary(spark, file, verify=True)
    names = back.domain_of("Supplier").nodes.select(F.col("id").alias("src"), "key")
    return back.relation("SUPPLIES").edges.join(names, "src").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("dst").alias("parts"))
