"""Queries of the part graph take every row of lineitem and part, against plain Python on a small fixture."""

from collections import Counter

import pytest

import __spark_entry__ as entry
from helpers import ids, rows

#: Parts of the lines of each order; keys beyond any small range, one part twice in a row, a cycle, and a part in no order.
ORDERS = {1: [500, 400, 700], 2: [500, 400, 500], 3: [700, 900], 4: [900, 20_000], 5: [20_000, 700], 6: [1, 1]}
PARTS = [1, 2, 400, 500, 700, 900, 20_000]
PAIRS = Counter(p for parts in ORDERS.values() for p in zip(parts, parts[1:]))


@pytest.fixture(scope="module")
def at(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(o, n, p) for o, parts in ORDERS.items() for n, p in enumerate(parts)], "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(p,) for p in PARTS], "p_partkey long").write.parquet(f"{folder}/part.parquet")
    return str(folder)


def paths_through(source):
    """Shares of the shortest paths from ``source`` through every node, path by path."""
    score, level = Counter(), [(source,)]
    seen = {source}
    while level:
        level = [(*p, b) for p in level for a, b in PAIRS if a == p[-1] and b not in seen]
        ends = Counter(p[-1] for p in level)
        for p in level:
            for x in p[1:-1]:
                score[x] += 1 / ends[p[-1]]
        seen |= ends.keys()
    return score


def test_part_graph_is_whole(spark, at):
    run = lambda name: entry.queries()[name](spark, at)
    assert dict(rows(run("mxv"))) == {p: float(sum(b for a, b in PAIRS if a == p)) for p in PARTS}
    assert ids(run("k_core_2")) == {700, 900, 20_000}
    want = Counter()
    for p in PARTS:
        if p % 50 == 0:
            want.update(paths_through(p))
    assert {k: v for k, v in rows(run("betweenness")) if v} == pytest.approx({k: v for k, v in want.items() if v}, abs=1e-6)
    assert {r["start"] for r in run("random_walks").collect()} == set(PARTS)
    assert dict(rows(run("cc_labels"))) == {1: 1, 2: 2} | {p: 400 for p in PARTS[2:]}
    assert run("triangles").first()[0] == 1 and run("triangle_sweep").first()[0] == sum((u, v) in PAIRS and (u, w) in PAIRS and (v, w) in PAIRS for u in PARTS for v in PARTS if v > u for w in PARTS)


def test_trade_network_is_whole(spark, tmp_path):
    # customers and suppliers by nation; a ring of nations 0 to 3 with a tail to 4, all from orders with high keys
    trade = {100: (0, 1), 200: (1, 2), 300: (2, 3), 400: (3, 0), 500: (4, 3), 600: (2, 2)}
    for name, columns, data in (
        ("lineitem", "l_orderkey long, l_suppkey long", [(o, s) for o, (_, s) in trade.items()]),
        ("orders", "o_orderkey long, o_custkey long", [(o, c) for o, (c, _) in trade.items()]),
        ("customer", "c_custkey long, c_nationkey int", [(n, n) for n in range(5)]),
        ("supplier", "s_suppkey long, s_nationkey int", [(n, n) for n in range(5)]),
    ):
        spark.createDataFrame(data, columns).write.parquet(f"{tmp_path}/{name}.parquet")
    assert rows(entry.queries()["islands_n1"](spark, str(tmp_path))) == [(304, 1)]
    two = rows(entry.queries()["islands_n2"](spark, str(tmp_path)))
    ring = [1, 3, 102, 203]
    assert two == sorted([(a, b, 1) for i, a in enumerate(ring) for b in ring[i + 1 :]] + [(a, 304, 1) for a in ring], key=repr)


def test_seeds_are_whole(spark, at, tmp_path):
    assert dict(rows(entry.queries()["heavy_hitters_sketch"](spark, at))) == Counter(p for parts in ORDERS.values() for p in parts)
    names = {"s_suppkey": [1, 2, 3], "s_name": ["a", "b", "c"]}
    spark.createDataFrame(list(zip(*names.values())), "s_suppkey long, s_name string").write.parquet(f"{tmp_path}/supplier.parquet")
    assert rows(entry.queries()["keys_roundtrip"](spark, str(tmp_path)).select("id", "key")) == list(zip(*names.values()))
