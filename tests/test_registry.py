"""Registry, statements and the session's tables."""

import threading

import pytest
from pyspark.sql import functions as F

from arclume import api, session
from arclume.operators import walks
from arclume.sources.snapshot import GraphSnapshot
from helpers import ids, rows


def graph(spark, *edges):
    nodes = spark.createDataFrame([(i, f"n{i}", i * 1.5) for i in range(8)], "id long, name string, w double")
    return GraphSnapshot(spark).with_domain("N", nodes).with_relation("r", "N", "N", spark.createDataFrame(list(edges), "src long, dst long"))


def test_swap_and_register_take_effect(spark):
    reg = api.QueryRegistry(graph(spark, (0, 1)))
    reg.register("q", "FROM N WHERE id = 0 -> out('r')")
    assert ids(reg.df("q")) == {1} and reg.df("q") is reg.df("q")
    reg.swap(graph(spark, (0, 7)))  # the same version number
    assert ids(reg.df("q")) == {7}
    reg.register("q", "FROM N WHERE id = 7 -> in('r')")
    assert ids(reg.df("q")) == {0}


def test_gate_compiles_queries_with_parameters(spark):
    reg = api.QueryRegistry(graph(spark, (0, 1)))
    reg.register("p", "FROM N WHERE id = $who -> out('r') -> filter('node.w > @least && node.name in @names')")
    reg.register("t", "FROM N WHERE id = $who -> out('r') -> filter('node.name == @name')")
    assert reg.validate(reg.snap, {"p": {"least": 1.0, "names": ["n1"]}}) == {}
    bare = GraphSnapshot(spark).with_domain("N", spark.range(3)).with_relation("r", "N", "N", spark.createDataFrame([(0, 1)], "src long, dst long"))
    with pytest.raises(ValueError, match="kept out"):
        reg.swap(bare)
    assert set(reg.validate(bare)) == {"p", "t"} and reg.snap is not bare


def test_drain_waits_for_the_old_snapshot(spark):
    reg = api.QueryRegistry(graph(spark, (0, 1)))
    reg.register("q", "FROM N WHERE id = 0 -> out('r')")
    inside, go = threading.Event(), threading.Event()
    seen = []

    def slow(df):
        inside.set()
        go.wait(60)
        seen.append(ids(df))

    t = threading.Thread(target=lambda: reg("q", slow))
    t.start()
    inside.wait(60)
    reg.swap(graph(spark, (0, 2)))
    assert not reg.drain(0, 0.05)
    assert reg("q", ids) == {2}
    go.set()
    assert reg.drain(0, 60) and t.join() is None and seen == [{1}]
    text = reg.metrics.exposition()
    assert 'arclume_query_seconds_bucket{le="+Inf"} 2' in text and "arclume_queries_total 2" in text and "arclume_compile_seconds_count" in text


def test_row_reader(spark):
    df = spark.createDataFrame([(1, "a", 2.75), (2, None, None)], "id long, name string, w double")
    r = api.RowReader(df, "n_id")
    with pytest.raises(LookupError):
        r.get_long()
    assert r.next() and (r.get_double("w"), r.get_double(2), r.get_string("name"), r.get_long("n_id"), r.get_node_id()) == (2.75, 2.75, "a", 1, 1)
    with pytest.raises(KeyError):
        r.get_long("x")
    assert r.next() and r.is_null("w") and r.get_string("name") is None and not r.next()
    counted = api.prepare(graph(spark, (0, 1), (0, 2)), "FROM N WHERE id = 0 -> out('r') -> count()").execute()
    assert counted.next() and counted.get_long("count") == 2
    named = api.prepare(graph(spark, (0, 2), (0, 1)), "FROM N WHERE id = 0 -> out('r')").execute()
    assert named.next() and named.get_long("n_id") == 1


def test_times_are_compared_at_the_scan(spark, tmp_path):
    spark.sql("SELECT id, timestamp_micros(id * 1000000) AS at, date_from_unix_date(CAST(id AS INT)) AS day, CAST(timestamp_micros(id * 1000000) AS TIMESTAMP_NTZ) AS wall FROM range(10)").write.parquet(f"{tmp_path}/n")
    g = GraphSnapshot(spark).with_domain("N", spark.read.parquet(f"{tmp_path}/n"))
    for where in ("node.at >= 3000000 && node.at < 7000000", "node.day >= 3 && 7 > node.day", "node.wall >= 3000000 && node.wall < 7000000"):
        t = g.domain("N").all().filter(where)
        assert ids(t.df()) == {3, 4, 5, 6}
        plan = t.explain(physical=True)
        assert "GreaterThanOrEqual(" in plan and "LessThan(" in plan, where
    assert ids(g.domain("N").all().filter("node.at / 1000000 == 4").df()) == {4}
    assert ids(g.domain("N").all().filter("node.at > 1.0 && node.day < 2").df()) == {1}


def test_shared_folder_is_needed_off_a_local_master(spark):
    class Far:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

        class conf:  # noqa: N801
            get = staticmethod(lambda name, default=None: None)

    with pytest.raises(RuntimeError, match="checkpoint"):
        session.shared_dir(Far())


def test_rounds_and_release(spark):
    found = session.Rounds("t")
    for i in range(20):
        found.add(session.materialize(spark.range(i, i + 1), "t"), 1)
        assert len(found.parts) <= session.Rounds.PARTS
    assert ids(found.all()) == set(range(20))
    gone = session.materialize(spark.range(3), "t")
    session.release(gone, spark.range(1))
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(gone._arclume_path).count()


def test_operators_are_read_from_the_plan_not_from_names(spark, tmp_path):
    spark.range(3).withColumnRenamed("id", "Join").write.parquet(f"{tmp_path}/Sort Aggregate Exchange")
    df = spark.read.parquet(f"{tmp_path}/Sort Aggregate Exchange")
    assert session.reusable(df) is df
    assert session.reusable(df.groupBy("Join").count())._arclume_path


@pytest.mark.parametrize("tasks", [1, 3, 7])
def test_neighbours_of_a_hub(spark, tasks):
    edges = [(0, (i * 37) % 101) for i in range(300)] + [(i % 9, i) for i in range(60)] + [(None, 4), (None, 2)]
    df = spark.createDataFrame(edges, "src long, dst long")
    got = rows(walks.ranked(df, "src", "dst", tasks=tasks).select("src", "position", "dst"))
    want = []
    for s in {e[0] for e in edges}:
        want += [(s, i + 1, d) for i, d in enumerate(sorted(b for a, b in edges if a == s))]
    assert got == sorted(want, key=repr)


def test_random_walk(spark):
    edges = spark.createDataFrame([(0, 1), (0, 2), (1, 0), (2, 3), (2, 3)], "src long, dst long")
    got = rows(walks.random_walk(edges, spark.range(5), 6, seed=3))
    assert got == rows(walks.random_walk(edges.repartition(3), spark.range(5), 6, seed=3))
    steps = {(s, n): i for s, n, i in got}
    pairs = {(0, 1), (0, 2), (1, 0), (2, 3)}
    assert all((steps[s, n - 1], i) in pairs for (s, n), i in steps.items() if n) and steps[3, 0] == 3 and (3, 1) not in steps
    draws = {r[0] for r in spark.range(200).select(walks.draw(F.col("id"), F.lit(1), 0) % 2).collect()}
    assert draws == {0, 1}
