import random

import pytest
from pyspark.sql import functions as F

from arclume import api
from arclume.functions.cel import ExpressionError
from arclume.operators import walks
from arclume.plans import cypher, sexpr
from arclume.sources.snapshot import GraphSnapshot
from helpers import ids, rows


def small(spark, edges, n=None, keys=None, **attributes):
    n = n or max(max(e[:2]) for e in edges) + 1
    nodes = spark.createDataFrame([(i, (keys or [])[i] if keys else str(i), *[v[i] for v in attributes.values()]) for i in range(n)], ["id", "key", *attributes])
    rel = spark.createDataFrame([(*e, 1.0)[:3] if len(e) == 2 else e for e in edges], "src long, dst long, weight double")
    return GraphSnapshot(spark).with_domain("User", nodes, key="key").with_relation("knows", "User", "User", rel)


KNOWS = [(0, 1), (0, 2), (1, 2), (1, 3), (2, 3)]
NAMES = ["usr_alice", "usr_bob", "usr_charlie", "usr_dave"]


@pytest.fixture(scope="module")
def knows(spark):
    return small(spark, KNOWS, keys=NAMES, age=[30, 20, None, 40])


def test_walks(knows):
    d = knows.domain("User")
    assert d.from_(0).out("knows").to_list() == [1, 2]
    assert d.from_(0, 1).out("knows").to_set() == {1, 2, 3}
    assert d.from_(0, 1, 1).count() == 2
    assert 0 not in d.all().out("knows").to_set()
    assert d.from_(3).in_("KNOWS").to_set() == {1, 2}
    assert d.from_key("usr_alice").out("knows").to_key_list() == ["usr_bob", "usr_charlie"]
    assert d.from_key("usr_alice").out("knows").intersect(d.from_key("usr_bob").out("knows")).to_key_set() == {"usr_charlie"}
    assert d.from_(77).out("knows").to_list() == []
    assert d.from_().out("knows").count() == 0 and not d.from_().out("knows").exists()
    assert d.from_(0).out2("knows", "knows").to_set() == d.from_(0).out("knows").out("knows").to_set() == {2, 3}
    assert d.from_(0, 1).out("knows", reducer="AND").to_set() == {2}
    assert d.from_(0).out_between("knows", 0, 2).to_set() == {0, 1, 2, 3}
    assert d.from_(0).repeat(2, lambda s: s.out("knows")).to_set() == {2, 3}
    assert d.from_(0).repeat(2, lambda s: s.out("knows"), emit="all").to_set() == {1, 2, 3}
    assert d.from_(1).repeat_until_stable(lambda s: s.out("knows")).to_set() == {1, 2, 3}
    assert d.from_(1).repeat_until_stable(lambda s: s.out("knows"), include_seed=False).to_set() == {2, 3}


def test_filters(knows):
    d = knows.domain("User")
    assert d.all().filter("node.age >= 21").to_set() == {0, 3}
    assert d.all().filter("age >= 21 && id < 3").to_set() == {0}
    assert d.from_(1).out("knows", "dest.age > 30").to_set() == {3}
    assert d.all().out("knows", "src.age < 25").to_set() == {2, 3}
    assert d.all().filter("age > @least").with_param("least", 35).to_set() == {3}
    assert d.from_(0).out_attribute("knows", "weight", ">", 1.0).count() == 0
    for bad in ("node.height > 1", "edge.weight > 1", "age >", "@x > 1"):
        with pytest.raises(ExpressionError):
            d.all().filter(bad).df()
    with pytest.raises(KeyError):
        d.all().out("hates").df()
    with pytest.raises(KeyError):
        d.from_key("usr_nobody").df()
    assert d.to_dense_id("usr_bob") == 1 and d.to_dense_id("x_3") == 3 and d.to_dense_id("2") == 2 and d.to_dense_id("zzz") == -1 and d.to_key(3) == "usr_dave" and d.to_key(9) == "User_9"


def test_reverse_without_transpose(spark):
    assert small(spark, [(0, 1), (0, 2), (1, 3), (2, 1)], 5).domain("User").from_(1).in_("knows").to_set() == {0, 2}
    assert small(spark, [(0, 1), (0, 2), (1, 3), (2, 0)], 5).domain("User").from_(1).in_("knows").to_set() == {0}
    assert small(spark, [(0, 1), (0, 2), (1, 3), (2, 3)], 4).domain("User").from_(0).out("knows").out("knows").to_list() == [3]
    assert len(small(spark, [(0, 5)] * 50 + [(5, i) for i in range(10, 110)], 200).domain("User").from_(0).out2("knows", "knows").to_list()) == 100


def test_state(spark):
    g = small(spark, [(0, 2, 5.0), (1, 2, 3.0), (1, 2, 4.0), (0, 3, 1.0), (1, 3, 1.0)], 4, cost=[10.0, 20.0, 0.0, 0.0])
    t = g.domain("User").from_(0, 1)
    all_ = "state.lo:MIN = edge.weight, state.hi:MAX = edge.weight, state.sum:SUM = src.cost + edge.weight, state.n:COUNT = 1, state.mean:AVG = edge.weight, state.any:ANY = edge.weight, state.or:OR = edge.weight > 4.0, state.and:AND = edge.weight > 2.0, state.via:ARGMIN(lo) = src.id, state.far:ARGMAX(hi) = src.id"
    got = {r["id"]: r.asDict() for r in t.out_with_state("knows", all_).df().collect()}
    assert got[2] == {"id": 2, "lo": 3.0, "hi": 5.0, "sum": 15.0 + 23.0 + 24.0, "n": 3, "mean": 4.0, "any": 3.0, "or": True, "and": True, "via": 1, "far": 0}
    assert got[3]["via"] == 0 and got[3]["far"] == 0 and got[3]["and"] is False
    chained = g.domain("User").from_(0).project("state.c = node.cost").out_with_state("knows", "state.c:MIN = state.c + edge.weight").filter("state.c > 12.0")
    assert rows(chained.df()) == [(2, 15.0)]
    assert t.attribute("cost").reduce("sum").first()[0] == 30.0
    assert t.attribute("cost").reduce("argmax").first()[0] == 1
    assert t.reduce("max", "-cost").first()[0] == -10.0 and t.reduce("max", "log(cost)", positive=True).first()[0] == t.reduce("max", "log(cost)").first()[0] and t.reduce("avg", "cost * 2.0").first()[0] == 30.0
    assert rows(t.with_attributes("cost", "key")) == [(0, 10.0, "0"), (1, 20.0, "1")]
    empty = g.domain("User").from_().attribute("cost")
    assert [empty.reduce(k).first()[0] for k in ("sum", "min", "argmin", "first", "count")] == [None, None, None, None, 0]
    with pytest.raises(ExpressionError):
        t.out_with_state("knows", "state.x:SUM = src.id").df()


def test_batches_equal_single_runs(spark):
    rng = random.Random(1)
    g = small(spark, [(rng.randrange(12), rng.randrange(12)) for _ in range(30)], 12)
    d = g.domain("User")
    got = d.batch(g.domain_of("User").nodes).out("knows").repeat_until_stable(lambda s: s.out("knows")).in_("knows").df()
    pairs = {(r["seed"], r["id"]) for r in got.collect()}
    for s in range(0, 12, 5):
        assert {i for a, i in pairs if a == s} == d.from_(s).out("knows").repeat_until_stable(lambda x: x.out("knows")).in_("knows").to_set()


def test_random_walks_against_sets(spark):
    rng = random.Random(7)
    for _ in range(3):
        edges = [(rng.randrange(15), rng.randrange(15)) for _ in range(rng.randrange(1, 40))]
        d = small(spark, edges, 15).domain("User")
        seed = {rng.randrange(15) for _ in range(3)}
        out = lambda f: {b for a, b in edges if a in f}  # noqa: E731, B023
        back = lambda f: {a for a, b in edges if b in f}  # noqa: E731, B023
        assert d.from_(seed).out("knows").in_("knows").out("knows").to_set() == out(back(out(seed)))
        reach = set(seed)
        while out(reach) - reach:
            reach |= out(reach)
        assert d.from_(seed).repeat_until_stable(lambda s: s.out("knows")).to_set() == reach


def test_virtual_relations(spark):
    g = small(spark, [(0, 1), (1, 2)], 4)
    g = g.with_relation("likes", "User", "User", spark.createDataFrame([(0, 3)], "src long, dst long")).with_virtual_relation("any", ["knows", "likes"])
    assert g.domain("User").from_(0).out("any").to_set() == {1, 3}
    assert g.domain("User").from_(0).out("any", "edge.component == 'likes'").to_set() == {3}
    plan = g.relation("any").edges.filter("component = 'likes'")._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan


def test_cypher_and_statements(knows):
    d = knows.domain("User")
    assert ids(api.prepare(knows, "MATCH (a:User {key: 'usr_alice'})-[:knows]->(b) RETURN b").df()) == {1, 2}
    assert api.prepare(knows, "MATCH (a)-[e:knows*2..2]->(b:User) WHERE id(a) = $x RETURN count(b)").bind("x", 0).execute_scalar() == 2
    assert ids(api.prepare(knows, "MATCH (a)<-[:`knows`]-(b) WHERE a.age > 35 AND b.age <= 20 RETURN DISTINCT b // all\n").df()) == {1}
    assert ids(api.prepare(knows, "MATCH (a)-[:knows]->(m)-[:knows]->(b) WHERE a.id = 0 AND b.id = 3 RETURN m").df()) == {1, 2}
    s = api.prepare(knows, "FROM User WHERE id = $id -> out('knows')")
    assert [s.bind("id", 0).df().count(), sorted(ids(s.bind("id", 1).df()))] == [2, [2, 3]]
    reader = s.bind_node("$id", 0).execute()
    assert [reader.next() and reader.get_long(), reader.next() and reader.get_string(), reader.next()] == [1, "2", False] and reader.names == ["user_id"]
    assert s.bind("id", [0, 1]).count() == 3
    for bad in ("MATCH (a)-[:knows*]->(b) RETURN b", "MATCH (a)-[:knows]-(b) RETURN b", "MATCH (a)-[]->(b) RETURN b", "MATCH (a)-[:knows]->(b) RETURN b.name", "MATCH (a)-[:knows]->(b) WHERE c.x = 1 RETURN b", "MATCH (a)-[:knows]->(b) RETURN c", "MATCH (a)-[:knows]->(a) RETURN a", "MATCH (a)-[:x|y]->(b) RETURN b", "MATCH (a)-[:knows]->(b) WHERE a.x = 1 OR b.x = 2 RETURN b"):
        with pytest.raises(cypher.CypherError):
            cypher.compile_cypher(bad)
    q = d.from_(0, 1).out("knows", "edge.weight > 0.5 && 'a\"b' != ''").filter("age > 1").repeat(2, lambda x: x.in_("knows")).repeat_until_stable(lambda x: x.walk("knows")).union(d.from_key("usr_bob").out_with_state("knows", "state.x:MIN = edge.weight")).with_param("p", 1.5).query
    assert sexpr.parse(sexpr.show(q)) == q
    assert ids(api.run(sexpr.parse('(program (domain "User") (seed ids 0) (csr-walk "knows") (collect-bitset))'), knows)) == {1, 2}
    for bad in ("(program", "(program))", "(walk x)", "(program (fly away))"):
        with pytest.raises(ValueError):
            sexpr.parse(bad)


def test_builder_registry(spark, knows):
    b = api.TypedBuilder(knows.domain("User").from_(0), "User")
    assert ids(b.walk_knows().filter_age(">=", 20).traversal.df()) == {1}
    with pytest.raises(AttributeError):
        b.walk_hates()
    r = api.QueryRegistry(knows)
    r.register("friends", knows.domain("User").from_(0).out("knows"))
    assert r("friends", lambda df: df.count()) == 2 and r.df("friends") is r.df("friends")
    other = small(spark, [(0, 3)], 4)
    old = r.df("friends")
    from dataclasses import replace

    with pytest.raises(ValueError):
        r.swap(GraphSnapshot(spark, version=5))
    r.swap(replace(other, version=1))
    assert ids(r.df("friends")) == {3} and ids(old) == {1, 2} and r.drain(0, 1) and "swaps_total 1" in r.metrics.exposition() and r.health()["queries"] == 1
    api.register_function("twice", lambda c: c * 2)
    assert knows.domain("User").all().filter("twice(age) > 70.0").to_set() == {3}


def test_vector_operators(spark):
    e = spark.createDataFrame([(0, 1, 2.0), (0, 1, 3.0), (1, 2, None)], "src long, dst long, w double")
    nodes = spark.range(3)
    x = nodes.withColumn("value", (F.col("id") + 1).cast("double"))
    assert rows(walks.semiring_product(e, x, nodes)) == [(0, 4.0), (1, 3.0), (2, 0.0)]
    assert rows(walks.semiring_product(e, x, nodes, "min_plus", "w")) == [(0, 4.0), (1, 4.0), (2, None)]
    assert rows(walks.degree(e, nodes)) == [(0, 2), (1, 1), (2, 0)]
    assert rows(walks.neighbors(e))[:2] == [(0, 1, 1), (0, 2, 1)]
    assert rows(walks.elementwise(x, x.filter("id < 1"), "add", True)) == [(0, 2.0), (1, 2.0), (2, 3.0)]
    assert rows(walks.elementwise(x, x.withColumn("value", F.lit(0.0)), "div", False)) == rows(x)
    assert walks.l1_distance(x, walks.scale(x, 2.0)).first()[:] == (6.0, False)
    bad = spark.createDataFrame([(0, 1.0), (1, float("nan")), (2, float("inf"))], "id long, value double")
    with pytest.raises(ArithmeticError, match="1"):
        walks.assert_finite(bad)
    assert walks.is_subset(nodes.filter("id < 2"), nodes).first()[0] and not walks.is_subset(nodes, nodes.limit(0)).first()[0]
    assert walks.sample_neighbors(e, 1).count() == 2
    steps = rows(walks.random_walk(e, nodes, 3))
    assert (0, 2, 2) in steps and not any(s == 2 and n for s, n, _ in steps)
