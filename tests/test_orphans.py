import random

import pytest

from arclume.operators.orphans import ForeignKey, cascade, edge_orphans, missing_as_of, orphan_report
from helpers import rows

OWNING = ["userPostsPost"]


@pytest.mark.parametrize("segment", [4, 7, 1 << 20])
def test_missing_as_of_against_brute_force(spark, segment):
    rng = random.Random(segment)
    history = [(rng.choice("abc"), rng.randrange(60), rng.random() < 0.6) for _ in range(40)] + [(None, 3, True), ("a", None, True), ("b", 5, None)]
    refs = [(i, rng.choice(["a", "b", "c", "hot", "hot", "hot", None]), rng.choice([*range(60), None])) for i in range(300)]
    got = missing_as_of(spark.createDataFrame(refs, "n int, k string, at long"), spark.createDataFrame(history, "k string, at long, live boolean"), ["k"], "at", "live", segment)

    def live(k, at):
        seen = [(t, not on) for x, t, on in history if x == k and t is not None and on is not None and t <= at]
        return bool(seen) and not max(seen)[1]

    want = {n for n, k, at in refs if k is not None and at is not None and not live(k, at)}
    assert {r["n"] for r in got.collect()} == want
    assert got.columns == ["n", "k", "at"] or set(got.columns) == {"n", "k", "at"}


def test_missing_as_of_empty(spark):
    refs = spark.createDataFrame([(1, "a", 5)], "n int, k string, at long")
    none = spark.createDataFrame([], "k string, at long, live boolean")
    assert missing_as_of(refs, none, ["k"], "at", "live").count() == 1
    assert missing_as_of(refs.limit(0), none, ["k"], "at", "live").count() == 0


def test_cascade_direct_inherited_and_cycles(spark):
    a = spark.createDataFrame([(1, None), (2, 99), (2, 99)], "id int, up int")
    b = spark.createDataFrame([(10, 1), (11, 2), (12, 7), (13, None)], "id int, a int")
    c = spark.createDataFrame([(20, 11, 21), (21, 12, 20), (22, 10, None), (23, None, 21)], "id int, b int, c int")
    fks = [ForeignKey("up", "a", ("up",), "a", ("id",)), ForeignKey("a", "b", ("a",), "a", ("id",)), ForeignKey("b", "c", ("b",), "b", ("id",)), ForeignKey("c", "c", ("c",), "c", ("id",))]
    got = cascade({"a": a, "b": b, "c": c}, {"a": "id", "b": "id", "c": "id"}, fks)
    assert rows(got.select("table_name", "row_key", "kind", "round")) == [
        ("a", "2", "direct", 0), ("b", "11", "inherited", 1), ("b", "12", "direct", 0), ("c", "20", "inherited", 2), ("c", "21", "inherited", 1), ("c", "23", "inherited", 2),
    ]
    assert cascade({"a": a.limit(0), "b": b}, {"a": "id", "b": "id"}, fks[1:2]).filter("kind = 'direct'").count() == 3


def test_cascade_raises_if_cut_short(spark):
    a = spark.createDataFrame([(1, 0), (2, 1), (3, 2)], "id int, up int")
    fks = [ForeignKey("up", "a", ("up",), "a", ("id",))]
    assert cascade({"a": a}, {"a": "id"}, fks, max_rounds=2).count() == 3
    with pytest.raises(RuntimeError):
        cascade({"a": a}, {"a": "id"}, fks, max_rounds=1)


def test_edge_orphans(spark):
    relations = spark.createDataFrame([(2, "userPostsPost", 1, 3), (10, "likes", 1, 3)], "relation_id int, relation_name string, src_domain_id int, tgt_domain_id int")
    domains = spark.createDataFrame([(1, "User", "int64"), (3, "Post", "int64")], "domain_id int, domain_name string, key_type string")
    base = spark.createDataFrame([(1, 0, "1", None), (1, 0, " 1", "twice"), (3, 0, "50", None)], "domain_id int, dense_id long, node_key string, node_name string")
    nodes = spark.createDataFrame([(1, 10, "I", 1, "2"), (2, 20, "D", 1, "+2"), (1, 30, "I", 1, "2"), (3, 40, "I", 1, None)], "delta_id long, kafka_offset long, op string, domain_id int, node_key string")
    ts = "2024-01-02 03:04:05"
    edges = spark.createDataFrame(
        [
            (1, 5, "I", 2, "2", "50", ts),  # user 2 comes later
            (2, 15, "I", 2, "2", "50", ts),
            (2, 25, "I", 2, "2", "50", ts),  # again, when the user is gone
            (3, 25, "I", 2, "2", "50", None),
            (4, 26, "I", 77, "9", "9", ts),
            (5, 27, "I", None, "9", "9", ts),
            (6, 28, "D", 2, "9", "9", ts),
            (7, 29, "I", 10, None, "51", ts),
            (8, 31, "I", 10, "1", "50", ts),
        ],
        "delta_id long, kafka_offset long, op string, relation_id int, src_key string, tgt_key string, event_ts string",
    ).withColumn("event_ts", __import__("pyspark").sql.functions.to_timestamp("event_ts"))
    got = edge_orphans(edges, nodes, base, relations, domains, OWNING)
    assert rows(got.filter("kind = 'direct'").select("delta_id", "ref_field")) == [(1, "src_key"), (3, "src_key"), (4, "relation_id"), (7, "tgt_key")]
    assert rows(got.filter("kind = 'inherited'").select("delta_id", "ref_field")) == [(8, "tgt_key")]
    assert {r["day"] is None for r in got.filter("delta_id = 3").collect()} == {True}
    assert orphan_report(got).agg({"refs": "sum"}).first()[0] == 5
    empty = edge_orphans(edges.limit(0), nodes.limit(0), base.limit(0), relations, domains, OWNING)
    assert empty.count() == 0
    assert edge_orphans(edges, nodes.limit(0), base.limit(0), relations.limit(0), domains, OWNING).filter("ref_field = 'relation_id'").count() == 6


def test_orphans_pass_down_a_chain(spark):
    """The nodes exist, but the edges that bring them in hang on a lost user: each step down the chain inherits a round later; many owning relations."""
    n = 1_100
    relations = spark.createDataFrame([(i, f"r{i}", 1, 1) for i in range(n)], "relation_id int, relation_name string, src_domain_id int, tgt_domain_id int")
    domains = spark.createDataFrame([(1, "N", "int64")], "domain_id int, domain_name string, key_type string")
    base = spark.createDataFrame([(1, str(k)) for k in range(1, 12)], "domain_id int, node_key string")
    nodes = spark.createDataFrame([], "delta_id long, kafka_offset long, op string, domain_id int, node_key string")
    chain = [(i, 100 + i, "I", n - 1 - i, str(i), str(i + 1), None) for i in range(10)]  # 0 is lost
    edges = spark.createDataFrame(chain, "delta_id long, kafka_offset long, op string, relation_id int, src_key string, tgt_key string, event_ts timestamp")
    got = edge_orphans(edges, nodes, base, relations, domains, [f"r{i}" for i in range(n)])
    assert rows(got.select("delta_id", "ref_field", "kind", "round")) == sorted([(0, "src_key", "direct", 0)] + [(i, "src_key", "inherited", i) for i in range(1, 10)], key=repr)
    assert edge_orphans(edges, nodes, base, relations, domains, []).count() == 1
