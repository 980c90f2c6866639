import random
from collections import Counter

from pyspark.sql import functions as F

from arclume.operators.skew import fragment, fragment_replicate_join, live_degrees, pack, plan_fragments
from helpers import rows


def test_pack_is_balanced():
    at = pack([(i, 10) for i in range(12)] + [("big", 40)], 4)
    loads = Counter()
    for k, t in at.items():
        loads[t] += 40 if k == "big" else 10
    assert max(loads.values()) == 40 and sum(loads.values()) == 160


def test_large_key_is_split(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 4000).alias("k"), F.col("id").alias("v"))
    plan = plan_fragments(df, ["k"], tasks=8)
    assert max(plan.loads) < 1.3 * 20_000 / 8
    assert plan.large.count() == 1
    got = fragment(df, ["k"], ["v"], plan)
    sizes = [r[0] for r in got.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert sum(sizes) == 20_000 and max(sizes) < 1.3 * 20_000 / 8
    # a light key is in one task
    assert got.filter("k != 1").groupBy("k").agg(F.countDistinct("_task").alias("n")).filter("n > 1").count() == 0


def test_join_matches_plain_join(spark):
    rng = random.Random(3)
    left = spark.createDataFrame([(rng.choice([1, 1, 1, 2, 3, None, *range(4, 40)]), i, i) for i in range(600)], "k int, v int, x int")
    right = spark.createDataFrame([(k, k * 10) for k in [1, 1, 2, 5, 6, 7, 99]] + [(None, 5)], "k int, x int")
    for how in ("inner", "left"):
        got = fragment_replicate_join(left, right, ["k"], ["v"], tasks=4, how=how).select("k", "v", "x", "x_right")
        want = left.join(right.withColumnRenamed("x", "x_right"), "k", how).select("k", "v", "x", "x_right")
        assert rows(got) == rows(want)
    assert fragment_replicate_join(left.limit(0), right, ["k"], ["v"]).count() == 0
    assert fragment_replicate_join(left, right.limit(0), ["k"], ["v"], how="left").count() == 600


def test_live_degrees(spark):
    relations = spark.createDataFrame([(1, "r", 1, 1), (2, "s", 1, 1)], "relation_id int, relation_name string, src_domain_id int, tgt_domain_id int")
    domains = spark.createDataFrame([(1, "A", "string")], "domain_id int, domain_name string, key_type string")
    loaded = spark.createDataFrame([(1, 1, 3), (1, 1, 3), (2, 1, 1), (3, 1, None), (4, 1, -1)], "snapshot_id long, relation_id int, edge_count long")
    rng = random.Random(5)
    log, n = [], 0
    for _ in range(500):
        n += 1
        row = (n, rng.choice([1, 1, 1, 2, 9, None]), rng.choice(["hot", "hot", " hot", "a", "b", None]), rng.choice(["x", "y ", "z", None, *map(str, range(9))]), rng.choice("ID"))
        log += [(*row, 2 * n)] + [(*row, 2 * rng.randrange(n, 600) + 1)] * rng.choice([0, 0, 1])
    edges = spark.createDataFrame(log, "delta_id long, relation_id int, src_key string, tgt_key string, op string, kafka_offset long").withColumn("src_domain", F.lit("clash"))
    last, first = {}, {}
    for d, r, s, t, op, at in log:
        if r in (1, 2) and s is not None:
            first[d] = min(first.get(d, (1 << 60,)), (at, r, s.strip(), t and t.strip(), op))
    for at, r, s, t, op in sorted(first.values(), key=lambda x: x[0]):
        last[r, s, t] = op
    want = Counter()
    for (r, s, t), op in last.items():
        want[r, s] += op == "I" and t is not None
    got = live_degrees(edges, loaded, relations, domains, tasks=4)
    assert {(r["relation_id"], r["src_key"]): r["degree"] for r in got.collect()} == dict(want)
    assert {(r["relation_id"], r["edge_count"]) for r in got.collect()} == {(1, 4), (2, None)}
    assert live_degrees(edges.limit(0), loaded.limit(0), relations, domains).count() == 0


def test_hot_pair_is_split(spark):
    """A third of all deltas are of one source and target, the last of them a delete or not."""
    relations = spark.createDataFrame([(1, "r", 1, 1)], "relation_id int, relation_name string, src_domain_id int, tgt_domain_id int")
    domains = spark.createDataFrame([(1, "A", "string")], "domain_id int, domain_name string, key_type string")
    loaded = spark.createDataFrame([(1, 1, 3)], "snapshot_id long, relation_id int, edge_count long")
    for op in "ID":
        log = [(i, 1, "hot" if i % 3 < 2 else f"s{i}", "one" if i % 3 == 0 else f"t{i}", "ID"[i % 2], 10 * i) for i in range(3000)]
        log += [(9000, 1, "hot", "one", op, 90_000), (9000, 1, "hot", "one", op, 95_000), (1500, 1, "hot", "one", "I", 99_000)]
        edges = spark.createDataFrame(log, "delta_id long, relation_id int, src_key string, tgt_key string, op string, kafka_offset long").repartition(5)
        got = {r["src_key"]: r["degree"] for r in live_degrees(edges, loaded, relations, domains, tasks=8).collect()}
        assert got["hot"] == sum(i % 3 == 1 and i % 2 == 0 for i in range(3000)) + (op == "I")
        assert len(got) == 1001


def test_units_follow_tasks(spark):
    plan = plan_fragments(spark.range(10).withColumnRenamed("id", "k"), ["k"], tasks=100_000)
    assert plan.n_units >= 2 * plan.tasks
