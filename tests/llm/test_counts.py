"""Frequent values, overlaps and distinct counts against brute force."""

import random
from collections import Counter, defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from arclume.llm import distinct, frequent, overlap
from helpers import rows


def hot(spark, n=6000, parts=5):
    rng = random.Random(4)
    data = [(rng.choice([1, 2, None]), rng.choice(["hot", "hot", "warm", None, *map(str, range(9))]) if rng.random() < 0.5 else f"r{i}", i) for i in range(n)]
    return data, spark.createDataFrame(data, "a int, n string, leader int").repartition(parts)


@pytest.mark.parametrize("most", [1 << 20, 50])
def test_frequent_values(spark, most, monkeypatch):
    monkeypatch.setattr(frequent.local_counts, "__defaults__", (most,))
    data, df = hot(spark)
    want = Counter((a, n) for a, n, _ in data if a is not None and n is not None)
    got = frequent.frequent_values(df, ["a", "n"], min_share=0.004)
    assert {(r["a"], r["n"]): r["n_"] for r in got.collect()} == {k: c for k, c in want.items() if c * 250 >= len(data)}
    top = frequent.frequent_values(df, ["a", "n"], k=5)
    assert [tuple(r) for r in top.collect()] == [(*k, c) for k, c in sorted(want.items(), key=lambda x: (-x[1], x[0]))[:5]]
    # a long tail on many nodes, where no share of a node reaches one row: bounds of the leaders rule it out
    assert [r[-1] for r in frequent.frequent_values(df.repartition(40), ["a", "n"], k=3).collect()] == sorted(want.values(), reverse=True)[:3]
    both = frequent.frequent_values(df.select("n"), ["n"], k=1, min_share=0.01)
    assert both.first()["n"] == "hot"


def test_frequent_values_edges(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)] * 3 + [(None,)] * 4, "v string")
    assert rows(frequent.frequent_values(df, ["v"], min_share=0.3)) == [("a", 3), ("b", 3)]  # exactly at the share
    assert rows(frequent.frequent_values(df, ["v"], k=9)) == [("a", 3), ("b", 3)]
    assert frequent.frequent_values(df.limit(0), ["v"], k=3).count() == 0
    assert frequent.frequent_values(df.filter("v is null"), ["v"], min_share=0.1).count() == 0
    with pytest.raises(ValueError):
        frequent.frequent_values(df, ["v"])


def test_overlap_sizes(spark, monkeypatch):
    monkeypatch.setattr(overlap, "BLOCK", 3)
    rng = random.Random(8)
    data = [(rng.choice([1, 2]), rng.choice("abcdefghij"), rng.choice([None, 0, *range(40)])) for _ in range(900)] + [(1, g, 0) for g in "abcdefghij"] + [(None, "x", 1), (None, "y", 1), (1, None, 3)]
    sizes, pairs = overlap.overlap_sizes(spark.createDataFrame(data, "scope int, grp string, member int").withColumn("sig", F.lit("clash")))
    sets = defaultdict(set)
    for s, g, m in data:
        if g is not None and m is not None:
            sets[s, g].add(m)
    assert {(r["scope"], r["grp"]): r["size"] for r in sizes.collect()} == {k: len(v) for k, v in sets.items()}
    want = {(s, a, b): (len(sets[s, a] & sets[s, b]), len(sets[s, a]), len(sets[s, b])) for (s, a), (t, b) in combinations(sorted(sets, key=repr), 2) if s == t and sets[s, a] & sets[s, b]}
    assert {(r["scope"], r["grp_a"], r["grp_b"]): (r["shared"], r["size_a"], r["size_b"]) for r in pairs.collect()} == want
    least = overlap.overlap_sizes(spark.createDataFrame(data, "scope int, grp string, member int"), 30)[1]
    assert {(r["scope"], r["grp_a"], r["grp_b"]): (r["shared"], r["size_a"], r["size_b"]) for r in least.collect()} == {k: v for k, v in want.items() if min(v[1:]) >= 30} != {}
    none = overlap.overlap_sizes(spark.createDataFrame([], "scope int, grp string, member int"))
    assert none[0].count() == none[1].count() == 0


def test_bitmap_sizes():
    assert distinct.pages_for(0, 0.01) == 1
    for n in (1000, 100_000, 5_000_000):
        pages = distinct.pages_for(n, 0.01)
        assert distinct.standard_error(n, pages * distinct.PAGE) <= 0.01
        assert pages == 1 or distinct.standard_error(n, pages // 2 * distinct.PAGE) > 0.01


def test_pages_column(spark):
    ns = [0, 1, 32_768, 200_000, 10**6, 10**8, 10**10, 10**12, 10**13]
    got = spark.createDataFrame([(n,) for n in ns], "n long").select("n", distinct.pages_column(F.col("n"), 0.01).alias("p")).collect()
    assert {r["n"]: r["p"] for r in got} == {n: distinct.pages_for(n, 0.01) for n in ns}


def test_distinct_by_and_merge(spark):
    df = spark.range(60_000).select((F.col("id") % 3).alias("g"), (F.col("id") % 20_000).cast("string").alias("v"), F.lit(1).alias("distinct"))
    df = df.unionByName(spark.createDataFrame([(9, None, 1), (None, "x", 1), (None, "x", 1)], "g long, v string, distinct int"))
    got = {r["g"]: r for r in distinct.distinct_by(df, ["g"], "v", 0.01).collect()}
    assert set(got) == {0, 1, 2, None} and got[None]["distinct"] == pytest.approx(1, abs=0.01)
    for g in range(3):
        true = df.filter(F.col("g") == g).select("v").distinct().count()
        assert abs(got[g]["distinct"] - true) < 5 * 0.01 * true and got[g]["error"] <= 0.01
    maps = distinct.bitmaps(df, ["g"], "v", 2)
    once, twice = distinct.merge(maps.withColumn("all", F.lit(1)), ["all"]), distinct.merge(maps.union(maps).withColumn("all", F.lit(1)), ["all"])
    assert rows(distinct.estimate(once, ["all"])) == rows(distinct.estimate(twice, ["all"]))
    assert abs(distinct.estimate(once, ["all"]).first()["distinct"] - 20_001) < 1000
    # maps of different sizes and kinds merge to the smallest
    sizes = spark.createDataFrame([(0, 4, 20_000), (1, 32_768, 20_000), (2, 8, 20_000), (None, 2, 2)], "g long, pages long, rows long")
    mixed = distinct.bitmaps(df, ["g"], "v", sizes)
    assert mixed.filter("g = 1").agg(F.count("bits"), F.count("bit")).first()[0] == 0  # sparse: places, not pages
    assert mixed.filter("g = 0").count() == 4 and mixed.filter("g = 9").count() == 0
    whole = distinct.merge(mixed.withColumn("all", F.lit(1)), ["all"])
    assert rows(whole.select("page", "bits")) == rows(once.select("page", "bits"))
    wide = {r["g"]: r["distinct"] for r in distinct.estimate(mixed, ["g"]).collect()}
    assert abs(wide[1] - 20_000) < 20  # of 32,768 pages
    assert distinct.distinct_by(df.limit(0), ["g"], "v").count() == 0


def test_audit(spark):
    keys = spark.createDataFrame([(d, day, f"{d % 2}-{i}") for d in (1, 2, 3) for day in ("2024-01-01", "2024-01-02") for i in range(200 if day[-1] == "1" else 50)] + [(1, None, "x"), (1, "2024-01-01", None)], "domain_id int, day string, key string").withColumn("day", F.to_date("day"))
    stats = [
        (1, "2024-01-01", "2024-01-02", [1, 3], 200),  # the same keys in both domains
        (2, "2024-01-01", "2024-01-02", [1, 3], 181), (3, "2024-01-01", "2024-01-02", [1, 3], 180), (4, "2024-01-01", "2024-01-02", [1, 3], 179), (5, "2024-01-01", "2024-01-01", [1, 2, 2], 400),
        (6, "2024-01-02", "2024-01-01", [1], 0), (7, "2024-01-05", "2024-01-06", [1], 3), (8, "2024-01-01", "2024-01-02", [1], None), (9, "2024-01-01", "2024-01-02", [1], -1), (10, "2024-01-02", "2024-01-02", [], 0), (11, "2024-01-02", "2024-01-02", None, 1), (5, "2024-01-01", "2024-01-01", [1, 2, 2], 400), (12, "2024-01-02", "2024-01-02", [2], 56), (13, "2024-01-02", "2024-01-02", [2], 300),
    ]
    df = spark.createDataFrame(stats, "stat_id long, from_day string, to_day string, domain_ids array<int>, est_count long").withColumn("from_day", F.to_date("from_day")).withColumn("to_day", F.to_date("to_day"))
    got = {r["stat_id"]: r for r in distinct.audit_statistics(keys, df).collect()}
    assert {k: r["wrong"] for k, r in got.items()} == {1: False, 2: False, 3: False, 4: True, 5: False, 6: False, 7: True, 10: False, 11: True, 12: True, 13: True}
    assert got[3]["checked"] and not got[13]["checked"]
    assert distinct.audit_statistics(keys.limit(0), df).filter("wrong").count() == 9
    assert distinct.audit_statistics(keys, df.limit(0)).count() == 0
