"""Sizes of the intersections of many large sets, by counting identical membership signatures. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arclume.session import materialize

#: Members of a signature that one row expands; longer signatures are cut, so that tasks share their pairs.
BLOCK = 256


def signatures(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``members`` (scope, grp, member) as signatures (scope, sig array<bigint>, n) and groups (scope, gid, grp).

    A member's signature is the sorted array of the ids of its groups; ``n`` members have the same. An id is a hash of the group's
    name under the first seed that gives no two groups of a scope the same (checked, not assumed). Repeated rows and hot
    members fold before the shuffle; a signature is no longer than the number of groups.
    """
    full = materialize(members.filter(F.col("grp").isNotNull() & F.col("member").isNotNull()).select("scope", "grp", "member"), "members")
    for seed in range(8):
        gid = F.xxhash64(F.col("grp"), F.lit(seed))
        groups = materialize(full.groupBy("scope", gid.alias("gid")).agg(F.min("grp").alias("grp"), F.max("grp").alias("_other")), "groups")
        if groups.filter(F.col("grp") != F.col("_other")).isEmpty():
            break
    else:
        raise ValueError("no seed separates the groups")
    by_member = full.groupBy("scope", "member").agg(F.sort_array(F.collect_set(gid)).alias("sig"))
    counted = by_member.groupBy("scope", "sig").agg(F.count(F.lit(1)).alias("n"))
    return materialize(counted.withColumn("_no", F.monotonically_increasing_id()), "signatures"), groups.drop("_other")


def _of_large(sigs: DataFrame, large: DataFrame) -> DataFrame:
    """``sigs`` without the groups that are not in ``large`` (scope, gid); signatures that are equal then count together."""
    own = large.select(F.col("scope").alias("_s"), F.col("gid").alias("_g"))
    kept = sigs.select("_no", "scope", "n", F.explode("sig").alias("gid")).join(own, F.col("scope").eqNullSafe(F.col("_s")) & (F.col("gid") == F.col("_g")), "left_semi")
    cut = kept.groupBy("_no").agg(F.first("scope").alias("scope"), F.first("n").alias("n"), F.sort_array(F.collect_list("gid")).alias("sig"))
    return cut.filter(F.size("sig") > 1).groupBy("scope", "sig").agg(F.sum("n").alias("n"))


def overlap_sizes(members: DataFrame, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """Set sizes (scope, grp, size) and overlaps (scope, grp_a, grp_b, shared, size_a, size_b; grp_a before grp_b).

    ``members`` is (scope, grp, member): ``member`` belongs to the set ``grp``, and sets of one scope are compared.
    Exact; pairs that share nothing don't come out, nor those with a set of fewer than ``least`` members, which leave the signatures before pairs
    are made. Nulls in grp or member are no membership; a null scope is a scope.
    """
    sigs, groups = signatures(members)
    sizes = sigs.select("scope", F.explode("sig").alias("gid"), "n").groupBy("scope", "gid").agg(F.sum("n").alias("size"))
    sizes = materialize(sizes.join(groups, [sizes["scope"].eqNullSafe(groups["scope"]), sizes["gid"] == groups["gid"]]).select(groups["scope"], groups["gid"], "grp", "size"), "sizes")
    many = _of_large(sigs, sizes.filter(F.col("size") >= least)) if least > 1 else sigs.filter(F.size("sig") > 1)
    blocks = many.withColumn("_from", F.explode(F.sequence(F.lit(0), F.size("sig") - 2, F.lit(BLOCK))))
    blocks = blocks.repartition(F.xxhash64("scope", "sig", "_from"))
    first = blocks.select("scope", "sig", "n", F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + BLOCK - 1, F.size("sig") - 2))).alias("_i"))
    pairs = first.select("scope", "n", F.element_at("sig", F.col("_i") + 1).alias("a"), F.explode(F.slice("sig", F.col("_i") + 2, F.size("sig"))).alias("b"))
    shared = pairs.groupBy("scope", "a", "b").agg(F.sum("n").alias("shared"))
    left = sizes.select(F.col("scope").alias("_sa"), F.col("gid").alias("_a"), F.col("grp").alias("ga"), F.col("size").alias("na"))
    right = sizes.select(F.col("scope").alias("_sb"), F.col("gid").alias("_b"), F.col("grp").alias("gb"), F.col("size").alias("nb"))
    named = shared.join(left, F.col("scope").eqNullSafe(F.col("_sa")) & (F.col("a") == F.col("_a"))).join(right, F.col("scope").eqNullSafe(F.col("_sb")) & (F.col("b") == F.col("_b")))
    ahead = F.col("ga") < F.col("gb")  # Spark compares strings by their UTF-8 bytes, which is the order of code points
    pick = lambda x, y, name: F.when(ahead, F.col(x)).otherwise(F.col(y)).alias(name)
    return sizes.select("scope", "grp", "size"), named.select("scope", pick("ga", "gb", "grp_a"), pick("gb", "ga", "grp_b"), "shared", pick("na", "nb", "size_a"), pick("nb", "na", "size_b"))


def audience_members(edges: DataFrame, relations: DataFrame, domains: DataFrame, source_domain: str = "Segment") -> DataFrame:
    """The inserted memberships of the relations whose source domain is ``source_domain``, keys canonical."""
    from arclume.functions.keys import with_canonical_edges

    held = relations.join(domains.filter(F.col("domain_name") == source_domain).select(F.col("domain_id").alias("src_domain_id")).distinct(), "src_domain_id", "left_semi")
    rows = with_canonical_edges(edges.filter(F.col("op") == "I").select("relation_id", "src_key", "tgt_key"), held, domains)
    return rows.select(F.col("relation_id").alias("scope"), F.col("src").alias("grp"), F.col("tgt").alias("member"))
