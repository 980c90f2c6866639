"""Distinct counts with mergeable fixed bitmaps (linear counting) of a size that meets a target error."""

from __future__ import annotations

import math
from collections.abc import Sequence
from fractions import Fraction
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arclume.session import materialize

#: Bits of one page of a bitmap: what the built-in bitmap aggregates hold.
PAGE = 32768
#: Rows a page under which a group is held as the places of its bits: merging sorts a row for each, which costs more than a page beyond.
SPARSE = 64
#: Pages of the largest bitmap, as a power of two: beyond 10**13 values at an error of 0.01.
MOST_DOUBLINGS = 26


def standard_error(n: float, m: int) -> float:
    """Relative standard error of linear counting: ``n`` distinct values in ``m`` bits."""
    t = n / m
    return 0.0 if n <= 0 else math.inf if t > 30 else math.sqrt((math.expm1(t) - t) / m) / t


def pages_for(n: int, target: float) -> int:
    """The least number of pages (a power of two) for which up to ``n`` values are counted within ``target``, one standard error."""
    pages = 1
    while standard_error(n, pages * PAGE) > target:
        pages *= 2
    return pages


@lru_cache(maxsize=64)
def _limits(target: float) -> list[int]:
    """The most values that 1, 2, 4, ... pages count within ``target``."""
    out = []
    for i in range(MOST_DOUBLINGS + 1):
        low, high = 0, PAGE << (i + 6)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if standard_error(mid, PAGE << i) <= target else (low, mid - 1)
        out.append(low)
    return out


def pages_column(n: Column, target: float) -> Column:
    """``pages_for`` of a column."""
    out = F.raise_error(F.lit("more values than a bitmap of a group may hold")).cast("long")
    for i, most in reversed(list(enumerate(_limits(target)))):
        out = F.when(n <= most, F.lit(1 << i).cast("long")).otherwise(out)
    return out


def sizes_by(df: DataFrame, groups: Sequence[str], value: str, target: float) -> DataFrame:
    """(groups, pages, rows) of every group with a value: sized by the group's rows, which no count exceeds."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(*groups).agg(F.count(F.lit(1)).alias("rows"))
    return counted.select(*groups, pages_column(F.col("rows"), target).alias("pages"), "rows")


def bitmaps(df: DataFrame, groups: Sequence[str], value: str, sizes: int | DataFrame) -> DataFrame:
    """A bitmap per group, as rows (groups, pages, page, bits, bit): the bits of the hashed ``value``. Nulls set no bit.

    ``sizes`` is a number of pages or (groups, pages, rows); groups that it lacks don't come out. A group whose rows would fill its pages is held in
    pages (``bits``), set on the map side first: what is shuffled is at most a page per task, group and page number. A group with
    fewer than SPARSE rows a page is held as the places of its bits (``bit``), a row each.
    """
    rows = df.filter(F.col(value).isNotNull())
    if isinstance(sizes, int):
        rows = rows.select(*groups, value, F.lit(sizes).cast("long").alias("pages"), F.lit(False).alias("_thin"))
    else:
        own = sizes.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], "pages", (F.col("rows") < F.col("pages") * SPARSE).alias("_thin"))
        rows = rows.select(*groups, value).join(own, [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(groups)])
    at = F.pmod(F.xxhash64(value), F.col("pages") * PAGE)
    hashed = rows.select(*groups, "pages", F.floor(at / PAGE).cast("long").alias("page"), (at % PAGE).alias("bit"), "_thin")
    full = hashed.filter(~F.col("_thin")).groupBy(*groups, "pages", "page").agg(F.bitmap_construct_agg("bit").alias("bits")).withColumn("bit", F.lit(None).cast("long"))
    if isinstance(sizes, int):
        return full
    return full.unionByName(hashed.filter("_thin").drop("_thin").distinct().withColumn("bits", F.lit(None).cast("binary")))


def merge(maps: DataFrame, groups: Sequence[str]) -> DataFrame:
    """The union of bitmaps per group of ``groups``, as the smallest of them (each is folded to it: a page is the union of those whose numbers are equal
    modulo the smaller number of pages). Merging is associative, and repeating a part changes nothing."""
    least = maps.groupBy(*groups).agg(F.min("pages").alias("_pages")).withColumnsRenamed({g: f"_m{i}" for i, g in enumerate(groups)})
    return _merged(maps.join(least, [F.col(g).eqNullSafe(F.col(f"_m{i}")) for i, g in enumerate(groups)]).withColumn("pages", F.col("_pages")), groups)


def _merged(maps: DataFrame, groups: Sequence[str]) -> DataFrame:
    """``merge`` of maps whose column pages already says what to fold them to."""
    own = maps.withColumn("page", F.col("page") % F.col("pages"))
    keys = [*groups, "pages", "page"]
    thin = own.filter(F.col("bit").isNotNull()).groupBy(*keys).agg(F.bitmap_construct_agg("bit").alias("bits"))
    full = own.filter(F.col("bits").isNotNull()).select(*keys, "bits").unionByName(thin)
    return full.groupBy(*keys).agg(F.bitmap_or_agg("bits").alias("bits")).withColumn("bit", F.lit(None).cast("long"))


def estimate(maps: DataFrame, groups: Sequence[str]) -> DataFrame:
    """(groups, distinct double, error double) from the share of empty bits: -m ln(empty / m). One bitmap per group.

    ``error`` is the relative standard error at the estimate. A full bitmap was sized too small and gives null.
    """
    ones = maps.groupBy(*groups, "pages").agg(F.sum(F.when(F.col("bit").isNotNull(), F.lit(1).cast("long")).otherwise(F.bitmap_count("bits"))).alias("_ones"))
    m = (F.col("pages") * PAGE).cast("double")
    n = F.when(F.col("_ones") < m, -m * F.ln(F.lit(1.0) - F.col("_ones") / m))
    t = F.greatest(n, F.lit(1.0)) / m
    return ones.select(*groups, n.alias("distinct"), F.when(n.isNotNull(), F.sqrt((F.expm1(t) - t) / m) / t).alias("error"))


def distinct_by(df: DataFrame, groups: Sequence[str], value: str, target: float = 0.01) -> DataFrame:
    """Estimated distinct ``value`` per group, within ``target`` (one standard error): (groups, distinct, error).

    Every group's bitmap is sized by its own rows, which no count exceeds. Rows with null ``value`` don't count, and
    groups without a value don't come out; null is a group of its own.
    """
    names = list(groups)
    own = [f"_c{i}" for i in range(len(names))]  # no clash with the columns added here
    rows = df.select(*[F.col(n).alias(c) for n, c in zip(names, own)], F.col(value).alias("_value"))
    sizes = materialize(sizes_by(rows, own, "_value", target), "sizes")
    return estimate(bitmaps(rows, own, "_value", sizes), own).select(*[F.col(c).alias(n) for n, c in zip(names, own)], "distinct", "error")


def inserted_keys(nodes: DataFrame, domains: DataFrame) -> DataFrame:
    """(domain_id, day, key) of the inserted nodes with key and event time; keys canonical, days in UTC."""
    from arclume.functions.keys import with_canonical_nodes

    rows = nodes.filter((F.col("op") == "I") & F.col("event_ts").isNotNull() & F.col("node_key").isNotNull())
    return with_canonical_nodes(rows.select("domain_id", "node_key", "event_ts"), domains).select("domain_id", F.to_date("event_ts").alias("day"), "key")


def combinations(stats: DataFrame) -> DataFrame:
    """``stats`` (stat, from_day, to_day, domain_ids) as the (stat, day, domain_id) that each covers.

    Ranges that end before they begin, and null ends, cover nothing.
    """
    days = F.when(F.col("from_day") <= F.col("to_day"), F.sequence("from_day", "to_day"))
    return stats.select("stat", F.explode(days).alias("day"), F.array_distinct("domain_ids").alias("_ids")).select("stat", "day", F.explode("_ids").alias("domain_id"))


def audit_statistics(keys: DataFrame, stats: DataFrame, tolerance: float = 0.1, target: float = 0.01, sure: float = 6.0) -> DataFrame:
    """Every known statistic with the estimated distinct count of its days and domains and a verdict.

    Out: (stat_id, est_count, distinct, error, checked, wrong): ``wrong`` if est_count differs by more than ``tolerance`` of the true value
    from it. Bitmaps per (day, domain) are merged by union for every statistic, each sized for what it holds; where the verdict would change within ``sure``
    standard errors of the estimate, the statistic's keys are counted exactly (``checked``). est_count null or
    negative is unknown and doesn't come out; repeated rows come out once; a statistic that covers no key has 0.
    """
    known = stats.filter(F.col("est_count") >= 0).select("stat_id", "from_day", "to_day", F.sort_array(F.array_distinct("domain_ids")).alias("domain_ids"), "est_count").distinct()
    # statistics of the same days and domains share one union
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("from_day", "to_day")], F.coalesce(F.concat_ws(",", F.col("domain_ids").cast("array<string>")), F.lit("-")))
    known = materialize(known.withColumn("stat", name), "stats")
    keys = materialize(keys.filter(F.col("key").isNotNull() & F.col("day").isNotNull()), "keys")
    # a statistic's union is sized by its rows, a day and domain's bitmap by the largest union that it is part of
    covers = combinations(known.dropDuplicates(["stat"]))
    counted = materialize(keys.groupBy("day", "domain_id").agg(F.count(F.lit(1)).alias("rows")), "counts")
    covers = covers.join(counted, ["day", "domain_id"])
    unions = covers.groupBy("stat").agg(F.sum("rows").alias("_rows")).select("stat", pages_column(F.col("_rows"), target).alias("pages"))
    covers = materialize(covers.join(unions, "stat"), "covers")
    sizes = materialize(covers.groupBy("day", "domain_id").agg(F.max("pages").alias("pages"), F.max("rows").alias("rows")), "sizes")
    parts = materialize(bitmaps(keys, ["day", "domain_id"], "key", sizes), "bitmaps")
    found = estimate(_merged(covers.select("stat", "day", "domain_id", "pages").join(parts.drop("pages"), ["day", "domain_id"]), ["stat"]), ["stat"])
    judged = known.join(found.withColumn("_seen", F.lit(True)), "stat", "left").withColumn("distinct", F.when(F.col("_seen"), F.col("distinct")).otherwise(F.lit(0.0)))
    off = F.abs(F.col("est_count") - F.col("distinct"))
    slack = F.lit(sure * (1 + tolerance)) * F.coalesce("error", F.lit(0.0)) * F.col("distinct") + F.lit(2.0)
    border = F.lit(tolerance) * F.col("distinct")
    open_ = F.col("distinct").isNull() | ((F.col("distinct") > 0) & (off > border - slack) & (off < border + slack))
    judged = materialize(judged.withColumn("checked", open_).withColumn("wrong", off > border), "judged")
    # the exact check: keys of the open statistics only, in two steps so that no group is collected
    due = combinations(judged.filter("checked").dropDuplicates(["stat"]))
    exact = keys.join(due, ["day", "domain_id"]).select("stat", "key").distinct().groupBy("stat").agg(F.count(F.lit(1)).alias("_true"))
    out = judged.join(exact, "stat", "left").withColumn("_true", F.coalesce("_true", F.lit(0)))
    part = Fraction(tolerance).limit_denominator(1_000_000)  # whole numbers: no rounding at the border
    wrong = F.when(F.col("checked"), F.abs(F.col("est_count") - F.col("_true")) * part.denominator > F.col("_true") * part.numerator)
    return out.select("stat_id", "est_count", "distinct", "error", "checked", F.coalesce(wrong, F.col("wrong")).alias("wrong"))
