"""References to records that do not exist: as-of lookups in a log, and the cascade down a foreign-key graph."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arclume.functions.keys import small_catalog, with_canonical_edges, with_canonical_nodes
from arclume.session import Rounds, materialize

#: Offsets in one segment of the log. A group (key, segment) holds at most the rows of so many offsets,
#: however hot its key is.
SEGMENT = 1 << 20


@dataclass(frozen=True)
class ForeignKey:
    """``child``'s ``columns`` refer to ``parent``'s ``parent_columns``.

    ``lookup`` False: a missing target is no case of its own (another rule finds it); the key only passes orphans on.
    """

    name: str
    child: str
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]
    lookup: bool = True


def missing_as_of(refs: DataFrame, history: DataFrame, keys: Sequence[str], at: str, live: str, segment: int = SEGMENT) -> DataFrame:
    """The rows of ``refs`` whose target is not live at their offset.

    ``history`` holds (``keys``, ``at``, ``live`` boolean), one row for each change; at one offset a change
    counts before a reference, and of several changes the last is not defined better than "not live wins".
    A target without a change at or before the offset is missing. Rows of ``refs`` with a null in ``keys`` or
    ``at`` refer to nothing and don't come out; such rows of ``history`` say nothing.

    The log is cut into segments of offsets. Changes and references are first folded per (key, segment),
    combined before the shuffle; the state at a segment's start is carried along the few segments of a key.
    Only references of (key, segment) groups in which a key also changes are then ordered by offset, so no
    task gets more rows of one key than a segment has offsets.
    """
    keys = list(keys)
    seg = (F.col(at) / F.lit(segment)).cast("long") if segment & (segment - 1) else F.shiftright(F.col(at).cast("long"), segment.bit_length() - 1)
    full = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in [*keys, at]])
    changes = history.filter(full & F.col(live).isNotNull()).select(*keys, F.col(at).cast("long").alias("_at"), F.col(live).alias("_live"), seg.alias("_seg"))
    asked = refs.filter(full).withColumn("_seg", seg)

    # one row per (key, segment): the last state in it, and whether it has references; 2 * offset + live orders as wanted
    stamp = F.col("_at") * 2 + F.when(F.col("_live"), 0).otherwise(1)
    folded = (
        changes.select(*keys, "_seg", stamp.alias("_last"), F.lit(0).alias("_asked"))
        .unionByName(asked.select(*keys, "_seg", F.lit(None).cast("long").alias("_last"), F.lit(1).alias("_asked")))
        .groupBy(*keys, "_seg")
        .agg(F.max("_last").alias("_last"), F.max("_asked").alias("_asked"))
    )
    along = Window.partitionBy(*keys).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    carried = folded.withColumn("_before", F.last("_last", ignorenulls=True).over(along)).filter(F.col("_asked") == 1)
    start = F.coalesce(F.col("_before") % 2 == 0, F.lit(False))
    kinds = carried.select(*keys, "_seg", start.alias("_start"), F.col("_last").isNotNull().alias("_mixed")).filter(F.col("_mixed") | ~F.col("_start"))
    kinds = materialize(kinds, "segments")

    hit = asked.join(kinds, [*keys, "_seg"])
    dead = hit.filter(~F.col("_mixed")).drop("_start", "_mixed", "_seg")
    mixed = hit.filter("_mixed").withColumn("_at", F.col(at).cast("long")).withColumn("_order", F.lit(1)).withColumn("_live", F.lit(None).cast("boolean"))
    moved = changes.join(kinds.filter("_mixed"), [*keys, "_seg"]).withColumn("_order", F.when(F.col("_live"), -1).otherwise(0))
    both = mixed.unionByName(moved, allowMissingColumns=True)
    up_to = Window.partitionBy(*keys, "_seg").orderBy("_at", "_order").rowsBetween(Window.unboundedPreceding, 0)
    state = F.coalesce(F.last("_live", ignorenulls=True).over(up_to), F.col("_start"))
    late = both.withColumn("_state", state).filter((F.col("_order") == 1) & ~F.col("_state"))
    return dead.unionByName(late.select(*dead.columns))


def cascade(tables: Mapping[str, DataFrame], row_keys: Mapping[str, str], foreign_keys: Sequence[ForeignKey], direct: DataFrame | None = None, max_rounds: int | None = None) -> DataFrame:
    """Direct and inherited orphans of a foreign-key graph, cycles included.

    ``tables`` by name; ``row_keys`` names the column that identifies a row of each. ``direct`` gives orphans found
    elsewhere as (table_name, row_key string, fk); all others are found here, as rows with a full, non-null key
    (``lookup`` keys only) that no parent row has. A row whose parent row is an orphan inherits it: each round
    semi-joins the children to the rows found in the round before, until a round finds none. Comes out as
    (table_name, row_key string, fk, kind 'direct' or 'inherited', round int), one row for each orphan and key:
    an orphan's own missing references, or the key through which it first inherited; a direct orphan is not
    listed as inherited too. The loop ends by itself, as every round finds new rows; more than ``max_rounds`` rounds, if given, raise. Repeated rows count once; an empty table orphans all that refers to it.
    """
    spark = next(iter(tables.values())).sparkSession
    out = "table_name string, row_key string, fk string, kind string, round int"

    def as_orphans(df: DataFrame, fk: ForeignKey, kind: str, n: int) -> DataFrame:
        return df.select(F.lit(fk.child).alias("table_name"), F.col(row_keys[fk.child]).cast("string").alias("row_key"), F.lit(fk.name).alias("fk"), F.lit(kind).alias("kind"), F.lit(n).alias("round"))

    def children(fk: ForeignKey, parents: DataFrame, how: str) -> DataFrame:
        child = tables[fk.child].filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in fk.columns]))
        parents = parents.select(*[F.col(p).alias(f"_p{i}") for i, p in enumerate(fk.parent_columns)]).distinct()
        return child.join(parents, [F.col(c) == F.col(f"_p{i}") for i, c in enumerate(fk.columns)], how)

    found = [as_orphans(children(fk, tables[fk.parent], "left_anti"), fk, "direct", 0) for fk in foreign_keys if fk.lookup]
    if direct is not None:
        found.append(direct.select("table_name", F.col("row_key").cast("string").alias("row_key"), "fk", F.lit("direct").alias("kind"), F.lit(0).alias("round")))
    start = reduce(DataFrame.unionByName, found).distinct() if found else spark.createDataFrame([], out)
    new = materialize(start, "orphans")
    rounds = Rounds("orphans")
    rounds.add(new, new.count())
    for n in count(1):
        grown = []
        reached = {r[0] for r in new.select("table_name").distinct().collect()}  # names of tables, no rows
        for fk in foreign_keys:
            if fk.parent in reached:
                parent = tables[fk.parent]
                rows = new.filter(F.col("table_name") == fk.parent).select(F.col("row_key").alias("_row_key")).distinct()
                orphaned = parent.join(rows, F.col(row_keys[fk.parent]).cast("string") == F.col("_row_key"), "left_semi")
                grown.append(as_orphans(children(fk, orphaned, "left_semi"), fk, "inherited", n))
        if not grown:
            break
        every = reduce(DataFrame.unionByName, grown).groupBy("table_name", "row_key").agg(F.min("fk").alias("fk"), F.min("kind").alias("kind"), F.min("round").alias("round"))
        known = rounds.all().select("table_name", "row_key").distinct()
        new = materialize(every.join(known, ["table_name", "row_key"], "left_anti"), "orphans")
        if not (size := new.count()):
            break
        if max_rounds is not None and n > max_rounds:
            raise RuntimeError(f"orphans are still inherited after {max_rounds} rounds")
        rounds.add(new, size)
    return rounds.all()


def edge_orphans(edges: DataFrame, nodes: DataFrame, base: DataFrame, relations: DataFrame, domains: DataFrame, owning: Sequence[str]) -> DataFrame:
    """Orphan references of the inserts of an edge log.

    Comes out as (delta_id, ref_field, relation_id, domain_id, day, kind, round): direct are references to a
    relation that is not in ``relations`` (domain_id is null) or to a node that is not live at the delta's
    offset; inherited are references to a node that an orphaned edge of an ``owning`` relation (by name) brings in: its target depends on it,
    and what refers to the target depends on both, from edge to edge until a round of the cascade finds nothing.
    A delta counts once, at its smallest offset. Null keys refer to nothing; the keys of rows without a known
    relation are not looked at; ``day`` is null without event_ts.
    """
    inserts = edges.filter((F.col("op") == "I") & F.col("relation_id").isNotNull()).select("delta_id", "kafka_offset", "relation_id", "src_key", "tgt_key", "event_ts")
    day = F.to_date("event_ts")
    known = relations.select("relation_id").distinct()
    first = lambda found: found.join(
        edges.select("delta_id", "kafka_offset").join(found.select("delta_id").distinct(), "delta_id", "left_semi").groupBy("delta_id").agg(F.min("kafka_offset").alias("kafka_offset")), ["delta_id", "kafka_offset"], "left_semi"
    ).dropDuplicates(["delta_id", "ref_field"])
    lost = inserts.join(known, "relation_id", "left_anti").select("delta_id", "kafka_offset", "relation_id", F.lit("relation_id").alias("ref_field"), F.lit(None).cast("int").alias("domain_id"), day.alias("day"))

    # read by the lookup and by every round of the cascade, so its keys are made canonical once
    owners = small_catalog(relations.filter(F.col("relation_name").isin(*owning)).select(F.col("relation_id").alias("_owner_id")).distinct())
    keyed = with_canonical_edges(inserts, relations, domains).join(owners, F.col("relation_id") == F.col("_owner_id"), "left")
    keyed = materialize(keyed.select("delta_id", "kafka_offset", "relation_id", "src_domain", "src", "tgt_domain", "tgt", day.alias("day"), F.col("_owner_id").isNotNull().alias("_owner")), "edges")
    side = lambda s: F.struct(F.lit(f"{s}_key").alias("ref_field"), F.col(f"{s}_domain").alias("domain_id"), F.col(s).alias("key"))
    refs = keyed.select("delta_id", "kafka_offset", "relation_id", "day", F.inline(F.array(side("src"), side("tgt"))))
    log = with_canonical_nodes(nodes.select("delta_id", "kafka_offset", "op", "domain_id", "node_key"), domains).filter(F.col("op").isin("I", "D"))
    # a node delta takes effect once, at its smallest offset
    log = log.groupBy("domain_id", "key", "delta_id", "op").agg(F.min("kafka_offset").alias("kafka_offset"))
    history = log.select("domain_id", "key", "kafka_offset", (F.col("op") == "I").alias("live")).unionByName(
        with_canonical_nodes(base.select("domain_id", "node_key"), domains).select("domain_id", "key", F.lit(-1).cast("long").alias("kafka_offset"), F.lit(True).alias("live"))
    )
    gone = missing_as_of(refs, history, ["domain_id", "key"], "kafka_offset", "live")
    candidates = materialize(gone.select("delta_id", "kafka_offset", "relation_id", "ref_field", "domain_id", "day").unionByName(lost.select("delta_id", "kafka_offset", "relation_id", "ref_field", "domain_id", "day")), "gone")
    direct = materialize(first(candidates).drop("kafka_offset"), "direct")

    # The cascade's foreign-key graph: edges refer to the owning edges that bring their nodes in, those to others.
    owner = F.col("_owner")
    tables = {"edge": keyed, "owner": keyed.filter(owner), "other": keyed.filter(~owner)}
    keys = dict.fromkeys(tables, "delta_id")
    brought = ("tgt_domain", "tgt")
    fks = [
        ForeignKey("src_key", "edge", ("src_domain", "src"), "owner", brought, lookup=False),
        ForeignKey("src_key", "owner", ("src_domain", "src"), "owner", brought, lookup=False),
        ForeignKey("tgt_key", "other", ("tgt_domain", "tgt"), "owner", brought, lookup=False),
    ]
    # direct orphans enter the cascade as what they are: as owners, too, where they are
    as_found = lambda df, name: df.select(F.lit(name).alias("table_name"), F.col("delta_id").alias("row_key"), F.col("ref_field").alias("fk"))
    owned = keyed.filter(owner).select("delta_id").distinct()
    found = cascade(tables, keys, fks, direct=as_found(direct, "delta").unionByName(as_found(direct.join(owned, "delta_id", "left_semi"), "owner")))
    found = found.select(F.col("row_key").cast("long").alias("delta_id"), F.col("fk").alias("ref_field"), "kind", "round", "table_name")
    columns = ["delta_id", "ref_field", "relation_id", "domain_id", "day", "kind", "round"]
    own = found.filter("kind = 'direct' AND table_name = 'delta'").drop("table_name").join(direct, ["delta_id", "ref_field"]).select(*columns)
    # one row per reference; a direct one is not listed again
    passed = found.filter("kind = 'inherited'").groupBy("delta_id", "ref_field").agg(F.min("round").alias("round")).join(direct.select("delta_id", "ref_field"), ["delta_id", "ref_field"], "left_anti")
    passed = materialize(passed, "heirs")
    side = lambda s: F.struct(F.lit(f"{s}_key").alias("ref_field"), F.col(f"{s}_domain").alias("domain_id"))
    held = keyed.join(passed.select("delta_id").distinct(), "delta_id", "left_semi").select("delta_id", "relation_id", "day", F.inline(F.array(side("src"), side("tgt"))))
    heirs = passed.withColumn("kind", F.lit("inherited")).join(held.dropDuplicates(["delta_id", "ref_field"]), ["delta_id", "ref_field"])
    return own.unionByName(heirs.select(*columns))


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphan references per relation, domain and day: (relation_id, domain_id, day, kind, refs)."""
    return orphans.groupBy("relation_id", "domain_id", "day", "kind").agg(F.count(F.lit(1)).alias("refs"))
