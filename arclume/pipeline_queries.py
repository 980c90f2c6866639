"""Queries p2 and p5 over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arclume.functions.keys import with_canonical_edges, with_canonical_nodes
from arclume.operators import orphans, skew
from arclume.oracle import edges_sql, nodes_sql
from arclume.sources.tables import tables


#: The foreign keys of the catalog that bring records in: posts and groups by users, roles by groups, devices by accounts, buses by devices.
OWNING = ("userPostsPost", "userToGroup", "groupToRole", "accountOwnsDevice", "deviceSeenByBus")


def _orphans(spark: SparkSession, at: str) -> DataFrame:
    return orphans.edge_orphans(*tables(spark, at, "edge_deltas", "node_deltas", "base_nodes", "graph_relations", "graph_domains"), owning=OWNING)


def p2_found(spark: SparkSession, at: str) -> DataFrame:
    return _orphans(spark, at).filter("kind = 'direct'").select("delta_id", "ref_field")


def p2_report(spark: SparkSession, at: str) -> DataFrame:
    return orphans.orphan_report(_orphans(spark, at))


def p2_rounds(spark: SparkSession, at: str) -> DataFrame:
    """References lost in each round of the cascade: 0 the direct ones, 1 those that hang on them, and so on."""
    return _orphans(spark, at).groupBy("round").agg(F.count(F.lit(1)).alias("refs"))


def p5_found(spark: SparkSession, at: str) -> DataFrame:
    return p5_degrees(spark, at).filter(F.col("degree") * 50 >= F.col("edge_count")).select("relation_id", "src_key")


def p5_degrees(spark: SparkSession, at: str) -> DataFrame:
    edges, loaded, relations, domains = tables(spark, at, "edge_deltas", "loaded_relations", "graph_relations", "graph_domains")
    return skew.live_degrees(edges, loaded, relations, domains).select("relation_id", "src_key", "degree", "edge_count")


def p5_histories(spark: SparkSession, at: str) -> DataFrame:
    """Every edge delta met with every delta of its source node, per relation: a join whose left side is skewed and whose right side is large."""
    edges, nodes, relations, domains = tables(spark, at, "edge_deltas", "node_deltas", "graph_relations", "graph_domains")
    left = with_canonical_edges(edges.select("relation_id", "src_key", "delta_id", "kafka_offset"), relations, domains, ("src",)).select("relation_id", F.col("src_domain").alias("domain_id"), F.col("src").alias("key"), "delta_id", "kafka_offset")
    right = with_canonical_nodes(nodes.select("domain_id", "node_key", "kafka_offset"), domains).select("domain_id", "key", "kafka_offset")
    met = skew.fragment_replicate_join(left, right, ["domain_id", "key"], ["delta_id", "kafka_offset"])
    return met.groupBy("relation_id").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("kafka_offset_right") < F.col("kafka_offset")).alias("before"))


QUERIES = {"p2_found": p2_found, "p2_report": p2_report, "p2_rounds": p2_rounds, "p5_found": p5_found, "p5_degrees": p5_degrees, "p5_histories": p5_histories}

_LOST = f"""f AS (SELECT delta_id, min(kafka_offset) AS kafka_offset FROM edge_deltas GROUP BY 1),
e AS (SELECT DISTINCT e.delta_id, e.kafka_offset, e.relation_id, e.event_ts, e.src_domain, e.src, e.tgt_domain, e.tgt FROM ({edges_sql("e.op = 'I'")}) e JOIN f USING (delta_id, kafka_offset)),
r AS (SELECT delta_id, kafka_offset, relation_id, event_ts, 'src_key' AS ref_field, src_domain AS domain_id, src AS key FROM e WHERE src IS NOT NULL
  UNION ALL SELECT delta_id, kafka_offset, relation_id, event_ts, 'tgt_key', tgt_domain, tgt FROM e WHERE tgt IS NOT NULL),
n AS (SELECT domain_id, key, min(kafka_offset) AS kafka_offset, op = 'I' AS live FROM ({nodes_sql("node_deltas")}) WHERE key IS NOT NULL GROUP BY domain_id, key, delta_id, op
  UNION SELECT domain_id, key, -1, TRUE FROM ({nodes_sql("base_nodes")}) WHERE key IS NOT NULL),
d AS (SELECT r.delta_id, r.ref_field, r.relation_id, r.domain_id, r.event_ts FROM r ASOF LEFT JOIN n ON n.domain_id = r.domain_id AND n.key = r.key AND r.kafka_offset >= n.kafka_offset WHERE n.live IS NOT TRUE
  UNION ALL SELECT DISTINCT x.delta_id, 'relation_id', x.relation_id, NULL, x.event_ts FROM edge_deltas x JOIN f USING (delta_id, kafka_offset) WHERE x.op = 'I' AND x.relation_id IS NOT NULL AND x.relation_id NOT IN (SELECT relation_id FROM graph_relations))"""

_OWNERS = f"o AS (SELECT e.delta_id, e.tgt_domain, e.tgt, e.src_domain, e.src FROM e JOIN graph_relations g USING (relation_id) WHERE g.relation_name IN {OWNING})"
_CASCADE = f"""{_LOST}, {_OWNERS},
h AS (SELECT o.delta_id, o.tgt_domain, o.tgt FROM o WHERE o.delta_id IN (SELECT delta_id FROM d) UNION SELECT o.delta_id, o.tgt_domain, o.tgt FROM o JOIN h ON o.src_domain = h.tgt_domain AND o.src = h.tgt),
b AS (SELECT DISTINCT tgt_domain, tgt FROM h),
i AS (SELECT DISTINCT r.delta_id, r.ref_field, r.relation_id, r.domain_id, r.event_ts FROM r JOIN b ON r.domain_id = b.tgt_domain AND r.key = b.tgt
  WHERE NOT (r.ref_field = 'tgt_key' AND r.delta_id IN (SELECT delta_id FROM o)) AND (r.delta_id, r.ref_field) NOT IN (SELECT (delta_id, ref_field) FROM d))"""

_DEGREES = f"""k AS ({edges_sql("e.src_key IS NOT NULL")}),
f AS (SELECT relation_id, src, tgt, delta_id, min(kafka_offset) AS pos, min(op) AS op FROM k GROUP BY ALL),
l AS (SELECT relation_id, src, tgt, arg_max(op, pos) AS op FROM f GROUP BY ALL),
c AS (SELECT relation_id, sum(n) AS edge_count FROM (SELECT snapshot_id, relation_id, max(edge_count) AS n FROM loaded_relations WHERE edge_count >= 0 GROUP BY ALL) GROUP BY 1),
g AS (SELECT relation_id, src AS src_key, count(*) FILTER (WHERE op = 'I' AND tgt IS NOT NULL) AS degree FROM l GROUP BY ALL)"""

SQL = {
    "p2_found": f"WITH {_LOST} SELECT delta_id, ref_field FROM d",
    "p2_report": f"""WITH RECURSIVE {_CASCADE}
SELECT relation_id, domain_id, CAST(event_ts AT TIME ZONE 'UTC' AS DATE) AS day, kind, count(*) AS refs FROM (SELECT *, 'direct' AS kind FROM d UNION ALL SELECT *, 'inherited' FROM i) GROUP BY ALL""",
    "p2_rounds": f"""WITH RECURSIVE {_LOST}, {_OWNERS},
h AS (SELECT o.delta_id, o.tgt_domain, o.tgt, 0 AS n FROM o WHERE o.delta_id IN (SELECT delta_id FROM d) UNION SELECT o.delta_id, o.tgt_domain, o.tgt, n + 1 FROM o JOIN h ON o.src_domain = h.tgt_domain AND o.src = h.tgt WHERE n < 8),
b AS (SELECT tgt_domain, tgt, min(n) + 1 AS n FROM h GROUP BY ALL),
i AS (SELECT r.delta_id, r.ref_field, min(b.n) AS n FROM r JOIN b ON r.domain_id = b.tgt_domain AND r.key = b.tgt
  WHERE NOT (r.ref_field = 'tgt_key' AND r.delta_id IN (SELECT delta_id FROM o)) AND (r.delta_id, r.ref_field) NOT IN (SELECT (delta_id, ref_field) FROM d) GROUP BY ALL)
SELECT CAST(n AS INT) AS round, count(*) AS refs FROM (SELECT delta_id, ref_field, 0 AS n FROM d UNION ALL SELECT * FROM i) GROUP BY 1""",
    "p5_histories": f"""WITH e AS ({edges_sql()}), n AS ({nodes_sql("node_deltas")}) SELECT e.relation_id, count(*) AS pairs, count(*) FILTER (WHERE n.kafka_offset < e.kafka_offset) AS before
FROM e JOIN n ON n.domain_id = e.src_domain AND n.key = e.src GROUP BY 1""",
    "p5_found": f"WITH {_DEGREES} SELECT relation_id, src_key FROM g JOIN c USING (relation_id) WHERE degree * 50 >= edge_count",
    "p5_degrees": f"WITH {_DEGREES} SELECT relation_id, src_key, degree, CAST(edge_count AS BIGINT) AS edge_count FROM g LEFT JOIN c USING (relation_id)",
}
