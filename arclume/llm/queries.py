"""Queries p1, p3, p4, p6, p7 and p8 over the test tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arclume.llm import distinct, frequent, leaks, overlap, packing, sentences
from arclume.oracle import edges_sql, key_sql, nodes_sql
from arclume.sources.tables import table, tables


def p1_found(spark: SparkSession, at: str) -> DataFrame:
    edges, relations, domains = tables(spark, at, "edge_deltas", "graph_relations", "graph_domains")
    return frequent.frequent_values(frequent.edge_sources(spark, edges, relations, domains), ["relation_id", "src_key"], min_share=0.004).select("relation_id", "src_key")


def p1_top_sources(spark: SparkSession, at: str) -> DataFrame:
    edges, relations, domains = tables(spark, at, "edge_deltas", "graph_relations", "graph_domains")
    return frequent.frequent_values(frequent.edge_sources(spark, edges, relations, domains), ["relation_id", "src_key"], k=100)


def _overlaps(spark: SparkSession, at: str, least: int = 1) -> DataFrame:
    edges, relations, domains = tables(spark, at, "edge_deltas", "graph_relations", "graph_domains")
    return overlap.overlap_sizes(overlap.audience_members(edges, relations, domains), least)[1].withColumnsRenamed({"scope": "relation_id", "grp_a": "src_key_a", "grp_b": "src_key_b"})


def p3_found(spark: SparkSession, at: str) -> DataFrame:
    small = F.least("size_a", "size_b")
    return _overlaps(spark, at, 30).filter(F.col("shared") * 2 >= small).select("relation_id", "src_key_a", "src_key_b")


def p3_overlaps(spark: SparkSession, at: str) -> DataFrame:
    return _overlaps(spark, at)


def p4_found(spark: SparkSession, at: str) -> DataFrame:
    nodes, stats, domains = tables(spark, at, "node_deltas", "domain_statistics", "graph_domains")
    return distinct.audit_statistics(distinct.inserted_keys(nodes, domains), stats).filter("wrong").select("stat_id").distinct()


def p4_daily(spark: SparkSession, at: str) -> DataFrame:
    nodes, domains = tables(spark, at, "node_deltas", "graph_domains")
    return distinct.distinct_by(distinct.inserted_keys(nodes, domains), ["day", "domain_id"], "key")


def p4_daily_bound(spark: SparkSession, at: str) -> DataFrame:
    """The exact counts beside ``p4_daily``: whether each estimate lies within six errors of them."""
    nodes, domains = tables(spark, at, "node_deltas", "graph_domains")
    exact = distinct.inserted_keys(nodes, domains).filter("key IS NOT NULL").distinct().groupBy("day", "domain_id").agg(F.count(F.lit(1)).alias("n"))
    both = p4_daily(spark, at).withColumnsRenamed({"day": "_day", "domain_id": "_domain"}).join(exact, F.col("_day").eqNullSafe(F.col("day")) & F.col("_domain").eqNullSafe(F.col("domain_id")), "full_outer")
    return both.select("day", "domain_id", "n", (F.abs(F.col("distinct") - F.col("n")) <= 6 * F.col("error") * F.col("n") + 1).alias("within"))


def p4_verdicts(spark: SparkSession, at: str) -> DataFrame:
    """Every statistic with its verdict, of coarse bitmaps that leave many to the exact count."""
    nodes, stats, domains = tables(spark, at, "node_deltas", "domain_statistics", "graph_domains")
    return distinct.audit_statistics(distinct.inserted_keys(nodes, domains), stats, target=0.05, sure=30.0).select("stat_id", "est_count", "wrong")


def p4_combinations(spark: SparkSession, at: str) -> DataFrame:
    nodes, stats, domains = tables(spark, at, "node_deltas", "domain_statistics", "graph_domains")
    return distinct.audit_statistics(distinct.inserted_keys(nodes, domains), stats)


def p6_found(spark: SparkSession, at: str) -> DataFrame:
    return packing.pack_documents(table(spark, at, "documents")).filter("pieces > 1").select("doc_id").distinct()


def p6_containers(spark: SparkSession, at: str) -> DataFrame:
    return packing.pack_documents(table(spark, at, "documents"))


def p6_loads(spark: SparkSession, at: str) -> DataFrame:
    """One row on the containers: how many, their tokens and fill, and how many break a limit."""
    cap, cost = 2048, packing.COST_SHARE * 2048**2
    loads = packing.container_loads(packing.pack_documents(table(spark, at, "documents")))
    return loads.agg(
        F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"), (F.sum("tokens") / (F.count(F.lit(1)) * cap)).alias("fill"), F.count_if(F.col("tokens") > cap).alias("over_tokens"),
        F.count_if(F.col("items") > 256).alias("over_items"), F.count_if((F.col("cost") > cost) & (F.col("items") > 1)).alias("over_cost"), F.count_if(F.col("cost") > 0.9 * cost).alias("near_cost"),
    )


def p7_found(spark: SparkSession, at: str) -> DataFrame:
    return p7_coverage(spark, at).select("doc_id", "item_id")


def p7_coverage(spark: SparkSession, at: str) -> DataFrame:
    documents, items = tables(spark, at, "documents", "test_items")
    return leaks.find_leaks(documents, items)


def p7_tiled(spark: SparkSession, at: str) -> DataFrame:
    """Items that a document's tiles cover to a third in whatever order: reordered passages come out too."""
    documents, items = tables(spark, at, "documents", "test_items")
    return leaks.find_leaks(documents, items, ordered=False)


def p8_found(spark: SparkSession, at: str) -> DataFrame:
    return sentences.sentence_units(table(spark, at, "documents"), with_text=False).select("doc_id", "sent_end")


def p8_sentences(spark: SparkSession, at: str) -> DataFrame:
    return sentences.sentence_units(table(spark, at, "documents"))


QUERIES = {"p1_found": p1_found, "p1_top_sources": p1_top_sources, "p3_found": p3_found, "p3_overlaps": p3_overlaps, "p4_found": p4_found, "p4_daily": p4_daily, "p4_daily_bound": p4_daily_bound, "p4_verdicts": p4_verdicts, "p4_combinations": p4_combinations, "p6_found": p6_found, "p6_containers": p6_containers, "p6_loads": p6_loads, "p7_found": p7_found, "p7_coverage": p7_coverage, "p7_tiled": p7_tiled, "p8_found": p8_found, "p8_sentences": p8_sentences}

_SOURCES = f"SELECT e.relation_id, {key_sql('e.src_key', 'd.key_type')} AS src_key FROM edge_deltas e JOIN graph_relations r USING (relation_id) JOIN graph_domains d ON d.domain_id = r.src_domain_id"
_SETS = f"""m AS (SELECT DISTINCT relation_id, src, tgt FROM ({edges_sql("e.op = 'I'")}) x WHERE src IS NOT NULL AND tgt IS NOT NULL
  AND src_domain IN (SELECT domain_id FROM graph_domains WHERE domain_name = 'Segment')),
s AS (SELECT relation_id, src, count(*) AS n FROM m GROUP BY ALL),
o AS (SELECT a.relation_id, a.src AS src_key_a, b.src AS src_key_b, count(*) AS shared FROM m a JOIN m b ON a.relation_id = b.relation_id AND a.tgt = b.tgt AND a.src < b.src GROUP BY ALL),
p AS (SELECT o.*, x.n AS size_a, y.n AS size_b FROM o JOIN s x ON x.relation_id = o.relation_id AND x.src = o.src_key_a JOIN s y ON y.relation_id = o.relation_id AND y.src = o.src_key_b)"""

_KEYS = f"""k AS (SELECT DISTINCT domain_id, CAST(event_ts AT TIME ZONE 'UTC' AS DATE) AS day, key FROM ({nodes_sql("node_deltas")}) WHERE op = 'I' AND key IS NOT NULL AND event_ts IS NOT NULL)"""
_COUNTS = f"""{_KEYS},
s AS (SELECT DISTINCT stat_id, from_day, to_day, domain_ids, est_count FROM domain_statistics WHERE est_count >= 0),
t AS (SELECT s.stat_id, s.from_day, s.to_day, s.domain_ids, s.est_count, count(DISTINCT k.key) AS n FROM s LEFT JOIN k ON list_contains(s.domain_ids, k.domain_id) AND k.day BETWEEN s.from_day AND s.to_day GROUP BY ALL)"""

SQL = {
    "p1_found": f"SELECT relation_id, src_key FROM ({_SOURCES}) WHERE src_key IS NOT NULL GROUP BY ALL HAVING count(*) * 250 >= (SELECT count(*) FROM edge_deltas)",
    "p1_top_sources": f"SELECT relation_id, src_key, count(*) AS n FROM ({_SOURCES}) WHERE src_key IS NOT NULL GROUP BY ALL ORDER BY n DESC, relation_id, src_key LIMIT 100",
    "p3_found": f"WITH {_SETS} SELECT relation_id, src_key_a, src_key_b FROM p WHERE least(size_a, size_b) >= 30 AND shared * 2 >= least(size_a, size_b)",
    "p3_overlaps": f"WITH {_SETS} SELECT * FROM p",
    "p4_found": f"WITH {_COUNTS} SELECT DISTINCT stat_id FROM t WHERE abs(est_count - n) * 10 > n",
    "p4_verdicts": f"WITH {_COUNTS} SELECT stat_id, est_count, abs(est_count - n) * 10 > n AS wrong FROM t",
    "p4_daily_bound": f"WITH {_KEYS} SELECT day, domain_id, count(*) AS n, TRUE AS within FROM k GROUP BY 1, 2",
}
