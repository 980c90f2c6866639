import pytest
from pyspark.sql import functions as F

from arclume.functions.keys import canonical_key, with_canonical_edges
from helpers import rows

UUID = "e5df919e-d161-4992-bbf3-d8090d5f38c6"
CASES = [
    ("uuid", UUID, UUID), ("uuid", "{E5DF919E-D161-4992-BBF3-D8090D5F38C6}", UUID), ("uuid", "urn:uuid:" + UUID, UUID), ("uuid", " e5df919ed1614992bbf3d8090d5f38c6\t", UUID), ("uuid", "URN:UUID:" + UUID.upper(), UUID),
    ("uuid", None, None), ("uuid", "", ""), ("uuid", "{010028876D53EE41}", "010028876d53ee41"), ("uuid", "n/a", "n/a"),
    ("int64", "+5010028535", "5010028535"), ("int64", "\t5010037599", "5010037599"), ("int32", "007", "7"), ("int32", "-0", "0"), ("int32", "+0", "0"), ("int64", "-12", "-12"), ("int64", "99999999999999999999", "99999999999999999999"), ("int32", "x", "x"),
    ("bytes", "01:00:15:e1", "010015e1"), ("bytes", "0x010015E1", "010015e1"), ("bytes", "\\x010015e1", "010015e1"), ("bytes", "01-00-15-E1 ", "010015e1"), ("bytes", "0010", "0010"), ("bytes", "zz", "zz"),
    ("string", "　café ", "café"), ("string", "\nGene::1", "Gene::1"), ("string", "gene::1", "gene::1"), ("string", "a  b", "a  b"), (None, " k ", "k"),
]


@pytest.mark.parametrize("n", range(1))
def test_canonical_keys(spark, n):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(CASES)], "i int, kind string, key string, want string")
    got = df.withColumn("got", canonical_key(F.col("key"), F.col("kind"))).filter(~F.col("got").eqNullSafe(F.col("want")))
    assert rows(got) == []


def test_edges_keep_clashing_and_unknown(spark):
    relations = spark.createDataFrame([(1, "r", 1, 2)], "relation_id int, relation_name string, src_domain_id int, tgt_domain_id int")
    domains = spark.createDataFrame([(1, "A", "int64"), (2, "B", "string")], "domain_id int, domain_name string, key_type string")
    edges = spark.createDataFrame([(1, "+1", " x ", 5), (9, "1", "x", 6), (None, None, None, 7)], "relation_id int, src_key string, tgt_key string, key_type int")
    assert rows(with_canonical_edges(edges, relations, domains).select("src", "tgt", "key_type")) == [("1", "x", 5)]
    assert with_canonical_edges(edges, relations, domains, how="left").count() == 3
    assert with_canonical_edges(edges.limit(0), relations.limit(0), domains.limit(0)).count() == 0
