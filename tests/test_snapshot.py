import pytest
from pyspark.sql import functions as F

from arclume.operators import statistics as st
from arclume.sources import snapshot as snap
from arclume.streaming import deltas
from helpers import ids, rows

MANIFEST = """
graphName: air
version: 2
tablespaces: {main: {file: data}}
domains:
  City: {tablespace: main, attributes: {pop: int64, code: {type: string, length: 3}}}
relations:
  fly: {source: City, target: City, tablespace: main, attributes: [{name: miles, type: float64}], inverseAlias: flownBy}
  drive: {source: City, target: City, tablespace: main}
virtual_relations: {go: {components: [fly, drive]}}
"""


def test_manifest(spark, tmp_path):
    (tmp_path / "m.yaml").write_text(MANIFEST)
    spark.createDataFrame([(0, "atl", 5, "ATL"), (1, "nyc", 8, "NYC")], "id long, key string, pop int, code string").write.parquet(f"{tmp_path}/data/domains/City")
    spark.createDataFrame([(0, 1, 7)], "src long, dst long, miles int").write.parquet(f"{tmp_path}/data/relations/fly")
    spark.createDataFrame([(1, 0)], "src long, dst long").write.parquet(f"{tmp_path}/data/relations/drive")
    g = snap.load_manifest(spark, str(tmp_path / "m.yaml"))
    assert ids(g.domain("City").from_key("atl").out("go").df()) == {1} and ids(g.domain("City").from_(1).out("flownBy").df()) == {0}
    assert dict(g.relation("fly").edges.dtypes)["miles"] == "double" and dict(g.domain_of("City").nodes.dtypes)["pop"] == "bigint"
    assert rows(g.inspect().select("relation", "edges")) == [("drive", 1), ("flownBy", 1), ("fly", 1), ("go", 2)]
    g.save(f"{tmp_path}/saved")
    back = snap.load_snapshot(spark, f"{tmp_path}/saved")
    assert set(back.relations) == set(g.relations) and ids(back.domain("City").from_(0).out("go").df()) == {1} and back.metadata["graph"] == "air"
    assert back.has("fly") == {"csr": True, "csc": True, "coo": True, "key_catalog": True}
    with pytest.raises(ValueError):
        snap.read_manifest("relations: {r: {source: A, target: B}}")
    with pytest.raises(FileNotFoundError):
        snap.resolve_path("nowhere")
    nodes = snap.read_manifest("nodes: {User: {key: uuid, attributes: {e: {type: 'float32[768]'}, n: {type: string(15), nullable: false}}}}\nrelations: [{name: f, from: User, to: User, cardinality: '1:N'}]")
    assert nodes["domains"]["User"]["attributes"]["e"]["type"] == "array<float>" and nodes["relations"]["f"]["multiplicity"] == "1:N"
    with pytest.raises(ValueError):
        snap.spark_type("decimal")


def test_edge_lines(spark, tmp_path):
    (tmp_path / "e.txt").write_text("# head\n0 1\n\n1,2,likes\n2\t0\tlikes\nx y\n3\n")
    g = snap.import_edges(spark, f"{tmp_path}/e.txt")
    assert set(g.relations) == {"default", "likes"} and g.domain("Node").node_count() == 3 and ids(g.domain("Node").from_(1, 2).out("likes").df()) == {0, 2}


def test_typed_import_and_merge(spark):
    nodes = spark.createDataFrame([("g1", "a", "Gene"), ("d1", "b", "Disease"), ("g2", "c", "Gene")], "key string, name string, kind string")
    edges = spark.createDataFrame([("d1", "DaG", "g2"), ("d1", "DaG", "gone"), ("g1", "x", "g2"), ("g1", "x", "d1")], "src string, relation string, dst string")
    g = snap.import_typed(spark, nodes, edges)
    assert set(g.relations) == {"DaG", "x_Gene_Disease", "x_Gene_Gene"} and g.domain("Disease").from_key("d1").out("DaG").to_key_list() == ["g2"]
    other = snap.import_typed(spark, spark.createDataFrame([("g0", "z", "Gene"), ("d1", "b", "Disease")], nodes.schema), spark.createDataFrame([("d1", "DaG", "g0")], edges.schema))
    m = g.merge(other)
    assert m.domain("Disease").from_key("d1").out("DaG").to_key_set() == {"g0", "g2"} and m.domain("Gene").node_count() == 3


def test_dense_ids(spark):
    got = rows(snap.dense_ids(spark.range(100).select((F.col("id") * 7 % 100).alias("k")), "k"))
    assert [r[1] for r in sorted(got)] == list(range(100))


def test_relation_statistics(spark):
    edges = spark.createDataFrame([(0, i) for i in range(1, 51)] + [(i, 0) for i in range(1, 100)], "src long, dst long")
    r = st.relation_statistics(edges, spark.range(100)).first()
    assert (r["max_degree"], r["avg_degree"], r["p50_degree"], r["p90_degree"], r["p99_degree"], r["unique_sources"], r["edge_count"], r["multiplicity"]) == (50, 1.49, 1, 1, 50, 100, 149, "M:N")
    assert ids(st.supernodes(edges, spark.range(100)).select("id")) == {0}
    assert st.degree_percentile(st.statistics_json(edges, spark.range(100)).first()[0], 99) == 50 and st.degree_percentile(None, 99) == -1
    one = st.relation_statistics(spark.createDataFrame([(0, 0), (0, 1), (1, 2), (1, 3)], "src long, dst long"), spark.range(2)).first()
    assert one["multiplicity"] == "1:N"
    assert st.relation_statistics(edges.limit(0), spark.range(3)).first()["edge_count"] == 0


def test_attribute_statistics(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([1.0, 2.0, 2.0, None, float("nan"), 5.0])], "o int, v double")
    assert st.attribute_statistics(df, "v", "o").first()[:] == (6, 2, 1.0, 5.0, 3, "INCREASING")
    assert st.attribute_statistics(df.withColumn("v", -F.col("o")), "v", "o").first()["monotonic"] == "DECREASING"
    assert st.attribute_statistics(df.withColumn("v", F.col("o") % 2), "v", "o").first()["monotonic"] == "NONE"
    assert [r["upper"] for r in st.equi_depth_exact(spark.range(1, 101), "id", 4).orderBy("bucket").collect()] == [25, 50, 75, 100]
    assert rows(st.heavy_hitters(spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "v string"), "v", 1)) == [("a", 2)]


def test_fold_and_overlay(spark):
    d = spark.createDataFrame([(1, 100, "I", 1), (1, 101, "I", 2), (1, 100, "D", 3), (2, 5, "D", 4), (2, 5, "I", 5), (3, 3, "I", 9), (3, 3, "D", 9)], "src long, dst long, op string, offset long")
    assert rows(deltas.fold(d, ["src", "dst"], ["offset"]).select("src", "dst", "op")) == [(1, 100, "D"), (1, 101, "I"), (2, 5, "I"), (3, 3, "D")]
    base = spark.createDataFrame([(1, 100, 0.5), (7, 7, 1.5), (7, 7, 1.5)], "src long, dst long, w double")
    assert rows(deltas.apply_deltas(base, d)) == [(1, 101, None), (2, 5, None), (7, 7, 1.5), (7, 7, 1.5)]
    assert deltas.apply_deltas(base, d.limit(0)).count() == 3


def test_stream_to_versions(spark, tmp_path):
    g = snap.GraphSnapshot(spark).with_domain("U", spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "id long, key string"), key="key")
    g = g.with_relation("r", "U", "U", spark.createDataFrame([(0, 1), (1, 2)], "src long, dst long"))
    store = deltas.VersionStore(spark, f"{tmp_path}/store")
    with pytest.raises(FileNotFoundError):
        store.load()
    store.publish(g)
    inbox = f"{tmp_path}/inbox"
    c = deltas.DeltaConsumer(spark, inbox)
    c.insert_node("U", "d")
    c.insert_edge("r", "a", "d")
    c.delete_edge("r", "a", "b")
    c.delete_node("U", "c")
    c.on_checkpoint(10)
    stream = spark.readStream.schema(deltas.DELTA_SCHEMA).parquet(inbox)
    for _ in range(2):
        deltas.stream_to_versions(stream, store, f"{tmp_path}/cp", compact_rows=1).awaitTermination(120)
    assert store.versions() == [1, 2]
    new = store.load()
    assert new.domain("U").from_key("a").out("r").to_key_list() == ["d"] and new.relation("r").edges.count() == 1 and new.domain("U").node_count() == 3
    assert store.load(1).relation("r").edges.count() == 2
    store.retain(1)
    assert store.versions() == [2]

    # deltas under the size of a compaction stay beside the version; readers see them
    c.insert_edge("r", "b", "d")
    c.flush()
    for _ in range(2):
        deltas.stream_to_versions(stream, store, f"{tmp_path}/cp", compact_rows=3).awaitTermination(120)
    assert store.versions() == [2] and len(store.pending(2)) == 1
    assert store.load().domain("U").from_key("b").out("r").to_key_list() == ["d"] and store.load(overlay=False).relation("r").edges.count() == 1
    c.insert_edge("r", "d", "a")
    c.insert_node("U", "e")
    c.flush()
    deltas.stream_to_versions(stream, store, f"{tmp_path}/cp", compact_rows=3).awaitTermination(120)
    assert store.versions() == [2, 3] and store.load(overlay=False).relation("r").edges.count() == 3 and store.load().domain("U").node_count() == 4


def test_delete_then_insert_of_a_node(spark):
    g = snap.GraphSnapshot(spark).with_domain("U", spark.createDataFrame([(0, "7"), (1, "8"), (2, "9")], "id long, key string"), key="key", key_type="int64")
    g = g.with_relation("r", "U", "U", spark.createDataFrame([(0, 1), (1, 2), (2, 0)], "src long, dst long"))
    log = [(1, "I", "edge", "r", "7", "9"), (2, "D", "node", "U", "+8", None), (3, "I", "node", "U", " 008", None), (4, "I", "edge", "r", "8 ", "07"), (5, "D", "node", "U", "9", None), (6, "I", "edge", "r", "7", "9"), (7, "I", "node", "U", None, None)]
    new = deltas.compact(g, spark.createDataFrame(log, deltas.DELTA_SCHEMA))
    # 8 lost its edges and has the one set after it came back; 9 is gone with its own
    assert rows(new.relation("r").edges) == [(1, 0)] and rows(new.domain_of("U").nodes.select("id", "key")) == [(0, "7"), (1, "8")]
    assert rows(deltas.compact(g, spark.createDataFrame([], deltas.DELTA_SCHEMA)).relation("r").edges) == [(0, 1), (1, 2), (2, 0)]


def test_writers_take_different_numbers(spark, tmp_path):
    g = snap.GraphSnapshot(spark).with_domain("U", spark.range(2))
    store, other = deltas.VersionStore(spark, f"{tmp_path}/s"), deltas.VersionStore(spark, f"{tmp_path}/s")
    held = store._numbers
    numbers = [lambda kind: []]  # the other writer looked before this one wrote
    store.publish(g)
    other._numbers = lambda kind: numbers.pop()(kind) if numbers else held(kind)
    assert other.publish(g.with_metadata(who="other")) == 2 and store.versions() == [1, 2]
    assert "who" not in store.load(1).metadata and store.load(2).metadata["who"] == "other"


def test_walks_against_edges_read_the_transposed_copy(spark, tmp_path):
    g = snap.GraphSnapshot(spark).with_domain("U", spark.range(4)).with_relation("r", "U", "U", spark.createDataFrame([(0, 3), (1, 3), (2, 0)], "src long, dst long"))
    g.save(f"{tmp_path}/g")
    walk = snap.load_snapshot(spark, f"{tmp_path}/g").domain("U").from_(3).in_("r")
    assert ids(walk.df()) == {0, 1} and "relations/r/in" in walk.explain(physical=True)
    assert "relations/r/out" in snap.load_snapshot(spark, f"{tmp_path}/g").domain("U").from_(3).out("r").explain(physical=True)
