import struct

import numpy as np
import pytest

from arclume.sources import binary
from arclume.sources.snapshot import GraphSnapshot
from helpers import ids, rows


def make(spark):
    users = spark.createDataFrame([(i, f"u{i}") for i in range(6)], "id long, key string")
    posts = spark.createDataFrame([(i, f"p{i}") for i in range(3)], "id long, key string")
    g = GraphSnapshot(spark).with_domain("User", users, key="key").with_domain("Post", posts, key="key").with_metadata(source="test é")
    g = g.with_relation("knows", "User", "User", spark.createDataFrame([(4, 0), (0, 1), (0, 2), (0, 1), (2, 5)], "src long, dst long"))
    return g.with_relation("posts", "User", "Post", spark.createDataFrame([(1, 0), (5, 2)], "src long, dst long")).with_relation("none", "User", "Post", spark.createDataFrame([], "src long, dst long"))


def test_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(binary, "EDGES_PER_TASK", 2)
    at = f"{tmp_path}/g.bin"
    g = make(spark)
    binary.write_binary(g, at)
    back = binary.load_binary(spark, at, verify=True)
    assert set(back.relations) == {"knows", "posts", "none"} and back.metadata["source"] == "test é"
    for name in back.relations:
        assert rows(back.relation(name).edges.select("src", "dst")) == rows(g.relation(name).edges.select("src", "dst"))
    assert rows(back.domain_of("Post").nodes) == [(0, "p0"), (1, "p1"), (2, "p2")]
    assert back.domain("User").from_key("u0").out("knows").to_key_list() == ["u1", "u2"]
    assert ids(back.domain("Post").from_(2).in_("posts").df()) == {5}


def test_attributes(spark, tmp_path):
    """An attribute with validity bits behind one relation, as a file written by hand."""
    at = tmp_path / "a.bin"
    pool = b"\0Bus\0Branch\0volt\0vec\0"
    data = bytearray(20000)
    data[0:58] = struct.pack("<IHIHHQQQQ16s", binary.MAGIC, 9, 4096, 1, 1, 0, 1, 0, 0, bytes(16))[:58]
    pos = 4096
    data[pos : pos + 4 + len(pool)] = struct.pack("<i", len(pool)) + pool
    data[4224:4240] = binary.DOMAIN.pack(3, 1, 0, 1, 3)
    data[4352:4480] = binary.RELATION.pack(0, 3, 3, 0, 2, 8, 5, 3, 4, 0, 8192, 32, 8320, 8, 0, 0, 0, 0, 2)
    data[4480:4524] = binary.ATTRIBUTE.pack(12, 0x80 | 5, 0, 0, 1, 8448, 128 + 16, 0, 0)
    data[4524:4568] = binary.ATTRIBUTE.pack(17, 5, 0, 0, 2, 9000, 32, 0, 0)
    data[8192:8224] = np.array([0, 2, 2, 4], "<u8").tobytes()
    data[8320:8328] = np.array([1, 2, 0, 1], "<u2").tobytes()
    data[8448] = 0b1011
    data[8576:8592] = np.array([1.5, 2.5, 3.5, 4.5], "<f4").tobytes()
    data[9000:9032] = np.arange(8, dtype="<f4").tobytes()
    at.write_bytes(data)
    edges = binary.load_binary(spark, str(at), {"volt": "<f4", "vec": "<f4"}).relation("Branch").edges
    assert rows(edges.select("src", "dst", "volt")) == [(0, 1, 1.5), (0, 2, 2.5), (2, 0, None), (2, 1, 4.5)]
    assert edges.filter("edge_id = 1").first()["vec"] == [2.0, 3.0]
    assert "volt" not in binary.load_binary(spark, str(at)).relation("Branch").edges.columns


@pytest.mark.parametrize("data", [b"", b"x" * 40, bytes(4096), struct.pack("<IH", binary.MAGIC, 7) + bytes(5000), struct.pack("<IHI", binary.MAGIC, 9, 4096) + bytes(5000)])
def test_no_snapshot(tmp_path, data):
    (tmp_path / "x").write_bytes(data)
    with pytest.raises(ValueError):
        binary.read_catalog(str(tmp_path / "x"))


def test_checksum(spark, tmp_path):
    at = tmp_path / "g.bin"
    binary.write_binary(make(spark), str(at))
    data = bytearray(at.read_bytes())
    data[20] ^= 1
    at.write_bytes(data)
    binary.read_catalog(str(at))
    with pytest.raises(ValueError, match="checksum"):
        binary.read_catalog(str(at), verify=True)


def test_footer_beyond_64_mb(spark, tmp_path):
    """Every key of a large domain comes back."""
    n = 700_000
    at = f"{tmp_path}/big.bin"
    g = GraphSnapshot(spark).with_domain("A", spark.range(n).selectExpr("id", "concat('a rather long key of the node ', id) AS key"), key="key")
    binary.write_binary(g, at)
    assert binary.read_catalog(at).metadata["domain.A.nodeCount"] == str(n)
    with open(at, "rb") as f:
        f.seek(-16, 2)
        assert binary.TRAILER.unpack(f.read())[0] > 1 << 26
    back = binary.load_binary(spark, at).domain_of("A").nodes
    assert back.count() == n and back.filter("key != concat('a rather long key of the node ', id)").count() == 0
    with open(at, "r+b") as f:
        f.seek(-16, 2)
        length = binary.TRAILER.unpack(f.read())[0]
        f.seek(-length, 2)
        f.write(struct.pack("<i", 1 << 30))
    with pytest.raises(ValueError, match="cut short"):
        binary.read_catalog(at)


def test_no_key_no_edge(spark, tmp_path):
    g = GraphSnapshot(spark).with_domain("A", spark.createDataFrame([(0, None), (3, "x")], "id long, key string"), key="key")
    binary.write_binary(g.with_relation("r", "A", "A", spark.createDataFrame([], "src long, dst long")), f"{tmp_path}/a.bin")
    back = binary.load_binary(spark, f"{tmp_path}/a.bin")
    assert rows(back.domain_of("A").nodes) == [(0, "A_0"), (1, "A_1"), (2, "A_2"), (3, "x")] and back.relation("r").edges.count() == 0
