"""Canonical node keys: one spelling for every value of a domain's key type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The characters with the property White_Space, the four information separators
#: and the zero-width marks that editors leave at the ends of a text.
WHITE_SPACE = "".join(
    map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF])
)


def trim_all(text: Column) -> Column:
    """``text`` without leading and trailing white space of any kind."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def nfc(text: Column) -> Column:
    """Unicode NFC. Spark has no such function; the ICU classes on its class path have.

    Only texts with a character from U+0300 on are handed over: shorter code points are in NFC already.
    """
    composed = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(False))
    return F.when(text.rlike(r"[^\x{0}-\x{2ff}]"), composed).otherwise(text)


def canonical_key(key: Column, key_type: Column) -> Column:
    """The canonical form of ``key`` as a value of ``key_type``; null for a null key.

    uuid: lower case with hyphens; int32, int64: plain digits; bytes: bare lower-case hex; string and any
    other type: trimmed and in NFC. A key that is no value of its type keeps its digits (uuid) or its
    trimmed text, so that no row is lost.
    """
    trimmed = trim_all(key)
    # uuid
    bare = F.regexp_replace(F.lower(F.translate(key, WHITE_SPACE + "{}()-\"'", "")), "^urn:uuid:", "")
    part = lambda at, n: F.substring(bare, at, n)
    hyphened = F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12))
    plain = key.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")
    uuid = F.when(plain, key).when(bare.rlike("^[0-9a-f]{32}$"), hyphened).when(bare.rlike("^[0-9a-f]+$"), bare).otherwise(trimmed)
    # integers, as text: any width
    digits = F.regexp_replace(F.regexp_replace(trimmed, r"^\+", ""), r"^(-?)0+(?=[0-9])", "$1")
    integer = F.when(key.rlike("^[1-9][0-9]*$"), key).when(trimmed.rlike("^[+-]?[0-9]+$"), F.when(digits == "-0", F.lit("0")).otherwise(digits)).otherwise(trimmed)
    # bytes
    stripped = F.regexp_replace(F.lower(F.translate(key, WHITE_SPACE + ":-_\"'", "")), r"^(0x|\\x|x)", "")
    octets = F.when(key.rlike("^[0-9a-f]+$"), key).when(stripped.rlike("^[0-9a-f]*$"), stripped).otherwise(trimmed)
    return F.when(key_type == "uuid", uuid).when(key_type.isin("int32", "int64"), integer).when(key_type == "bytes", octets).otherwise(nfc(trimmed))


#: Rows of a catalog of relations or domains up to which it is broadcast; a larger one is joined as the planner likes.
CATALOG_ROWS = 100_000


def small_catalog(df: DataFrame, limit: int = CATALOG_ROWS) -> DataFrame:
    """``df`` read once to the driver and marked for broadcast, if it has no more than ``limit`` rows; else as it is.

    Estimates of joined catalogs are products of their sizes, which would send all rows of a log through a shuffle by relation.
    """
    rows = df.limit(limit + 1).collect()
    return df if len(rows) > limit else F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def with_canonical_nodes(nodes: DataFrame, domains: DataFrame, out: str = "key") -> DataFrame:
    """``nodes`` with the canonical ``node_key`` as ``out``. Rows of an unknown domain are taken as strings."""
    kinds = small_catalog(domains.select(F.col("domain_id").alias("_domain_id"), F.col("key_type").alias("_key_type")).dropDuplicates(["_domain_id"]))
    joined = nodes.join(kinds, F.col("domain_id") == F.col("_domain_id"), "left")
    return joined.withColumn(out, canonical_key(F.col("node_key"), F.coalesce("_key_type", F.lit("string")))).drop("_domain_id", "_key_type")


def with_canonical_edges(edges: DataFrame, relations: DataFrame, domains: DataFrame, sides: tuple[str, ...] = ("src", "tgt"), how: str = "inner") -> DataFrame:
    """``edges`` with ``src_domain``, ``src`` and/or ``tgt_domain``, ``tgt``: domains and canonical keys.

    ``how`` is inner (edges of the catalog's relations) or left (all; the new columns are null for the others).
    """
    wide = relations.select(F.col("relation_id").alias("_relation_id"), *[F.col(f"{s}_domain_id").alias(f"{s}_domain") for s in sides]).dropDuplicates(["_relation_id"])
    for s in sides:
        kinds = domains.select(F.col("domain_id").alias(f"_{s}_id"), F.col("key_type").alias(f"_{s}_type")).dropDuplicates([f"_{s}_id"])
        wide = wide.join(kinds, F.col(f"{s}_domain") == F.col(f"_{s}_id"), "left").drop(f"_{s}_id")
    joined = edges.join(small_catalog(wide), F.col("relation_id") == F.col("_relation_id"), how)
    for s in sides:
        joined = joined.withColumn(s, canonical_key(F.col(f"{s}_key"), F.coalesce(f"_{s}_type", F.lit("string"))))
    return joined.drop("_relation_id", *[f"_{s}_type" for s in sides])
