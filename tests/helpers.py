"""Rows of DataFrames as plain values."""

from pyspark.sql import DataFrame


def rows(df: DataFrame) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)


def ids(df: DataFrame) -> set[int]:
    found = [r["id"] for r in df.collect()]
    assert len(found) == len(set(found)), "an id twice"
    return set(found)
