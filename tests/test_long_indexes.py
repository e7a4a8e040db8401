"""Indexes of values with many rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from axistab.operators import agg, index


def test_merged_indexes_and_chunks_stay_split(spark):
    long = spark.range(1000).select(F.lit("a").alias("value"), F.col("id").alias("row"))
    merged = agg.merge_indexes(long.filter("row < 700"), long.filter("row >= 300"), spark.createDataFrame([("b", 3)], "value string, row long"))
    assert sorted((r["value"], r["n"]) for r in merged.groupBy("value").agg(F.count("row").alias("n")).collect()) == [("a", 1000), ("b", 1)]
    lists = index.row_chunks(index.create_index(merged, "value"), 300).orderBy("coord", "chunk").collect()
    assert [(r["value"], r["chunk"], len(r["rows"])) for r in lists] == [("a", 0, 300), ("a", 1, 300), ("a", 2, 300), ("a", 3, 100), ("b", 0, 1)]
    assert [x for r in lists[:4] for x in r["rows"]] == list(range(1000))
