"""Ragged and sparse domains as runs, against sets of cells."""

import random

import pytest
from pyspark.sql import functions as F

from axistab.operators import domains


def cells_frame(spark, cells):
    return spark.createDataFrame(sorted(cells, key=repr), "a int, b int, c int").repartition(5)


def brute_runs(cells):
    out, cells = set(), set(cells)
    for a, b, c in cells:
        if (a, b, c - 1) not in cells:
            hi = c
            while (a, b, hi + 1) in cells:
                hi += 1
            out.add((a, b, c, hi))
    return out


def some_cells(rng, n, prefixes):
    return {(*rng.choice(prefixes), rng.randrange(-20, 40)) for _ in range(n)}


@pytest.mark.parametrize("prefixes", [[(1, 1)], [(1, 1), (1, None), (None, 2), (2, 2)]])
def test_runs_and_sweeps_equal_sets(spark, prefixes):
    rng = random.Random(len(prefixes))
    one, two = some_cells(rng, 120, prefixes), some_cells(rng, 90, [*prefixes, (9, 9)])
    a, b = (domains.runs_of(cells_frame(spark, c), ["a", "b", "c"]) for c in (one, two))
    got = lambda df: {tuple(r) for r in df.select("a", "b", "lo", "hi").collect()}
    assert got(a) == brute_runs(one) and a.count() == len(brute_runs(one))
    by = ["a", "b"]
    for made, cells in ((domains.union_runs(a, b, by), one | two), (domains.intersect_runs(a, b, by), one & two), (domains.subtract_runs(a, b, by), one - two)):
        assert made.columns == ["a", "b", "lo", "hi"] and got(made) == brute_runs(cells)
    assert {tuple(r) for r in domains.cells_of(a, by, "c").collect()} == one
    assert domains.same_runs(a, a, by) and not domains.same_runs(a, b, by)
    assert domains.union_runs(a.limit(0), b.limit(0), by).count() == 0 and domains.subtract_runs(a, a, by).count() == 0


def test_overlapping_runs_and_no_prefix(spark):
    one = spark.createDataFrame([(0, 9), (5, 14), (15, 20), (30, 31)], "lo int, hi int")
    two = spark.createDataFrame([(3, 4), (31, 40)], "lo int, hi int")
    got = lambda df: sorted(map(tuple, df.collect()))
    assert got(domains.union_runs(one, two, [])) == [(0, 20), (30, 40)]
    assert got(domains.subtract_runs(one, two, [])) == [(0, 2), (5, 20), (30, 30)]
    assert got(domains.intersect_runs(one, two, [])) == [(3, 4), (31, 31)]


def test_one_run_over_many_partitions(spark):
    """20,000 cells in a row with two gaps, in range partitions: what crosses their bounds is joined."""
    cells = spark.range(20_000).filter("id not in (7000, 13000)").select(F.col("id").alias("c"))
    assert sorted(map(tuple, domains.runs_of(cells, ["c"]).collect())) == [(0, 6999), (7001, 12999), (13001, 19999)]


def test_ragged_rows(spark):
    """Two and three elements in turn over twelve rows; a null and an empty array have no cells."""
    rows = [(r, r, [10 * r + i for i in range(2 + r % 2)]) for r in range(12)]
    df = spark.createDataFrame([*rows, (12, 12, []), (13, 13, None)], "row int, x int, w array<int>")
    runs = domains.element_runs(df, ["row"], "w")
    one = domains.runs_envelope(runs, ["row"]).first()
    assert (one["row_lo"], one["row_hi"], one["lo"], one["hi"], one["cells"], one["runs"], one["rank"], one["dense"]) == (0, 11, 0, 2, 30, 12, 2, False)
    short = df.withColumn("w", F.slice("w", 1, 2))
    less = domains.subtract_runs(runs, domains.element_runs(short, ["row"], "w"), ["row"])
    assert sorted(map(tuple, less.collect())) == [(r, 2, 2) for r in range(1, 12, 2)]
    assert domains.runs_envelope(domains.element_runs(short.filter("row < 12"), ["row"], "w"), ["row"]).first()["dense"]
    none = domains.runs_envelope(runs.limit(0), ["row"]).first()
    assert none["cells"] == 0 and not none["dense"] and none["lo"] is None
