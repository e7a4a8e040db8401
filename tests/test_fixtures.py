"""Golden values on small tables."""

import math

import pytest
from pyspark.sql import functions as F

from axistab.functions.cplx import cplx
from axistab.model import AxisTable
from axistab.operators import agg, blocks, columns, index
from axistab.plans import cf
from axistab.schemas import SCHEMAS
from axistab.sources import tables


@pytest.fixture(scope="module")
def table0(spark):
    rows = [(r, 22 + r // 3, 30 + r % 3, r) for r in range(12)]
    return AxisTable(spark.createDataFrame(rows, "row long, x long, y long, z long"))


def got(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_index(table0):
    lists = index.row_lists(index.create_index(table0.df, "x")).orderBy("coord").collect()
    assert [(r["coord"], r["value"], r["rows"]) for r in lists] == [(i, 22 + i, [3 * i, 3 * i + 1, 3 * i + 2]) for i in range(4)]
    lists = index.row_lists(index.create_index(table0.df, "y")).orderBy("coord").collect()
    assert [(r["value"], r["rows"]) for r in lists] == [(30 + i, [i, i + 3, i + 6, i + 9]) for i in range(3)]


def test_reindex(table0):
    both = index.reindexed(table0, ["x", "y"])
    assert got(both.df, "x_at", "y_at", "z") == [(i, j, 3 * i + j) for i in range(4) for j in range(3)]
    assert got(both.dims["x"], "coord", "value") == [(i, 22 + i) for i in range(4)]
    rows = index.reindexed(table0, ["y"], allow_rows=True)
    assert rows.index_axes == ("y", "row")
    assert got(rows.df, "y_at", "row", "x", "z") == [(i, j, 22 + j, 3 * j + i) for i in range(3) for j in range(4)]
    assert got(index.reindexed(rows, ["y", "x"]).df, "y_at", "x_at", "z") == [(j, i, 3 * i + j) for j in range(3) for i in range(4)]
    assert got(index.lookup(both, {"x": 23, "y": 31}), "z") == [(4,)]


def test_reindex_collisions_nulls_and_errors(spark, table0):
    df = spark.createDataFrame([(0, 1, 5), (1, 1, 6), (2, 2, 7), (3, None, 8)], "row long, k int, v int")
    table = AxisTable(df)
    assert got(index.reindexed(table, ["k"]).df, "k_at", "v") == [(1, 7)]
    assert got(index.reindexed(table, ["k"], allow_rows=True).df, "k_at", "row", "v") == [(0, 0, 5), (0, 1, 6), (1, 0, 7)]
    with pytest.raises(ValueError):
        index.reindexed(table, ["k"], on_collision="error")
    with pytest.raises(ValueError):
        index.reindexed(table, ["nothing"])
    rows = index.reindexed(table0, ["y"], allow_rows=True)
    with pytest.raises(ValueError):
        index.reindexed(rows, ["x", "y"])
    with pytest.raises(ValueError):
        index.reindexed(index.reindexed(table0, ["y", "x"]), ["y", "x", "z"])
    assert index.reindexed(AxisTable(df.filter("false")), ["k"]).df.count() == 0


def test_blocks(table0):
    assert got(blocks.partition_rows(table0.df, ["row"], [4]), "row", "row_block") == [(r, r // 4) for r in range(12)]
    halo = blocks.blocks_and_halos(table0.df, "row", 4, 1, 12)
    assert got(halo, "block", "row") == sorted((b, r) for b in range(3) for r in range(max(0, 4 * b - 1), min(12, 4 * b + 5)))
    alone = blocks.blocks_and_halos(table0.df, "row", 4, 0, 12)
    assert got(alone, "block", "row") == [(r // 4, r) for r in range(12)]
    gaps = blocks.partition_axis(table0.df, "row", 4, 1, (0, 1))
    assert got(gaps, "block", "row") == [(0, 1), (0, 2), (1, 5), (1, 6), (2, 9), (2, 10)]
    with pytest.raises(ValueError):
        blocks.partition_axis(table0.df, "row", 0)
    with pytest.raises(ValueError):
        blocks.partition_rows(table0.df, ["row"], [4, 4])


def test_columns(spark, table0):
    assert columns.remove_columns(table0, ["z"]).df.columns == ["row", "x", "y"]
    with pytest.raises(ValueError):
        columns.remove_columns(table0, ["row"])
    assert columns.remove_columns(table0, ["row", "x", "y", "z"]).df.columns == []
    with pytest.raises(ValueError):
        columns.add_columns(table0.df, {"x": F.lit(1)})
    found = columns.profile_columns(table0.df, SCHEMAS["DATA_DESCRIPTION"]).collect()
    assert [r["present"] for r in found] == [False] * 4


def test_storage(spark, table0, tmp_path):
    both = index.reindexed(AxisTable(tables.with_metadata(table0.df, "z", measure={"class": "epoch", "ref": "UTC"}, unit="s")), ["x", "y"])
    both = AxisTable(tables.with_metadata(both.df, "z", unit="s"), both.index_axes, both.dims, "u")
    tables.write_table(both, str(tmp_path / "t"))
    back = tables.load_table(spark, str(tmp_path / "t"))
    assert back.index_axes == ("x", "y") and back.uid == "u" and tables.metadata(back.df, "z")["unit"] == "s"
    assert got(back.df, "x_at", "y_at", "z") == got(both.df, "x_at", "y_at", "z")
    with pytest.raises(Exception, match="exists"):
        tables.write_table(both, str(tmp_path / "t"))
    with pytest.raises(ValueError):
        tables.attach(spark, {"z": ""}, ["row"])
    with pytest.raises(ValueError):
        tables.attach(spark, {"z": str(tmp_path / "t/facts")}, ["other"])
    assert tables.chosen_tables(["a", "b", "c"], ["~b"]) == ["a", "c"] and tables.chosen_tables(["a", "b"], ["a", "~a"]) == ["a"]


def test_time_average(spark):
    z = lambda a, b: (float(a), float(b))
    rows = [(1.0, [[z(1, 1), z(3, 1)]]), (1.0, [[z(5, -1), z(7, -1)]]), (2.0, [[z(2, 0), z(4, 2)]])]
    df = spark.createDataFrame(rows, "time double, data array<array<struct<re:float,im:float>>>")
    assert got(agg.average_by(df, ["time"], "data"), "time", "re", "im") == [(1.0, 4.0, 0.0), (2.0, 3.0, 1.0)]


@pytest.mark.parametrize("n", [4, 5])
def test_transform(spark, n):
    plane = cf.cf_axes([spark.range(2).toDF("key")], n).withColumn("value", cplx(F.lit(1.0), F.lit(0.0)))
    out = cf.cf_fft(plane, ["key"], n)
    peak = [r for r in out.collect() if abs(r["re"]) > 1e-9 or abs(r["im"]) > 1e-9]
    at = -(n // 2 + 1) % n
    assert [(r["x"], r["y"], round(r["re"], 9)) for r in peak] == [(at, at, n * n)] * 2
    bumpy = plane.withColumn("value", cplx(F.col("x") * 1.5 - F.col("y"), F.col("key") + F.col("y")))
    one = {(r["key"], r["x"], r["y"]): (r["re"], r["im"]) for r in cf.cf_fft(bumpy, ["key"], n).collect()}
    two = {(r["key"], r["x"], r["y"]): (r["re"], r["im"]) for r in cf.cf_fft_sums(bumpy, ["key"], n).collect()}
    assert one.keys() == two.keys() and all(math.isclose(a, b, abs_tol=1e-9) for k in one for a, b in zip(one[k], two[k], strict=True))


def test_product_centres_the_smaller_grid(spark):
    axis = spark.range(1).toDF("key")
    make = lambda n, v: cf.cf_axes([axis], n).withColumns({"value": cplx(F.lit(v), F.lit(0.0)), "weight": F.lit(1.0)})
    out = cf.cf_product(make(5, 2.0), 5, make(3, 3.0), 3, ["key"])
    assert {(r["x"], r["y"]): r["value"]["re"] for r in out.collect()} == {
        (x, y): 6.0 if 1 <= x <= 3 and 1 <= y <= 3 else 2.0 for x in range(5) for y in range(5)
    }
    with pytest.raises(ValueError):
        cf.cf_product(make(5, 2.0), 5, make(2, 3.0), 2, ["key"])
    centre = [
        r for r in cf.ps_term(
            cf.grid_coordinates(cf.cf_axes([axis.withColumn("ps_scale", F.lit(0.4))], 5), 5, 2.5)
        ).collect() if (r["x"], r["y"]) == (2, 2)
    ]
    assert centre[0]["value"]["re"] == 1.0


def test_series_terms_are_orthogonal_on_the_disk():
    terms = cf.zernike_terms(tabulated=False)
    assert len({(m, n) for m, n, *_ in terms}) == 66
    assert [t for t in terms if t[:2] == (-2, 2)] == [(-2, 2, 0, 0, -1), (-2, 2, 0, 2, 2), (-2, 2, 2, 0, 2)]
    assert [t for t in terms if t[:2] == (3, 3)] == [(3, 3, 0, 3, 1), (3, 3, 2, 1, -3)]

    def moment(p, q):  # of x^p y^q over the unit disk
        if p % 2 or q % 2:
            return 0.0
        return 2 * math.gamma((p + 1) / 2) * math.gamma((q + 1) / 2) / math.gamma((p + q + 2) / 2) / (p + q + 2)

    series = {}
    for m, n, px, py, c in terms:
        series.setdefault((m, n), []).append((px, py, c))
    for a, one in series.items():
        for b, two in series.items():
            product = sum(c * d * moment(p + r, q + s) for p, q, c in one for r, s, d in two)
            assert (product > 1e-3) if a == b else abs(product) < 1e-6
    changed = set(cf.zernike_terms()) ^ set(terms)
    assert {t[:4] for t in changed} == cf.OPPOSITE_SIGN


def test_every_declared_type_is_a_spark_type(spark):
    assert len(SCHEMAS) == 18
    for schema in SCHEMAS.values():
        empty = spark.createDataFrame([], ", ".join(f"`{name}` {kind}" for name, (kind, _) in schema.items()))
        assert {f.name: f.dataType.simpleString() for f in empty.schema} == {name: kind for name, (kind, _) in schema.items()}
