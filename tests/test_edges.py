"""Refusals and edges of the table operators."""

from __future__ import annotations

import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from axistab.functions import expr
from axistab.functions.cplx import cplx
from axistab.model import AxisSet, AxisTable
from axistab.operators import blocks, columns, index, joins
from axistab.plans import cf
from axistab.sources import tables
from axistab.sources.scratch import free, stage


def got(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_axis_sets_conform_by_uid_and_leading_axes():
    index_axes = AxisSet("u", ("x", "y"))
    assert AxisSet("u", ("x", "y")).conforms(index_axes) and AxisSet("u", ("x", "y", "chan")).conforms(index_axes)
    assert not AxisSet("v", ("x", "y")).conforms(index_axes), "another uid"
    assert not AxisSet("u", ("y", "x", "chan")).conforms(index_axes) and not AxisSet("u", ("x",)).conforms(index_axes)
    assert AxisSet("u", ("y",)).conforms(index_axes, is_index=True)
    assert not AxisSet("u", ("chan",)).conforms(index_axes, is_index=True) and not AxisSet("u", ("x", "y")).conforms(index_axes, is_index=True)


def test_add_columns_from_conforming_tables(spark):
    table = AxisTable(spark.createDataFrame([(i, i * 10) for i in range(4)], "row long, a long"), uid="u")
    more = spark.createDataFrame([(i, [i, i]) for i in range(4)], "row long, b array<long>")
    out = columns.add_columns_from(table, (AxisSet("u", ("row", "chan")), more))
    assert got(out.df, "row", "a", "b") == [(i, i * 10, [i, i]) for i in range(4)] and out.uid == "u"
    refused = [
        [(AxisSet("v", ("row",)), more)], [(AxisSet("u", ("chan",)), more)], [(AxisSet("u", ("row",)), more.filter("row < 3"))],
        [(AxisSet("u", ("row",)), more.unionByName(more))], [(AxisSet("u", ("row",)), more), (AxisSet("u", ("row",)), more.toDF("row", "c"))],
        [(AxisSet("u", ("row",)), more.toDF("row", "a"))], [(AxisSet("u", ("row",)), more.toDF("r", "b"))],
    ]
    for others in refused:
        with pytest.raises(ValueError):
            columns.add_columns_from(table, *others)
    answer = lambda *a, **k: columns.is_conformant(*a, **k).first()["conformant"]
    axes = (table.axes, AxisSet("u", ("row",)))
    assert answer(table.df, more, ["row"], axes) and not answer(table.df, more.limit(2), ["row"], axes)
    assert not answer(table.df, more, ["row"], (table.axes, AxisSet("v", ("row",))))
    assert answer(table.df, more.limit(2), ["row"], axes, is_index=True)


def test_reindexing_keeps_the_uid(spark):
    table = AxisTable(spark.createDataFrame([(0, 1, 5), (1, 2, 6)], "row long, k int, v int"), uid="u")
    assert index.reindexed(table, ["k"]).uid == "u" and index.reindexed(table, ["k"], allow_rows=True).axes == AxisSet("u", ("k", "row"))


def test_align_refuses_what_would_multiply_or_vanish(spark):
    a, b = spark.createDataFrame([(1, 1), (None, 2)], "k int, x int"), spark.createDataFrame([(1, 3), (None, 4)], "k int, y int")
    assert got(joins.align_rows(a, b, ["k"]), "k", "x", "y") == [(1, 1, 3), (None, 2, 4)]
    for other in (b.unionByName(b), b.limit(1), b.filter("false")):
        with pytest.raises(ValueError):
            joins.align_rows(a, other, ["k"])
    with pytest.raises(ValueError):
        joins.align_rows(a, b, ["k"], (AxisSet("u", ("k",)), AxisSet("v", ("k",))))


def test_attach_several_paths_and_refuse_other_domains(spark, tmp_path):
    df = spark.createDataFrame([(i, i * 2, str(i)) for i in range(6)], "row long, a long, b string")
    df.select("row", "a").write.parquet(str(tmp_path / "a"))
    df.select("row", "b").write.parquet(str(tmp_path / "b"))
    df.filter("row < 5").select("row", "b").write.parquet(str(tmp_path / "short"))
    out = tables.attach(spark, {"a": str(tmp_path / "a"), "b": str(tmp_path / "b")}, ["row"])
    assert got(out, "row", "a", "b") == got(df, "row", "a", "b")
    with pytest.raises(ValueError):
        tables.attach(spark, {"a": str(tmp_path / "a"), "b": str(tmp_path / "short")}, ["row"])


def test_export_finds_warns_and_refuses(spark, tmp_path):
    for name, rows in (("one", 3), ("two", 2), ("none", 0)):
        spark.range(rows).write.parquet(str(tmp_path / f"in/{name}.parquet"))
    source = str(tmp_path / "in")
    assert tables.stored_tables(spark, source) == ["none", "one", "two"]
    assert tables.export_dataset(spark, source, str(tmp_path / "all")) == ["one", "two"]
    with pytest.warns(UserWarning, match="ignored"):
        assert tables.export_dataset(spark, source, str(tmp_path / "some"), names=["two", "~one"]) == ["two"]
    with pytest.raises(ValueError):
        tables.export_dataset(spark, source, str(tmp_path / "x"), names=["three"])


def test_metadata_survives_reindexing_and_storage(spark, tmp_path):
    df = spark.createDataFrame([(0, 1, 5), (1, 2, 6)], "row long, k int, v int")
    about = {"measure": {"class": "epoch", "ref": "UTC"}, "unit": "s", "keyword": [1, 2]}
    laid = index.reindexed(AxisTable(tables.with_metadata(df, "v", **about), uid="u"), ["k"])
    tables.write_table(laid, str(tmp_path / "t"))
    back = tables.load_table(spark, str(tmp_path / "t"))
    assert tables.metadata(back.df, "v") == about and got(back.dims["k"], "coord", "value") == [(0, 1), (1, 2)]


def test_import_applies_the_schema(spark):
    df = spark.createDataFrame([("1", 2.5, "x")], "num_chan string, ref_frequency float, other string")
    out = tables.import_table(df, {"num_chan": ("int", None), "ref_frequency": ("double", "Hz"), "name": ("string", None)})
    assert out.dtypes == [("num_chan", "int"), ("ref_frequency", "double")] and tables.metadata(out, "ref_frequency") == {"unit": "Hz"}
    assert [tuple(r) for r in out.collect()] == [(1, 2.5)]


def test_shapes_at_every_rank(spark):
    rows = [(0, [[1, 2], [3, 4]], [[1], [2]], [[5, 6], [7, 8]]), (1, [[1, 2], [3, 4]], [[1], [2]], [[0, 0], [9, 9]])]
    df = spark.createDataFrame(rows, "row long, a array<array<int>>, b array<array<int>>, c array<array<int>>")
    assert sorted(r["columns"] for r in columns.shape_groups(df, ["a", "b", "c"], "row").collect()) == [["a", "c"], ["b"]]
    odd = spark.createDataFrame([(0, [[], [1]], [[1], []], None)], "row long, a array<array<int>>, b array<array<int>>, c array<array<int>>")
    assert columns.shape_groups(odd, ["a", "b", "c"], "row").count() == 3
    ragged = spark.createDataFrame([(0, [[1, 2]]), (1, [[1], [2]]), (2, [[1, 2]]), (3, None)], "row long, a array<array<int>>")
    assert columns.profile_columns(ragged, {"a": ("array<array<int>>", None)}).first()["shapes"] == 2


def test_collapse_undoes_explode(spark):
    df = spark.createDataFrame([(0, [3, 1]), (1, []), (2, None), (3, [None, 7])], "k long, v array<int>")
    long = columns.explode_elements(df, "v", "pos", "x", keep_empty=True)
    assert got(columns.collapse_elements(long, ["k"], "pos", "x", "v"), "k", "v") == got(df, "k", "v")


def test_keyed_lookup_of_empty_arrays(spark):
    dim = spark.createDataFrame([(1, [5]), (2, []), (3, None)], "d int, e array<int>")
    fact = spark.createDataFrame([(1,), (2,), (3,), (4,)], "k int")
    assert got(joins.keyed_lookup(fact, dim, {"k": "d"}, "e"), "k", "e") == [(1, 5), (2, None), (3, None)]


def test_large_tables_are_not_broadcast(spark):
    assert joins.fits(spark.range(10)) and not joins.fits(spark.range(11), rows=10)
    assert not joins.fits(spark.range(10).select(F.repeat(F.lit("x"), 1000).alias("s")), size=5000)


def test_blocks_of_large_and_negative_coordinates(spark):
    at = [2**53 + 1, -1, -4, -5, 0, 7]
    df = spark.createDataFrame([(c,) for c in at], "row long")
    assert got(blocks.partition_rows(df, ["row"], [2]), "row", "row_block") == sorted(((c, c // 2) for c in at), key=repr)
    big = blocks.partition_axis(spark.createDataFrame([(2**53 + 1,)], "row long"), "row", 2)
    assert [r["block"] for r in big.collect()] == [(2**53 + 1) // 2]


@pytest.mark.parametrize("rank", [1, 2, 3])
def test_halos_over_axes(spark, rank):
    axes, extent, size, border = "xyz"[:rank], 7, 3, 1
    df = spark.range(extent**rank).select(*(F.floor(F.col("id") / extent**i % extent).alias(a) for i, a in enumerate(axes)))
    out = blocks.halos_over_axes(df, dict.fromkeys(axes, size), dict.fromkeys(axes, border), dict.fromkeys(axes, extent))
    cells = [()]
    for _ in axes:
        cells = [(*c, i) for c in cells for i in range(extent)]
    expected = []
    for c in cells:
        held = [()]
        for i in c:
            held = [(*h, b) for h in held for b in range(-(-extent // size)) if b * size - border <= i < b * size + size + border]
        expected += [(*c, *h, all(i // size == b for i, b in zip(c, h, strict=True))) for h in held]
    assert got(out, *axes, *(f"{a}_block" for a in axes), "inner") == sorted(expected, key=repr)
    with pytest.raises(ValueError):
        blocks.partition_axes(df, {}, (AxisSet("u", ("x",)), AxisSet("v", ("x",))))


def test_parts_by_value(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), (None, 3), ("b", 4)], "k string, v int")
    out = got(blocks.partition_by_value(df, ["k"]), "v", "part")
    assert out == [(1, 2), (2, 1), (3, 0), (4, 2)]


def test_ordinals_across_runs(spark, monkeypatch):
    monkeypatch.setattr(index, "RUN", 3)
    rows = [(i, i % 2, i) for i in range(20)]
    out = index.reindexed(AxisTable(spark.createDataFrame(rows, "row long, k long, v long")), ["k"], allow_rows=True)
    assert got(out.df, "k_at", "row", "v") == sorted(((i % 2, i // 2, i) for i in range(20)), key=repr)


def test_product_uses_the_first_coordinate_of_other_axes(spark):
    make = lambda df, n, v: cf.cf_axes([df], n).withColumns({"value": cplx(v, F.lit(0.0)), "weight": F.lit(1.0)})
    left = make(spark.range(2).toDF("k"), 3, F.lit(2.0))
    right = make(spark.range(5, 8).toDF("m"), 3, F.col("m") * 1.0)
    out = cf.cf_product(left, 3, right, 3, [], ["m"]).collect()
    assert len(out) == 18 and {r["value"]["re"] for r in out} == {10.0}
    many = cf.cf_products([(left, 3, ["k"]), (right, 3, ["m"]), (left, 3, ["k"])]).collect()
    assert len(many) == 18 and {r["value"]["re"] for r in many} == {20.0}


def test_nearest_frequencies(spark):
    known = spark.createDataFrame([("a", 1.0, 0, 5.0, 0.0), ("a", 3.0, 0, 7.0, 1.0)], "c string, frequency double, k int, re double, im double")
    wanted = spark.createDataFrame([("a", f) for f in (0.0, 1.0, 2.0, 2.1, 3.0, 9.0)] + [("b", 1.0)], "c string, frequency double")
    out = cf.nearest_frequency_coeffs(wanted, known, ["c"], 1)
    assert got(out, "c", "frequency", "re") == [
        ("a", 0.0, 5.0), ("a", 1.0, 5.0), ("a", 2.0, 5.0), ("a", 2.1, 7.0), ("a", 3.0, 7.0), ("a", 9.0, 7.0), ("b", 1.0, 0.0),
    ]


def test_directions_of_all_components(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0]], 2.0), ([[1.0, 2.0]], 2.0), ([], 2.0)], "p array<array<double>>, t double")
    out = df.select(expr.interp_directions(F.col("p"), F.col("t"), F.lit(0.0)).alias("d")).collect()
    assert [r["d"] for r in out] == [[7.0, 10.0], [1.0, 2.0], []]


def test_time_scales_there_and_back(spark):
    utc = [datetime(2016, 12, 31, 23, 59, 59), datetime(2017, 1, 1), datetime(1972, 1, 1), datetime(1971, 12, 31)]
    df = expr.epoch_shift(
        expr.epoch_shift(spark.createDataFrame([(t,) for t in utc], "t timestamp_ntz").select(F.col("t").cast("timestamp").alias("t")), "t", "tai"),
        "tai", "back", "UTC",
    )
    rows = {
        r["t"]: r for r in df.select(
            "t", ((F.col("tai").cast("double") - F.col("t").cast("double"))).alias("d"), (F.col("back") == F.col("t")).alias("same"),
        ).collect()
    }
    assert [r["d"] for _, r in sorted(rows.items())] == [None, 10.0, 36.0, 37.0]
    assert [r["same"] for _, r in sorted(rows.items())] == [None, True, True, True]


def test_fixed_values_by_name():
    """Values that must stay as they are, stated apart from the code that holds them."""
    at = lambda nu, p, q, top: sum(
        c * (nu * nu - top * top) ** i for i, c in enumerate(p)
    ) / sum(c * (nu * nu - top * top) ** i for i, c in enumerate(q))
    (low, p1, q1), (high, p2, q2) = cf.SPHEROIDAL
    assert abs(at(0, p1, q1, low) - 1) < 1e-4 and abs(at(0.75, p1, q1, low) - 8.203343e-2) < 1e-9 and abs(at(1, p2, q2, high) - 4.028559e-3) < 1e-9
    assert abs(at(0.75, p1, q1, low) - at(0.75, p2, q2, high)) < 1e-5
    terms = {(m, n): sorted((px, py, c) for a, b, px, py, c in cf.zernike_terms() if (a, b) == (m, n)) for m, n in ((0, 4), (2, 4), (-1, 3), (3, 5))}
    assert terms[(0, 4)] == [(0, 0, 1), (0, 2, -6), (0, 4, 6), (2, 0, -6), (2, 2, 12), (4, 0, 6)]
    assert terms[(2, 4)] == [(0, 2, -3), (0, 4, 4), (2, 0, 3), (4, 0, -4)]
    assert terms[(-1, 3)] == [(1, 0, -2), (1, 2, 3), (3, 0, 3)]
    assert dict(expr.LEAP_SECONDS)["2017-01-01"] == 37 and len(expr.LEAP_SECONDS) == 28


def test_staged_tables_can_be_freed(spark):
    held = stage(spark.range(5), "five")
    assert held.count() == 5
    free(held, None, spark.range(1))
    with pytest.raises(Exception):  # noqa: B017
        held.count()


def test_row_lists_refuse_long_lists(spark):
    rows = spark.createDataFrame([(0, "a", r) for r in range(6)] + [(1, "b", 9)], "coord long, value string, row long")
    assert [r["rows"] for r in index.row_lists(rows, 6).orderBy("coord").collect()] == [[0, 1, 2, 3, 4, 5], [9]]
    with pytest.raises(Exception, match="over 5 rows"):
        index.row_lists(rows, 5).collect()


def test_several_tables_in_one_shuffle(spark):
    one = spark.createDataFrame([(1, 2, "a"), (None, 2, None)], "k int, j int, x string")
    two, three = one.select("k", "j", F.lit(5).alias("y")), one.select("k", "j")
    out = joins.aligned([one, two, three], ["k", "j"])
    assert out.columns == ["k", "j", "x", "y"] and sorted(map(tuple, out.collect()), key=repr) == [(1, 2, "a", 5), (None, 2, None, 5)]
    for bad in (two.limit(1), two.unionByName(two)):
        with pytest.raises(ValueError):
            joins.aligned([one, bad], ["k", "j"])


def test_profile_counts_nulls_and_shapes_once(spark):
    df = spark.createDataFrame([(1, [1, 2], None), (None, [3], [[1], [2, 3]]), (2, None, [[1], [2, 3]]), (3, [4], [])], "a int, b array<int>, c array<array<int>>")
    schema = {"a": ("int", "m"), "b": ("array<int>", None), "c": ("array<array<int>>", None), "d": ("int", None)}
    got = {r["name"]: (r["present"], r["cells"], r["shapes"]) for r in columns.profile_columns(df, schema).collect()}
    assert got == {"a": (True, 3, 1), "b": (True, 3, 2), "c": (True, 3, 2), "d": (False, 0, 0)}
    assert {r["cells"] for r in columns.profile_columns(df.limit(0), schema).collect()} == {0}
