from __future__ import annotations

import random

import pytest

CLASHING = ["_text", "_id", "_sha", "_len", "_fp", "_size", "_source", "_name", "c0", "row", "value", "block", "uid", "length", "kept", "rep"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)


def words(rng, stems, n):
    return " ".join(rng.choice(stems) + rng.choice(stems) for _ in range(n))


def messy_rows():
    """Copies, near copies, nulls in every column, empty, blank and very long texts, repeated rows."""
    rng = random.Random(3)
    stems = {"aa": ["ba", "ke", "li", "to", "nu"], "bb": ["shr", "und", "ach", "eit", "ver"]}
    rows = []
    for i in range(80):
        lang = "aa" if i % 3 else "bb"
        rows.append((i, words(rng, stems[lang], 5 + i), lang, f"src{i % 5}"))
    long = words(rng, stems["aa"], 20_000)
    rows += [
        (100, rows[70][1] + " ", "aa", "src1"), (101, rows[70][1].replace(" ", "\n"), "aa", None),
        (102, rows[70][1].rsplit(" ", 1)[0] + " tail", "aa", "src2"),
    ]
    rows += [
        (103, None, "aa", "src0"), (104, "", None, "src0"), (105, " \t\n", "bb", None), (106, long, "aa", "src0"), (107, long, "aa", "src3"),
        (None, "no id here", None, None),
    ]
    rows += [
        (108, "Ünïcode ‘quotes’ 中文字符   x y", "bb", "é"), (109, "12 34 !!", "aa", "src4"), (7, rows[7][1], "aa", "src2"),
        (7, rows[7][1], "aa", "src2"),
    ]
    return [(*r, None if r[1] is None else len(r[1]), *["x"] * len(CLASHING)) for r in rows]


@pytest.fixture(scope="session")
def messy(spark):
    return spark.createDataFrame(messy_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
