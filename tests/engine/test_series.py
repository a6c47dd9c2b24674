from __future__ import annotations

from chronolith.operators.series import range_diff


def test_range_diff(spark):
    body = lambda x: "".join(f"line {x} {i}\n" for i in range(20))
    rows = [("k", "old", 1, body("a")), ("k", "old", 2, body("b")), ("k", "old", 3, body("c")), ("k", "new", 1, body("b")), ("k", "new", 2, body("a") + "more\n"), ("k", "new", 3, body("z")), ("j", "old", 1, body("a"))]
    got = range_diff(spark.createDataFrame(rows, "key string, side string, pos int, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("k", 2, 1, "="), ("k", 1, 2, "!"), ("k", 3, None, "<"), ("k", None, 3, ">"), ("j", 1, None, "<")], key=str)
