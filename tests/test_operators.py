import fnmatch
import re

import pytest
from pyspark.sql import functions as F

from lattica.operators import aggregates, joins, names


@pytest.mark.parametrize("pattern", ["app/*.py", "a?c", "[ab]*", "[!a]x", "a.b", "x[", "**/t_*.py"])
def test_globs_match_as_fnmatch_does(pattern):
    for text in ["app/x/y.py", "abc", "a/c", "bz", "bx", "ax", "a.b", "acb", "x[", "d/e/t_1.py", "app/m.pyc"]:
        assert bool(re.match(names.glob_regex(pattern).replace("\\z", "\\Z"), text)) == fnmatch.fnmatchcase(text, pattern)


def test_prefix_join_takes_the_longest_and_keeps_the_rest(spark):
    left = spark.createDataFrame([("a.b.c",), ("a.bc",), ("z",), (None,)], "name string")
    right = spark.createDataFrame([("a", 1), ("a.b", 2)], "prefix string, v int")
    got = {r["name"]: r["v"] for r in names.prefix_join(left, "name", right, "prefix", "left").collect()}
    assert got == {"a.b.c": 2, "a.bc": 1, "z": None, None: None}


def test_bind_arguments(spark):
    calls = spark.createDataFrame([(1, "f", [(None, 0, "x"), ("b", None, "y")]), (2, "f", [(None, 0, "x"), ("a", None, "y")]), (3, "f", [("c", None, "y"), (None, 0, "x")]), (4, "f", [("b", None, "y")])], "call_id int, function string, args array<struct<name:string,position:int,value:string>>")
    params = spark.createDataFrame([("f", "a", 0, "positional_or_keyword", True), ("f", "b", 1, "positional_or_keyword", False)], "function string, name string, position int, kind string, required boolean")
    assert set(map(tuple, joins.bind_arguments(calls, params).collect())) == {(1, "a", "x"), (1, "b", "y")}


def test_containment_meets_each_pair_once(spark):
    outer = spark.createDataFrame([("k", 1, 0, 500), ("k", 2, 60, 70)], "k string, o int, start int, end int")
    inner = spark.createDataFrame([("k", 7, 63, 65), ("k", 8, 490, 510)], "k string, i int, start int, end int")
    assert sorted((r.o, r.inner_i) for r in joins.containment_join(outer, inner, ["k"]).collect()) == [(1, 7), (2, 7)]


def test_exit_codes(spark):
    schema = "verdict string, level string, disposition string"
    none = spark.createDataFrame([], "code string")
    code = lambda rows, issues=none: aggregates.exit_code(spark.createDataFrame(rows, schema), issues).first()[0]
    assert code([]) == 0
    assert code([("fail", "advisory", "active"), ("fail", "enforced", "ignored"), ("indeterminate", "advisory", "active")]) == 0
    assert code([("fail", "enforced", "active")]) == 1
    assert code([("fail", "enforced", "active"), ("indeterminate", "enforced", "active")]) == 2
    assert code([], spark.createDataFrame([("X",)], "code string")) == 2


def test_nearest_rank_limits(spark):
    files = spark.createDataFrame([("r", n) for n in range(1, 401)], "role string, n int")
    assert aggregates.size_limits(files, ["role"], "n").first().max_lines == 500  # p95 380, with headroom 456
    assert names.module_identity(F.lit("a")) is not None
