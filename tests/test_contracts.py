"""Merged contracts, wrapper rules and runtime requirements on small hand-made tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from clearframe.functions import requirements as Q
from clearframe.operators import contracts as C


def test_exact_key_beats_globs_and_two_globs_are_ambiguous(spark):
    fn = spark.createDataFrame([("a/x.ts#f", "a/x.ts"), ("a/y.ts#f", "a/y.ts"), ("b?.ts#f", "b?.ts")], "sym string, file string")
    config = spark.createDataFrame(
        [("a/x.ts#f", True, "f", "a/x.ts"), ("a/*#f", False, "f", "a/*"), ("**/y.ts#f", False, "f", "**/y.ts"), ("b?.ts#f", True, "f", "b?.ts"), ("gone#f", True, "f", "gone")],
        "key string, exact boolean, decl_sym string, decl_path string",
    )
    got = {r["sym"]: (r["key"], r["ambiguous"]) for r in C.config_matches(config, fn).collect()}
    assert got == {"a/x.ts#f": ("a/x.ts#f", False), "a/y.ts#f": ("**/y.ts#f", True), "b?.ts#f": ("b?.ts#f", False)}
    assert [r["key"] for r in C.unmatched_exact(config, fn).collect()] == ["gone#f"]


def test_merge_prefers_comment_then_config_then_spec(spark):
    tags = spark.createDataFrame(
        [("s", "capabilities", "none", None), ("s", "budget", "none", None), ("s", "effects", "declared", "network"), ("s", "entrypoint", "none", None), ("t", "budget", "invalid", None)],
        "sym string, tag string, kind string, value string",
    )
    matches = spark.createDataFrame([("s", "k", True, False), ("t", "k", True, False)], "sym string, key string, exact boolean, ambiguous boolean")
    config = spark.createDataFrame([("k", "capabilities", "c"), ("k", "effects", "env"), ("k", "entrypoint", "false"), ("k", "budget", None)], "key string, tag string, value string")
    specs = spark.createDataFrame([("s", 2, "late", "late"), ("s", 1, "spec", "first"), ("t", 1, None, "first")], "sym string, ord int, caps string, budget string")
    got = {(r["sym"], r["tag"]): (r["kind"], r["value"], r["origin"], r["diverges"]) for r in C.merged(tags, matches, config, specs).collect()}
    assert got == {
        ("s", "capabilities"): ("declared", "c", "config", False),
        ("s", "budget"): ("declared", "first", "spec", False),
        ("s", "effects"): ("declared", "network", "jsdoc", True),
        ("s", "entrypoint"): ("none", None, None, False),
        ("t", "budget"): ("invalid", None, None, False),
    }


def test_wrapper_capabilities_compare_as_sets(spark):
    contract = spark.createDataFrame([("h", "capabilities", "declared", "b,a"), ("h", "budget", "none", None), ("h", "entrypoint", "none", None)], "sym string, tag string, kind string, value string")
    wrappers = spark.createDataFrame([(1, "h", "a,b", "none"), (2, "h", "a", "timeMs=1"), (3, None, "a", "none"), (4, "h", None, None)], "wrapper int, handler string, caps string, w_budget string")
    got = sorted((r["wrapper"], r["rule"], r["cause"]) for r in C.wrapper_findings(wrappers, contract).collect())
    assert got == [(2, "AMB-E010", "caps-differ"), (2, "AMB-E011", "budget-differs"), (3, "AMB-W004", "no-handler"), (4, "AMB-W004", "budget-not-literal"), (4, "AMB-W004", "caps-not-literal")]


def test_region_and_numbered_keys(spark):
    lines = spark.createDataFrame([("h", 1, False), ("h", 2, True), ("h", 3, False), ("h", 4, True), ("b", 1, False)], "side string, line int, heading boolean")
    assert sorted((r["side"], r["line"]) for r in C.approval_region(lines).collect()) == [("b", 1), ("h", 3), ("h", 4)]
    keys = spark.createDataFrame([("k", 2), ("k", 1), ("m", 1)], "key string, at int")
    assert sorted(tuple(r) for r in C.numbered_keys(keys, "key", "at").collect()) == [("k", 1), ("k #2", 2), ("m", 1)]


@pytest.mark.parametrize(
    ("expression", "expected"),
    [
        (lambda: Q.fetch_requirement(F.lit("POST"), F.lit("https://a.org:443/x")), "http:post:a.org"),
        (lambda: Q.fetch_requirement(F.lit("GET"), F.lit("http://a.org:443/x")), "http:get:a.org:443"),
        (lambda: Q.resolved_path(F.lit("/../a/./b/..//c")), "/a/c"),
        (lambda: Q.resolved_path(F.lit("/")), "/"),
        (lambda: Q.file_requirements(F.lit("rename"), F.array(F.lit("/a"), F.lit("/b"))), ["fs:read:/a", "fs:write:/b"]),
        (lambda: Q.file_requirements(F.lit("other"), F.array(F.lit("/a"))), []),
        (lambda: Q.open_requirements(F.lit("/a"), F.lit("wx+")), ["fs:read:/a", "fs:write:/a"]),
        (lambda: Q.open_requirements(F.lit("/a"), F.lit(None).cast("string")), ["fs:read:/a"]),
        (lambda: Q.spawn_requirement(F.lit("spawn"), F.lit(None).cast("string"), F.lit("false"), "/n"), "proc:spawn:unknown"),
        (lambda: Q.spawn_requirement(F.lit("spawn"), F.lit("ls"), F.lit("true"), "/n"), "proc:spawn:/bin/sh"),
        (lambda: Q.database_requirements(F.lit(""), F.lit("pg://h/my%20db?x=1"), F.lit("with x")), ["db:read:my db", "db:write:my db"]),
    ],
)
def test_requirements(spark, expression, expected):
    assert spark.range(1).select(expression().alias("v")).first()["v"] == expected
