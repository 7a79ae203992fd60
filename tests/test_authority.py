"""The authority operators on small graphs, against plain-Python versions and known cases."""

import random

import pytest
from pyspark.sql import functions as F

from clearframe.functions import scalars as S
from clearframe.operators import audit, diff
from clearframe.operators.propagate import excess_capabilities, witness_paths
from clearframe.plans.lineage import closure


def one(spark, column, *values):
    names = [f"c{i}" for i in range(len(values))]
    return spark.createDataFrame([values], ", ".join(f"{n} string" for n in names)).select(column(*[F.col(n) for n in names]).alias("x")).first()["x"]


def test_closure_is_the_least_fixed_point(spark):
    r = random.Random(1)
    for _ in range(4):
        n = 25
        edges = {(r.randrange(n), r.randrange(n)) for _ in range(40)}
        seeds = {(r.randrange(3), r.randrange(n)) for _ in range(5)}
        want = set(seeds)
        while True:
            more = want | {(t, b) for t, x in want for a, b in edges if a == x}
            if more == want:
                break
            want = more
        got = closure(spark.createDataFrame(list(seeds), "token int, node int"), spark.createDataFrame(list(edges), "src int, dst int"), ["token"]).collect()
        assert {(x["token"], x["node"]) for x in got} == want and len(got) == len(want)


def test_witness_path_ends_in_a_cycle(spark):
    w = spark.createDataFrame([("all", "e", "P", "network", "A"), ("all", "e", "A", "network", "B"), ("all", "e", "B", "network", "A")], "snap string, lattice string, sym string, token string, callee string")
    start = w.where("sym = 'P'").select("snap", "lattice", "sym", "token")
    assert sorted((x["hop_ix"], x["hop"]) for x in witness_paths(w, start).collect()) == [(1, "A"), (2, "B")]


@pytest.mark.parametrize(
    "pattern, value, match",
    [("*.example.com", "a.example.com", True), ("*.example.com", "example.com", False), ("a?c", "abc", True), ("a?c", "ac", False), ("*", "x/y\nz", True), ("a.c", "abc", False), ("a*", "b", False), ("[x]", "[x]", True)],
)
def test_target_globs(spark, pattern, value, match):
    assert one(spark, S.glob_matches, pattern, value) is match


def test_path_globs():
    import re

    fits = lambda p, v: re.match(S.path_glob_regex(p).replace(r"\z", r"\Z"), v) is not None
    assert fits("src/*.ts", "src/a.ts") and not fits("src/*.ts", "src/b/a.ts") and fits("src/**/a.ts", "src/a.ts") and fits("src/**", "src/x/y") and not fits("a?c", "abc") and fits("a?c", "a?c")


def test_scalars(spark):
    assert one(spark, S.capability_parts, " http:get:a:b ").asDict() == {"resource": "http", "action": "get", "target": "a:b"}
    assert one(spark, S.capability_parts, "h*:get:x") is None and one(spark, S.capability_parts, "db:read") is None
    assert one(spark, S.capabilities_tag, "db:read:x, db:read:x") == ["db:read:x", "db:read:x"] and one(spark, S.capabilities_tag, "db:read:x, bad") is None
    assert one(spark, S.host_of, "https://u:p@API.example.com:8080/x") == "api.example.com:8080" and one(spark, S.host_of, "/v1") is None
    assert one(spark, S.sql_direction, " ( SELECT 1") == "read" and one(spark, S.sql_direction, "with x") == "both"
    assert one(spark, S.with_node_prefix, "fs/promises.rm") == "node:fs/promises.rm" and one(spark, S.with_node_prefix, "lodash.map") == "lodash.map"
    assert one(spark, S.display_name, "a.ts#X.constructor") == "X.constructor" and one(spark, S.display_name, "a.ts#X.y") == "y"
    assert one(spark, S.budget_fields, "timeMs=5 llmCalls=2")["on_exceed"] == "throw" and one(spark, S.budget_fields, "timeMs=5 timeMs=6") is None and one(spark, S.budget_fields, "llmCalls=1.5") is None
    assert one(spark, S.boundary_reason, 'reason="a b"') == "a b" and one(spark, S.boundary_reason, "reason=") is None
    assert one(spark, S.annotation_property, "a:b,c%\n") == "a%3Ab%2Cc%25%0A"


def test_containment_is_directional(spark):
    schema = "sym string, token string"
    need = spark.createDataFrame([("f", "http:get:a.example.com"), ("f", "http:get:*"), ("g", "db:read:x")], schema)
    give = spark.createDataFrame([("f", "http:get:*.example.com"), ("g", "db:write:x")], schema)
    assert sorted(x["token"] for x in excess_capabilities(need, give, ["sym"]).collect()) == ["db:read:x", "http:get:*"]


def test_ledger_lines_already_in_base_are_spent(spark):
    schema = "side string, line long, symbol string, kind string, name string"
    ledger = spark.createDataFrame([("base", 1, "s", "effect", "env"), ("head", 1, "s", "effect", "env"), ("head", 9, "t", "effect", "env")], schema)
    asked = spark.createDataFrame([("s", "effect", "env"), ("t", "effect", "env"), ("t", "effect", "env")], "symbol string, kind string, name string")
    assert sorted((x["symbol"], x["status"]) for x in diff.review(asked, ledger).collect()) == [("s", "unapproved"), ("t", "approved"), ("t", "unapproved")]


def test_ledger_region(spark):
    text = ["- `x` `effect:env` — before", "# Approvals", "- `a#b` `effect:env` — because", "- `bad` line"]
    rows = diff.parse_ledger(spark.createDataFrame([("head", i, t) for i, t in enumerate(text)], "side string, line int, text string")).collect()
    assert sorted((x["line"], x["malformed"]) for x in rows) == [(2, False), (3, True)]


def test_audit_has_no_row_without_context(spark):
    req = spark.createDataFrame([(1, 1, "http:get:a.com"), (1, 2, "http:post:a.com"), (2, 3, "http:get:a.com")], "ctx int, seq int, cap string")
    grants = spark.createDataFrame([(1, "http:get:*")], "ctx int, cap string")
    assert sorted((x["seq"], x["granted"]) for x in audit.decisions(req, grants).collect()) == [(1, True), (2, False)]


def test_streamed_audit_equals_batch(spark, tmp_path):
    from clearframe.streaming.audit import audit_stream

    req = spark.createDataFrame([(i % 3, i, f"http:get:h{i % 2}.com") for i in range(20)], "ctx int, seq int, cap string")
    req.write.parquet(f"{tmp_path}/in")
    grants = spark.createDataFrame([(0, "http:get:h0.com"), (1, "http:get:*")], "ctx int, cap string")
    stream = spark.readStream.schema(req.schema).parquet(f"{tmp_path}/in")
    q = audit_stream(stream, grants, f"{tmp_path}/out", f"{tmp_path}/check")
    q.awaitTermination(60)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(spark.read.parquet(f"{tmp_path}/out")) == key(audit.decisions(req, grants))


def test_generations_commit_whole(spark, tmp_path):
    from clearframe.streaming.generations import Generations

    store = Generations(str(tmp_path / "facts"))
    assert store.current(spark) is None
    first = spark.createDataFrame([("a.ts", "f"), ("b.ts", "g")], "file string, sym string")
    store.commit(spark, store.patched(spark, first, ["a.ts", "b.ts"]))
    store.commit(spark, store.patched(spark, spark.createDataFrame([("a.ts", "h")], first.schema), ["a.ts"]))
    assert sorted(map(tuple, store.current(spark).collect())) == [("a.ts", "h"), ("b.ts", "g")]
    with pytest.raises(ValueError):
        store.patched(spark, first, ["a.ts"])


def test_queries_and_oracles_are_registered():
    import __spark_entry__ as entry

    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 100


def test_comparisons_start_from_kept_rows(spark):
    from clearframe.plans import catalogue

    p = catalogue.program(spark, "/root/testdata/sf0.001").at(*catalogue.BOTH)
    joins = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    assert joins(p.contribution) == 0
    assert joins(diff.holdings(p)) == 1 and joins(diff.authority_changes(p)) < 12


def test_a_comparison_joins_both_snapshots_at_once(spark):
    from clearframe.plans import catalogue

    p = catalogue.program(spark, "/root/testdata/sf0.001").at(*catalogue.BOTH)
    assert diff.authority_changes(p)._jdf.queryExecution().optimizedPlan().toString().count("Join ") <= 4


def test_what_reads_a_comparison_starts_from_its_kept_rows(spark):
    from clearframe.plans import catalogue

    plan = lambda key: catalogue.QUERIES[key](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan("p08_diff_views").count("Join ") == 0
    assert plan("u10_unchanged").count("Join ") <= 2
    # the ledger's side joins orders, functions, effects and the spent lines; the changes come in by one full join
    assert plan("j09_ledger_match").count("FullOuter") == 1 and plan("j09_ledger_match").count("regexp_extract") == 0


def test_bodies_pick_their_calls_before_they_meet_contributions(spark):
    from clearframe.operators import propagate
    from clearframe.sources.facts import Facts

    p = propagate.Program(Facts(spark, "/root/testdata/sf0.001")).at("base", "head")
    assert p.declared._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 0
    bodies = p.bodies()
    assert bodies._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    # the same rows, picked last
    several = p.calls.groupBy("snap", "sym").agg(F.countDistinct("body_ix").alias("n")).where("n > 1")
    free = p.nodes.where("not declared and not boundary").groupBy("snap", "sym").count().where("count = 2")
    every = propagate.direct_tokens(p.calls, ("body_ix",)).unionByName(p.inherited("body_ix").select("snap", "lattice", "sym", "body_ix", "token")).distinct()
    want = every.join(several, ["snap", "sym"], "left_semi").join(free, ["snap", "sym"], "left_semi")
    rows = lambda df: sorted(map(tuple, df.select("snap", "lattice", "sym", "body_ix", "token").collect()))
    assert rows(bodies) == rows(want) != []


def test_the_driver_is_trimmed_around_the_statements_of_a_comparison(spark, monkeypatch):
    from clearframe.operators import propagate
    from clearframe.plans import lineage
    from clearframe.sources.facts import Facts

    shares, trim = [], lambda spark, share: shares.append(share)
    monkeypatch.setattr(lineage, "trim", trim)
    monkeypatch.setattr(propagate, "trim", trim)
    p = propagate.Program(Facts(spark, "/root/testdata/sf0.001")).at("base", "head")
    diff.unchanged(p)
    # before and after the calls; edges, declarations, contributions, picked calls, bodies, changes
    assert shares.count(propagate.SHARE) == 8 and shares[:2] == [propagate.SHARE] * 2 and shares[-1] == propagate.SHARE
