"""The distributed loop and the one-task solver against a plain fixed point."""

import random

import pytest

from clearframe.plans import lineage, local


@pytest.mark.parametrize("rows, most, fan", [(500_000, 4_000_000, 50_000), (0, 0, 50_000), (0, 0, 5), (500_000, 10, 50_000)])
def test_masks_reach_all_that_edges_reach(spark, monkeypatch, rows, most, fan):
    monkeypatch.setattr(local, "ROWS", rows)
    monkeypatch.setattr(local, "MOST", most)
    monkeypatch.setattr(lineage, "FAN", fan)
    r = random.Random(3)
    edges = {(r.randrange(2), r.randrange(4) if r.random() < 0.5 else r.randrange(20), r.randrange(20)) for _ in range(60)}
    seeds = {(r.randrange(2), r.choice("xy"), r.randrange(20), 1 << r.randrange(3)) for _ in range(7)}
    want: dict = {}
    for g, k, x, m in seeds:
        want[g, k, x] = want.get((g, k, x), 0) | m
    changed = True
    while changed:
        changed = False
        for g, a, b in edges:
            for k in "xy":
                v, o = want.get((g, k, a), 0), want.get((g, k, b), 0)
                if v & ~o:
                    want[g, k, b], changed = o | v, True
    got = lineage.fixed_point(spark.createDataFrame(list(seeds), "g int, k string, node int, mask long"), spark.createDataFrame(list(edges), "g int, src int, dst int"), ["k", "g"]).collect()
    assert {(x["g"], x["k"], x["node"]): x["mask"] for x in got} == want and len(got) == len(want)


def test_no_seeds_give_no_rows(spark):
    edges = spark.createDataFrame([(1, 2)], "src int, dst int")
    assert lineage.closure(spark.createDataFrame([], "node int"), edges, []).collect() == []


def test_known_rows_stay_where_they_lie(spark):
    rows = spark.range(20).selectExpr("id % 3 as g", "id as node", "1L as mask")
    with lineage.dealt(spark) as n:
        known = lineage.checkpointed(rows.repartition(n, "g", "node"))
        new = rows.repartition(n, "g", "node").union(known.select("g", "node", "mask"))
        plan = new.groupBy("g", "node").agg({"mask": "max"})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_a_heap_that_grew_is_given_back(spark):
    java = spark._jvm.java
    runtime, buffers = java.lang.Runtime.getRuntime(), java.nio.ByteBuffer
    kept = [buffers.allocate(256 << 20) for _ in range(6)]
    grown = runtime.totalMemory()
    del kept
    lineage.release(spark)
    total, used = runtime.totalMemory(), runtime.totalMemory() - runtime.freeMemory()
    assert grown > 1 << 30 and total * (1 - lineage.SPARE / 100) < used + (128 << 20)
    assert lineage._managed(spark.sparkContext, "HotSpotDiagnostic", "getVMOption", lineage._FREE).get("value") == "70"
