"""Extra columns with clashing names in every stage, two texts under one doc_id, and component labels."""

import random

import pytest

import corpus_pipeline
from clearframe.llm import neardup

CLASHING = "gone_id gone_id_ bad_id pii_email pii_base pii_spans pii_loose pii_merged pii_ip mix_unit mix_copies mix_key mix_rows row key id unit rows copies each copy component node size target block p label lang_id posterior accepted host site".split()


@pytest.fixture(scope="module")
def clashing_docs(spark):
    base = [(i, f"the quick brown fox number {i} jumps over the lazy dog and writes to joe{i}@example.com today", "en", "s", 10) for i in range(12)]
    docs = spark.createDataFrame(base, "doc_id long, text string, lang string, source string, n_chars long")
    for c in CLASHING:
        docs = docs.selectExpr("*", f"concat('own ', '{c}') as `{c}`")
    return docs


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_clashing_columns_keep_their_values(spark, clashing_docs, name, stage):
    out = stage(spark, clashing_docs, "")
    rows = out.collect()
    assert rows
    if name != "packing":
        assert out.columns == clashing_docs.columns
        assert all(r[c] == f"own {c}" for r in rows for c in CLASHING)
    if name == "pii":
        assert all("[EMAIL]" in r["text"] and r["n_chars"] == len(r["text"]) for r in rows)


@pytest.mark.parametrize("n, m", [(30, 20), (200, 600), (60, 59)])
def test_components_are_the_smallest_reachable_nodes(spark, n, m):
    r = random.Random(n)
    edges = {(r.randrange(n), r.randrange(n)) for _ in range(m)} if m != 59 else {(i, i + 1) for i in range(59)}
    edges = {(a, b) for a, b in edges if a != b}
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {x["node"]: x["component"] for x in neardup.components(spark.createDataFrame(list(edges), "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


def test_few_edges_take_few_jobs_and_give_what_the_rounds_give(spark, monkeypatch):
    r = random.Random(5)
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 90) if i % 30] + [(a, a + r.randrange(1, 400)) for a in r.choices(range(100, 900), k=500)], "a long, b long")
    context = spark.sparkContext
    context.setJobGroup("few edges", "")
    few = sorted(map(tuple, neardup.components(edges).collect()))
    jobs = context.statusTracker().getJobIdsForGroup("few edges")
    context.setJobGroup("rounds", "")
    monkeypatch.setattr(neardup, "EDGES", -1)
    rounds = sorted(map(tuple, neardup.components(edges).collect()))
    assert few == rounds and len(few) == len({x for x, _ in few})
    assert len(jobs) <= 6 < len(context.statusTracker().getJobIdsForGroup("rounds"))
    assert neardup.components(edges.limit(0)).collect() == []


def test_two_texts_under_one_doc_id_give_one_result(spark):
    first, second = "a b c d e f g h i j", "k l m n o p q r s t"
    rows = [(1, first), (2, first), (3, second), (3, first), (4, second)]
    schema = "doc_id long, text string"
    runs = [sorted(map(tuple, neardup.near_duplicates(spark.createDataFrame(rows[::step], schema).repartition(parts)).select("doc_id", "component_id").distinct().collect())) for step, parts in ((1, 1), (-1, 3))]
    assert runs[0] == runs[1] and len(runs[0]) == 4
    assert dict(runs[0])[2] == 1 and (dict(runs[0])[3] == 1) != (dict(runs[0])[4] == 3)
